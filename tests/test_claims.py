from chirrup.operators import quality


def test_published_figures_agree_within_their_last_digit(spark, tmp_path):
    stats = spark.createDataFrame([("a", 10, 2.345), ("b", 4, 1.0), (None, 1, 0.5)], "platform string, n_posts long, avg_likes double")
    path = str(tmp_path / "claims")
    quality.publish_claims(stats, "platform", {"n_posts": 0, "avg_likes": 2}, path)
    claims = quality.read_claims(spark, "platform", path)
    assert {(r.platform, r.claim, r.published) for r in claims.collect()} >= {("a", "n_posts", "10"), ("b", "avg_likes", "1.00")}
    assert all(r.agrees for r in quality.check_claims(claims, stats, "platform").collect())

    now = spark.createDataFrame([("a", 11, 2.3499), ("c", 7, 0.0), (None, 1, 0.5)], "platform string, n_posts long, avg_likes double")
    got = {(r.platform, r.claim): (r.claimed, r.recomputed, r.agrees) for r in quality.check_claims(claims, now, "platform").collect()}
    assert got[("a", "n_posts")] == (10.0, 11.0, False)
    assert got[("a", "avg_likes")][2] is (abs(got[("a", "avg_likes")][0] - 2.3499) <= 0.005)
    assert got[("b", "n_posts")] == (4.0, None, False) and got[("c", "n_posts")] == (None, 7.0, False)
    assert got[(None, "n_posts")] == (1.0, 1.0, True) and len(got) == 8


def test_claims_that_are_no_numbers_or_name_nothing_disagree(spark):
    stats = spark.createDataFrame([("a", 10)], "platform string, n_posts long")
    claims = spark.createDataFrame(
        [("a", "n_posts", "many"), ("a", "n_users", "3"), ("a", "n_posts", None)], "platform string, claim string, published string"
    )
    rows = quality.check_claims(claims, stats, "platform").collect()
    assert len(rows) == 3 and not any(r.agrees for r in rows)
    assert quality.check_claims(claims.limit(0), stats, "platform").count() == 0
