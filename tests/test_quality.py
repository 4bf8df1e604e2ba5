"""Expectations on keys."""

from chirrup.operators import quality


def test_keys_are_counted_in_parts_that_stay_small(spark):
    """Parts that Spark merges into a few held, in one task, the keys of all of them (before: as many as there are cores)."""
    rows = [(i, "x") for i in range(300)] + [(7, "x"), (7, "y"), (None, "x"), (None, "x")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {(r.k, r.t): r.rows for r in quality.duplicates(df, ["k", "t"]).collect()}
    assert got == {(7, "x"): 2, (None, "x"): 2}
    assert [(r.expectation, r.violations) for r in quality.unique(df, ["k"], "n").collect()] == [("n", 3)]
    assert quality.duplicates(df, ["k"]).select("k").rdd.getNumPartitions() == quality.KEY_PARTS
