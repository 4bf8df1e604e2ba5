import html
import random

import pytest
from pyspark.sql import functions as F

from chirrup.constants import STOPWORDS
from chirrup.functions import social_text as st
from chirrup.functions import strings
from chirrup.operators import intake

REPAIRS = [
    ("NULL&amp;", None), ("NULLÃ©", None), ("TrailÃ©", "Trail"), ("café", "café"),
    ("<div>Great phone, #Tag&amp;", "Great phone, #Tag"), ("Love it #Fashion, &amp;<br>", "Love it #Fashion"),
    ("a &lt;br&gt; b", "a b"), ("  two  spaces ", "two spaces"), ("日本 Ã©", "日本 Ã©"), ("NULL\n\n", None),
    ("x &eacute;&#33;", "x é!"), ("a<b<br>r>b", "ab"), ("a&&,,& ", "a"), ("　wide ", "wide"), (None, None),
]


def test_text_repair(spark):
    df = spark.createDataFrame(REPAIRS, "text_content string, want string")
    assert [(r.text_content, r.want) for r in intake.repair_text(df).collect() if r.text_content != r.want] == []


def test_text_repair_counts_every_hit(spark):
    df = spark.createDataFrame([("<div>a&&, &amp;,<br>",)], "text_content string")
    r = intake.repair_text(df).first()
    assert (r.hit_html_tag, r.hit_stray_amp, r.hit_trailing_comma, r.hit_html_entity) == (1, 3, 2, 1)


TIMES = [
    ("2025-04-13T20:12:18", "2025-04-13 20:12:18", "iso8601"), ("1722528840", "2024-08-01 16:14:00", "epoch_seconds"),
    ("25-09-2024", "2024-09-25 00:00:00", "dayfirst_dmy"), ("31-13-2024", None, "unparsed"), ("2024/01/02", None, "unparsed"),
    ("NULL", None, "missing"), ("", None, "missing"), (None, None, "missing"),
]


def test_timestamps(spark):
    df = intake.normalise_time(spark.createDataFrame(TIMES, "timestamp string, want string, fmt string"))
    for r in df.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("got"), "want", "fmt", "timestamp_format").collect():
        assert (r.got, r.timestamp_format) == (r.want, r.fmt)


def test_numbers_platform_location(spark):
    df = spark.createDataFrame([("-1205.0", "1", ""), ("0", None, "2"), (None, "x", "3")], "likes string, shares string, comments string")
    assert [(r.likes, r.flag_likes_sign_restored) for r in intake.normalise_engagement(df).collect()] == [(1205, True), (0, False), (None, False)]
    assert intake.normalise_engagement(df, restore_sign=False).first().likes is None
    names = spark.createDataFrame([(" x ",), ("insta",), (None,), ("Mastodon",)], "p string")
    assert [r[0] for r in names.select(intake.canonical_platform(F.col("p"))).collect()] == ["Twitter", "Instagram", "Unspecified", "Mastodon"]
    users = spark.createDataFrame([("u", "London, UK", " EN", "2024-01-02", "-3")], "user_id string, location string, language string, account_created string, follower_count string")
    u = intake.repair_users(users).first()
    assert (u.city, u.country, u.language, u.follower_count, str(u.account_created)) == ("London", "United Kingdom", "en", None, "2024-01-02")


def test_intake_closes(spark):
    columns = ", ".join(f"{c} string" for c in intake.RAW_COLUMNS)
    raw = [
        ("P1", "U1", "x", "hello", "2024-05-02T00:00:00", "1", "2", "3"), ("P1", "U1", "x", "hello", "2024-05-02T00:00:00", "1", "2", "3"),
        ("P2", "U2", "NULL", "NULL", "02-05-2024", "-4.0", "", "1"), ("P2", "U2", "", "null", "02-05-2024", "-4.0", "NULL", "1"),
    ]
    job = intake.repair_posts(spark.createDataFrame(raw, columns))
    r = job.counts.first()
    assert (r.raw_rows, r.replay_rows, r.held_out_rows, r.analysis_rows, r.closes) == (4, 2, 1, 1, True)
    assert intake.identity_collisions(job.repaired).count() == 0
    log = {(x.action, x.column): x.rows_affected for x in job.log.collect()}
    assert log[("drop exact duplicate row", "*")] == 2 and log[("textual_NULL -> real NULL", "platform")] == 2


B = "\\"
TOKENS = [
    ("I do not love this boring update", ["not", "NOT_love", "NOT_boring", "NOT_update"]), ("this is not good :)", ["not", "NOT_good", "<smile>"]),
    ("Can't wait", ["not", "NOT_wait"]), ("the a an", ["<empty>"]), ("", ["<empty>"]), (None, ["<empty>"]), ("quick brown fox", ["quick", "brown", "fox"]),
    ("sooo happyyy :) :(", ["soo", "happyy", "<smile>", "<sad>", "<elong>"]), ("no no good", ["no", "no", "NOT_good"]),
    ("not a :) b not c d e f g never", ["not", "<smile>", "NOT_b", "not", "NOT_c", "NOT_d", "NOT_e", "f", "g", "never"]),
]


def test_tokens(spark):
    df = st.normalise_corpus(spark.createDataFrame([(t,) for t, _ in TOKENS], "t string"), "t")
    assert [r.tokens for r in df.collect()] == [w for _, w in TOKENS]


def _scope_by_loop(tokens, window=3):
    out, left = [], 0
    for t in tokens:
        marker = t.startswith("<")
        if t in st.NEGATIONS:
            out.append(t)
            left = window
        else:
            out.append("NOT_" + t if left and not marker else t)
            left -= bool(left and not marker)
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_negation_scope_against_a_loop(spark, window):
    import random

    rng = random.Random(window)
    cases = [" ".join(rng.choice(["not", "never", "<url>", "<smile>", "a1", "b", "nothing2", "cc"]) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", st.negation_scope(F.col("t"), window).alias("s"))
    for r in df.collect():
        assert r.s.split(" ") == _scope_by_loop(r.t.split(" "), window)


def test_escapes_entities_and_marks(spark):
    texts = ["it" + B + "u2019s, ok" + B + "u0021", B + "uZZZZ stays", "Hey @User, see https://x.co/a and #StayHome!", B + "u005cu0041", "&amp;lt;b&amp;gt;"]
    got = st.normalise_corpus(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert got[0].clean == "it's, ok!" and got[1].clean == B + "uZZZZ stays" and got[3].clean == B + "u0041" and got[4].clean == "<b>"
    assert got[2].normalised == "hey <user> see <url> and stayhome <hashtag>"


def test_html_entities_like_the_standard_table(spark):
    texts = ["&eacute;", "&notit;", "&#128512;", "&#x80;", "&amp;amp;", "a & b", "&lt", "&unknown;", "&quot;q&#39;", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(strings.unescape_html(F.col("t"))).collect()
    want = [html.unescape(t) if t is not None else None for t in texts]
    want[6] = html.unescape("&lt")
    assert [r[0] for r in got] == want


def test_any_mix_of_references_decodes_as_in_python(spark):
    from html.entities import html5

    rng = random.Random(5)
    bits = ["&", "&amp;", "&lt", "#", ";", "x", "1", "&#", "&#x", "&#0;", "&#xd800;", "&#x110000;", "&#99999999999;", "&#xfdd0;", "&#0065;", "é", "😀", " ", "\n", "&notit;", "&copy", "ffff"]
    texts = ["".join(rng.choice(bits) if rng.random() < 0.8 else "&" + rng.choice(sorted(html5)) for _ in range(rng.randrange(9))) for _ in range(1500)]
    texts += ["&" + n for n in html5] + [f"&#{n};" for n in range(300)] + ["&#x10FFFF;", "&#xFFFE;", "&#xE000;", "&" + "q" * 60 + ";", "", None]
    once, twice = strings.unescape_html(F.col("t")), strings.unescape_html(F.col("t"), 2)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", once.alias("a"), twice.alias("b"))
    for r in got.collect():
        assert (r.a, r.b) == ((None, None) if r.t is None else (html.unescape(r.t), html.unescape(html.unescape(r.t))))
    plan = spark.range(1).select(strings.unescape_html(F.col("id").cast("string"), 2))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan


def test_strip_is_pythons(spark):
    texts = ["\x1c a \x85", " x　", " \t\n\x0b\x0cy\r", "", "\xa0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(strings.strip(F.col("t")).alias("s"), strings.squeeze(F.concat(F.lit("p"), F.col("t"), F.lit("q"))).alias("q")).collect()
    assert [r.s for r in got] == [t.strip() for t in texts]
    assert [r.q for r in got] == [" ".join(("p" + t + "q").split()) for t in texts]


def test_ngrams(spark):
    df = spark.createDataFrame([("ab a",), ("abcdef",), ("",)], "t string")
    got = [r[0] for r in df.select(st.char_ngrams(F.col("t"))).collect()]
    assert got[0] == [" ab", "ab ", " ab ", " a "] and got[2] == []
    padded = " abcdef "
    assert got[1] == [padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)]
    words = spark.createDataFrame([(["quick", "brown", "fox"],), (["x"],)], "t array<string>")
    assert [r[0] for r in words.select(st.with_bigrams(F.col("t"))).collect()] == [["quick", "brown", "fox", "quick brown", "brown fox"], ["x"]]


def test_stoplist():
    assert len(STOPWORDS) == 133 and not set(STOPWORDS) & set(st.NEGATIONS)


MARKERS = [("&amp;", "a&amp;b"), ("<br", "x<br>"), ("<div", "<div>x"), ("Ã©", "TrailÃ©")]


@pytest.mark.parametrize("marker,sample", MARKERS)
def test_residual_sweep_fires_on_a_bad_sample(spark, marker, sample):
    df = spark.createDataFrame([(sample, 1, "2024-01-01")], "text_content string, likes int, timestamp string")
    assert intake.residual_sweep(df).agg(F.sum("rows")).first()[0] >= 1


def test_url_key(spark):
    df = spark.createDataFrame([("https://x.co/a?b=é",)], "u string")
    assert df.select(strings.url_key(F.col("u"))).first()[0] == "37e281dc3621503e"


def test_held_out_bodies_come_back_from_their_file(spark, tmp_path):
    """Quotes, line ends and white space survive the deliverables' CSV."""
    from types import SimpleNamespace

    from chirrup.sources import files

    rows = [("1", 'say "yes",\nor no'), ("2", " \tpadded "), ("3", ""), ("4", "back\\slash \\" )]
    held = spark.createDataFrame(rows, "post_id string, text_content string")
    posts = held.withColumn("post_month", F.lit("2024-01"))
    files.write_intake(SimpleNamespace(analysis=posts, held_out=held, log=held), held, str(tmp_path))
    back = files.read_strings(spark, f"{tmp_path}/held_out", ("post_id", "text_content"))
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_other_characters_are_looked_up_not_compared_by_range(spark):
    odd = "".join(map(chr, [*range(1, 0x250), 0x1F600, 0x10FFFF, 0x2028, 0x4E2D, 0xFF41])) + "a  b\t\nc--d<e>"
    assert "-" not in st.OTHERS  # a range costs a call for every character of every text
    df = spark.createDataFrame([(odd,), ("",), ("   ",), ("a b",)], "t string")
    rows = df.select(F.regexp_replace("t", st.OTHERS, " "), F.regexp_replace("t", "[^a-z0-9<>]+", " ")).collect()
    assert all(got == wanted for got, wanted in rows)
