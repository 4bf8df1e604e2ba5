import re

from chirrup.llm import secret_ledger as sl
from helpers_llm import documents

PATTERNS = {
    "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def brute(text):
    spans = []
    for place, (kind, (pattern, part, least)) in enumerate(PATTERNS.items()):
        spans += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "", re.A) if len(m[part]) >= least]
    return ",".join(s[2] for s in sorted(spans))


TEXTS = [
    None,
    "",
    "nothing here",
    "password = hunter22 and token: 'abc'",
    "secret=token: abcdef",
    "SECRET=token=abcdef; Api_Key:\"A+/=_.-x\"",
    "é𝔘 passwd=ünot token= abcdefgh𝔘 " + "a1" * 12,
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 16,
    "f" * 23 + "g" + "0" * 24 + " " + "ab" * 40,
    "apikey:xxxxxx" * 3,
    "x " * 200_000 + "token=abcdef1",
]


def spans_of(df):
    return df.select("doc_id", sl.in_order(sl.F.col("found"), tuple(PATTERNS)).alias("s"))


def test_spans_match_a_plain_search(spark):
    rows = list(enumerate(TEXTS)) + [(100, TEXTS[3]), (3, TEXTS[3]), (None, TEXTS[4])]
    docs = documents(spark, rows)
    ledger = sl.Ledger(spark)
    sl.scan(docs, "doc_id", "text", ledger)
    got = sorted(map(repr, (tuple(r) for r in spans_of(sl.findings(docs, "doc_id", "text", ledger)).collect())))
    assert got == sorted(map(repr, ((i, brute(t)) for i, t in rows)))


def test_only_unseen_blobs_and_rules_are_read(spark):
    ledger = sl.Ledger(spark)
    first = documents(spark, [(1, TEXTS[3]), (2, TEXTS[3]), (3, "plain")])
    assert sl.scan(first, "doc_id", "text", ledger, sl.BASE) == 2
    assert sl.scan(first, "doc_id", "text", ledger, sl.BASE) == 0
    second = documents(spark, [(1, TEXTS[3]), (4, "new token=abcdef"), (9, "plain")])
    assert sl.scan(second, "doc_id", "text", ledger, sl.BASE) == 1
    newer = (*sl.BASE[:2], sl.Rule("hex", 2, "[0-9a-f]{4,}"))
    assert sl.scan(second, "doc_id", "text", ledger, newer) == 3  # one rule of each blob
    found = {r["doc_id"]: r["s"] for r in spans_of(sl.findings(second, "doc_id", "text", ledger, newer)).collect()}
    assert found == {1: "assign:0:19", 4: "assign:4:16,hex:10:16", 9: ""}


def test_empty_history(spark):
    ledger = sl.Ledger(spark)
    docs = documents(spark, [])
    assert sl.scan(docs, "doc_id", "text", ledger) == 0 and sl.findings(docs, "doc_id", "text", ledger).collect() == []


def test_private_keys_are_added(spark):
    docs = documents(spark, [(1, "a -----BEGIN RSA PRIVATE KEY----- b")])
    ledger = sl.Ledger(spark)
    sl.scan(docs, "doc_id", "text", ledger)
    row = sl.findings(docs, "doc_id", "text", ledger).select(sl.in_order(sl.F.col("found"), ("private_key",)).alias("s")).first()
    assert row["s"] == "private_key:2:33"


def test_a_ledger_is_opened_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", "token = abcdef123"), ("b", "nothing")], "path string, text string")
    path = f"file://{tmp_path}/ledger"
    assert sl.scan(rows, "path", "text", sl.Ledger(spark, path)) == 2
    again = sl.Ledger(spark, path)
    assert sl.scan(rows, "path", "text", again) == 0
    assert sl.scan(rows.union(spark.createDataFrame([("c", "new")], rows.schema)), "path", "text", again) == 1
    assert {r["path"]: len(r["found"]) for r in sl.findings(rows, "path", "text", sl.Ledger(spark, path)).collect()} == {"a": 1, "b": 0}


def test_a_blob_is_read_once_however_often_its_row_repeats(spark):
    rows = spark.createDataFrame([(None, "secret: abcdefg")] * 1000 + [(1, "secret: abcdefg")] * 3, "path long, text string")
    ledger = sl.Ledger(spark)
    assert sl.scan(rows, "path", "text", ledger) == 1 and ledger.table().count() == 1
    assert sl.findings(rows, "path", "text", ledger).count() == 1003
