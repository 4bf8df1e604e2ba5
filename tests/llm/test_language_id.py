import zlib

from chirrup.llm import language_id as li
from helpers_llm import documents, real


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_accuracy_on_the_held_out_fold(spark):
    rows = [r[:4] for r in real("documents", "sf0.01")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in li.predictions(docs, li.learn(docs)).collect()}
    assert len(got) == len(rows) and all(got[r[0]]["held_out"] == held(r[0]) for r in rows)
    fold = [r for r in rows if held(r[0])]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in fold) >= 0.97 * len(fold)
    assert all(0 <= g["score"] <= 1 for g in got.values())
    kept = {r["doc_id"] for r in li.accepted(docs, li.learn(docs)).collect()}
    assert len(kept) >= 0.97 * len(rows)


def test_only_text_decides(spark):
    de = "der hund und die katze sitzen in dem haus und das ist nicht mehr als ein anfang"
    en = "the dog and the cat are sitting in that house which is no more than a beginning"
    rows = [(1, de, "de"), (2, en, "en"), (3, en, None), (6, de, "xx")]
    docs = documents(spark, [(i * 100 + k, f"{t} {k}", l) for i, t, l in rows for k in range(8)])
    model = li.learn(docs)
    assert set(model) == {"de", "en", "xx"}
    text = "the cat and the dog are sitting in that house and that is a beginning"
    moved = documents(spark, [(7, text, "de", "a"), (8, text, "en", "b"), (7, text, None)])
    answers = [(r["lang_pred"], r["score"]) for r in li.predictions(moved, model).collect()]
    assert len(set(answers)) == 1 and answers[0][0] == "en"


def test_edges(spark):
    docs = documents(spark, [(1, None, "en"), (2, "", "en"), (3, "12 !! 34", "en"), (None, "words", "en"), (4, "word " * 100_000, "en")])
    model = li.learn(documents(spark, [(i, "some english words here", "en") for i in range(9)]))
    got = sorted((repr(r["doc_id"]), r["lang_pred"], r["rejected"]) for r in li.predictions(docs, model).collect())
    assert got == [("1", "und", True), ("2", "und", True), ("3", "und", True), ("4", "en", False), ("None", "en", False)]
    left = li.accepted(docs, model)
    assert left.columns == docs.columns and left.count() == 2
    assert {r["lang_pred"] for r in li.predictions(docs, {}).collect()} == {"und"}
    none = documents(spark, [])
    assert li.learn(none) == {} and li.predictions(none, model).collect() == []


def test_narrow_margins_are_rejected():
    same = {"a": b"some words here and there", "b": b"some words here and there"}
    lang, score, margin = li.Encoders(same).answer("some words")
    assert lang == "a" and margin == 0 and abs(score - 0.5) < 1e-9


def test_numerals_are_no_letters(spark):
    docs = documents(spark, [(1, "a b c", "en"), (2, "½ ²"), (3, "ⅷ ৪ 12"), (4, "a")])
    got = {r["doc_id"]: r["lang_pred"] for r in li.predictions(docs, {"en": b"a b c"}).collect()}
    assert got[2] == got[3] == "und" and got[4] != ""
