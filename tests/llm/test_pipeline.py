"""The pipeline's stages on the smallest documents, each against a plain computation on its own input."""

import collections
import hashlib
import re

import corpus_pipeline
from chirrup.llm import language_id
from chirrup.llm.common import table
from helpers_llm import real
from test_decontaminate import full_overlaps
from test_jaccard_join import brute as components
from test_mixing import brute_targets, size

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, SMALL), "stage")
        kept[name] = (rows_of(before), rows_of(docs))
        if name != "mixing":
            assert docs.columns == columns and docs.schema == before.schema

    rows, left = kept["language"]
    encoders = language_id.Encoders(language_id.learn(table(spark, SMALL, "documents")))
    answers = {i: encoders.answer(t) for i, t in rows}
    assert left == [(i, t) for i, t in rows if answers[i][0] != "und" and answers[i][2] >= language_id.NARROW]
    assert len(left) >= 0.97 * len(rows)

    rows, left = kept["exact dedup"]
    first = {}
    for i, t in rows:  # by id
        first.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).digest(), (i, t))
    assert left == sorted(first.values()) and len(left) < len(rows)

    rows, left = kept["near dedup"]
    names = {i for i, _, c in components(rows) if c == i}
    assert left == [r for r in rows if r[0] in names] and len(left) < len(rows)

    rows, left = kept["decontamination"]
    gone = {r[0] for r in rows} - {r[0] for r in left}
    leaks = {i for i, _ in full_overlaps(rows, real("benchmark"))}
    assert leaks <= gone and len(gone) <= len(leaks) + 2

    mixed = docs.collect()
    sources = collections.Counter()
    for r in before.collect():
        sources[r["source"]] += size(r["text"])
    want, taken, largest = brute_targets(sources), collections.Counter(), collections.Counter()
    for r in mixed:
        assert r["_mix_source_size"] == sources[r["source"]] and r["_mix_size"] == size(r["text"]) and 1 <= r["_mix_copy"] <= 2
        taken[r["source"]] += r["_mix_size"]
        largest[r["source"]] = max(largest[r["source"]], r["_mix_size"])
    for s in sources:
        biggest = max(size(r["text"]) for r in before.where(before.source == s).collect())
        assert abs(taken[s] - want[s]) <= biggest / 2 + 1e-6


def test_run_is_all_stages(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert set(table(spark, SMALL, "documents").columns) <= set(out.columns) and out.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact dedup", "near dedup", "decontamination", "mixing"]
