import hashlib
import random

import numpy as np

from chirrup.llm import repeated_spans as rs
from helpers_llm import documents, real


def brute(rows):
    """Windows by a dictionary, in order of id and text digest as ties are ordered; copies of rows last."""
    seen, out = set(), []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - rs.LENGTH + 1):
            w = raw[i : i + rs.LENGTH]
            if w in seen:
                gone[i : i + rs.LENGTH] = True
            seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in rs.removed(df).collect()), key=repr)


def test_transform_against_a_dictionary():
    random.seed(5)
    for letters in (b"ab", b"abcdef "):
        base = [bytes(random.choice(letters) for _ in range(260)) for _ in range(3)]
        segments = []
        for _ in range(40):
            b, a = random.choice(base), random.randrange(0, 90)
            s = bytearray(b[a : a + random.randrange(rs.LENGTH, 170)])
            if random.random() < 0.5:
                s[random.randrange(len(s))] = 65
            segments.append(bytes(s))
        segments += [b"a" * 150, b"ab" * 70]
        windows = np.array([len(s) - rs.LENGTH + 1 for s in segments])
        got = set(zip(*[x.tolist() for x in rs.repeats(segments, np.arange(len(segments)), np.zeros(len(segments), np.int64), windows)]))
        seen, want = set(), set()
        for i, s in enumerate(segments):
            for w in range(windows[i]):
                if s[w : w + rs.LENGTH] in seen:
                    want.add((i, w))
                seen.add(s[w : w + rs.LENGTH])
        assert got == want


def test_given_documents_against_brute_force(spark):
    rows = sorted((r[0], r[1]) for r in real("documents"))
    assert result(documents(spark, rows)) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 99), (5, "x" * 100), (6, "x" * 350), (7, "ab" * 120), (8, long), (9, long[1000:1300] + "é" * 60), (10, "é" * 200), (11, long)]
    assert result(documents(spark, rows)) == brute(rows)


def test_a_key_larger_than_a_block_is_settled_by_hashes(spark, monkeypatch):
    monkeypatch.setattr(rs, "WHOLE_KEY", 300)
    monkeypatch.setattr(rs, "BLOCK", 400)
    random.seed(2)
    passage = "the passage that all of these texts share, long enough to hold several hundred bytes " * 2 + "end of it"
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(9))
    rows = [(i, f"{word()} {word()} {word()} {passage} {word()} {word()} {word()}") for i in range(30)]
    held = list(rs._expand(_batches(rows)))
    assert any(b.column("high").null_count < b.num_rows for b in held)
    want = brute(rows)
    assert result(documents(spark, rows)) == want


def _batches(rows):
    import pyarrow as pa

    import zstandard

    z = zstandard.ZstdCompressor()
    ids = pa.array([r[0] for r in rows], pa.int64())
    described = list(rs._describe([pa.RecordBatch.from_arrays([ids, pa.array([z.compress(r[1].encode()) for r in rows], pa.binary())], ["id", "text"])]))
    table = pa.Table.from_batches(described).sort_by([("key", "ascending"), ("content", "ascending"), ("id", "ascending"), ("at", "ascending")])
    settled = pa.Table.from_batches(list(rs._settle(table.to_batches()))).to_pylist()
    asked = {}
    for r in settled:
        if r["open"]:
            asked.setdefault(r["id"], []).append(r["at"])
    texts = dict(rows)
    keys = sorted(asked)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array([asked[k] for k in keys], pa.list_(pa.int64())), pa.array([z.compress(texts[k].encode()) for k in keys], pa.binary())], ["id", "asked", "text"]
    )
    halves = pa.Table.from_batches(list(rs._halves([batch]))).sort_by([("key", "ascending"), ("content", "ascending"), ("id", "ascending"), ("at", "ascending")])
    return halves.to_batches()


def test_keys_in_parts():
    import pyarrow as pa

    key = [1] * 5 + [2] * 4 + [3]
    rows = {"key": key, "content": [1, 1, 1, 2, 2, 5, 5, 5, 5, 9], "id": list(range(10)), "at": [0] * 10}
    table = pa.table(rows)
    whole = pa.Table.from_batches(list(rs._settle(table.to_batches()))).to_pylist()
    assert {(r["id"], r["open"]) for r in whole} == {(0, True), (1, False), (2, False), (3, True), (4, False), (6, False), (7, False), (8, False)}


def test_repeats_of_ids_and_rows(spark):
    text = "some text that is longer than one hundred bytes so that it can be removed when it comes again, and that is it"
    docs = documents(spark, [(1, text), (1, text), (None, text), (None, "short"), (1, "other " + text)])
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in rs.removed(docs).collect()]
    assert sorted(map(repr, got)) != [] and len(got) == 5
    # one of the rows with id 1 keeps the text; the rest lose it
    assert sum(n - k for _, n, k in got) == len(text) + len("short") + len("other ")
    assert result(documents(spark, [])) == []


def test_many_texts_without_an_id(spark):
    """More than 16 bits could tell apart; they come in the order of their digests."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(19))
    texts = [" ".join(word() for _ in range(8)) + (" " + passage if k % 2 else "") + " " + word() for k in range(3000)]
    got = rs.removed(documents(spark, [(None, t) for t in texts])).collect()
    ranked = sorted(texts, key=lambda t: hashlib.sha256(t.encode()).digest())
    first = next(t for t in ranked if passage in t)
    size = len(passage) + 1  # with the space before it
    holders = [t for t in texts if passage in t]
    removed = sorted(r["n_removed"] for r in got)
    assert len(got) == 3000 and removed.count(0) == 3000 - len(holders) + 1
    assert all(n >= size for n in removed if n) and sum(n >= size for n in removed) == len(holders) - 1
    whole = {hashlib.sha256(t.encode()).hexdigest() for t in texts if passage not in t or t == first}
    assert {r["kept_sha256"] for r in got if not r["n_removed"]} == whole
