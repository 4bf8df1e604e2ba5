"""Aligned tokens against whole texts encoded at once and counted in plain Python."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from chirrup.llm import common, token_alignment as ta
from helpers_llm import documents, real

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "aé中\U0001f600 <0x41> </s>  two  \n\t z\x00q ﬁ ",
    " leading", "trailing ", "   ", "\n", " ", "<|endoftext|> and <s> </s> <unk>", "don't won't  they'll", "▁", "x ▁ y", " a  b c\u0085 d\x1c e",
    "\U0001f468‍\U0001f469‍\U0001f467 family", "é combining ́", "1234567890" * 30, "nospaces" * 300, "नमस्ते 你好世界你好",
]


@pytest.fixture(scope="module")
def files():
    return ta.Vocabularies.read()


def brute(texts, files):
    """Every text at once, places from decoded bytes alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(files.byte_level.decode())
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_proto=files.pieces)
    of, links, rows = ta.byte_characters(), Counter(), []
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs = [bytes(of[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            rows.append((0, 0, [], ""))
            continue
        ends = lambda t: {sum(map(len, t[: k + 1])): k for k in range(len(t))}
        p, q = ends(xs), ends(ys)
        cuts = sorted(p.keys() & q.keys())
        mine = [(x[p[c]], y[q[c]]) for c in cuts]
        links.update(mine)
        groups, i, j = [], 0, 0
        for c in cuts:
            groups.append(",".join(map(str, x[i : p[c] + 1])) + "|" + ",".join(map(str, y[j : q[c] + 1])))
            i, j = p[c] + 1, q[c] + 1
        rows.append((len(x), len(y), mine, ";".join(groups)))
    best = {}
    for (_, v), n in links.items():
        best[v] = max(best.get(v, 0), n)
    return [
        (n_a, n_b, len(mine), len(mine), sum(links[m] == best[m[1]] for m in mine), sum(links[m] for m in mine), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for n_a, n_b, mine, g in rows
    ]


def check(spark, files, texts):
    got = ta.alignment(documents(spark, list(enumerate(texts))), files)
    assert got.columns == COLUMNS
    assert [tuple(r)[1:] for r in got.orderBy("doc_id").collect()] == brute(texts, files)


def test_odd_texts(spark, files):
    check(spark, files, ODD)


def test_given_documents(spark, files):
    check(spark, files, [r[1] for r in real("documents") if r[1]][:120])


def test_rare_pairs_are_joined_by_a_shuffle(spark, files, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 20 * ta.PAIR_BYTES)
    check(spark, files, [*ODD, "the the the cat and the dog", "the cat the dog"])


def test_nulls_repeats_and_bytes_that_are_no_text(spark, files):
    docs = documents(spark, [(1, None), (2, ""), (None, "one two"), (None, "one two"), (3, "one two"), (3, "one two")])
    rows = [tuple(r) for r in ta.alignment(docs, files).collect()]
    assert sorted((r[0] is None, r[0] or 0) for r in rows) == [(False, 1), (False, 2), (False, 3), (False, 3), (True, 0), (True, 0)]
    assert {r[1:] for r in rows if r[0] in (1, 2)} == {(0, 0, 0, 0, 0, 0, "")}
    assert len({r[1:] for r in rows if r[0] not in (1, 2)}) == 1 and all(r[6] == 4 * r[4] for r in rows if r[0] == 3)
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert [tuple(r)[1:] for r in ta.alignment(broken, files).collect()] == [(0, 0, 0, 0, 0, 0, "")]
    assert ta.alignment(docs.limit(0), files).collect() == []


def test_spans_that_do_not_fit_are_settled_by_bytes():
    def ends(spans, tokens, data):
        got = ta._ends(np.array(spans), tokens, data)
        return None if got is None else got.tolist()

    assert ends([(0, 2), (2, 3)], [b"ab", b"c"], b"abc") == [2, 3]
    assert ends([(0, 3), (0, 3), (3, 4)], [b"\xe4\xb8", b"\xad", b"x"], b"\xe4\xb8\xadx") == [2, 3, 4]
    assert ends([(1, 2)], [b" a"], b" a") == [2]
    assert ends([(0, 1)], [b"b"], b"a") is None and ends([(0, 1)], [b"a"], b"ab") is None


def test_parts_are_forgotten_and_learned_again(spark, files, monkeypatch):
    aligner = ta.Aligner(files)
    texts = [["a", "bc"], [], ["a", "x▁y"], ["bc", "bc", "d"]]
    first = [c.to_pylist() for c in ta._of_texts(aligner, texts)]
    monkeypatch.setattr(ta, "KEPT_PARTS", 0)
    assert [c.to_pylist() for c in ta._of_texts(aligner, texts)] == first and first[0] == [2, 0, 0, 3]
    monkeypatch.setattr(ta, "JOINED", 1)
    assert [c.to_pylist() for c in ta._of_texts(aligner, texts)] == first


def test_a_repeated_part_is_encoded_once(files, monkeypatch):
    monkeypatch.setattr(ta, "KEPT_PARTS", 20)
    aligner, asked = ta.Aligner(files), []
    add = ta.Aligner._add
    monkeypatch.setattr(ta.Aligner, "_add", lambda self, parts, *rest: (asked.extend(parts), add(self, parts, *rest))[1])
    for k in range(5):
        text = "often again often again " + " ".join(f"only{k}{i}" for i in range(30))
        found, fresh = ([c.to_pylist() for c in ta._of_texts(a, [a.split(text)])] for a in (aligner, ta.Aligner(files)))
        assert found == fresh
    assert asked.count("often") == asked.count("again") == 1 + 5  # five of the fresh ones
