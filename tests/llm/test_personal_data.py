import hashlib
import re

import numpy as np
import pytest

from chirrup.llm import personal_data as pd_
from helpers_llm import documents, real


@pytest.fixture(scope="module")
def field():
    return pd_.Field.trained(pd_.LABELLED)


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    """The patterns as the contract words them, by a plain search."""
    out, text = [], text or ""
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


TEXTS = [
    None, "", "plain", "a@b.c", "@b.c", "x@y", "a@b.c@d.e", "a@b@c.de", "a.b@c..d", "é@b.co ü.x@y-z.w.", "a@b.c.d.", "..@a.b",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.3.4", "1.2.3", "999999.1.2.3.4", "0000000.0.0.0",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "41111111111111114111111111111111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (509) 555-6973", "+15095556973", "++1 509 555 6973", "+1 2", "+1 (826) 555-4081 190.137.223.204", "+1234567890123456",
    "٣٤٥@x.y +١٢٣٤٥٦٧٨٩٠ ١.٢.٣.٤",
]


def test_patterns_against_a_plain_search():
    for text in TEXTS:
        assert pd_.base_spans(text or "") == brute(text), text
    for row in real("documents"):
        assert pd_.base_spans(row[1]) == brute(row[1])


def test_hostile_texts_stay_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "@" * 100_000, "a@" * 100_000, "+1" + "(" * 200_000, "1 " * 100_000):
        pd_.base_spans(text)
        list(pd_.stretches(text))


def test_viterbi_is_the_best_path_and_marginals_sum(field):
    rng = np.random.default_rng(0)
    small = pd_.Field(rng.normal(size=field.weights.shape), rng.normal(size=field.moves.shape))
    n = len(pd_.LABELS)
    words = ["a@b.c", "1.2.3.4", "the"]
    x = pd_.features(words)
    s = small.scores(x)
    paths = {(a, b, c): s[0, a] + s[1, b] + s[2, c] + small.moves[a, b] + small.moves[b, c] for a in range(n) for b in range(n) for c in range(n)}
    best = max(paths, key=paths.get)
    assert tuple(small.decode([x, x[:1], x])[0]) == best
    p, pairs = small.marginals(x)
    z = sum(np.exp(v) for v in paths.values())
    assert np.allclose(p[1], [sum(np.exp(v) for k, v in paths.items() if k[1] == j) / z for j in range(n)])
    assert np.allclose(p.sum(1), 1) and np.isclose(pairs.sum(), 2)


def test_field_learns_its_table_and_adds_to_the_patterns(field):
    for row in pd_.LABELLED:
        words, labels = pd_.parse_labelled(row)
        assert field.decode([pd_.features(words)])[0].tolist() == labels
    (own, every), = pd_.find(["old line (509) 555-6973 still works, holder 219-09-9999 signed"], field)
    assert own == [] and [pd_.LABELS[p + 1] for _, p, _ in every] == ["phone", "id"]
    (own, every), = pd_.find(["the +1 (826) 555-4081 190.137.223.204 of"], field)
    assert set(own) <= set(every) and len(every) > len(own)


def test_clean_texts_get_nothing(field):
    texts = [r[1] for r in real("documents")]
    for text, (own, every) in zip(texts, pd_.find(texts, field)):
        assert set(own) <= set(every)
        for a, place, b in every:
            assert (a, place, b) in own or place == 3 and re.search(r"\d{3}", text[a:b])


def test_table_of_documents(spark, field):
    docs = documents(spark, [*enumerate(TEXTS), (3, TEXTS[3]), (None, "a@b.c"), (99, "word " * 100_000 + "a@b.c")])
    got = pd_.spans(docs, field).collect()
    assert len(got) == len(TEXTS) + 3
    want = {i: ",".join(f"{pd_.LABELS[p + 1]}:{a}:{b}" for a, p, b in brute(t)) for i, t in enumerate(TEXTS)}
    for r in got:
        if r["doc_id"] in want:
            assert r["base"] == want[r["doc_id"]] and r["n_email"] == want[r["doc_id"]].count("email:")
            assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
    assert pd_.spans(documents(spark, []), field).collect() == []
    assert hashlib.sha256(b"").hexdigest()


def test_shape_of_the_whole_word():
    long = "x" * 70
    assert pd_.shape(long + "7")[0] == pd_.shape("x7")[0] and pd_.shape(long + "7")[1:3] == pd_.shape("x7")[1:3]
    assert pd_.shape(long + "@x")[0] == pd_.shape("x@x")[0]


def test_parts_hold_each_word_once_with_its_neighbours():
    for n in (1, 64, 511, 512, 513, 575, 576, 577, 960, 961, 5000):
        cuts = pd_.parts_of(n)
        assert [k for _, _, a, b in cuts for k in range(a, b)] == list(range(n))
        assert all(b - a <= pd_.LONGEST and (f == 0 or f - a == pd_.MARGIN) and (t == n or b - t == pd_.MARGIN) for a, b, f, t in cuts)


def test_values_across_the_ends_of_parts(field):
    value = "(509) 555-6973"
    for n in (3, *range(440, 520), *range(890, 966), 1023):
        text = "row 7 " * (n // 2) + "a " * (n % 2) + "phone " + value + " today " + "row 7 " * 40
        (_, spans), = pd_.find([text], field)
        assert value in [text[a:b] for a, _, b in spans], n
