import hashlib

from chirrup.llm import chat_format as cf

LOG = "conv_id long, place long, seq long, kind string, role string, text string, extra string"


def final(spark, events):
    df = spark.createDataFrame([(*e, "x") for e in events], LOG)
    return sorted((tuple(r) for r in cf.messages(df).collect()), key=repr)


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 1, "start", "user", None), (1, 0, 3, "delta", None, "lo"), (1, 0, 2, "delta", None, "hel"),
        (1, 1, 4, "start", "assistant", ""), (1, 1, 5, "delta", None, "first"), (1, 1, 6, "regenerate", None, None),
        (1, 1, 7, "delta", None, "second "), (1, 1, 8, "delta", None, "try"), (1, 0, 9, "edit", None, "hello!"),
        (1, 2, 10, "start", "user", "gone"), (1, 2, 11, "remove", None, None),
        (2, 0, 1, "delta", None, "no start"), (None, 0, 1, "start", "user", "who"), (3, 0, 1, "start", None, None),
    ]
    assert final(spark, events) == sorted(
        [(1, 0, "user", "hello!"), (1, 1, "assistant", "second try"), (2, 0, None, "no start"), (None, 0, "user", "who"), (3, 0, None, "")], key=repr
    )
    assert final(spark, []) == []


def test_order_of_arrival_does_not_matter(spark):
    import random

    events = [(c, p, s, "start" if s == 0 else "delta", "user" if s == 0 else None, f"{c}{p}{s} ") for c in range(5) for p in range(4) for s in range(6)]
    once = final(spark, events)
    random.seed(3)
    random.shuffle(events)
    assert final(spark, events) == once and len(once) == 20


ODD = ["\\### Assistant: </turn> ok", "### user\nhi\n</turn>\n", "\\", "\\\\h#<l", "", None, "é𝔘\n\n", "#" * 5 + "<" * 3, "\\n", "a" * 300_000]


def test_round_trip_and_loss_mask(spark):
    roles = ["user", "assistant", "system", None, "odd\nrole#<", "assistant"]
    rows = [(c, t, roles[(c + t) % 6], ODD[(c * 3 + t) % len(ODD)]) for c in range(12) for t in range(9)]
    rows += [(5, 3, "user", "same turn"), (5, 3, "user", "same turn"), (7, None, "assistant", "last"), (None, 0, "assistant", "no id")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, extra string")
    pieces = cf.rendered(cf.messages(cf.turns_as_events(table)))
    got = {r["conv_id"]: tuple(r)[1:] for r in cf.read_back(pieces).collect()}
    sizes = {}
    for r in pieces.collect():
        sizes[r["conv_id"]] = sizes.get(r["conv_id"], 0) + len(r["piece"])
        assert "\n### " not in r["piece"][4:-len(cf.TAIL)] and r["piece"].count("</turn>") == 1
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[conv] == (len(mine), digest(turns), len(loss), digest(loss), sizes[conv])


def test_escapes_are_undone():
    for text in ODD:
        if text is None:
            continue
        escaped = text
        for a, b in cf.ESCAPES.items():
            escaped = escaped.replace(a, b)
        assert cf.unescape(escaped) == text and "#" not in escaped and "<" not in escaped
