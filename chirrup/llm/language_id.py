"""Language identification by compression.

Per language a zstandard raw-content dictionary is cut from labelled text. A text is encoded in
pieces with each dictionary and belongs to the language whose dictionary makes it smallest; if the
second best comes within ``NARROW`` of that size the answer is rejected as too close to call.
Of a text all words are encoded, in lower case, without other signs and without immediate
repetitions. The pieces are encoded apart, so that a long text cannot become its own dictionary,
which would level the sizes.

Dictionaries are learned from a bounded sample: of each language, pieces of ``PIECE`` characters
are drawn by hash until ``SAMPLE`` characters are expected. The driver gathers that sample only.
Lines that come twice in it (licences, slogans) say nothing about a language and are left out, unless
a language has no others.

Nulls and other cases: texts that are null or have no letter get ``und``, score 0 and are rejected;
rows without a language, a text or in the held-out fold teach nothing; with no language learned
every text is ``und``, with one the score is 1; equal sizes go to the language with more text and
are rejected; repeated rows are answered alike; empty tables give empty results;
other columns are ignored by ``predictions`` and carried along by ``accepted``, whatever their names.
"""

from __future__ import annotations

import math
import regex
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chirrup.llm.common import held_out

PIECE = 2000
SAMPLE = 400_000  # characters a language, gathered to fill its dictionary
DICTIONARY = 60_000  # bytes a language
ENCODING = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 2, "min_match": 3, "target_length": 16, "strategy": 4}
NARROW = 0.002
SHARPNESS = 60.0
UNKNOWN = "und"
WORD = regex.compile(r"\p{L}+")


def learn(docs: DataFrame, *, sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionary per language from the text and language of rows outside the held-out fold."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    volume = known.groupBy("lang").agg(F.sum(F.length("text")).alias("n"))
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in volume.collect()}  # one row per language
    if not share:
        return {}
    shares = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    number = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))
    draw = lambda i: F.pmod(F.xxhash64("doc_id", i), F.lit(1 << 20)) < F.element_at(shares, F.col("lang")) * (1 << 20)
    pieces = known.select(
        "lang", "doc_id", F.explode(F.transform(F.filter(number, draw), lambda i: F.struct(i.alias("i"), F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE)).alias("t")))).alias("p")
    )
    texts: dict[str, list[str]] = {lang: [] for lang in sorted(share, key=lambda x: (share[x], x))}
    for r in sorted(pieces.collect(), key=lambda r: (r["lang"], hash_of(r["doc_id"], r["p"]["i"]), r["p"]["t"])):
        texts[r["lang"]] += [words(line) for line in r["p"]["t"].split("\n")]
    often = Counter(line for lines in texts.values() for line in lines)
    return {lang: " ".join([x for x in lines if often[x] == 1] or dict.fromkeys(lines)).encode()[-size:] for lang, lines in texts.items()}


def words(text: str) -> str:
    """The words of a text in lower case, without immediate repetitions."""
    found = WORD.findall(text.lower())
    return " ".join([w for w, before in zip(found, [None, *found]) if w != before])


def hash_of(doc_id: int | None, i: int) -> int:
    """An order that mixes the sampled pieces, alike on every run."""
    return ((doc_id or 0) * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F) >> 7 & 0xFFFFFFFF


class Encoders:
    """One compressor per language, built once in a task; languages with more text come first."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as zs

        self.languages = list(dictionaries)
        how = zs.ZstdCompressionParameters(**ENCODING, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressors = []
        for lang in self.languages:
            d = zs.ZstdCompressionDict(dictionaries[lang], dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.compressors.append(zs.ZstdCompressor(compression_params=how, dict_data=d))

    def answer(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the margin is the gap to the second best, as a share of its size."""
        low = words(text) if text and self.languages else ""
        if not low:
            return UNKNOWN, 0.0, 0.0
        sizes = [0] * len(self.languages)
        for a in range(0, len(low), PIECE):
            piece = low[a : a + PIECE].encode("utf-8", "surrogatepass")
            for k, c in enumerate(self.compressors):
                sizes[k] += len(c.compress(piece)) - 9  # what an empty frame takes
        best = min(sizes)
        at = sizes.index(best)
        if len(sizes) == 1:
            return self.languages[0], 1.0, 1.0
        second = min(s for k, s in enumerate(sizes) if k != at)
        score = 1.0 / sum(math.exp(SHARPNESS * (best - s) / max(best, 1)) for s in sizes)
        return self.languages[at], score, (second - best) / max(second, 1)


def predictions(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, margin, rejected."""

    def answer(batches):
        encoders = Encoders(dictionaries)
        for b in batches:
            found = [encoders.answer(t) for t in b.column("text").to_pylist()]
            lang, score, margin = zip(*found) if found else ((), (), ())
            rejected = [x == UNKNOWN or m < NARROW for x, m in zip(lang, margin)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"],
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(answer, "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""

    def keep(batches):
        encoders = Encoders(dictionaries)
        for b in batches:
            found = [encoders.answer(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield b.filter(pa.array([x != UNKNOWN and m >= NARROW for x, _, m in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
