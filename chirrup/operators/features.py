"""Text features as relations: term counts, vocabulary, TF-IDF weights, sparse vectors.

The vocabulary is a DataFrame, so it may exceed any driver; it meets the documents in chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from chirrup.constants import MIN_DF, TOPIC_MAX_DF, TOPIC_MIN_DF
from chirrup.operators import chunks
from chirrup.operators.ranking import global_row_number


@dataclass(frozen=True)
class Counts:
    """How often each document holds each term; counted chunk by chunk (``chunks``) where it is asked for.

    ``rows`` are dealt (key, ``_words``, ``_chunk``); rows of one key are one document.
    """

    rows: DataFrame
    key: str
    pairs: bool = False
    parts: chunks.Parts | None = None

    def _bag(self):
        key, pairs, parts = self.key, self.pairs, self.parts

        def bag(part: pa.Table):
            """Cells of a chunk by the place of their key in ``keys``, its terms, and ``keys``."""
            keys = chunks.column(part, key).dictionary_encode(null_encoding="encode")
            cells = chunks.bag(chunks.column(part, "_words"), pairs=pairs, parts=parts, rows=keys.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            return *cells, keys.dictionary

        return bag

    @property
    def _kind(self) -> str:
        return f"`{self.key}` {dict(self.rows.dtypes)[self.key]}"

    def documents(self) -> Column:
        """The number of keys that hold a term."""
        return self.rows.where(F.size("_words") > 0).agg(F.count_distinct(self.key).alias("n")).scalar()

    def cells(self) -> DataFrame:
        """(key, term, tf)."""
        bag, key = self._bag(), self.key

        def work(part: pa.Table) -> pa.Table:
            row, code, tf, terms, keys = bag(part)
            return chunks.batched({key: keys.take(pa.array(row)), "term": terms.take(pa.array(code)), "tf": tf})

        return self.rows.groupBy("_chunk").applyInArrow(work, f"{self._kind}, term string, tf long")

    def named(self) -> DataFrame:
        """Every chunk's terms: (_chunk, term, df, total)."""
        bag = self._bag()

        def work(part: pa.Table) -> pa.Table:
            _, code, tf, terms, _ = bag(part)
            total = np.zeros(len(terms), np.int64)
            np.add.at(total, code, tf)
            here = pa.array(np.full(len(terms), part.column("_chunk")[0].as_py()))
            return chunks.batched({"_chunk": here, "term": terms, "df": np.bincount(code, minlength=len(terms)), "total": total})

        return self.rows.groupBy("_chunk").applyInArrow(work, "_chunk long, term string, df long, total long")

    def weighed(self, facts: DataFrame) -> DataFrame:
        """(key, term, weight) with the ``idf`` of (_chunk, term, idf); terms it lacks and rows without a key are left out."""
        bag, key = self._bag(), self.key

        def work(part: pa.Table, mine: pa.Table) -> pa.Table:
            row, code, tf, terms, keys = bag(part)
            idf = chunks.known(terms, mine, ["idf"])[code, 0]
            kept = idf > 0
            row, code, weight = row[kept], code[kept], chunks.weights(row[kept], tf[kept], idf[kept], len(keys))
            return chunks.batched({key: keys.take(pa.array(row)), "term": terms.take(pa.array(code)), "weight": weight})

        rows = self.rows.where(F.col(self.key).isNotNull())
        return chunks.met(rows, facts, work, f"{self._kind}, term string, weight double").where(F.col(self.key).isNotNull())


def term_counts(df: DataFrame, key: str, terms: Column, *, pairs: bool = False, parts: chunks.Parts | None = None) -> Counts:
    """Counts of the terms in arrays: the words, with ``pairs`` neighbours too, with ``parts`` the parts of words instead."""
    return Counts(chunks.dealt(df.select(key, F.coalesce(terms, F.array().cast("array<string>")).alias("_words")), key, "_words"), key, pairs, parts)


def document_frequencies(counts: Counts, min_df: int = MIN_DF) -> DataFrame:
    return counts.named().groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") >= min_df)


def tfidf(counts: Counts, key: str, *, min_df: int = MIN_DF, fitted: DataFrame | None = None, n_docs=None) -> DataFrame:
    """Weights (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document scaled to length one.

    ``fitted`` and ``n_docs`` carry the document frequencies of a training set; left out,
    they are those of ``counts``. Terms outside the vocabulary are dropped.
    """
    n = n_docs if n_docs is not None else counts.documents()
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    named = counts.named()
    if fitted is None:
        facts = chunks.totals(named, ["df"]).where(F.col("df") >= min_df)
    else:
        facts = named.select("_chunk", "term").join(fitted.select("term", "df"), "term")
    return counts.weighed(facts.withColumn("n", n).select("_chunk", "term", idf.alias("idf")))


def indexed(terms: DataFrame, order: list | None = None) -> DataFrame:
    """Vocabulary with a dense index ``idx`` from 0, in term order unless told otherwise."""
    numbered = global_row_number(terms, order or ["term"], "idx")
    return numbered.withColumn("idx", (F.col("idx") - 1).cast("int"))


def topic_vocabulary(
    counts: Counts, key: str, *, min_df: int = TOPIC_MIN_DF, max_df: float = TOPIC_MAX_DF
) -> DataFrame:
    """Terms neither rare nor everywhere, with an index by falling frequency."""
    n = counts.documents()
    kept = (
        counts.named()
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        .withColumn("n", n)
        .where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
        .drop("n")
    )
    return indexed(kept, [F.desc("total"), "term"])


@F.udf(VectorUDT(), useArrow=True)
def _sparse(size, indices, values):
    return Vectors.sparse(size, indices, values)


def sparse_vectors(cells: DataFrame, key: str, size: int, weight: str = "weight", name: str = "features") -> DataFrame:
    """One sparse vector per document from (key, idx, weight) cells, collected per document."""
    packed = cells.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("idx", F.col(weight).cast("double").alias("w")))).alias("c")
    )
    return packed.select(
        key,
        _sparse(F.lit(size), F.transform("c", lambda x: x["idx"]), F.transform("c", lambda x: x["w"])).alias(name),
    )


def stacked(word: DataFrame, char: DataFrame, word_size: int) -> DataFrame:
    """Word and character cells in one space, the characters behind the words."""
    return word.unionByName(char.withColumn("idx", F.col("idx") + F.lit(word_size)))

