"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from itertools import count, islice

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that parts words, and words, in all contracts of this subpackage.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast up to this many bytes; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no model learns from; a null id belongs to the learning fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def new_names(df: DataFrame, n: int) -> list[str]:
    """Names for ``n`` working columns that ``df`` doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    return list(islice((name for k in count() if (name := f"_own{k}") not in taken), n))


def complete_parts(spark: SparkSession, path: str, name: str) -> tuple[list[str], int]:
    """Folders ``<name>=<n>…`` below ``path`` whose write was finished, by n, and the next free n."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(where)] if files.exists(where) else []
    numbered = sorted(((int(m.group(1)), p) for p in found if (m := re.fullmatch(rf"{name}=([0-9]+).*", p.getName()))), key=lambda x: x[0])
    done = [p.toString() for _, p in numbered if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return done, numbered[-1][0] + 1 if numbered else 0


def fits(written: DataFrame, bytes_per_row: int) -> bool:
    """The counted rows of ``written`` may be broadcast."""
    return written.count() * bytes_per_row <= BROADCAST_BYTES


def sized_side(written: DataFrame, bytes_per_row: int) -> DataFrame:
    """``written`` (rows already materialised) with a broadcast hint if its counted size allows one.

    A larger side gets no hint: the join then shuffles both sides, with AQE splitting hot keys.
    """
    return F.broadcast(written) if fits(written, bytes_per_row) else written
