"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chirrup.session import materialise

EDGE = "a long, b long"


def _star(larger: bool):
    """Of rows (u, v) sorted by both: v tied to the smallest vertex around u.

    ``larger``: of all neighbours those above u. Else u's smaller neighbours and u itself. A task
    holds a batch and, of the vertex at hand, the smallest neighbour.
    """

    def run(batches):
        vertex, least, before = None, None, None  # of the vertex that goes on, and its last neighbour
        for b in batches:
            u, v = b.column("u").to_numpy(), b.column("v").to_numpy()
            if not len(u):
                continue
            new = np.concatenate([[u[0] != vertex], u[1:] != u[:-1]])
            first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            smallest = np.minimum(v[first], u[first])
            if not new[0]:
                smallest[0] = least
            m = np.repeat(smallest, np.diff([*first, len(u)]))
            again = np.concatenate([[not new[0] and v[0] == before], ~new[1:] & (v[1:] == v[:-1])])
            if larger:
                keep = (v > u) & ~again
                a, c = m[keep], v[keep]
            else:  # u itself comes once, with its first neighbour
                keep = ~again
                a, c = np.concatenate([m[keep], m[new]]), np.concatenate([v[keep], u[new]])
            edge = a < c
            yield pa.RecordBatch.from_arrays([pa.array(a[edge]), pa.array(c[edge])], ["a", "b"])
            vertex, least, before = u[-1], m[-1], v[-1]

    return run


def _by_vertex(rows: DataFrame, larger: bool) -> DataFrame:
    return rows.repartition("u").sortWithinPartitions("u", "v").mapInArrow(_star(larger), EDGE)


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (a, b): the component is its smallest vertex.

    A round is two shuffles of the edges and a write to the shared folder; the number of rounds
    grows with the logarithm of the longest path. Loops (a = b) are left out.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"), "edges")
    before = None
    while True:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
        tied = _by_vertex(both.select("e.u", "e.v"), True)
        edges = materialise(_by_vertex(tied.select(F.col("b").alias("u"), F.col("a").alias("v")), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if now == before:
            break
        before = now
    edges = edges.distinct()
    return edges.select(F.col("b").alias("vertex"), F.col("a").alias("component")).unionByName(
        edges.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct()
    )
