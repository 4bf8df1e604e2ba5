import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirrup.operators import ranking


def rows(spark, n, seed=1, hot=0.4):
    """Values of which one holds a large part."""
    rng = random.Random(seed)
    data = [(i, "g" if rng.random() < hot else f"g{i % 5}", 7 if rng.random() < hot else rng.randrange(50)) for i in range(n)]
    return data, spark.createDataFrame(data, "id int, grp string, v int").repartition(6)


@pytest.mark.parametrize("n", [1, 3, 11, 400])
@pytest.mark.parametrize("k", [5, 10])
def test_ntile_and_row_number(spark, con, n, k):
    data, df = rows(spark, n)
    got = {r.id: (r.rn, r.bucket) for r in ranking.global_ntile(ranking.global_row_number(df, ["v", "id"]), k, ["v", "id"]).collect()}
    order = sorted(data, key=lambda r: (r[2], r[0]))
    sql = con.execute(f"SELECT x, ntile({k}) OVER (ORDER BY x) FROM range({n}) t(x)").fetchall()
    for place, (row, (_, bucket)) in enumerate(zip(order, sql)):
        assert got[row[0]] == (place + 1, bucket)


def test_ntile_seven_rows(spark):
    _, df = rows(spark, 7)
    assert sorted(r.bucket for r in ranking.global_ntile(df, 5, ["v", "id"]).collect()) == [1, 1, 2, 2, 3, 4, 5]


@pytest.mark.parametrize("partitions", ["1", "3", "16"])
def test_result_does_not_depend_on_partitioning(spark, partitions):
    data, df = rows(spark, 300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.id: r.rn for r in ranking.global_row_number(df, [F.desc("v"), "id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: (-r[2], r[0])))}


def test_number_within_hot_group(spark):
    data, df = rows(spark, 500, hot=0.6)
    got = {r.id: (r.rn, r.size) for r in ranking.number_within(df, ["grp"], ["v", "id"], total="size").collect()}
    for g in {r[1] for r in data}:
        members = sorted((r for r in data if r[1] == g), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(members):
            assert got[r[0]] == (i + 1, len(members))


def test_running_totals_and_average_ranks(spark):
    data, df = rows(spark, 400)
    hist = ranking.average_ranks(ranking.grouped_histogram(df, ["grp"], "v"))
    for r in hist.collect():
        values = sorted(x[2] for x in data if x[1] == r.grp)
        assert r.n_all == len(values) and r.n_cum == sum(v <= r.v for v in values)
        places = [i + 1 for i, v in enumerate(values) if v == r.v]
        assert r.avg_rank == pytest.approx(np.mean(places))


@pytest.mark.parametrize("n", [1, 2, 5, 333])
def test_exact_quantiles(spark, n):
    data, df = rows(spark, n)
    probes = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    whole = ranking.exact_quantiles(df, [], "v", probes).first().q
    assert whole == pytest.approx(list(np.quantile([r[2] for r in data], probes)))
    for r in ranking.exact_quantiles(df, ["grp"], "v", probes).collect():
        assert r.q == pytest.approx(list(np.quantile([x[2] for x in data if x[1] == r.grp], probes)))
