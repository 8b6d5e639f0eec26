import numpy as np
from pyspark.sql import functions as F

from rainweave.operators.distributed import attach, exact_quantiles, ordinal, running_sums


def values(seed=1):
    rng = np.random.default_rng(seed)
    wide = rng.normal(0, 1, 400) * 10.0 ** rng.integers(-6, 7, 400)
    close = 0.3333 + rng.random(400) * 1e-7
    # One group holds most rows and a third of them share one value.
    return [("hot", float(v)) for v in np.concatenate([wide, close, np.full(400, 2.0), [0.0, -0.0, 4.0, 8.0, 16.0]])] + \
           [("cold", float(v)) for v in wide[:7]] + [(None, 1.5), (None, 3.5)]


def test_running_sums_follow_the_sorted_group(spark):
    rows = values()
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.value): (r.n, r.cum_n, r.total_n) for r in running_sums(df, ["g"], F.col("v"), {"n": F.lit(1)}, totals=True).collect()}
    for g in ("hot", "cold", None):
        mine = sorted(v for k, v in rows if k == g)
        for v in set(mine):
            assert got[(g, v)] == (mine.count(v), sum(x <= v for x in mine), len(mine))


def test_exact_quantiles_match_numpy(spark):
    rows = values(2)
    df = spark.createDataFrame(rows, "g string, v double")
    qs = {"a": 0.025, "b": 0.5, "c": 0.9}
    for r in exact_quantiles(df, ["g"], F.col("v"), qs).collect():
        mine = [v for k, v in rows if k == r.g]
        np.testing.assert_allclose([r.a, r.b, r.c], np.quantile(mine, list(qs.values())), rtol=1e-12)
    low = exact_quantiles(df, [], F.col("v"), {"q": 0.4}, "lower").first().q
    assert low == sorted(v for _, v in rows)[int(0.4 * (len(rows) - 1))]


def test_attach_matches_null_keys_and_single_rows(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    agg = df.groupBy("k").agg(F.sum("x").alias("s"))
    assert {(r.k, r.s) for r in attach(df, agg, ["k"]).collect()} == {(None, 1), ("a", 2)}
    assert {r.s for r in attach(df, df.agg(F.sum("x").alias("s")), []).collect()} == {3}


def test_ordinal(spark):
    df = spark.createDataFrame([(5.0,), (-1.0,), (5.0,), (2.0,)], "v double")
    assert {(r.value, r.idx) for r in ordinal(df, F.col("v")).collect()} == {(-1.0, 0), (2.0, 1), (5.0, 2)}
