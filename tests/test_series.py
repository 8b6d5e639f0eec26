import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainweave.operators import series as W
from rainweave.operators.spatial import adjacency

START, DAYS = dt.date(2020, 5, 1), 61
LEAD, LAG = 3, 2


def rain(seed=7):
    return np.random.default_rng(seed).gamma(1, 8, (DAYS, 4))


def frame(spark, a, skip=()):
    rows = [(i, START + dt.timedelta(d), float(a[d, i])) for d in range(DAYS) for i in range(4) if d not in skip]
    return spark.createDataFrame(rows, "grid_id int, date date, rain_mm double")


def cells(spark):
    return spark.createDataFrame([(i, 19 + 0.25 * i, 74.0, i == 3) for i in range(4)], "grid_id int, lat double, lon double, excluded boolean")


def features(spark, a, chunk=1024):
    f = W.lag_features(frame(spark, a), ["grid_id"], "date", "rain_mm", LEAD, LAG, [6, 7, 8, 9, 10], chunk)
    near = adjacency(cells(spark), "grid_id", "lat", "lon", ~F.col("excluded"))
    return W.neighbour_features(f, near, "grid_id", "date")


def table(df):
    names = sorted(c for c in df.columns if c not in ("grid_id", "date", "rain_mm"))
    return {(r.grid_id, r.date): [None if r[n] is None else round(r[n], 9) for n in names] for r in df.collect()}, names


def test_values_and_first_target(spark):
    a = rain()
    got, names = table(features(spark, a))
    days = sorted({d for _, d in got})
    assert days[0] == dt.date(2020, 6, 1) and len(got) == 30 * 4
    t = 45
    row = dict(zip(names, got[(1, START + dt.timedelta(t))]))
    c = t - LEAD - LAG
    assert row["rain_thirteen_before"] == pytest.approx(a[c - 13, 1])
    assert row["mean14"] == pytest.approx(a[c - 13:c + 1, 1].mean())
    assert row["max3"] == pytest.approx(a[c - 2:c + 1, 1].max())
    assert row["neighbor_last"] == pytest.approx(a[c, [0, 2]].mean())
    assert row["neighbor_event_fraction"] == pytest.approx((a[c, [0, 2]] >= 20).mean())


def test_chunks_do_not_change_anything(spark):
    a = rain(3)
    assert table(features(spark, a, 9)) == table(features(spark, a))


def test_future_and_holdout_never_leak(spark):
    a = rain()
    base, names = table(features(spark, a))
    t0 = 40
    b = a.copy()
    b[t0 - LEAD - LAG + 1:] += 50
    later, _ = table(features(spark, b))
    for (g, d), v in base.items():
        if (d - START).days <= t0:
            assert later[(g, d)] == v
    c = a.copy()
    c[:, 3] += 50
    held, _ = table(features(spark, c))
    near = [i for i, n in enumerate(names) if n.startswith("neighbor")]
    for k, v in base.items():
        assert [held[k][i] for i in near] == [v[i] for i in near]


def test_gap_is_refused_and_gives_null(spark):
    gap = frame(spark, rain(), skip=(20,))
    with pytest.raises(ValueError):
        W.continuity(gap, ["grid_id"], "date", strict=True)
    f = W.lag_features(gap, ["grid_id"], "date", "rain_mm", LEAD, LAG)
    row = f.where(f"grid_id = 0 AND date = DATE'{START + dt.timedelta(25)}'").first()
    assert row.rain_last is None and row.mean3 is None and row.rain_previous is not None


@pytest.mark.parametrize("chunk", [3, 7, 64])
def test_dry_spells_against_brute_force(spark, chunk):
    import random
    rng = random.Random(chunk)
    rows, want = [], {}
    for cell in ("a", "b", "c", "empty", None):
        run, last = 0, None
        for k in range(160):
            if cell == "empty" or rng.random() < (0.03 if cell != "c" else 0.4):
                continue  # a missing date
            x = rng.choice([None, 5.0, 1.0]) if rng.random() < 0.06 and cell != "b" else rng.choice([0.0, 0.99])
            day = dt.date(2023, 11, 1) + dt.timedelta(days=k)
            dry = x is not None and x < 1
            run = 0 if not dry else run + 1 if last == k - 1 else 1
            last = k
            rows.append((cell, day, x, 1))
            want[cell, day] = run
    df = spark.createDataFrame(rows, "cell string, day date, rain double, dry int")
    got = {(r.cell, r.day): r.dry_days for r in W.dry_spells(df, ["cell"], "day", "rain", chunk=chunk).collect()}
    assert got == want and max(want.values()) > 20
    assert W.dry_spells(df.where("dry = 0"), ["cell"], "day", "rain").count() == 0


def test_distinct_days_and_continuity_hold_no_row_per_day(spark):
    d = dt.date
    rows = [(1, d(1969, 12, 30)), (1, d(1969, 12, 31)), (1, d(1970, 1, 1)), (1, d(1970, 1, 1)), (2, d(2001, 3, 1)), (2, d(2001, 3, 3)),
            (3, None), (3, None), (3, d(1995, 5, 5)), (None, d(1999, 1, 1)), (4, None), (5, d(1, 1, 1)), (5, d(9999, 12, 31))]
    df = spark.createDataFrame(rows, "k int, d date")
    days = W.distinct_days(df, ["k"], "d")
    assert sorted(map(tuple, days.collect()), key=str) == sorted(set(rows), key=str)
    got = {r.k: (r.n, r.days, r.continuous) for r in W.continuity(df, ["k"], "d").collect()}
    assert got.pop(4)[:2] == (1, 0)
    assert got == {1: (4, 3, False), 2: (2, 2, False), 3: (3, 1, False), None: (1, 1, True), 5: (2, 2, False)}
    assert "keys=[k" in (plan := W.continuity(days, ["k"], "d")._jdf.queryExecution().executedPlan().toString()) and "keys=[k, d" not in plan


def test_days_of_neighbours_are_not_broadcast(spark):
    cells = spark.range(30).selectExpr("id AS grid_id", "18 + id / 10 AS lat", "73 + id % 7 / 10 AS lon")
    days = cells.selectExpr("grid_id", "explode(sequence(DATE'2001-01-01', DATE'2002-12-31')) AS date", "CAST(grid_id AS DOUBLE) AS rain_mm")
    near = cells.selectExpr("grid_id", "(grid_id + 1) % 30 AS neighbour").union(cells.selectExpr("grid_id", "(grid_id + 2) % 30 AS neighbour"))
    out = W.neighbour_features(W.lag_features(days, ["grid_id"], "date", "rain_mm", LEAD, LAG, [6, 7]), near, "grid_id", "date")
    joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "[neighbour" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    got = {(r.grid_id, r.neighbor_last, r.neighbor_mean3, r.neighbor_mean7, r.neighbor_event_fraction) for r in out.collect()}
    assert got == {(i, *[sum(n := [(i + 1) % 30, (i + 2) % 30]) / 2] * 3, sum(x >= 20 for x in n) / 2) for i in range(30)} and out.count() == 30 * 2 * 61
