"""Grid files as a data source: many tasks a file, filters choose planes, broken files, and the files sink."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from rainweave.sources import grid_source as G


def year_file(path, order, planes=366, shape=(6, 5)):
    rng = np.random.default_rng(planes)
    a = np.where(rng.random((planes, *shape)) < 0.3, -999.0, np.round(rng.gamma(1, 6, (planes, *shape)), 2)).astype(order)
    a[:, 0, 0] = -999.0
    a[7] = 3.5  # a plane without missing cells tells no order by itself
    path.write_bytes(a.tobytes())
    return a


def expected(name, a):
    return {(name, d, y, x): None if v == -999 else float(v) for (d, y, x), v in np.ndenumerate(a.astype(float))}


@pytest.mark.parametrize("order", ["<f4", ">f4"])
def test_a_year_is_read_by_many_tasks(spark, tmp_path, order):
    a = year_file(tmp_path / "2024.grd", order)
    df = G.scan(spark, str(tmp_path), rows="6", cols="5", planes="20")
    assert df.rdd.getNumPartitions() == 19
    assert {(r.file, r.day, r.iy, r.ix): r.rain_mm for r in df.collect()} == expected("2024.grd", a)
    alone = G.scan(spark, str(tmp_path), days=(7, 7), rows="6", cols="5")
    assert alone.agg(F.sum("rain_mm"), F.count("*")).first()[:] == (30 * 3.5, 30)


def test_ranges_choose_planes_and_cells(spark, tmp_path):
    a, b = year_file(tmp_path / "a.grd", "<f4"), year_file(tmp_path / "b.grd", ">f4", 40)
    want = {**expected("a.grd", a), **expected("b.grd", b)}
    scan = lambda **k: G.scan(spark, str(tmp_path), rows="6", cols="5", planes="1", **k)
    assert scan(days=(100, 100)).rdd.getNumPartitions() == 1 and scan().rdd.getNumPartitions() == 406
    cases = [(dict(days=(100, 100)), lambda f, d, y, x: d == 100), (dict(days=(30, 44), box=(4, 5, 0, 4)), lambda f, d, y, x: 30 <= d <= 44 and y > 3),
             (dict(files=["b.grd"], box=(0, 5, 0, 1)), lambda f, d, y, x: f == "b.grd" and x <= 1), (dict(files=["a.grd", "zz"], days=(361, 999)), lambda f, d, y, x: f == "a.grd" and d > 360),
             (dict(days=(400, 500)), lambda *_: False), (dict(files=[]), lambda *_: False), (dict(box=(2, 1, 0, 4)), lambda *_: False)]
    for options, keep in cases:
        got = {(r.file, r.day, r.iy, r.ix): r.rain_mm for r in scan(**options).collect()}
        assert got == {k: v for k, v in want.items() if keep(*k)}, options


def test_broken_files(spark, tmp_path):
    a = year_file(tmp_path / "good.grd", "<f4", 9)
    (tmp_path / "short.grd").write_bytes(b"x" * 119)
    (tmp_path / "empty.grd").write_bytes(b"")
    (tmp_path / "wild.grd").write_bytes(np.full((2, 6, 5), 1e9, "<f4").tobytes())
    (tmp_path / ".part").write_bytes(b"left over")
    df = G.scan(spark, str(tmp_path), rows="6", cols="5", strict="false")
    assert {r.file for r in df.where("day is null").collect()} == {"short.grd", "empty.grd", "wild.grd"}
    assert df.where("day is not null").count() == a.size
    with pytest.raises(Exception, match="ambiguous rain grid"):
        G.scan(spark, str(tmp_path), rows="6", cols="5").count()
    (tmp_path / "none").mkdir()
    assert G.scan(spark, str(tmp_path / "none")).count() == 0


def test_files_appear_only_when_the_job_is_done(spark, tmp_path):
    files = spark.createDataFrame([(f"f{k}", bytearray([k] * 10)) for k in range(9)], "file string, content binary").repartition(3)
    G.write_files(files, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == [f"f{k}" for k in range(9)] and (tmp_path / "out" / "f3").read_bytes() == b"\x03" * 10
    bad = files.withColumn("content", F.when(F.col("file") == "f8", F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        G.write_files(bad, str(tmp_path / "other"))
    assert not [f for f in (os.listdir(tmp_path / "other") if (tmp_path / "other").exists() else []) if not f.startswith(".")]
