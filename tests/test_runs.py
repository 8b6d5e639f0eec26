"""Run store: one writer wins, nothing half-written is seen, requests read only the default run's files of a date."""

import os
import re
import threading

import pytest
from pyspark.sql import functions as F
from rainweave.operators import runs as R
from rainweave.plans import served_run as SR


def rows(spark, k=1, n=60):
    return spark.range(n).select("id", (F.col("id") * k).alias("v"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("valid_date"))


def test_one_of_two_writers_wins(spark, tmp_path):
    path, start, got = str(tmp_path), threading.Barrier(2), {}

    def write(k):
        df = rows(spark, k)
        start.wait()
        try:
            got[k] = R.write_run(df, path, "run", ["valid_date"])
        except ValueError:
            got[k] = "refused"

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got.values()) == ["refused", "written"]
    winner = next(k for k, v in got.items() if v == "written")
    assert R.read_run(spark, path, "run").agg(F.sum("v")).first()[0] == winner * sum(range(60))
    assert len(os.listdir(f"{path}/data")) == 1  # the loser's rows are gone
    assert R.write_run(rows(spark, winner).repartition(5), path, "run", ["valid_date"]) == "unchanged"
    with pytest.raises(ValueError):
        R.write_run(rows(spark, winner).drop("v"), path, "run")


def test_same_content_at_once_is_no_error(spark, tmp_path):
    got = []
    threads = [threading.Thread(target=lambda: got.append(R.write_run(rows(spark), str(tmp_path), "r"))) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == ["unchanged", "written"] and R.read_run(spark, str(tmp_path), "r").count() == 60


def test_a_killed_write_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    path = str(tmp_path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(R, "create_once", killed)
        with pytest.raises(KeyboardInterrupt):
            R.write_run(rows(spark, 5), path, "a", ["valid_date"])
    assert R.manifests(spark, path).count() == 0
    with pytest.raises(ValueError):
        R.read_run(spark, path, "a")
    with pytest.raises(ValueError):
        R.activate(spark, path, "a", "2024-01-01")
    assert SR.publish(rows(spark, 1), path, "a", "2024-01-01") == "written"
    assert R.served(spark, path).agg(F.sum("v")).first()[0] == sum(range(60))  # not the killed writer's rows


def test_a_failing_job_publishes_nothing(spark, tmp_path):
    bad = rows(spark).withColumn("v", F.when(F.col("id") == 59, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        R.write_run(bad, str(tmp_path), "a")
    assert R.manifest(spark, str(tmp_path), "a") is None


def test_activations_at_once_get_one_number_each(spark, tmp_path):
    path = str(tmp_path)
    for name in ("a", "b"):
        R.write_run(rows(spark), path, name)
    got = []
    threads = [threading.Thread(target=lambda k=k: got.append(R.activate(spark, path, "ab"[k % 2], f"2024-01-0{1 + k % 2}"))) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == list(range(6)) and R.activations(spark, path).count() == 6
    assert R.served(spark, path).select("run").distinct().first().run == "b"
    for name in ("../x", "", ".hidden", "a/b"):
        with pytest.raises(ValueError):
            R.write_run(rows(spark), path, name)


def test_empty_runs_and_store(spark, tmp_path):
    path = str(tmp_path)
    assert R.manifests(spark, path).count() == R.activations(spark, path).count() == 0
    assert R.write_run(rows(spark).where("id < 0"), path, "none") == "written"
    assert R.write_run(rows(spark).where("id < 0"), path, "none") == "unchanged"
    assert R.read_run(spark, path, "none").count() == 0


def test_a_request_prunes_runs_and_dates_when_it_runs(spark, tmp_path):
    path = str(tmp_path)
    for k, name in enumerate(("old", "new", "other")):
        SR.publish(rows(spark, k + 1), path, name, f"2024-02-0{3 if name == 'new' else 1}")
    out = SR.request(spark, path, "2024-01-02")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    filters = re.search(r"PartitionFilters: \[.*2024-01-02.*\]", plan)[0]
    assert "dynamicpruning" in filters
    assert out.agg(F.sum("v"), F.count("*"), F.max("run")).first()[:] == (2 * sum(range(1, 60, 3)), 20, "new")
    # files opened by the scan: those of one run and one date
    out.collect()
    scan = out._jdf.queryExecution().executedPlan()
    found, todo = [], [scan.executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node)
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    numbers = [n.metrics().apply("numFiles").value() for n in found]
    folders = [f"{path}/data/{d}" for d in os.listdir(f"{path}/data")]
    count = lambda top: sum(f.endswith(".parquet") for _, _, files in os.walk(top) for f in files)
    new = next(d for d in folders if "folder=new." in d)
    assert numbers == [count(f"{new}/valid_date=2024-01-02")] and 0 < numbers[0] < sum(map(count, folders)) / 6
    with pytest.raises(ValueError):
        SR.request(spark, path, "2030-01-01", strict=True)
