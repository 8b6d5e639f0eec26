"""Immutable runs published by a manifest, activation history and exports."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainweave.operators.quality import canonical_json, digest


DATA, MANIFESTS, ACTIVATIONS = "data", "_manifests", "_activations"
ACTIVATION = "seq long, run string, issue date"
MANIFEST = "run string, folder string, digest string, rows long, columns array<string>, partitions array<string>"


def _files(spark: SparkSession, path: str):
    """The path as the file system knows it, and that file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(target), fs


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file unless it is there already, which of all writers at once only one does; whether this one did.

    A stored file is complete: local ones are linked into place, in other stores a file appears under its name when it is
    closed, or counts as not there while it is empty.
    """
    target, fs = _files(spark, path)
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        own = target.toUri().getPath()
        part = os.path.join(os.path.dirname(own), f".{uuid.uuid4().hex}")
        with open(part, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(part, own)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
    try:
        out = fs.create(target, False)
    except Exception as error:  # the store's own exception says that the file is there
        if fs.exists(target):
            return False
        raise error
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _read_small(spark: SparkSession, path: str) -> str | None:
    target, fs = _files(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode() or None
    finally:
        stream.close()


def manifest(spark: SparkSession, path: str, run_id: str) -> dict | None:
    text = _read_small(spark, f"{path}/{MANIFESTS}/{safe_name(run_id)}.json")
    return json.loads(text) if text else None


def safe_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name or "") or name.startswith("."):
        raise ValueError(f"Invalid run identifier: {name!r}")
    return name


def write_run(df: DataFrame, path: str, run_id: str, partition_by: list[str] = ()) -> str:
    """Write one run once. Identical content again is a no-op, other content is an error.

    The rows go to a folder of their own that no reader knows. The run exists from the moment its manifest, which names
    that folder and its content digest, is created; of several writers one creates it, and the others compare with it.
    A writer that dies before leaves nothing visible.
    """
    spark, name = df.sparkSession, safe_name(run_id)
    row = canonical_json(df.columns)
    told = manifest(spark, path, name)
    folder = f"{name}.{uuid.uuid4().hex}"
    if told is None:
        df.write.partitionBy(*partition_by).parquet(f"{path}/{DATA}/folder={folder}")
        written = spark.read.schema(df.schema).parquet(f"{path}/{DATA}/folder={folder}")
        own = digest(written.select(*df.columns), [], row).first()
        text = json.dumps({"run": name, "folder": folder, "digest": own["digest"] if own else None, "rows": own["rows"] if own else 0,
                           "columns": df.columns, "partitions": list(partition_by)})
        if create_once(spark, f"{path}/{MANIFESTS}/{name}.json", text):
            return "written"
        told = manifest(spark, path, name)
        target, fs = _files(spark, f"{path}/{DATA}/folder={folder}")
        fs.delete(target, True)  # this writer's own rows, which no manifest names
    else:
        own = digest(df, [], row).first()
    if sorted(told["columns"]) != sorted(df.columns) or told["digest"] != (own["digest"] if own else None):
        raise ValueError(f"Refusing to overwrite immutable run: {run_id}")
    return "unchanged"


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The rows of one published run."""
    told = manifest(spark, path, run_id)
    if told is None:
        raise ValueError(f"No such run: {run_id}")
    return spark.read.option("basePath", f"{path}/{DATA}/folder={told['folder']}").parquet(f"{path}/{DATA}/folder={told['folder']}").select(*told["columns"])


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per published run."""
    return _small_rows(spark, f"{path}/{MANIFESTS}", MANIFEST)


def activations(spark: SparkSession, path: str) -> DataFrame:
    """seq, run, issue: every activation, in order."""
    return _small_rows(spark, f"{path}/{ACTIVATIONS}", ACTIVATION)


def _small_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    target, fs = _files(spark, path)
    if not fs.exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def activate(spark: SparkSession, path: str, run_id: str, issue: str) -> int:
    """Appends an activation of a published run; the number it got. Activations at the same time get one number each."""
    if manifest(spark, path, run_id) is None:
        raise ValueError(f"No such run: {run_id}")
    last = activations(spark, path).agg(F.max("seq")).first()[0]
    seq = 0 if last is None else last + 1
    while not create_once(spark, f"{path}/{ACTIVATIONS}/a{seq:012}.json", json.dumps({"seq": seq, "run": safe_name(run_id), "issue": str(issue)})):
        seq += 1
    return seq


def served(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the default run (latest issue, latest activation on ties), with its run.

    All runs are one partitioned table, joined by folder with the default run's manifest: which folders are read is decided
    when the query runs (dynamic partition pruning), and conditions on partition columns choose the files in them.
    """
    default = history(activations(spark, path), "run", "seq", "issue").where("is_default").select("run")
    chosen = manifests(spark, path).join(default, "run").select("folder", "run")
    return spark.read.parquet(f"{path}/{DATA}").join(F.broadcast(chosen), "folder").drop("folder")  # one row: there is one default run


def history(activations: DataFrame, run: str, seq: str, issue: str, series: list[str] = ()) -> DataFrame:
    """Ordered-unique runs of a series with the current default: the latest issue, latest first on ties.

    `position` follows each run's first activation; `previous_default` is the default before the
    last activation batch.
    """
    first = activations.groupBy(*series, run).agg(F.min(seq).alias("first_seq"), F.max(issue).alias("issue"))
    last = activations.groupBy(*series).agg(F.max(seq).alias("last_seq"))
    from rainweave.operators.distributed import attach
    rows = attach(activations, last, list(series))
    latest = rows.groupBy(*series).agg(
        F.max_by(run, F.struct(issue, seq)).alias("default_run"),
        F.max_by(run, F.when(F.col(seq) < F.col("last_seq"), F.struct(issue, seq))).alias("previous_default"))
    return attach(first, latest, list(series)).withColumn("is_default", F.col(run) == F.col("default_run"))


def geojson_features(df: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row as text, ready for a text sink."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.col(geometry).alias("geometry"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Rows with a header, quotes doubled; NULL is nothing, an empty text is quoted. A folder that exists is an error."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def map_features(geometry: DataFrame, forecast: DataFrame, key: list[str], fields: list[str],
                 reason: str = "Parent block forecast missing") -> DataFrame:
    """source_* and local_* columns beside every geometry; missing rows keep it with a reason."""
    rows = forecast.select(*key, *[F.col(f"source_{f}") for f in fields], *[F.col(f"local_{f}") for f in fields],
                           F.lit(True).alias("__has"))
    out = geometry.join(rows, key, "left")
    has = F.coalesce("__has", F.lit(False)) & F.col("available")
    shown = {c: F.when(has, F.col(c)) for f in fields for c in (f"source_{f}", f"local_{f}")}
    return out.withColumns({**shown, "unavailable_reason": F.when(~has, F.coalesce("unavailable_reason", F.lit(reason))),
                            "available": has}).drop("__has")


def bulletin_table(df: DataFrame, key: list[str], date: str, fields: list[str], days: int = 5) -> DataFrame:
    """Variable x day table, source beside local: columns d0_source, d0_local, ... and the sums source_total, local_total.

    Every date is shown: a key whose dates span more than `days` has one table per span of that
    length, counted from its first date; first_date is the first day of the span. Day columns are
    offsets, so no distinct dates are collected first. Totals leave missing days out.
    """
    from rainweave.operators.distributed import attach
    rows = attach(df, df.groupBy(*key).agg(F.min(date).alias("__start")), key)
    offset = F.datediff(F.col(date), F.col("__start"))
    rows = rows.withColumn("__day", offset % days).withColumn("first_date", F.date_sub(F.col(date), F.col("__day")))
    long = rows.select(*key, "first_date", "__day", F.inline(F.array(*[F.struct(
        F.lit(f).alias("variable"), F.col(f"source_{f}").cast("double").alias("source"),
        F.col(f"local_{f}").cast("double").alias("local")) for f in fields])))
    table = long.groupBy(*key, "first_date", "variable").pivot("__day", list(range(days))).agg(
        F.max("source").alias("source"), F.max("local").alias("local"))
    names = {f"{i}_{s}": F.col(f"{i}_{s}").alias(f"d{i}_{s}") for i in range(days) for s in ("source", "local")}

    def total(side):
        known = F.array_compact(F.array(*[f"{i}_{side}" for i in range(days)]))
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v)).alias(f"{side}_total")

    return table.select(*key, "first_date", "variable", *names.values(), total("source"), total("local"))


def cell_value(c: str) -> Column:
    return F.coalesce(F.format_number(F.col(c), 2), F.lit("Unavailable"))
