"""Incremental import of newly arrived block tables, idempotent by content, with what was seen kept as stream state."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rainweave.functions.text import utf8
from rainweave.sources import block_tables as B

SOURCE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
STATUS_SCHEMA = "file string, sha256 string, block string, issue_date date, values_sha256 string, status string, canonical_file string, " \
                "reasons array<string>, warnings array<string>"
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
BUCKETS = 8192


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Stream of whole CSV files as file, content, sha256."""
    raw = (spark.readStream.format("binaryFile").schema(SOURCE_SCHEMA)
           .option("pathGlobFilter", "*.{csv,CSV}").load(path))
    return raw.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("file"),
                      utf8("content").alias("content"), F.sha2("content", 256).alias("sha256"))


def _bucket(key: str):
    """Keys of a bucket are worked on in one call, as one call a key costs milliseconds; each is still looked up by itself."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")


def _new_contents(files: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """The first file of each content: one that no batch before had, of a batch the one whose name sorts first."""
    from pyspark.sql.streaming import StatefulProcessor

    class First(StatefulProcessor):
        def init(self, handle):
            self.seen = handle.getMapState("seen", "sha256 string", "file string")

        def handleInitialState(self, key, rows, timers):
            for sha, file in zip(rows["sha256"], rows["file"]):
                self.seen.updateValue((sha or "",), (file or "",))

        def handleInputRows(self, key, rows, timers):
            import pandas as pd
            begun, first = self.seen.exists(), {}
            name = lambda file: (file is None, file or "")  # noqa: E731  a missing name sorts last
            for part in rows:
                for file, content, sha in zip(part["file"], part["content"], part["sha256"]):
                    if sha not in first:
                        first[sha] = None if begun and self.seen.containsKey((sha or "",)) else (file, content)
                    elif first[sha] and name(file) < name(first[sha][0]):
                        first[sha] = (file, content)
            fresh = [(*x, sha) for sha, x in first.items() if x]
            for file, _, sha in fresh:
                self.seen.updateValue((sha or "",), (file or "",))
            if fresh:
                yield pd.DataFrame(fresh, columns=["file", "content", "sha256"])

        def close(self):
            pass

    state = None if earlier is None else earlier.select(_bucket("sha256"), "sha256", "file").groupBy("bucket")
    return files.select(_bucket("sha256"), "file", "content", "sha256").groupBy("bucket").transformWithStateInPandas(
        First(), "file string, content string, sha256 string", "append", "none", initialState=state)


def _judged(parsed: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """parsed with key, values_sha256, status and canonical_file; one file of a key was, or is, accepted.

    The state of a key is the name and the digest of the values of its accepted file.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Verdict(StatefulProcessor):
        def init(self, handle):
            self.accepted = handle.getMapState("accepted", "key string", "file string, values_sha256 string")

        def handleInitialState(self, key, rows, timers):
            for row in zip(rows["key"], rows["file"], rows["values_sha256"]):
                self.accepted.updateValue(row[:1], row[1:])

        def handleInputRows(self, key, rows, timers):
            import pandas as pd
            begun, told, out = self.accepted.exists(), {}, []
            for part in rows:
                out += list(zip(part["file"], part["sha256"], part["values_sha256"], part["good"], part["row"], part["key"]))
            verdicts = []
            for file, sha, values, good, row, name in sorted(out, key=lambda r: (r[0] is None, r[0] or "", r[1] or "")):
                if not good:
                    verdicts.append((file, sha, values, row, "rejected", None))
                    continue
                if name not in told and begun and self.accepted.containsKey((name,)):
                    told[name] = self.accepted.getValue((name,))
                if name not in told:
                    told[name] = (file, values)
                    self.accepted.updateValue((name,), told[name])
                    verdicts.append((file, sha, values, row, "accepted", file))
                else:
                    verdicts.append((file, sha, values, row, "duplicate" if values == told[name][1] else "conflict", told[name][0]))
            yield pd.DataFrame(verdicts, columns=["file", "sha256", "values_sha256", "row", "status", "canonical_file"])

        def close(self):
            pass

    whole = F.struct(*[c for c in parsed.columns])
    good = F.size("reasons") == 0
    # rejected files share no key: nothing is decided between them
    key = F.when(good, F.concat_ws("|", "block", F.col("issue_date").cast("string"))).otherwise(F.concat(F.lit("rejected "), F.col("sha256")))
    rows = parsed.select(key.alias("key"), "file", "sha256", F.sha2(F.to_json("days"), 256).alias("values_sha256"), good.alias("good"), F.to_json(whole).alias("row"))
    state = None if earlier is None else earlier.where("status = 'accepted'").select(
        F.concat_ws("|", "block", F.col("issue_date").cast("string")).alias("key"), "file", "values_sha256")
    state = None if state is None else state.select(_bucket("key"), "key", "file", "values_sha256").groupBy("bucket")
    judged = rows.select(_bucket("key"), *rows.columns).groupBy("bucket").transformWithStateInPandas(
        Verdict(), "file string, sha256 string, values_sha256 string, row string, status string, canonical_file string", "append", "none", initialState=state)
    kind = parsed.schema.simpleString()
    return judged.select(F.from_json("row", kind).alias("row"), "values_sha256", "status", "canonical_file").select("row.*", "values_sha256", "status", "canonical_file")


def import_stream(files: DataFrame, out: str, checkpoint: str, index: DataFrame | None = None, districts: list[str] = ("Nashik",),
                  block_id: str = "block_id", block_name: str = "block_name") -> StreamingQuery:
    """Validate each batch of a (file, content, sha256) stream like the batch import; write below `out`.

    `index` (spelling, block_id, block_name) names the known blocks; without it blocks go by the title's
    spelling. `files` holds one row per new content with its status: rejected, accepted, duplicate (its
    block and issue date were imported with the same values) or conflict (with other values), judged
    against its batch and all earlier ones; `records` holds the accepted days.

    Which contents were seen and what was accepted for a block and issue date is state of the stream, kept by key in its
    checkpoint: a batch reads no earlier file. Only a new checkpoint on an output that exists begins by reading its
    `files`. A batch that is replayed after a failure writes the same folders again, named by the query and the batch.
    """
    spark = files.sparkSession
    begun = _exists(spark, f"{checkpoint}/commits/0")  # its first batch is complete
    earlier = spark.read.schema(STATUS_SCHEMA).parquet(f"{out}/files") if not begun and _exists(spark, f"{out}/files") else None
    parsed = B.parse(_new_contents(files, earlier), districts)
    if index is not None:
        parsed = B.resolve_blocks(parsed, index, block_id, block_name).withColumn("block", F.col(block_id).cast("string"))
    else:
        parsed = parsed.withColumn("block", B.normal("title_block"))
    judged = _judged(parsed, earlier)
    identity = [block_id, block_name] if index is not None else []

    def write(batch: DataFrame, epoch: int) -> None:
        name = f"{_query_id(batch.sparkSession, checkpoint)}-{epoch:010}"
        rows = batch.persist()
        rows.select(*[c.split()[0] for c in STATUS_SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{out}/files/batch={name}")
        B.records(rows.where("status = 'accepted'"), *identity).write.mode("overwrite").parquet(f"{out}/records/batch={name}")
        rows.unpersist()

    with _settings(spark, STATE_STORE):
        return (judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).outputMode("append").start())


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """A query takes its settings along when it starts; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return bool(fs.exists(target))


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The query's id, which its checkpoint keeps over restarts."""
    target, fs = _path(spark, f"{checkpoint}/metadata")
    stream = fs.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["id"]
    finally:
        stream.close()
