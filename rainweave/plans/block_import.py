"""Folder import: parsed files to accepted records, duplicates, conflicts, coverage and a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rainweave.operators import quality as Q
from rainweave.operators.distributed import attach
from rainweave.session import cut_lineage


def classify(parsed: DataFrame, key: list[str], known: DataFrame | None = None) -> DataFrame:
    """Parsed files with `status`, `values_sha256` and `canonical_file`.

    Files with reasons are rejected. Of the others the first file of a key is accepted, those with the same
    values are duplicates and those with other values conflicts. `known` holds keys accepted earlier, with
    values_sha256 and file, which take the place of the first file. The parsed rows are written once, as several branches read them.
    """
    rows = cut_lineage(parsed.withColumn("values_sha256", F.sha2(F.to_json("days"), 256)))
    good = F.size("reasons") == 0
    first = rows.where(good).groupBy(*key).agg(F.min(F.struct("file", "sha256", "values_sha256")).alias("__first"))
    rows = attach(rows, first, key)
    own = F.struct(F.col("file"), F.col("sha256")) == F.struct(F.col("__first.file").alias("file"), F.col("__first.sha256").alias("sha256"))
    told, file, new = F.col("__first.values_sha256"), F.col("__first.file"), own
    if known is not None:
        old = known.groupBy(*key).agg(F.min(F.struct("file", "values_sha256")).alias("__known"))
        rows = attach(rows, old, key)
        told, file = F.coalesce("__known.values_sha256", told), F.coalesce("__known.file", file)
        new = own & F.col("__known").isNull()
    status = (F.when(~good, "rejected").when(F.col("values_sha256") != told, "conflict").when(new, "accepted").otherwise("duplicate"))
    rows = rows.withColumns({"status": status, "canonical_file": F.when(good, file)})
    return rows.drop("__first", *(["__known"] if known is not None else []))


def coverage(classified: DataFrame, blocks: DataFrame, block: str, issue: str = "issue_date") -> DataFrame:
    """Each issue date with every expected block and whether a file of it was accepted."""
    have = classified.where("status = 'accepted'").select(F.col(issue), F.col(block), F.lit(0).alias("__all"))
    return Q.coverage(have, blocks.select(block, F.lit(0).alias("__all")), issue, "__all", block).drop("__all")


def manifest(classified: DataFrame) -> DataFrame:
    """One row: files by status, the dataset version from the input hashes, and whether the import is valid.

    Valid means that some file was accepted and none was rejected or in conflict.
    """
    kinds = ("accepted", "duplicate", "conflict", "rejected")
    counts = classified.agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds])
    version = Q.digest(classified.select("sha256"), [], F.col("sha256")).select(F.col("digest").alias("dataset_version"))
    valid = reduce(lambda a, b: a & b, [F.col("accepted") > 0, F.col("conflict") == 0, F.col("rejected") == 0])
    return attach(counts, version, []).withColumn("valid", valid)
