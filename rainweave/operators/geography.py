"""Administrative names, aliases and the conservative village link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainweave.operators.distributed import attach, require_empty

# Spellings of blocks and their canonical names.
BLOCK_ALIASES = {"Chandvad": "Chandwad", "Peint": "Peth", "Yevla": "Yeola", "Trimbakeshwar": "Trimbak"}


def normal(c) -> Column:
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def names_index(units: DataFrame, unit_id: str, unit_name: str, aliases: DataFrame | None = None,
                alias: str = "alias", canonical: str = "canonical") -> DataFrame:
    """Every accepted spelling of a unit: its id, its name and the aliases of its name."""
    ids = units.select(normal(F.col(unit_id).cast("string")).alias("spelling"), unit_id, unit_name)
    names = units.select(normal(unit_name).alias("spelling"), unit_id, unit_name)
    out = ids.unionByName(names)
    if aliases is not None:
        known = aliases.select(normal(alias).alias("spelling"), normal(canonical).alias("__c"))
        # An alias replaces the spelling, even where a unit carries that spelling itself.
        out = out.join(known.select("spelling"), "spelling", "left_anti").unionByName(
            known.join(out.withColumnRenamed("spelling", "__c"), "__c").drop("__c"))
    return out.distinct()


def resolve(df: DataFrame, name: str, index: DataFrame, strict: bool = False) -> DataFrame:
    """Attach the canonical unit; unresolved names stay with NULL, or fail with `strict`."""
    rows = df.withColumn("spelling", normal(name)).join(index, "spelling", "left").drop("spelling")
    if strict:
        key = [c for c in index.columns if c != "spelling"][0]
        require_empty(rows.where(F.col(key).isNull()), "Unresolved name")
    return rows


def link_villages(geometry: DataFrame, covariates: DataFrame, key: str, parent: str) -> DataFrame:
    """Geometry rows with `available` and every reason why one may not be linked.

    `parent` is the canonical parent id on both sides (NULL where unresolved).
    """
    def counted(df, name):
        return attach(df, df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), [key])

    cov = covariates.groupBy(key).agg(F.count(F.lit(1)).alias("__nc"), F.max(parent).alias("__cp"))
    rows = counted(geometry, "__ng").join(cov, key, "left")
    why = F.array_compact(F.array(
        F.when(F.col(parent).isNull(), "Unresolved block"),
        F.when(F.col("__nc").isNull(), "Missing covariate record"),
        F.when((F.coalesce("__nc", F.lit(0)) != 1) | (F.col("__ng") != 1), "Duplicate/placeholder geographic ID"),
        F.when(F.col("__nc").isNotNull() & F.col(parent).isNotNull() & ~F.col("__cp").eqNullSafe(F.col(parent)),
               "Boundary/covariate parent disagreement")))
    return rows.withColumns({"available": F.size(why) == 0,
                             "unavailable_reason": F.when(F.size(why) > 0, F.concat_ws("; ", why))}).drop("__nc", "__ng", "__cp")
