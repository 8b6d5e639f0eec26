"""Binary rain grids: float32 planes in either byte order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SHAPE = (129, 135)
MISSING = -999.0
SCHEMA = "file string, day int, iy int, ix int, rain_mm double"


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, content; one row per raw file."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("file"), "content")


def decode(files: DataFrame, days: int | None = 1, shape: tuple[int, int] = SHAPE, strict: bool = True) -> DataFrame:
    """Long rows (file, day, iy, ix, rain_mm) with NULL for missing cells.

    `days` is the number of planes every file must have; None takes it from a `days` column, e.g.
    the length of the file's year. A file is accepted if exactly one byte order gives plausible
    values; otherwise the task fails, or with strict=False the file yields one row with NULL day.
    Planes leave the decoder one by one, so a task holds one file and one plane of rows.
    """
    rows, cols = shape
    named = files.select("file", "content", (F.lit(days) if days is not None else F.col("days")).cast("int").alias("days"))

    def scan(batches):
        import numpy as np
        import pandas as pd
        iy, ix = (a.ravel().astype("int32") for a in np.indices((rows, cols)))
        for batch in batches:
            for name, content, n in zip(batch["file"], batch["content"], batch["days"]):
                found = []
                if len(content) == n * rows * cols * 4:
                    for order in ("<f4", ">f4"):
                        a = np.frombuffer(content, dtype=order).reshape(n, rows, cols)
                        gone = a == MISSING
                        with np.errstate(invalid="ignore"):
                            good = np.isfinite(a) & (a >= 0) & (a <= 5000)
                        if (gone | good).all() and gone.mean() > 0.01 and good.mean() > 0.1 and a[good].max() > 1:
                            found.append((a, gone))
                if len(found) != 1:
                    if strict:
                        raise ValueError(f"Invalid or ambiguous rain grid: {name}")
                    yield pd.DataFrame({"file": [name], "day": pd.array([None], "Int32"), "iy": pd.array([None], "Int32"),
                                        "ix": pd.array([None], "Int32"), "rain_mm": [None]})
                    continue
                a, gone = found[0]
                for d in range(n):
                    values = a[d].astype("float64").ravel()
                    values[gone[d].ravel()] = np.nan
                    yield pd.DataFrame({"file": name, "day": np.int32(d), "iy": iy, "ix": ix, "rain_mm": values})

    out = named.mapInPandas(scan, SCHEMA)
    return out.withColumn("rain_mm", F.when(~F.isnan("rain_mm"), F.col("rain_mm")))


def year_days(year) -> "F.Column":
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def extract(grids: DataFrame, cells: DataFrame, first_day) -> DataFrame:
    """Daily rows (date, grid_id, rain_mm) of the wanted cells; `first_day` is the date of plane 0."""
    return grids.join(cells.select("iy", "ix", "grid_id"), ["iy", "ix"]).select(
        F.date_add(first_day, F.col("day")).alias("date"), "grid_id", "rain_mm")


def cell_table(spark: SparkSession, shape: tuple[int, int] = SHAPE, lat0: float = 6.5, lon0: float = 66.5,
               step: float = 0.25) -> DataFrame:
    """All cells of the fixed grid with their centres and ids."""
    n = F.col("id")
    iy, ix = F.floor(n / shape[1]), n % shape[1]
    return spark.range(shape[0] * shape[1]).select(
        F.concat(F.lit("IMD025_"), iy, F.lit("_"), ix).alias("grid_id"), iy.cast("int").alias("iy"), ix.cast("int").alias("ix"),
        (lat0 + step * iy).alias("lat"), (lon0 + step * ix).alias("lon"))


def flag_cells(cells: DataFrame, state_edges: DataFrame, holdout_edges: DataFrame, halo: float = 0.25) -> DataFrame:
    """Cells inside the state, with holdout and halo flags; edges carry a `poly` column."""
    from rainweave.operators.spatial import points_in_polygons, within_halo
    inside = points_in_polygons(cells, state_edges, "grid_id", "poly", "lon", "lat").select("grid_id").distinct()
    held = points_in_polygons(cells, holdout_edges, "grid_id", "poly", "lon", "lat").select("grid_id").distinct()
    near = within_halo(cells, holdout_edges, "grid_id", "poly", "lon", "lat", halo).select("grid_id").distinct()
    out = cells.join(inside, "grid_id")
    out = out.join(held.withColumn("holdout", F.lit(True)), "grid_id", "left")
    out = out.join(near.withColumn("excluded_from_training", F.lit(True)), "grid_id", "left")
    return out.fillna(False, ["holdout", "excluded_from_training"])
