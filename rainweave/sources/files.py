"""Plain file readers: CSV with BOM, JSON and GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header CSV in UTF-8, with or without a byte order mark; quotes inside quotes are doubled."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("encoding", "UTF-8").option("enforceSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_geojson(spark: SparkSession, path: str, properties: str, coordinates: str = "array<array<array<double>>>",
                 multiline: bool = True) -> DataFrame:
    """One row per feature: its properties, geometry type and coordinates.

    A collection per file by default; multiline=False reads one collection per line.
    """
    feature = f"struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:{coordinates}>>"
    raw = read_json(spark, path, f"features array<{feature}>", multiline)
    return raw.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"),
                                                               F.col("f.geometry.coordinates").alias("coordinates"))


def rings(df: DataFrame, coordinates: str = "coordinates") -> DataFrame:
    """Every ring of polygon coordinates as array<struct<lon, lat>>, holes included (parity handles them)."""
    point = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    return df.withColumn("ring", F.explode(F.transform(coordinates, lambda r: F.transform(r, point))))
