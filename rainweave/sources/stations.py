"""Station API payloads: a dictionary of daily series per station."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rainweave.functions.numeric import clamp

SCHEMA = "struct<properties:struct<parameter:map<string,map<string,double>>>>"


def reshape(df: DataFrame, key: list[str], payload: str) -> DataFrame:
    """Daily rows from {"properties": {"parameter": {name: {yyyyMMdd: value}}}}.

    Rain is clamped at 0 and humidity to 10..100; absent values take the defaults 0, 30, 20, 70.
    """
    series = F.from_json(payload, SCHEMA)["properties"]["parameter"]
    rows = df.select(*key, series.alias("s"))
    days = F.array_distinct(F.flatten(F.transform(F.map_values("s"), F.map_keys)))
    rows = rows.select(*key, "s", F.explode(days).alias("day"))

    def value(name, default):
        return F.coalesce(F.try_element_at(F.try_element_at("s", F.lit(name)), F.col("day")), F.lit(default))

    rows = rows.select(*key, F.to_date("day", "yyyyMMdd").alias("date"), value("PRECTOTCORR", 0.0).alias("r"),
                       value("T2M_MAX", 30.0).alias("hi"), value("T2M_MIN", 20.0).alias("lo"), value("RH2M", 70.0).alias("h"))
    return rows.select(*key, "date", F.bround(F.greatest(F.lit(0.0), F.col("r")), 2).alias("rainfall_mm"),
                       F.bround("hi", 1).alias("temp_max_c"), F.bround("lo", 1).alias("temp_min_c"),
                       F.bround((F.col("hi") + F.col("lo")) / 2, 1).alias("temp_mean_c"),
                       F.bround(clamp("h", 10, 100), 1).alias("rh_pct"))
