"""Village covariates: terrain proxies, land cover shares, distances and the rain anomaly."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rainweave.functions.numeric import half_even
from rainweave.functions.text import synthesized_id
from rainweave.operators.rules import first_match
from rainweave.operators.spatial import min_distance_km

LULC = ("tree", "shrub", "grass", "crop", "urban", "water", "bare")


class Rise(NamedTuple):
    """Metres per degree on the way from one value of a coordinate towards higher or lower ones; not below zero where floored."""

    metres: float
    of: str
    start: float
    towards: str
    floored: bool = False


class Band(NamedTuple):
    """Terrain west of a longitude (None: everywhere else)."""

    west_of: float | None
    base: float
    rises: tuple[Rise, ...]
    slope: float


class Sampled(NamedTuple):
    """How a sampled height gives spread, slope and aspect, and which heights count."""

    least_std: float
    std_share: float
    steep_west_of: float
    steep_above: float
    steep_slope: float
    flat_slope: float
    aspect_per_degree: float
    height_over: float
    height_under: float


class Anomaly(NamedTuple):
    """Rain bias: a bell over a crest or a ramp west of a longitude, and a shadow that grows towards the east."""

    west_of: float
    west_mm: float
    crest: float | None          # of the bell; None for a ramp
    width: float                 # of the bell, or steepness of the ramp
    shadow_mm: float
    shadow_from: float
    shadow_per_degree: float


class Region(NamedTuple):
    bands: tuple[Band, ...]
    least_std: float
    land_cover: list[tuple[dict[str, float], list[str]]]
    other_cover: dict[str, float]
    sampled: Sampled
    anomaly: Anomaly


# Fixed values of the first region: terrain by longitude, land cover in percent by part of the block's name, rain bias.
STATE = Region(
    bands=(Band(west_of=73.1, base=15.0, rises=(Rise(80.0, "lon", 72.6, "up", floored=True),), slope=1.8),
           Band(west_of=73.8, base=580.0, rises=(Rise(45.0, "lat", 18.0, "up", floored=True), Rise(600.0, "lon", 73.8, "down")), slope=14.5),
           Band(west_of=75.0, base=560.0, rises=(Rise(-120.0, "lon", 73.8, "up"),), slope=3.2),
           Band(west_of=None, base=320.0, rises=(Rise(-20.0, "lon", 75.0, "up"),), slope=1.5)),
    least_std=0.0,
    land_cover=[({"tree": 52.0, "shrub": 18.0, "grass": 8.0, "crop": 16.0, "urban": 2.0, "water": 4.0, "bare": 0.0}, ["igatpuri", "trimbak", "peint", "peth", "surgana"]),
                ({"tree": 8.0, "shrub": 6.0, "grass": 4.0, "crop": 72.0, "urban": 6.0, "water": 4.0, "bare": 0.0}, ["niphad", "dindori", "nashik"]),
                ({"tree": 4.0, "shrub": 22.0, "grass": 14.0, "crop": 52.0, "urban": 3.0, "water": 1.0, "bare": 4.0}, ["malegaon", "yeola", "nandgaon", "deola", "chandvad"])],
    other_cover={"tree": 12.0, "shrub": 14.0, "grass": 10.0, "crop": 58.0, "urban": 4.0, "water": 2.0, "bare": 0.0},
    sampled=Sampled(least_std=5.0, std_share=0.08, steep_west_of=73.8, steep_above=500.0, steep_slope=12.0, flat_slope=2.5, aspect_per_degree=37.0,
                    height_over=-500.0, height_under=9000.0),
    anomaly=Anomaly(west_of=73.65, west_mm=45.0, crest=73.5, width=0.05, shadow_mm=-15.0, shadow_from=73.8, shadow_per_degree=1.5))
# Fixed values of the second region.
SECOND = Region(
    bands=(Band(west_of=73.65, base=650.0, rises=(Rise(800.0, "lon", 73.65, "down"),), slope=15.0),
           Band(west_of=74.0, base=560.0, rises=(Rise(-80.0, "lon", 73.65, "up"),), slope=4.0),
           Band(west_of=None, base=530.0, rises=(Rise(-60.0, "lon", 74.0, "up"),), slope=2.0)),
    least_std=5.0,
    land_cover=[({"tree": 48.0, "shrub": 18.0, "grass": 8.0, "crop": 18.0, "urban": 3.0, "water": 5.0, "bare": 0.0}, ["mawal", "mulshi", "velhe", "bhor"]),
                ({"tree": 6.0, "shrub": 10.0, "grass": 6.0, "crop": 70.0, "urban": 4.0, "water": 4.0, "bare": 0.0}, ["baramati", "indapur", "daund", "shirur"]),
                ({"tree": 10.0, "shrub": 12.0, "grass": 6.0, "crop": 64.0, "urban": 5.0, "water": 3.0, "bare": 0.0}, ["junnar", "ambegaon", "khed", "purandar"])],
    other_cover={"tree": 12.0, "shrub": 14.0, "grass": 8.0, "crop": 48.0, "urban": 14.0, "water": 4.0, "bare": 0.0},
    sampled=Sampled(least_std=4.0, std_share=0.08, steep_west_of=73.7, steep_above=550.0, steep_slope=14.0, flat_slope=3.0, aspect_per_degree=37.0,
                    height_over=0.0, height_under=4000.0),
    anomaly=Anomaly(west_of=73.7, west_mm=38.0, crest=None, width=2.5, shadow_mm=-12.0, shadow_from=73.7, shadow_per_degree=1.5))

# Coast and river reference points as (lon, lat).
COAST = [(72.82, 18.90), (72.73, 19.97), (72.87, 18.64), (73.09, 17.81),
         (73.30, 16.99), (73.63, 15.86), (72.80, 19.40), (72.70, 20.20)]
RIVERS = [(73.53, 19.94), (73.79, 19.99), (74.11, 20.08), (74.50, 20.00), (75.30, 19.50), (77.30, 19.10),
          (73.85, 18.53), (74.58, 18.15), (75.90, 17.65), (74.20, 16.70),
          (74.20, 21.30), (75.56, 21.01), (77.00, 21.20)]


def _banded(region: Region, value) -> Column:
    out = None
    for band in reversed(region.bands):
        out = value(band) if out is None else F.when(F.col("lon") < band.west_of, value(band)).otherwise(out)
    return out


def _height(band: Band) -> Column:
    h = F.lit(band.base)
    for r in band.rises:
        way = F.col(r.of) - r.start if r.towards == "up" else r.start - F.col(r.of)
        h = h + (F.greatest(F.lit(0.0), r.metres * way) if r.floored else r.metres * way)
    return h


def topography(region: Region = STATE, sampled: str | None = None) -> dict[str, Column]:
    """Elevation, its spread and limits, slope and aspect from `lat`, `lon` and, where valid, a sampled height."""
    proxy = _banded(region, _height)
    std = F.greatest(F.lit(region.least_std), half_even(proxy * 0.07, 1))
    slope, turn = _banded(region, lambda b: F.lit(b.slope)), F.lit(42.0)
    height, low_at = proxy, F.lit(1.2)
    if sampled:
        by, s = region.sampled, F.col(sampled)
        ok = F.coalesce((s > by.height_over) & (s < by.height_under), F.lit(False))
        height = F.when(ok, s).otherwise(proxy)
        std = F.when(ok, F.greatest(F.lit(by.least_std), half_even(s * by.std_share, 1))).otherwise(std)
        slope = F.when(ok, F.when((F.col("lon") < by.steep_west_of) & (s > by.steep_above), by.steep_slope).otherwise(by.flat_slope)).otherwise(slope)
        turn = F.when(ok, by.aspect_per_degree).otherwise(turn)
        low_at = F.when(ok, 1.5).otherwise(low_at)
    return {"elevation_mean": half_even(height, 1), "elevation_std": std,
            "elevation_min": half_even(F.greatest(F.lit(0.0), height - std * low_at), 1),
            "elevation_max": half_even(height + std * low_at, 1), "slope_mean": half_even(slope, 1),
            "aspect_mean": half_even(F.pmod(F.col("lon") * turn, F.lit(360.0)), 1)}


def land_cover(block, region: Region = STATE) -> dict[str, Column]:
    return {f"lulc_{name}_pct": first_match(block, [(shares[name], keys) for shares, keys in region.land_cover],
                                            region.other_cover[name]) for name in LULC}


def rain_anomaly(region: Region = STATE) -> Column:
    """Wet in the west, a rain shadow in the east."""
    a, lon = region.anomaly, F.col("lon")
    west = a.west_mm * (a.west_of - lon) * a.width if a.crest is None else a.west_mm * F.exp(-F.pow(lon - a.crest, F.lit(2)) / a.width)
    shadow = a.shadow_mm * F.least(F.lit(1.0), (lon - a.shadow_from) * a.shadow_per_degree)
    return F.when(lon < a.west_of, half_even(west, 1)).otherwise(half_even(shadow, 1))


def topographic_variability(std="elevation_std", slope="slope_mean") -> Column:
    return F.col(std) / 10.0 + F.col(slope) / 5.0


def covariates(df: DataFrame, district_code: str, village_code: str, block: str, region: Region = STATE,
               prefix: str = "MH", sampled: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One covariate row per centroid (`lat`, `lon`), all in one projection."""
    from rainweave.operators.distributed import staged
    terrain = topography(region, sampled)
    rows = staged(df, terrain)
    return rows.select(
        *keep, synthesized_id(prefix, (district_code, "00"), (village_code, "0")).alias("panchayat_id"),
        F.round("lat", 5).alias("centroid_lat"), F.round("lon", 5).alias("centroid_lon"),
        min_distance_km("lat", "lon", COAST).alias("dist_to_coast_km"), min_distance_km("lat", "lon", RIVERS).alias("dist_to_water_km"),
        rain_anomaly(region).alias("historical_rain_bias"), *terrain.keys(),
        *[c.alias(n) for n, c in land_cover(block, region).items()])


def local_weather(df: DataFrame, rain: str, tmax: str, tmin: str, deviation: str, elevation: str = "elevation_mean") -> DataFrame:
    """Temperatures by lapse rate about 550 m with half the deviation; humidity follows rain."""
    lapse = (F.col(elevation) - 550.0) * (6.5 / 1000.0)
    return df.withColumns({
        "downscaled_tmax_pred": half_even(F.col(tmax) - lapse + F.col(deviation) * 0.5, 1),
        "downscaled_tmin_pred": half_even(F.col(tmin) - lapse + F.col(deviation) * 0.5, 1),
        "downscaled_rh_pred": half_even(F.greatest(F.lit(30.0), F.least(F.lit(98.0), 60.0 + F.col(rain) * 0.4)), 1)})
