"""Rule tables: crops, stages, alerts, advice, hazards and dominant factors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rainweave.operators.advisory_texts import TEXTS

# Block-name fragments per crop, first matching group wins.
CROP_GROUPS = [
    ("Grape", ["niphad", "dindori", "nashik", "sinnar", "chandvad", "kalwan"]),
    ("Onion", ["malegaon", "deola", "yeola", "nandgaon", "baglan"]),
    ("Bajra", ["igatpuri", "trimbak", "peint", "peth", "surgana"]),
    ("Sugarcane", ["bhor", "velhe", "mulshi", "mawal", "ambegaon", "junnar", "khed"]),
    ("Onion", ["baramati", "indapur", "daund", "purandhar", "shirur"]),
    ("Grape", ["haveli", "pune"]),
]
DEFAULT_CROP = "Grape"

# Growth stages and their months in listed order; stages overlap.
STAGES = {
    "Grape": [("Foundation_Pruning", [4, 5]), ("Forward_Pruning", [9, 10]), ("Shooting_Bud_Burst", [10, 11]),
              ("Flowering_Berry_Set", [11, 12]), ("Berry_Development", [12, 1, 2]), ("Harvesting", [2, 3, 4])],
    "Onion": [("Nursery", [6, 7, 10, 11]), ("Transplanting", [7, 8, 12, 1]),
              ("Vegetative_Bulb_Formation", [8, 9, 1, 2]), ("Harvesting_Curing", [9, 10, 3, 4])],
    "Bajra": [("Sowing_Emergence", [6, 7]), ("Vegetative_Tillering", [7, 8]), ("Grain_Filling", [8, 9]),
              ("Maturity_Harvest", [9, 10])],
    "Sugarcane": [("Germination_Tillering", [2, 3, 4, 5]), ("Grand_Growth", [6, 7, 8, 9]),
                  ("Ripening_Maturation", [10, 11, 12]), ("Harvesting_Crushing", [1, 2, 3])],
    "Soybean": [("Sowing_Emergence", [6, 7]), ("Vegetative_Flowering", [7, 8]), ("Pod_Development", [8, 9, 10]),
                ("Maturity_Harvest", [9, 10, 11])],
    "Tomato": [("Transplanting_Vegetative", [6, 7, 10, 11]), ("Flowering_Fruit_Set", [7, 8, 11, 12]),
               ("Harvesting", [8, 9, 1, 2, 3])],
}
# Crop names as they are shown.
MARATHI_CROP = {"Grape": "द्राक्ष (Grape)", "Onion": "कांदा (Onion / Kanda)", "Bajra": "बाजरी (Pearl Millet / Bajra)",
                "Sugarcane": "ऊस (Sugarcane / Us)", "Soybean": "सोयाबीन (Soybean)", "Tomato": "टोमॅटो (Tomato)"}

# The wet branch applies from this rain, or from this humidity where one is given.
WET_FROM = {"Grape": (20.0, 80.0), "Onion": (15.0, None), "Sugarcane": (20.0, None), "Soybean": (15.0, None),
            "Tomato": (15.0, 80.0), "Bajra": (10.0, None)}

# Hazard limits per crop as (crop, hazard, {measure: (from, to)}).
HAZARDS = [
    ("Grape", "downy_mildew", {"rh": (80.0, None), "temp": (20.0, 30.0), "rain": (5.0, None)}),
    ("Grape", "powdery_mildew", {"rh": (40.0, 75.0), "temp": (22.0, 32.0)}),
    ("Grape", "berry_cracking", {"rain": (25.0, None)}),
    ("Onion", "purple_blotch", {"rh": (75.0, None), "temp": (20.0, 28.0), "rain": (10.0, None)}),
    ("Onion", "thrips_infestation", {"dry_days": (5.0, None), "temp": (30.0, None)}),
    ("Sugarcane", "white_grub", {"rain": (15.0, None), "temp": (22.0, 32.0)}),
    ("Sugarcane", "water_logging", {"rain": (35.0, None)}),
    ("Soybean", "soybean_rust", {"rh": (85.0, None), "temp": (20.0, 28.0), "rain": (10.0, None)}),
    ("Soybean", "spodoptera_litura", {"temp": (25.0, 35.0)}),
    ("Tomato", "early_blight", {"rh": (80.0, None), "temp": (20.0, 30.0), "rain": (10.0, None)}),
]
# Alert levels as they are shown.
ALERT_MARATHI = {"NORMAL": "सर्वसाधारण (NORMAL)", "WARNING": "दक्षता इशारा (ORANGE WARNING - HEAVY RAIN)",
                 "ADVISORY": "सल्ला (YELLOW ADVISORY)"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(text, groups: list[tuple], default) -> Column:
    """Value of the first group one of whose fragments occurs in the lower-cased text."""
    low = F.lower(_c(text).cast("string"))
    out = default if isinstance(default, Column) else F.lit(default)
    for value, fragments in reversed(groups):
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in fragments])
        out = F.when(F.coalesce(hit, F.lit(False)), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def dominant_crop(block) -> Column:
    return first_match(block, CROP_GROUPS, DEFAULT_CROP)


def growth_stage(crop, month) -> Column:
    """First listed stage of the month, else the crop's last stage."""
    out = F.lit("Vegetative")
    for name, stages in STAGES.items():
        inner = F.lit(stages[-1][0])
        for stage, months in reversed(stages):
            inner = F.when(_c(month).isin(months), stage).otherwise(inner)
        out = F.when(_c(crop) == name, inner).otherwise(out)
    return out


def alert_level(rain, crop, rh) -> Column:
    r, c, h = _c(rain), _c(crop), _c(rh)
    return (F.when(r >= 64.5, "WARNING")
            .when((r >= 20) | ((c == "Grape") & (h >= 85)), "ADVISORY").otherwise("NORMAL"))


def branch(crop, rain, rh) -> Column:
    """wet or dry by the crop's limits; an unlisted crop follows the last rule."""
    r, h = _c(rain), _c(rh)

    def wet(limits):
        by_rain, by_rh = limits
        return (r >= by_rain) | (h >= by_rh) if by_rh is not None else r >= by_rain

    out = wet(WET_FROM["Bajra"])
    for name, limits in WET_FROM.items():
        out = F.when(_c(crop) == name, wet(limits)).otherwise(out)
    return F.when(out, "wet").otherwise("dry")


def advice(crop, which) -> Column:
    """Struct of the six advice texts of a crop and branch."""
    known = F.when(_c(crop).isin(list(WET_FROM)), _c(crop)).otherwise("Bajra")
    entries = []
    for (name, side), texts in TEXTS.items():
        entries += [F.lit(f"{name}:{side}"), F.struct(*[F.lit(t).alias(k) for k, t in texts.items()])]
    return F.element_at(F.create_map(*entries), F.concat(known, F.lit(":"), _c(which)))


def fixed(c, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", F.bround(_c(c), digits))


def anomaly_phrase(rain, parent, language: str = "en") -> Column:
    """Higher or lower than the parent mean beyond 3 mm, else consistent with it."""
    diff = F.bround(_c(rain) - _c(parent), 1)
    size, mean = fixed(F.abs(diff)), fixed(parent)
    if language == "mr":
        head = F.concat(F.lit("तालुका सरासरीपेक्षा ("), mean, F.lit(" मिमी) "), size)
        return (F.when(diff > 3, F.concat(head, F.lit(" मिमी अधिक"))).when(diff < -3, F.concat(head, F.lit(" मिमी कमी")))
                .otherwise(F.concat(F.lit("तालुका सरासरीच्या जवळपास ("), mean, F.lit(" मिमी)"))))
    tail = F.concat(F.lit(" than the block-level average ("), mean, F.lit(" mm)"))
    return (F.when(diff > 3, F.concat(size, F.lit(" mm HIGHER"), tail)).when(diff < -3, F.concat(size, F.lit(" mm LOWER"), tail))
            .otherwise(F.concat(F.lit("consistent with the block-level average ("), mean, F.lit(" mm)"))))


def valid_until(issue, days: int = 5) -> Column:
    return F.date_add(_c(issue), days)


def bulletins(df: DataFrame, forecast_date: str) -> DataFrame:
    """Structured advisory rows from downscaled records; absent fields take their defaults."""
    from rainweave.operators.distributed import staged

    def get(name, default):
        if name in df.columns:
            return F.coalesce(F.col(name), default)
        return default

    rain = get("downscaled_rain_pred", F.lit(0.0))
    village = get("panchayat_name", F.lit("Local Panchayat"))
    rows = staged(df, {
        "rain": rain, "parent": get("block_rain_mean", rain), "tmax": get("downscaled_tmax_pred", F.lit(30.0)),
        "tmin": get("downscaled_tmin_pred", F.lit(21.0)), "rh": get("downscaled_rh_pred", F.lit(75.0)),
        "low": get("rain_ci_lower_80", F.greatest(F.lit(0.0), rain - 4)), "high": get("rain_ci_upper_80", rain + 5),
        "factor": get("dominant_factor", F.lit("Topographic relief")), "name": village, "village": get("village_name", village),
        "block": get("block_name", F.lit("Nashik")), "district": get("district_name", F.lit("Nashik")),
        "confidence": get("confidence_level", F.lit("HIGH")), "issue_date": F.col(forecast_date).cast("date")})
    rows = staged(rows, {"dominant_crop": dominant_crop("block")})
    rows = staged(rows, {"crop_stage": growth_stage("dominant_crop", F.month("issue_date")),
                         "alert_level": alert_level("rain", "dominant_crop", "rh"),
                         "a": advice("dominant_crop", branch("dominant_crop", "rain", "rh"))})
    stage_text = F.replace("crop_stage", F.lit("_"), F.lit(" "))
    marathi = F.element_at(F.create_map(*[F.lit(x) for kv in MARATHI_CROP.items() for x in kv]), F.col("dominant_crop"))
    whole = F.format_string("%.0f", F.bround("rh", 0))
    return rows.select(
        *[c for c in ("panchayat_id",) if c in df.columns], F.col("name").alias("panchayat_name"),
        F.col("village").alias("village_name"), F.col("block").alias("block_name"), F.col("district").alias("district_name"),
        F.concat(F.lit("GRAMIN KRISHI MAUSAM SEWA (GKMS) — DAMU KVK "), F.upper("district")).alias("bulletin_header"),
        "issue_date", valid_until("issue_date").alias("valid_until"), "dominant_crop", marathi.alias("marathi_crop_name"), "crop_stage",
        F.struct(F.col("rain").alias("rainfall_mm"), F.col("parent").alias("block_mean_rainfall_mm"), F.col("low").alias("ci_lower_80"),
                 F.col("high").alias("ci_upper_80"), F.col("tmax").alias("temp_max_c"), F.col("tmin").alias("temp_min_c"),
                 F.col("rh").alias("rh_pct"), F.col("confidence").alias("confidence_level"),
                 F.col("factor").alias("dominant_factor")).alias("downscaled_weather"),
        # The sentences of a bulletin.
        F.concat(F.lit("Expected 24-hr Rainfall: "), fixed("rain"), F.lit(" mm (Confidence Band 80%: "), fixed("low"), F.lit(" - "),
                 fixed("high"), F.lit(" mm). This estimate is "), anomaly_phrase("rain", "parent"), F.lit(", driven primarily by "),
                 F.col("factor"), F.lit(". Max Temp: "), fixed("tmax"), F.lit("°C, Min Temp: "), fixed("tmin"),
                 F.lit("°C, Relative Humidity: "), whole, F.lit("%.")).alias("weather_summary_en"),
        F.concat(F.lit("अपेक्षित २४ तासांचा पाऊस: "), fixed("rain"), F.lit(" मिमी (८०% विश्वासार्हता मर्यादा: "), fixed("low"),
                 F.lit(" ते "), fixed("high"), F.lit(" मिमी). हा अंदाज "), anomaly_phrase("rain", "parent", "mr"), F.lit(", मुख्यत्वे "),
                 F.col("factor"), F.lit(" मुळे. कमाल तापमान: "), fixed("tmax"), F.lit("°से, किमान तापमान: "), fixed("tmin"),
                 F.lit("°से, हवेतील आर्द्रता: "), whole, F.lit("%.")).alias("weather_summary_mr"),
        F.concat(F.lit("Crop: "), F.col("dominant_crop"), F.lit(" ("), stage_text, F.lit("). "), F.col("a.pest_en"), F.lit(" "),
                 F.col("a.spray_en"), F.lit(" "), F.col("a.irrigation_en")).alias("agromet_advisory_en"),
        F.concat(F.lit("पीक: "), marathi, F.lit(" ("), stage_text, F.lit("). "), F.col("a.pest_mr"), F.lit(" "),
                 F.col("a.spray_mr"), F.lit(" "), F.col("a.irrigation_mr")).alias("agromet_advisory_mr"),
        F.col("a.spray_en").alias("spray_recommendation_en"), F.col("a.spray_mr").alias("spray_recommendation_mr"),
        F.col("a.irrigation_en").alias("irrigation_advice_en"), F.col("a.irrigation_mr").alias("irrigation_advice_mr"),
        F.col("a.pest_en").alias("pest_disease_warning_en"), F.col("a.pest_mr").alias("pest_disease_warning_mr"), "alert_level",
        F.element_at(F.create_map(*[F.lit(x) for kv in ALERT_MARATHI.items() for x in kv]), F.col("alert_level")).alias("alert_level_mr"),
        F.lit("DRAFT").alias("status"))


# Messages of the served advisory.
SERVED = {
    "heavy": "Forecast rain may interrupt spraying; review field drainage and the spray window.",
    "some": "Check local rainfall and soil moisture before irrigation or spraying.",
    "none": "No rain is forecast by the parent source; check soil moisture before deciding irrigation.",
    "humid": "High source humidity: inspect crops for moisture-related disease symptoms.",
    "unknown": "Humidity is unavailable; no humidity-dependent advisory was generated.",
}


def served_text(rain, rh_max) -> Column:
    r, h = _c(rain), _c(rh_max)
    first = F.when(r >= 20, SERVED["heavy"]).when(r > 0, SERVED["some"]).otherwise(SERVED["none"])
    return F.concat_ws(" ", F.array_compact(F.array(first, F.when(h >= 90, SERVED["humid"]), F.when(h.isNull(), SERVED["unknown"]))))


def served_advisories(df: DataFrame, rain: str, rh_max: str, freshness: str, identity: list[str]) -> DataFrame:
    """Text, historical flag and an id hashed from the row's identity and text."""
    out = df.withColumns({"text": served_text(rain, rh_max), "historical": F.col(freshness) == "archived",
                          "rule_version": F.lit("weather-preview-v1"), "advisory_status": F.lit("preview_only")})
    body = F.to_json(F.struct(*sorted([*identity, "text", "historical", "rule_version"])), {"ignoreNullFields": "false"})
    return out.withColumn("advisory_id", F.substring(F.sha2(body, 256), 1, 24))


def explanation(df: DataFrame, key: str, value, strict: bool = True) -> DataFrame:
    """The one served row of a key; an absent key is an error."""
    out = df.where(F.col(key) == value)
    if strict and out.isEmpty():
        raise ValueError(f"Unavailable for this run, date or filter: {value}")
    return out


def dominant_factor(elevation="elevation_mean", slope="slope_mean", coast="dist_to_coast_km", crop="lulc_crop_pct",
                    water="dist_to_water_km") -> Column:
    c = F.col
    return (F.when((c(elevation) > 600) | (c(slope) > 8), "Orographic Sahyadri Elevation Gradient")
            .when(c(coast) < 60, "Coastal Maritime Proximity").when(c(crop) > 65, "Horticultural Orchard Microclimate")
            .when(c(water) < 10, "Riparian Godavari River Valley").otherwise("Rain-Shadow Plateau Topography"))


def hazards(crop, measures: dict[str, str]) -> Column:
    """Names of the crop's hazards whose limits all hold; a hazard with an unavailable measure does not count."""
    found = []
    for name, hazard, limits in HAZARDS:
        if any(m not in measures for m in limits):
            continue
        ok = _c(crop) == name
        for m, (low, high) in limits.items():
            x = _c(measures[m])
            ok = ok & (x >= low) if high is None else ok & x.between(low, high)
        found.append(F.when(ok, F.lit(hazard)))
    return F.array_compact(F.array(*found))
