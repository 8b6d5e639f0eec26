"""Fail-closed data rules, duplicate classes, coverage, freshness and content digests."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from rainweave.functions.numeric import finite
from rainweave.operators.distributed import attach, require_empty

SAFE_ID = "^[a-zA-Z0-9_-]+$"


class Checked(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def reasons(rules: dict[str, Column]) -> Column:
    """Texts of the broken rules; a rule that evaluates to NULL counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(t)) for t, bad in rules.items()]))


def validate(df: DataFrame, rules: dict[str, Column], strict: bool = False) -> Checked:
    """Rows that break no rule, and the rest with their reasons."""
    rows = df.withColumn("reasons", reasons(rules))
    rejected = rows.where(F.size("reasons") > 0)
    if strict:
        require_empty(rejected, "Rejected row")
    return Checked(rows.where(F.size("reasons") == 0).drop("reasons"), rejected)


def weather_rules(rain="rainfall_mm", wind="wind_speed_kmph", cloud="cloud_cover_oktas", direction="wind_direction_deg",
                  rh_min="relative_humidity_min_pct", rh_max="relative_humidity_max_pct", t_min="temp_min_c",
                  t_max="temp_max_c", get=F.col) -> dict[str, Column]:
    """Physical ranges of a daily forecast record; `get` turns a name into a value."""
    c = get
    present = reduce(lambda a, b: a & b, [finite(c(x)) for x in (rain, wind, cloud, direction, rh_min, rh_max, t_min, t_max)])
    return {
        "Values that are no numbers": ~present,
        "Negative rainfall or wind speed": (c(rain) < 0) | (c(wind) < 0),
        "Cloud cover or wind direction out of range": ~(c(cloud).between(0, 8) & c(direction).between(0, 360)),
        "Humidity out of range or min above max": ~((c(rh_min) >= 0) & (c(rh_min) <= c(rh_max)) & (c(rh_max) <= 100)),
        "Minimum temperature above maximum": c(t_min) > c(t_max),
    }


def weather_warnings(issue="issue_date", valid="valid_date", rain="rainfall_mm", wind="wind_speed_kmph",
                     t_min="temp_min_c", t_max="temp_max_c", get=F.col) -> dict[str, Column]:
    c = get
    return {
        "unusual physical values require review": (c(rain) > 500) | (c(t_min) < -20) | (c(t_max) > 55) | (c(wind) > 150),
        "valid date is on or before issue date": c(valid) <= c(issue),
    }


def range_rules(ranges: dict[str, tuple[float, float]], ordered: list[tuple[str, str]] = ()) -> dict[str, Column]:
    """Optional values: a present value outside its range, or an inverted pair, breaks the rule."""
    out = {f"Value out of range: {k}": F.coalesce(~F.col(k).between(a, b), F.lit(False)) for k, (a, b) in ranges.items()}
    out.update({f"Lowest value over the highest: {a}, {b}": F.coalesce(F.col(a) > F.col(b), F.lit(False)) for a, b in ordered})
    return out


def series_validity(df: DataFrame, key: list[str], date: str, value: str) -> DataFrame:
    """Per key: dates are unique and values finite and not negative."""
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        ((F.count(F.lit(1)) == F.countDistinct(date)) & (F.count_if(~finite(value) | (F.col(value) < 0)) == 0)).alias("valid"))


def is_fresh(fetched, now, max_age_hours: float = 6.0) -> Column:
    age = (F.unix_micros(F.col(now).cast("timestamp") if isinstance(now, str) else now)
           - F.unix_micros(F.col(fetched).cast("timestamp")))
    return F.coalesce(age < max_age_hours * 3.6e9, F.lit(False))


def select_date(df: DataFrame, run: list[str], date: str, today: Column, requested: Column | None = None,
                strict: bool = False) -> DataFrame:
    """The requested date if the run has it; without a request today if present, else the first."""
    d = F.col(date)
    first = F.coalesce(F.max(F.when(d == today, d)), F.min(d))
    if requested is None:
        return df.groupBy(*run).agg(first.alias("selected"))
    out = df.groupBy(*run).agg(F.when(F.max(requested).isNull(), first)
                               .otherwise(F.max(F.when(d == requested, d))).alias("selected"))
    if strict:
        require_empty(out.where("selected IS NULL"), "Requested date unavailable")
    return out


def freshness(df: DataFrame, run: list[str], date: str, today: Column) -> DataFrame:
    return df.groupBy(*run).agg(F.when(F.max(date) < today, "archived").when(F.min(date) > today, "upcoming")
                                .otherwise("current").alias("freshness"))


def forecast_rows(df: DataFrame, mode: str, run_id, valid_date, block_id=None, strict: bool = False) -> DataFrame:
    """Served rows of one mode, run, date and optionally block; conditions reach partition pruning."""
    out = df.where((F.col("mode") == mode) & (F.col("run_id") == run_id) & (F.col("valid_date") == F.lit(valid_date).cast("date")))
    if block_id is not None:
        out = out.where(F.col("block_id") == block_id)
    if strict and out.isEmpty():
        raise ValueError("No linked forecasts for the selected source and date")
    return out


def classify_duplicates(df: DataFrame, key: list[str], values: list[str], file: str) -> DataFrame:
    """accepted: the first file of a key; duplicate: same values again; conflict: other values, also within that file."""
    rows = df.withColumn("__h", F.sha2(F.to_json(F.struct(*sorted(values))), 256))
    first = rows.groupBy(*key).agg(F.min(F.struct(F.col(file).alias("f"), F.col("__h").alias("h"))).alias("__first"))
    rows = attach(rows, first, key)
    status = (F.when(F.col("__h") != F.col("__first.h"), "conflict")
              .when(F.col(file) == F.col("__first.f"), "accepted").otherwise("duplicate"))
    return rows.withColumns({"status": status, "canonical_file": F.col("__first.f")}).drop("__h", "__first")


def provenance(classified: DataFrame, key: list[str], file: str) -> DataFrame:
    """Every source of an accepted record, its own file and its duplicates, one row each."""
    return classified.where(F.col("status") != "conflict").select(*key, "canonical_file", F.col(file).alias("source_file"), "status")


def coverage(records: DataFrame, expected: DataFrame, issue: str, group: str, member: str) -> DataFrame:
    """Each issue date of a group with every expected member and whether it is present."""
    wanted = records.select(issue, group).distinct().join(expected, group)
    have = records.select(issue, group, member).distinct().withColumn("available", F.lit(True))
    return wanted.join(have, [issue, group, member], "left").withColumn("available", F.coalesce("available", F.lit(False)))


def missing_members(expected: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    return expected.select(*key).distinct().join(present.select(*key).distinct(), key, "left_anti")


def canonical_json(columns: list[str]) -> Column:
    """JSON with keys in sorted order, NULLs kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def digest(df: DataFrame, groups: list[str], row: Column) -> DataFrame:
    """Order-free content digest of each group's rows (multiset): `rows` and `digest`.

    Five parts of every row's SHA-256, all its bits, are summed, so rows combine before the shuffle and
    no task ever holds a whole group.
    """
    sha = F.sha2(row, 256)
    parts = {f"p{i}": F.conv(F.substring("__sha", 1 + 13 * i, 13), 16, 10).cast("decimal(20,0)") for i in range(5)}
    rows = df.withColumn("__sha", sha).select(*groups, *[c.alias(n) for n, c in parts.items()])
    sums = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(n).alias(n) for n in parts])
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(n).cast("string") for n in parts])
    return sums.select(*groups, "rows", F.sha2(text, 256).alias("digest"))


def duplicate_profiles(df: DataFrame, member: str, row: Column) -> DataFrame:
    """Members whose whole series is identical share a `profile`; the dates are part of each row."""
    marks = digest(df, [member], row).withColumnRenamed("digest", "profile")
    size = marks.groupBy("profile").agg(F.count(F.lit(1)).alias("members"))
    return attach(marks, size, ["profile"]).select(member, "profile", "members")


def agrees_with_manifest(records: DataFrame, manifests: DataFrame, run: str, versions: list[str]) -> DataFrame:
    """Records whose versions are not those their run's manifest states."""
    return records.join(manifests.select(run, *versions).distinct(), [run, *versions], "left_anti")


def checksum_mismatches(records: DataFrame, manifests: DataFrame, run: str, row: Column, checksum: str) -> DataFrame:
    found = digest(records, [run], row)
    return manifests.join(found, run, "left").where(~F.col(checksum).eqNullSafe(F.col("digest"))).select(run, checksum, "digest")


def unlisted(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose label is not on the list; must be empty before training."""
    return df.where(~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))


def is_safe_id(c) -> Column:
    return F.coalesce(F.rlike(F.col(c) if isinstance(c, str) else c, F.lit(SAFE_ID)), F.lit(False))


def network_report(df: DataFrame, zone: str, member: str, group: str, target, required: list[str],
                   at_least: int = 20, target_at_least: int = 5) -> DataFrame:
    """One row: member counts, required zones that are missing, and whether the network suffices."""
    out = df.agg(F.countDistinct(member).alias("stations"),
                 F.countDistinct(F.when(F.col(group) == target, F.col(member))).alias("target_stations"),
                 F.array_sort(F.array_except(F.array(*[F.lit(z) for z in required]), F.collect_set(
                     F.when(F.col(zone).isin(required), F.col(zone))))).alias("missing_zones"))
    return out.withColumn("passed", (F.size("missing_zones") == 0) & (F.col("stations") >= at_least)
                          & (F.col("target_stations") >= target_at_least))


def filter_by_name(df: DataFrame, candidates: list[str], names: list[str]) -> DataFrame:
    """Keep rows matching the names in the first candidate column that has any match at all."""
    existing = [c for c in candidates if c in df.columns]
    if not existing:
        raise ValueError(f"None of the columns exists: {candidates}")
    wanted = [n.lower() for n in names]

    def hit(c):
        return F.coalesce(F.trim(F.lower(F.col(c).cast("string"))).isin(wanted), F.lit(False))

    pick = F.lit(None).cast("string")
    for c in reversed(existing):
        pick = F.when(F.bool_or(hit(c)), F.lit(c)).otherwise(pick)
    chosen = df.agg(pick.alias("c")).scalar()
    keep = F.lit(False)
    for c in existing:
        keep = keep | ((chosen == c) & hit(c))
    return df.where(keep)


def deterministic_sample(df: DataFrame, keep_all: Column, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """All target rows and n others, chosen by a hash of their key: the same on every run."""
    order = F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))), 256)
    rest = df.where(~keep_all).orderBy(order, *key).limit(n)
    return df.where(keep_all).unionByName(rest)


def replace_slice(existing: DataFrame, new: DataFrame, in_slice: Column, key: list[str], order: list[str]) -> DataFrame:
    """Drop the slice from the old rows and append the new ones, the first row per key."""
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")
    return existing.where(~F.coalesce(in_slice, F.lit(False))).unionByName(first.select(*existing.columns))
