"""District bulletin texts: forecast values stand after each label, observations before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainweave.functions import text as T
from rainweave.operators import quality as Q
from rainweave.operators.distributed import staged

# Row names as letters without what stands in brackets, with the lowest and highest value.
OPTIONAL = {
    "temp_max_c": ("maxtemp", -60.0, 65.0),
    "temp_min_c": ("mintemp", -60.0, 65.0),
    "relative_humidity_max_pct": ("maxrh", 0.0, 100.0),
    "relative_humidity_min_pct": ("minrh", 0.0, 100.0),
    "wind_speed_kmph": ("windspeed", 0.0, 300.0),
}
RAIN_NAME, CLOUD_NAME, FORECAST_NAME = "rainfall", "cloudcover", "weatherforecast"
SKIES = ("cloudy", "clear", "overcast")
DAYS = 5


def _lines(text: Column) -> Column:
    """Non-empty lines as structs: words, name (letters ahead of the last bracket, lower case), note (text of the last bracket), tail (words behind it)."""
    plain = F.regexp_replace(F.translate(text, "\u00a0\t\r", "  \n"), " +", " ")

    def taken_apart(line):
        behind = F.substring_index(line, ")", -1)
        inner = F.substring_index(F.substring_index(line, ")", -2), "(", -1)
        has = F.contains(line, F.lit(")"))
        head = F.when(has, F.left(line, F.length(line) - F.length(F.substring_index(line, "(", -1)))).otherwise(line)
        return F.struct(_words(line).alias("words"), F.lower(F.regexp_replace(head, "[^A-Za-z]", "")).alias("name"),
                        F.when(has, F.substring_index(inner, ")", 1)).alias("note"), F.when(has, _words(behind)).alias("tail"))

    return F.filter(F.transform(F.split(plain, "\n"), taken_apart), lambda x: F.size(x["words"]) > 0)


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def _first(lines: Column, wanted) -> Column:
    return F.get(F.filter(lines, wanted), F.lit(0))


def _dotted(words: Column) -> Column:
    """The first word that is a date with dots."""
    dates = F.array_compact(F.transform(words, lambda w: T.date(F.rtrim(w, F.lit(",.;")), "d.M.yyyy")))
    return F.get(dates, F.lit(0))


def _behind(words: Column, word: str) -> Column:
    """The DAYS words behind the first occurrence of a word, or NULL if it does not occur."""
    at = F.array_position(F.transform(words, F.lower), F.lit(word))
    return F.when(at > 0, F.slice(words, at.cast("int") + 1, DAYS))


def _day_numbers(words: Column) -> Column:
    """Five day numbers behind the word Date, else NULL."""
    days = F.transform(_behind(words, "date"), lambda w: F.when(F.length(w) <= 2, w.try_cast("int")))
    return F.when((F.size(days) == DAYS) & F.forall(days, lambda d: d.isNotNull()), days)


def _values(words: Column) -> Column:
    """Words as numbers, NULL for one that is none."""
    return F.transform(words, lambda w: F.when(F.translate(w, "0123456789", "").isin("", ".", "-", "-."), w.try_cast("double")))


def parse(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, issued_date, `days` (five structs) and `reasons`; each bulletin is parsed in its own row."""
    rows = staged(df.select(*key, text), {"__lines": _lines(F.col(text))}).drop(text)
    lines = F.col("__lines")
    names = {"__rain": RAIN_NAME, **{f"__{v}": n for v, (n, _, _) in OPTIONAL.items()}}
    heads = lambda w: F.lower(F.array_join(w, ""))
    named = lambda n: lambda x: (x["name"] == n) & x["tail"].isNotNull()
    dated = _first(lines, lambda x: (F.contains(heads(x["words"]), F.lit("meetingdated")) | F.contains(heads(x["words"]), F.lit("date:"))) & _dotted(x["words"]).isNotNull())
    rows = staged(rows, {
        "issued_date": _dotted(dated["words"]),
        "__start": _dotted(_words(_first(lines, lambda x: F.endswith(x["name"], F.lit(FORECAST_NAME)) & x["note"].isNotNull())["note"])),
        "__numbers": F.get(F.filter(F.transform(lines, lambda x: _day_numbers(x["words"])), lambda d: d.isNotNull()), F.lit(0)),
        "__words": _first(F.transform(lines, lambda x: F.when(F.contains(x["name"], F.lit(CLOUD_NAME)), _behind(x["words"], "cover"))), lambda w: w.isNotNull()),
        **{v: _values(_first(lines, named(n))["tail"]) for v, n in names.items()}})
    rows = staged(rows, {"__rain": F.transform("__rain", lambda x: F.when(x >= 0, x))})
    later = F.transform(F.sequence(F.lit(1), F.lit(DAYS)), lambda i: F.date_add("issued_date", i.cast("int")))
    dates = F.when(F.col("__numbers").isNotNull() & F.col("__start").isNotNull(), T.rolled_dates(F.col("__numbers"), F.col("__start"))).when(
        F.col("issued_date").isNotNull(), later)

    def incomplete(c):
        return F.coalesce((F.size(c) != DAYS) | F.exists(c, lambda t: t.isNull()), F.lit(False))

    cloudy = (F.size("__words") == DAYS) & F.forall("__words", lambda w: F.lower(w).isin(*SKIES))
    rows = staged(rows, {"__dates": dates})
    rules = {"No rainfall row": F.col("__rain").isNull(),
             "Rainfall without a value for each day": incomplete(F.col("__rain")),
             "No dates for the days": F.col("__dates").isNull() | F.exists("__dates", lambda d: d.isNull())}
    for v, (_, low, high) in OPTIONAL.items():
        c = F.col(f"__{v}")
        rules[f"Row without a value for each day: {v}"] = incomplete(c)
        rules[f"Value out of range: {v}"] = F.coalesce(
            F.exists(c, lambda t: ~t.between(low, high)), F.lit(False))
    parts = {"valid_date": F.col("__dates"), "rainfall_mm": F.col("__rain"), **{v: F.col(f"__{v}") for v in OPTIONAL}, "cloud_description": F.when(cloudy, F.col("__words"))}
    blank = {v: F.array_repeat(F.lit(None).cast(t), DAYS) for v, t in
             ((v, "date" if v == "valid_date" else "string" if v == "cloud_description" else "double") for v in parts)}
    rows = staged(rows, {f"__p_{v}": F.coalesce(c, blank[v]) for v, c in parts.items()})
    rows = staged(rows, {"days": F.slice(F.transform(F.arrays_zip(*[f"__p_{v}" for v in parts]), lambda z: F.struct(
        *[z[f"__p_{v}"].alias(v) for v in parts])), 1, DAYS)})
    for low, high in (("temp_min_c", "temp_max_c"), ("relative_humidity_min_pct", "relative_humidity_max_pct")):
        rules[f"Lowest value over the highest: {low}, {high}"] = F.coalesce(
            F.exists("days", lambda d: F.coalesce(d[low] > d[high], F.lit(False))), F.lit(False))
    return staged(rows, {"reasons": Q.reasons(rules)}).select(*key, "issued_date", "days", "reasons")


def records(parsed: DataFrame, key: list[str]) -> DataFrame:
    return parsed.where(F.size("reasons") == 0).select(*key, "issued_date", F.inline("days"))
