"""Text clean-up, number and date parsing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Entities used on the scanned pages; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label(c) -> Column:
    """Comparison form of a table label: full-width letters and unit signs unified, no blanks, lower case."""
    wide = "".join(chr(i) for i in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F))
    x = F.translate(F.replace(_c(c), F.lit("℃"), F.lit("°C")), wide + "º", narrow + "°")
    return F.lower(F.regexp_replace(x, r"[\s\p{Z}]+", ""))


def title_name(c) -> Column:
    """Every letter that follows no letter is raised, so also those after a hyphen or an apostrophe."""
    words = F.regexp_extract_all(F.lower(F.trim(_c(c))), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(words, F.initcap), "")


def unescape(c) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), _c(c))


def number(c) -> Column:
    """Plain decimal text as a double, anything else NULL."""
    x = F.trim(_c(c))
    return F.when(F.rlike(x, F.lit(NUMBER)), x.try_cast("double"))


def date(c, *formats: str) -> Column:
    """First of the formats that parses, e.g. yyyy-MM-dd, d-M-yyyy, d.M.yyyy; else NULL."""
    x = F.trim(_c(c))

    def parsed(f):
        day = F.try_to_timestamp(x, F.lit(f)).cast("date")
        numbers = re.fullmatch(r"(d{1,2}|M{1,2}|y{4})([-./])(d{1,2}|M{1,2}|y{4})\2(d{1,2}|M{1,2}|y{4})", f)
        if not numbers:
            return day
        # the parser throws and catches an error for each text it refuses, so it gets only numbers with the format's marks between
        mark = numbers[2]
        likely = F.contains(x, F.lit(mark)) & (F.translate(x, "0123456789+-", "") == F.lit("" if mark == "-" else mark * 2))
        return F.when(likely, day)

    return F.coalesce(*[parsed(f) for f in formats])


def utf8(c) -> Column:
    """Bytes as text; invalid UTF-8 becomes empty text, which every parser rejects, so one bad file stops no other."""
    return F.coalesce(F.try_validate_utf8(_c(c).cast("string")), F.lit(""))


def extract(c, pattern: str, group: int = 1) -> Column:
    """Captured text, or NULL where the pattern does not occur."""
    return F.when(F.rlike(_c(c), F.lit(pattern)), F.regexp_extract(_c(c), pattern, group))


def urls(c, keywords: list[str] = ()) -> Column:
    """Distinct URLs of a text, optionally only those containing a keyword."""
    found = F.array_distinct(F.regexp_extract_all(_c(c), F.lit(r"https?://[^\s\"'<>\)]+"), F.lit(0)))
    if keywords:
        found = F.filter(found, lambda u: reduce(lambda a, b: a | b, [F.contains(F.lower(u), F.lit(k.lower())) for k in keywords]))
    return found


def synthesized_id(prefix: str, *parts: tuple) -> Column:
    """prefix_a_b with blanks trimmed; each part is (column, default for missing or empty)."""
    filled = [F.coalesce(F.nullif(F.trim(_c(c).cast("string")), F.lit("")), F.lit(d) if isinstance(d, str) else d.cast("string"))
              for c, d in parts]
    return F.concat_ws("_", F.lit(prefix), *filled)


def rolled_dates(labels: Column, start: Column) -> Column:
    """Dates of a day-number list: a day below its predecessor opens the next month."""
    zero = F.struct(F.dayofmonth(start).alias("prev"), F.lit(0).alias("months"), F.array().cast("array<date>").alias("dates"))

    def step(acc, day):
        months = acc["months"] + F.when(day < acc["prev"], 1).otherwise(0)
        first = F.add_months(F.trunc(start, "MM"), months)
        real = F.date_add(first, day - 1)
        real = F.when(F.month(real) == F.month(first), real)
        return F.struct(day.alias("prev"), months.alias("months"), F.concat(acc["dates"], F.array(real)).alias("dates"))

    return F.aggregate(labels, zero, step, lambda acc: acc["dates"])
