"""Web page scans: realised-rain fragments and document links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainweave.functions import text as T
from rainweave.operators.distributed import staged

OBJECT = "title string, id string, color string, info string, balloonText string"


def _objects(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, pos, o, parts: the map's district objects in order; parts are (name, value) pairs of the balloon's lines.

    An object begins at its title and ends with the first closing brace; one that is not JSON is left out.
    """
    pieces = F.slice(F.split(html, '"title"'), 2, 1_000_000)
    found = pages.select(page, F.posexplode(pieces).alias("pos", "piece"))
    rows = staged(found, {"o": F.from_json(F.concat(F.lit('{"title"'), F.substring_index("piece", "}", 1), F.lit("}")), OBJECT)}).where("o.balloonText is not null")
    shown = F.split(F.regexp_replace(T.unescape(F.col("o.balloonText")), "<[^>]*>", "\n"), "\n")
    named = F.filter(shown, lambda line: F.contains(line, F.lit(":")))
    parts = F.transform(named, lambda line: F.struct(F.lower(F.trim(F.substring_index(line, ":", 1))).alias("name"),
                                                     F.trim(F.substring(line, F.instr(line, ":") + 1, 1_000_000)).alias("value")))
    return staged(rows, {"parts": parts}).select(page, "pos", "o", "parts")


def _part(name: str) -> Column:
    return F.get(F.filter("parts", lambda p: p["name"] == name), F.lit(0))["value"]


def _millimetres(name: str) -> Column:
    value = _part(name)
    return F.when(F.contains(F.lower(value), F.lit("mm")), T.number(F.substring_index(F.lower(value), "mm", 1)))


def realized_rain(pages: DataFrame, page: str, html: str) -> DataFrame:
    """First complete observation per page and district; one without amount or date does not count."""
    rows = _objects(pages, page, html).select(
        page, "pos", F.upper(F.trim("o.title")).alias("district"), _millimetres("actual").alias("rainfall_mm"),
        T.date(_part("date"), "yyyy-MM-dd").alias("observed_date"), _millimetres("normal").alias("normal_mm"), F.nullif(_part("departure"), F.lit("")).alias("departure"))
    good = rows.where(F.col("rainfall_mm").isNotNull() & F.col("observed_date").isNotNull())
    fields = F.struct("rainfall_mm", "observed_date", "normal_mm", "departure")
    return good.groupBy(page, "district").agg(F.min_by(fields, "pos").alias("r")).select(page, "district", "r.*")


def district_rain(pages: DataFrame, page: str, html: str) -> DataFrame:
    """Every district object of a page with id and colour; absent numbers are 0. The last object of a title wins."""
    change = _part("departure")
    change = F.when((change != "") & (F.translate(change, "+-0123456789%", "") == ""), change)
    rows = _objects(pages, page, html).where("o.id is not null and o.color is not null").select(
        page, "pos", F.col("o.title").alias("district_name"), F.col("o.id").alias("district_id"), F.col("o.color").alias("color"),
        F.coalesce(change, F.col("o.info")).alias("departure"), _part("date").alias("date"),
        F.coalesce(_millimetres("actual"), F.lit(0.0)).alias("rainfall_mm"), F.coalesce(_millimetres("normal"), F.lit(0.0)).alias("normal_rainfall_mm"))
    fields = [c for c in rows.columns if c not in (page, "pos")]
    last = rows.groupBy(page, F.upper("district_name").alias("key")).agg(F.max_by(F.struct(*fields), "pos").alias("r"))
    return last.select(page, "r.*")


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute URL of a link found on the page at `base`."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^/]*//[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    joined = F.when(F.startswith(link, F.lit("/")), link).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), link))
    tail = F.regexp_extract(joined, r"([?#].*)$", 1)
    parts = F.split(F.regexp_replace(joined, r"[?#].*$", ""), "/")
    empty = F.array().cast("array<string>")

    def step(acc, part):
        return (F.when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
                .when(part == ".", acc).otherwise(F.concat(acc, F.array(part))))

    normal = F.array_join(F.aggregate(parts, empty, step), "/")
    page = F.concat(site, path)
    return (F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), link)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(F.startswith(link, F.lit("?")), F.concat(page, link))
            .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, r"#.*$", ""), link))
            .otherwise(F.concat(site, normal, tail)))


def links(pages: DataFrame, page: str, url: str, html: str, hosts: list[str] | None = None, scheme: str | None = "https",
          path_contains: list[str] = ()) -> DataFrame:
    """Link targets of every page that pass the allow-list, in order, without the page itself."""
    found = F.regexp_extract_all(html, F.lit("(?i)(?:href|src)=[\"']([^\"']+)[\"']"), F.lit(1))
    rows = pages.select(page, url, F.posexplode(found).alias("pos", "link"))
    rows = staged(rows, {"target": resolve_url(F.col(url), T.unescape("link"))}).where(F.col("target") != F.col(url))
    if scheme:
        rows = rows.where(F.startswith(F.lower("target"), F.lit(f"{scheme}://")))
    if hosts is not None:
        host = F.lower(F.regexp_extract("target", r"^[^/]*//(?:[^/?#@]*@)?([^/?#:]*)", 1))
        rows = rows.where(host.isin([h.lower() for h in hosts]))
    if path_contains:
        path = F.lower(F.regexp_extract("target", r"^[^/]*//[^/?#]*([^?#]*)", 1))
        keep = F.lit(False)
        for p in path_contains:
            keep = keep | F.contains(path, F.lit(p.lower()))
        rows = rows.where(keep)
    return rows.select(page, "pos", "target")
