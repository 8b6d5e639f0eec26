import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainweave.operators import geography as G, quality as Q
from rainweave.sources import block_tables as B, bulletins, grids, pages

ISSUED, DAYS = dt.date(2026, 7, 3), 5
ROWS = {  # label: values of the days, printed summary
    "Rainfall (mm)": ([0.4, 12.5, 30.2, 8.0, 2.9], 54.0), "Max. Temp. (℃)": ([29.5, 28.0, 26.5, 27.0, 29.0], 28.0),
    "Min. Temp. (℃)": ([22.0, 21.5, 21.0, 21.5, 22.0], 21.6), "Cloud Cover (octa)": ([5, 6, 8, 7, 4], "- - -"), "RH Max. (%)": ([91, 93, 97, 95, 92], 93.6),
    "RH Min. (%)": ([66, 70, 81, 74, 68], 71.8), "Windspeed(kmph)": ([6.0, 9.5, 14.0, 11.5, 7.5], 9.7), "Wind Dir.(Deg)": ([240, 255, 270, 262, 248], "- - -")}


def _table():
    days = [f"{ISSUED + dt.timedelta(days=k + 1):%d-%m-%Y}" for k in range(DAYS)]
    body = [[label, *map(str, values), str(total)] for label, (values, total) in ROWS.items()]
    return [[f"IGATPURI : Block Forecast issued on {ISSUED:%d-%m-%Y}"] + [""] * 6, ["Date", *days, "Total / Average"], *body]


TABLE = _table()
AT = {row[0]: k for k, row in enumerate(TABLE)}
FIRST = TABLE[1][1]
# one change per rule: (row, column, new cell)
BAD = {
    "no title": (0, 0, "IGATPURI : Block Forecast"), "other issue date": (0, 0, f"IGATPURI : Block Forecast issued on {ISSUED - dt.timedelta(days=1):%d-%m-%Y}"),
    "other block": (0, 0, f"YEOLA : Block Forecast issued on {ISSUED:%d-%m-%Y}"), "no total": (1, 6, "Sum"), "repeated day": (1, 3, TABLE[1][2]),
    "days out of order": (1, 5, FIRST), "no day": (1, 4, "soon"), "no row": (AT["RH Max. (%)"], 0, "Humidity"), "row twice": (AT["RH Max. (%)"], 0, "RH Min. (%)"),
    "no number": (AT["Rainfall (mm)"], 2, "trace"), "infinite": (AT["Windspeed(kmph)"], 5, "inf"), "empty": (AT["Cloud Cover (octa)"], 1, ""),
    "negative rain": (AT["Rainfall (mm)"], 3, "-0.1"), "negative wind": (AT["Windspeed(kmph)"], 4, "-2"), "cloud over eight": (AT["Cloud Cover (octa)"], 3, "8.5"),
    "direction over a circle": (AT["Wind Dir.(Deg)"], 2, "360.5"), "humidity over a hundred": (AT["RH Max. (%)"], 3, "100.4"), "humidity turned round": (AT["RH Min. (%)"], 4, "95.5"),
    "temperatures turned round": (AT["Min. Temp. (℃)"], 5, "29.1")}
NAME = f"Nashik_Igatpuri_{ISSUED}.csv"


def text(edit=None, end="\r\n", bom="﻿"):
    rows = [list(r) for r in TABLE]
    if edit:
        rows[edit[0]][edit[1]] = edit[2]
    return bom + end.join(",".join(r) for r in rows)


def index(spark):
    blocks = spark.createDataFrame([("b:igatpuri", "Igatpuri"), ("b:niphad", "Niphad"), ("b:chandwad", "Chandwad"), ("b:peth", "Peth"),
                                    ("b:yeola", "Yeola"), ("b:trimbak", "Trimbak")], "block_id string, block_name string")
    aliases = spark.createDataFrame(list(G.BLOCK_ALIASES.items()), "alias string, canonical string")
    return G.names_index(blocks, "block_id", "block_name", aliases)


def parsed(spark, files):
    df = spark.createDataFrame(files, "file string, content string").withColumn("sha256", F.sha2("content", 256))
    return B.resolve_blocks(B.parse(df), index(spark))


def test_golden_values_and_formats(spark):
    files = [(NAME, text()), (f"Nashik_Igatpuri_{ISSUED} - Sheet1.csv", text(end="\n", bom="")), (f"Nashik_Igatpuri_{ISSUED}.CSV", text().replace("℃", "°C"))]
    rows = B.records(parsed(spark, files), "block_id").orderBy("file", "valid_date").collect()
    assert len(rows) == 15
    one = [r for r in rows if r.file == NAME]
    names = list(B.LABELS)
    for name, (values, _) in zip(names, ROWS.values()):
        assert [r[name] for r in one] == values
    assert [r.valid_date for r in one] == [ISSUED + dt.timedelta(days=k + 1) for k in range(DAYS)]


def test_malformed_files_reject_alone(spark):
    files = [(NAME, text(b)) for b in BAD.values()]
    files += [(f"Nashik_Igatpuri_{ISSUED} - Sheet2.csv", text()), (f"Nashik_Central_{ISSUED}.csv", text()), (f"Pune_Igatpuri_{ISSUED}.csv", text()),
              (NAME, text() + "\r\nRainfall (mm),1,2,3,4,5,15"), (NAME, ""), (NAME, text())]
    sizes = [r.n for r in parsed(spark, files).select(F.size("reasons").alias("n"), "file").collect()]
    assert len(sizes) == len(files) and sum(n == 0 for n in sizes) == 1


def test_summary_is_only_a_warning(spark):
    p = parsed(spark, [(NAME, text((2, 6, "999")))]).first()
    assert p.reasons == [] and any("summary" in w for w in p.warnings)
    kinds = {r.severity for r in B.report(parsed(spark, [(NAME, text((2, 6, "999")))])).collect()}
    assert kinds == {"accepted", "warning"}


def test_aliases(spark):
    names = spark.createDataFrame([("Chandvad",), ("peint",), (" Yevla ",), ("Trimbakeshwar",), ("Central",)], "n string")
    got = [r.block_name for r in G.resolve(names, "n", index(spark)).orderBy("n").collect()]
    assert sorted(x for x in got if x) == ["Chandwad", "Peth", "Trimbak", "Yeola"] and got.count(None) == 1
    with pytest.raises(ValueError):
        G.resolve(names, "n", index(spark), strict=True)


def test_duplicates_and_conflicts(spark):
    rows = [("a.csv", "x", 1.0), ("b.csv", "x", 1.0), ("c.csv", "x", 2.0), ("d.csv", "y", 1.0)]
    df = spark.createDataFrame(rows, "file string, k string, v double")
    got = {r.file: r.status for r in Q.classify_duplicates(df, ["k"], ["v"], "file").collect()}
    assert got == {"a.csv": "accepted", "b.csv": "duplicate", "c.csv": "conflict", "d.csv": "accepted"}


SEEN = [3, 1, 0, 7, 2, 6, 4]  # a week observed, ahead of each label
COMING = {"Rainfall (mm)": [12, 4, 0, 28, 6], "Max. Temp. (0C)": [31, 30, 29, 27, 28], "Min. Temp. (0C)": [22, 21, 21, 20, 22],
          "Max. RH (%)": [84, 82, 90, 95, 88], "Min. RH (%)": [61, 60, 72, 83, 70], "Wind Speed (km/hr)": [9, 10, 15, 18, 13]}


def bulletin(start, coming=COMING, **other):
    """A bulletin of five days from a date on, written from values; `other` replaces what stands behind a label."""
    days = [start + dt.timedelta(days=k) for k in range(DAYS)]
    join = lambda values: " ".join(map(str, values))
    lines = [f"committee meeting dated {start - dt.timedelta(days=1):%d.%m.%Y} Place: Nashik", f"Weather Forecast ({start:%d.%m.%Y} to {days[-1]:%d.%m.%Y})",
             f"{join(f'{start - dt.timedelta(days=7 - k):%d}' for k in range(7))} Date {join(f'{d:%d}' for d in days)}"]
    lines += [f"{join(SEEN)} {label} {other.get(label, join(values))}" for label, values in coming.items()]
    return "\n".join([*lines, "Clear Clear Cloudy Clear Clear Clear Clear Cloud Cover Overcast Clear Cloudy Cloudy Clear"]) + "\n"


def test_bulletins(spark):
    start, turn = dt.date(2026, 7, 6), dt.date(2026, 7, 29)
    rh, rain = "Max. RH (%)", "Rainfall (mm)"
    texts = [bulletin(start), bulletin(turn, {rain: [1, 0, 2, 0, 3]})]
    texts += [bulletin(start, **{rh: v}) for v in ("84 82 90 95", "84 82 90 95 100.5", "84 high 90 95 88", "none 82 90 95 88")]
    texts += [bulletin(start, **{rain: v}) for v in ("12 4 0 28", "12 4 0 28 6 1", "12 4 -1 28 6", "12 4 0 1e2 6")]
    texts += [bulletin(start, **{"Min. Temp. (0C)": "22 21 30 20 22"}), bulletin(start).replace("Rainfall", "Rain"), "no bulletin", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    p = {r.id: r for r in bulletins.parse(df, ["id"]).collect()}
    assert p[0].reasons == [] and p[0].issued_date == start - dt.timedelta(days=1)
    names = ["rainfall_mm", "temp_max_c", "temp_min_c", "relative_humidity_max_pct", "relative_humidity_min_pct", "wind_speed_kmph"]
    for name, values in zip(names, COMING.values()):
        assert [d[name] for d in p[0].days] == values
    assert [d.cloud_description for d in p[0].days] == ["Overcast", "Clear", "Cloudy", "Cloudy", "Clear"]
    assert [d.rainfall_mm for d in p[1].days] == [1, 0, 2, 0, 3] and [d.temp_max_c for d in p[1].days] == [None] * 5
    assert [d.valid_date for d in p[1].days] == [turn + dt.timedelta(days=k) for k in range(DAYS)]  # into the next month
    assert all(p[i].reasons for i in range(2, len(texts)))
    assert bulletins.records(bulletins.parse(df, ["id"]), ["id"]).count() == 10


def test_realised_rain_fragment(spark):
    shown = "<b>SANGLI<\\/b> <p>Date : 2026-07-04<\\/br>Departure : +12%<\\/br>Actual : 3.5 mm<\\/br>Normal : 3.1 mm &amp; more<\\/p>"
    raw = 'var areas = [{"title": "Sangli", "id": "7", "color": "#123456", "info": "x", "balloonText": "' + shown + '"}, {"title": "Satara", "id": "8", "balloonText": "Actual : -"}, {"title": broken}]'
    df = spark.createDataFrame([("u", raw), ("none", "<p>no map</p>"), ("null", None)], "page string, html string")
    (row,) = pages.realized_rain(df, "page", "html").collect()
    assert (row.page, row.district, row.rainfall_mm, row.observed_date, row.normal_mm, row.departure) == ("u", "SANGLI", 3.5, dt.date(2026, 7, 4), 3.1, "+12%")
    (row,) = pages.district_rain(df, "page", "html").collect()
    assert (row.district_id, row.color, row.departure, row.date, row.rainfall_mm, row.normal_rainfall_mm) == ("7", "#123456", "+12%", "2026-07-04", 3.5, 3.1)


def test_links(spark):
    html = '<a href="/a/../b/x.pdf?q=1&amp;r=2"></a><a href="https://other.org/y.pdf"></a><img src="z.pdf"><a href="//m.host.in/w.PDF">'
    df = spark.createDataFrame([("p", "https://host.in/d/e.html", html)], "page string, url string, html string")
    got = [r.target for r in pages.links(df, "page", "url", "html", ["host.in", "m.host.in"], path_contains=[".pdf"]).orderBy("pos").collect()]
    assert got == ["https://host.in/b/x.pdf?q=1&r=2", "https://host.in/d/z.pdf", "https://m.host.in/w.PDF"]


@pytest.mark.parametrize("order", ["<f4", ">f4"])
def test_binary_grid_either_byte_order(spark, order):
    a = np.full((2, 129, 135), -999, order)
    a[:, 30:100, 40:120] = 12.5
    df = spark.createDataFrame([("f", bytearray(a.tobytes()))], "file string, content binary")
    out = grids.decode(df, days=2)
    r = out.groupBy("day").agg(F.count("*").alias("n"), F.count("rain_mm").alias("m"), F.max("rain_mm").alias("x")).collect()
    assert {(x.day, x.n, x.m, x.x) for x in r} == {(0, 17415, 5600, 12.5), (1, 17415, 5600, 12.5)}
    assert grids.decode(df, days=3, strict=False).first().day is None


def test_incremental_import_is_idempotent(spark, tmp_path):
    from rainweave.streaming.imports import arrivals, import_stream
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()

    def run():
        import_stream(arrivals(spark, str(folder)), out, mark).awaitTermination()
        return spark.read.parquet(f"{out}/records").count()

    (folder / NAME).write_text(text(), encoding="utf-8")
    assert run() == 5
    (folder / "Nashik_Igatpuri_2026-07-03 - Sheet1.csv").write_text(text(), encoding="utf-8")  # same bytes again
    (folder / "Nashik_Niphad_2026-07-03.csv").write_text(text().replace("IGATPURI", "NIPHAD").replace("30.2", "8.2"), encoding="utf-8")
    (folder / "Nashik_Igatpuri_2026-07-04.csv").write_bytes(b"\xff\xfe bad bytes")
    assert run() == 10
    assert B.read(spark, str(folder)).count() == 4
    assert B.parse(B.read(spark, str(folder))).where("size(reasons) = 0").count() == 3


def test_incremental_import_judges_like_the_folder_import(spark, tmp_path):
    from rainweave.operators.geography import names_index
    from rainweave.streaming.imports import import_stream
    units = spark.createDataFrame([(1, "Igatpuri"), (2, "Niphad")], "block_id int, block_name string")
    index, out = names_index(units, "block_id", "block_name"), str(tmp_path / "out")
    schema = "file string, content string, sha256 string"

    def run(mark, **files):
        rows = [(n.replace("_x", "").replace("__", "-") + ".csv", c, __import__("hashlib").sha256(c.encode()).hexdigest()) for n, c in files.items()]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / f"in-{mark}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in-{mark}"))
        import_stream(stream, out, str(tmp_path / mark), index).awaitTermination()
        status = {r.file: r.status for r in spark.read.parquet(f"{out}/files").collect()}
        return status, spark.read.parquet(f"{out}/records").count()

    good, niphad = text(), text().replace("IGATPURI", "NIPHAD")
    status, days = run("a", **{"Nashik_Igatpuri_2026__07__03": good, "Nashik_Yeola_2026__07__03": text().replace("IGATPURI", "YEOLA"),
                               "Nashik_Niphad_2026__07__03": niphad + "\n"})
    assert status == {"Nashik_Igatpuri_2026-07-03.csv": "accepted", "Nashik_Yeola_2026-07-03.csv": "rejected", "Nashik_Niphad_2026-07-03.csv": "accepted"}
    assert days == 10
    # a second checkpoint onto the same output: same values are a duplicate, others a conflict, nothing earlier is lost
    status, days = run("b", **{"Nashik_Igatpuri_2026__07__03": good + "\n", "Nashik_Niphad_2026__07__03_x": niphad.replace("30.2", "8.2")})
    rows = spark.read.parquet(f"{out}/files").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in rows} == {"accepted": 2, "rejected": 1, "duplicate": 1, "conflict": 1} and days == 10
    # everything again through a third checkpoint adds nothing
    status, days = run("c", **{"Nashik_Igatpuri_2026__07__03": good, "Nashik_Niphad_2026__07__03": niphad + "\n"})
    assert days == 10 and spark.read.parquet(f"{out}/files").count() == 5
    # a checkpoint that began from an earlier output goes on without it
    status, days = run("b", **{"Nashik_Niphad_2026__07__03_xx": niphad.replace("30.2", "8.2"), "Nashik_Igatpuri_2026__07__03": good + "\n\n"})
    rows = spark.read.parquet(f"{out}/files").groupBy("status").count().collect()
    assert {r.status: r["count"] for r in rows} == {"accepted": 2, "rejected": 1, "duplicate": 2, "conflict": 1} and days == 10


def test_a_batch_is_replayed_after_a_failure_and_reads_no_earlier_file(spark, tmp_path, monkeypatch):
    from rainweave.streaming import imports
    out, schema = str(tmp_path / "out"), "file string, content string, sha256 string"
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def run(name, content):
        if name:
            rows = [(name, content, __import__("hashlib").sha256(content.encode()).hexdigest())]
            spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        imports.import_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, str(tmp_path / "mark")).awaitTermination()

    run(NAME, text())
    whole = imports.B.records
    with monkeypatch.context() as m:
        m.setattr(imports.B, "records", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run("Nashik_Niphad_2026-07-03.csv", text().replace("IGATPURI", "NIPHAD"))
    assert imports.B.records is whole and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    run(None, None)  # the same batch again
    assert spark.read.parquet(f"{out}/records").count() == 10
    assert {r.status: r["count"] for r in spark.read.parquet(f"{out}/files").groupBy("status").count().collect()} == {"accepted": 2}
    before = {str(p) for p in (tmp_path / "out").rglob("*.parquet")}
    for p in before:
        open(p, "wb").write(b"no parquet file")
    run(NAME, text().replace("30.2", "8.2"))
    new = sorted({str(p.parent) for p in (tmp_path / "out" / "files").rglob("*.parquet")} - {p.rsplit("/", 1)[0] for p in before})
    assert [tuple(r) for r in spark.read.parquet(*new).select("status", "canonical_file").collect()] == [("conflict", NAME)]


def test_files_of_one_bucket_are_judged_each_by_itself(spark, tmp_path, monkeypatch):
    from rainweave.streaming import imports
    monkeypatch.setattr(imports, "BUCKETS", 1)
    out, schema = str(tmp_path / "out"), "file string, content string, sha256 string"

    def run(**files):
        rows = [(n.replace("__", "-") + ".csv", c, __import__("hashlib").sha256(c.encode()).hexdigest()) for n, c in files.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        imports.import_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, str(tmp_path / "mark")).awaitTermination()
        return sorted((r.file, r.status, r.canonical_file) for r in spark.read.parquet(f"{out}/files").collect())

    igatpuri, niphad = "Nashik_Igatpuri_2026-07-03.csv", "Nashik_Niphad_2026-07-03.csv"
    other = text().replace("IGATPURI", "NIPHAD")
    told = run(**{"Nashik_Igatpuri_2026__07__03_": text(), "Nashik_Igatpuri_2026__07__03": text(), "Nashik_Niphad_2026__07__03": other})
    assert told == [(igatpuri, "accepted", igatpuri), (niphad, "accepted", niphad)]
    told = run(**{"Nashik_Igatpuri_2026__07__03": text() + "\n", "Nashik_Niphad_2026__07__03": other.replace("30.2", "8.2"), "Nashik_Niphad_2026__07__03_": other})
    assert told == [(igatpuri, "accepted", igatpuri), (igatpuri, "duplicate", igatpuri), (niphad, "accepted", niphad), (niphad, "conflict", niphad)]


def test_classified_files_are_parsed_once(spark):
    from rainweave.plans import block_import
    parsed = B.parse(spark.createDataFrame([(NAME, text(), "a"), ("Nashik_x", text(), "b")], "file string, content string, sha256 string"))
    rows = block_import.classify(parsed, ["title_block", "issue_date"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert sorted((r.file, r.status, r.canonical_file) for r in rows.collect()) == [(NAME, "accepted", NAME), ("Nashik_x", "rejected", None)]


def test_cells_with_and_without_quotes(spark):
    lines = ['a,,b', '', 'a,"b,c",d', '"x ""y""",z', 'plain', ',']
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select(B._split(F.col("x")).alias("c")).collect()
    assert [r.c for r in rows] == [["a", "", "b"], [""], ["a", "b,c", "d"], ['x "y"', "z"], ["plain"], ["", ""]]


def test_only_likely_dates_reach_the_parser(spark):
    from rainweave.functions import text as T
    texts = ["1.2.2020", "01.02.2020", "1.2.20", "1.2.+12020", "1.2.-2020", "-1.2.2020", "1-2-2020", "1--2-2020", "to", "", " 1.2.2020 ", "..", "1.2.2020.",
             "2020-01-05", "2020/01/05", "31.02.2020", None, "1.2.2020x", "-2020-01-05"]
    formats = ["yyyy-MM-dd", "d-M-yyyy", "d.M.yyyy", "yyyy/MM/dd", "dd.MM.yyyy"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    plain = [F.try_to_timestamp(F.trim("x"), F.lit(f)).cast("date").cast("string") for f in formats]
    assert df.select(*[T.date("x", f).cast("string") for f in formats]).collect() == df.select(*plain).collect()
    assert "CASE WHEN" in df.select(T.date("x", "d.M.yyyy"))._jdf.queryExecution().optimizedPlan().toString()


def test_files_without_a_name_or_hash_in_a_bucket(spark, tmp_path, monkeypatch):
    from rainweave.streaming import imports
    monkeypatch.setattr(imports, "BUCKETS", 1)
    schema, at = "file string, content string, sha256 string", str(tmp_path / "in")
    rows = [(None, "x", "x"), (None, text(), "a"), (NAME, text(), "a"), (None, "y", "y"), (None, None, None), ("z.csv", "z", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(at)
    imports.import_stream(spark.readStream.schema(schema).parquet(at), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = {(r.file, r.sha256, r.status) for r in spark.read.parquet(str(tmp_path / "out" / "files")).collect()}
    assert got == {(None, "x", "rejected"), (NAME, "a", "accepted"), (None, "y", "rejected"), ("z.csv", None, "rejected")}
