"""Rain grid files as a data source: planes are read by byte ranges, many tasks a file, and a scan names its planes and cells.

    scan(spark, folder, days=(10, 12), box=(0, 39, 0, 134))

A file is a row of float32 planes in either byte order. Missing cells tell the order: they read as -999 in one order only.
Ranges are options, not pushed filters: Spark 4.1 keeps what was pushed into a Python source for later queries on the same
DataFrame, which then lose rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rainweave.sources.grids import MISSING, SCHEMA, SHAPE

PLANES = 8  # of a task
HIGHEST = 5000.0


def _folder(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Planes(InputPartition):
    path: str
    name: str
    begin: int
    end: int


class GridReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.rows, self.cols = int(options.get("rows", SHAPE[0])), int(options.get("cols", SHAPE[1]))
        self.planes, self.strict = int(options.get("planes", PLANES)), options.get("strict", "true") == "true"
        self.days = tuple(int(x) for x in options.get("days", f"0,{1 << 31}").split(","))
        self.box = tuple(int(x) for x in options.get("box", f"0,{self.rows - 1},0,{self.cols - 1}").split(","))
        self.files = set(json.loads(options["files"])) if options.get("files") else None

    def partitions(self):
        from pyarrow import fs
        system, folder = _folder(self.path)
        info = system.get_file_info(folder)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(folder, recursive=True))
        plane, out = self.rows * self.cols * 4, []
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            if self.files is not None and f.base_name not in self.files:
                continue
            if not f.size or f.size % plane:
                out.append(Planes(f.path, f.base_name, -1, -1))
                continue
            begin, end = max(0, self.days[0]), min(f.size // plane, self.days[1] + 1)
            out += [Planes(f.path, f.base_name, k, min(k + self.planes, end)) for k in range(begin, end, self.planes)]
        return out or [Planes("", "", 0, 0)]

    def read(self, part: Planes):
        import numpy as np
        import pyarrow as pa
        size = self.rows * self.cols
        if part.begin == part.end >= 0:
            return
        values = None
        if part.begin >= 0:
            with _folder(self.path)[0].open_input_file(part.path) as file:
                raw = file.read_at((part.end - part.begin) * size * 4, part.begin * size * 4)
                values = self._decoded(raw)
                if values is None and len(raw) < file.size():  # the range alone does not tell
                    whole = self._decoded(file.read_at(file.size(), 0))
                    values = None if whole is None else whole[part.begin:part.end]
        if values is None:
            if self.strict:
                raise ValueError(f"Invalid or ambiguous rain grid: {part.name}")
            yield pa.RecordBatch.from_pylist([{"file": part.name}], pa.schema([("file", pa.string()), ("day", pa.int32()), ("iy", pa.int32()), ("ix", pa.int32()), ("rain_mm", pa.float64())]))
            return
        iy, ix = (a.ravel().astype(np.int32) for a in np.indices((self.rows, self.cols)))
        south, north, west, east = self.box
        cells = np.flatnonzero((iy >= south) & (iy <= north) & (ix >= west) & (ix <= east))
        for k, plane in enumerate(values):
            one = plane.ravel()[cells]
            yield pa.record_batch([pa.array([part.name] * len(cells)), pa.array(np.full(len(cells), part.begin + k, np.int32)), pa.array(iy[cells]), pa.array(ix[cells]),
                                   pa.array(one.astype(np.float64), mask=one == MISSING)], ["file", "day", "iy", "ix", "rain_mm"])

    def _decoded(self, raw: bytes):
        """The planes in the one byte order in which all cells are missing or plausible and some are missing; else None."""
        import numpy as np
        found = []
        for order in ("<f4", ">f4"):
            a = np.frombuffer(raw, order).reshape(-1, self.rows, self.cols)
            gone = a == MISSING
            with np.errstate(invalid="ignore"):
                good = np.isfinite(a) & (a >= 0) & (a <= HIGHEST)
            if gone.mean() > 0.01 and (gone | good).all():
                found.append(a)
        return found[0] if len(found) == 1 else None


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Rows (file, content) as files. They get their names when all tasks are done; those of a failed job are removed."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, rows):
        system, folder = _folder(self.path)
        system.create_dir(folder, recursive=True)
        moves = []
        for row in rows:
            part = f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(bytes(row["content"]))
            moves.append((part, f"{folder}/{row['file']}"))
        return Written(moves)

    def commit(self, messages):
        system, _ = _folder(self.path)
        for part, name in (m for w in messages if w for m in w.moves):
            system.move(part, name)

    def abort(self, messages):
        system, _ = _folder(self.path)
        for part, _ in (m for w in messages if w for m in w.moves):
            system.delete_file(part)


class RainGrids(DataSource):
    """Options: path, rows, cols, planes (of a task), days, box, files, strict (an invalid file is an error, else one row without a day)."""

    @classmethod
    def name(cls):
        return "rain_grids"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GridReader(self.options)

    def writer(self, schema, overwrite):
        return FileWriter(self.options)


def scan(spark: SparkSession, path: str, days: tuple[int, int] | None = None, box: tuple[int, int, int, int] | None = None, files: list[str] | None = None,
         **options) -> DataFrame:
    """file, day, iy, ix, rain_mm of the grid files below path.

    Only the planes from days[0] to days[1], the cells of box (first and last iy, first and last ix) and the named files are
    read, each end included.
    """
    spark.dataSource.register(RainGrids)
    chosen = {"days": days and ",".join(map(str, days)), "box": box and ",".join(map(str, box)), "files": None if files is None else json.dumps(files)}
    return spark.read.format("rain_grids").options(**{k: v for k, v in chosen.items() if v}, **options).load(path)


def write_files(files: DataFrame, path: str) -> None:
    """Writes rows (file, content) as files of these names."""
    files.sparkSession.dataSource.register(RainGrids)
    files.select("file", "content").write.format("rain_grids").mode("append").save(path)
