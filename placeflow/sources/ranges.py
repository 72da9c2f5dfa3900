"""Python data sources for packed files: tasks read ranges of records of shapefiles, members of zips and sheets of workbooks.

Files are opened through pyarrow, so a path may be local or of any store that pyarrow knows (s3, gs, hdfs, abfss), and seeking replaces
reading whole: a range of a shapefile costs its own bytes of .shx, .shp and .dbf, a member of a zip its own bytes and the zip's
directory. Columns that the reader's schema leaves out are not made; a schema without rings leaves .shp alone.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Rows that a reader hands on at once, records of a shapefile that a task reads, and bytes fetched at once.
ROWS, RECORDS, FETCH = 50_000, 20_000, 1 << 20
RINGS = "array<array<struct<x:double,y:double>>>"
_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][\w+.-]*:", path) else (fs.LocalFileSystem(), path)


def found(path: str, ending: str) -> list[str]:
    """The files below a folder, or the file itself, whose names match the regular expression; in order, by paths that open_at() takes."""
    store, inner = _at(path)
    info = store.get_file_info(inner)
    names = [inner] if info.type == fs.FileType.File else [f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File]
    head = path[: -len(inner)] if path.endswith(inner) else path.split(":", 1)[0] + "://"
    return sorted(head + n for n in names if re.search(ending, n.rsplit("/", 1)[-1]))


def open_at(path: str) -> io.BufferedReader:
    store, inner = _at(path)
    return io.BufferedReader(store.open_input_file(inner), FETCH)


@dataclass
class Part(InputPartition):
    """A file, what of it, and a range of its records."""

    path: str
    member: str | None = None
    start: int = 0
    stop: int | None = None


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        # a reader is sent to tasks, where options' own type need not be known
        self.options = {k: options[k] for k in options}

    def need(self, ending: str) -> list[str]:
        files = found(self.options["path"], ending)
        if not files:
            raise FileNotFoundError(f"nothing like {ending} in {self.options['path']}")
        return files


class _ShapeReader(_Reader):
    def partitions(self) -> list[Part]:
        each = int(self.options.get("records", RECORDS))
        out = []
        for path in found(self.options["path"], r"\.shp$"):
            base = path[:-4]
            with open_at(f"{base}.dbf") as table:
                count = struct.unpack("<I", table.read(8)[4:])[0]
            # without an index records can only be walked, so one task does
            some = bool(found(f"{base}.shx", r"\.shx$")) if _exists(f"{base}.shx") else "rings" not in self.names
            out += [Part(base, None, a, min(count, a + each)) for a in range(0, count, each)] if some else [Part(base, None, 0, count)]
        return out or [Part("", None, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.start == part.stop:
            return
        fields = [n for n in self.names if n != "rings"]
        rows = _dbf(part, fields, self.options.get("encoding", "latin-1"))
        shapes = _shapes(part) if "rings" in self.names else None
        held: list[tuple] = []
        for row in rows:
            rings = next(shapes) if shapes else None
            if row is not None:
                held.append((row, rings))
            if len(held) >= RECORDS:
                yield self._batch(fields, held)
                held = []
        if held:
            yield self._batch(fields, held)

    def _batch(self, fields: list[str], held: list[tuple]) -> pa.RecordBatch:
        column = {f: pa.array([r[i] for r, _ in held], pa.string()) for i, f in enumerate(fields)}
        if "rings" in self.names:
            column["rings"] = pa.array([x for _, x in held], _RINGS)
        return pa.RecordBatch.from_arrays([column[n] for n in self.names], self.names)


def _exists(path: str) -> bool:
    store, inner = _at(path)
    return store.get_file_info(inner).type == fs.FileType.File


def _dbf(part: Part, fields: list[str], encoding: str) -> Iterator[tuple | None]:
    """The fields of each record of the range, None for deleted ones; unknown fields and blanks are null."""
    with open_at(f"{part.path}.dbf") as table:
        head, size = struct.unpack("<HH", table.read(12)[8:])
        table.seek(32)
        columns, offset = {}, 1
        raw = table.read(head - 32)
        for at in range(0, len(raw) - 31, 32):
            if raw[at] == 0x0D:
                break
            columns[raw[at : at + 11].split(b"\0")[0].decode("ascii")] = (offset, raw[at + 16])
            offset += raw[at + 16]
        table.seek(head + part.start * size)
        for _ in range(part.start, part.stop):
            record = table.read(size)
            cells = (record[a : a + n].decode(encoding).strip() or None for a, n in (columns.get(f, (0, 0)) for f in fields))
            yield None if record[:1] == b"*" else tuple(cells)


def _shapes(part: Part) -> Iterator[list]:
    with open_at(f"{part.path}.shp") as file:
        file.seek(100)
        if part.start:
            with open_at(f"{part.path}.shx") as index:
                index.seek(100 + 8 * part.start)
                file.seek(2 * struct.unpack(">i", index.read(4))[0])
        # records follow one another, so one seek is enough
        for _ in range(part.start, part.stop):
            words = struct.unpack(">2i", file.read(8))[1]
            yield _polygon(file.read(2 * words))


def _polygon(raw: bytes) -> list[list[dict[str, float]]]:
    """Rings of a polygon record; shapes of other kinds and null shapes have none."""
    if struct.unpack_from("<i", raw)[0] not in (5, 15, 25):
        return []
    n_parts, n_points = struct.unpack_from("<2i", raw, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", raw, 44), n_points]
    xy = struct.unpack_from(f"<{2 * n_points}d", raw, 44 + 4 * n_parts)
    return [[{"x": xy[2 * i], "y": xy[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]


class _ZipReader(_Reader):
    def partitions(self) -> list[Part]:
        out = []
        for path in self.need(self.options.get("pattern", r"\.csv\.zip$")):
            with open_at(path) as file, zipfile.ZipFile(file) as packed:
                tables = [n for n in packed.namelist() if n.endswith(".csv")]
            if not tables:
                raise ValueError(f"no CSV in {path}")
            out += [Part(path, n) for n in (tables if self.options.get("members", "first") == "all" else tables[:1])]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in self.names])
        wanted = set(self.names)
        with open_at(part.path) as file, zipfile.ZipFile(file) as packed, packed.open(part.member) as text:
            for rows in pd.read_csv(text, dtype=str, keep_default_na=False, chunksize=ROWS, usecols=lambda c: c in wanted):
                clean = rows.reindex(columns=self.names).astype(object)
                yield pa.RecordBatch.from_pandas(clean.where(clean.notna() & (clean != ""), None), schema, preserve_index=False)


class _SheetReader(_Reader):
    def partitions(self) -> list[Part]:
        wanted = self.options.get("sheet")
        out = []
        for path in found(self.options["path"], r"\.xlsx$"):
            places = _sheet_places(path)
            chosen = [m for name, m in places if wanted in (None, name)]
            if not chosen:
                raise ValueError(f"no sheet {wanted} in {path}")
            out.append(Part(path, chosen[0], int(self.options.get("first_row", 1))))
        return out or [Part("", None, 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.path:
            return
        wanted = [int(n[1:]) if n not in ("sheet", "row_idx") else n for n in self.names]
        for number, cells in _sheet_rows(part):
            if number >= part.start:
                yield tuple(part.path if w == "sheet" else number if w == "row_idx" else cells.get(w) for w in wanted)


def _tag(name: str) -> str:
    return name.rsplit("}", 1)[-1]


def _sheet_places(path: str) -> list[tuple[str, str]]:
    """Names and members of the sheets of a workbook."""
    with open_at(path) as file, zipfile.ZipFile(file) as book:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
        sheets = [s for s in ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter() if _tag(s.tag) == "sheet"]
    out = []
    for sheet in sheets:
        target = targets[next(v for k, v in sheet.attrib.items() if _tag(k) == "id")]
        out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _number_of(letters: str) -> int:
    out = 0
    for c in letters:
        out = out * 26 + ord(c) - 64
    return out - 1


def _sheet_rows(part: Part) -> Iterator[tuple[int, dict[int, str]]]:
    """Row numbers and cells by column number, as text, while the sheet streams by."""
    with open_at(part.path) as file, zipfile.ZipFile(file) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, item in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                if _tag(item.tag) == "si":
                    shared.append("".join(t.text or "" for t in item.iter() if _tag(t.tag) == "t"))
                    item.clear()
        number, above = 0, []
        for event, node in ElementTree.iterparse(book.open(part.member), ("start", "end")):
            if event == "start":
                above.append(node)
                continue
            above.pop()
            if _tag(node.tag) != "row":
                continue
            number = int(node.get("r") or number + 1)
            cells: dict[int, str] = {}
            for k, cell in enumerate(c for c in node if _tag(c.tag) == "c"):
                letters = re.match("[A-Z]*", cell.get("r") or "")[0]
                value = next((v.text for v in cell if _tag(v.tag) == "v"), None)
                if cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter() if _tag(t.tag) == "t")
                elif cell.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                if value is not None:
                    cells[_number_of(letters) if letters else k] = value
            yield number, cells
            above[-1].remove(node)  # rows that have passed are let go


class Shapefiles(DataSource):
    """Polygons of the shapefiles below path: text fields by name and rings. Options: encoding, records (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "shapefiles"

    def schema(self) -> str:
        path = next(iter(found(self.options["path"], r"\.dbf$")), None)
        if path is None:
            raise FileNotFoundError(f"no .dbf in {self.options['path']}")
        with open_at(path) as table:
            head = struct.unpack("<H", table.read(10)[8:])[0]
            table.seek(32)
            raw = table.read(head - 32)
        names = [raw[at : at + 11].split(b"\0")[0].decode("ascii") for at in range(0, len(raw) - 31, 32)]
        return ", ".join([*(f"`{n}` string" for n in names), f"rings {RINGS}"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ShapeReader(schema, self.options)


class ZippedCsv(DataSource):
    """CSV members of the zips below path, as text by the names of a given schema. Options: pattern (regular expression), members (first, all)."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ZipReader(schema, self.options)


class Sheets(DataSource):
    """A sheet of each workbook below path: sheet (the file), row_idx and cells c0, c1, ... as text. Options: columns, sheet (a name), first_row."""

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return ", ".join(["sheet string, row_idx long", *(f"c{i} string" for i in range(int(self.options["columns"])))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SheetReader(schema, self.options)


SOURCES = (Shapefiles, ZippedCsv, Sheets)
