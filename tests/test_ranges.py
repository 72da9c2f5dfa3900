"""Data sources of packed files: ranges of records, members, and what is left unread."""

import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from placeflow.sources import packed, ranges


def write_layer(folder, name, shapes, rows, deleted=(), index=True):
    """A .shp, .dbf and .shx of polygons (lists of rings; None: a null shape) with two text fields."""
    body, places, at = b"", b"", 100
    for k, rings in enumerate(shapes):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for ring in rings for p in ring]
            starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
            content = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        body += struct.pack(">2i", k + 1, len(content) // 2) + content
        places += struct.pack(">2i", at // 2, len(content) // 2)
        at += 8 + len(content)
    (folder / f"{name}.shp").write_bytes(bytes(100) + body)
    if index:
        (folder / f"{name}.shx").write_bytes(bytes(100) + places)
    fields = b"".join(n.ljust(11, b"\0") + b"C" + bytes(4) + bytes([8]) + bytes(15) for n in (b"NAME", b"CODE"))
    records = b"".join((b"*" if k in deleted else b" ") + b"".join(v.encode("latin-1").ljust(8) for v in row) for k, row in enumerate(rows))
    (folder / f"{name}.dbf").write_bytes(struct.pack("<B3BIHH", 3, 24, 1, 1, len(rows), 32 + 64 + 1, 17) + bytes(20) + fields + b"\x0d" + records)


def layer(n, seed):
    rng = random.Random(seed)
    shapes = [None if rng.random() < 0.1 else [[(rng.random(), rng.random()) for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 3))] for _ in range(n)]
    return shapes, [(f"n{k % 7}é", "" if k % 5 == 0 else str(k)) for k in range(n)]


def as_rows(df):
    return sorted(((r["NAME"], r["CODE"] or "", str([[tuple(p) for p in ring] for ring in r["rings"]])) for r in df.collect()))


def test_a_shapefile_is_read_by_ranges(spark, tmp_path):
    shapes, rows = layer(103, 1)
    write_layer(tmp_path, "a", shapes, rows, deleted={10, 49, 102})
    want = sorted((n, c, str(s or [])) for k, ((n, c), s) in enumerate(zip(rows, shapes, strict=True)) if k not in (10, 49, 102))
    for records in (1, 10, 50, 1000):
        got = packed.shapefile(spark, str(tmp_path), ["NAME", "CODE"], records=records)
        assert as_rows(got) == want
        assert got.rdd.getNumPartitions() == -(-103 // records)
    per_task = packed.shapefile(spark, str(tmp_path), ["CODE"], records=10).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 11 and max(r["count"] for r in per_task) == 10


def test_layers_without_index_and_without_rings(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    shapes, rows = layer(30, 2)
    write_layer(one, "a", shapes, rows, index=False)
    got = packed.shapefile(spark, str(one), ["NAME", "CODE"], records=10)
    assert got.rdd.getNumPartitions() == 1 and got.count() == 30
    write_layer(two, "b", shapes, rows)
    (two / "b.shp").write_bytes(b"not read")
    plain = packed.shapefile(spark, str(two), ["CODE", "OTHER"], records=10, rings=False)
    assert plain.columns == ["CODE", "OTHER"] and plain.where("CODE IS NULL").count() == 6 and plain.where("OTHER IS NULL").count() == 30
    every = packed.reader(spark, ranges.Shapefiles).load(f"file://{two}")
    assert every.columns == ["NAME", "CODE", "rings"]
    (tmp_path / "none").mkdir()
    assert packed.shapefile(spark, str(tmp_path / "none"), ["A"]).count() == 0


def test_members_of_a_zip_are_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "m.csv.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", "no table")
        for part in range(4):
            z.writestr(f"p{part}.csv", "id,unused,v\n" + "".join(f'{part * 100 + i},"a, b",{"" if i % 10 == 0 else i}\n' for i in range(100)))
    first = packed.zipped_csv(spark, str(tmp_path), "id int, v int, lacking string")
    assert first.rdd.getNumPartitions() == 1 and first.agg(F.sum("id"), F.count("v"), F.count("lacking")).first()[:] == (4950, 90, 0)
    every = packed.zipped_csv(spark, f"file://{tmp_path}", "id int, v int", members="all")
    assert every.rdd.getNumPartitions() == 4 and sorted(r["id"] for r in every.collect()) == list(range(400))
    with zipfile.ZipFile(tmp_path / "empty.csv.zip", "w") as z:
        z.writestr("readme.txt", "no table")
    with pytest.raises(Exception, match="no CSV"):
        packed.zipped_csv(spark, str(tmp_path), "id int").count()


def test_workbooks_by_sheet_name(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    for book in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{book}.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="x"/><sheet name="T" sheetId="2" r:id="y"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="x" Target="worksheets/one.xml"/><Relationship Id="y" Target="/xl/worksheets/two.xml"/></Relationships>')
            for member, n in (("one", 5), ("two", 300)):
                lines = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c><c r="AB{r}"><v>{r * 2}</v></c></row>' for r in range(1, n + 1))
                z.writestr(f"xl/worksheets/{member}.xml", f"<worksheet {main}><sheetData>{lines}</sheetData></worksheet>")
    got = packed.xlsx_rows(spark, str(tmp_path), 28, sheet="T", first_row=101)
    assert got.rdd.getNumPartitions() == 2
    rows = got.where("c0 % 100 = 0").select("row_idx", "c0", "c1", "c27").distinct().orderBy("row_idx").collect()
    assert [tuple(r) for r in rows] == [(200, "200", None, "400"), (300, "300", None, "600")] and got.count() == 400
    with pytest.raises(Exception, match="no sheet"):
        packed.xlsx_rows(spark, str(tmp_path), 2, sheet="U").count()
