"""Readers on files that the tests write, and operators against plain restatements on small tables."""

import random
import struct
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from placeflow.functions import ratios
from placeflow.operators import census, delimitation, flows, fragments, matching, rules, zones
from placeflow.sources import adapters, files, packed
from placeflow.streaming.presence import presence_by_window


def test_points_in_box(spark, tmp_path):
    rows = [(("p", x, y), x, y, h) for x, y, h in [(1.0, 1.0, ["a", "b"]), (5.0, 1.0, ["a"]), (2.0, 2.0, []), (2.0, 1.5, None)]]
    points = spark.createDataFrame([(r[1], r[2], r[3]) for r in rows], "x double, y double, h array<string>")
    points.select(F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin")).alias("bbox"), F.struct(F.col("h").alias("hierarchy")).alias("taxonomy"), F.lit("t").alias("theme")).write.partitionBy("theme").parquet(f"{tmp_path}/p")
    got = files.points_in_box(spark, f"{tmp_path}/p", (0.0, 0.0, 3.0, 3.0))
    assert [(r["bbox"]["xmin"], r["theme"]) for r in got.collect()] == [(1.0, "t")]
    assert "GreaterThanOrEqual(bbox.xmin" in got._jdf.queryExecution().toString()


def test_csv_and_tracks(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("a", "b", 3), ("c", "d", 4)], "x string, y string, z int").coalesce(1), f"{tmp_path}/c")
    got = files.named_csv(spark, f"{tmp_path}/c", "x string, y string, z int", ["origin", "dest", "flow"])
    assert sorted(map(tuple, got.collect())) == [("a", "b", 3), ("c", "d", 4)] and got.columns == ["origin", "dest", "flow"]
    some = files.od_csv(spark, f"{tmp_path}/c", "x string, y string, z int", ["o", "d", "n"], "n > 3", ["o", "n"])
    assert [tuple(r) for r in some.collect()] == [("c", 4)]
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1.5" lon="2.5"><time>2024-01-01T00:00:00Z</time></trkpt><trkpt lat="3" lon="4"/></trkseg></trk></gpx>')
    tracks = files.tracks(spark, f"{tmp_path}/t.gpx")
    assert sorted(map(tuple, tracks.collect())) == [(1.5, 2.5, "2024-01-01T00:00:00Z"), (3.0, 4.0, None)]
    assert files.timed_share(tracks).first()["timed"] == 0.5


def test_zipped_csv(spark, tmp_path):
    for month, text in (("01", "citycode,population\n40305,5\n7,\n"), ("02", "citycode,extra,population\n9,x,2.5\n")):
        (tmp_path / month).mkdir()
        with zipfile.ZipFile(tmp_path / month / "m.csv.zip", "w") as z:
            z.writestr("m.csv", text)
    got = packed.recode(packed.zipped_csv(spark, str(tmp_path), "citycode int, population double"), "citycode", {40305: 40231})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(40231, 5.0), (7, None), (9, 2.5)], key=str)
    with pytest.raises(FileNotFoundError):
        packed.zipped_csv(spark, str(tmp_path / "01"), "a int", "*.none")


def write_xlsx(path, rows):
    """Rows of cells, as shared strings, numbers and inline strings; None leaves a gap."""
    strings = []
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, str) and c % 2 == 0:
                strings.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
            elif isinstance(v, str):
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif v is not None:
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="T1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{s}</t></si>' for s in strings)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")


def test_census_sheet(spark, tmp_path):
    """Totals add up, keys are unique, cities are not municipalities, shares lie in 0 to 1, zeros are single settlements."""
    head = [["title"], [None], ["x"], ["y"]]
    body = [
        ["РЕПУБЛИКА", "с", 60, 25, 15, 12, 8],
        ["Београдски регион", "с", 60, 25, 15, 12, 8],
        ["Београдска област", "с", 30, 10, 10, 6, 4], ["Београдска област", "м", 1, 1, 0, 0, 0],
        ["Палилула", "с", 20, 10, 4, 4, 2], ["Палилула", "м", 9, 9, 0, 0, 0], ["Градска", "с", 9, 9, 0, 0, 0], ["Остала", "с", 1, 1, 0, 0, 0],
        ["Врачар", "с", 10, None, 6, 2, 2], ["Градска", "с", 10, 0, 6, 2, 2], ["Остала", "м", 1, 0, 0, 0, 0],
        ["Нишавска област", "ж", 1, 1, 1, 1, 1], ["Град Ниш", "с", 30, 15, 5, 6, 4],
        ["Палилула", "с", 30, 15, 5, 6, 4], ["Остала", "с", 30, 15, 5, 6, 4], ["Лоша", "с", "-", 1, 1, 1, 1], ["Градска", "с", 1, 1, 1, 1, 1],
    ]
    write_xlsx(tmp_path / "s.xlsx", head + body)
    sheet = packed.xlsx_rows(spark, str(tmp_path), 7, first_row=5)
    every = census.read_territories(sheet, "all")
    rows = census.add_self_containment(census.read_territories(sheet)).orderBy("row_idx").collect()
    assert [(r["name"], r["area"], r["city"], r["single_settlement"]) for r in rows] == [("Палилула", "Београдска област", None, False), ("Врачар", "Београдска област", None, True), ("Палилула", "Нишавска област", "Град Ниш", False)]
    assert all(r["difference"] == 0 for r in census.reconcile(every).collect())
    assert len({r["key"] for r in rows}) == 3 and all(0 <= r["rbsc"] <= 1 for r in rows)
    assert {r["name"] for r in rows if r["rbsc"] == 0} == {r["name"] for r in rows if r["single_settlement"]} == {"Врачар"}
    assert {r["level"] for r in every.collect()} == {"country_or_macroregion", "region", "area", "city_aggregate", "municipality"}


def test_polygon_files(spark, tmp_path):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    records = b""
    for k, dx in enumerate((0.0, 1.0)):
        content = struct.pack("<i4d2i", 5, dx, 0.0, dx + 1, 1.0, 1, 5) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", x + dx, y) for x, y in square)
        records += struct.pack(">2i", k + 1, len(content) // 2) + content
    (tmp_path / "m.shp").write_bytes(bytes(100) + records)
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8, 0]) + bytes(14)
    (tmp_path / "m.dbf").write_bytes(struct.pack("<B3BIHH", 3, 24, 1, 1, 2, 32 + 32 + 1, 9) + bytes(20) + field + b"\x0d" + b" ARAN?EL " + b" B       ")
    got = packed.shapefile(spark, str(tmp_path), ["NAME"])
    assert sorted(r["NAME"] for r in got.collect()) == ["ARAN?EL", "B"]
    near = fragments.adjacency(got.select(F.col("NAME").alias("unit"), packed.corners(F.col("rings")).alias("corners")))
    assert sorted(map(tuple, near.collect())) == [("ARAN?EL", "B"), ("B", "ARAN?EL")]
    (tmp_path / "g.geojson").write_text('{"type":"FeatureCollection","features":[{"properties":{"code":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}},{"properties":{"code":"b"},"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[5,5]]],[[[7,7],[8,7],[7,7]]]]}}]}')
    shapes = {r["code"]: r["rings"] for r in packed.geojson_polygons(spark, f"{tmp_path}/g.geojson", ["code"]).collect()}
    assert len(shapes["a"]) == 1 and len(shapes["b"]) == 2 and tuple(shapes["b"][1][0]) == (7.0, 7.0)


def test_presence_of_a_stream(spark, sf, tmp_path):
    """A stream of points gives the counts of a batch."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", (F.col("user_id") % 5).alias("zone"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = presence_by_window(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "zone")
    query = stream.writeStream.format("memory").queryName("presence").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("presence").collect()))
    batch = presence_by_window(events.withColumn("ts", F.col("ts").cast("timestamp")), "zone")
    assert got == sorted(map(tuple, batch.collect())) and len(got) > 100


def test_columns_present(spark):
    rows = spark.createDataFrame([], "a int, t struct<h array<struct<d string>>>")
    assert packed.columns_present(rows, ["a", "t.h.d", "t.x", "b"]) == {"a": True, "t.h.d": True, "t.x": False, "b": False}


def test_adapters_reject(spark):
    with pytest.raises(KeyError):
        adapters.standardize_od(spark.range(1), "FR")
    with pytest.raises(ValueError):
        adapters.standardize_od(spark.range(1), "NL")


def test_flows_without_codes(spark):
    od = flows.prepare_od(spark.createDataFrame([("a", " b ", "2"), ("a", None, "5"), (None, "b", "5"), ("a", "b", "x"), ("a", "b", "-1"), ("a", "b", "1")], "o string, d string, w string"), "o", "d", "w")
    assert [tuple(r) for r in od.collect()] == [("a", "b", 3.0)]


def test_home_workers_and_null_destinations(spark):
    """Areas of a hand-made table: a null destination is a trip that leaves, special codes don't count."""
    rows = [("w", 80.0, "A", "A"), ("w", 20.0, "A", "B"), ("w", 50.0, "B", "B"), ("w", 40.0, "B", None), ("w", 9.0, "B", "OD0000001"), (None, 5.0, "A", "A")]
    got = {r["fa_code"]: r for r in flows.self_containment(spark.createDataFrame(rows, "motive string, trip_count double, o_fa_code string, d_fa_code string"), ["OD0000001"]).collect()}
    assert got["A"]["RBSC"] == 0.8 and got["B"]["departures_res"] == 90 and abs(got["B"]["DBSC"] - 50 / 70) < 1e-12


def test_single_rows(spark):
    one = spark.range(1).select(ratios.rank_quartile(F.lit(1), F.lit(1)).alias("q")).first()["q"]
    assert one == 1
    line = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i) for i in range(5)], "x double, y double, z double")
    got = zones.correlations(line, "x", "y", "z").first()
    assert got["r_xy"] == 1.0 and got["r_xy_z"] is None
    table = spark.createDataFrame([(i, float(-i)) for i in range(37)], "k int, v double")
    assert sorted((r["k"], r["rank"], r["rows"]) for r in zones.ranked(table.repartition(5), "v", "k").collect()) == [(i, 37 - i, 37) for i in range(37)]


def plain_stats(od, assign):
    res, job, inside = defaultdict(float), defaultdict(float), defaultdict(float)
    for (o, d), f in od.items():
        if o in assign and d in assign:
            res[assign[o]] += f
            job[assign[d]] += f
            inside[assign[o]] += f * (assign[o] == assign[d])
    return {a: (res[a], min(inside[a] / res[a] if res[a] else 0.0, inside[a] / job[a] if job[a] else 0.0)) for a in {*res, *job}}


def plain_deficits(stats, rule):
    out = {}
    for a, (size, sc) in stats.items():
        need = rule.sc_small + min(1.0, max(0.0, (size - rule.small) / (rule.big - rule.small))) * (rule.sc_big - rule.sc_small)
        if size < rule.small:
            out[a] = 1 + (rule.small - size) / rule.small
        elif sc < need:
            out[a] = need - sc
    return out


def random_od(seed, units, areas):
    rng = random.Random(seed)
    names = [f"u{i:02}" for i in range(units)]
    assign = {u: f"a{i % areas}" for i, u in enumerate(names)}
    od = {(o, d): float(rng.randrange(1, 60) * (4 if assign[o] == assign[d] else 1)) for o in names for d in names if rng.random() < 0.25}
    return od, assign


def frames(spark, od, assign):
    return spark.createDataFrame([(o, d, f) for (o, d), f in od.items()], "origin string, dest string, flow double"), spark.createDataFrame(list(assign.items()), "unit string, fua string")


def test_merging_by_the_rule(spark):
    od, assign = random_od(1, 18, 6)
    assign["lonely"] = "z"
    rule = rules.Rule(250.0, 2000.0, 0.6, 0.5)
    got = {r["unit"]: r["fua"] for r in rules.enforce_by_merging(*frames(spark, od, assign), rule).collect()}
    now, apart = dict(assign), set()
    while True:
        stats = plain_stats(od, now) | {a: (0.0, 0.0) for a in set(now.values()) - set(plain_stats(od, now))}
        bad = plain_deficits({a: s for a, s in stats.items() if a not in apart}, rule)
        if not bad:
            break
        worst = min(bad, key=lambda a: (-bad[a], a))
        links = defaultdict(float)
        for (o, d), f in od.items():
            a, b = now.get(o), now.get(d)
            if worst in (a, b) and a != b and None not in (a, b):
                links[b if a == worst else a] += f
        links = {a: f for a, f in links.items() if a not in apart and f > 0}
        if not links:
            apart.add(worst)
            continue
        to = min(links, key=lambda a: (-links[a], a))
        now = {u: to if a == worst else a for u, a in now.items()}
    assert got == now and len(set(now.values())) < 6


def test_dissolving_by_the_rule(spark):
    od, assign = random_od(2, 20, 5)
    rule = rules.Rule(500.0, 3000.0, 0.42, 0.35)
    got = {r["unit"]: r["fua"] for r in rules.enforce_by_dissolving(*frames(spark, od, assign), rule, 20).collect()}
    now = dict(assign)
    for _ in range(20):
        stats = plain_stats(od, now)
        bad = plain_deficits(stats, rule)
        if not bad:
            break
        worst, moved = min(bad, key=lambda a: (-bad[a], a)), {}
        for u in [u for u, a in now.items() if a == worst]:
            links = defaultdict(float)
            for (o, d), f in od.items():
                for x, y in ((o, d), (d, o)):
                    if x == u and now[y] in set(stats) - set(bad):
                        links[now[y]] += f
            if links:
                moved[u] = max(links, key=lambda a: (links[a], a))
        if not moved:
            break
        now |= moved
    assert got == now and now != assign


def test_delimitation_by_hand(spark):
    """Two cores that exchange much become one; d follows c, which follows them; e sends too little; f only gets trips."""
    od = spark.createDataFrame([("a", "b", 30.0), ("a", "c", 70.0), ("b", "a", 5.0), ("b", "c", 95.0), ("c", "a", 20.0), ("c", "e", 80.0), ("d", "c", 50.0), ("d", "e", 50.0), ("e", "a", 5.0), ("e", "f", 95.0), ("b", "b", 9.0)], "origin string, dest string, flow double")
    cores = spark.createDataFrame([("a",), ("b",)], "unit string")
    got = {r["unit"]: (r["fua"], r["is_core"]) for r in delimitation.build_areas(od, cores).collect()}
    assert got == {"a": ("b", True), "b": ("b", True), "c": ("b", False), "d": ("b", False), "e": (None, False), "f": (None, False)}
    summary = delimitation.area_summary(od, spark.createDataFrame([(u, a) for u, (a, _) in got.items()], "unit string, fua string")).collect()
    assert [tuple(r)[:4] for r in summary] == [("b", 4, 409.0, 279.0)]


def test_repair_by_hand(spark):
    """1-2 and 5 are cut apart; 5 goes to y, which it exchanges most with; 9 is an island."""
    assigned = spark.createDataFrame([("1", "x"), ("2", "x"), ("5", "x"), ("3", "y"), ("4", "y"), ("6", "z"), ("9", "x")], "unit string, fua string")
    edges = fragments.symmetric(spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4"), ("4", "5"), ("5", "6")], "a string, b string"), "a", "b")
    od = spark.createDataFrame([("4", "5", 3.0), ("5", "4", 4.0), ("5", "6", 5.0)], "origin string, dest string, flow double")
    got = {r["unit"]: r["fua"] for r in fragments.repair(od, assigned, edges).collect()}
    assert got == {"1": "x", "2": "x", "3": "y", "4": "y", "5": "y", "6": "z", "9": "x"}
    with_core = fragments.repair(od, assigned, edges, spark.createDataFrame([("5",)], "unit string"))
    assert {r["unit"]: r["fua"] for r in with_core.collect()}["1"] == "y"


def test_matching_by_hand(spark):
    """A pattern that fits two names waits until one of them is taken; twins need their qualifier."""
    polygons = spark.createDataFrame([(1, "RAKOVICA"), (2, "?AKOVICA"), (3, "PALILULA (NI?)"), (4, "PALILULA (BEOGRAD)"), (5, "V?A?AR"), (6, "?O?E")], "polygon_id int, name string")
    names = spark.createDataFrame([("Раковица", "Београдска"), ("Ђаковица", "Косово"), ("Палилула", "Нишавска област"), ("Палилула", "Београдска област"), ("Врачар", None), ("Горе", "а"), ("Доле", "б")], "name string, area string")
    got = {(r["polygon_id"], r["key"], r["stage"]) for r in matching.match(polygons, names).collect()}
    assert got == {(1, "RAKOVICA", 1), (2, "DAKOVICA", 3), (3, "PALILULA@NISAVSKAOBLAST", 2), (4, "PALILULA@BEOGRADSKAOBLAST", 2), (5, "VRACAR", 3)}
    assert {(r["problem"], r["id"]) for r in matching.audit(matching.match(polygons, names), polygons, names).collect()} == {("territory", "GORE"), ("territory", "DOLE"), ("polygon", "6")}
