"""Readers of files that Spark has no reader for: zipped CSV, XLSX sheets, shapefiles, GeoJSON. The first three stand on the data sources of ranges."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import ranges


def reader(spark: SparkSession, source: type) -> DataFrameReader:
    """A reader of one of ranges.SOURCES, which the session knows by its name from then on."""
    spark.dataSource.register(source)
    return spark.read.format(source.name())


def zipped_csv(spark: SparkSession, path: str, schema: str, pattern: str = "*.csv.zip", members: str = "first") -> DataFrame:
    """Rows of the first CSV, or all, in each zip below a folder, by the names in its header; columns that a file lacks are null.

    Each member is read by its own task, in pieces. No file that fits the pattern is a FileNotFoundError.
    """
    kind = StructType.fromDDL(schema)
    ending = fnmatch.translate(pattern)
    if not ranges.found(path, ending):
        raise FileNotFoundError(f"no {pattern} in {path}")
    texts = reader(spark, ranges.ZippedCsv).schema(", ".join(f"`{c}` string" for c in kind.names)).option("pattern", ending).option("members", members).load(path)
    return texts.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kind))


def recode(rows: DataFrame, column: str, changes: dict[int, int]) -> DataFrame:
    """Codes replaced by others, as when towns have merged."""
    out = F.col(column)
    for old, new in changes.items():
        out = F.when(F.col(column) == old, F.lit(new).cast(rows.schema[column].dataType)).otherwise(out)
    return rows.withColumn(column, out)


def xlsx_rows(spark: SparkSession, path: str, columns: int, sheet: str | None = None, first_row: int = 1) -> DataFrame:
    """sheet (the file), row_idx, c0 ... as text: one sheet, by name or the first, of each XLSX file, from a row on; empty cells are null.

    A sheet is one compressed stream, so one task reads it; rows that have passed are let go.
    """
    rows = reader(spark, ranges.Sheets).option("columns", columns).option("first_row", first_row)
    return (rows if sheet is None else rows.option("sheet", sheet)).load(path)


def shapefile(spark: SparkSession, path: str, fields: list[str], encoding: str = "latin-1", records: int = ranges.RECORDS, rings: bool = True) -> DataFrame:
    """The named fields, as text, and rings (arrays of (x, y)) of the polygons of the shapefiles in a folder; null shapes have none.

    A .shp and the .dbf of the same name lie side by side. Tasks read ranges of records, which .shx locates; a layer without .shx is
    read by one task. Without rings only the .dbf is read.
    """
    kind = ", ".join([*(f"`{f}` string" for f in fields), *([f"rings {ranges.RINGS}"] if rings else [])])
    return reader(spark, ranges.Shapefiles).schema(kind).option("encoding", encoding).option("records", records).load(path)


def geojson_polygons(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """The named properties and rings (arrays of (x, y)) of the polygons of GeoJSON files; parts of multipolygons follow one another."""
    kinds = ", ".join(f"`{p}`: string" for p in properties)
    schema = f"features array<struct<properties: struct<{kinds}>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    text = F.col("f.geometry.coordinates")
    one = F.from_json(text, "array<array<array<double>>>")
    many = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one)
    xy = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return features.select(*(F.col(f"f.properties.`{p}`").alias(p) for p in properties), xy.alias("rings"))


def corners(rings):  # noqa: ANN001, ANN201
    """All corners of a polygon's rings, for adjacency()."""
    return F.array_distinct(F.flatten(rings))


def columns_present(rows: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Which columns, nested ones by dotted names, a frame has; nothing is read."""

    def has(kind, parts: list[str]) -> bool:  # noqa: ANN001
        if not parts:
            return True
        if hasattr(kind, "elementType"):
            return has(kind.elementType, parts)
        return isinstance(kind, StructType) and parts[0] in kind.names and has(kind[parts[0]].dataType, parts[1:])

    return {c: has(rows.schema, c.split(".")) for c in columns}
