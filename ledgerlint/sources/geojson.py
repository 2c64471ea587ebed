"""GeoJSON scans: one row per feature, properties as columns, coordinates as lon / lat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import (ArrayType, DoubleType, StringType, StructField, StructType)

from ledgerlint.sources.split_json import objects_of
from ledgerlint.sources.tables import clean_nulls
from ledgerlint.specs import REGISTRY_FILE_FIELDS

REGISTRY_PROPERTIES = ", ".join(f"{name} {kind}" for name, kind in REGISTRY_FILE_FIELDS)


def _feature(properties: str) -> StructType:
    return StructType([
        StructField("properties", StructType.fromDDL(properties)),
        StructField("geometry", StructType([
            StructField("type", StringType()),
            StructField("coordinates", ArrayType(DoubleType())),
        ])),
    ])


def _flatten(df: DataFrame) -> DataFrame:
    """Absent and null geometries give NULL coordinates."""
    flat = df.select(
        "pos", "f.properties.*",
        F.get("f.geometry.coordinates", F.lit(0)).alias("geo_longitude"),
        F.get("f.geometry.coordinates", F.lit(1)).alias("geo_latitude"),
    )
    return clean_nulls(flat, [])


def read_feature_collection(spark: SparkSession, path: str,
                            properties: str = REGISTRY_PROPERTIES) -> DataFrame:
    """One ``FeatureCollection`` document, read by one task; :func:`read_large_collection` splits it."""
    schema = StructType([StructField("features", ArrayType(_feature(properties)))])
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return _flatten(doc.select(F.posexplode("features").alias("p", "f"))
                    .select(F.col("p").cast("long").alias("pos"), "f"))


def read_large_collection(spark: SparkSession, path: str, properties: str = REGISTRY_PROPERTIES,
                          range_bytes: int = 32 << 20) -> DataFrame:
    """The same rows, one large document read by a task per byte range."""
    found = objects_of(spark, path, "features", range_bytes)
    return _flatten(found.select("pos", F.from_json("text", _feature(properties)).alias("f")))


def read_feature_lines(spark: SparkSession, path: str,
                       properties: str = REGISTRY_PROPERTIES) -> DataFrame:
    """Newline-delimited features, split over tasks. ``pos`` numbers the lines in file order:
    rows are counted per input split and only the split counts are summed up in order."""
    split = [F.col("_metadata.file_path").alias("file"),
             F.col("_metadata.file_block_start").alias("start")]
    lines = (spark.read.schema(_feature(properties)).json(path)
             .select(F.struct("properties", "geometry").alias("f"), *split,
                     F.monotonically_increasing_id().alias("n")))
    splits = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("rows"),
                                                F.min("n").alias("first"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "start", "first",
                            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    placed = lines.join(offsets, ["file", "start"])
    return _flatten(placed.select((F.col("offset") + F.col("n") - F.col("first")).alias("pos"), "f"))
