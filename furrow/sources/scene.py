"""Scenes of one field as JSON documents, read into tables of vertices and settings.

A scene names a metric frame and holds GeoJSON polygons: `target` is worked, `travel` may be driven on (the target if it
isn't given), `obstacles` are neither. Unknown keys, a missing target and polygons of too few points fail the job when
the row is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The keys that a scene may have.
SCENE_KEYS = ("profile", "name", "crs", "target", "travel", "obstacles", "vehicle", "planning", "start", "end")
LAYERS = ("target", "travel", "obstacles")
_SHAPE = "struct<type:string,coordinates:string>"


def _parts(shape: Column) -> Column:
    """array<polygon> of a GeoJSON Polygon or MultiPolygon."""
    polygon = F.from_json(shape["coordinates"], "array<array<array<double>>>")
    several = F.from_json(shape["coordinates"], "array<array<array<array<double>>>>")
    return F.when(shape["type"] == "Polygon", F.array(polygon)).when(shape["type"] == "MultiPolygon", several).otherwise(F.raise_error(F.lit("not a polygon")).cast("array<array<array<array<double>>>>"))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """(scene, name, crs, target, travel, obstacles, start, end, vehicle, planning) of each JSON file under `path`."""
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("scene"), F.col("value"))
    unknown = F.array_except(F.coalesce(F.json_object_keys("value"), F.array(F.lit("no JSON object"))), F.array(*map(F.lit, SCENE_KEYS)))
    schema = f"struct<name:string,crs:string,target:{_SHAPE},travel:{_SHAPE},obstacles:{_SHAPE},start:array<double>,end:array<double>,vehicle:map<string,double>,planning:map<string,double>>"
    rows = text.select("scene", unknown.alias("unknown"), F.from_json("value", schema).alias("s")).select("scene", "unknown", "s.*")
    wrong = F.when(F.size("unknown") > 0, F.concat(F.lit("unknown keys: "), F.array_join("unknown", ", "))).when(F.col("target").isNull(), F.lit("target is missing")).when(F.coalesce("crs", F.lit("")).isin("", "EPSG:4326"), F.lit("crs is not metric"))
    ok = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(F.lit(True))
    return rows.where(ok).drop("unknown").withColumn("travel", F.coalesce("travel", "target"))


def scene_vertices(scenes: DataFrame) -> DataFrame:
    """(scene, layer, part, ring, i, x, y) of all polygons of scenes; the closing point is left out."""
    layers = F.array(*(F.struct(F.lit(n).alias("layer"), F.when(F.col(n).isNotNull(), _parts(F.col(n))).alias("parts")) for n in LAYERS))
    parts = scenes.select("scene", F.explode(layers).alias("l")).select("scene", "l.layer", F.posexplode("l.parts").alias("part", "rings"))
    rings = parts.select("scene", "layer", "part", F.posexplode("rings").alias("ring", "points"))
    few = F.when(F.size("points") < 4, F.raise_error(F.lit("a ring of fewer than three points")).cast("boolean")).otherwise(F.lit(True))
    open_ = F.when(F.element_at("points", 1) == F.element_at("points", -1), F.slice("points", F.lit(1), F.size("points") - 1)).otherwise(F.col("points"))
    points = rings.where(few).select("scene", "layer", "part", "ring", F.posexplode(open_).alias("i", "p"))
    return points.select("scene", "layer", "part", "ring", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
