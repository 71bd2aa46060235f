"""Result tables: checked writes, upserts of whole fields, parameter sets, manifests and contracts.

Tables are folders of Parquet with one partition a commit, which appears as a whole. Readers take the newest commit of
each field.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parameter_id(parameters: dict) -> str:
    """Content hash of a parameter record."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, allow_nan=False).encode()).hexdigest()


def checked(df: DataFrame, finite: list[str], not_negative: list[str] = (), required: list[str] = ()) -> DataFrame:
    """`df`; a row that breaks a rule fails the job when it is read."""
    rules = [(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), f"{c} is not finite") for c in finite]
    rules += [(F.col(c) < 0, f"{c} is negative") for c in not_negative] + [(F.col(c).isNull(), f"{c} is missing") for c in required]
    ok: Column = F.lit(True)
    for bad, why in rules:
        ok = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(why).cast("boolean")).otherwise(ok)
    return df.where(ok) if rules else df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and rows of `old` whose key `new` doesn't have; all rows of a key are replaced together."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def commit(df: DataFrame, folder: str, number: int) -> str:
    """Writes one commit of a table, as a partition that replaces itself alone if it is written again.

    Spark stages the files out of readers' sight and moves the partition into place when the job has succeeded, so a
    reader never sees half a commit. An empty commit leaves nothing.
    """
    df.withColumn("commit", F.lit(f"{number:09d}")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit").parquet(folder)
    return f"{folder}/commit={number:09d}"


def newest(spark: SparkSession, folder: str, key: str = "field_id") -> DataFrame:
    """The rows of each key's newest commit; keys and commits alone are read to find it."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    last = rows.groupBy(key).agg(F.max("commit").alias("commit"))
    return rows.join(last, [key, "commit"], "left_semi").drop("commit")


def pending(fields: DataFrame, done: DataFrame, key: str = "field_id", retries: int = 1) -> DataFrame:
    """Fields without a committed result, or failed with attempts left. done: key, state, attempts."""
    closed = done.where((F.col("state") == "COMPLETED") | ((F.col("state") == "FAILED") & (F.col("attempts") > retries)))
    return fields.join(closed.select(key), key, "left_anti")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and SHA-256 of each file of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """True if both tables hold the same rows equally often."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def itineraries(segments: DataFrame, field: str = "field_id", component: str = "component", order: str = "sequence") -> DataFrame:
    """One ordered array of points for each itinerary; gaps between components are never bridged."""
    rows = F.array_sort(F.collect_list(F.struct(order, "points")))
    return segments.groupBy(field, component).agg(F.flatten(F.transform(rows, lambda r: r["points"])).alias("line"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV mirror with these columns in this order and a header."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def rows_of(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The rows of one field of a CSV with a field_id, all as text."""
    return text_records(spark, path).where(F.col("field_id") == str(field))


def text_records(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text, so that no id loses a leading zero."""
    return spark.read.csv(path, header=True, inferSchema=False)


def geojson(df: DataFrame, kind: str, coordinates: str, properties: list[str]) -> DataFrame:
    """(field_id, value): one GeoJSON feature a row; a null geometry stays null, never a made-up line."""
    shape = F.when(F.col(coordinates).isNotNull(), F.struct(F.lit(kind).alias("type"), F.col(coordinates).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select("field_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str) -> None:
    """Features of `geojson` as text files, one folder a field."""
    df.write.mode("overwrite").partitionBy("field_id").text(path)


def write_layers(df: DataFrame, path: str, kind: str = "kind", crs: str = "crs") -> None:
    """Metric layers, one folder for each kind and frame."""
    df.write.mode("overwrite").partitionBy(kind, crs).parquet(path)


def collected(layers: list[DataFrame]) -> DataFrame:
    """Per-field exports of different columns as one table."""
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out
