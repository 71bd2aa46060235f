"""Connected components of link tables, and tables kept between the rounds of a job."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; without one, a temporary folder if everything runs in one process."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept as a table of the shared folder, for the state of rounds.

    A checkpoint would be computed twice, and its plan goes on to carry what the optimizer infers about its columns,
    which grows from round to round.
    """
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(*tables: DataFrame) -> None:
    """Deletes tables that this module wrote, once nothing reads them again, and the shuffle files of the jobs that did."""
    spark = tables[0].sparkSession
    for folder in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)


def cut(df: DataFrame) -> DataFrame:
    """`kept`, under the name that says what it does to the lineage."""
    return kept(df)


def gathered(df: DataFrame) -> DataFrame:
    """`cut` for narrow rows of links and items: about two tasks a core write it, however many partitions made it."""
    return cut(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism))


def release(spark: SparkSession) -> None:
    """Lets go of what no DataFrame refers to any more: Spark's cleaner then removes its shuffle files.

    What refers to a job that just ended may itself go by the first collection only.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def stored(df: DataFrame, encoded: bool = True) -> DataFrame:
    """`df` as a compressed table of the shared folder, for wide rows that are read by columns; hashes need no dictionary."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(encoded).lower()).parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_pair(x: str, y: str) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def linked(links: DataFrame) -> DataFrame:
    """(item, label) of all items of `links` (a, b), label being the least item that it is connected to.

    Union by contraction: every item points to its least neighbour or stays, links are mapped to what their ends point
    to, and links inside one group vanish, until none is left. After the first round "least" goes by a hash, so that
    chains shrink by a share a round, on average, and stars vanish in two. Rounds are grouped
    minima and joins; no neighbourhood meets in a task.
    """
    edges = gathered(links.where("a <> b").select(*ordered_pair("a", "b")).distinct())
    labels, rounds = None, 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = (lambda c: F.struct(F.col(c).alias("i"))) if rounds == 0 else (lambda c: F.struct(F.xxhash64(F.lit(17), c).alias("h"), F.col(c).alias("i")))
        up = both.groupBy(F.col("a").alias("item")).agg(F.min(key("b")).alias("m")).select("item", F.least(key("item"), "m")["i"].alias("up"))
        ends = [up.select(F.col("item").alias(c), F.col("up").alias(f"{c}2")) for c in "ab"]
        mapped = gathered(edges.join(ends[0], "a").join(ends[1], "b").where("a2 <> b2").select(*ordered_pair("a2", "b2")).distinct())
        labels = gathered(up.withColumnRenamed("up", "label")) if labels is None else gathered(labels.join(up.select(F.col("item").alias("label"), "up"), "label", "left").select("item", F.coalesce("up", "label").alias("label")))
        edges, rounds = mapped, rounds + 1
        if edges.isEmpty():
            break
    if rounds == 1:
        return labels
    least = labels.groupBy("label").agg(F.min("item").alias("least"))
    return gathered(labels.join(least, "label").select("item", F.col("least").alias("label")))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) with the least node of each component; links (a, b) join nodes."""
    found = linked(links.select("a", "b"))
    return nodes.select("node").join(found.select(F.col("item").alias("node"), "label"), "node", "left").select("node", F.coalesce("label", "node").alias("component"))
