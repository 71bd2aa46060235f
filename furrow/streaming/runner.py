"""Field batches as an incremental stream: each micro-batch of fields commits once, and a restart resumes.

The state of a field is the newest row of the status table. A batch that is run again after a failure overwrites its own
commit, so results don't depend on how often it ran. A field that `compute` marks with an error is recorded and doesn't stop
the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from furrow.sources.store import commit, parameter_id


def run_available(spark: SparkSession, source: str, schema: str, out: str, compute: Callable[[DataFrame], DataFrame], parameters: dict, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """Computes all new files of fields under `source` and commits results and states under `out`, then stops.

    `compute` maps fields to rows with field_id and error (null if it went well).
    """
    contract = parameter_id(parameters)

    def one(batch: DataFrame, number: int) -> None:
        rows = compute(batch).withColumn("parameter_set_id", F.lit(contract)).persist()
        try:
            commit(rows.where("error is null").drop("error"), f"{out}/results", number)
            commit(rows.select("field_id", F.when(F.col("error").isNull(), "COMPLETED").otherwise("FAILED").alias("state"), "error", "parameter_set_id"), f"{out}/states", number)
        finally:
            rows.unpersist()

    fields = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return fields.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def same_contract(spark: SparkSession, out: str, parameters: dict) -> bool:
    """True if every committed state was made with these parameters."""
    return spark.read.parquet(f"{out}/states").where(F.col("parameter_set_id") != parameter_id(parameters)).isEmpty()
