"""Triage of arriving messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from parlova.operators.retrieval import RetrievalIndex
from parlova.operators.triage import TriageConfig, triage
from parlova.runtime import materialize, scratch_scope

MESSAGE_SCHEMA = "qid bigint, message string"


def start_triage_stream(
    spark: SparkSession,
    source_dir: str,
    output_dir: str,
    checkpoint_dir: str,
    classify,
    classes: list[str],
    index: RetrievalIndex,
    config: TriageConfig = TriageConfig(),
    files_per_batch: int = 100,
    available_now: bool = True,
) -> StreamingQuery:
    """Triage message files as they arrive, against a stored index and model.

    Each micro-batch runs the batch operator and overwrites its own
    ``batch=<id>`` folder, so a batch repeated after a failure leaves no
    duplicates. The batch's intermediate tables are removed afterwards.
    """
    messages = (
        spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            if batch.isEmpty():
                return
            # Every stored step of the triage reads the batch.
            out = triage(materialize(batch), classify, classes, index, config)
            out.write.mode("overwrite").parquet(f"{output_dir}/batch={batch_id}")

    writer = messages.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_triage_output(spark: SparkSession, output_dir: str) -> DataFrame:
    return spark.read.parquet(output_dir)
