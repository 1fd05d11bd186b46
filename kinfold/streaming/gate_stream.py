"""Incremental gate: new files in, accepted and rejected tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import BUILD_RULES, MESSAGE_SCHEMA, GateRules
from ..plans.build import gate_and_dedup
from ..session import intermediates, materialize, release
from .hash_history import FANOUT, HashHistory


def stream_gate(
    spark: SparkSession,
    source: str,
    accepted: str,
    rejected: str,
    checkpoint: str,
    schema: T.StructType = MESSAGE_SCHEMA,
    rules: GateRules = BUILD_RULES,
    files_per_batch: int | None = None,
    fanout: int = FANOUT,
) -> StreamingQuery:
    """Gate and deduplicate the JSONL files that arrive in `source`.

    Rows of a batch stand in the order of their `ord`, where the files have one;
    otherwise by file, block and line. A file where only some rows have one is an
    error. Dedup state is a table of accepted hashes beside the accepted rows, not
    the state store; its files are merged as batches go by, `fanout` at a time. Each
    batch writes its own batch_id folders in overwrite mode and compares with earlier
    batches only, so a batch replayed after a crash gives the same rows again.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    history = HashHistory(spark, f"{accepted.rstrip('/')}-hashes", fanout)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]

    def gate(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        scratch = len(intermediates(session))
        try:
            history.tidy(batch_id)
            batch = materialize(batch.withColumn("_row", F.monotonically_increasing_id()), "batch")
            have = batch.select("ord").limit(1).filter("ord IS NOT NULL").count() if "ord" in batch.columns else 0
            if not have:
                batch = batch.withColumn("ord", F.struct("_file", "_block", "_row"))
            batch = batch.drop("_file", "_block", "_row")
            gated = gate_and_dedup(batch, lambda passed: history.known(passed, batch_id), rules)
            out = gated.accepted.drop("reason")
            out = out if have else out.drop("ord")
            out.write.mode("overwrite").parquet(f"{accepted}/batch_id={batch_id}")
            gated.rejected.write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")
            made = session.read.schema("text_hash string").parquet(f"{accepted}/batch_id={batch_id}")
            history.add(made, batch_id)
        finally:
            release(session, intermediates(session)[scratch:])

    return (
        reader.json(source)
        .select("*", *place)
        .writeStream.foreachBatch(gate)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
