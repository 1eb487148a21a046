"""Similar records of a stream, against a fixed collection and against what the stream brought before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from setloom.plans.join import similarity_join


def probe_stream(stream: DataFrame, indexed: DataFrame, out: str, checkpoint: str, *, threshold: float, strict: bool = False, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of (rid, tokens) is joined with ``indexed``; pairs (rid1 of it, rid2 of the stream) go to ``out``.

    A batch writes its own folder anew, so that one repeated after a failure leaves no pair twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        similarity_join(indexed, df, threshold=threshold, strict=strict).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def growing_join(stream: DataFrame, store: str, out: str, checkpoint: str, *, threshold: float, strict: bool = False) -> StreamingQuery:
    """A self-join of a growing collection: a batch is joined with all before it and with itself, then kept in ``store``."""

    def before(spark: SparkSession, number: int) -> DataFrame | None:
        try:
            kept = spark.read.parquet(store)
        except Exception as error:  # the store is made by the first batch
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise
        return kept.where(kept["batch"] < number).select("rid", "tokens")

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        own = df.select("rid", "tokens").persist()
        pairs = similarity_join(own, threshold=threshold, strict=strict)
        old = before(spark, number)
        if old is not None:
            pairs = pairs.unionByName(similarity_join(old, own, threshold=threshold, strict=strict))
        pairs.write.mode("overwrite").parquet(f"{out}/batch={number}")
        own.write.mode("overwrite").parquet(f"{store}/batch={number}")
        own.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
