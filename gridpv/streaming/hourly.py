"""F1 (half-hour -> hour mean per key) as an incremental Structured Streaming job.

Generation files land in a folder (parquet, :data:`GENERATION_SCHEMA`).  Each
row joins its hour; rows arriving up to ``watermark`` late still count; an hour
is written once, when the watermark passes its end (append mode).  State is
one partial mean per key and open hour.  The caller names the checkpoint folder, so a
restarted or moved driver resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridpv.schemas import GENERATION_SCHEMA


def hourly_stream(spark: SparkSession, source: str, keys: Sequence[str] = ("gsp_id",), ts: str = "datetime_gmt",
                  value: str = "generation_mw", watermark: str = "2 hours",
                  schema: StructType = GENERATION_SCHEMA) -> DataFrame:
    """Streaming hour means of ``value`` per key (missing values skipped)."""
    from gridpv.functions.columns import EPOCH, epoch_us

    rows = spark.readStream.schema(schema).parquet(source)
    # Watermarks need an instant (TIMESTAMP); NTZ values mean UTC, so go through
    # epoch microseconds (no session time zone involved) and back.
    rows = rows.withColumn("_event", F.timestamp_micros(epoch_us(ts)))
    return (
        rows.withWatermark("_event", watermark)
        .groupBy(*keys, F.window("_event", "1 hour").alias("_w"))
        .agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_rows"))
        .select(*keys, F.timestamp_add("MICROSECOND", F.unix_micros("_w.start"), EPOCH()).alias(ts), value, "n_rows")
    )


def write_hourly(df: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append closed hours to a parquet table.  ``checkpoint`` is the state folder of this very job
    (source and target), on storage that all executors share."""
    w = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")
    return w.start(target)
