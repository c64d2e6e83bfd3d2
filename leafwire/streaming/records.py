"""Records in a stream: the decode has no state, so the batch functions run in it as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafwire.functions import udfs


def read_stream(spark: SparkSession, path: str, schema: str = "rec_id long, ts timestamp, raw string") -> DataFrame:
    """JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def decode_stream(stream: DataFrame, text: str = "raw", lenient: bool = False) -> DataFrame:
    return udfs.decoded(stream, text, lenient=lenient)


def quality_by_window(stream: DataFrame, ts: str = "ts", width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Per window: records, readable and repaired ones; rows later than ``late`` are dropped."""
    read = decode_stream(stream.withWatermark(ts, late))
    return read.groupBy(F.window(ts, width)).agg(F.count("*").alias("n"), F.count_if("decoded.ok").alias("ok"), F.count_if(F.size("decoded.repairs") > 0).alias("repaired"))


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parquet, what is there and then stop; a restart from the checkpoint writes nothing twice."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
