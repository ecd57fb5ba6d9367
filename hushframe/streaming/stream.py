"""Detection and masking of a stream: the batch operators on ``readStream``, since a document needs no other one.

Files or rows come in, masked rows go out in append mode; there is no state, so late data and restarts need nothing but
the sink's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hushframe.operators.detect import detect
from hushframe.operators.mask import mask, to_detections


def masked_stream(spark: SparkSession, path: str, schema: str, names: Iterable[str] = (), mode: str = "safe", files: int = 100) -> DataFrame:
    """A stream over Parquet files under ``path`` with entities, detections and masked text of each row."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return mask(to_detections(detect(df, names=names)), mode=mode)


def write_masked(df: DataFrame, path: str, checkpoint: str, columns: Iterable[str] = ("doc_id", "masked_text")) -> StreamingQuery:
    """Write what is there as Parquet, once, and end."""
    return df.select(*columns).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
