"""New documents in a folder are cut into blocks, normalised and classified as they arrive. Stateless, so no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocks as b
from ..operators import layout


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def block_stream(docs: DataFrame) -> DataFrame:
    return layout.with_heading_levels(b.normalize(b.from_documents(docs)))


def run_to_table(blocks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived and ends; a later run goes on where this one ended."""
    return blocks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
