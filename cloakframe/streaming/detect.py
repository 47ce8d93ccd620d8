"""Detection on a stream: a stateless map, so it needs no watermark; per-batch numbering goes through a batch sink."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.spans import detect


def detect_stream(stream: DataFrame, categories=None, keys=("doc_id",)) -> DataFrame:
    return detect(stream, categories, keys=keys)


def anonymise_batches(stream: DataFrame, path: str, checkpoint: str, categories=None, style: str = "pelny_token"):
    """Starts a query that anonymises each micro-batch by document and appends it to path; a batch that is run again replaces
    its own folder."""
    from ..plans.api import anonymise

    def write(batch, number):
        anonymise(batch, categories=categories, style=style).texts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
