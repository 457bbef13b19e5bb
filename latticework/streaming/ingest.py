"""Incremental ingest: a stream of documents is upserted, and counts of graph edges are added up.

Per-document mentions do not depend on other documents, and co-occurrence
weights are sums over documents, so batches can be merged in any order. Each
micro-batch is written under its id, so a batch that is run again replaces
itself. Of several versions of a document the last one counts: the one of the last
batch, and within a batch that with the greatest `version`, or, where the stream
has no such column, the greatest text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latticework.operators import kg as K


def ingest(stream: DataFrame, root: str, checkpoint: str, extractor: Callable[[Column], Column] | None = None, once: bool = True) -> StreamingQuery:
    """stream(id, text[, version]): mentions of each batch below root; `once` takes what is there and stops."""

    def batch(d: DataFrame, n: int) -> None:
        order = F.struct(*(F.col(c) for c in ("version", "text") if c in d.columns))
        last = d.groupBy("id").agg(F.max_by("text", order).alias("text"))
        c = K.collapse_within(K.extract_mentions(last, extractor or K.rule_extractor()))
        # a document without mentions has a row too, so that it replaces an earlier version
        nodes = last.select(F.col("id").cast("string").alias("doc_id")).join(c, "doc_id", "left")
        nodes.select("doc_id", F.concat(F.lit("ent:"), "kept").alias("node")).distinct().write.mode("overwrite").parquet(f"{root}/batch={n}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def merged_edges(spark, root: str) -> DataFrame:
    """Co-occurrence edges over all batches; of a document that came again the last batch counts."""
    d = spark.read.parquet(root)
    last = d.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return K.cooccurrence(d.join(last, ["doc_id", "batch"], "left_semi").filter("node is not null").select("doc_id", "node"))
