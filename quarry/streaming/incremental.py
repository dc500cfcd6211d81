"""Indexes that grow with a stream of documents: every micro-batch appends its own postings and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.operators import sparse
from quarry.plans import rag


def append_index(docs: DataFrame, path: str, checkpoint: str, settings: rag.Settings | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """Start a query that appends postings, lengths and chunks of streamed docs below path.

    A batch that is tried again overwrites its own folder, so each document counts once.
    """
    own = settings or rag.Settings()

    def keep(batch: DataFrame, number: int) -> None:
        index = sparse.build(batch, id_col, text_col)
        chunks = rag.chunked(batch, own, id_col, text_col)
        for name, rows in (("postings", index.postings), ("lengths", index.lengths), ("chunks", chunks)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return docs.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()


def read_index(spark, path: str) -> sparse.SparseIndex:
    """The index of all batches so far."""
    parts = [spark.read.parquet(f"{path}/{name}").drop("batch") for name in ("postings", "lengths")]
    return sparse._of(*parts)
