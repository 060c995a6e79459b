"""Appending postings from a file stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexigrove.functions.analysis import Profile, stemmed
from lexigrove.operators.index import token_rows


def append_postings(documents: DataFrame, profile: Profile, path: str, checkpoint: str, id_col: str = "id", text_col: str = "full_text") -> StreamingQuery:
    """Write (term, doc_id, pos) of each micro-batch as Parquet under `path`, in a folder that its retry overwrites.

    Documents are new ones: an id that comes again adds positions, as repeated rows do in build_index().
    """
    rows = token_rows(documents, profile, id_col, text_col)

    def write(batch: DataFrame, epoch: int) -> None:
        stemmed(batch, "token", profile).select("term", "doc_id", "pos").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
