"""Landed response pages as a stream (S3): ``readStream`` over page files;
each micro-batch goes through extraction, transform and the keyed upsert,
so a stream of pages produces the same table as one batch run.

A batch is named by the stream's id and its number. The id is kept in the
checkpoint, so a restarted stream skips what it has committed, and a stream
with another checkpoint is another writer of the same table."""
from __future__ import annotations

from collections.abc import Sequence

from sluice.operators import extract as X
from sluice.operators import tables as B
from sluice.operators import transform as T
from sluice.sources.landed import PAGES_SCHEMA


def read_pages_stream(spark, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None):
    r = spark.readStream.schema(PAGES_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def stream_id(spark, checkpoint: str) -> str:
    """The id that Spark has given the stream of this checkpoint; it is there before the first batch."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def run_pages_stream(spark, path: str, input_root: str, steps: Sequence[dict], keys: Sequence[str],
                     table: str, checkpoint: str, max_files_per_trigger: int | None = None,
                     drop: Sequence[str] = ("connector_id",)) -> str:
    """Process landed pages to completion; returns the (bucket) table folder.

    The table keeps (run_id, page_idx, pos) of each row and the last by that
    order wins: a later run replaces an earlier one's record whatever pages
    the two stood on, and micro-batches may arrive in any order."""
    stream = read_pages_stream(spark, path, max_files_per_trigger=max_files_per_trigger)

    def batch(df, bid):
        writer = stream_id(spark, checkpoint)
        if B.committed(spark, table, writer, bid):
            return
        recs = X.extract_records(df, input_root)
        rows = T.transform(recs, steps).rows.drop(*drop)
        B.upsert_table(rows, table, list(keys), writer=writer, batch_id=bid)

    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table
