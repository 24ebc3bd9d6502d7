"""Adding to the stored corpus from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.items import BODY_CHARS, item_chunks, parse_items
from gleaner.providers import OFFLINE, Providers
from gleaner.sources.store import FANOUT, Store


def ingest_items_stream(
    raw: DataFrame, store: Store, repo: str, checkpoint: str, providers: Providers = OFFLINE, available_now: bool = True,
    body_chars: int | None = BODY_CHARS, compact_every: int = FANOUT,
) -> StreamingQuery:
    """raw: a streaming table of JSON items (column `value`, one per row).

    Every micro-batch is one ingest.  A batch that is run again after a failure
    adds nothing twice, because ids that are stored already are left alone.
    Bodies are cut to `body_chars` characters, or not if it is None.  Small
    generations are merged every `compact_every` batches.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        items = parse_items(batch.select(F.col("value").alias("json")))
        chunks = item_chunks(items.where("state = 'closed'"), repo, body_chars)
        store.add(chunks, [F.col("source_path"), F.col("chunk_id")], providers)
        if batch_id % compact_every == compact_every - 1:
            store.compact(compact_every)

    writer = raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
