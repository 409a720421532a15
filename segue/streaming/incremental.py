"""Arriving tracks linked as they come.

Each micro-batch is a small transfer: keys without a standing decision are searched,
and their decisions are merged into the next version.  The catalog is a table, prepared
and indexed once when the query starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed_values as fv
from ..operators import decisions as dec
from ..operators.link import link_tracks, ready_tracks
from ..operators.prepare import dedup_groups, prepare_catalog, with_key
from ..operators.search import build_index
from ..session import materialise
from ..sinks.versions import decisions_table


def link_stream(
    arriving: DataFrame,
    catalog: DataFrame,
    folder: str,
    service: str,
    threshold: float = fv.DEFAULT_THRESHOLD,
) -> StreamingQuery:
    """Start linking a stream of tracks; processes what is there, then stops.

    A key is decided in the first batch that brings it.  Each version tells the last batch in
    it, so a batch that is run again after a failure adds nothing, and only the buckets of
    keys that a batch decides are written.
    """
    entries = materialise(prepare_catalog(catalog))
    index = build_index(entries)
    progress = f"{folder.rstrip('/')}/progress"

    def handle(batch: DataFrame, number: int) -> None:
        table = decisions_table(batch.sparkSession, folder, service)
        now = table.current()
        if now and now.batches.get(progress, -1) >= number:
            return
        work = dec.work_list(dedup_groups(with_key(batch)), table.load(now), threshold).drop("stale")
        ready = ready_tracks(work)
        table.merge(link_tracks(ready, entries, threshold, index=index), progress, number)

    return (
        arriving.writeStream.foreachBatch(handle)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
