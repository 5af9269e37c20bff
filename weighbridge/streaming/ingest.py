"""Continuous filing of arriving passages into the store.

The stream keeps, per drawer id, whether it has come before: a later arrival ends
there, without a look at the store. What is left of a micro-batch becomes a version
of the store under the batch's own stamp, so a batch that runs again files nothing
twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weighbridge.operators.versions import VersionedStore


def stored_drawers(spark: SparkSession, path: str) -> DataFrame:
    """The store as it is now; an empty one where nothing was written yet."""
    return VersionedStore(path).read(spark)


def _first_arrival(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first row of an id that has not come before, by ``authored_at`` and text."""
    first = None
    for rows in batches:
        if state.exists:
            continue
        both = rows if first is None else pd.concat([first, rows])
        first = both.sort_values(["authored_at", "text"], na_position="last", kind="stable").head(1)
    if first is not None:
        state.update((True,))
        yield first


def first_arrivals(arrivals: DataFrame) -> DataFrame:
    """A stream of drawers with one row per id, over all micro-batches and restarts.

    State is a flag per id; with very many ids set the session's state store to RocksDB.
    """
    grouped = arrivals.groupBy("drawer_id")
    return grouped.applyInPandasWithState(_first_arrival, arrivals.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def ingest_stream(arrivals: DataFrame, store_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start filing a stream of drawers ``(drawer_id, wing, room, text, ...)``.

    The first arrival of an id is filed, within a micro-batch that of the lowest
    ``authored_at`` and text. Ids that others have filed before keep their drawer: the store's
    filters name the few arrivals for which its buckets have to be read.
    """
    store = VersionedStore(store_path)

    def file_batch(batch: DataFrame, batch_id: int) -> None:
        store.commit(batch, [F.asc_nulls_last("authored_at"), F.asc("text")], stamp=f"{checkpoint}#{batch_id}")

    writer = first_arrivals(arrivals).writeStream.foreachBatch(file_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
