"""A log of source changes kept up to date in stored roll-ups, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import apply_deltas, changes, keyed
from ..spec import TreeSpec, col


def maintain(log: DataFrame, spec: TreeSpec, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], columns: dict[str, str], checkpoint: str, feed: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Fold a stream of (scope, id, changes) into a stored tree.

    ``load`` gives the current version; ``save`` writes the next one under its batch
    number, so that a batch which runs again after a failure replaces its own output.
    ``feed`` receives the change feed of each batch.
    """

    def batch(rows: DataFrame, number: int) -> None:
        before = load()
        deltas = rows.groupBy(*keyed(rows, spec)).agg(*[F.sum(col(d)).alias(d) for d in dict.fromkeys(columns.values())])
        after = apply_deltas(before, spec, deltas, columns)
        save(after, number)
        if feed:
            feed(changes(before, after, spec, list(columns)), number)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
