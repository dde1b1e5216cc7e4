"""The forward sum of a two-state chain as a stream: one small state a key, rows in order within each micro-batch.

Rows that come after later ones of their key have been seen are late; they are dropped. A key is forgotten once the watermark
has passed its last row by ``remember``: a row after that begins a chain of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import append_log

OUTPUT = "key string, seen long, lnl double"
STATE = "f0 double, f1 double, seen long, last double"


def _chain(m: np.ndarray) -> np.ndarray:
    """The product of matrices of logs (k, from, to), of neighbours two by two: as many steps as the logarithm of their number."""
    while len(m) > 1:
        odd = m[len(m) // 2 * 2 :]
        a, b = m[: len(m) // 2 * 2 : 2], m[1::2]
        m = np.concatenate([np.logaddexp(a[:, :, :1] + b[:, None, 0], a[:, :, 1:] + b[:, None, 1]), odd])
    return m[0]


def forward_stream(rows: DataFrame, prior: tuple[float, float], transition: list[list[float]], *, delay: str = "1 hour", remember: int = 86_400_000, order: Sequence[str] = ()) -> DataFrame:
    """key, seen, lnl after each micro-batch. ``rows``: key string, ts timestamp, e0, e1 (logs of the emissions). ``delay`` is how
    late rows may come, ``remember`` (milliseconds of event time) for how long a key without rows is kept. Rows of
    one time stand by the columns of ``order``."""
    start, t = np.log(prior), np.log(np.array(transition))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f, seen, last = None, 0, -np.inf
        if state.exists:
            a, b, seen, last = state.get
            f = np.array([a, b])
        new = pd.concat(list(batches)).sort_values(["ts", *order])
        at = np.array([x.timestamp() for x in new["ts"]], dtype=float)
        new, at = new[at >= last], at[at >= last]
        if not len(at) and f is None:
            return
        if len(at):
            e = new[["e0", "e1"]].to_numpy(dtype=float)
            if f is None:
                f, e = start + e[0], e[1:]
            if len(e):
                along = _chain(t + e[:, None, :])
                f = np.logaddexp(f[0] + along[0], f[1] + along[1])
            seen, last = seen + len(at), at[-1]
        state.update((float(f[0]), float(f[1]), int(seen), float(last)))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + remember)
        yield pd.DataFrame([(key[0], int(seen), float(np.logaddexp(*f)))], columns=["key", "seen", "lnl"])

    return rows.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def append_events(rows: DataFrame, path: str, checkpoint: str):
    """A stream of events appended to a Parquet log, each once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def log_stream(rows: DataFrame, path: str, checkpoint: str, *, mode: str = "append"):
    """A stream of events written to a log by batch: a batch that is tried again, also by a query that lost its checkpoint, replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        append_log(batch, path, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
