"""Windows that are sealed once the stream has passed them, and ordered emission of results that come out of order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sealed_counts(stream: DataFrame, ts: str, key: str, window: str = "1000 seconds", slide: str = "950 seconds", late: str = "0 seconds") -> DataFrame:
    """Rows of each key in overlapping windows of event time; a window comes out when the watermark has passed its end."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def in_order(stream: DataFrame, part: str, idx: str, value: str, first: int = 0, most: int = 100_000) -> DataFrame:
    """(part, idx, value) in the order of idx for each part: a row waits in state until all before it have come.

    Rows of an idx that has passed are dropped. More than `most` waiting rows in a part are an error: its next idx seems lost.
    """
    kind = dict(stream.dtypes)[part]

    def step(key, frames, state: GroupState):
        following, waiting = state.get if state.exists else (first, [])
        held = {int(i): v for i, v in waiting}
        for f in frames:
            held.update((i, v) for i, v in zip(f[idx].astype(int), f[value], strict=True) if i >= following)
        out = []
        while following in held:
            out.append((key[0], following, held.pop(following)))
            following += 1
        if len(held) > most:
            raise ValueError(f"{len(held)} rows of {key[0]} wait for {following}")
        state.update((following, sorted(held.items())))
        yield pd.DataFrame(out, columns=[part, idx, value])

    return stream.groupBy(part).applyInPandasWithState(step, f"{part} {kind}, {idx} long, {value} string", "next long, waiting array<struct<i: long, v: string>>", "append", GroupStateTimeout.NoTimeout)


class _InOrder(StatefulProcessor):
    """State of a part: the index that comes next, and a map from each waiting index to its row."""

    def __init__(self, part: str, idx: str, value: str, kind: str, first: int, patience_ms: int):
        self.row = Row(part, idx, value, "lost")
        self.idx, self.value, self.kind, self.first, self.patience = idx, value, kind, first, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.following = handle.getValueState("following", "i long")
        self.waiting = handle.getMapState("waiting", "i long", f"v {self.kind}")

    def handleInputRows(self, key, rows, timerValues):
        before = following = self.following.get()[0] if self.following.exists() else self.first
        came = False
        for r in rows:
            i = r[self.idx]
            if i is not None and i >= following:
                self.waiting.updateValue((int(i),), (r[self.value],))
                came = True
        while came and self.waiting.containsKey((following,)):
            yield self.row(*key, following, self.waiting.getValue((following,))[0], False)
            self.waiting.removeKey((following,))
            following += 1
        if following != before or not self.following.exists():
            self.following.update((following,))
            self._wait(timerValues)

    def _wait(self, timerValues) -> None:
        """One timer a part, set anew whenever its next index changes."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if next(iter(self.waiting.keys()), None) is not None:
            yield self.row(*key, self.following.get()[0], None, True)

    def close(self) -> None:
        pass


def in_order_timed(stream: DataFrame, part: str, idx: str, value: str, first: int = 0, patience_ms: int = 600_000) -> DataFrame:
    """(part, idx, value, lost) in the order of idx for each part, values of any type: a row waits in a map state until all before it have come.

    A batch costs its new rows and those that it sets free, however many wait. When a part has waited for its next index
    for patience_ms of processing time while later ones stand there, a row with that index, no value and lost = true
    reports it, once; nothing is skipped. Rows of an idx that has passed, and of a null
    one, are dropped; of rows of one idx that wait the last counts. Needs the RocksDB state store.
    """
    kinds = dict(stream.dtypes)
    made = f"`{part}` {kinds[part]}, `{idx}` long, `{value}` {kinds[value]}, lost boolean"
    return stream.select(part, idx, value).groupBy(part).transformWithState(_InOrder(part, idx, value, kinds[value], first, patience_ms), made, "Append", "ProcessingTime")
