"""Rows of a key held back until the watermark has passed them, and joins in their order."""

from __future__ import annotations

import itertools
import json
import pickle
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Rows are kept in entries of at most this span of time, or of few rows.
SPAN = "10 minutes"
FEW = 256
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def micros_of(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1_000_000)


class Held:
    """Tuples that begin with their time in microseconds, in a map state by time.

    A batch adds one entry for each span of time that it has rows of, without a
    look at what is there; spans with few rows share one, since each access to
    the state costs more than they do. What is due is read entry by entry; only
    the entries in which the watermark stands can be written again. So a row
    costs the same whether few or many others are held.
    """

    def __init__(self, handle: StatefulProcessorHandle, span: int):
        self.handle, self.span = handle, span
        # The first time in an entry, and a number that tells entries apart.
        self.entries = handle.getMapState("held", "first bigint, number bigint", "rows binary")

    def add(self, rows: Sequence[tuple]) -> None:
        """Keep the rows, and wake up just after the first one."""
        spans: dict[int, list] = {}
        for row in rows:
            spans.setdefault(row[0] // self.span, []).append(row)
        parts: list[list] = []
        for _, part in sorted(spans.items()):
            if parts and len(parts[-1]) + len(part) <= FEW:
                parts[-1] += part
            else:
                parts.append(part)
        for part in parts:
            key = (min(r[0] for r in part), uuid.uuid4().int >> 65)
            self.entries.updateValue(key, (pickle.dumps(part, 5),))
        if parts:
            self._wake(min(r[0] for r in rows))

    def _wake(self, at: int) -> None:
        due = at // 1000 + 1
        timers = list(self.handle.listTimers())
        if all(due < timer for timer in timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def due(self, limit: int) -> list[tuple]:
        """All rows up to `limit`, in any order; they are not held any longer."""
        first, out, back = None, [], []
        for key in [tuple(k) for k in self.entries.keys()]:
            if key[0] > limit:
                first = key[0] if first is None else min(first, key[0])
                continue
            for row in pickle.loads(bytes(self.entries.getValue(key)[0])):
                (out if row[0] <= limit else back).append(row)
            self.entries.removeKey(key)
        self.add(back)
        if first is not None:
            self._wake(first)
        return out


def passed(timerValues, expiredTimerInfo) -> int:
    """The time in microseconds that the watermark has passed, at least that of the timer."""
    return max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000


# Keys are held in so many groups: each batch wakes a group, not each key, and a call to the engine
# costs more than the rows of a key. Some groups for each state partition keep all cores busy.
GROUPS = 1024
# Rows that leave at once, at most.
OUT = 10_000


class _AsOf(StatefulProcessor):
    """Gives each left row the last right row of its key before it, in the order of their times.

    A group has many keys. Their rows are held together; the payload in force is kept for each key.
    """

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = Held(handle, self.span)
        self.current = handle.getMapState("current", "key string", "payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = []
        for batch in rows:
            arrived += zip(*(batch[c].tolist() for c in ("at", "side", "key", "body")))
        self.held.add(arrived)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Right rows come first at an instant, the greater payload last.
        rows = sorted(
            self.held.due(passed(timerValues, expiredTimerInfo)),
            key=lambda r: (r[2], r[0], r[1], _ordered(r[3]) if r[1] == 0 else ()),
        )
        out = []
        for one, mine in itertools.groupby(rows, key=lambda r: r[2]):
            before = payload = self.current.getValue((one,))[0] if self.current.containsKey((one,)) else None
            for at, side, _, body in mine:
                if side == 0:
                    payload = body
                else:
                    out.append((at, body, payload))
            if payload != before:
                self.current.updateValue((one,), (payload,))
        for start in range(0, len(out), OUT):
            part = pd.DataFrame(out[start : start + OUT], columns=["_time", "_left", "_right"])
            yield part.assign(_time=pd.to_datetime(part["_time"], unit="us", utc=True))

    def close(self) -> None:
        pass


def _ordered(payload: str) -> tuple:
    return tuple((v is not None, v) for v in json.loads(payload).values())


def live_as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    lateness: str,
    span: str = SPAN,
) -> DataFrame:
    """Each left row with the payload of the last right row at or before its time, both sides arriving.

    Both streams come without a watermark; `lateness` is that of the two
    together, so a side that is silent holds nobody up. A left row leaves once
    the watermark has passed it. Of two right rows at one instant the greater
    payload wins; a right row without a time is left out. The result has the
    left columns, in event time `left_time`, and the payload, null before the
    first right row. State holds the rows within the lateness and one payload
    for each key; keys of one hash are held together.
    """

    def side(df: DataFrame, time: str, number: int, columns: Sequence[str]) -> DataFrame:
        def whole(names: Sequence[str]) -> Column:
            return F.to_json(F.struct(*names), {"timestampFormat": _TIME, "ignoreNullFields": "false"})

        return df.select(
            F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int").alias("group"),
            F.col(time).alias("_time"),
            F.unix_micros(time).alias("at"),
            F.lit(number).alias("side"),
            whole(keys).alias("key"),
            whole(columns).alias("body"),
        )

    rows = side(left, left_time, 1, left.columns).unionByName(
        side(right.where(F.col(right_time).isNotNull()), right_time, 0, payload)
    )
    joined = (
        rows.withWatermark("_time", lateness)
        .groupBy("group")
        .transformWithStateInPandas(
            statefulProcessor=_AsOf(micros_of(span)),
            outputStructType="_time timestamp, _left string, _right string",
            outputMode="Append",
            timeMode="EventTime",
            eventTimeColumnName="_time",
        )
    )
    options = {"timestampFormat": _TIME}
    found = right.select(*payload).schema
    parsed = joined.select(
        F.col("_time"),
        F.from_json("_left", left.schema, options).alias("_l"),
        F.from_json("_right", found, options).alias("_r"),
    )
    return parsed.select(
        *[F.col("_time").alias(c) if c == left_time else F.col("_l")[c].alias(c) for c in left.columns],
        *[F.col("_r")[c].alias(c) for c in payload],
    )
