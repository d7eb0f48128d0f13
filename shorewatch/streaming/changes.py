"""Findings that appear and go, from a stream of scans."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

NEW, FIXED = "new", "fixed"
#: Settings without which the state of a key can't be kept.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}

RESULT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("change", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("sightings", T.LongType()),
    ]
)


def _millis(moment: datetime) -> int:
    return int(moment.replace(tzinfo=moment.tzinfo or timezone.utc).timestamp() * 1000)


def _moment(millis: int) -> datetime:
    return datetime.fromtimestamp(millis / 1000, timezone.utc)


class Sightings(StatefulProcessor):
    """Stretches of time in which a finding was seen with no gap over ``horizon``, kept until they are over.

    A stretch is told as new when no row of before its beginning can come any more, and as fixed when the horizon
    has passed behind its last sighting; then its state goes.  Both are decided by the watermark, so rows that come
    late or in another order make no difference.
    """

    def __init__(self, horizon_ms: int):
        self.horizon = horizon_ms

    def init(self, handle) -> None:
        self.handle = handle
        kind = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "count", "told")])
        self.stretches = handle.getListState("stretches", kind)

    def handleInputRows(self, key, rows, timerValues):
        stretches = [list(s) for s in self.stretches.get()]
        for row in rows:
            at = _millis(row["seen_at"])
            met = [s for s in stretches if s[0] - self.horizon <= at <= s[1] + self.horizon]
            stretches = [s for s in stretches if s not in met]
            stretches.append([min([at, *(s[0] for s in met)]), max([at, *(s[1] for s in met)]), 1 + sum(s[2] for s in met), max([0, *(s[3] for s in met)])])
        self._keep(stretches)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed, out, kept = timerValues.getCurrentWatermarkInMs(), [], []
        for first, last, count, told in self.stretches.get():
            if not told and first < passed:
                told = 1
                out.append(Row(source=key[0], fingerprint=key[1], change=NEW, at=_moment(first), sightings=None))
            if last + self.horizon < passed:
                out.append(Row(source=key[0], fingerprint=key[1], change=FIXED, at=_moment(last), sightings=count))
            else:
                kept.append([first, last, count, told])
        self._keep(kept)
        return iter(out)

    def _keep(self, stretches: list[list[int]]) -> None:
        if not stretches:
            self.stretches.clear()
            return
        self.stretches.put([tuple(s) for s in sorted(stretches)])
        for first, last, _, told in stretches:
            if not told:
                self.handle.registerTimer(first + 1)
            self.handle.registerTimer(last + self.horizon + 1)

    def close(self) -> None:
        pass


def changes(sightings: DataFrame, horizon_ms: int, late: str) -> DataFrame:
    """(source, fingerprint, change, at, sightings) of a stream of (source, fingerprint, seen_at).

    Rows up to ``late`` behind the latest one count.  Needs the settings of ``STATE_STORE``.
    """
    return (
        sightings.withWatermark("seen_at", late)
        .groupBy("source", "fingerprint")
        .transformWithState(Sightings(horizon_ms), RESULT, "Append", "EventTime")
    )
