"""Changes from reading to reading on a stream whose readings may come late, out of order and repeatedly.

A station's state holds the readings that are not older than the watermark, and the last one before them. A reading that comes late gets
its change, and the reading after it is issued again with a new one. A timer at the oldest reading's time lets go of what the
watermark has passed, also where a station falls silent. So the state is as long as the watermark's delay, whatever the history.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from riverflux.streaming.levels import upsert_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RATES = "station_id int, measured_at timestamp, level_cm double, rate_cm_h double, revision long"


class Rates(StatefulProcessor):
    """For each reading its change since the one before. revision grows with each row of a station, so of several rows for one
    reading the one with the largest revision holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "at long", "level double")
        self.revision = handle.getValueState("revision", "n long")

    def kept(self) -> dict[int, float]:
        return {k[0]: v[0] for k, v in self.levels.iterator()}

    def forget(self, held: dict[int, float], watermark: int) -> None:
        """Drop what the watermark (microseconds) has passed but for the last such reading, and wait for the next."""
        times = sorted(held)
        for t in times[: max(bisect_left(times, watermark) - 1, 0)]:
            self.levels.removeKey((t,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waiting = [t for t in times if t >= watermark]
        if waiting:
            self.handle.registerTimer(waiting[0] // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        new: dict[int, float] = {}
        for r in rows:
            if r["at"] >= watermark:
                new[r["at"]] = max(r["level_cm"], new.get(r["at"], r["level_cm"]))
        held = self.kept()
        changed = {t for t, v in new.items() if held.get(t) != v}
        for t in changed:
            held[t] = new[t]
            self.levels.updateValue((t,), (new[t],))
        times = sorted(held)
        place = {t: i for i, t in enumerate(times)}
        issue = sorted({i for t in changed for i in (place[t], place[t] + 1) if i < len(times)})
        n = (self.revision.get() or (0,))[0] if self.revision.exists() else 0
        for i in issue:
            n += 1
            rate = held[times[i]] - held[times[i - 1]] if i else None
            yield Row(station_id=key[0], at=times[i], level_cm=held[times[i]], rate_cm_h=rate, revision=n)
        self.revision.update((n,))
        self.forget(held, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.forget(self.kept(), timerValues.getCurrentWatermarkInMs() * 1000)
        return iter(())

    def close(self) -> None:
        pass


def rates(levels: DataFrame, delay: str = "2 hours") -> DataFrame:
    """station_id, measured_at, level_cm, rate_cm_h, revision of a stream of readings (measured_at with a zone). Readings older
    than the watermark are left out; of repeated readings the one of a later batch holds, within a batch the highest; readings
    without a level or time are left out."""
    rows = levels.where("level_cm is not null and measured_at is not null").withWatermark("measured_at", delay)
    rows = rows.select("station_id", "measured_at", F.unix_micros("measured_at").alias("at"), "level_cm")
    out = rows.groupBy("station_id").transformWithState(Rates(), "station_id int, at long, level_cm double, rate_cm_h double, revision long", "Update", "EventTime")
    return out.select("station_id", F.timestamp_micros("at").alias("measured_at"), "level_cm", "rate_cm_h", "revision")


def rates_table(levels: DataFrame, target: str, checkpoint: str, delay: str = "2 hours") -> StreamingQuery:
    """The rates as a table with a folder for each day, where a later revision replaces an earlier one."""
    return upsert_stream(rates(levels, delay), target, checkpoint, "revision", ("level_cm", "rate_cm_h", "revision"))
