"""Keyed streaming state of mandates and holds: small records, those of a shard of keys in one table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskspark.constants import MANDATE_INTERVAL_S
from riskspark.streaming.history import SHARDS, packed, shard_of, unpacked, use_rocks


class MandateProcessor(StatefulProcessor):
    """Execution records of a shard of mandates: last accepted time and count of each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "held binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["us", "attempt_id"], ignore_index=True)
        held = unpacked(self.record.get()[0]) if self.record.exists() else None
        records = dict(zip(held.mandate_id, zip(held["last"].tolist(), held.used.tolist()))) if held is not None else {}
        gaps = {f: int(s * 950_000) for f, s in MANDATE_INTERVAL_S.items()}
        reasons = []
        for mandate, us, expires, status, frequency, amount, ceiling in zip(*(
                new[c].tolist() for c in ("mandate_id", "us", "expires_us", "status", "frequency", "amount", "max_amount"))):
            last, used = records.get(mandate, (None, 0))
            gap = gaps[frequency]
            if us > expires:
                why = "EXPIRED"
            elif status != "ACTIVE" or (frequency == "ONCE" and used):
                why = "NOT_ACTIVE"
            elif amount > ceiling:
                why = "OVER_CEILING"
            elif gap and last is not None and us - last < gap:
                why = "TOO_EARLY"
            else:
                why = None
                records[mandate] = int(us), used + 1
            reasons.append(why)
        if records:
            self.record.update((packed(pd.DataFrame([(m, *r) for m, r in records.items()], columns=["mandate_id", "last", "used"])),))
        yield pd.DataFrame({"mandate_id": new.mandate_id, "attempt_id": new.attempt_id, "us": new.us,
                            "accepted": [w is None for w in reasons], "reject_reason": reasons})

    def close(self) -> None:
        pass


def mandate_stream(attempts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``attempts`` joined with their mandate's terms; the mandates of a shard share a state record."""
    use_rocks(attempts)
    return attempts.withColumn("shard", shard_of("mandate_id", shards)).groupBy("shard").transformWithStateInPandas(
        MandateProcessor(), "mandate_id string, attempt_id bigint, us bigint, accepted boolean, reject_reason string",
        "Append", "None")


class HoldProcessor(StatefulProcessor):
    """A shard of holds that are released or denied by an action, or expired by an event-time timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holds = handle.getValueState("holds", "held binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def _open(self) -> dict:
        if not self.holds.exists():
            return {}
        held = unpacked(self.holds.get()[0])
        return dict(zip(held.hold_id, zip(held.status, held.expires.tolist())))

    def _keep(self, holds: dict) -> None:
        """Store the holds and wake up when the first of them is over."""
        if not holds:
            self.holds.clear()
            return
        self.holds.update((packed(pd.DataFrame([(h, *x) for h, x in holds.items()], columns=["hold_id", "status", "expires"])),))
        first = min(over(x[1]) for x in holds.values())
        if not self.timer.exists() or first < self.timer.get()[0]:
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["us", "seq"], ignore_index=True)
        holds, out = self._open(), []
        for hold, us, action, token_ok, ends in zip(*(new[c].tolist() for c in ("hold_id", "us", "action", "token_ok", "expires_us"))):
            status, expires = holds.get(hold, (None, None))
            if action == "CREATE":
                holds[hold] = "HOLD", int(ends)
            elif status == "HOLD" and us <= expires and token_ok:
                status = "RELEASED" if action == "CONFIRM" else "DENIED"
                holds[hold] = status, expires  # a terminal mark stays until the timer, so that later actions do nothing
                out.append((hold, status))
        self._keep(holds)
        yield pd.DataFrame(out, columns=["hold_id", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        holds, mark = self._open(), timerValues.getCurrentWatermarkInMs()
        out = [(h, "EXPIRED") for h, (status, expires) in holds.items() if over(expires) <= mark and status == "HOLD"]
        self.timer.clear()
        self._keep({h: x for h, x in holds.items() if over(x[1]) > mark})  # nothing about a hold is kept beyond its window
        yield pd.DataFrame(out, columns=["hold_id", "status"])

    def close(self) -> None:
        pass


def over(expires: int) -> int:
    """The first millisecond after the end of a hold."""
    return -(-(expires + 1) // 1000)


def hold_stream(events: DataFrame, delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """``events``: hold_id, ts, us, seq, action (CREATE, CONFIRM, DENY), token_ok, expires_us; the holds of a shard share a state record."""
    use_rocks(events)
    return events.withWatermark("ts", delay).withColumn("shard", shard_of("hold_id", shards)).groupBy("shard").transformWithStateInPandas(
        HoldProcessor(), "hold_id string, status string", "Append", "EventTime")
