"""The life of coding sessions as a stream: open while an instance lives, ended with the last of them, purged some days later.

An instance lives from an event of it until its next one, or until it says that it ends, or until its heartbeat lapses, ``timeout`` after its last event.  A
session's run ends when none of its instances lives any more, and an event after that begins another run.

Events are held until the watermark has passed them and then taken in the order of their times, so what comes out doesn't depend on the order, or the micro-batches,
in which they came; ends and purges are timers on event time.  State is a run and the held events of each session, on disk by way of the state store, and
a stream that starts anew from its checkpoint goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The setting with which state is on disk.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAYS = 7
ROWS = "session_id {kind}, status string, started_at timestamp, ended_at timestamp, events long, instances long"


def _lifetime(timeout: int, retention: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What a session's rows, or its timer, do.  Times are microseconds; a session's state comes and goes with its rows, so nothing is asked for one by one."""

    def ended(state: dict, now: int, out: list[tuple]) -> None:
        """Close the run if no instance of it lives after ``now``."""
        run = state["run"]
        if run and max(run["until"].values()) <= now:
            done = {"started": run["started"], "ended": max(run["until"].values()), "events": run["events"], "instances": len(run["until"])}
            state["run"] = None
            state["ended"].append(done)
            out.append(("ended", done))

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now = kept.getCurrentWatermarkMs() * 1000
        state = json.loads(kept.get[0]) if kept.exists else {"run": None, "ended": [], "held": []}
        held, fresh = state["held"], False
        for frame in frames:
            fresh = fresh or len(frame) > 0
            held += [[at, instance, bool(ends), events] for at, instance, ends, events in zip(frame["at"].tolist(), frame["instance_id"].tolist(), frame["ends"].tolist(), frame["events"].tolist(), strict=True)]
        if fresh:
            held.sort()
        out: list[tuple] = []
        due = 0
        while due < len(held) and held[due][0] <= now:
            at, instance, ends, events = held[due]
            ended(state, at - 1, out)
            run = state["run"] = state["run"] or {"started": at, "events": 0, "until": {}}
            run["events"] += events
            run["until"][instance] = at if ends else at + timeout
            due += 1
        state["held"] = held[due:]
        ended(state, now, out)
        for run in [r for r in state["ended"] if r["ended"] + retention <= now]:
            state["ended"].remove(run)
            out.append(("purged", run))
        waits = [r[0] for r in state["held"][:1]] + [r["ended"] + retention for r in state["ended"]] + ([max(state["run"]["until"].values())] if state["run"] else [])
        if waits:
            kept.update((json.dumps(state, separators=(",", ":")),))
            kept.setTimeoutTimestamp(max(now // 1000, min(waits) // 1000) + 1)
        elif kept.exists:
            kept.remove()
        if out:
            column = {c: [r[c] for _, r in out] for c in ("started", "ended", "events", "instances")}
            times = {c: pd.to_datetime(column[c], unit="us", utc=True) for c in ("started", "ended")}
            yield pd.DataFrame({"session_id": [key[0]] * len(out), "status": [s for s, _ in out], "started_at": times["started"], "ended_at": times["ended"], "events": column["events"], "instances": column["instances"]})

    return step


def lifetimes(events: DataFrame, timeout_seconds: int, days: int = DAYS, delay: str = "1 hour") -> DataFrame:
    """A stream of ``ROWS`` from one of ``events(session_id, instance_id, ts, ends, events)``: a row when a run of a session has ended, and one when it is purged.

    ``ends`` tells that the instance is done; events later than ``delay`` are left out, as are those without a session, an instance or a time.
    """
    spark = events.sparkSession
    if spark.conf.get(STATE_STORE[0]) != STATE_STORE[1]:
        raise ValueError(f"set {STATE_STORE[0]} to {STATE_STORE[1]}")
    kind = events.schema["session_id"].dataType.simpleString()
    known = events.filter("session_id IS NOT NULL AND instance_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    own = known.select("session_id", F.col("instance_id").cast("string").alias("instance_id"), "ts", F.unix_micros("ts").alias("at"), F.coalesce("ends", F.lit(False)).alias("ends"), F.coalesce("events", F.lit(1)).cast("long").alias("events"))
    step = _lifetime(timeout_seconds * 1_000_000, days * 86_400_000_000)
    return own.groupBy("session_id").applyInPandasWithState(step, ROWS.format(kind=kind), "state string", "append", GroupStateTimeout.EventTimeTimeout)
