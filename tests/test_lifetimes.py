"""Lives of sessions, streamed in several micro-batches, against their definition."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomdex.streaming import lifetimes

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
FIELDS = "session_id long, instance_id string, ts timestamp, ends boolean, events long"


def runs(events, timeout):
    """The definition: each event lives until the next of its instance, its lapse, or itself if it ends; overlapping lives are a run."""
    out, by_session = [], {}
    for e in sorted(events, key=lambda e: e[2]):
        by_session.setdefault(e[0], []).append(e)
    for session, own in by_session.items():
        lives = []
        for i, (_, instance, at, ends, n) in enumerate(own):
            following = [e[2] for e in own[i + 1 :] if e[1] == instance]
            lives.append((at, at if ends else min([at + timeout, *following[:1]]), instance, n))
        run = None
        for a, b, instance, n in lives:
            if run and a > run[1]:
                out.append((session, run[0], run[1], run[2], len(run[3])))
                run = None
            run = [a, b, n, {instance}] if run is None else [run[0], max(run[1], b), run[2] + n, run[3] | {instance}]
        out.append((session, run[0], run[1], run[2], len(run[3])))
    return out


@pytest.fixture
def store(spark):
    old = spark.conf.get(lifetimes.STATE_STORE[0])
    spark.conf.set(*lifetimes.STATE_STORE)
    yield
    spark.conf.set(lifetimes.STATE_STORE[0], old)


def streamed(spark, folder, stop_after=None):
    source = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = lifetimes.lifetimes(source, 3600, days=2, delay="2 hours")
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return query


def test_micro_batches_late_events_and_a_restart(spark, store, tmp_path):
    r = random.Random(3)
    events = []
    for i in range(240):
        at = T0 + dt.timedelta(seconds=i * 1800 + r.randrange(900))
        events.append((r.randrange(5), f"i{r.randrange(3)}", at, r.random() < 0.3, 1))
    # a batch is some hours; an event may come a batch late, but within the delay
    batch = [min(5, i // 40 + (r.random() < 0.3 and i % 40 > 37)) for i in range(240)]
    for b in range(6):
        rows = [e for e, own in zip(events, batch) if own == b]
        r.shuffle(rows)
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if b == 2:
            streamed(spark, tmp_path)  # then it ends, and goes on from its checkpoint
    streamed(spark, tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).withColumns({c: F.unix_micros(c) for c in ("started_at", "ended_at")}).collect()
    micros = lambda t: int(t.timestamp() * 1_000_000 + 0.5)
    want = runs([(s, i, micros(t), e, n) for s, i, t, e, n in events], 3_600_000_000)
    mark = max(micros(e[2]) for e in events) - 7_200_000_000
    ended = [w for w in want if w[2] <= mark]
    purged = [w for w in want if w[2] + 2 * 86_400_000_000 <= mark]
    assert len(ended) > 20 and 5 < len(purged) < len(ended)
    rows = lambda status: sorted((g["session_id"], g["started_at"], g["ended_at"], g["events"], g["instances"]) for g in got if g["status"] == status)
    assert rows("ended") == sorted(ended) and rows("purged") == sorted(purged)


def test_the_state_store_is_asked_for(spark):
    events = spark.createDataFrame([], FIELDS)
    if spark.conf.get(lifetimes.STATE_STORE[0]) != lifetimes.STATE_STORE[1]:
        with pytest.raises(ValueError, match="RocksDB"):
            lifetimes.lifetimes(events, 10)


def test_a_session_asks_for_its_state_once():
    import json

    import pandas as pd

    class Kept:
        exists, calls, now = False, [], 0

        @property
        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.exists, self.value = True, value

        def remove(self):
            self.exists = False

        def setTimeoutTimestamp(self, at):
            self.wakes = at

        def getCurrentWatermarkMs(self):
            return self.now

    kept, step = Kept(), lifetimes._lifetime(1_000_000, 5_000_000)
    rows = pd.DataFrame({"at": [2_500_000, 1_000_000, 1_500_000], "instance_id": ["a", "a", "b"], "ends": [False] * 3, "events": [1, 1, 1]})
    assert not list(step((7,), iter([rows]), kept)) and kept.calls == ["update"] and kept.wakes == 1001
    assert len(json.loads(kept.value[0])["held"]) == 3
    kept.now = 3_000
    assert not list(step((7,), iter([]), kept)) and kept.calls == ["update", "get", "update"] and kept.wakes == 3501
    kept.now = 9_000
    out = pd.concat(step((7,), iter([]), kept))
    assert out[["session_id", "status", "events", "instances"]].values.tolist() == [[7, "ended", 3, 2], [7, "purged", 3, 2]] and not kept.exists
