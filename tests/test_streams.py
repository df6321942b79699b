"""Streams whose outcomes must not depend on files, chunks or failures."""

import datetime as dt
from collections import Counter
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import commits, events, late

START = dt.datetime(2024, 1, 1)


def files(spark, folder, rows, parts):
    """rows, in order, as so many files in the order of their names."""
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/{k:02d}")
    return spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder)).withWatermark("ts", "2 hours")


def test_late_corrections_are_the_same_for_any_split(spark, tmp_path):
    # one key of 30,000 rows, neighbours within two hours swapped, and some small keys
    rows = [(k, START + dt.timedelta(seconds=20 * (k ^ 3)), 1, "a", float(k % 7)) for k in range(30_000)]
    rows += [(50_000 + k, START + dt.timedelta(hours=2 * k), 2 + k % 3, "b", float(k // 6)) for k in range(80)]
    rows.sort(key=lambda r: (r[1] - dt.timedelta(minutes=r[0] % 90), r[0]))  # as they come: up to an hour and a half early or late
    got = {}
    for parts in (1, 3, 10):
        s = files(spark, tmp_path / f"in{parts}", rows, parts).withColumn("known", F.when(F.col("event_id") % 5 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")))
        got[parts] = Counter(tuple(r) for r in events.run_to_end(late.corrections(s), late.ROCKS).collect())
    held, want = {}, Counter()
    last = max(r[1] for r in rows) - dt.timedelta(hours=2)
    for i, ts, user, kind, value in sorted(rows, key=lambda r: (r[1], r[0])):
        if ts < last:
            known = ts - dt.timedelta(days=1) if i % 5 == 0 else ts
            what = late.outcome(held.get((user, kind)), known, value)
            if what in ("inserted", "corrected"):
                held[user, kind] = (known, value)
            want[user, i, what] += 1
    assert got[1] == want == got[3] == got[10]
    assert {w for *_, w in want} == {"inserted", "skipped", "corrected", "out_of_order"}


def test_a_failed_batch_is_pulled_again_once(spark, tmp_path):
    rows = [(k, START + dt.timedelta(minutes=k), k % 4, "a", 1.0) for k in range(90)]
    stream, tries = files(spark, tmp_path / "in", rows, 3), []

    def work(batch, number):
        tries.append(number)
        if number == 1 and tries.count(1) == 1:
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/data/batch={number}")  # what a failed try leaves
            raise RuntimeError("no luck")
        return batch

    out = f"{tmp_path}/out"
    with pytest.raises(Exception, match="no luck"):
        commits.load(stream, out, "event_id", work)
    assert commits.loaded(spark, out).count() == 30 and commits.watermark(spark, out, "long").first().high == 29
    commits.load(stream, out, "event_id", work)
    assert tries == [0, 1, 1, 2]
    assert sorted(r.event_id for r in commits.loaded(spark, out).collect()) == list(range(90))
    commits.load(stream, out, "event_id", work)  # nothing new
    assert len(tries) == 4 and tuple(commits.watermark(spark, out, "long").first()) == (3, 90, 89)


def test_ticks_take_up_after_the_last_commit(spark, tmp_path):
    table = spark.range(0, 260).filter("id % 2 = 0")
    seen = []

    def handle(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        if len(seen) == 2:
            raise RuntimeError("no luck")
        return rows

    with pytest.raises(RuntimeError):
        commits.drain(table, "id", str(tmp_path), 50, handle)
    got = commits.drain(table, "id", str(tmp_path), 50, handle)
    assert seen[1] == seen[2] and [len(x) for x in seen] == [50, 50, 50, 30]
    assert sorted((r.batch, r.id) for r in got.collect()) == [(k // 100, k) for k in range(0, 260, 2)]
    assert commits.tick(table, "id", 258)[1] == 258 and commits.tick(table.limit(0), "id", None)[1] is None


class Memory:
    """One group's state and timers."""

    def __init__(self):
        self.lists, self.timers = {}, []

    def getListState(self, name, schema):  # noqa: N802
        rows = self.lists.setdefault(name, [])
        put = lambda new: (rows.clear(), rows.extend(new))
        return SimpleNamespace(get=lambda: iter(list(rows)), appendList=rows.extend, put=put, clear=rows.clear)

    def listTimers(self):  # noqa: N802
        return iter(list(self.timers))

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)


def test_users_of_one_state_keep_their_own_values_and_ends():
    memory, c = Memory(), late.Corrections(1_000)
    c.init(memory)

    def come(*rows):
        list(c.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["ts", "event_id", "user_id", "event_type", "known", "value"])]), None))

    def close(at):
        assert len(memory.timers) == 1 and memory.timers.pop() <= at
        out = c.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: at), None)
        return [tuple(r) for d in out for r in d.itertuples(index=False)]

    come((3000, 2, 1, "a", 3, 5.0), (2000, 1, 2, "a", 2, 5.0), (1000, 3, 1, None, 1, 5.0), (900_000, 4, 2, "a", 9, 6.0))
    assert close(10) == [(1, 3, "inserted"), (2, 1, "inserted"), (1, 2, "inserted")] and memory.timers == [900]
    come((9000, 5, 1, "a", 9, 5.0))
    assert close(20) == [(1, 5, "skipped")]
    assert close(1005) == [(2, 4, "corrected")]  # the key (1, None) is forgotten, the others not yet
    assert {r[:2] for r in memory.lists["held"]} == {(1, "a"), (2, "a")} and memory.timers == [1009]
    assert close(2500) == [] and not memory.lists["held"] and not memory.timers


def test_neighbouring_users_share_a_group_and_far_ones_do_not(spark, tmp_path):
    s = files(spark, tmp_path / "in", [(1, START, 1, "a", 1.0)], 1).withColumn("known", F.col("ts"))
    assert "shiftright(user_id" in late.corrections(s)._jdf.queryExecution().logical().toString()
