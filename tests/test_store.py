"""Stores with snapshots: appends happen once, readers see whole changes, rollups follow what was appended."""

from __future__ import annotations

import random
import threading
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skytally.operators import telemetry as T
from skytally.schema import TELEMETRY
from skytally.streaming import tables
from skytally.streaming.store import Rollups, Store

DAY = datetime(2024, 1, 1)


def rows(n: int, start: datetime = DAY, device: str = "d", metric: str = "m", step_s: int = 60):
    return [(start + timedelta(seconds=i * step_s), "t", device, metric, float(i)) for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Store(spark, f"{tmp_path}/raw", TELEMETRY)


def frame(spark, data):
    return spark.createDataFrame([(t.replace(tzinfo=timezone.utc), *r) for t, *r in data], TELEMETRY)


def run_stream(spark, start, folder: str, checkpoint: str):
    q = start(spark.readStream.schema(TELEMETRY).parquet(folder), checkpoint)
    q.processAllAvailable()
    q.stop()


@pytest.mark.parametrize("kind", ("store", "folders"))
def test_two_streams_and_a_new_checkpoint_lose_nothing(spark, store, tmp_path, kind):
    frame(spark, rows(1, device="a")).write.parquet(f"{tmp_path}/a")
    frame(spark, rows(1, device="b")).write.parquet(f"{tmp_path}/b")
    start = store.stream if kind == "store" else lambda s, c: tables.append_batches(s, f"{tmp_path}/raw", c)
    for folder, checkpoint in (("a", "cp1"), ("b", "cp2"), ("a", "cp1"), ("a", "cp3")):  # the third run finds nothing new
        run_stream(spark, start, f"{tmp_path}/{folder}", f"{tmp_path}/{checkpoint}")
    back = store.read() if kind == "store" else spark.read.parquet(f"{tmp_path}/raw")
    assert sorted(r.device_id for r in back.collect()) == ["a", "a", "b"]


def test_a_batch_that_comes_again_is_left_out(spark, store):
    one = frame(spark, rows(5))
    assert store.append(one, ("s", 0)) and not store.append(one, ("s", 0)) and store.append(one, ("s", 1)) and store.append(one, ("other", 0))
    assert store.read().count() == 15 and store.snapshot()["version"] == 3


def test_writers_at_one_time_all_get_in(spark, store):
    failed = []

    def write(i: int) -> None:
        try:
            store.append(frame(spark, rows(3, device=f"d{i}")), (f"s{i}", 0))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failed and store.read().count() == 18 and store.snapshot()["version"] == 6


def test_compaction_under_a_reader(spark, store):
    for i in range(4):
        store.append(frame(spark, rows(50, DAY + timedelta(minutes=7 * i), device=f"d{i % 2}")))
    store.append(frame(spark, rows(3, DAY + timedelta(days=2))))
    reader = store.read()  # takes its snapshot here
    held = store.snapshot()
    want = sorted(map(tuple, reader.collect()))
    assert store.compact(DAY + timedelta(days=1, hours=1)) == []  # the day ended less than two hours ago
    assert store.compact(DAY + timedelta(days=1, hours=26)) == ["2024-01-01"]
    assert sorted(map(tuple, reader.collect())) == want == sorted(map(tuple, store.read().collect()))
    files = [f for f in store.snapshot()["files"] if f["day"] == "2024-01-01"]
    assert len({f["file"].split("/")[0] for f in files}) == 1 and len(files) <= len([f for f in held["files"] if f["day"] == "2024-01-01"])
    for f in files:  # by series, newest first
        inside = [(r.device_id, r.time) for r in spark.read.parquet(f"{store.path}/data/{f['file']}").collect()]
        assert inside == sorted(inside, key=lambda r: (r[0], -r[1].timestamp()))
    assert store.vacuum(3600) == 0  # still there for readers
    assert store.vacuum(-5) > 0 and store.read().count() == len(want)
    assert store.compact(DAY + timedelta(days=1, hours=26)) == []


def test_a_change_made_from_what_is_gone_is_dropped(spark, store, monkeypatch):
    for i in range(2):
        store.append(frame(spark, rows(5)))
    write = store._write

    def meanwhile(data):
        out = write(data)
        monkeypatch.setattr(store, "_write", write)
        assert store.compact(DAY + timedelta(days=3)) == ["2024-01-01"]  # another compacts first
        return out

    monkeypatch.setattr(store, "_write", meanwhile)
    assert store.compact(DAY + timedelta(days=3)) == []
    assert store.read().count() == 10


def test_files_are_skipped_by_series_and_time(spark, store):
    for device in "abc":
        store.append(frame(spark, rows(20, device=device) + rows(20, DAY + timedelta(days=5), device=device)))
    assert len(store.files("t", "b")) < len(store.files()) and {f["least"][1] for f in store.files("t", "b")} == {"b"}
    assert store.files("u") == [] and store.read("u").count() == 0
    assert {f["day"] for f in store.files("t", "b", None, DAY + timedelta(days=5))} == {"2024-01-06"}
    got = store.read("t", "b", "m", DAY + timedelta(minutes=5), DAY + timedelta(minutes=8)).collect()
    assert sorted(r.value for r in got) == [5.0, 6.0, 7.0]
    assert store.drop_before((DAY + timedelta(days=5)).date()) > 0 and store.read().count() == 60


def test_latest_reads_from_the_newest_day_until_all_are_found(spark, store, monkeypatch):
    for d in range(30):
        store.append(frame(spark, rows(3, DAY + timedelta(days=d), metric="often") + (rows(1, DAY + timedelta(days=d), metric="once") if d == 27 else [])))
    loaded, load = [], store._load
    monkeypatch.setattr(store, "_load", lambda files: loaded.append(sorted({f["day"] for f in files})) or load(files))
    got = {r.metric: (r.time.replace(tzinfo=None), r.value) for r in store.latest("t", "d", DAY, {"often"}).collect()}
    assert got == {"often": (DAY + timedelta(days=29, minutes=2), 2.0)} and loaded == [["2024-01-30"]]
    loaded.clear()
    got = {r.metric: r.value for r in store.latest("t", "d", DAY, {"often", "once"}).collect()}
    assert got == {"often": 2.0, "once": 0.0} and [d for (d,) in loaded] == ["2024-01-30", "2024-01-29", "2024-01-28"]
    assert store.latest("t", "x", DAY, {"often"}).count() == 0


def test_rollups_follow_what_was_appended(spark, store, tmp_path):
    rolled, rng = Rollups(store, f"{tmp_path}/rolled"), random.Random(1)
    now, kept = DAY + timedelta(hours=10, seconds=30), []

    def add(times, device):
        data = [(t, "t", device, "m", float(rng.randrange(1000))) for t in times]
        store.append(frame(spark, data))
        return data

    def check(end):
        """Minutes and hours as one batch job makes them of the rows that came in time."""
        spans = [(level, f, T.refresh_range(level, end)[1]) for level, f in (("MINUTE", rolled.minutes), ("HOUR", rolled.hours))]
        raw = frame(spark, kept)
        minute = T.rollup(raw).where(F.col("bucket") < F.lit(spans[0][2].replace(tzinfo=timezone.utc)))
        want = {"MINUTE": minute, "HOUR": T.rollup_up(minute).where(F.col("bucket") < F.lit(spans[1][2].replace(tzinfo=timezone.utc)))}
        for level, got, _ in spans:
            tidy = lambda df: sorted((r.bucket, r.device_id, round(r.avg_value, 9), r.min_value, r.max_value, r.samples) for r in df.collect())
            assert tidy(got()) == tidy(want[level]), level

    kept += add([now - timedelta(seconds=20 * i) for i in range(400)], "a")  # the last minute is too new as yet
    assert rolled.refresh(now) == {"MINUTE": 1, "HOUR": 1}
    check(now)
    assert rolled.refresh(now)["MINUTE"] in (0, 1)  # what waits may be looked at, but adds nothing
    check(now)
    now += timedelta(minutes=40)
    kept += add([now - timedelta(seconds=45 * i) for i in range(100)], "a") + add([now - timedelta(minutes=90)], "b")
    add([now - timedelta(hours=9)], "b")  # too late for the horizon
    assert rolled.refresh(now)["MINUTE"] == 4
    check(now)
    now += timedelta(minutes=30)
    assert rolled.refresh(now)["MINUTE"] == 1  # only the file whose last minute waited
    check(now)
    now += timedelta(hours=2)
    assert rolled.refresh(now)["MINUTE"] == 0
    check(now)
    assert store.compact(now + timedelta(days=2), rolled.minute.snapshot()["meta"]["seen"]["version"]) == ["2024-01-01"]
    assert rolled.refresh(now)["MINUTE"] == 0
    check(now)


def test_an_empty_store(spark, store, tmp_path):
    assert store.read().count() == 0 and store.files() == [] and store.compact(DAY) == [] and store.vacuum(0) == 0
    assert store.append(frame(spark, []), ("s", 0)) and not store.append(frame(spark, []), ("s", 0))
    assert store.read().count() == 0
    assert Rollups(store, f"{tmp_path}/r").refresh(DAY) == {"MINUTE": 0, "HOUR": 0}
    assert not [p for p in Path(store.path, "manifest").iterdir() if p.name.startswith("_")]
