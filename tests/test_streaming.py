"""Streams: live alerts equal the batch fold, batches are written once, rollups refresh within their horizon."""

from __future__ import annotations

import http.server
import json
import threading
import time
from collections import Counter
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skytally.rules.batch import alerts
from skytally.rules.model import SECOND, Rule, Staleness, Threshold
from skytally.sources import notify
from skytally.streaming import tables
from skytally.streaming.alerts import Shard, live_alerts

SCHEMA = "tenant_id string, device_id string, metric string, value double, time_ns long, arrival long"
RULES = [Rule("low", "Low", "t", "*", "WARNING", Threshold("battery", "BELOW", 20.0, 30.0), 2 * SECOND, 2 * SECOND)]


def drain(writer, rows: int) -> None:
    """Runs a stream until so many rows are read and written. (Processing-time timeouts make it run on without data, so that
    neither an available-now run nor processAllAvailable would end.)"""
    query, seen, end = writer.start(), {}, time.time() + 100
    while sum(seen.values()) < rows and time.time() < end:
        time.sleep(0.2)
        seen |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
    query.stop()
    assert sum(seen.values()) == rows


def samples(device: str, start: int) -> list[tuple]:
    values = [50, 10, 10, 10, 10, 40, 40, 40, 40, 10]
    return [("t", device, "battery", float(v), (start + i) * SECOND, start + i) for i, v in enumerate(values)]


def test_live_alerts_equal_the_batch_fold(spark, tmp_path):
    rows = samples("d/1", 0) + samples("d/2", 3)
    for i, part in enumerate((rows[:7], rows[7:13], rows[13:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = live_alerts(spark, stream, RULES, tick_s=3600)
    drain(found.writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp"), len(rows))
    live = sorted(map(tuple, spark.table("live").collect()))
    batch = sorted(map(tuple, alerts(spark, spark.createDataFrame(rows, SCHEMA), RULES, "arrival").collect()))
    assert live == batch and len(live) == 4


def test_silence_is_noticed_by_the_fold_without_records(spark):
    from skytally.rules.batch import Fold

    fold = Fold([Rule("gone", "Silent", "t", "*", "CRITICAL", Staleness(20 * SECOND))], "t", "d")
    fold.record(0, {})
    assert fold.tick(20 * SECOND) == []
    assert [a.kind for a in fold.tick(21 * SECOND)] == ["FIRED"]
    assert [a.kind for a in fold.record(22 * SECOND, {})] == ["RESOLVED"]


def test_batches_are_in_the_table_once(spark, tmp_path):
    schema = "time timestamp, tenant_id string, device_id string, metric string, value double"
    hostile = "link\t1\\n/sys'1"
    rows = [(datetime(2024, 1, 1) + timedelta(seconds=i), "t", hostile, "m", float(i)) for i in range(20)]
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        q = tables.append_batches(stream, f"{tmp_path}/table", f"{tmp_path}/cp")
        q.processAllAvailable()
        q.stop()
    back = spark.read.parquet(f"{tmp_path}/table")
    assert back.count() == 20 and back.select("device_id").distinct().first()[0] == hostile


def test_envelopes_take_the_last_header_and_mark_what_lacks_one(spark):
    h = lambda **kw: [(k, v.encode()) for k, v in kw.items()]
    rows = [(b"p", h(tenant="t", device="d", msgId="33", receivedAtNanos="1500") + h(tenant="t2"), datetime(2024, 1, 1)), (b"p", h(tenant="t", msgId="1"), datetime(2024, 1, 1)), (b"p", h(tenant="t", device="d", msgId="x"), datetime(2024, 1, 1)), (b"p", None, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "value binary, headers array<struct<key:string,value:binary>>, timestamp timestamp")
    got = tables.envelopes(df).collect()
    assert (got[0].tenant_id, got[0].message_id, got[0].received_at_nanos, got[0].sequence) == ("t2", 33, 1500, -1)
    assert [bool(r.undecodable) for r in got] == [False, True, True, True]


def test_refresh_changes_only_its_horizon_and_retention_drops_days(spark, tmp_path):
    from skytally.operators import telemetry as T

    now = datetime(2024, 1, 10, 12, 0, 30)
    rows = [(now - timedelta(minutes=m), "t", "d", "m", 1.0) for m in range(0, 400, 5)]
    source = spark.createDataFrame(rows, "time timestamp, tenant_id string, device_id string, metric string, value double")
    path = f"{tmp_path}/minute"
    tables.refresh(spark, source, path, "MINUTE", now)
    start, end = T.refresh_range("MINUTE", now)
    first = spark.read.parquet(path)
    assert first.agg(F.min("bucket"), F.max("bucket")).first()[0] >= start and first.where(F.col("bucket") >= F.lit(end)).count() == 0
    later = now + timedelta(hours=2)
    tables.refresh(spark, source.withColumn("value", F.lit(5.0)), path, "MINUTE", later)
    again = spark.read.parquet(path)
    edge = T.refresh_range("MINUTE", later)[0]
    assert {r.avg_value for r in again.where(F.col("bucket") < F.lit(edge)).collect()} == {1.0}
    assert {r.avg_value for r in again.where(F.col("bucket") >= F.lit(edge)).collect()} == {5.0}
    assert again.groupBy("bucket").count().where("count > 1").count() == 0
    assert tables.drop_expired(spark, path, "MINUTE", now + timedelta(days=89)) == []
    assert tables.drop_expired(spark, path, "MINUTE", now + timedelta(days=92)) == ["2024-01-10"]


def test_delivery_retries_then_abandons():
    pauses: list[float] = []

    def down(_k: str, _v: str) -> None:
        raise OSError("no answer")

    def refused(_k: str, _v: str) -> None:
        raise notify.Permanent("answered 400")

    got: list[str] = []
    counts = notify.deliver("k", "{}", {"a": down, "b": refused, "c": lambda k, v: got.append(v)}, pauses.append, lambda: 1.0)
    assert counts == Counter(retried=3, abandoned=1, rejected=1, delivered=1) and got == ["{}"]
    assert pauses == pytest.approx([0.2, 0.4, 0.8])
    assert notify.deliver("k", "{not json", {"a": down}) == Counter(undecodable=1)
    assert notify.backoff_s(10, lambda: 1.0) == 5.0


def test_webhook_posts_and_judges_answers():
    seen: list[dict] = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            self.send_response(body["answer"])
            self.end_headers()

        def log_message(self, *_args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    send = notify.webhook(f"http://127.0.0.1:{server.server_port}/")
    send("k", '{"answer": 204}')
    for answer in (503, 429, 408):
        with pytest.raises(OSError):
            send("k", json.dumps({"answer": answer}))
    for answer in (400, 302):
        with pytest.raises(notify.Permanent):
            send("k", json.dumps({"answer": answer}))
    server.shutdown()
    assert len(seen) == 6


def fleet(now: list[int]) -> Shard:
    rules = [Rule("gone", "Silent", "t", "*", "CRITICAL", Staleness(10 * SECOND))]
    return Shard(rules, 300 * SECOND, 64, 8, now[0])


def heard(shard: Shard, device: str, at: int) -> list:
    return shard.records(("t", device), pd.DataFrame({"metric": [None], "value": [None], "time_ns": [at]}))


NOW, TWO_HOURS = 1_700_000_000 * SECOND, 7200 * SECOND


def test_a_backlog_suppresses_ticks_of_all_its_devices():
    now = [NOW]
    shard, found = fleet(now), []
    for i in range(20):  # five devices in turn: four of them have no record between two ticks
        heard(shard, f"d{i % 5}", NOW - TWO_HOURS + i * SECOND)
        now[0] += SECOND
        found += shard.tick(now[0], 60)
    assert found == []
    # The backlog runs out, and the devices really are silent.
    for _ in range(2):
        now[0] += SECOND
        found += shard.tick(now[0], 60)
    assert sorted(a.device_id for a in found) == [f"d{i}" for i in range(5)]


def test_current_traffic_and_lag_without_traffic_suppress_nothing():
    now = [NOW]
    shard = fleet(now)
    heard(shard, "old", NOW - TWO_HOURS)
    assert shard.tick(NOW, 60) == []  # consumed just now: this may be a backlog
    assert [a.device_id for a in shard.tick(NOW + SECOND, 60)] == ["old"]
    found = []
    for i in range(15):
        heard(shard, "alive", NOW + i * SECOND)
        found += shard.tick(NOW + i * SECOND, 60)
    for i in range(15, 27):
        found += shard.tick(NOW + i * SECOND, 60)
    assert [a.device_id for a in found] == ["alive"]


def test_a_shard_is_the_same_after_a_restart():
    shard = fleet([NOW])
    heard(shard, "d", NOW)
    again = Shard.load(shard.dump(), [Rule("gone", "Silent", "t", "*", "CRITICAL", Staleness(10 * SECOND))], 300 * SECOND, 64, 8)
    assert again.consumed == 1 and again.newest == NOW
    assert [a.kind for a in again.tick(NOW + 11 * SECOND, 60)] == ["FIRED"]


def test_live_alerts_go_on_from_their_checkpoint(spark, tmp_path):
    rows = samples("d/1", 0)
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        found = live_alerts(spark, stream, RULES, tick_s=3600, shards=2)
        drain(found.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out")).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp"), len(part))
    live = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert live == sorted(map(tuple, alerts(spark, spark.createDataFrame(rows, SCHEMA), RULES, "arrival").collect()))


def test_state_that_a_batch_writes_follows_the_devices_it_brings(spark, tmp_path):
    """A shard of 3000 devices: a batch of one device updates two rows of state, its entry and the shard's totals."""
    fleet_rows = [("t", f"d{i}", "battery", 50.0, i, i) for i in range(3000)]
    written = []
    for i, part in enumerate((fleet_rows, [("t", "d7", "battery", 10.0, 5000, 5000)])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        query = live_alerts(spark, stream, RULES, tick_s=3600, shards=1).writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
        seen, end = 0, time.time() + 100
        while not seen and time.time() < end:
            time.sleep(0.3)
            for p in query.recentProgress:
                if p["numInputRows"]:
                    seen = max(seen, sum(o["numRowsUpdated"] for o in p["stateOperators"]))
        query.stop()
        written.append(seen)
    assert written[0] >= 3000 and 0 < written[1] <= 4


def test_silence_is_noticed_by_the_stream_without_records(spark, tmp_path):
    rules = [Rule("gone", "Silent", "t", "*", "CRITICAL", Staleness(2 * SECOND))]
    now = time.time_ns()
    spark.createDataFrame([("t", "d", None, None, now, 0), ("t", "e", None, None, now + 3600 * SECOND, 1)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    query = live_alerts(spark, stream, rules, tick_s=0.5, shards=1).writeStream.format("memory").queryName("gone").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    end = time.time() + 60
    while not spark.table("gone").count() and time.time() < end:
        time.sleep(0.5)
    query.stop()
    assert {(r.device_id, r.kind) for r in spark.table("gone").collect()} == {("d", "FIRED")}


def test_duplicates_go_and_late_records_stay(spark, tmp_path):
    schema = "tenant_id string, device_id string, source string, message_id int, sequence int, system_id int, component_id int, received_at_nanos bigint, payload binary"
    record = lambda seq, at_s, number=27, tenant="t": (tenant, "d", "MAVLINK", number, seq, 1, 1, int(at_s * SECOND), b"p")
    first = [record(1, 100), record(2, 101), record(1, 101.5), record(4, 160), record(1, 100, tenant="u"), record(0, 100, 0), record(0, 100, 0)]
    second = [record(3, 102), record(4, 161.9), record(4, 162), record(2, 99.5), record(1, 90), record(0, 100, 0)]
    for i, part in enumerate((first, second)):  # the second run goes on from the checkpoint of the first
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        drain(tables.deduplicated(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp"), 2 * len(part))  # both branches read it
    got = sorted((r.tenant_id, r.sequence, r.received_at_nanos / SECOND) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("t", 0, 100.0)] * 3 + [("t", 1, 90.0), ("t", 1, 100.0), ("t", 2, 101.0), ("t", 3, 102.0), ("t", 4, 160.0), ("t", 4, 162.0), ("u", 1, 100.0)]


def test_streamed_tables_are_pruned_and_retained_by_day(spark, tmp_path):
    schema = "time timestamp, tenant_id string, device_id string, metric string, value double"
    rows = [(datetime(2024, 1, 1 + i % 3, 12), "t", f"d{i}", "m", float(i)) for i in range(30)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = tables.append_batches(stream, f"{tmp_path}/table", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    back = spark.read.parquet(f"{tmp_path}/table")
    assert back.where("event_date = DATE'2024-01-02'").count() == 10
    assert len({f.rsplit("/", 3)[1] for f in back.where("event_date = DATE'2024-01-02'").inputFiles()}) >= 1
    assert tables.drop_expired(spark, f"{tmp_path}/table", "RAW", datetime(2024, 1, 9)) == ["2024-01-01"]
    assert spark.read.parquet(f"{tmp_path}/table").count() == 20


def test_delivery_from_the_executors(spark, tmp_path):
    folder = str(tmp_path)

    def write(key: str, value: str) -> None:
        with open(f"{folder}/{key.replace('/', '_')}", "a") as f:
            f.write(json.loads(value)["kind"] + "\n")

    def refuse(_key: str, _value: str) -> None:
        raise notify.Permanent("answered 400")

    rows = [(f"r/d{i % 5}", json.dumps({"kind": kind, "at_ns": at})) for i in range(10) for kind, at in (("RESOLVED", 2), ("FIRED", 1))]
    df = spark.createDataFrame(rows, "key string, value string")
    counts = {r.outcome: r.n for r in notify.delivered(df, {"file": write, "no": refuse}).groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    assert counts == {"delivered": 20, "rejected": 20}
    for i in range(5):
        assert (tmp_path / f"r_d{i}").read_text().split() == ["FIRED"] * 2 + ["RESOLVED"] * 2


def test_keyed_records_read_back_as_envelopes(spark):
    ack = (400).to_bytes(2, "little") + bytes([4])
    rows = [("t", "d/1", "MAVLINK", 77, 3, 1, 1, 1500, ack), ("t", "d/1", "MAVLINK", 77, 4, 1, 1, 2500, ack[:2]), ("t", "d/2", "HK", 77, -1, -1, -1, 5, b"x"), ("t", "d/2", "MAVLINK", 33, 9, 1, 1, 6, bytes(28))]
    schema = "tenant_id string, device_id string, source string, message_id int, sequence int, system_id int, component_id int, received_at_nanos bigint, payload binary"
    df = spark.createDataFrame(rows, schema)
    sent = tables.keyed_records(df)
    assert {bytes(r.key) for r in sent.collect()} == {b"t/d/1", b"t/d/2"}
    back = tables.envelopes(sent.withColumn("timestamp", F.lit(datetime(2024, 1, 1))))
    assert sorted(map(tuple, back.drop("undecodable").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert [tuple(r)[:4] for r in tables.acks(back).orderBy("at").collect()] == [("t", "d/1", 400, 4), ("t", "d/1", 400, 0)]


def test_capture_files(spark, tmp_path):
    from skytally.plans.catalogue import _mavlink_frame
    from skytally.sources import binary as sources

    for i in range(3):
        (tmp_path / f"link-{i}.bin").write_bytes(b"".join(_mavlink_frame(e, e * 0.25) for e in range(100 * i, 100 * i + 100)))
    frames = sources.mavlink_frames(spark, sources.captures(spark, str(tmp_path)))
    assert frames.select("path").distinct().count() == 3
    assert frames.count() == sum(1 for e in range(300) if not (e % 22 == 0 and e % 256 < 200) and e % 19)
