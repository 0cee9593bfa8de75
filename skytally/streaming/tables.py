"""Streams into tables: envelopes in, measurements and rollups out, each batch written once."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skytally.functions import binary, scalars
from skytally.operators import telemetry as T
from skytally.schema import SERIES_KEY

REQUIRED = ("tenant", "device", "msgId")


def _header(name: str, headers: str = "headers"):
    """The text of the last header of that name, null if there is none."""
    same = F.filter(F.col(headers), lambda h: h["key"] == name)
    return F.try_element_at(same, F.lit(-1))["value"].cast("string")


def envelopes(records: DataFrame) -> DataFrame:
    """Broker records (value, headers, timestamp) as envelopes; ``undecodable`` marks those that lack a required header.

    Receive time comes from the header, else from the broker's timestamp.
    """
    number = lambda name, default: F.coalesce(_header(name).try_cast("int"), F.lit(default))
    nanos = F.coalesce(_header("receivedAtNanos").try_cast("long"), F.unix_micros(F.col("timestamp")) * 1000)
    return records.select(
        _header("tenant").alias("tenant_id"),
        _header("device").alias("device_id"),
        F.coalesce(_header("source"), F.lit("MAVLINK")).alias("source"),
        _header("msgId").try_cast("int").alias("message_id"),
        number("seq", -1).alias("sequence"),
        number("sysId", -1).alias("system_id"),
        number("compId", -1).alias("component_id"),
        nanos.alias("received_at_nanos"),
        F.col("value").alias("payload"),
    ).withColumn("undecodable", F.col("tenant_id").isNull() | F.col("device_id").isNull() | F.col("message_id").isNull())


#: Header names of telemetry records, and the columns they carry.
HEADERS = {"tenant": "tenant_id", "device": "device_id", "source": "source", "msgId": "message_id", "seq": "sequence", "sysId": "system_id", "compId": "component_id", "receivedAtNanos": "received_at_nanos"}


def keyed_records(envelope: DataFrame) -> DataFrame:
    """Envelopes as records for a topic: key (tenant/device, so that a device keeps its order), value (the payload) and
    headers, which let a reader discard a record without decoding it. Null columns give no header."""
    headers = F.filter(F.array(*(F.struct(F.lit(h).alias("key"), F.encode(F.col(c).cast("string"), "UTF-8").alias("value")) for h, c in HEADERS.items())), lambda h: h["value"].isNotNull())
    return envelope.select(scalars.routing_key("tenant_id", "device_id").cast("binary").alias("key"), F.col("payload").alias("value"), headers.alias("headers"))


#: Fixed value: the message that answers a command.
COMMAND_ACK = 77


def acks(envelope: DataFrame) -> DataFrame:
    """The answers to commands among envelopes: tenant_id, device_id, mav_command_id, result, at. All other records go by
    their message id, before a payload is looked at; bytes that a sender cut off at the end are zero."""
    rows = envelope.where(f"NOT undecodable AND source = 'MAVLINK' AND message_id = {COMMAND_ACK}")
    at = F.timestamp_micros(F.floor(F.col("received_at_nanos") / 1000).cast("long"))
    return rows.select("tenant_id", "device_id", binary.read("payload", "u16", 0).cast("int").alias("mav_command_id"), binary.read("payload", "u8", 2).cast("int").alias("result"), at.alias("at"))


IDENTITY = ["tenant_id", "device_id", "message_id", "sequence", "system_id", "component_id", "payload"]


def deduplicated(envelope: DataFrame, window_ns: int = 2_000_000_000, keep_s: float = 60.0) -> DataFrame:
    """Drops repeats of one record within the window; critical messages always pass, and so does everything else however late.

    A record is a repeat if an equal one passed less than the window before it, or was received less than the window after
    it but came first. The state of an identity is the time of the record that passed; it goes ``keep_s`` seconds after the
    last record of the identity, so nothing is lost to a watermark. Identity is compared by its columns, the tenant among
    them, not by a hash of them.
    """
    marked = envelope.withColumn("_critical", scalars.priority("message_id") == "CRITICAL")
    names = envelope.columns

    def step(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("received_at_nanos", kind="stable")
        keep = []
        for at in rows["received_at_nanos"].tolist():
            late = passed is not None and at <= passed - window_ns
            keep.append(passed is None or late or at - passed >= window_ns)
            passed = at if keep[-1] and not late else passed
        state.update((passed,))
        state.setTimeoutDuration(max(1, int(keep_s * 1000)))
        yield rows[keep][names]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in envelope.schema)
    looked = marked.where("NOT _critical").drop("_critical")
    once = looked.groupBy(*IDENTITY).applyInPandasWithState(step, kinds, "passed bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return once.unionByName(marked.where("_critical").drop("_critical"))


def measurements(envelope: DataFrame) -> DataFrame:
    """Decoded measurements of envelopes: time, tenant, device, metric, value."""
    frames = envelope.where("NOT undecodable AND source = 'MAVLINK'")
    time = F.timestamp_micros(F.floor(F.col("received_at_nanos") / 1000).cast("long")).alias("time")
    return binary.metrics(frames).select(time, *SERIES_KEY, "value")


def append_batches(stream: DataFrame, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Appends a stream of measurements to a table by day. Within a day a batch has a folder of its own, named by the stream's
    id (which the checkpoint keeps) and its number, so that a batch that is run again after a failure replaces what it wrote
    before, and nothing that another stream wrote: every record is in the table once. Range queries prune days, and retention
    deletes them. ``store.Store`` has snapshots and compaction besides.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        name = f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"
        out = batch.withColumns({"event_date": F.to_date("time"), "batch": F.lit(name)})
        out = out.repartition("event_date", *SERIES_KEY).sortWithinPartitions("event_date", *SERIES_KEY, F.col("time").desc())
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).options(**options).start()


def write_measurements(rows: DataFrame, path: str) -> None:
    """Appends measurements by day, clustered by series with the newest first, as range queries read them."""
    out = rows.withColumn("event_date", F.to_date("time"))
    # The number of files of a day follows its size: the hash only spreads series, and AQE splits or joins partitions.
    out.repartition("event_date", *SERIES_KEY).sortWithinPartitions(*SERIES_KEY, F.col("time").desc()).write.mode("append").partitionBy("event_date").parquet(path)


def write_rollup(rolled: DataFrame, path: str) -> None:
    """A rollup by day, clustered by series, as range queries read it."""
    out = rolled.withColumn("event_date", F.to_date("bucket")).repartition("event_date", *SERIES_KEY)
    out.sortWithinPartitions("event_date", *SERIES_KEY, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def refresh(spark: SparkSession, source: DataFrame, path: str, level: str, now: datetime) -> None:
    """Recomputes the buckets of a rollup that lie within its refresh horizon, and only those.

    The rollup is partitioned by day. Of the days at the edges, the buckets outside the horizon are kept as they are, so
    data that came too late for the horizon doesn't change them.
    """
    start, end = T.refresh_range(level, now)
    column = "time" if level == "MINUTE" else "bucket"
    part = T.between(source, start, end, column)
    fresh = T.rollup(part) if level == "MINUTE" else T.rollup_up(part)
    fresh = fresh.withColumn("event_date", F.to_date("bucket"))
    try:
        old = spark.read.schema(fresh.schema).parquet(path)
        days = old.where((F.col("event_date") >= F.lit(start).cast("date")) & (F.col("event_date") <= F.lit(end).cast("date")))
        kept = days.where((F.col("bucket") < F.lit(start)) | (F.col("bucket") >= F.lit(end)))
        fresh = fresh.unionByName(kept)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    # Read days are written over: the new ones are complete in a folder beside them first.
    staged = f"{path.rstrip('/')}_staged"
    fresh.write.mode("overwrite").parquet(staged)
    write_rollup(spark.read.parquet(staged).drop("event_date"), path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_expired(spark: SparkSession, path: str, level: str, now: datetime) -> list[str]:
    """Retention: deletes the day folders that lie wholly outside the level's horizon; returns their days."""
    keep = T.RETENTION.get(level)
    if keep is None:
        return []
    cutoff = (now - keep).date()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        day = name.partition("=")[2]
        if name.startswith("event_date=") and day < cutoff.isoformat():
            files.delete(status.getPath(), True)
            gone.append(day)
    return sorted(gone)
