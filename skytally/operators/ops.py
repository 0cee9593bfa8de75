"""Operations analytics: duplicates, admission, links, commands and their acknowledgements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skytally.functions.scalars import ack_state, ratio, shed
from skytally.session import materialize, scratch

OPEN_STATES = ("PENDING", "SENT")


def dedup(records: DataFrame, identity: list[str], nanos: str, window_ns: int, arrival: str, exempt: Column | None = None) -> DataFrame:
    """Adds suppressed: whether an equal record passed less than the window ago. The window is fixed at the record that
    passed; a suppressed one doesn't extend it. Exempt records always pass and open no window. Null times come first and
    always pass.

    Identity columns are compared themselves, the tenant among them, not a hash. The records of an identity are sorted by
    time and arrival (with spill) and pass through one task as a stream, which holds only the time of the last that passed.
    """
    exempt = F.lit(False) if exempt is None else exempt
    rows = records.withColumn("_exempt", exempt)
    looked, names = rows.where("NOT _exempt").drop("_exempt"), records.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, passed = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            last = {c: batch.column(c)[-1] for c in identity}
            for c in identity:
                x = batch.column(c)
                y = pa.concat_arrays([pa.array([before[c].as_py() if before else None], x.type), x.slice(0, len(x) - 1)])
                differ = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(x.is_null(), y.is_null()))
                new |= np.asarray(differ)
            if before is None:
                new[0] = True
            before = last
            times, known = np.asarray(pc.fill_null(batch.column(nanos), 0)), np.asarray(batch.column(nanos).is_valid())
            ok = ~known
            starts = np.flatnonzero(new)
            for a, b in zip(np.append(0, starts).tolist(), np.append(starts, len(new)).tolist(), strict=True):
                if a < b and new[a]:
                    passed = None
                at = a + int((~known[a:b]).sum())
                if passed is not None:
                    at += int(np.searchsorted(times[at:b], passed + window_ns))
                while at < b:
                    ok[at], passed = True, int(times[at])
                    at += int(np.searchsorted(times[at:b], passed + window_ns))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(~ok)], [*batch.schema.names, "suppressed"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema), "suppressed boolean"])
    folded = looked.repartition(*identity).sortWithinPartitions(*identity, nanos, arrival).mapInArrow(fold, schema)
    return folded.unionByName(rows.where("_exempt").select(*names, F.lit(False).alias("suppressed")))


def dedup_stats(deduped: DataFrame, exempt: Column) -> DataFrame:
    """passed, suppressed, exempt, and the share suppressed among those that were looked at."""
    n = deduped.agg(F.count_if(~exempt & ~F.col("suppressed")).alias("passed"), F.count_if(F.col("suppressed")).alias("suppressed"), F.count_if(exempt).alias("exempt"))
    return n.withColumn("suppressed_ratio", ratio("suppressed", F.col("passed") + F.col("suppressed")))


def nearest_ranks(df: DataFrame, group: str, value: str, levels: dict[str, float], range_rows: int = 1_000_000) -> DataFrame:
    """Nearest-rank percentiles of each group, and max.

    Equal values are counted before the shuffle. The counts are dealt into ranges of (group, value); how many rows of a group
    lie in the ranges before, one number per range and group, tells in which range a rank falls, and only there it is sought.
    So a group, however large, is the work of many tasks. Null values don't count; a null group is one.
    """
    spark = df.sparkSession
    with scratch(spark):
        counts = materialize(spark, df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n")), "rank-counts")
        parts = max(1, -(-counts.count() // range_rows))
        ranges = counts.repartitionByRange(parts, group, value).withColumn("_part", F.spark_partition_id())
        ranges = materialize(spark, ranges, "rank-ranges")
        sums = ranges.groupBy(F.col(group).alias("_g"), "_part").agg(F.sum("_n").alias("_here"))
        by_group = Window.partitionBy("_g")
        before = F.coalesce(F.sum("_here").over(by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = sums.select("_g", F.col("_part").alias("_p"), before.alias("_before"), "_here", F.sum("_here").over(by_group).alias("_total"), F.max("_part").over(by_group).alias("_last"))
        sought = [F.greatest(F.lit(1), F.ceil(F.col("_total") * q)) for q in levels.values()]
        hit = [(F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_here")) for rank in sought]
        wanted = placed.where(F.array_contains(F.array(*hit, F.col("_p") == F.col("_last")), True))
        rows = ranges.join(wanted, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
        upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = rows.withColumn("_upto", upto).groupBy(group).agg(*(F.min(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col(value))).alias(n) for n, rank in zip(levels, sought, strict=True)), F.max(value).alias("max"))
        return materialize(spark, found, "ranks", keep=True)


def admission(records: DataFrame, priority: str, pressure: str) -> DataFrame:
    """Adds is_shed: what the admission policy does with each record at its pressure."""
    return records.withColumn("is_shed", shed(priority, pressure))


def shed_stats(admitted: DataFrame, priority: str) -> DataFrame:
    """Accepted and shed records by priority, with the share shed."""
    out = admitted.groupBy(priority).agg(F.count_if(~F.col("is_shed")).alias("accepted"), F.count_if(F.col("is_shed")).alias("shed"))
    return out.withColumn("shed_ratio", ratio("shed", F.col("accepted") + F.col("shed")))


def link_registry(frames: DataFrame, registry: DataFrame, mode: str, default_tenant: str = "default") -> DataFrame:
    """Tenant of each frame by its link. open: unknown links belong to the default tenant; closed: they are dropped."""
    joined = frames.join(registry, "link_id", "left" if mode == "open" else "inner")
    return joined.withColumn("tenant_id", F.coalesce("tenant_id", F.lit(default_tenant)))


def outbox_claim(outbox: DataFrame, command: DataFrame, limit: int) -> DataFrame:
    """The oldest unpublished entries with their commands: a top-k by entry id."""
    c = command.select(F.col("id").alias("_cid"), "tenant_id", "device_id")
    return outbox.where(F.col("published_at").isNull()).join(c, F.col("command_id") == F.col("_cid")).drop("_cid").orderBy("id").limit(limit)


def ack_match(acks: DataFrame, commands: DataFrame) -> DataFrame:
    """What each acknowledgement settles: the oldest command of its tenant, device and number that is still open then.

    acks: ack_id, tenant_id, device_id, mav_command_id, result, at. A settled command is closed, so one answers for it at
    most; an acknowledgement that finds nothing open has a null command_id and new_state. Both sides of a key are one
    sequence in order of time (a command goes before an answer of the same time): the n-th answer that finds one settles the
    n-th command. Answers that find none are those at which answers less commands reach a new high.
    """
    keys = ["tenant_id", "device_id", "mav_command_id"]
    open_ = commands.where(F.col("state").isin(*OPEN_STATES))
    blank = {"ack_id": acks.schema["ack_id"].dataType, "result": acks.schema["result"].dataType, "command_id": commands.schema["id"].dataType}
    null = lambda c: F.lit(None).cast(blank[c]).alias(c)
    both = open_.select(*keys, null("ack_id"), null("result"), F.col("id").alias("command_id"), F.col("created_at").alias("at"), F.lit(0).alias("_is_ack"))
    both = both.unionByName(acks.select(*keys, "ack_id", "result", null("command_id"), "at", F.lit(1).alias("_is_ack")))
    so_far = Window.partitionBy(*keys).orderBy("at", "_is_ack", "command_id", "ack_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"_acks": F.sum("_is_ack").over(so_far), "_ahead": F.sum(2 * F.col("_is_ack") - 1).over(so_far)})
    both = both.withColumns({"_missed": F.greatest(F.lit(0), F.max("_ahead").over(so_far)), "_missed_before": F.greatest(F.lit(0), F.coalesce(F.max("_ahead").over(earlier), F.lit(0)))})
    place = F.when(F.col("_is_ack") == 0, F.sum(1 - F.col("_is_ack")).over(so_far)).when(F.col("_missed") == F.col("_missed_before"), F.col("_acks") - F.col("_missed"))
    placed = both.withColumn("_place", place)
    # The command of a place lies in the same key, and so in the same partition: no further shuffle.
    settled = F.max("command_id").over(Window.partitionBy(*keys, "_place"))
    out = placed.withColumn("command_id", F.when(F.col("_place").isNotNull(), settled)).where("_is_ack = 1")
    return out.select("ack_id", *keys, "command_id", F.when(F.col("command_id").isNotNull(), ack_state("result")).alias("new_state"), "at")


def ack_stats(matched: DataFrame, records: DataFrame) -> DataFrame:
    """records_seen, acks_seen, commands_settled, unmatched, and the share of records that are answers."""
    seen = records.agg(F.count("*").alias("records_seen"))
    n = matched.agg(F.count("*").alias("acks_seen"), F.count("command_id").alias("commands_settled"), F.count_if(F.col("command_id").isNull()).alias("unmatched"))
    return seen.crossJoin(n).withColumn("ack_ratio", ratio("acks_seen", "records_seen"))  # one row each


def first_acks(acks: DataFrame) -> DataFrame:
    """By command: the first answer wins."""
    return acks.groupBy("command_id").agg(F.min(F.struct("at", "result")).alias("m")).select("command_id", F.col("m.at").alias("ack_at"), F.col("m.result").alias("ack_result"))


def recent_commands(commands: DataFrame, tenant: str, device: str | None = None, limit: int = 50) -> DataFrame:
    """The newest commands of a tenant; the limit is clamped to 1..500."""
    rows = commands.where(F.col("tenant_id") == tenant)
    rows = rows if device is None else rows.where(F.col("device_id") == device)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(min(max(limit, 1), 500))


def expired_commands(commands: DataFrame, now: Column) -> DataFrame:
    """Open commands whose time is strictly over, with the state they go to."""
    return commands.where(F.col("state").isin(*OPEN_STATES) & (F.col("expires_at") < now)).withColumn("state", F.lit("EXPIRED"))


def open_command_conflicts(commands: DataFrame) -> DataFrame:
    """Keys with more than one open command, where one is allowed."""
    return commands.where(F.col("state").isin(*OPEN_STATES)).groupBy("tenant_id", "device_id", "mav_command_id").agg(F.count("*").alias("open_commands")).where("open_commands > 1")


def duplicate_keys(commands: DataFrame) -> DataFrame:
    """Idempotency keys that were used more than once by a tenant."""
    return commands.groupBy("tenant_id", "idempotency_key").agg(F.count("*").alias("n")).where("n > 1")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The new rows that an insert with "do nothing on conflict" adds: the first of each key that isn't there yet."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.join(existing.select(*keys), keys, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose reference doesn't exist."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def command_view(commands: DataFrame) -> DataFrame:
    """What a client sees of a command: an ack result of -1 is none."""
    return commands.withColumn("ack_result", F.nullif("ack_result", F.lit(-1)))
