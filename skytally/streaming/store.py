"""Tables by day with snapshots: appends that happen once, compaction that readers don't notice, rollups that follow changes.

A table is a folder of Parquet files and a chain of manifests, JSON files numbered from 1. A manifest lists the table's files
with day, rows, and the least and greatest series and time of each. Whoever changes the table writes files into a folder of
their own first and then puts the next manifest in place; only one writer can have a number, any other looks at the new state
and tries again. Readers take the newest manifest and read its files and no others, so they see all of a change or nothing of
it; files that are listed no more stay for a while, for those who still read them.

A manifest also keeps what goes with its state: which batch of each stream was appended last (a batch that comes again after
a failure is left out; another stream, or the same one from a new checkpoint, has another id), and how far a rollup has come.

The driver holds one line per file. Of a table of many files, compaction makes few.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skytally.functions.scalars import time_bucket
from skytally.operators import telemetry as T
from skytally.schema import SERIES_KEY

#: Days are compacted when they ended so long ago.
COMPACT_AFTER = timedelta(hours=2)
#: Manifests in place at once before a writer gives up; they only collide while others write.
ATTEMPTS = 20


def _micros(t: datetime | date | None) -> int | None:
    if t is None:
        return None
    if not isinstance(t, datetime):
        t = datetime(t.year, t.month, t.day)
    return int((t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t - timedelta()).timestamp() * 1_000_000)


class Conflict(Exception):
    """What a change was made from is not there any more."""


class Store:
    """A table whose rows have a time column and the series key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, time: str = "time"):
        self.spark, self.path, self.schema, self.time = spark, path.rstrip("/"), schema, time
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # Manifests.

    def _fs(self, path: str):
        p = self._hadoop.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def snapshot(self) -> dict[str, Any]:
        """The newest manifest: version, files, streams and meta."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "files": [], "streams": {}, "meta": {}}
        path, fs = self._fs(f"{self.path}/manifest/{versions[-1]:08d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> bool:
        """Puts a manifest in place, unless another has its number. It is complete before it gets its name."""
        made, fs = self._fs(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target, _ = self._fs(f"{self.path}/manifest/{manifest['version']:08d}.json")
        files = self._hadoop.FileContext.getFileContext(fs.makeQualified(made).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(fs.makeQualified(made), fs.makeQualified(target), none)
            return True
        except Exception as refused:
            fs.delete(made, False)
            if "FileAlreadyExists" not in str(refused):
                raise
            return False

    def commit(self, change: Callable[[dict], dict | None]) -> bool:
        """Applies a change to the newest manifest and puts the result in place; again, if another writer was first. A change
        that gives None is not needed any more."""
        for _ in range(ATTEMPTS):
            now = self.snapshot()
            after = change({**now, "files": list(now["files"]), "streams": dict(now["streams"]), "meta": dict(now["meta"])})
            if after is None:
                return False
            if self._put({**after, "version": now["version"] + 1}):
                return True
        raise Conflict(f"{self.path}: others kept writing")

    # Files.

    def _write(self, rows: DataFrame) -> list[dict]:
        """Writes rows by day, by series and with the newest first, and describes the files."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        out = rows.withColumn("event_date", F.to_date(self.time)).repartition("event_date", *SERIES_KEY)
        out.sortWithinPartitions("event_date", *SERIES_KEY, F.col(self.time).desc()).write.partitionBy("event_date").parquet(folder)
        path, fs = self._fs(folder)
        if not any(s.isDirectory() for s in fs.listStatus(path)):
            return []
        key, at = F.struct(*SERIES_KEY), F.unix_micros(F.col(self.time).cast("timestamp"))
        by_file = self.spark.read.parquet(folder).withColumn("_file", F.input_file_name()).groupBy("_file", F.col("event_date").cast("string").alias("day"))
        found = by_file.agg(F.count("*").alias("rows"), F.min(key).alias("least"), F.max(key).alias("greatest"), F.min(at).alias("from"), F.max(at).alias("to")).collect()  # one row per file
        name = folder.rsplit("/", 1)[1]
        return [{"file": f"{name}/{r['_file'].split(f'/{name}/', 1)[1]}", "day": r.day, "rows": r.rows, "least": list(r.least), "greatest": list(r.greatest), "from": r["from"], "to": r["to"]} for r in found]

    def _load(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f['file']}" for f in files))

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None, seen: tuple[dict, dict] | None = None) -> bool:
        """Appends rows; with ``batch`` (a stream's id and the batch's number), unless the stream has come so far already; with
        ``seen`` (what the table has seen of its source, before and after), unless it has gone on from there meanwhile."""
        done = lambda m: batch is not None and m["streams"].get(batch[0], -1) >= batch[1] or seen is not None and m["meta"].get("seen", {}) != seen[0]
        if done(self.snapshot()):
            return False
        files = self._write(rows.select(*(c.split()[0] for c in self.schema.split(", "))))

        def add(m: dict) -> dict | None:
            if done(m):
                return None
            m["files"] += [f | {"version": m["version"] + 1} for f in files]
            m["streams"] |= {batch[0]: batch[1]} if batch else {}
            m["meta"] |= {"seen": seen[1]} if seen else {}
            return m

        return self.commit(add)

    def stream(self, rows: DataFrame, checkpoint: str, **options: str) -> StreamingQuery:
        """Appends a stream. Its batches go by the id that Spark keeps in the checkpoint, so that streams don't meet."""

        def write(batch: DataFrame, number: int) -> None:
            self.append(batch, (batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number))

        return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).options(**options).start()

    def files(self, tenant: str | None = None, device: str | None = None, metric: str | None = None, start: datetime | None = None, end: datetime | None = None, snapshot: dict | None = None) -> list[dict]:
        """The files that may hold rows of a (beginning of a) series key within start <= time < end."""
        key = []
        for part in (tenant, device, metric):
            if part is None:
                break
            key.append(part)
        low, high, n = _micros(start), _micros(end), len(key)
        return [f for f in (snapshot or self.snapshot())["files"] if f["least"][:n] <= key <= f["greatest"][:n] and (low is None or f["to"] >= low) and (high is None or f["from"] < high)]

    def read(self, tenant: str | None = None, device: str | None = None, metric: str | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Rows of the newest snapshot, from the files that may hold them."""
        rows = self._load(self.files(tenant, device, metric, start, end))
        for name, value in zip(SERIES_KEY, (tenant, device, metric), strict=True):
            rows = rows if value is None else rows.where(F.col(name) == value)
        return T.between(rows, start, end, self.time)

    def latest(self, tenant: str, device: str, since: datetime, metrics: set[str]) -> DataFrame:
        """The newest value of each of the metrics: days are read from the newest down until all are found."""
        snapshot, found = self.snapshot(), []
        files = self.files(tenant, device, None, since, None, snapshot)
        for day in sorted({f["day"] for f in files}, reverse=True):
            left = metrics - {r.metric for r in found}
            if not left:
                break
            rows = self._load([f for f in files if f["day"] == day]).where(F.col("metric").isin(sorted(left)))
            found += T.latest(rows, tenant, device, since).collect()  # a row per metric
        return self.spark.createDataFrame(found, "metric string, time timestamp, value double")

    # Upkeep.

    def compact(self, now: datetime, rolled_up_to: int | None = None) -> list[str]:
        """Rewrites each day that ended ``COMPACT_AFTER`` ago and lies in several appends: by series, newest first. With
        ``rolled_up_to``, only appends up to that version, which a rollup has seen. Returns the days."""
        snapshot, days = self.snapshot(), []
        before = (now - COMPACT_AFTER).date().isoformat()
        by_day: dict[str, list[dict]] = {}
        for f in snapshot["files"]:
            if f["day"] < before and (rolled_up_to is None or f["version"] <= rolled_up_to):
                by_day.setdefault(f["day"], []).append(f)
        for day, old in sorted(by_day.items()):
            if len({f["file"].split("/")[0] for f in old}) < 2:
                continue
            new = [f | {"version": max(x["version"] for x in old)} for f in self._write(self._load(old))]
            gone = {f["file"] for f in old}

            def swap(m: dict, new: list[dict] = new, gone: set[str] = gone) -> dict | None:
                if not gone <= {f["file"] for f in m["files"]}:
                    return None  # another has compacted or dropped the day
                m["files"] = [f for f in m["files"] if f["file"] not in gone] + new
                return m

            if self.commit(swap):
                days.append(day)
        return days

    def drop_before(self, day: date) -> int:
        """Takes days out of the table; returns how many files."""
        count = 0

        def drop(m: dict) -> dict | None:
            nonlocal count
            kept = [f for f in m["files"] if f["day"] >= day.isoformat()]
            count = len(m["files"]) - len(kept)
            return m | {"files": kept} if count else None

        self.commit(drop)
        return count

    def vacuum(self, older_s: float) -> int:
        """Deletes folders of data that the newest manifest doesn't list and nobody has written to for so long, and manifests
        before it as old. The time must exceed that of any read, and of any write before its manifest is in place."""
        current = self.snapshot()
        used = {f["file"].split("/")[0] for f in current["files"]}
        limit, gone = datetime.now(timezone.utc).timestamp() * 1000 - older_s * 1000, 0
        for folder, keep in (("data", lambda n: n in used), ("manifest", lambda n: n == f"{current['version']:08d}.json")):
            path, fs = self._fs(f"{self.path}/{folder}")
            for s in fs.listStatus(path) if fs.exists(path) else []:
                if not keep(s.getPath().getName()) and s.getModificationTime() < limit:
                    fs.delete(s.getPath(), True)
                    gone += 1
        return gone


#: Partial aggregates of minutes, which merge, and hours, of which the newest version counts.
PARTIAL = "bucket timestamp, tenant_id string, device_id string, metric string, min_value double, max_value double, samples bigint, sum_value double"
HOURS = "bucket timestamp, tenant_id string, device_id string, metric string, avg_value double, min_value double, max_value double, samples bigint, sum_value double, version bigint"
KEYS = ["bucket", *SERIES_KEY]


class Rollups:
    """Minutes and hours of a store of measurements, kept up by what was appended.

    A refresh reads the files that were appended since the last one, and of older files only the minutes that were then too
    new for the horizon. Their rows give partial aggregates, which are appended; reading merges the partials of a minute.
    The hours that were touched are made again from their minutes and appended as a new version. Rows that come when their
    bucket has left the horizon change nothing. How far a level has come is in its manifest, put in place with its rows.
    """

    def __init__(self, raw: Store, path: str):
        self.raw = raw
        self.minute, self.hour = (Store(raw.spark, f"{path.rstrip('/')}/{n}", s, "bucket") for n, s in (("minute", PARTIAL), ("hour", HOURS)))

    def minutes(self, *scope: Any, **bounds: Any) -> DataFrame:
        merged = self.minute.read(*scope, **bounds).groupBy(*KEYS).agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("samples").alias("samples"), F.sum("sum_value").alias("sum_value"))
        return merged.select(*KEYS, (F.col("sum_value") / F.col("samples")).alias("avg_value"), "min_value", "max_value", "samples", "sum_value")

    def hours(self, *scope: Any, **bounds: Any) -> DataFrame:
        names = ["avg_value", "min_value", "max_value", "samples", "sum_value"]
        newest = F.max_by(F.struct(*names), "version").alias("v")
        return self.hour.read(*scope, **bounds).groupBy(*KEYS).agg(newest).select(*KEYS, *(f"v.{n}" for n in names))

    def _news(self, source: Store, state: dict, end: datetime) -> tuple[list[tuple[dict, int | None]], dict]:
        """Files with rows that a level hasn't seen, each with the time (of buckets) from which on; and the level's next state."""
        snapshot, until = source.snapshot(), _micros(end)
        seen, waiting = state.get("version", 0), state.get("waiting", {})
        news, still = [], {}
        for f in snapshot["files"]:
            since = waiting.get(f["file"])
            if f["version"] > seen or since is not None:
                news.append((f, since))
                if f["to"] >= until:
                    still[f["file"]] = max(until, since or until)
        return news, {"version": snapshot["version"], "waiting": still}

    def _fresh(self, source: Store, news: list[tuple[dict, int | None]], width: int, start: datetime, end: datetime) -> DataFrame:
        """The unseen rows of buckets within the horizon, with the bucket as _b."""
        parts, by_since = None, {}
        for f, since in news:
            by_since.setdefault(since, []).append(f)
        for since, files in by_since.items():
            rows = source._load(files).withColumn("_b", time_bucket(width, source.time))
            rows = rows if since is None else rows.where(F.col("_b") >= F.timestamp_micros(F.lit(since)))
            parts = rows if parts is None else parts.unionByName(rows)
        return T.between(parts, start, end, "_b")

    def refresh(self, now: datetime) -> dict[str, int]:
        """Brings both levels up to ``now``; returns how many files each read."""
        read = {}
        start, end = T.refresh_range("MINUTE", now)
        state = self.minute.snapshot()["meta"].get("seen", {})
        news, after = self._news(self.raw, state, end)
        read["MINUTE"] = len(news)
        if news:
            rows = self._fresh(self.raw, news, 60, start, end)
            partial = rows.groupBy(F.col("_b").alias("bucket"), *SERIES_KEY).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("samples"), F.sum("value").alias("sum_value"))
            self.minute.append(partial, seen=(state, after))
        start, end = T.refresh_range("HOUR", now)
        state = self.hour.snapshot()["meta"].get("seen", {})
        news, after = self._news(self.minute, state, end)
        read["HOUR"] = len(news)
        if news:
            touched = self._fresh(self.minute, news, 3600, start, end).select(F.col("_b").alias("bucket"), *SERIES_KEY).distinct()
            span = touched.agg(F.min("bucket"), F.max("bucket")).first()
            if span[0] is not None:
                minutes = self.minutes(start=span[0], end=span[1] + timedelta(hours=1)).withColumn("_hour", time_bucket(3600, "bucket"))
                changed = minutes.join(touched.withColumnRenamed("bucket", "_hour"), ["_hour", *SERIES_KEY], "left_semi").drop("_hour")
                self.hour.append(T.rollup_up(changed).withColumn("version", F.lit(after["version"])), seen=(state, after))
            else:
                self.hour.commit(lambda m: m | {"meta": m["meta"] | {"seen": after}} if m["meta"].get("seen", {}) == state else None)
        return read
