"""Alerts out of the stream: JSON records by alert key, and delivery to receivers with bounded retries.

An alert is delivered at least once: a batch commits after its deliveries. A receiver that stays down costs its attempts
and is then abandoned for that alert, so that one receiver never holds up the rest.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skytally.session import ship_package

ATTEMPTS, BASE_S, CAP_S = 4, 0.2, 5.0
TIMEOUT_S, AT_ONCE = 10.0, 8


class Permanent(Exception):
    """A delivery that no retry can mend."""


def records(alerts: DataFrame) -> DataFrame:
    """key (rule/device) and value (JSON) of each alert, as a topic takes them."""
    return alerts.select(F.concat_ws("/", "rule_id", "device_id").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"))


def backoff_s(attempt: int, draw: Callable[[], float] = random.random) -> float:
    """The pause after a failed attempt (1 is the first): doubled each time up to the cap, with full jitter."""
    return draw() * min(CAP_S, BASE_S * 2 ** (attempt - 1))


def retryable(status: int) -> bool:
    return status >= 500 or status in (408, 429)


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_args):
        return None


def webhook(url: str, timeout_s: float = TIMEOUT_S) -> Callable[[str, str], None]:
    """A receiver that posts the JSON; raises Permanent for answers that a retry won't change. Redirects aren't followed."""

    def send(key: str, value: str) -> None:
        opener = urllib.request.build_opener(_NoRedirect)  # made where it is used: receivers go to the executors
        request = urllib.request.Request(url, value.encode(), {"Content-Type": "application/json"}, method="POST")
        try:
            with opener.open(request, timeout=timeout_s) as answer:
                status = answer.status
        except urllib.error.HTTPError as e:
            status = e.code
        if not 200 <= status < 300:
            raise (OSError if retryable(status) else Permanent)(f"answered {status}")

    return send


def deliver(key: str, value: str, receivers: dict[str, Callable[[str, str], None]], sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random) -> Counter:
    """Offers one alert to every receiver: counts delivered, retried, rejected (permanent), abandoned, and undecodable."""
    counts: Counter = Counter()
    try:
        json.loads(value)
    except (TypeError, ValueError):
        counts["undecodable"] += 1
        return counts
    for send in receivers.values():
        for attempt in range(1, ATTEMPTS + 1):
            try:
                send(key, value)
                counts["delivered"] += 1
                break
            except Permanent:
                counts["rejected"] += 1
                break
            except OSError:
                if attempt == ATTEMPTS:
                    counts["abandoned"] += 1
                else:
                    counts["retried"] += 1
                    sleep(backoff_s(attempt, draw))
    return counts


def delivered(alerts: DataFrame, receivers: dict[str, Callable[[str, str], None]], at_once: int = AT_ONCE) -> DataFrame:
    """Delivers (key, value) records from the executors and returns what came of it: outcome, n of each partition's batches.

    The alerts of one key go to one partition and out one after the other, in the order of their times; those of different
    keys go out side by side, so many at once. A task that is run again delivers its alerts again.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_key: dict[str, list[str]] = {}
            for key, value in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist(), strict=True):
                by_key.setdefault(key, []).append(value)
            counts: Counter = Counter()
            with ThreadPoolExecutor(at_once) as pool:
                for c in pool.map(lambda kv: [deliver(kv[0], v, receivers) for v in kv[1]], by_key.items()):
                    for one in c:
                        counts.update(one)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["outcome", "n"])

    order = F.get_json_object("value", "$.at_ns").cast("long")
    rows = alerts.select("key", "value").repartition("key").sortWithinPartitions("key", order)
    return rows.mapInArrow(send, "outcome string, n bigint")


def notify(alert_records: DataFrame, receivers: dict[str, Callable[[str, str], None]], checkpoint: str, totals: Counter | None = None, **options: str) -> StreamingQuery:
    """Delivers a stream of (key, value) records; only the counts come to the driver."""
    totals = Counter() if totals is None else totals
    ship_package(alert_records.sparkSession)

    def send(batch: DataFrame, _id: int) -> None:
        totals.update({r["outcome"]: r["n"] for r in delivered(batch, receivers).groupBy("outcome").agg(F.sum("n").alias("n")).collect()})

    return alert_records.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).options(**options).start()
