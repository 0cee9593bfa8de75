"""Byte links as streams of chunks: rows of (link_id, arrival_seq, chunk, eos) become frames, wherever the chunks were cut.

A link is a connection or a sender of datagrams. What a chunk leaves of an unfinished frame waits in the state until the link
goes on; an ``eos`` row ends the link, whose held bytes are then given up one by one, so that frames within them come out, and
whose state goes. Links are dealt into shards by their ids. A shard holds at most ``senders`` links: one more pushes out the
link that was silent longest, with what it held, and each such loss is a row of its own in the result (``evicted``).

State is one map entry per link, in RocksDB: a batch reads and writes only the links that it brings chunks of. Within a batch
a shard's chunks are taken in the order of arrival_seq.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skytally.codec import framing
from skytally.codec.dialect import CORE_DIALECT, Message
from skytally.session import on_rocksdb, ship_package

SENDERS, SHARDS = 4096, 16
COLUMNS = ["link_id", "arrival_seq", "version", "sequence", "system_id", "component_id", "message_id", "incompat", "compat", "payload", "evicted"]
FRAMES = "link_id string, arrival_seq bigint, version int, sequence int, system_id int, component_id int, message_id int, incompat int, compat int, payload binary, evicted int"


class Decode(StatefulProcessor):
    def __init__(self, dialect: dict[int, Message], senders: int):
        self.dialect, self.senders = dialect, senders

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "link_id string", "rest binary, seen bigint")
        self.count = handle.getValueState("count", "links bigint")
        self.known = framing.known(self.dialect)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = pd.concat(list(rows)).sort_values("arrival_seq", kind="stable")
        n = self.count.get()[0] if self.count.exists() else 0
        links: dict[str, tuple[bytes, int]] = {}  # of this batch; the last one to be heard comes last
        stored: list[tuple[int, str]] | None = None  # the others, by when they were heard, once they are needed
        out: list[tuple] = []
        for link, seq, chunk, eos in zip(chunks["link_id"], chunks["arrival_seq"], chunks["chunk"], chunks["eos"], strict=True):
            if link in links:
                rest = links.pop(link)[0]
            elif self.held.containsKey((link,)):
                rest = bytes(self.held.getValue((link,))[0])
            else:
                rest, n = b"", n + 1
                if n > self.senders and not eos:  # a link that ends at once needs no place
                    if stored is None:
                        stored = sorted(((seen, k[0]) for k, (_, seen) in self.held.iterator()), reverse=True)
                    while stored and (stored[-1][1] in links or stored[-1][1] == link or not self.held.containsKey((stored[-1][1],))):
                        stored.pop()
                    lost = stored.pop()[1] if stored else next(iter(links))
                    links.pop(lost, None)
                    if self.held.containsKey((lost,)):
                        self.held.removeKey((lost,))
                    n -= 1
                    out.append((lost, int(seq), *[None] * 8, 1))
            data = rest + (bytes(chunk) if chunk is not None else b"")
            frames, done = framing.scan(np.frombuffer(data, np.uint8), self.known, bool(eos), framing.Stats())
            out += [(link, int(seq), *row[:-2], data[row[-2] : row[-1]], 0) for row in zip(*(c.tolist() for c in frames[1:]), strict=True)]
            if eos:
                n -= 1
                if self.held.containsKey((link,)):
                    self.held.removeKey((link,))
            else:
                links[link] = data[done:], int(seq)
        for link, (rest, seq) in links.items():
            self.held.updateValue((link,), (rest, seq))
        self.count.update((n,))
        if out:
            made = pd.DataFrame(out, columns=COLUMNS)
            yield made.astype({c: "Int32" for c in COLUMNS[2:9]})

    def close(self) -> None:
        pass


def decoded(chunks: DataFrame, dialect: dict[int, Message] | None = None, senders: int = SENDERS, shards: int = SHARDS) -> DataFrame:
    """Frames of a stream of chunks (append mode). Rows without a link id are dropped; a null chunk is empty, a null eos false.

    The number of shards must not change between runs from one checkpoint. Puts the session's new streams on RocksDB, unless
    it names a state store itself.
    """
    ship_package(chunks.sparkSession)
    on_rocksdb(chunks.sparkSession)
    rows = chunks.where("link_id IS NOT NULL").select(F.pmod(F.xxhash64("link_id"), F.lit(shards)).alias("shard"), "link_id", "arrival_seq", "chunk", F.coalesce("eos", F.lit(False)).alias("eos"))
    return rows.groupBy("shard").transformWithStateInPandas(Decode(dialect or CORE_DIALECT, senders), FRAMES, "append", "none")
