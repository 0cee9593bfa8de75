"""Columnar framing against a decoder that goes byte by byte; captures in parts, links in chunks."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytally.codec import framing, mavlink
from skytally.codec.crc import mcrf4xx
from skytally.codec.dialect import CORE_DIALECT
from skytally.sources import binary, captures
from skytally.streaming import links

from golden import ATT, GPI, HEARTBEAT, HUD, SYS

KNOWN = framing.known(CORE_DIALECT)


def slowly(data: bytes, end: bool = True) -> tuple[list[int], framing.Stats, int]:
    """Where frames begin, the counters and how far reading came, one byte after the other."""
    at, n, out, s = 0, len(data), [], framing.Stats()
    while at < n:
        head = {0xFD: 10, 0xFE: 6}.get(data[at])
        if head:
            size = head + data[at + 1] + 2 + (13 if head == 10 and data[at + 2] & 1 else 0) if at + head <= n else None
            if size is None or at + size > n:
                if not end:
                    return out, s, at
            else:
                number = int.from_bytes(data[at + 7 : at + 10], "little") if head == 10 else data[at + 5]
                stop = at + head + data[at + 1]
                if number not in CORE_DIALECT:
                    s.unknown += 1
                    at += size
                    continue
                if mcrf4xx(bytes([CORE_DIALECT[number].seed]), mcrf4xx(data[at + 1 : stop])) == int.from_bytes(data[stop : stop + 2], "little"):
                    s.decoded += 1
                    s.signed += head == 10 and data[at + 2] & 1
                    s.v1 += head == 6
                    out.append(at)
                    at += size
                    continue
                s.crc_errors += 1
        at += 1
        s.resync_bytes += 1
    return out, s, n


def hostile(rng: random.Random, parts: int) -> bytes:
    """Frames with anything between them: false starts that claim good frames, cut frames, magic bytes, unknown messages."""
    e1, e2 = mavlink.Encoder(1, 1), mavlink.Encoder(9, 7)
    out = []
    for _ in range(parts):
        kind = rng.randrange(9)
        payload = rng.choice((rng.randbytes(rng.randint(1, 40)), bytes([0xFD] * 20), b"\xfe\x09\x00\x01\x01\x00" * 3))
        good = rng.choice((lambda: e1.v2(0, payload), lambda: e2.v2(33, payload), lambda: e1.v1(74, payload), lambda: e2.v2(30, b"\0" * 9)))()
        if kind < 4:
            out.append(good)
        elif kind == 4:
            out.append(b"\xfd" + bytes([rng.randrange(60), 0, 0, 0, 1, 1, 0, 0, 0]))
        elif kind == 5:
            out.append(good[: rng.randrange(len(good))])
        elif kind == 6:
            out.append(rng.choice((b"\xfe\xfe\xfe", b"\xfd\xfd", rng.randbytes(12), b"\xfe\xff\x00\x00\x00\x00")))
        elif kind == 7:
            out.append(b"\xfd" + bytes([rng.randrange(30), 0, 0, 0, 1, 1, 77, 77, 1]))
        else:
            signed = bytearray(good)
            if signed[0] == 0xFD:
                signed[2] = 1
                signed[-2:] = mcrf4xx(bytes([CORE_DIALECT[int.from_bytes(signed[7:10], "little")].seed]), mcrf4xx(bytes(signed[1:-2]))).to_bytes(2, "little")
                signed += rng.randbytes(13)
            out.append(bytes(signed))
    return b"".join(out)


@pytest.mark.parametrize("many", (0, 64))
def test_columns_equal_the_bytewise_decoder(many, monkeypatch):
    monkeypatch.setattr(framing, "MANY", many)
    rng = random.Random(many)
    false_starts = 0
    for _ in range(300):
        data = hostile(rng, rng.randint(0, 30))
        for end in (True, False):
            want, counted, reached = slowly(data, end)
            stats = framing.Stats()
            frames, done = framing.scan(np.frombuffer(data, np.uint8), KNOWN, end, stats)
            assert (frames.at.tolist(), done, stats.row()) == (want, reached, counted.row())
            false_starts += counted.crc_errors
            payload, at = frames.payloads(np.frombuffer(data, np.uint8))
            for i, a in enumerate(want):
                head = 10 if data[a] == 0xFD else 6
                assert payload[at[i] : at[i + 1]].tobytes() == data[a + head : a + head + data[a + 1]]
    assert false_starts > 100


def test_pieces_and_the_tracker_go_on():
    rng = random.Random(4)
    data = hostile(rng, 3000)
    whole, pieces = framing.Stats(), framing.Stats()
    one = [at + x for at, _, f in framing.stretches(data, KNOWN, whole) for x in f.at.tolist()]
    more = [at + x for at, _, f in framing.stretches(data, KNOWN, pieces, piece=700) for x in f.at.tolist()]
    assert one == more == slowly(data)[0] and whole == pieces and whole.lost > 0 and whole.endpoints == 2


def test_every_cut_knows_its_first_frame():
    rng = random.Random(8)
    # Magic bytes only: chains from different bytes stay apart for long.
    for data in (hostile(rng, 400), b"\xfe\x00\x00\x00\x00\x01" * 500 + hostile(rng, 50), bytes(3000), b"\xfd" * 5000):
        reached, at = [], 0
        c = framing.candidates(np.frombuffer(data, np.uint8), KNOWN)
        step = dict(zip(c.at.tolist(), c.step.tolist(), strict=True))
        while at < len(data):
            reached.append(at)
            at += step.get(at, 1)
        reached.append(at)
        for cut in rng.sample(range(1, len(data)), 60):
            want = next(p for p in reached if p >= cut)
            assert framing.entry(lambda a, b: data[a:b], cut, KNOWN, back=300) == want


def test_speed():
    rng = random.Random(2)
    e = mavlink.Encoder(1, 1)
    data = b"".join(e.v2(33, rng.randbytes(28)) for _ in range(50_000))
    began = time.process_time()
    assert sum(len(f.at) for _, _, f in framing.stretches(data, KNOWN, framing.Stats())) == 50_000
    assert len(data) / (time.process_time() - began) > 5e6  # on a busy machine; some 40 MB a second on a free core


def test_a_capture_in_parts_gives_the_rows_of_the_whole(spark, tmp_path):
    captures.register(spark)
    rng = random.Random(6)
    contents = {"a.bin": hostile(rng, 4000), "b.bin": b"", "c.bin": hostile(rng, 3)}
    (tmp_path / "in").mkdir()
    for name, data in contents.items():
        (tmp_path / "in" / name).write_bytes(data)
    whole = binary.mavlink_frames(spark, binary.captures(spark, f"{tmp_path}/in"))
    want = sorted((r.path[-5:], r.arrival, r.message_id, r.sequence, bytes(r.payload)) for r in whole.collect())
    for split in (997, 20_000, 1 << 20):
        read = spark.read.format("mavlink").option("splitBytes", split).load(f"{tmp_path}/in")
        assert read.rdd.getNumPartitions() == sum(max(1, -(-len(d) // split)) for d in contents.values())
        rows = sorted((r.path[-5:], r.offset, r.message_id, r.sequence, bytes(r.payload)) for r in read.collect())
        assert [(p, *x) for p, _, *x in rows] == [(p, *x) for p, _, *x in want]
        assert [r[1] for r in rows if r[0] == "a.bin"] == slowly(contents["a.bin"])[0]
    with pytest.raises(Exception, match="splitBytes"):
        spark.read.format("mavlink").option("splitBytes", 0).load(f"{tmp_path}/in").collect()


CHUNKS = "link_id string, arrival_seq bigint, chunk binary, eos boolean"


def run_links(spark, tmp_path, batches, **options):
    """One run for each batch: every batch begins after a restart."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(CHUNKS).parquet(f"{tmp_path}/in")
        writer = links.decoded(stream, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        query = writer.trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return spark.read.parquet(f"{tmp_path}/out")


def test_chunks_give_the_frames_of_the_whole_across_restarts(spark, tmp_path):
    rng = random.Random(11)
    whole = {f"link/{i}": hostile(rng, 60) for i in range(5)}
    pending = {k: [d[a : a + 37] for a in range(0, len(d), 37)] for k, d in whole.items()}
    rows, seq = [], 0
    while any(pending.values()):
        link = rng.choice([k for k, v in pending.items() if v])
        chunk = pending[link].pop(0)
        rows.append((link, seq, bytearray(chunk), not pending[link]))
        seq += 1
    third = len(rows) // 3
    out = run_links(spark, tmp_path, [rows[:third], rows[third : 2 * third], rows[2 * third :]], shards=2)
    got = {}
    for r in out.orderBy("arrival_seq").collect():
        got.setdefault(r.link_id, []).append((r.message_id, r.sequence, bytes(r.payload)))
    for link, data in whole.items():
        assert sorted(got[link]) == sorted((f[4], f[1], f[7]) for f in mavlink.decode(data)[0])
    assert out.agg(F.sum("evicted")).first()[0] == 0


def test_the_longest_silent_sender_is_pushed_out_and_counted(spark, tmp_path):
    frames = [bytes.fromhex(h) for h in (HEARTBEAT, GPI, SYS, HUD, ATT)]
    half = lambda i: bytearray(frames[i][:7])
    rest = lambda i: bytearray(frames[i][7:])
    # Three places. a and b hold half a frame; a is heard again, so c and d push out b, not a; then b's rest finds nothing.
    first = [("a", 0, half(0), False), ("b", 1, half(1), False), ("a", 2, bytearray(), None), ("c", 3, half(2), False)]
    second = [(None, 4, half(0), False), ("d", 5, half(3), False), ("a", 6, rest(0), False), ("b", 7, rest(1), False), ("d", 8, rest(3), False), ("c", 9, None, True)]
    out = run_links(spark, tmp_path, [first, second], senders=3, shards=1).orderBy("arrival_seq").collect()
    assert [(r.link_id, r.arrival_seq) for r in out if r.evicted] == [("b", 5), ("c", 7)]
    assert [(r.link_id, r.message_id) for r in out if not r.evicted] == [("a", 0), ("d", 74)]
