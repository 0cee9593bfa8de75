"""Chat round trips and media signatures."""

from __future__ import annotations

import hashlib
import struct
import time
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

import pytest

from skytally.llm import chat, media

PIECES = ["<|im_start|>", "<|im_end|>", "<|im_escaped|>", "\n", "\\", "\\n", "<|", "|>", "<\\|", "assistant", "user", "x", ""]
TEXT = st.lists(st.sampled_from(PIECES), max_size=8).map("".join) | st.text(max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_any_conversation_parses_back(turns):
    rendered, spans = chat.round_trip(turns)
    got = chat.parse(rendered)
    assert [x[:2] for x in got] == turns
    assert [rendered[a:b] for a, b in spans] == [x[2] for x in got]


def test_query_shape_equals_brute_force(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yes"), (1, 2, "assistant", None), (2, 0, "system", ""), (3, None, None, "x\\"), (3, 0, "assistant", "<|im_start|>user\n" * 3), (4, 5, "assistant", "long " * 50_000), (4, 5, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "formatted") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(spark, df)).collect()}
    assert set(got) == {1, 2, 3, 4}
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_chat(spark, df.limit(0))).count() == 0


def png(content: bytes = b"abc") -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", content) + chunk(b"IEND", b"")


def test_sniffing_corrects_types_and_carves(spark):
    wav, picture = media.store_wav(b"RIFF" + b"\0" * 60), png()
    rows = [(1, wav, "image/png"), (2, b"junk" + picture + b"BM" + picture, None), (3, picture[:-1], "image/png"), (4, b"", None), (5, None, None), (6, b"GIF89a", "image/gif")]
    got = {r.id: r for r in media.sniff(spark.createDataFrame([(*r, 0) for r in rows], "id long, data binary, declared string, carved int"), "data", "declared").collect()}
    assert [got[i].media_type for i in range(1, 7)] == ["audio/wav", None, None, None, None, None]
    assert got[1].declared_right is False
    assert [(c.type, c.offset, bytes(c.data)) for c in got[2].carved] == [("image/png", 4, picture), ("image/png", 6 + len(picture), picture)]
    assert not got[3].carved and not got[6].carved


def test_payloads_come_back_exactly(spark):
    texts = [None, "", "a", "b" * 64, "c" * 65, "é" * 1000, "RIFF text \x89PNG", "d" * 300_000, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in media.read_media(media.media_table(spark, docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[2][1:] == got[8][1:]


@pytest.mark.parametrize("hit", (b"GIF89aaaaaAaa!a", b"GIF87a" + b"\x01" * 9, b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02", b"\xff\xd8\xff\x00", b"\x89PNG\r\n\x1a\n", png()[:40], b"RIFFaaaaWAVEfmt ", b".snd\0\0\0\x18aaaa", b"BM" * 8))
def test_false_starts_by_the_hundred_thousand_cost_in_proportion(hit):
    data = (hit * (4_000_000 // len(hit) + 1))[:4_000_000]
    a, took = media.automaton(), []
    for n in (500_000, 4_000_000):
        began = time.process_time()
        media.find(a, data[:n])
        took.append(time.process_time() - began)
    assert took[1] < 16 * took[0] + 2


def test_failed_walks_do_not_hide_a_picture():
    gif = b"GIF89a\x01\0\x01\0\0\0\0" + b"!\xfe\x03abc\0" + b",\0\0\0\0\x01\0\x01\0\0\x02\x02L\x01\0;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02a\xff\x00b\xff\xd9"
    for one, kind in ((gif, "image/gif"), (jpeg, "image/jpeg"), (png(), "image/png")):
        cut = one[:-2]
        data = b"".join((cut, one, cut * 3, b"x", one))
        found = media.find(media.automaton(), data)
        assert (kind, len(data) - len(one), len(data)) in found and all(k == kind for k, _, _ in found)
