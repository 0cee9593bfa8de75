"""Framing, checksums and field readers, on golden bytes and on damaged links."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skytally.codec import crc, hk, mavlink
from skytally.codec.dialect import CORE_DIALECT, from_xml
from skytally.functions import binary, scalars
from skytally.plans.routing import route
from skytally.sources import binary as sources

from golden import ATT, GPI, HEARTBEAT, HK_LOG, HUD, SYS

FRAMES = bytes.fromhex(HEARTBEAT + GPI + SYS + HUD + ATT)


def test_checksums():
    assert crc.mcrf4xx(b"123456789") == 0x6F91
    assert crc.ccitt_false(b"123456789") == 0x29B1
    assert crc.mcrf4xx(b"6789", crc.mcrf4xx(b"12345")) == 0x6F91


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=20))
def test_chunks_do_not_matter(cuts):
    decoder, got, at = mavlink.Decoder(), [], 0
    for n in cuts:
        got += list(decoder.feed(FRAMES[at : at + n]))
        at += n
    got += list(decoder.feed(FRAMES[at:], end=True))
    assert got == mavlink.decode(FRAMES)[0] and len(got) == 5


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 4))
def test_noise_between_frames_costs_no_frame_after_it(noise, place):
    parts = [bytes.fromhex(h) for h in (HEARTBEAT, GPI, SYS, HUD, ATT)]
    noisy = noise.replace(b"\xfd", b"\0").replace(b"\xfe", b"\0")
    frames, stats = mavlink.decode(b"".join([*parts[:place], noisy, *parts[place:]]))
    assert len(frames) == 5 and stats.resync_bytes == len(noisy)


def test_damaged_checksum_drops_one_frame():
    broken = bytearray(FRAMES)
    broken[30] ^= 0xFF  # in the payload of the second frame
    frames, stats = mavlink.decode(bytes(broken))
    # Of the 40 bytes of the frame, each that was given up is counted.
    assert len(frames) == 4 and stats.crc_errors >= 1 and stats.resync_bytes == len(GPI) // 2


def test_encoder_output_decodes():
    e = mavlink.Encoder(3, 4)
    data = e.v2(0, b"\0" * 9) + e.v2(76, mavlink.command_long(400, [1.0], 3, 1))
    frames, stats = mavlink.decode(data)
    assert stats.decoded == 2 and stats.crc_errors == 0


def test_log_golden_counts():
    records, stats = hk.decode(bytes.fromhex(HK_LOG))
    assert [r[0] for r in records] == [1, 2, 3, 4, 5]
    assert stats.row() == (5, 2, 93, 6)


def test_readers_are_zero_past_the_end(spark):
    row = spark.range(1).select(F.unhex(F.lit("ff7f")).alias("b"))
    got = row.select(*(binary.read("b", k, o).alias(f"{k}{o}") for k in ("u8", "i8", "u16", "i16", "u32", "i32") for o in (0, 1, 5))).first().asDict()
    assert (got["u80"], got["i80"], got["u160"], got["u81"], got["u161"], got["u85"], got["i325"]) == (255, -1, 0x7FFF, 0x7F, 0x7F, 0, 0)


def test_unknown_messages_and_empty_captures_give_no_metrics(spark):
    df = spark.createDataFrame([("a", bytearray(FRAMES)), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    frames = sources.mavlink_frames(spark, df)
    assert frames.count() == 5
    assert binary.metrics(frames).count() == 25


def test_routing_takes_the_coarsest_relation_that_resolves():
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    assert route(start, start + timedelta(hours=1), 500).source == "RAW"
    assert route(start, start + timedelta(days=1), 500).source == "MINUTE"
    assert route(start, start + timedelta(days=30), 500).source == "HOUR"


def test_buckets_are_aligned_to_their_origin(spark):
    row = spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS t")
    assert str(row.select(scalars.time_bucket(7, "t").alias("b")).first().b) == "2024-01-01 00:00:07"  # 108172801 times 7 seconds after 2000-01-03


#: Seeds that the public headers state.
SEEDS = {0: 50, 1: 124, 2: 137, 4: 237, 5: 217, 6: 104, 7: 119, 8: 117, 11: 89, 20: 214, 21: 159, 22: 220, 23: 168, 24: 24, 25: 23, 26: 170, 27: 144, 28: 67, 29: 115, 30: 39, 31: 246, 32: 185, 33: 104, 34: 237, 35: 244, 36: 222, 37: 212, 38: 9, 39: 254, 40: 230, 41: 28, 42: 28, 43: 132, 44: 221, 45: 232, 46: 11, 47: 153, 48: 41, 49: 39, 50: 78, 51: 196, 54: 15, 55: 3, 61: 167, 62: 183, 63: 119, 64: 191, 65: 118, 66: 148, 67: 21, 69: 243, 70: 124, 73: 38, 74: 20, 75: 158, 76: 152, 77: 143, 81: 106, 82: 49, 83: 22, 84: 143, 85: 140, 86: 5, 87: 150, 89: 231, 90: 183, 91: 63, 92: 54, 93: 47, 100: 175, 101: 102, 102: 158, 103: 208, 104: 56, 105: 93, 106: 138, 107: 108, 108: 32, 109: 185, 110: 84, 111: 34, 112: 174, 113: 124, 114: 237, 115: 4, 116: 76, 117: 128, 118: 56, 119: 116, 120: 134, 121: 237, 122: 203, 123: 250, 124: 87, 125: 203, 126: 220, 127: 25, 128: 226, 129: 46, 130: 29, 131: 223, 132: 85, 133: 6, 134: 229, 135: 203, 136: 1, 137: 195, 138: 109, 139: 168, 140: 181, 141: 47, 142: 72, 143: 131, 144: 127, 146: 103, 147: 154, 148: 178, 149: 200, 150: 134, 151: 219, 152: 208, 153: 188, 154: 84, 155: 22, 156: 19, 157: 21, 158: 134, 160: 78, 161: 68, 162: 189, 163: 127, 164: 154, 165: 21, 166: 21, 167: 144, 168: 1, 169: 234, 170: 73, 171: 181, 172: 22, 173: 83, 174: 167, 175: 138, 176: 234, 177: 240, 178: 47, 179: 189, 180: 52, 181: 174, 182: 229, 183: 85, 184: 159, 185: 186, 186: 72, 191: 92, 192: 36, 193: 71, 194: 98, 195: 120, 200: 134, 201: 205, 214: 69, 215: 101, 216: 50, 217: 202, 218: 17, 219: 162, 226: 207, 230: 163, 231: 105, 232: 151, 233: 35, 234: 150, 235: 179, 241: 90, 242: 104, 243: 85, 244: 95, 245: 130, 246: 184, 247: 81, 248: 8, 249: 204, 250: 49, 251: 170, 252: 44, 253: 83, 254: 46, 256: 71, 257: 131, 258: 187, 259: 92, 260: 146, 261: 179, 262: 12, 263: 133, 264: 49, 265: 26, 266: 193, 267: 35, 268: 14, 269: 109, 270: 59, 299: 19, 300: 217, 310: 28, 311: 95, 320: 243, 321: 88, 322: 243, 323: 78, 324: 132, 330: 23, 331: 91, 11000: 134, 11001: 15, 11002: 234, 11003: 64, 11010: 46, 11011: 106, 11020: 205, 11030: 144, 11031: 133, 11032: 85}


def test_seeds_of_the_definitions():
    assert {number: m.seed for number, m in CORE_DIALECT.items()} == SEEDS


def test_a_dialect_from_a_definition_file(tmp_path):
    (tmp_path / "d.xml").write_text("""<mavlink><messages><message id="42000" name="OWN"><field type="uint8_t" name="a">x</field><field type="float[3]" name="b">y</field><extensions/><field type="uint16_t" name="c">z</field></message></messages></mavlink>""")
    own = from_xml(tmp_path / "d.xml")
    assert (own[42000].least, own[42000].most) == (13, 15)
    e = mavlink.Encoder(1, 1, CORE_DIALECT | own)
    frames, stats = mavlink.decode(e.v2(42000, b"x" * 13) + e.v2(0, b"y" * 9), CORE_DIALECT | own)
    assert [f[4] for f in frames] == [42000, 0] and stats.unknown == 0
