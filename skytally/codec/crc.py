"""The two 16-bit checksums of the wire formats. They share a polynomial, one of them with all bits reflected, so that both
run in the C code of ``binascii``."""

from __future__ import annotations

import binascii

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Every byte with its bits in reverse order.
MIRROR = bytes(int(f"{byte:08b}"[::-1], 2) for byte in range(256))


def _mirror16(crc: int) -> int:
    return MIRROR[crc & 0xFF] << 8 | MIRROR[crc >> 8]


def mcrf4xx(data: bytes, crc: int = 0xFFFF) -> int:
    """Reflected CCITT polynomial, no final xor; pass a previous result to go on from it."""
    return _mirror16(binascii.crc_hqx(bytes(data).translate(MIRROR), _mirror16(crc)))


def ccitt_false(data: bytes, crc: int = 0xFFFF) -> int:
    """CCITT polynomial, most significant bit first."""
    return binascii.crc_hqx(data, crc)


@F.pandas_udf(T.IntegerType())
def crc16_mcrf4xx(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else mcrf4xx(bytes(b))).astype("Int32")


@F.pandas_udf(T.IntegerType())
def crc16_ccitt_false(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else ccitt_false(bytes(b))).astype("Int32")
