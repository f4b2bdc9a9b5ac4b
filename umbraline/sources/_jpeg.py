"""Dimensions of JPEG images, read from their segment headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StructType

#: Start-of-frame markers: C0 to CF but for C4 (tables), C8 (reserved) and CC (arithmetic).
START_OF_FRAME = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def size_of(blob: bytes | None) -> tuple[int, int] | None:
    if not blob or blob[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(blob):
        if blob[at] != 0xFF:
            at += 1
            continue
        marker = blob[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in START_OF_FRAME and at + 9 <= len(blob):
            height, width = struct.unpack(">HH", blob[at + 5 : at + 9])
            return width, height
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        else:
            at += 2 + struct.unpack(">H", blob[at + 2 : at + 4])[0]
    return None


@pandas_udf(StructType().add("width", IntegerType()).add("height", IntegerType()))
def sizes(blobs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([size_of(b) or (None, None) for b in blobs], columns=["width", "height"]).astype("Int32")
