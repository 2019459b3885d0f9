"""Header checks of JPEG contents (P10).

No image library is available, so a picture is judged by its start, its size header and its dimensions, which is weaker than
decoding it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE_MARKERS = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


def jpeg_size(content: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the frame header, or None if there is none."""
    if content is None or len(content) < 4 or content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(content):
        if content[at] != 0xFF:
            return None
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in SIZE_MARKERS:
            return int.from_bytes(content[at + 7 : at + 9]), int.from_bytes(content[at + 5 : at + 7])
        at += 2 + int.from_bytes(content[at + 2 : at + 4])
    return None


def _status(contents: pd.Series) -> pd.Series:
    def one(c: bytes | None) -> str:
        if c is None:
            return "missing"
        size = jpeg_size(bytes(c))
        return "corrupted" if size is None or min(size) <= 0 else "ok"

    return contents.map(one)


def image_status(content: Column) -> Column:
    """``ok``, ``missing`` (null) or ``corrupted``."""
    return F.pandas_udf(_status, "string")(content)
