"""Bit maps of fixed size: what may be broadcast to sieve rows early, whatever the input's size.

A set bit means "perhaps"; a fuller map lets more rows through and never loses one, so results don't depend on it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import U


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    b = np.zeros(1 << 16, np.uint8)
    b[pdf["slot"].to_numpy().astype(np.int64)] = 1
    return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [np.packbits(b, bitorder="little").tobytes()]})


def bit_map(hashes: DataFrame, bits: int) -> bytes:
    """Marks the top ``bits`` bits of the well-mixed 64-bit column ``h``: 2**bits bits in all reach the driver."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    parts = hashes.select(F.shiftright(slot, 16).cast("int").alias("part"), slot.bitwiseAND(0xFFFF).alias("slot")).distinct()
    marks = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.groupBy("part").applyInPandas(_pack, "part int, bits binary").toLocalIterator():
        marks[r.part << 13 : (r.part + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return marks.tobytes()


def marked(h: np.ndarray, marks: bytes) -> np.ndarray:
    bytes_ = np.frombuffer(marks, np.uint8)
    slot = (h >> U(64 - len(bytes_).bit_length() - 2)).astype(np.int64)
    return (bytes_[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
