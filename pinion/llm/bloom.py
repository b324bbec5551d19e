"""Bloom filters of a fixed size, built by the executors and merged by OR."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pinion.llm.common import U64, mix

SEGMENT = 1 << 16  # bytes of the filter in one shuffled row


class Bloom:
    """bits is a power of two; add() and contains() take arrays of 64-bit hashes."""

    def __init__(self, bits: int, hashes: int, seed: int = 0, data: np.ndarray | None = None):
        self.bits, self.hashes, self.seed = bits, hashes, seed
        self.data = np.zeros(max(1, bits // 8), np.uint8) if data is None else data

    @classmethod
    def sized(cls, items: int, rate: float, seed: int = 0, most_bits: int = 1 << 33) -> Bloom:
        need = max(64, items * -math.log(rate) / math.log(2) ** 2)
        bits = min(most_bits, 1 << math.ceil(math.log2(need)))
        return cls(bits, max(1, min(16, round(bits / max(items, 1) * math.log(2)))), seed)

    def _places(self, h: np.ndarray, j: int) -> np.ndarray:
        a = mix(h.astype(U64) ^ U64((self.seed * 0x9E3779B97F4A7C15 + j * 0xD1B54A32D192ED03) % 2**64))
        return (a & U64(self.bits - 1)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for j in range(self.hashes):
            at = self._places(h, j)
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def contains(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for j in range(self.hashes):
            at = self._places(h, j)
            ok &= (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok


def fill(hashes: DataFrame, empty: Bloom) -> Bloom:
    """Adds all of a one-column DataFrame of longs. Each task sends the parts of its filter that are not empty;
    the driver gets one filter, whose size is that of `empty` whatever the number of rows."""
    bits, n, seed, span = empty.bits, empty.hashes, empty.seed, min(SEGMENT, len(empty.data))

    def part(batches):
        own = Bloom(bits, n, seed)
        for pdf in batches:
            own.add(pdf.iloc[:, 0].to_numpy(np.int64).astype(U64))
        for k in range(0, len(own.data), span):
            if (piece := own.data[k : k + span]).any():
                yield pd.DataFrame({"k": [k], "piece": [piece.tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        all_of = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["piece"]])
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "piece": [all_of.tobytes()]})

    pieces = hashes.na.drop().mapInPandas(part, "k long, piece binary").groupBy("k").applyInPandas(merge, "k long, piece binary")
    out = Bloom(bits, n, seed)
    for row in pieces.toLocalIterator():
        out.data[row["k"] : row["k"] + span] = np.frombuffer(row["piece"], np.uint8)
    return out


#: Bits of a filter that thins out rows before a join: at most 16 MB; beyond that many ids it lets more through, never less.
MOST_THIN_BITS = 1 << 27


def thinning(ids: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test that every value of a one-column DataFrame of longs passes, and few others; its filter is sent once to an executor."""
    bits = 1 << max(16, min(MOST_THIN_BITS, 12 * ids.count()).bit_length())
    filter_ = fill(ids, Bloom(min(bits, MOST_THIN_BITS), 4))
    sent = ids.sparkSession.sparkContext.broadcast(filter_)
    return lambda x: sent.value.contains(x.astype(U64))
