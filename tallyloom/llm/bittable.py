"""A table of bits of fixed length that all workers can hold, put together by the executors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 17  # a block has 2^17 words, one megabyte


def ored(rows: DataFrame, bits_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], words: int) -> np.ndarray:
    """``words`` words of 64 bits, each the OR of what ``bits_of`` gives for it; 8 bytes a word reach the driver."""
    size = min(words, 1 << BLOCK)

    def parts(batches):
        for b in batches:
            word, bits = bits_of(b)
            order = np.argsort(word, kind="stable")
            word, at = np.unique(word[order], return_index=True)
            bits = np.bitwise_or.reduceat(bits[order], at) if len(at) else bits
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64) if x is not bits else x.view(np.int64)) for x in (word // size, word % size, bits)], names=["block", "word", "bits"])

    def dense(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            block, word, bits = (b.column(i).to_numpy() for i in range(3))
            for x in np.unique(block).tolist():
                at = block == x
                np.bitwise_or.at(held.setdefault(x, np.zeros(size, dtype=np.uint64)), word[at], bits[at].view(np.uint64))
        for x, table in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([table.tobytes()], pa.binary())], names=["block", "table"])

    got = rows.mapInArrow(parts, "block long, word long, bits long").repartition("block").mapInArrow(dense, "block long, table binary").toArrow()
    out = np.zeros(words, dtype=np.uint64)
    for x, table in zip(got["block"].to_pylist(), got["table"], strict=True):
        out[x * size : (x + 1) * size] = np.frombuffer(table.as_buffer(), dtype=np.uint64)
    return out
