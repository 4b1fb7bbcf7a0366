"""Texts that are close to a text of another table: candidates by banded minima, decided by the exact similarity.

Cases: null and empty texts are close to nothing; equal texts are one text during the search; repeated rows give one row;
extra columns are ignored; a text of any length is one row of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import pieces as S
from tallyloom.workspace import Workspace

SIMILAR = 0.8
BANDS, ROWS = 32, 8
WORDS = 8
AT_ONCE = 2000


def signed(texts: DataFrame) -> DataFrame:
    """``tkey``, ``n`` (distinct pieces), ``bands``, ``s0`` ... (bit sketch) of every text; a task signs equal texts once."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            fresh = pa.array([k not in seen and not seen.add(k) for k in b.column(0).to_pylist()], pa.bool_())
            if len(seen) > 500_000:
                seen.clear()
            b = b.filter(fresh)
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                text, h = S.piece_hashes(part.column(1).to_pylist())
                bands, sketch = S.band_digests(text, h, part.num_rows, BANDS, ROWS), S.sketches(text, h, part.num_rows, WORDS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
                cols = [part.column(0), pa.array(np.bincount(text, minlength=part.num_rows).astype(np.int32)), lists, *(pa.array(sketch[:, k]) for k in range(WORDS))]
                yield pa.RecordBatch.from_arrays(cols, names=["tkey", "n", "bands", *(f"s{k}" for k in range(WORDS))])

    return texts.select("tkey", "text").mapInArrow(run, "tkey long, n int, bands array<long>, " + ", ".join(f"s{k} long" for k in range(WORDS)))


def near_keys(left: DataFrame, right: DataFrame, ws: Workspace, least: float = SIMILAR) -> DataFrame:
    """Distinct ``tkey`` of ``left`` (``tkey``, ``text``) whose text has a share of its pieces in a text of ``right``.

    Two texts of similarity 0.8 agree in a band of eight minima with probability 0.17, so in one of 32 bands with 0.997, at
    0.85 with 0.9999; equal texts always meet. Bit sketches drop pairs that are provably not similar enough before any
    text is moved, and the pairs left are decided by all pieces of both texts.
    """
    a, b = (ws.put(signed(df.where("length(text) > 0")), f"signed_{k}") for k, df in (("left", left), ("right", right)))
    in_bands = lambda df, p: df.select(F.explode("bands").alias("band"), F.col("tkey").alias(p)).distinct()
    pairs = ws.put(in_bands(a, "l").join(in_bands(b, "r"), "band").select("l", "r").distinct(), "pairs")
    side = lambda df, p: df.groupBy(F.col("tkey").alias(p)).agg(F.first("n").alias(f"{p}n"), *(F.first(f"s{k}").alias(f"{p}{k}") for k in range(WORDS)))
    miss = lambda x, y: sum((F.bit_count(F.col(f"{x}{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}{k}")))) for k in range(WORDS)), F.lit(0))
    most = F.least(F.col("ln") - miss("l", "r"), F.col("rn") - miss("r", "l")) + 1  # one to spare for pieces of one hash
    may_be = most >= (F.col("ln") + F.col("rn") - most) * least
    kept = ws.put(pairs.join(side(a, "l"), "l").join(side(b, "r"), "r").where(may_be).select("l", "r"), "kept")
    text_of = lambda df, p, x: df.select("tkey", "text").join(kept.select(F.col(p).alias("tkey")).distinct(), "tkey", "left_semi").groupBy(F.col("tkey").alias(p)).agg(F.first("text").alias(x))
    full = kept.join(text_of(left, "l", "x"), "l").join(text_of(right, "r", "y"), "r")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                alike = S.similarities(part.column(1).to_pylist(), part.column(2).to_pylist()) >= least
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(alike))], names=["tkey"])

    return full.select("l", "x", "y").mapInArrow(run, "tkey long").distinct()


def near(left: DataFrame, right: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Distinct ``text`` of ``left`` that have a text of ``right`` with at least the given share of 3-character pieces."""
    ws = Workspace(left.sparkSession)
    keyed = lambda df: df.where("text is not null").select(F.xxhash64("text").alias("tkey"), "text")
    mine = keyed(left)
    return mine.join(near_keys(mine, keyed(right), ws, least), "tkey", "left_semi").select("text").distinct()
