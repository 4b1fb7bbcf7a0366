"""Counter-based randomness: a uniform number is a hash of a seed and keys, so results depend on no partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(seed: int | str, *keys: Column) -> Column:
    """Uniform in [0, 1): the first 64 bits of SHA-256 of seed and keys joined by ``|``."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def unit_sql(seed: int | str, *keys: str) -> str:
    """The same number in DuckDB's SQL."""
    text = " || '|' || ".join([f"'{seed}'", *(f"coalesce(cast({k} as varchar), '')" for k in keys)])
    return f"(('0x' || substr(sha256({text}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


def hash_unit(c: Column) -> Column:
    """Uniform of one string: the first 16 hex digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def stable_bit(c: Column) -> Column:
    """The lowest bit of the first byte of SHA-1."""
    return F.conv(F.substring(F.sha1(c.cast("binary")), 1, 2), 16, 10).cast("int") % 2


def replicates(df: DataFrame, reps: int, seed: int, keys: list[str], digits: int) -> DataFrame:
    """Each row once for each replicate, with ``rep`` and ``draw``, some hex digits of its own.

    One SHA-256 of seed, block and keys serves a block of replicates, as many as its 64 digits hold.
    """
    per = 64 // digits
    text = F.concat_ws("|", F.lit(str(seed)), F.col("_block").cast("string"), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // per)))).withColumn("_hex", F.sha2(text, 256))
    each = blocks.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(per - 1)))).withColumn("rep", F.col("_block") * per + F.col("_at")).where(F.col("rep") < reps)
    return each.withColumn("draw", F.substring(F.col("_hex"), F.col("_at") * digits + 1, F.lit(digits))).drop("_block", "_hex", "_at")


def draw_sql(seed: int, keys: list[str], digits: int) -> str:
    """The draw of a row and ``rep`` in SQL."""
    per = 64 // digits
    text = " || '|' || ".join([f"'{seed}'", f"CAST(rep // {per} AS VARCHAR)", *(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)])
    return f"substr(sha256({text}), CAST(rep % {per} * {digits} + 1 AS BIGINT), {digits})"


def poisson_weight(draw: Column) -> Column:
    """A Poisson(1) count from four hex digits, by the inverse of its distribution."""
    return sum(((draw >= c).cast("int") for c in POISSON_STEPS), F.lit(0))


def poisson_sql(draw: str) -> str:
    """The same count in SQL."""
    return "(" + " + ".join(f"CAST({draw} >= '{c}' AS INT)" for c in POISSON_STEPS) + ")"


def _steps() -> list[str]:
    p = total = 0.36787944117144233  # exp(-1)
    out = []
    while (n := round(total * 65536)) < 65536:
        out.append(f"{n:04x}")
        p /= len(out)
        total += p
    return out


POISSON_STEPS = _steps()
