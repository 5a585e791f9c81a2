"""Deterministic, engine-independent randomness.

Spark's ``rand()``/``sample()`` depend on partitioning, so every random choice
here is a function of ``(seed, key)`` through md5: the order key is the hex
digest, and a uniform draw in [0, 1) is its first 32 bits over 2**32.  DuckDB
computes the same numbers, which is what lets the SQL oracle check samples.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_text(seed, *keys) -> Column:
    """``'<seed>|<k1>|<k2>...'`` as one string."""
    parts = [F.lit(str(seed))]
    for k in keys:
        parts += [F.lit("|"), _c(k).cast("string")]
    return F.concat(*parts)


def hash_order(seed, *keys) -> Column:
    """Sort key: md5 hex digest of ``seed|key...`` (ties broken by the key)."""
    return F.md5(seeded_text(seed, *keys))


def uniform(seed, *keys) -> Column:
    """Uniform double in [0, 1) from the first 8 hex digits of the md5."""
    h = F.substring(hash_order(seed, *keys), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(TWO_32)


def sql_uniform(seed, key_sql: str) -> str:
    """The same draw written for DuckDB (used by oracle SQL)."""
    return f"(('0x' || substr(md5('{seed}|' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"


def sql_order(seed, key_sql: str) -> str:
    return f"md5('{seed}|' || CAST({key_sql} AS VARCHAR))"


M32 = 0xFFFFFFFF
GOLDEN32 = 0x9E3779B1
MIX_MUL = 0x45D9F3B


def row_hash32(seed, *keys) -> Column:
    """First 32 bits of ``md5(seed|key...)`` as a bigint (computed once per row)."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("bigint")


def sub_uniform(h32: Column, i: Column) -> Column:
    """Uniform in [0, 1) for position ``i`` of a row whose hash is ``h32``.

    ``x = ((h32 + (i + 1) * 0x9E3779B1) mod 2**32) * 0x45D9F3B mod 2**32``,
    then ``(x xor (x >> 16)) / 2**32``: exact integer arithmetic that DuckDB
    reproduces (``sql_sub_uniform``), far cheaper than an md5 per position.
    One mixing round only: lambdas are evaluated without common-subexpression
    elimination, so every extra round doubles the work.
    """
    x = ((h32 + (i.cast("bigint") + 1) * GOLDEN32).bitwiseAND(M32) * MIX_MUL).bitwiseAND(M32)
    return x.bitwiseXOR(F.shiftright(x, 16)) / F.lit(TWO_32)


def sql_row_hash32(seed, key_sql: str) -> str:
    return f"('0x' || substr(md5('{seed}|' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT"


def sql_sub_uniform(h32_sql: str, i_sql: str) -> str:
    """DuckDB form of ``sub_uniform`` (``i_sql`` 0-based)."""
    x = f"(((({h32_sql} + ({i_sql} + 1) * {GOLDEN32}) & {M32}) * {MIX_MUL}) & {M32})"
    return f"(xor({x}, ({x} >> 16)) / 4294967296.0)"
