"""Portable seeded keys.

A draw key is the first 15 hex digits of ``md5('<seed>:<part>:...')`` read as
an unsigned 60-bit integer, so a draw ``mod N`` reaches every row of a table of
any size and is uniform to one part in ``2^60 / N``.  The same value comes out of any SQL engine with
``md5`` and hex parsing, so seeded samples have exact SQL oracles, and the
key depends only on the row's ids — never on partitioning or row order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BITS = 60


def _parts(seed, parts) -> Column:
    cols = [F.lit(str(seed))] + [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def hash_key(seed, *parts) -> Column:
    """Uniform 60-bit non-negative key from the seed and id columns."""
    return F.conv(F.substring(F.md5(_parts(seed, parts)), 1, 15), 16, 10).cast("long")


def draw_index(seed, step, n) -> Column:
    """Integer draw in ``[0, n)`` for a step number (uniform, with replacement)."""
    return F.pmod(hash_key(seed, step), F.lit(n).cast("long") if not isinstance(n, Column) else n)


def sql_hash_key(seed, *exprs: str) -> str:
    """DuckDB / ANSI text of :func:`hash_key` for oracle queries."""
    inner = " || ':' || ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"('0x' || substr(md5({inner}), 1, 15))::BIGINT"
