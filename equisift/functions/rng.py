"""Stateless random numbers: functions of seed, purpose, round and row, so that no result depends on how rows are partitioned."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def uniform(seed: int, tag: str, round_: int | str, row_id: str | Column = "row_id") -> Column:
    """A double in (0, 1) from the first 32 bits of an MD5."""
    row = F.col(row_id) if isinstance(row_id, str) else row_id
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(tag), F.lit(str(round_)), row.cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def uniform_value(seed: int, tag: str, round_: int | str, row_id) -> float:
    """The same for one row."""
    return (int(hashlib.md5(f"{seed}:{tag}:{round_}:{row_id}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def uniform_sql(seed: int, tag: str, round_: int, row_id: str = "row_id") -> str:
    """The same as SQL."""
    return f"((('0x' || substr(md5(concat_ws(':', '{seed}', '{tag}', '{round_}', {row_id}::VARCHAR)), 1, 8))::BIGINT + 0.5) / 4294967296.0)"
