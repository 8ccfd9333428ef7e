"""Reproducible draws: the same value on any engine, however the rows are dealt."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1) from the md5 of the parts, joined by ':'."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(*parts: str) -> str:
    """The SQL twin of uniform(); parts are SQL expressions."""
    joined = " || ':' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"(cast(('0x' || substr(md5({joined}), 1, 8)) as bigint) / 4294967296e0)"
