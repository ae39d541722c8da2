"""Bytes of a binary column as numbers and text. Anything past the end is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def holds(c: Column, at, n) -> Column:
    return (_col(at) >= 0) & (_col(at) + n <= F.length(c))


def slice_of(c: Column, at, n) -> Column:
    return F.when(holds(c, at, n), F.substring(c, _col(at) + 1, _col(n)))


def _number(part: Column) -> Column:
    return F.conv(F.hex(part), 16, 10).cast("long")


def be(c: Column, at, n: int) -> Column:
    """n bytes as a big-endian unsigned number."""
    return _number(slice_of(c, at, n))


def le(c: Column, at, n: int) -> Column:
    """n bytes as a little-endian unsigned number."""
    turned = F.concat(*(F.substring(c, _col(at) + k, F.lit(1)) for k in range(n, 0, -1)))
    return F.when(holds(c, at, n), _number(turned))


def u8(c: Column, at) -> Column:
    return be(c, at, 1)


def narrow(x: Column) -> Column:
    """Numbers above a signed 32-bit one are no number here."""
    return F.when(x <= 2147483647, x).cast("int")


def is_ascii(c: Column, at, text: str) -> Column:
    """False past the end, never null for a binary that isn't."""
    return F.coalesce(slice_of(c, at, len(text)) == F.lit(text.encode()), F.lit(False))


def ascii_of(c: Column, at, n) -> Column:
    return F.decode(slice_of(c, at, n), "ISO-8859-1")
