"""Order-preserving buckets of a number, used to split a sorted group over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BITS = 4096


def order_image(c: Column, kind: str) -> Column:
    """A number whose order follows that of a column of the simple type `kind`; equal for values that are close."""
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind.startswith(("string", "varchar", "char", "binary")):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return c.cast("double")


def order_buckets(c: Column) -> list[Column]:
    """Two integers whose lexicographic order follows the number's order.

    The first joins the signed octave with the leading 12 bits of the mantissa, the second holds
    the next 12 bits, so even values that crowd into a narrow range fall into many buckets.
    """
    v = c.cast("double")
    size = F.abs(v)
    octave = F.floor(F.log2(size))
    part = (size / F.pow(F.lit(2.0), octave) - 1.0) * BITS
    rest = (part - F.floor(part)) * BITS
    sign = F.when(v < 0, F.lit(-1)).otherwise(F.lit(1))
    zero = F.lit(0).cast("long")
    # Octaves start at -1074; the gap of two octaves absorbs rounding at either end of one.
    return [F.when(v == 0, zero).otherwise(sign * ((octave + 1100) * BITS * 2 + F.floor(part))).cast("long"),
            F.when(v == 0, zero).otherwise(sign * F.floor(rest)).cast("long")]
