"""Half-even rounding and the text forms of rounded numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_even(value: Column, digits: int = 4) -> Column:
    """Half-even rounding of a double by scale, rint, unscale.

    This is how NumPy rounds. It also avoids the BigDecimal that ``bround`` allocates per row.
    """
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def fixed_text(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded as printf does: half even on the exact binary value.

    Most decimal ties (0.285) are not ties in binary. When the product with the scale looks like a tie, its rounding
    error decides. The error is exact: head and tail are short enough for their own products to be exact.
    """
    scale = F.lit(float(10**digits))
    product = value * scale
    head = value.cast("float").cast("double")
    error = (head * scale - product) + (value - head) * scale
    below = F.floor(product).cast("double")
    tie = product - below == 0.5
    rounded = (
        F.when(tie & (error > 0), below + 1.0).when(tie & (error < 0), below).otherwise(F.rint(product))
    )
    return F.format_string(f"%.{digits}f", rounded / scale)


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(fixed_text(value * F.lit(100.0), digits), F.lit("%"))
