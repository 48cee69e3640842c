"""Text-to-number helpers with the semantics of the catalogue's source values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in text. Java's parser alone would also take "1d" or hex.
_FLOAT_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"
_INT_TEXT = r"^\s*[+-]?\d+\s*$"
# 2^27 + 1: splits a double into two halves whose products with 10^n are exact.
_SPLITTER = 134217729.0
_WHOLE_LIMIT = float(2 ** 53)


def truthy_text(c: Column) -> Column:
    """NULL for an empty string, the string itself otherwise."""
    return F.nullif(c, F.lit(""))


def nonzero(c: Column) -> Column:
    """NULL for zero, the number itself otherwise."""
    return F.nullif(c, F.lit(0).cast("double"))


def exact_round(x: Column, digits: int) -> Column:
    """Round a double half-even on its exact binary value.

    ``bround`` looks at the shortest decimal form, so 1234.565 (stored slightly
    above the tie) would go to .56; here it goes to .57. The product with
    10^digits is formed without error from the two halves of ``x``, so its
    distance to the tie has the right sign. Plain arithmetic, hence codegen.
    ``x`` occurs often in it: give a plain column, and compute anything costly
    in a select before.
    """
    scale = float(10 ** digits)
    spread = x * F.lit(_SPLITTER)
    high = spread - (spread - x)
    low = x - high
    near = F.rint(x * F.lit(scale))
    # the exact distance of x * scale from near, less and plus a half; each has the right sign
    above = (high * F.lit(scale) - near - F.lit(0.5)) + low * F.lit(scale)
    below = (high * F.lit(scale) - near + F.lit(0.5)) + low * F.lit(scale)
    odd = F.pmod(near, F.lit(2.0)) == 1.0
    up = (above > 0) | ((above == 0) & odd)
    down = (below < 0) | ((below == 0) & odd)
    # from 2^53 / scale on, doubles lie further apart than the last digit, so x is its own rounding
    rounded = (near + up.cast("double") - down.cast("double")) / F.lit(scale)
    return F.when(F.abs(x) < F.lit(_WHOLE_LIMIT / scale), rounded).otherwise(x)


def is_float_text(c: Column) -> Column:
    return c.rlike(_FLOAT_TEXT)


def is_int_text(c: Column) -> Column:
    return c.rlike(_INT_TEXT)


def parse_float(c: Column) -> Column:
    """Double or NULL; NaN is NULL. Not rounded."""
    value = F.when(is_float_text(c), c.try_cast("double"))
    return F.nanvl(value, F.lit(None).cast("double"))


def safe_float(c: Column) -> Column:
    """Double rounded to two digits; NULL for NaN or text that is no number."""
    return exact_round(parse_float(c), 2)


def safe_int(c: Column) -> Column:
    """Int or NULL: ``' 8 '`` is 8, ``'8.0'`` is NULL.

    The pattern spares the failed cast, which raises and drops an exception per row.
    """
    return F.when(is_int_text(c), c.try_cast("int"))


def safe_long(c: Column) -> Column:
    """As safe_int, with 64 bits."""
    return F.when(is_int_text(c), c.try_cast("bigint"))


def thousandth(c: Column) -> Column:
    """A rounded number in thousands, two digits; zero is NULL. bit/s -> kbit/s, ms -> s."""
    return exact_round(nonzero(c) / F.lit(1000.0), 2)
