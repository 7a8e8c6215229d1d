"""Small column helpers: local binding, missing strings, safe integers, exact rounding."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`, also inside other lambdas.

    Catalyst inlines a column into a lambda that mentions it, so an expensive expression would
    run once per array element. A lambda variable is not inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    Catalyst may merge a projection into each place that uses it, which repeats expensive work.
    It does not look through a generator, so a one-element explode keeps the value in place.
    """
    others = [F.col(c) for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def present(column) -> Column:
    """The string, or null when it is empty."""
    return F.nullif(column, F.lit(""))


def first_present(*columns) -> Column:
    return F.coalesce(*[present(c) for c in columns])


def safe_int_text(column) -> Column:
    """Integer from text; anything that is not a whole number becomes 0."""
    trimmed = F.trim(column)
    whole = F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), trimmed)
    return F.coalesce(whole.try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_int_number(column) -> Column:
    """Integer from a numeric column, truncated toward zero; null becomes 0."""
    return F.coalesce(column.try_cast("bigint"), F.lit(0).cast("bigint"))


_LIMB = 40
_MASK = (1 << _LIMB) - 1


def _exact_units(value: Column, digits: int) -> Column:
    """`value` >= 0 in units of 10**-digits, rounded half to even on the exact binary value.

    The fraction of a double is taken apart into two 40-bit integers, so no step loses a bit.
    Decimal-digit rounding would differ for values such as 2.675, which is stored below the tie.
    """
    scale = 10**digits
    mask, two_limb = F.lit(_MASK), F.lit(float(1 << _LIMB))
    whole = F.floor(value).cast("bigint")
    shifted = (value - whole) * two_limb
    high = F.floor(shifted).cast("bigint")
    low = F.floor((shifted - F.floor(shifted)) * two_limb).cast("bigint")

    def scaled(limbs: Column) -> Column:
        lower = limbs["low"] * scale
        upper = limbs["high"] * scale + F.shiftright(lower, _LIMB)
        return F.struct(
            F.shiftright(upper, _LIMB).alias("q"),
            upper.bitwiseAND(mask).alias("r_high"),
            lower.bitwiseAND(mask).alias("r_low"),
        )

    def finish(p: Column) -> Column:
        units = whole * F.lit(scale).cast("bigint") + p["q"]
        half = F.lit(1 << (_LIMB - 1))
        above = (p["r_high"] > half) | ((p["r_high"] == half) & (p["r_low"] > 0))
        tie = (p["r_high"] == half) & (p["r_low"] == 0)
        return units + F.when(above | (tie & (F.pmod(units, F.lit(2)) == 1)), 1).otherwise(0)

    limbs = F.struct(high.alias("high"), low.alias("low"))
    return let(let(limbs, scaled), finish)


def round_exact(value: Column, digits: int = 0) -> Column:
    """Round a double half to even on its exact value, for magnitudes below 2**52 / 10**digits."""
    value = value.cast("double")
    size = _exact_units(F.abs(value), digits).cast("double") / F.lit(float(10**digits))
    return F.when(value < 0, -size).otherwise(size)


def format_fixed(value: Column, digits: int) -> Column:
    """Non-negative number as text with a fixed number of decimals."""
    scale = 10**digits

    def render(units: Column) -> Column:
        whole = F.floor(units / F.lit(scale)).cast("string")
        return F.concat(
            whole, F.lit("."), F.lpad(F.pmod(units, F.lit(scale)).cast("string"), digits, "0")
        )

    return let(_exact_units(value.cast("double"), digits), render)
