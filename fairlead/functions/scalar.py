"""Column expressions shared by all operators. Everything here stays inside the JVM."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.constants import DIMS, PEAK_MONTHS

_EXACT_INTEGERS = 9.0e15  # a double beyond 2^53 has no fraction left to round


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_round(x: Column | str, decimals: int, half: float = 0.5) -> Column:
    """Round half up by ``floor(x * 10^n + 0.5) / 10^n``; the same in every IEEE engine."""
    scale = float(10**decimals)
    y = col(x) * F.lit(scale) + F.lit(half)
    whole = F.when(F.abs(y) < _EXACT_INTEGERS, F.floor(y).cast("double")).otherwise(y)
    return whole / F.lit(scale)


def floor_round_sql(x: str, decimals: int, half: float = 0.5) -> str:
    """``floor_round`` as SQL text, for wide projections that are written as text."""
    scale = f"{float(10**decimals)!r}D"
    y = f"(({x}) * {scale} + {half!r}D)"
    return f"if(abs({y}) < {_EXACT_INTEGERS!r}D, cast(floor({y}) as double), {y}) / {scale}"


def round_doubles(df: DataFrame, decimals: int = 6, special: dict[str, int] | None = None,
                  half: float = 0.5) -> DataFrame:
    """Round every double column, so that the order of summation does not show."""
    special = special or {}
    return df.selectExpr(*[
        f"{floor_round_sql(f'`{f.name}`', special.get(f.name, decimals), half)} as `{f.name}`"
        if isinstance(f.dataType, T.DoubleType) else f"`{f.name}`"
        for f in df.schema.fields
    ])


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, null when b is 0 (ANSI mode would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def truncate(x: Column) -> Column:
    """Drop the fraction towards zero, as a long."""
    return x.cast("bigint")


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))


# calendar -----------------------------------------------------------------

def month_start(d: Column | str) -> Column:
    return F.trunc(col(d), "MM")


def month_index(d: Column | str) -> Column:
    """Months since year 0; differences are month distances."""
    return F.year(col(d)) * 12 + F.month(col(d))


def horizon_index(d: Column | str, as_of: Column | str) -> Column:
    """1 for the month of ``as_of``, 2 for the next one."""
    return month_index(d) - month_index(as_of) + 1


def season(d: Column | str) -> Column:
    m = F.month(col(d))
    return (
        F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer").otherwise("Fall")
    )


def quarter_label(d: Column | str) -> Column:
    c = col(d)
    return F.concat(F.lit("Q"), F.quarter(c).cast("string"), F.lit(" "), F.year(c).cast("string"))


def month_label(d: Column | str) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def is_peak(d: Column | str, trade: Column | str, table: dict[str, list[int]] = PEAK_MONTHS) -> Column:
    """Whether the month of ``d`` is a peak month of the trade; unknown trades have none."""
    months = F.create_map(*chain.from_iterable(
        (F.lit(t), F.array(*[F.lit(m) for m in ms])) for t, ms in table.items()))
    listed = F.try_element_at(months, col(trade))
    return F.coalesce(F.array_contains(listed, F.month(col(d))), F.lit(False))


# series keys --------------------------------------------------------------

def series_key(*dims: str) -> Column:
    """The parts joined by "/". A "/" or "%" within a part is written as %2F or %25 and a null part as %0, so every key
    splits into the parts it was made of."""
    part = lambda d: F.coalesce(F.replace(F.replace(F.col(d), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("%0"))
    return F.concat_ws("/", *[part(d) for d in dims or DIMS])


def key_part(key: Column | str, i: int) -> Column:
    part = F.get(F.split(col(key), "/"), i)
    return F.when(part != "%0", F.replace(F.replace(part, F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%")))


def key_depth(key: Column | str) -> Column:
    """Number of separators: 0 for the coarsest level."""
    return F.size(F.split(col(key), "/")) - 1


# display formats ----------------------------------------------------------

def fmt_dollars(x: Column | str) -> Column:
    return F.concat(F.lit("$"), F.format_number(floor_round(x, 0), 0))


def fmt_percent(x: Column | str) -> Column:
    return F.when(col(x).isNotNull(), F.format_string("%.1f%%", floor_round(col(x) * 100.0, 1)))


def fmt_millions(x: Column | str) -> Column:
    return F.concat(F.lit("$"), F.format_number(floor_round(col(x) / 1e6, 1), 1), F.lit("M"))


def fmt_billions(x: Column | str) -> Column:
    return F.when(col(x).isNotNull(), F.format_string("$%.2fB", floor_round(col(x) / 1e9, 2)))


def fmt_thousands(x: Column | str) -> Column:
    return F.format_number(col(x), 0)


# deterministic normal draws -------------------------------------------------

def hashed_uniform(draw: Column, k: int) -> Column:
    """Uniform in (0, 1) from the first 32 bits of md5("draw:k")."""
    digest = F.md5(F.concat(draw.cast("string"), F.lit(f":{k}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def hashed_normal(draw: Column, j: int) -> Column:
    """Standard normal by Box-Muller; the same value wherever and however often it is computed."""
    u1, u2 = hashed_uniform(draw, 2 * j), hashed_uniform(draw, 2 * j + 1)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)
