"""Scalar functions: each takes a DataFrame and adds or replaces columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Status codes of the Standard Workload Format used for job states.
SWF_STATUS = {"completed": 1, "FAILED": 0, "CANCELLED": 5}


def whole_and_fraction(interval: Column) -> Column:
    """An interval between timestamps in seconds, exact to the microsecond."""
    return interval.cast("interval second").cast("decimal(18,6)")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds as a double, fractions included, whatever the session's zone."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return whole_and_fraction(as_col(end) - as_col(start)).cast("double")


def epoch_of(kind: T.DataType) -> Column:
    """1970-01-01 00:00 UTC as a value of the given timestamp type."""
    if isinstance(kind, T.TimestampNTZType):
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_seconds(F.lit(0))


def naive_utc(instant: Column) -> Column:
    return epoch_of(T.TimestampNTZType()) + (instant - epoch_of(T.TimestampType()))


def instant_utc(naive: Column) -> Column:
    return epoch_of(T.TimestampType()) + (naive - epoch_of(T.TimestampNTZType()))


def parse_timestamps(df: DataFrame, cols: Sequence[str], fmt: str | None = None,
                     errors: str = "raise") -> DataFrame:
    """Text to timestamps. ``errors='coerce'`` turns unreadable text into NULL."""
    if errors not in ("raise", "coerce"):
        raise ValueError(f"errors must be 'raise' or 'coerce', not {errors!r}")
    pattern = [] if fmt is None else [F.lit(fmt)]
    read = F.to_timestamp_ntz if errors == "raise" else None
    changed = {}
    for c in cols:
        if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)):
            changed[c] = F.col(c)
        elif read is not None:
            changed[c] = read(F.col(c), *pattern)
        else:
            changed[c] = F.try_to_timestamp(F.col(c), *pattern).cast("timestamp_ntz")
    return df.withColumns(changed)


def strip_timezone(df: DataFrame, cols: Sequence[str], tz: str | None = None) -> DataFrame:
    """Zone-aware instants to naive UTC.

    With ``tz``, the columns hold naive wall-clock values of that zone; without,
    they hold instants. Both become ``timestamp_ntz`` in UTC.
    """
    if tz is None:
        return df.withColumns({c: naive_utc(F.col(c)) for c in cols})
    return df.withColumns({c: F.convert_timezone(
        F.lit(tz), F.lit("UTC"), F.col(c).cast("timestamp_ntz")) for c in cols})


def wait_time(df: DataFrame, submit: str, start: str, out: str = "wait_time") -> DataFrame:
    return df.withColumn(out, seconds_between(submit, start))


def run_time(df: DataFrame, start: str, end: str, out: str = "run_time") -> DataFrame:
    return df.withColumn(out, seconds_between(start, end))


def time_limit_seconds(df: DataFrame, col: str, strict: bool = True,
                       out: str = "time_limit_sec") -> DataFrame:
    """``[D-]HH:MM[:SS]`` to seconds; two parts mean hours and minutes.

    Text of another shape raises, or gives NULL with ``strict=False``.
    """
    text = F.col(col)
    days = F.split(text, "-")
    clock = F.split(F.element_at(days, -1), ":")

    def number(part: Column) -> Column:
        return part.try_cast("long")

    day_part = F.when(F.size(days) == 2, number(days[0])).when(F.size(days) == 1, F.lit(0).cast("long"))
    second_part = F.when(F.size(clock) == 3, number(F.get(clock, F.lit(2)))).when(
        F.size(clock) == 2, F.lit(0).cast("long"))
    total = (day_part * 86400 + number(clock[0]) * 3600
             + number(F.get(clock, F.lit(1))) * 60 + second_part)
    if strict:
        message = F.concat(F.lit("unreadable time limit: "), F.coalesce(text, F.lit("missing")))
        total = F.coalesce(total, F.raise_error(message).cast("long"))
    return df.withColumn(out, total)


def epoch_relative_submit(df: DataFrame, col: str, out: str = "submit_time") -> DataFrame:
    """Whole seconds since the earliest value of the trace."""
    since_epoch = F.floor(whole_and_fraction(F.col(col) - epoch_of(df.schema[col].dataType))).cast("long")
    first = df.agg(F.min(since_epoch).alias("first")).scalar()
    return df.withColumn(out, since_epoch - first)


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def cast_int_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to integers; text that holds none is an error."""
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


def to_numeric_coerce(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to doubles; text that holds no number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def floating_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities become NULL, in all floating-point columns by default."""
    floating = floating_columns(df)
    chosen = floating if cols is None else [c for c in cols if c in floating]
    return df.withColumns({c: finite(F.col(c)) for c in chosen}) if chosen else df


def fill_missing(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in values.items()})


def safe_ratio(df: DataFrame, num: str, den: str, default: float = -1, out: str = "ratio") -> DataFrame:
    """``num / den`` with a missing numerator read as 0; no usable denominator gives ``default``."""
    return df.withColumn(out, F.coalesce(
        F.try_divide(F.coalesce(F.col(num), F.lit(0.0)), F.nullif(F.col(den), F.lit(0.0))),
        F.lit(float(default))))


def log_target(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Natural logarithm; values without one become NULL."""
    return df.withColumn(out or "log_" + col, F.when(F.col(col) > 0, F.ln(col)))


def exp_prediction(df: DataFrame, col: str = "pred") -> DataFrame:
    return df.withColumn(col, F.exp(col))


def ceil_prediction(df: DataFrame, col: str = "pred") -> DataFrame:
    return df.withColumn(col, F.ceil(col).cast("double"))


def overestimation_factor(df: DataFrame) -> DataFrame:
    """Predicted and requested amounts as multiples of the actual one."""
    return df.withColumns({
        "overestimation_factor": F.try_divide("pred", "act"),
        "user_overestimation_factor": F.try_divide("req", "act"),
    })


def signed_abs_error(df: DataFrame, unit: str = "min") -> DataFrame:
    """``act - pred`` and its size; ``unit`` is ``s``, ``min`` or ``h`` for the size."""
    divisor = {"s": 1.0, "min": 60.0, "h": 3600.0}[unit]
    gap = F.col("act") - F.col("pred")
    return df.withColumns({"error": gap, "abs_error": F.abs(gap) / F.lit(divisor)})


def hours_minutes_units(df: DataFrame, divisors: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Unit changes: ``{new column: (column, divisor)}``."""
    return df.withColumns({out: F.col(c) / F.lit(float(d)) for out, (c, d) in divisors.items()})


def status_code_map(df: DataFrame, col: str, mapping: Mapping[str, int] | None = None,
                    strict_case: bool = False, out: str = "status") -> DataFrame:
    """State text to its code, -1 if unknown; case counts only with ``strict_case``."""
    chosen = SWF_STATUS if mapping is None else mapping
    fold = (lambda s: s) if strict_case else str.lower
    state = F.col(col) if strict_case else F.lower(col)
    pairs = [F.lit(x) for name, code in chosen.items() for x in (fold(name), code)]
    return df.withColumn(out, F.coalesce(
        F.try_element_at(F.create_map(*pairs), state), F.lit(-1)))
