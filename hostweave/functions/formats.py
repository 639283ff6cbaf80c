"""Formatters for people, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The units of sizes.
UNITS = ("B", "KB", "MB", "GB", "TB")


def human_bytes(c: Column) -> Column:
    """Base 1024; no decimals below GB, one from there on."""
    n = c.cast("double")
    out = F.format_string("%.1f TB", n / F.lit(1024.0**4))
    for k in (3, 2, 1, 0):
        form = "%.1f" if k >= 3 else "%.0f"
        out = F.when(n < F.lit(1024.0 ** (k + 1)), F.format_string(f"{form} {UNITS[k]}", F.bround(n / F.lit(1024.0**k), 1 if k >= 3 else 0))).otherwise(out)
    return F.when(n == 0, F.lit("0 B")).otherwise(out)


def duration(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return (
        F.when(s < 60, F.format_string("%d s", s))
        .when(s < 3600, F.format_string("%d min", F.floor(s / 60)))
        .otherwise(F.format_string("%d h %d min", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def rank_text(rank: Column) -> Column:
    """A dash for nothing, four decimals from a thousandth on, else an exponent with three decimals."""
    exponent = F.floor(F.log10(rank)).cast("int")
    small = F.concat(F.format_string("%.3f", rank / F.pow(F.lit(10.0), exponent)), F.lit("e"), exponent.cast("string"))
    return F.when(rank.isNull() | (rank == 0), "—").when(rank >= 0.001, F.format_string("%.4f", rank)).otherwise(small)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Slavic plural: 1, 21 one; 2 to 4, 22 few; 5 to 20 many."""
    tens, units = F.abs(n) % 100, F.abs(n) % 10
    return F.when(tens.between(11, 14), many).when(units == 1, one).when(units.between(2, 4), few).otherwise(many)


def metric_label(metric: Column) -> Column:
    return F.when(F.lower(metric) == "harmonic", "Harmonic").otherwise("PageRank")


def file_name(path: Column) -> Column:
    last = F.regexp_extract(path, r"([^/\\]*)\z", 1)
    return F.when(last == "", path).otherwise(last)


def run_status(error: Column, marker: str = "cancelled") -> Column:
    return F.when(error.isNull(), "completed").when(F.contains(error, F.lit(marker)), "cancelled").otherwise("failed")


def plain_decimal(value: float) -> str:
    """A float as digits and a point, never an exponent."""
    from decimal import Decimal

    text = format(Decimal(repr(float(value))), "f")
    return text[:-2] if text.endswith(".0") else text
