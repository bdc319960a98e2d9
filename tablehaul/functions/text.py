"""Sizes, durations and messages as people read them.

Byte counts are rounded in whole numbers, half to even, so the text never
depends on how a floating-point value happens to print.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB = 1024
MB = 1024 * 1024
GB = 1024 * 1024 * 1024

# Error texts when a failed process said nothing.
IMPORT_SILENT = "Process exited with error (no stderr output)"
EXPORT_SILENT = "Process exited with error"


def scaled(count: Column, unit: int, digits: int) -> Column:
    """``count / unit`` in steps of ``10**-digits``, as a whole number, half to even."""
    count = count.cast("bigint")
    step = 10**digits
    rest = F.pmod(count, F.lit(unit)) * step
    part = F.call_function("div", rest, F.lit(unit).cast("bigint"))
    left = F.pmod(rest, F.lit(unit))
    up = (left * 2 > unit) | ((left * 2 == unit) & (F.pmod(part, F.lit(2)) == 1))
    return F.call_function("div", count, F.lit(unit).cast("bigint")) * step + part + up.cast("bigint")


def fixed(steps: Column, digits: int, commas: bool = False) -> Column:
    """A whole number of ``10**-digits`` steps as decimal text."""
    step = F.lit(10**digits).cast("bigint")
    whole = F.call_function("div", steps, step)
    head = F.format_number(whole, 0) if commas else whole.cast("string")
    return F.concat(head, F.lit("."), F.lpad(F.pmod(steps, step).cast("string"), digits, "0"))


def format_bytes(count: Column) -> Column:
    """``500 B``, ``1.50 KB``, ``1.00 MB``, ``1.00 GB (1,024.00 MB)``."""
    mb_text = fixed(scaled(count, MB, 2), 2, commas=True)
    return (
        F.when(count < KB, F.concat(count.cast("string"), F.lit(" B")))
        .when(count < MB, F.concat(fixed(scaled(count, KB, 2), 2), F.lit(" KB")))
        .when(count < GB, F.concat(fixed(scaled(count, MB, 2), 2), F.lit(" MB")))
        .otherwise(F.concat(fixed(scaled(count, GB, 2), 2), F.lit(" GB ("), mb_text, F.lit(" MB)")))
    )


def format_bytes_compact(count: Column) -> Column:
    """As ``format_bytes`` with one digit for KB and no second unit."""
    return (
        F.when(count < KB, F.concat(count.cast("string"), F.lit(" B")))
        .when(count < MB, F.concat(fixed(scaled(count, KB, 1), 1), F.lit(" KB")))
        .when(count < GB, F.concat(fixed(scaled(count, MB, 2), 2), F.lit(" MB")))
        .otherwise(F.concat(fixed(scaled(count, GB, 2), 2), F.lit(" GB")))
    )


def format_mb(count: Column) -> Column:
    """A byte count in MB with thousands separators."""
    return fixed(scaled(count, MB, 2), 2, commas=True)


def format_with_commas(value: Column) -> Column:
    """A number with two decimals and thousands separators, sign kept."""
    return F.format_number(F.bround(value.cast("decimal(38,18)"), 2), 2)


def format_duration(seconds: Column) -> Column:
    """``MM:SS``, or ``HH:MM:SS`` from one hour on; part seconds are cut off."""
    whole = F.floor(seconds).cast("bigint")

    def two(x: Column) -> Column:
        text = x.cast("string")
        return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)

    hours = F.call_function("div", whole, F.lit(3600).cast("bigint"))
    minutes = F.call_function("div", F.pmod(whole, F.lit(3600)), F.lit(60).cast("bigint"))
    short = F.concat(two(minutes), F.lit(":"), two(F.pmod(whole, F.lit(60))))
    return F.when(hours > 0, F.concat(two(hours), F.lit(":"), short)).otherwise(short)


def eta_seconds(done: Column, total: Column, bytes_per_second: Column) -> Column:
    """Seconds left, or null when done, slower than 10 B/s, or over 30 days away."""
    seconds = (total - done).cast("double") / bytes_per_second
    return F.when(
        (done < total) & (bytes_per_second > 10.0),
        F.when((seconds <= 86400.0 * 30.0) & ~F.isnan(seconds), seconds),
    )


def percent_done(done: Column, total: Column) -> Column:
    """Percent of the total, held at 99.9 until the task ends."""
    share = done.cast("double") / F.nullif(total, F.lit(0)).cast("double") * 100.0
    return F.when(total > 0, F.least(share, F.lit(99.9))).otherwise(0.0)


def error_snippet(message: Column, silent: str = IMPORT_SILENT) -> Column:
    """The first line naming an error; else the first line; else a fixed sentence."""
    text = F.coalesce(message, F.lit(""))
    lines = F.split(text, r"\r?\n")
    named = F.get(F.filter(lines, lambda l: F.contains(l, F.lit("ERROR")) | F.contains(l, F.lit("Error"))), 0)
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    first = F.get(F.split(trimmed, r"\r?\n"), 0)
    return F.coalesce(named, F.when(trimmed == "", silent).otherwise(first))
