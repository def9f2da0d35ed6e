"""Durations, memory sizes, rounding, and detections' bits. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# KiB of each unit.
KIB = {"K": 1.0, "M": 1024.0, "G": 1024.0**2, "T": 1024.0**3, "P": 1024.0**4}
# End of fixed values.


def duration_seconds(text: Column) -> Column:
    """Seconds of ``[DD-]HH:MM:SS[.mmm]`` or ``MM:SS``; null for words and empty text."""
    days = F.when(text.contains("-"), F.substring_index(text, "-", 1).try_cast("double")).otherwise(0.0)
    parts = F.split(F.substring_index(text, "-", -1), ":")
    clock = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))
    return F.when(text.rlike(r"^(\d+-)?\d+(:\d+)*(\.\d+)?$"), days * 86400 + clock)


def memory_kib(text: Column, cpus: Column, nodes: Column) -> Column:
    """KiB of ``4G``, ``2000Mc`` (for each cpu), ``1Gn`` (for each node); without a unit MiB."""
    form = r"^([0-9.]+)([KMGTP]?)([cn]?)$"
    value, unit, per = F.regexp_extract(text, form, 1).try_cast("double"), F.regexp_extract(text, form, 2), F.regexp_extract(text, form, 3)
    scale = F.lit(KIB["M"])
    for name, kib in KIB.items():
        scale = F.when(unit == name, kib).otherwise(scale)
    return value * scale * F.when(per == "c", cpus).when(per == "n", nodes).otherwise(1)


def format_duration(seconds: Column) -> Column:
    """``1d02h03m``, ``2h03m04s`` or ``3m04s``; ``-`` for null."""
    s = F.floor(seconds).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return F.when(s.isNull(), "-").when(d > 0, F.format_string("%dd%02dh%02dm", d, h, m)).when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s % 60)).otherwise(F.format_string("%dm%02ds", m, s % 60))


def format_kib(kib: Column) -> Column:
    """``1.5G`` from one GiB on, else ``512M``; ``-`` for null."""
    tenths = F.floor(kib / 1048576 * 10 + 0.5).cast("long")
    return F.when(kib.isNull(), "-").when(kib >= 1048576, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("G"))).otherwise(F.concat(F.floor(kib / 1024 + 0.5).cast("long").cast("string"), F.lit("M")))


def format_percent(share: Column) -> Column:
    return F.when(share.isNull(), "-").otherwise(F.concat(F.floor(share * 100 + 0.5).cast("long").cast("string"), F.lit("%")))


def round_memory(mib: Column) -> Column:
    """MiB up to a multiple of 256, 1024 at least."""
    return F.greatest(F.ceil(mib / 256) * 256, F.lit(1024)).cast("long")


def memory_text(mib: Column) -> Column:
    """Rounded memory: ``4G`` where it is whole, else ``4352M``."""
    m = round_memory(mib)
    return F.when(m % 1024 == 0, F.concat((m / 1024).cast("long").cast("string"), F.lit("G"))).otherwise(F.concat(m.cast("string"), F.lit("M")))


def round_minutes(seconds: Column) -> Column:
    """Minutes up to a multiple of five, ten at least."""
    return F.greatest(F.ceil(seconds / 300) * 5, F.lit(10)).cast("long")


def decode_bits(probabilities: Column) -> Column:
    """Bits of probabilities above one half."""
    return F.transform(probabilities, lambda p: (p > 0.5).cast("int"))


def bits_to_id(bits: Column) -> Column:
    """The number whose binary digits the bits are, the first the highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a * 2 + b)


def bit_confidence(probabilities: Column) -> Column:
    """Product of every bit's distance from a coin toss, 0 to 1."""
    return F.aggregate(probabilities, F.lit(1.0), lambda a, p: a * F.abs(p - 0.5) * 2)


def coerce_numeric(c: Column, kind: str = "double") -> Column:
    """The number in a text, or null."""
    return c.try_cast(kind)
