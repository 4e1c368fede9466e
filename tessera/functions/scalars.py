"""Small scalar rules: clocks, versions, options, settings words, smoothed speed, evenly spaced samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """h:mm:ss from an hour on, else mm:ss; parts of a second are dropped."""
    whole = F.floor(seconds).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def version(text: Column) -> Column:
    """The numbers of a version such as v1.2.10 as an array; what follows the last number of the leading run is dropped."""
    run = F.regexp_extract(F.trim(text), r"^[vV]?([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(run != "", F.transform(F.split(run, r"\."), lambda x: x.cast("long")))


def is_newer(text: Column, than: Column) -> Column:
    """Whether a version comes after another, number by number; false where either is no version."""
    a, b = version(text), version(than)
    return F.coalesce(a > b, F.lit(False))


def boost_mode(value: Column) -> Column:
    """The contrast setting from what older settings may hold: true is always, nothing and false are off, other words auto."""
    v = F.lower(F.trim(value))
    return F.when(value.isNull() | v.isin("", "false", "0", "off", "none"), "off").when(v.isin("true", "1", "always"), "always").otherwise("auto")


def option_kind(value: Column) -> Column:
    """What a key=value option's value is read as: bool, int, float or str."""
    v = F.trim(value)
    return F.when(F.lower(v).isin("true", "false"), "bool").when(v.rlike("^[+-]?[0-9]+$"), "int").when(v.try_cast("double").isNotNull() & v.rlike("[0-9]"), "float").otherwise("str")


def smoothed(steps: Column, keep: float = 0.7) -> Column:
    """An exponentially smoothed value over an ordered array of steps: ``keep`` of the old and the rest of the new."""
    return F.aggregate(steps, F.lit(0.0), lambda v, s: v * keep + s * (1 - keep))


def evenly_spaced(first: Column, last: Column, samples: int) -> Column:
    """``samples`` places from first to last, cut to whole numbers, each once."""
    places = [first + F.floor((last - first) * (k / max(1, samples - 1))).cast("long") for k in range(samples)]
    return F.array_distinct(F.array(*places))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms (arrays of counts) in 0..1; 1 where either is empty."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x.cast("double"))
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(total(a) * total(b))
    return F.when(size > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - both / size))).otherwise(F.lit(1.0))
