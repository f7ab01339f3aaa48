"""Scalar expressions: labels, identifiers, calendars and small arithmetic. All are columns, none a UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillmark.functions import vocab


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


# ---- labels and identifiers


def port_number(label: Column) -> Column:
    """Number of a label like `Port 3`, else null."""
    return F.regexp_extract(label, r"(?i)^\s*port\s*(\d+)\s*$", 1).try_cast("smallint")


def sensor_type(label: Column) -> Column:
    return vocab.recode(F.lower(F.trim(label)), vocab.SENSOR_TYPES)


def variable(header: Column) -> Column:
    return vocab.recode(compact(header), vocab.VARIABLES)


def compact(header: Column) -> Column:
    """Lower case, single spaces, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(header, r"\s+", " ")))


def cloud_type(name: Column) -> Column:
    return vocab.recode(name, vocab.CLOUD_TYPES)


def cloud_variable(name: Column) -> Column:
    return vocab.recode(name, vocab.CLOUD_VARIABLES)


def logger_serial(name: Column) -> Column:
    """Five digits after z6-, else null."""
    return F.nullif(F.regexp_extract(name, r"(?i)z6-(\d{5})", 1), F.lit(""))


def sensor_id(code: Column) -> Column:
    """SMS and a number of two digits at least, from spellings like `sms 7`."""
    n = F.regexp_extract(F.upper(F.trim(code)), r"^SMS\s*0*(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("SMS"), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)))


def treatment(location: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, name in vocab.TREATMENTS.items():
        out = F.when(location.startswith(prefix), name).otherwise(out)
    return out


def padded(serial: Column, width: int = 5) -> Column:
    """Digits padded with zeros; longer values stay whole."""
    text = F.trim(serial.cast("string"))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def depth(value: Column) -> Column:
    return F.round(value.cast("string").try_cast("double")).try_cast("smallint")


def station_sensors(label: Column) -> Column:
    """Sensor ids of a label like `'SMS 1, 2'`; empty for other labels."""
    bare = F.upper(F.regexp_replace(label, "['\"‘’“”]", ""))
    numbers = F.transform(F.split(F.regexp_replace(F.trim(bare), "^SMS", ""), ","), lambda x: F.trim(x).try_cast("int"))
    ids = F.transform(F.filter(numbers, lambda n: n.isNotNull()), lambda n: F.concat(F.lit("SMS"), F.lpad(n.cast("string"), 2, "0")))
    return F.when(F.trim(bare).startswith("SMS"), ids).otherwise(F.array().cast("array<string>"))


def display(sensor: Column) -> Column:
    """Display label; an unknown id gets a question mark."""
    return vocab.recode(sensor, vocab.DISPLAY, F.concat(sensor, F.lit("?")))


def display_with_raw(sensor: Column) -> Column:
    return F.concat(display(sensor), F.lit(" ("), sensor, F.lit(")"))


def safe_stem(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def to_number(text: Column) -> Column:
    """A double; blanks and words such as Not Set give null."""
    return F.trim(text).try_cast("double")


def quad(a: str = "a", b: str = "b", m: str = "m", n: str = "n") -> Column:
    return F.concat_ws("_", *(F.col(c).cast("string") for c in (a, b, m, n)))


def reciprocal_quad(a: str = "a", b: str = "b", m: str = "m", n: str = "n") -> Column:
    return quad(m, n, a, b)


# ---- time


def shifted(ts: Column, seconds: Column) -> Column:
    """ts and a number of seconds, to the microsecond; time zones play no part."""
    return F.timestamp_add("MICROSECOND", F.round(seconds * F.lit(1e6)).cast("bigint"), ts)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def slot(ts: Column, origin: Column, step: int) -> Column:
    """Number of the grid step at or after ts: readings snap up."""
    return F.ceil(seconds_between(origin, ts) / step).cast("bigint")


# ---- space


def canonical_xy(x: Column, y: Column, sx: int = -1, sy: int = -1) -> tuple[Column, Column]:
    return x * sx, y * sy


def canonical_extent(low: Column, high: Column, sign: int) -> tuple[Column, Column]:
    return F.least(low * sign, high * sign), F.greatest(low * sign, high * sign)


#: The eight symmetries of a square as (name, swap, sign of x, sign of y).
SYMMETRIES = [("identity", False, 1, 1), ("flip_x", False, -1, 1), ("flip_y", False, 1, -1), ("rot180", False, -1, -1), ("swap", True, 1, 1), ("rot90", True, -1, 1), ("rot270", True, 1, -1), ("anti", True, -1, -1)]


def symmetric_xy(x: Column, y: Column, swap: bool, sx: int, sy: int) -> tuple[Column, Column]:
    x, y = (y, x) if swap else (x, y)
    return x * sx, y * sy


def similarity(x: Column, y: Column, world: tuple, scan: tuple) -> tuple[Column, Column]:
    """Two-point similarity that takes world[0], world[1] to scan[0], scan[1] (points as complex numbers)."""
    f = (scan[1] - scan[0]) / (world[1] - world[0])
    dx, dy = x - world[0].real, y - world[0].imag
    return F.lit(scan[0].real) + dx * f.real - dy * f.imag, F.lit(scan[0].imag) + dx * f.imag + dy * f.real


def geometric_factor(am: Column, bm: Column, an: Column, bn: Column) -> Column:
    """2 pi over the alternating sum of inverse distances; null if it vanishes or electrodes coincide."""
    one = F.lit(1.0)
    total = ratio(one, am) - ratio(one, bm) - ratio(one, an) + ratio(one, bn)
    return F.when(F.abs(total) >= 1e-9, 2 * math.pi / F.nullif(total, F.lit(0.0)))


# ---- errors and weights


def reciprocal_error(r: Column, other: Column) -> Column:
    """Percent: difference over the absolute mean of both."""
    return F.abs(r - other) / F.nullif(F.abs(r + other) / 2, F.lit(0.0)) * 100


def error_weight(r: Column, error: Column) -> Column:
    return F.abs(r) * F.greatest(F.coalesce(error, F.lit(1.0)), F.lit(1.0)) / 100


def match_quality(slot: Column, location: Column, depth_cm: Column) -> Column:
    """How a sensor fits a published table of slots: ok, above ground (the depth -10 stands for it), unknown place, or no such slot."""
    return F.when(slot.isNotNull(), "ok").when(depth_cm == -10, "no_slot_above_ground").when(location.isNull(), "tag_unmapped").otherwise("no_slot")
