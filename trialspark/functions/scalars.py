"""Small scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import __version__

# Steps of the frame ruler.
TICK_STEPS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm, folded over as many steps as 64-bit numbers can need."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(92)),
        start,
        lambda s, _: F.struct(
            F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"),
            F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"),
        ),
    )
    return F.when(done["a"] == 0, F.lit(1).cast("long")).otherwise(done["a"])


def reduce_rational(num: Column, den: Column) -> Column:
    by = gcd(num, den)
    whole = lambda x: F.call_function("div", x.cast("long"), by)  # noqa: E731  exact beyond 2**53
    return F.struct(whole(num).alias("num"), whole(den).alias("den"))


def rational_to_number(r: Column) -> Column:
    return F.try_divide(r["num"].cast("double"), r["den"].cast("double"))


def format_fps(r: Column) -> Column:
    return F.when(r["den"] == 1, r["num"].cast("string")).otherwise(F.format_string("%.3f (%d/%d)", rational_to_number(r), r["num"], r["den"]))


def percent(count: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(100.0 * count / F.nullif(total, F.lit(0)), 1))


def half_up(x: Column) -> Column:
    """Rounding to the integer above on a tie, also below zero."""
    return F.floor(x + 0.5)


def nice_tick_step(top: Column, ticks: int) -> Column:
    """A step of 1, 2 or 5 times a power of ten for an axis up to ``top``."""
    raw = F.greatest(top, F.lit(1e-300)) / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    unit = raw / power
    return F.when(top <= 0, F.lit(1.0)).otherwise(power * F.when(unit < 1.5, 1).when(unit < 3, 2).when(unit < 7, 5).otherwise(10))


def tick_interval(frames: Column) -> Column:
    out = None
    for step in TICK_STEPS:
        cond = F.lit(step) >= frames / 40
        out = F.when(cond, step) if out is None else out.when(cond, step)
    return out.otherwise(5000)


def format_duration(seconds: Column) -> Column:
    """m:ss of the whole seconds that have passed."""
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def format_time(seconds: Column) -> Column:
    """m:ss.ff"""
    minutes = F.floor(seconds / 60)
    return F.concat(minutes.cast("string"), F.lit(":"), F.lpad(F.format_string("%.2f", seconds - minutes * 60), 5, "0"))


def format_seconds(seconds: Column) -> Column:
    return F.concat(F.format_string("%.2f", seconds), F.lit("s"))


def short_name(name: Column) -> Column:
    """The name, or its first 12 characters and an ellipsis where it has over 14."""
    return F.when(F.length(name) > 14, F.concat(F.substring(name, 1, 12), F.lit("\u2026"))).otherwise(name)


def dated_name(stem: Column, day: Column, ending: str) -> Column:
    """stem-yyyy-mm-dd.ending"""
    return F.concat(stem, F.lit("-"), F.date_format(day, "yyyy-MM-dd"), F.lit("." + ending))


def format_size(size: Column) -> Column:
    mb = size / (1024 * 1024)
    return F.when(size < 1024 * 1024, F.concat(half_up(size / 1024).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", mb), F.lit(" MB")))


def file_stem(name: Column) -> Column:
    """The name without its extension, other than letters, digits, _ and - as _."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[^A-Za-z0-9_-]", "_")


def is_video_file(mime: Column, name: Column) -> Column:
    return mime.startswith("video/") | F.lower(name).rlike(r"\.(mp4|m4v|mov|avi|webm|mkv)$")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, half_up(x)))


def min_frames_for(seconds: float, fps: float) -> int:
    return max(1, int(seconds * fps + 0.5))


def radius_factor_for(cm: float, per_cm: float, hole_radius: float) -> float:
    return cm * per_cm / hole_radius


def auto_id(start_frame: Column) -> Column:
    return F.concat(F.lit("auto-"), start_frame.cast("string"))


def tool_version() -> Column:
    return F.lit(f"trialspark {__version__}")
