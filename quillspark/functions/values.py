"""Small checks and conversions of values: numbers, dates, paths, captions and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import SPACE, let

# A closing line that recognisers make out of silence.
STOCK_CAPTION = rf"(?i)^(?:thanks|thank you){SPACE}+for{SPACE}+watching[.!?…]*$"
_SPACES = rf"^{SPACE}+|{SPACE}+$"


def is_stock_caption(text: Column) -> Column:
    """Whether a whole segment is a closing line of silence; the words inside a longer one are speech."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, "").rlike(STOCK_CAPTION)


def numeric_option(value: Column, default: float, least: float, most: float | None = None) -> Column:
    """A number given as text or not at all: the default where it is none or zero, then held within bounds."""
    number = F.coalesce(F.nullif(F.nanvl(value.try_cast("double"), F.lit(None)), F.lit(0.0)), F.lit(float(default)))
    held = F.greatest(F.lit(float(least)), number)
    return held if most is None else F.least(F.lit(float(most)), held)


def size_limit(value: Column, default: int) -> Column:
    """A limit: whole, not negative, and the default where it is no finite number."""
    number = value.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(usable, F.greatest(F.lit(0), F.floor(number))).otherwise(F.lit(default)).cast("long")


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounded with halves towards positive infinity, of negative numbers too."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def local_date(instant: Column, zone: str = "UTC") -> Column:
    """The calendar date of an instant in a zone."""
    return F.date_format(F.from_utc_timestamp(instant, zone), "yyyy-MM-dd")


def is_calendar_date(text: Column) -> Column:
    """Whether a text is a date that exists, written with four, two and two digits."""
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}\z")
    return F.coalesce(shaped & (F.date_format(parsed, "yyyy-MM-dd") == text), F.lit(False))


def title_request(date: Column, label: Column, most: int = 80) -> Column:
    """``date, label, valid`` of a request for a numbered title: a real date and a label that says something."""
    kept = F.substring(F.regexp_replace(F.coalesce(label, F.lit("")), _SPACES, ""), 1, most)
    return F.struct(date.alias("date"), kept.alias("label"), (is_calendar_date(date) & (kept != "")).alias("valid"))


def required_text(text: Column) -> Column:
    """``text, problem``: trimmed, or why it isn't there."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, "")
    return F.struct(F.nullif(kept, F.lit("")).alias("text"), F.when(kept == "", "required").alias("problem"))


def resolved_path(root: Column, target: Column) -> Column:
    """``target`` seen from ``root`` without ``.`` and ``..``; an absolute one stands for itself."""
    path = F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", root, target))
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(held: Column, part: Column) -> Column:
        return F.when(part != "..", F.concat(held, F.array(part))).when(F.size(held) > 0, F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(held)

    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def is_contained(root: Column, target: Column) -> Column:
    """Whether a path stays inside a root folder (or is it)."""
    inside = resolved_path(F.lit("/"), root)
    return let(resolved_path(root, target), lambda found: (found == inside) | found.startswith(F.concat(F.when(inside == "/", F.lit("")).otherwise(inside), F.lit("/"))))


def may_copy(root: Column, target: Column) -> Column:
    """Whether a workspace may be copied there: neither folder inside the other."""
    return (resolved_path(F.lit("/"), root) == resolved_path(F.lit("/"), target)) | ~(is_contained(root, target) | is_contained(target, root))


def mono_mix(channels: Column) -> Column:
    """The mean of an array of channels, sample by sample."""
    n = F.size(channels)
    return F.transform(channels[0], lambda _, i: F.aggregate(channels, F.lit(0.0), lambda total, c: total + F.get(c, i).cast("double") / n))


def resample(samples: Column, source_rate: float, target_rate: float = 16_000) -> Column:
    """Samples at another rate, by linear interpolation; the same where the rates agree."""
    if source_rate == target_rate:
        return samples
    ratio = source_rate / target_rate
    length = F.floor(F.size(samples) / F.lit(ratio)).cast("int")

    def at(i: Column) -> Column:
        position = i * F.lit(ratio)
        left = F.floor(position).cast("int")
        right, mix = F.least(F.size(samples) - 1, left + 1), position - left
        return F.get(samples, left) * (1 - mix) + F.get(samples, right) * mix

    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), at)).otherwise(F.array().cast("array<double>"))


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Insertions, deletions and substitutions between two words, in code points; null beyond ``most``."""
    if most is None:
        return F.levenshtein(a, b)
    return F.nullif(F.levenshtein(a, b, most), F.lit(-1))
