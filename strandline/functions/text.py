"""Text and number formats of reports, file names and paths, as column expressions."""

from __future__ import annotations

import os.path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]


def half_up(x: Column) -> Column:
    """Rounds to the nearest whole number, halves upward."""
    return F.floor(x + 0.5)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits after the point, as text, without grouping."""
    return F.format_string(f"%.{digits}f", F.round(x.cast("double"), digits))


def fmt_bytes(n: Column) -> Column:
    """1536 -> 1.5 KB: at most two decimals, without trailing zeros."""
    n = n.cast("double")
    scaled = F.lit(None).cast("string")
    for k in reversed(range(len(SIZE_UNITS))):
        text = F.regexp_replace(F.regexp_replace(fixed(n / float(1024**k), 2), r"0+$", ""), r"\.$", "")
        piece = F.concat(text, F.lit(" " + SIZE_UNITS[k]))
        scaled = piece if k == len(SIZE_UNITS) - 1 else F.when(n < float(1024 ** (k + 1)), piece).otherwise(scaled)
    return F.when(n == 0, F.lit("0 B")).otherwise(scaled)


def fmt_duration(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    m = F.floor(s / 60)
    text = lambda x: x.cast("bigint").cast("string")
    return (
        F.when(ms < 1000, F.concat(text(ms), F.lit("ms")))
        .when(s < 60, F.concat(text(s), F.lit("s")))
        .when(m < 60, F.concat(text(m), F.lit("m "), text(s % 60), F.lit("s")))
        .otherwise(F.concat(text(F.floor(m / 60)), F.lit("h "), text(m % 60), F.lit("m")))
    )


def fmt_count(n: Column) -> Column:
    """1234 -> 1.2K, 1500000 -> 1.5M."""
    size = F.abs(n)
    return F.when(size >= 1_000_000, F.concat(fixed(n / 1e6, 1), F.lit("M"))).when(size >= 1000, F.concat(fixed(n / 1e3, 1), F.lit("K"))).otherwise(half_up(n).cast("bigint").cast("string"))


def rate(count: Column, elapsed_ms: Column) -> Column:
    """Per second, to two decimals; 0 for no time."""
    return F.when(elapsed_ms == 0, F.lit(0.0)).otherwise(half_up(F.try_divide(count, elapsed_ms) * 1000 * 100) / 100)


def ellipsis(s: Column, n: int) -> Column:
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 3), F.lit("...")))


def safe_name(s: Column) -> Column:
    name = F.regexp_replace(F.coalesce(s, F.lit("")), "[^a-zA-Z0-9-_]", "_")
    return F.when(name == "", F.lit("unknown")).otherwise(name)


def chunk_name(channel: Column, part: Column) -> Column:
    """<name>-<part>.json; the part has six digits at least and is never cut."""
    return F.format_string("%s-%06d.json", safe_name(channel), part)


def part_of_name(name: Column) -> Column:
    digits = F.regexp_extract(name, r"-(\d{6,})\.json$", 1)
    return F.when(digits != "", digits).try_cast("bigint")


def output_path(template: str, channel: str, single: bool) -> str:
    """Where a channel's export goes: {channel} is replaced; one channel takes the template as it is; else the id goes before the extension, or into the folder."""
    if "{channel}" in template:
        return template.replace("{channel}", channel)
    if single:
        return template
    stem, ext = os.path.splitext(template)
    return f"{stem}-{channel}{ext}" if ext else os.path.join(template, f"{channel}.jsonl")


def output_path_col(template: Column, channel: Column, single: Column) -> Column:
    ext = F.regexp_extract(template, r"[^/.][^/]*(\.[^./]*)$", 1)
    stem = F.substring(template, F.lit(1), F.length(template) - F.length(ext))
    return (
        F.when(F.contains(template, F.lit("{channel}")), F.replace(template, F.lit("{channel}"), channel))
        .when(single, template)
        .when(ext != "", F.concat(stem, F.lit("-"), channel, ext))
        .otherwise(F.concat(F.regexp_replace(template, "/+$", ""), F.lit("/"), channel, F.lit(".jsonl")))
    )


def json_or(text: Column, path: str, fallback: str) -> Column:
    """A field of JSON text, or the fallback where the text is missing, no JSON or without the field."""
    return F.coalesce(F.get_json_object(text, path), F.lit(fallback))
