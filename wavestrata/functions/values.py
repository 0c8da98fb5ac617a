"""Parsing, casting and formatting of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavestrata.functions.domains import TARGET_FORMATS, TRANSFORMS


def safe_int(x: Column) -> Column:
    """The integer of a text's first token, cut towards zero; null if it isn't a number."""
    token = F.element_at(F.split(F.trim(x), " "), 1)
    number = token.try_cast("double")
    return F.when(~F.isnan(number), number).try_cast("bigint")


def safe_float(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def _canonical(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(x)), "^([A-Z]+)_?([0-9]+)$", "$1_$2")


def _looked_up(name: Column, domain: dict[str, tuple[str, int | None]], what: str) -> Column:
    table = F.create_map(*[c for k, (code, rate) in domain.items() for c in (F.lit(k), F.struct(F.lit(k).alias("name"), F.lit(code).alias("code"), F.lit(rate).cast("int").alias("sample_rate")))])
    found = F.try_element_at(table, name)
    return F.when(name.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), name)).cast("struct<name:string,code:string,sample_rate:int>"))


def target_format(x: Column) -> Column:
    """Struct of name, code and sample rate of a target format's name, such as flac44100; others raise."""
    return _looked_up(_canonical(x), TARGET_FORMATS, "target format")


def sampling_transform(x: Column) -> Column:
    """The same for a sampling transform; bare names mean nearest, automatic and exact."""
    name = _canonical(x)
    bare = F.when(name.isin("RESAMPLE", "RESAMPLING", "RESAMPLE_NEAREST", "RESAMPLINGNEAREST"), "RESAMPLING_NEAREST").when(name.isin("REINTERPRET", "REINTERPRETING", "REINTERPRETINGAUTO"), "REINTERPRETING_AUTO").when(name.startswith("EXACT"), "EXACTLY")
    return _looked_up(F.coalesce(bare, name), TRANSFORMS, "sampling transform")


def millis(position: Column, rate: Column) -> Column:
    return F.floor(position * 1000 / rate).cast("bigint")


def duration_text(seconds: Column) -> Column:
    """HH:MM:SS.hh with every part cut."""
    hundredths = F.floor(seconds * 100).cast("bigint")
    part = lambda by, mod: F.expr("0") + F.floor(hundredths / by) % mod
    return F.format_string("%02d:%02d:%02d.%02d", F.floor(hundredths / 360_000), part(6000, 60), part(100, 60), hundredths % 100)


def size_text(n_bytes: Column) -> Column:
    return F.format_string("%.1f MB", n_bytes / (1024 * 1024))


def bitrate_text(bit_rate: Column) -> Column:
    return F.format_string("%d kbps", F.floor(bit_rate / 1000).cast("bigint"))


def total_samples(duration_ts: Column, time_base: Column, rate: Column, duration: Column, container_duration: Column) -> Column:
    """duration_ts if its unit is one sample, else the seconds of the stream or container times the rate, cut."""
    unit = F.element_at(F.split(time_base, "/"), 2).try_cast("int")
    return F.when(unit == rate, duration_ts).otherwise(F.coalesce((duration * rate).cast("bigint"), (container_duration * rate).cast("bigint"))).cast("bigint")


def or_default(x: Column, default: int | str) -> Column:
    """x, or the default where x is null, 0 or empty."""
    return F.coalesce(F.nullif(x, F.lit(0 if isinstance(default, int) else "")), F.lit(default))


def nearest(x: Column, values: list[int]) -> Column:
    """The value nearest to x, the smaller of two."""
    gaps = F.array(*[F.struct(F.abs(x - v).alias("gap"), F.lit(v).alias("value")) for v in values])
    return F.array_min(gaps)["value"]


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def frame_hash(content: Column) -> Column:
    """The first 16 hex digits of the hash of the first 64 bytes."""
    return F.substring(F.sha2(F.substring(content, 1, 64), 256), 1, 16)
