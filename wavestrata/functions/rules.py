"""The rule engine as column expressions: classify a source, suggest storage settings, find conflicts.

All functions take and return columns, so a million sources are one projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavestrata.functions.domains import AAC_RATES, FLAC_HIGHEST_RATE, FLAC_MOST_CHANNELS, FLAC_RATES, LOSSLESS_NAMES, LOSSY_NAMES, RAW_NAMES

RAW, LOSSLESS, LOSSY, UNKNOWN = "uncompressed", "lossless_compressed", "lossy_compressed", "unknown"
ULTRASOUND_HZ = 96_000
# Limits in bit/s of the classes low, medium and high, and of bitrates for storage.
MONO_LIMITS, STEREO_LIMITS = (86_000, 128_000, 196_000), (110_000, 159_000, 225_000)
RAISE_STEPS = ((96_000, 1.40), (128_000, 1.35), (160_000, 1.30), (192_000, 1.25), (256_000, 1.18))
RAISE_LAST, LOWEST_BITRATE, HIGHEST_BITRATE = 1.15, {1: 160_000, 2: 190_000, 3: 220_000}, 320_000


def _case(default: Column, *branches: tuple[Column, Column]) -> Column:
    first, *rest = branches
    return reduce(lambda c, b: c.when(*b), rest, F.when(*first)).otherwise(default)


def _named(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compression_class(codec: Column | str) -> Column:
    """How a codec compresses, by its name; hyphens count as underscores, case does not count."""
    name = F.translate(F.lower(_named(codec)), "-", "_")
    return _case(
        F.lit(UNKNOWN),
        (name.startswith("pcm_") | name.startswith("dsd_") | name.isin(RAW_NAMES), F.lit(RAW)),
        (name.isin(LOSSLESS_NAMES), F.lit(LOSSLESS)),
        (name.isin(LOSSY_NAMES) | name.startswith("adpcm_") | name.startswith("g7"), F.lit(LOSSY)),
    )


def is_ultrasound(rate: Column | str, over: int = ULTRASOUND_HZ) -> Column:
    return F.coalesce(_named(rate), F.lit(44_100)) > over


def _graded(value: Column, limits: tuple[int, int, int]) -> Column:
    return _case(F.lit("excessive"), *((value < x, F.lit(g)) for x, g in zip(limits, ("low", "medium", "high"), strict=True)))


def bitrate_class(bit_rate: Column | str, channels: Column | str) -> Column:
    """low to excessive; from three channels on, 0.7 of them count against the limits of mono."""
    bit_rate, channels = _named(bit_rate), _named(channels)
    many = _graded(bit_rate / (channels * 0.7), MONO_LIMITS)
    return F.when(channels == 1, _graded(bit_rate, MONO_LIMITS)).when(channels == 2, _graded(bit_rate, STEREO_LIMITS)).otherwise(many)


def quality_tier(compression: Column, rate: Column | str, grade: Column, ultrasound_hz: int = ULTRASOUND_HZ) -> Column:
    rate = F.coalesce(F.nullif(_named(rate), F.lit(0)), F.lit(44_100))
    return _case(
        F.lit("low"),
        (is_ultrasound(rate, ultrasound_hz), F.lit("ultrasound")),
        (compression.isin(RAW, LOSSLESS), F.when(rate >= 96_000, "studio").when(rate >= 48_000, "high").otherwise("standard")),
        (grade.isin("medium", "high", "excessive"), F.lit("standard")),
    )


def source_quality(codec: Column | str, rate: Column | str, bit_rate: Column | str, channels: Column | str, sample_format: Column | None = None, ultrasound_hz: int = ULTRASOUND_HZ) -> Column:
    """The nine fields that suggestions and conflicts look at, as a struct."""
    kind = compression_class(codec)
    bit_rate = _named(bit_rate)
    grade = F.when((kind == LOSSY) & (bit_rate != 0), bitrate_class(bit_rate, channels)).otherwise("unknown")
    return F.struct(
        kind.alias("compression_type"), _named(codec).alias("codec_name"), _named(rate).cast("int").alias("sample_rate"), bit_rate.cast("int").alias("bit_rate"),
        _named(channels).cast("int").alias("channels"), (F.lit(None).cast("string") if sample_format is None else sample_format).alias("sample_format"),
        grade.alias("bitrate_class"), quality_tier(kind, rate, grade, ultrasound_hz).alias("quality_tier"), is_ultrasound(rate, ultrasound_hz).alias("is_ultrasound"),
    )


def raised_bitrate(bit_rate: Column | str, channels: Column | str) -> Column:
    """Bitrate to store a lossy source with: raised by its step, cut to an integer, between floor and cap."""
    bit_rate, channels = _named(bit_rate), _named(channels)
    factor = _case(F.lit(RAISE_LAST), *((bit_rate < x, F.lit(f)) for x, f in RAISE_STEPS))
    floor = F.when(channels == 1, LOWEST_BITRATE[1]).when(channels == 2, LOWEST_BITRATE[2]).otherwise(LOWEST_BITRATE[3])
    return F.least(F.lit(HIGHEST_BITRATE), F.greatest(floor, (bit_rate * factor).cast("int")))


def _target(code: str, rate: Column | int | None, transform: str, transform_rate: int | None = None, bitrate: Column | int | None = None, level: int | None = None, copy: bool = False) -> Column:
    put = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(
        F.lit(code).alias("code"), put(rate).alias("sample_rate"), F.lit(transform).alias("transform"), put(transform_rate).alias("transform_rate"),
        put(bitrate).alias("aac_bitrate"), put(level).alias("flac_compression_level"), F.lit(copy).alias("copy_mode"),
    )


def suggested_target(quality: Column, wanted_code: Column | None = None, aac_bitrate: int = 160_000, flac_level: int = 4) -> Column:
    """Storage settings for a source; wanted_code is the code of a format already chosen, if any."""
    loud = F.coalesce(quality.is_ultrasound, F.lit(False))
    wanted = F.lit(None).cast("string") if wanted_code is None else wanted_code
    rate, channels = F.coalesce(quality.sample_rate, F.lit(44_100)), F.coalesce(quality.channels, F.lit(2))
    kind, codec = quality.compression_type, F.lower(F.coalesce(quality.codec_name, F.lit("")))
    known = F.coalesce(F.nullif(quality.bit_rate, F.lit(0)), F.lit(128_000))
    listed = lambda rates: F.when(rate.isin(*rates), rate)
    plain = kind.isin(RAW, LOSSLESS)
    return _case(
        _target("aac", listed((44_100, 48_000)), "exactly", bitrate=F.when(channels == 2, 192_000).otherwise(aac_bitrate)),
        ((codec == "aac") & (wanted == "aac"), _target("aac", listed(AAC_RATES), "exactly", bitrate=F.coalesce(F.nullif(quality.bit_rate, F.lit(0)), F.lit(aac_bitrate)), copy=True)),
        (loud & plain & (rate <= FLAC_HIGHEST_RATE), _target("flac", None, "exactly", level=6)),
        (loud & plain, _target("flac", 96_000, "reinterpreting", 96_000, level=6)),
        (loud, _target("aac", 32_000, "reinterpreting", 32_000, bitrate=192_000)),
        (kind == LOSSY, _target("aac", listed((44_100, 48_000)), "exactly", bitrate=raised_bitrate(known, channels))),
        (plain & (codec == "flac") & (wanted == "flac"), _target("flac", listed(FLAC_RATES), "exactly", level=flac_level, copy=True)),
        (plain, _target("flac", listed((44_100, 48_000, 88_200, 96_000)), "exactly", level=flac_level)),
    )


def copy_possible(codec: Column, target_code: Column) -> Column:
    """Whether the bytes can be stored as they are: source and target codec are both aac or both flac."""
    name = F.lower(F.trim(codec))
    return F.coalesce(name.isin("aac", "flac") & (name == target_code), F.lit(False))


def reencoding_severity(codec: Column, target_code: Column) -> Column:
    """quality_loss for aac to aac, efficiency for flac to flac, else null."""
    return F.when(copy_possible(codec, target_code), F.when(target_code == "aac", "quality_loss").otherwise("efficiency"))


def copy_benefits(codec: Column, target_code: Column) -> Column:
    text = F.when(target_code == "aac", "AAC stream kept bit by bit").otherwise("FLAC stream kept bit by bit")
    return F.when(copy_possible(codec, target_code), F.create_map(F.lit("codec"), F.upper(target_code), F.lit("description"), text))


def with_overrides(suggested: Column, **chosen: Column) -> Column:
    """The suggestion with the user's values where they are not null."""
    return reduce(lambda s, kv: s.withField(kv[0], F.coalesce(kv[1], s[kv[0]])), chosen.items(), suggested)


def _found(*rules: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in rules]))


def conflicts(quality: Column, target: Column) -> Column:
    """Blocking conflicts, quality warnings and efficiency warnings of all checks together, as three arrays."""
    rate, channels = F.coalesce(quality.sample_rate, F.lit(44_100)), F.coalesce(quality.channels, F.lit(2))
    codec, kind, tier = F.lower(F.coalesce(quality.codec_name, F.lit(""))), quality.compression_type, quality.quality_tier
    copy, code = F.coalesce(target.copy_mode, F.lit(False)), target.code
    aac, flac = code == "aac", code == "flac"
    moved, exact = target["transform"], F.coalesce(target["transform"] == "exactly", F.lit(False))
    bitrate = F.coalesce(target.aac_bitrate, F.lit(160_000))
    own_rate = F.coalesce(quality.bit_rate, F.lit(0))
    loud = F.coalesce(quality.is_ultrasound, F.lit(False))
    plain = kind.isin(RAW, LOSSLESS) & aac & ~copy
    ratio = F.when(target["transform"] == "resampling", target.transform_rate / rate)
    many = aac & (channels > 2)
    again = (codec == "aac") & aac & ~copy
    blocking = _found(
        (flac & (channels > FLAC_MOST_CHANNELS), F.format_string("FLAC holds at most 8 channels, the source has %d", channels)),
        ((target.sample_rate != rate) & (moved.isNull() | exact), F.format_string("Sample rate of the source is %d Hz, of the target %d Hz, and no transform is given", rate, target.sample_rate)),
        (loud & aac & ~copy & (moved == "resampling"), "Ultrasound in AAC: Resampling destroys the signal, reinterpret it instead"),
    )
    worse = _found(
        (many & ~copy & (codec != "aac"), "AAC with more than two channels can destroy spatial information"),
        (again & (target.aac_bitrate > quality.bit_rate), "AAC is encoded anew with a higher bitrate, which lowers quality: copy it"),
        (again & ~F.coalesce(target.aac_bitrate > quality.bit_rate, F.lit(False)), "AAC is encoded anew, which loses a generation: copy it"),
        (ratio < 0.5, "Much lower sample rate: quality is reduced"),
        (loud & aac & ~copy & (moved.isNull() | ~moved.isin("resampling", "reinterpreting", "exactly")), "Ultrasound in AAC without reinterpretation"),
        (loud & flac & (rate > FLAC_HIGHEST_RATE), "Sample rate exceeds what FLAC can hold"),
        (plain & (channels == 1) & (bitrate < 160_000), "AAC bitrate is very low for mono"),
        (plain & (channels == 2) & (bitrate < 190_000), "AAC bitrate is low for stereo"),
        (plain & (tier == "studio") & (bitrate < 256_000), "Studio quality needs 256 kbit/s or FLAC"),
        (plain & (tier == "high") & (bitrate < 192_000), "High quality needs 192 kbit/s"),
        (plain & (tier == "ultrasound"), "Ultrasound in AAC needs reinterpretation"),
        ((kind == LOSSY) & aac & ~copy & (bitrate < own_rate * 1.2), "Lossy source encoded anew with less than 1.2 times its bitrate"),
    )
    larger = _found(
        (many & (copy | (codec == "aac")), "AAC with more than two channels may not suit directional analysis"),
        ((codec == "flac") & flac & ~copy & moved.isNotNull() & ~exact, "FLAC to FLAC with another sample rate: check whether a copy will do"),
        (ratio > 2.0, "Much higher sample rate: larger without a gain"),
        ((kind == LOSSY) & flac & quality.bitrate_class.isin("low", "medium"), "Low or medium lossy source in FLAC: larger without a gain"),
        ((target.aac_bitrate > 256_000) & (target.aac_bitrate / channels > 192_000), "Very high AAC bitrate"),
    )
    return F.struct(blocking.alias("blocking"), worse.alias("quality"), larger.alias("efficiency"))


def importable(streams: Column, selected: Column, decodable: Column) -> Column:
    """Whether a file can be imported: it has audio, exactly one known stream is selected, and its codec can be decoded."""
    known = F.transform(streams, lambda s: s["index"])
    chosen = F.coalesce(selected, F.slice(known, 1, 1))
    return (F.size(streams) > 0) & (F.size(chosen) == 1) & F.forall(chosen, lambda x: F.array_contains(known, x)) & decodable


def same_shape(streams: Column) -> Column:
    """Whether streams have one number of samples and one sample rate."""
    return F.size(F.array_distinct(F.transform(streams, lambda s: F.struct(s["nb_samples"], s["sample_rate"])))) <= 1


def copy_report(codec: Column, target: Column) -> Column:
    """Whether the bytes can stay as they are, what that is good for, and what a new encoding would cost, as a struct."""
    code = target["code"]
    return F.struct(copy_possible(codec, code).alias("possible"), copy_benefits(codec, code).alias("benefits"), reencoding_severity(codec, code).alias("reencoding"))


def legacy_bitrate(bit_rate: Column, channels: Column) -> Column:
    """A wanted AAC bitrate between 32 and 320 kbit/s, at most 128 for mono."""
    clamped = F.least(F.greatest(bit_rate, F.lit(32_000)), F.lit(320_000))
    return F.when(channels == 1, F.least(clamped, F.lit(128_000))).otherwise(clamped)


def present(streams: Column, field: str) -> Column:
    """The distinct values that a field has over all streams, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(streams, lambda s: s[field]), lambda x: x.isNotNull())))


def missing_codecs(codecs: Column, available: Column) -> Column:
    """The codecs of a list that another one lacks."""
    return F.array_except(codecs, available)


def checked_bitrate(value: Column) -> Column:
    return F.when(value.isNull() | value.between(32_000, 320_000), value).otherwise(F.raise_error("aac_bitrate must be from 32000 to 320000").cast("int"))


def checked_level(value: Column) -> Column:
    return F.when(value.isNull() | value.between(0, 12), value).otherwise(F.raise_error("flac_compression_level must be from 0 to 12").cast("int"))
