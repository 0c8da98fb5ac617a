"""Truth tables of the rule engine, and what its checks find together."""

import pytest
from pyspark.sql import functions as F

from wavestrata.functions import rules, values
from wavestrata.functions.domains import TARGET_FORMATS, TRANSFORMS


def column(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").orderBy("k").select(expr).collect()]


def test_compression_class(spark):
    names = {
        "pcm_s24le": rules.RAW, "PCM-S16LE": rules.RAW, "u8": rules.RAW, "dsd_msbf": rules.RAW, "s302m": rules.RAW, "flac": rules.LOSSLESS, "ALAC": rules.LOSSLESS, "dst": rules.LOSSLESS, "sonic": rules.LOSSLESS,
        "mp3": rules.LOSSY, "wmalossless": rules.LOSSY, "adpcm_new": rules.LOSSY, "g799x": rules.LOSSY, "dolby-e": rules.LOSSY, "nothing": rules.UNKNOWN, "g7": rules.LOSSY, "gx7": rules.UNKNOWN,
    }
    assert column(spark, [(n,) for n in names], "c string", rules.compression_class("c")) == list(names.values())


def test_bitrates(spark):
    rows = [(64_000, 1), (96_000, 2), (256_000, 2), (300_000, 2), (95_999, 1), (130_000, 3)]
    assert column(spark, rows, "b int, c int", rules.raised_bitrate("b", "c")) == [160_000, 190_000, 294_400, 320_000, 160_000, 220_000]
    grades = [(85_999, 1, "low"), (86_000, 1, "medium"), (128_000, 1, "high"), (196_000, 1, "excessive"), (109_999, 2, "low"), (159_000, 2, "high"), (224_999, 2, "high"), (225_000, 2, "excessive"), (100_000, 8, "low"), (1_200_000, 8, "excessive")]
    assert column(spark, [g[:2] for g in grades], "b int, c int", rules.bitrate_class("b", "c")) == [g[2] for g in grades]


def test_quality(spark):
    q = rules.source_quality("c", "r", "b", "n")
    rows = [("flac", 96_000, None, 1), ("flac", 96_001, None, 1), ("pcm_s16le", 48_000, None, 2), ("pcm_s16le", 44_100, 1, 2), ("mp3", 44_100, 320_000, 2), ("mp3", 44_100, 90_000, 2), ("mp3", 44_100, None, 2), ("odd", None, None, 1)]
    got = column(spark, rows, "c string, r int, b int, n int", q)
    assert [g.quality_tier for g in got] == ["studio", "ultrasound", "high", "standard", "standard", "low", "low", "low"]
    assert [g.bitrate_class for g in got] == ["unknown"] * 4 + ["excessive", "low", "unknown", "unknown"]


def test_suggestions(spark):
    t = rules.suggested_target(rules.source_quality("c", "r", "b", "n"), F.col("w"))
    rows = [("aac", 44_100, 128_000, 2, "aac"), ("pcm_s16le", 400_000, None, 1, None), ("pcm_s16le", 700_000, None, 1, None), ("mp3", 250_000, 1, 1, None), ("mp3", 44_100, 128_000, 2, None), ("flac", 48_000, None, 1, "flac"), ("flac", 12_345, None, 1, None), ("odd", 48_000, None, 2, None)]
    got = column(spark, rows, "c string, r int, b int, n int, w string", t)
    assert [(g.code, g.sample_rate, g["transform"], g.aac_bitrate, g.flac_compression_level, g.copy_mode) for g in got] == [
        ("aac", 44_100, "exactly", 128_000, None, True), ("flac", None, "exactly", None, 6, False), ("flac", 96_000, "reinterpreting", None, 6, False), ("aac", 32_000, "reinterpreting", 192_000, None, False),
        ("aac", 44_100, "exactly", 190_000, None, False), ("flac", 48_000, "exactly", None, 4, True), ("flac", None, "exactly", None, 4, False), ("aac", 48_000, "exactly", 192_000, None, False),
    ]


def target(**v):
    fields = {"code": "string", "sample_rate": "int", "transform": "string", "transform_rate": "int", "aac_bitrate": "int", "copy_mode": "boolean"}
    return F.struct(*[F.lit(v.get(k)).cast(t).alias(k) for k, t in fields.items()])


@pytest.mark.parametrize(
    ("source", "aim", "where", "text"),
    [
        (("pcm_s16le", 44_100, None, 12), {"code": "flac", "transform": "exactly"}, "blocking", "8 channels"),
        (("pcm_s16le", 400_000, None, 1), {"code": "aac", "sample_rate": 48_000, "transform": "resampling", "transform_rate": 48_000}, "blocking", "Resampling"),
        (("pcm_s16le", 44_100, None, 8), {"code": "aac", "copy_mode": False}, "quality", "spatial information"),
        (("pcm_s16le", 44_100, None, 1), {"code": "flac", "sample_rate": 48_000}, "blocking", "no transform"),
        (("mp3", 44_100, 100_000, 2), {"code": "flac"}, "efficiency", "lossy source in FLAC"),
        (("aac", 44_100, 128_000, 2), {"code": "aac", "aac_bitrate": 192_000}, "quality", "higher bitrate"),
        (("mp3", 44_100, 260_000, 2), {"code": "aac", "aac_bitrate": 299_000}, "quality", "less than 1.2"),
        (("pcm_s16le", 700_000, None, 1), {"code": "flac"}, "quality", "exceeds what FLAC"),
        (("pcm_s16le", 44_100, None, 1), {"code": "aac", "aac_bitrate": 300_000}, "efficiency", "Very high"),
    ],
)
def test_conflicts(spark, source, aim, where, text):
    c = rules.conflicts(rules.source_quality("c", "r", "b", "n"), target(**aim))
    (got,) = column(spark, [source], "c string, r int, b int, n int", c)
    assert any(text in m for m in got[where]), got


def test_all_checks_are_kept(spark):
    """A blocking conflict stays although later checks find something else (or nothing)."""
    c = rules.conflicts(rules.source_quality("c", "r", "b", "n"), target(code="aac", sample_rate=48_000, transform="resampling", transform_rate=48_000, aac_bitrate=100_000))
    (got,) = column(spark, [("pcm_s16le", 400_000, None, 1)], "c string, r int, b int, n int", c)
    assert len(got.blocking) == 1 and len(got.quality) == 3


def test_own_suggestion_for_a_good_lossy_source_warns(spark):
    """260 kbit/s are raised to 299, less than 1.2 times: both rules stay as they are."""
    q = rules.source_quality("c", "r", "b", "n")
    (got,) = column(spark, [("mp3", 44_100, 260_000, 2)], "c string, r int, b int, n int", rules.conflicts(q, rules.suggested_target(q)))
    assert got.blocking == [] and len(got.quality) == 1


def test_overrides_and_copy(spark):
    t = rules.with_overrides(rules.suggested_target(rules.source_quality("c", "r", "b", "n")), aac_bitrate=F.col("own"))
    rows = [("mp3", 44_100, 128_000, 2, 256_000), ("mp3", 44_100, 128_000, 2, None)]
    assert [g.aac_bitrate for g in column(spark, rows, "c string, r int, b int, n int, own int", t)] == [256_000, 190_000]
    pairs = [(" AAC ", "aac"), ("flac", "flac"), ("mp3", "aac"), (None, "aac"), ("aac", "flac")]
    assert column(spark, pairs, "c string, t string", rules.copy_possible(F.col("c"), F.col("t"))) == [True, True, False, False, False]
    assert column(spark, pairs, "c string, t string", rules.reencoding_severity(F.col("c"), F.col("t"))) == ["quality_loss", "efficiency", None, None, None]
    assert column(spark, pairs[:1], "c string, t string", rules.copy_benefits(F.trim(F.lower("c")), F.col("t")))[0]["codec"] == "AAC"


def test_limits_raise(spark):
    assert column(spark, [(32_000,), (None,)], "b int", rules.checked_bitrate(F.col("b"))) == [32_000, None]
    for bad, check in ((31_999, rules.checked_bitrate), (320_001, rules.checked_bitrate), (13, rules.checked_level)):
        with pytest.raises(Exception, match="must be from"):
            column(spark, [(bad,)], "b int", check(F.col("b")))


def test_names(spark):
    rows = [("flac44100",), ("aac_48000",), (" Flac ",), (None,), ("NUMPY",)]
    assert [g and (g.name, g.code, g.sample_rate) for g in column(spark, rows, "t string", values.target_format(F.col("t")))] == [("FLAC_44100", "flac", 44_100), ("AAC_48000", "aac", 48_000), ("FLAC", "flac", None), None, ("NUMPY", "numpy", None)]
    rows = [("resampling44100",), ("reinterpreting_auto",), ("resampling",), ("reinterpreting",), ("exact",), ("EXACTLY",)]
    assert [g.name for g in column(spark, rows, "t string", values.sampling_transform(F.col("t")))] == ["RESAMPLING_44100", "REINTERPRETING_AUTO", "RESAMPLING_NEAREST", "REINTERPRETING_AUTO", "EXACTLY", "EXACTLY"]
    for bad, f in (("invalid_format", values.target_format), ("flac_1", values.target_format), ("sideways", values.sampling_transform)):
        with pytest.raises(Exception, match="unknown"):
            column(spark, [(bad,)], "t string", f(F.col("t")))
    assert (len(TARGET_FORMATS), len(TRANSFORMS)) == (26, 21)


def test_values(spark):
    texts = [("12.9 kHz",), ("-7.8",), ("N/A",), ("",), (None,), ("1e3",)]
    assert column(spark, texts, "t string", values.safe_int(F.col("t"))) == [12, -7, None, None, None, 1000]
    assert column(spark, texts, "t string", values.safe_float(F.col("t"))) == [None, -7.8, None, None, None, 1000.0]
    assert column(spark, [(3661.259,), (0.0,), (359_999.999,)], "s double", values.duration_text(F.col("s"))) == ["01:01:01.25", "00:00:00.00", "99:59:59.99"]
    assert column(spark, [(1_572_864,)], "s long", values.size_text(F.col("s"))) == ["1.5 MB"] and column(spark, [(128_999,)], "s long", values.bitrate_text(F.col("s"))) == ["128 kbps"]
    rows = [(1000, "1/48000", 48_000, 9.0, None), (1000, "1/1000", 48_000, 1.5, None), (None, None, 8000, None, 2.0), (None, None, 8000, None, None)]
    assert column(spark, rows, "d long, t string, r int, s double, c double", values.total_samples(*map(F.col, "dtrsc"))) == [1000, 72_000, 16_000, None]
    assert column(spark, [(14_000,), (14_001,), (99,)], "x int", values.nearest(F.col("x"), [8000, 12_000, 16_000])) == [12_000, 16_000, 8000]
