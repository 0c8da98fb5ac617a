"""Probe reports, file reports and helpers around them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavestrata.functions import metadata, signal
from wavestrata.operators.lookup import random_requests
from wavestrata.sources import formats, probe

REPORT = {
    "format": {"format_name": "mov", "duration": "1.5", "size": "100", "bit_rate": "N/A", "maker": "x"},
    "streams": [{"index": 2, "codec_type": "audio", "codec_name": "aac", "channels": 2, "sample_rate": "44100", "odd": 1}, {"codec_type": "audio", "channels": 1}, {"index": 0, "codec_type": "video", "codec_name": "h264"}],
    "chapters": [{"id": 1}],
}


def test_report_parts(spark):
    rows = spark.createDataFrame([(1, json.dumps(REPORT)), (2, "{}"), (3, None), (4, "not json")], "k int, r string").orderBy("k")
    r = F.col("r")
    got = rows.select(metadata.container_info(r).alias("c"), metadata.audio_streams(r).alias("a"), metadata.other_streams(r).alias("o")).collect()
    assert (got[0].c.format_name, got[0].c.duration, got[0].c["size"], got[0].c.bit_rate) == ("mov", 1.5, 100, None)
    assert [s["index"] for s in got[0].a] == [2, None] and [s.codec_name for s in got[0].o] == ["h264"] and got[0].a[0].sample_rate == 44_100
    assert all(g.a == [] and g.o == [] for g in got[1:])
    rest = json.loads(rows.where("k = 1").select(F.to_json(metadata.rest(r, F.lit("mine")))).first()[0])
    assert rest["format"] == {"maker": "x"} and rest["streams"][0] == {"odd": "1"} and rest["user_meta"] == "mine" and "chapters" in rest["other"]


def test_typed_json_must_fit(spark):
    df = spark.createDataFrame([('{"a": "x"}',)], "t string")
    assert spark.createDataFrame([('{"a": 1}',)], "t string").select(metadata.typed(F.col("t"), "a int")).first()[0].a == 1
    with pytest.raises(Exception):  # noqa: B017, PT011  the type depends on how the error travels
        df.select(metadata.typed(F.col("t"), "a int")).collect()


def test_file_reports(spark, tmp_path):
    x = np.arange(9000)[:, None] % 200
    (tmp_path / "a.flac").write_bytes(formats.flac_file(x, 48_000))
    (tmp_path / "b.flac").write_bytes(b"fLaC")
    (tmp_path / "c.txt").write_bytes(b"nothing")
    files = probe.read_files(spark, str(tmp_path))
    got = {r.path[-6:]: r for r in probe.diagnosed(files).collect()}
    assert (got["a.flac"].frames, got["a.flac"].metadata_blocks, got["a.flac"].issues) == (3, 1, []) and got["b.flac"].issues and not got["/c.txt"].has_signature
    texts = {r.path[-6:]: r.report for r in probe.reports(probe.analysed(probe.probed(files))).collect()}
    assert "stream 0    flac" in texts["a.flac"] and "48000 Hz" in texts["a.flac"] and "size        0.0 MB" in texts["a.flac"]
    assert "flac" in texts["a.flac"] and "importable  true" in texts["a.flac"] and "importable  false" in texts["/c.txt"]


def test_random_requests_lie_within(spark):
    recs = spark.createDataFrame([(0, 100), (1, 5), (2, 0), (3, 100_000)], "rec_id long, n_samples long")
    rows = random_requests(recs, 20, 50).collect()
    sizes = {0: 100, 1: 5, 3: 100_000}
    assert len(rows) == 60 and len({r.request_id for r in rows}) == 60
    assert all(0 <= r.start_sample <= r.end_sample < sizes[r.rec_id] and r.end_sample - r.start_sample + 1 == min(50, sizes[r.rec_id]) for r in rows)
    assert sorted(map(tuple, random_requests(recs, 20, 50).collect())) == sorted(map(tuple, rows))


def test_resampling_keeps_a_tone():
    t = np.arange(4800) / 48_000
    x = np.sin(2 * np.pi * 1000 * t)[:, None]
    y = signal.resampled(x, 48_000, 16_000)
    assert y.shape == (1600, 1) and np.allclose(y[:, 0], np.sin(2 * np.pi * 1000 * np.arange(1600) / 16_000), atol=1e-6)
    assert np.allclose(signal.resampled(y, 16_000, 48_000), x, atol=1e-6) and signal.resampled(x[:0], 48_000, 8000).shape == (0, 1)


def test_reports_name_tags_and_conflicts(spark, tmp_path):
    """Preferred tags come first; a source with a conflict says so."""
    from pyspark.sql import functions as F

    (tmp_path / "a.wav").write_bytes(formats.wav_file(np.arange(4000)[:, None], 8000))
    files = probe.probed(probe.read_files(spark, str(tmp_path))).withColumn("tags", F.create_map(*map(F.lit, ("zeta", "1", "Title", "Owls", "album", "Night"))))
    text = probe.reports(probe.analysed(files, sample_rate=F.lit(48_000))).first().report.split("\n")
    tags = [x for x in text if x.startswith("tag ")]
    assert [x.split()[1] for x in tags] == ["title:", "album:", "zeta:"] or [x.split()[1] for x in tags] == ["album:", "title:", "zeta:"]
    assert any(x.startswith("! Sample rate of the source is 8000 Hz") for x in text)


def test_chosen_settings_are_checked_and_conf_acts(spark, tmp_path):
    from pyspark.sql import functions as F

    from wavestrata.config import EngineConf

    (tmp_path / "a.wav").write_bytes(formats.wav_file(np.arange(4000)[:, None], 64_000))
    files = probe.probed(probe.read_files(spark, str(tmp_path)))
    with pytest.raises(Exception, match="320000"):
        probe.analysed(files, aac_bitrate=F.lit(5)).collect()
    low = probe.analysed(files, conf=EngineConf(ultrasound_threshold_hz=50_000)).first()
    assert low.quality.is_ultrasound and low.target.flac_compression_level == 6 and not probe.analysed(files).first().quality.is_ultrasound
    assert probe.analysed(files, conf=EngineConf(flac_default_level=9)).first().target.flac_compression_level == 9


def test_lists_of_codecs_and_rates(spark):
    from pyspark.sql import functions as F

    from wavestrata.functions import rules

    df = spark.sql("SELECT array(struct('flac' AS codec_name, 48000 AS sample_rate), struct('aac' AS codec_name, 48000 AS sample_rate), struct('flac' AS codec_name, CAST(NULL AS INT) AS sample_rate)) AS s")
    row = df.select(rules.present(F.col("s"), "codec_name").alias("c"), rules.present(F.col("s"), "sample_rate").alias("r"), rules.missing_codecs(rules.present(F.col("s"), "codec_name"), F.array(F.lit("flac"))).alias("m")).first()
    assert (row.c, row.r, row.m) == (["aac", "flac"], [48_000], ["aac"])
    rates = spark.createDataFrame([(1000, 2), (999_999, 2), (160_000, 1), (100_000, 1)], "b int, c int").select(rules.legacy_bitrate(F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in rates] == [32_000, 320_000, 128_000, 100_000]
