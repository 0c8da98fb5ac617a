"""Index, lookup, catalogue, signal and streaming operators against plain Python."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavestrata.config import EngineConf
from wavestrata.functions import signal
from wavestrata.operators import catalog, index, lookup
from wavestrata.operators.ranking import row_numbers
from wavestrata.sources import probe
from wavestrata.streaming.segments import tumbling, watch

FRAMES = "rec_id long, frame_no long, sample_pos long, n_samples int"


def test_frame_range_edges(spark):
    """Four frames of 1024: the frame of start, and one after that of end, at most the last; none if reversed."""
    frames = spark.createDataFrame([(1, k, k * 1024, 1024) for k in range(4)], FRAMES)
    asks = [(0, 0), (1500, 2500), (4095, 9000), (-10, 5), (2048, 2047), (5000, 10), (3000, 3000)]
    requests = spark.createDataFrame([(k, 1, a, b) for k, (a, b) in enumerate(asks)] + [(99, 2, 0, 1)], "request_id long, rec_id long, start_sample long, end_sample long")
    got = {r.request_id: (r.first_frame, r.last_frame) for r in lookup.frame_range(requests, frames).collect()}
    assert got == {0: (0, 1), 1: (1, 3), 2: (3, 3), 3: (0, 1), 4: (2, 2), 5: (None, None), 6: (2, 3), 99: (None, None)}
    got = {r.request_id: (r.first_frame, r.last_frame) for r in lookup.frame_range(requests, frames, overlap=1, frame=1024).collect()}
    assert got[1] == (0, 3) and got[2] == (2, 3) and got[3] == (0, 1)


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_overlap_join_equals_a_nested_loop(spark, bucket):
    rng = np.random.default_rng(2)
    left = [(int(i), int(rng.integers(3)), int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-50, 200, 60), rng.integers(-3, 40, 60), strict=True))]
    right = [(int(i), int(rng.integers(3)), int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-50, 200, 60), rng.integers(0, 25, 60), strict=True))]
    x, y = spark.createDataFrame(left, "l long, k int, a long, b long"), spark.createDataFrame(right, "r long, k int, c long, d long")
    got = sorted((r.l, r.r) for r in lookup.overlap_join(x, y, "k", ("a", "b"), ("c", "d"), bucket).collect())
    assert got == sorted((p[0], q[0]) for p in left for q in right if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3] and p[2] <= p[3])


def test_trim(spark):
    cases = [([0, 1, 2, 3], 10, 11, 12), ([0, 1, 2, 3], 10, 8, 11), ([0, 1, 2, 3], 10, 14, 20), ([0, 1, 2, 3], 10, 12, 99), ([0, 1], 5, 6, 5), ([], 0, 0, 3)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, x array<int>, f long, a long, b long").orderBy("k")
    assert [r[0] for r in df.select(lookup.trimmed(F.col("x"), F.col("f"), F.col("a"), F.col("b"))).collect()] == [[1, 2], [0, 1], [], [2, 3], [], []]


def test_latest_at(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 1), (4, "a", 0)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 5, 1.5), ("a", 7, None), ("b", 2, 9.0)], "k string, s int, v double")
    assert {r.i: r.v for r in lookup.latest_at(left, right, "k", "t", "s", "v", 3).collect()} == {1: 1.5, 2: None, 3: None, 4: None}


def test_index(spark):
    rows = spark.createDataFrame([(1, k, n, 5) for k, n in enumerate([10, 0, 7])] + [(2, 0, 3, 8)], "rec_id long, frame_no long, n_samples long, frame_size long")
    made = index.accumulated(rows, "rec_id", "frame_no")
    assert {(r.rec_id, r.frame_no): r.sample_pos for r in made.collect()} == {(1, 0): 0, (1, 1): 10, (1, 2): 10, (2, 0): 0}
    placed = index.accumulated(made, "rec_id", "frame_no", "frame_size", "byte_offset").withColumn("total_bytes", F.when(F.col("rec_id") == 1, 15).otherwise(0))
    assert {r.rec_id: (r.monotonic, r.in_bounds, r.sizes_ok, r.valid) for r in index.validated(placed).collect()} == {1: (True, True, True, True), 2: (True, False, True, False)}
    stats = {r.rec_id: r for r in index.statistics(placed, rate=10).collect()}
    assert (stats[1].total_samples, stats[1].duration_ms, stats[1].std_size) == (17, 1700, 0.0)
    ns = [1, 5000, 5001, 50_000, 60_000, 10_000_000]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in ns], "n long").select(index.adaptive_chunk(F.col("n"))).collect()] == [5000, 5000, 10_000, 12_500, 5000, 100_000]


def test_chunks(spark):
    df = spark.createDataFrame([(1, b"abcdefgh"), (2, b""), (3, None), (4, b"abc")], "k int, content binary")
    got = sorted((r.k, r.chunk_no, r.byte_start, r.byte_end, bytes(r.payload)) for r in index.split_chunks(df, "k", "content", 3).collect())
    assert got == [(1, 0, 0, 3, b"abc"), (1, 1, 3, 6, b"def"), (1, 2, 6, 8, b"gh"), (4, 0, 0, 3, b"abc")]


def test_row_numbers(spark):
    for values, kind in (([5, 3, 9, None, 1], "long"), (["b", "a", "c", None], "string"), ([], "long")):
        df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
        assert {r.v: r.i for r in row_numbers(df, "v", "i", 10).collect()} == {v: 10 + k for k, v in enumerate(sorted(values, key=lambda v: (v is not None, v or 0 if kind == "long" else v or "")))}
    assert [r.rec_id for r in catalog.assigned_ids(df.sparkSession.createDataFrame([("x",)], "v string"), None, "v").collect()] == [0]


def test_catalogue(spark):
    files = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", None)], "path string, sha256 string")
    known = spark.createDataFrame([("h1",), ("h1",)], "sha256 string")
    assert {r.path: r.already_imported for r in catalog.flag_known(files, known).collect()} == {"a": True, "b": False, "c": False}
    assert {r.path for r in catalog.fresh(files, known).collect()} == {"b", "c"}
    left, right = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k int, v int"), spark.createDataFrame([(2, 5), (3, None), (4, 0)], "k int, v int")
    assert {r.k: r.status for r in catalog.difference(left, right, "k", ("v",)).collect()} == {1: "missing", 2: "changed", 4: "extra"}
    row = catalog.snapshot(spark.createDataFrame([("abcdef", [1, 2, 3], {"b": 1, "a": 2})], "t string, x array<int>, m map<string,int>"), 2, 1).first()
    assert (row.t, row.x, row.m) == ("ab", [1], {"a": 2})


def test_sample_values(spark):
    df = spark.createDataFrame([(0.99999,), (-0.5,), (2.0,), (-2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(signal.to_int16(F.col("x"))).collect()] == [32_766, -16_383, 32_767, -32_768, None]


def test_spectra_invert():
    x = np.random.default_rng(0).normal(size=5000)
    assert np.allclose(signal.istft(signal.stft(x), len(x)), x, atol=1e-8)
    level, phase = signal.stereo_features(x * 2, x)
    assert np.allclose(level, 20 * np.log10(2), atol=1e-3) and np.allclose(phase, 0)
    labels = np.zeros(signal.stft(x).shape[1], int)
    assert np.allclose(signal.separated(x, x, labels, 0), x) and np.allclose(signal.separated(x, x, labels, 1), 0)


def test_mel_and_clusters(spark):
    t = np.arange(4096) / 8000
    rows = [(k, np.sin(2 * np.pi * (300 if k % 2 else 3000) * t).tolist()) for k in range(6)]
    features = signal.mel_features(spark.createDataFrame(rows, "request_id long, samples array<double>"), 8000).cache()
    labels = {}
    for r in signal.clustered(features.where("frame BETWEEN 2 AND 5"), "mel").collect():
        labels.setdefault(r.request_id % 2, set()).add(r.cluster)
    assert all(len(v) == 1 for v in labels.values()) and labels[0] != labels[1]


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("segments").start()
    query.processAllAvailable()
    query.stop()
    rounded = lambda df: sorted((r.start, r.event_type, r.n, round(r.rms, 9)) for r in df.collect())
    assert rounded(spark.table("segments")) == rounded(tumbling(events, "1 hour"))


def test_watch_gives_each_file_once(spark, tmp_path):
    from wavestrata.sources import formats

    (tmp_path / "in").mkdir()
    seen = []
    ingest = lambda files: seen.extend(r.path.rsplit("/", 1)[1] for r in probe.analysed(probe.probed(files)).where("can_be_imported").collect())
    for names in (["a.wav"], ["b.wav", "skip.txt"]):
        for name in names:
            (tmp_path / "in" / name).write_bytes(formats.wav_file(np.arange(50)[:, None], 8000))
        watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), ingest).awaitTermination(60)
    assert sorted(seen) == ["a.wav", "b.wav"]


def test_settings():
    conf = EngineConf().with_values(import_batch_size=5)
    assert EngineConf.from_yaml("# note\n" + conf.to_yaml()) == conf
    assert (conf.workers(8), EngineConf().workers(1), EngineConf().workers(100)) == (6, 1, 16)
    with pytest.raises(AttributeError):
        EngineConf().with_values(unknown=1)
    with pytest.raises(ValueError, match="320000"):
        EngineConf(aac_default_bitrate=1)
    with pytest.raises(TypeError):
        EngineConf(chunk_bytes="1")


def test_time_axis_has_no_gaps(spark, data):
    rows = tumbling(spark.read.parquet(f"{data}/events.parquet"), "3 seconds").select("start").distinct().collect()
    assert all((r.start - dt.datetime(2020, 1, 1)).total_seconds() % 3 == 0 for r in rows)


def test_each_of_equal_requests_gets_a_row(spark):
    frames = spark.createDataFrame([(1, k, 100 * k) for k in range(10)], "rec_id long, frame_no long, sample_pos long")
    asks = spark.createDataFrame([(1, 150, 420)] * 3 + [(1, 0, 5)], "rec_id long, start_sample long, end_sample long")
    got = sorted((r.start_sample, r.first_frame, r.last_frame) for r in lookup.frame_range(asks, frames).collect())
    assert got == [(0, 0, 1), *[(150, 1, 5)] * 3]


def test_latest_at_across_buckets_equals_a_plain_search(spark):
    import random

    rng = random.Random(4)
    right = [(rng.randrange(3), rng.randrange(400), k) for k in range(150)]
    left = [(k, rng.randrange(4), rng.choice([None, *range(-20, 450)])) for k in range(300)]
    found = lookup.latest_at(spark.createDataFrame(left, "i int, k int, t int"), spark.createDataFrame(right, "k int, s int, v int"), "k", "t", "s", "v", 37)
    best = lambda k, t: max(((s, v) for key, s, v in right if key == k and t is not None and s <= t), default=(0, None))[1]
    assert {r.i: r.v for r in found.collect()} == {i: best(k, t) for i, k, t in left}


def test_sequence_gaps(spark):
    from wavestrata.operators import index

    pages = spark.createDataFrame([(1, 10 * k, n) for k, n in enumerate([5, 6, 7, 9, 10])] + [(2, 0, 3)], "rec_id long, byte_offset long, page_no long")
    assert [tuple(r) for r in index.sequence_gaps(pages).collect()] == [(1, 30, 8, 9)]


def test_clusters_are_those_of_the_nearest_centre(spark):
    """Two groups far apart: k-means must find them, whatever it calls them."""
    from wavestrata.functions import signal

    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=4) + (10 if k % 2 else -10)).tolist()) for k in range(80)]
    got = {r.i: r.cluster for r in signal.clustered(spark.createDataFrame(rows, "i long, e array<double>"), "e").collect()}
    assert len({got[k] for k in range(0, 80, 2)}) == len({got[k] for k in range(1, 80, 2)}) == 1 and got[0] != got[1]
