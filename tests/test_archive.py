import re

import numpy as np
import pytest

from wavestrata.errors import DuplicateRecording, ImportBlocked, IncompleteArchive, NotAnArchive, VersionMismatch
from wavestrata.sources import formats, probe
from wavestrata.sources.archive import META, Archive


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(12345)
    walk = lambda n, c: (np.cumsum(rng.integers(-200, 200, (n, c)), 0) % 40000 - 20000).astype(np.int64)
    return {"mono": walk(20_000, 1), "stereo": walk(9_001, 2), "flac": walk(12_345, 2)}


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory, signals):
    files = tmp_path_factory.mktemp("files")
    (files / "a_mono.wav").write_bytes(formats.wav_file(signals["mono"], 48_000))
    (files / "b_stereo.wav").write_bytes(formats.wav_file(signals["stereo"], 44_100))
    (files / "c.flac").write_bytes(formats.flac_file(signals["flac"], 48_000))
    (files / "d.aac").write_bytes(b"".join(formats.adts_frame(bytes([k % 251] * 300)) for k in range(50)))
    made = Archive.open(spark, str(tmp_path_factory.mktemp("archive") / "x"))
    results = made.import_files(probe.analysed(probe.probed(probe.read_files(spark, str(files)))), user_meta={"site": "north", "year": 2024}).collect()
    assert [r.rec_id for r in results] == [0, 1, 2, 3] and all(r.success for r in results)
    made.files = files
    return made


def test_recordings_and_metadata(archive):
    assert len(archive) == 4 and 2 in archive and 9 not in archive and list(archive) == [0, 1, 2, 3]
    row = archive[2]
    assert (row.codec, row.nb_channels, row.sample_rate, row.n_samples) == ("flac", 2, 48_000, 12_345)
    assert archive.where_meta("$.year", "int", "v = 2024").count() == 4
    assert archive.where_meta("$.site", "string", "v = 'south'").count() == 0
    with pytest.raises(KeyError):
        archive[99]


def test_random_segments_equal_the_source(spark, archive, signals):
    rng = np.random.default_rng(1)
    asks, expected = [], {}
    for rec, name in ((0, "mono"), (1, "stereo"), (2, "flac")):
        x = signals[name]
        for a, b in [(0, 0), (0, len(x) - 1), (len(x) - 1, len(x) + 500), (-5, 10), (5, 2), (len(x) + 1, len(x) + 2), (4095, 4096), *np.sort(rng.integers(0, len(x), (5, 2)), 1).tolist()]:
            expected[len(asks)] = x[max(0, a) : b + 1] if b >= a else x[:0]
            asks.append((len(asks), rec, a, b))
    asks += [(len(asks), 3, 0, 10), (len(asks) + 1, 77, 0, 10)]
    rows = {r.request_id: r for r in archive.segments(spark.createDataFrame(asks, "request_id long, rec_id long, start_sample long, end_sample long")).collect()}
    assert len(rows) == len(asks)
    for k, x in expected.items():
        assert rows[k].error is None and rows[k].samples == x.T.tolist(), asks[k]
    assert "no decoder for aac" in rows[len(expected)].error and "no recording" in rows[len(expected) + 1].error


def test_float_segment_and_export(archive, signals):
    assert np.allclose(archive.segment(0, 10, 20, "float32")[:, 0], signals["mono"][10:21, 0] / 32767, atol=1e-6)
    stream = formats.parse(data := archive.export_wav(1, 5, 104))
    assert (formats.pcm_samples(data[stream.payload[0] : stream.payload[1]], stream.codec, 2) == signals["stereo"][5:105]).all()


def test_frames_fulfil_the_invariants(archive):
    rows = archive.frames.orderBy("rec_id", "frame_no").collect()
    for rec in range(4):
        own = [r for r in rows if r.rec_id == rec]
        assert [r.frame_no for r in own] == list(range(len(own)))
        assert all(b.sample_pos == a.sample_pos + a.n_samples and b.byte_offset >= a.byte_offset + a.frame_size for a, b in zip(own, own[1:], strict=False))
        assert own[-1].sample_pos + own[-1].n_samples == archive[rec].n_samples
    before = {tuple(r) for r in rows}
    archive.rebuild_index()
    assert {tuple(r) for r in archive.frames.collect()} == before


def test_known_content_is_refused_or_skipped(spark, archive):
    again = probe.analysed(probe.probed(probe.read_files(spark, str(archive.files / "a_mono.wav"))))
    assert archive.is_known(again).first().already_imported
    with pytest.raises(DuplicateRecording):
        archive.import_files(again)
    assert not archive.import_files(again, on_duplicate="skip").first().success and len(archive) == 4


def test_a_file_that_cannot_be_imported_stops_the_batch(spark, archive, tmp_path):
    (tmp_path / "fake.wav").write_bytes(b"this is not audio")
    (tmp_path / "good.wav").write_bytes(formats.wav_file(np.arange(100)[:, None], 8000))
    with pytest.raises(ImportBlocked, match="fake.wav"):
        archive.import_files(probe.analysed(probe.probed(probe.read_files(spark, str(tmp_path)))))
    assert len(archive) == 4


def test_delete_hides_and_vacuum_removes(spark, archive, tmp_path):
    own = Archive.create(spark, str(tmp_path / "y"))
    own.import_files(probe.analysed(probe.probed(probe.read_files(spark, str(archive.files / "a_mono.wav"), str(archive.files / "b_stereo.wav")))))
    own.delete(0)
    assert list(own) == [1] and own.frames.where("rec_id = 0").count() == 0
    own.vacuum()
    assert own.table("blobs").where("rec_id = 0").count() == 0 and own.segment(1, 0, 3).shape == (4, 2)
    with pytest.raises(KeyError):
        own.delete(0)


def test_opening_checks_the_folder(spark, archive, tmp_path):
    with pytest.raises(IncompleteArchive):
        Archive.open(spark, str(tmp_path / "none"), create=False)
    (tmp_path / "other").mkdir()
    with pytest.raises(NotAnArchive):
        Archive.open(spark, str(tmp_path / "other"))
    with pytest.raises(NotAnArchive):
        Archive.create(spark, archive.path)
    spark.createDataFrame([("wavestrata-archive", "0")], META).write.parquet(str(tmp_path / "old" / "archive_meta"))
    with pytest.raises(VersionMismatch):
        Archive.open(spark, str(tmp_path / "old"))
    assert set(archive.snapshot()) == {"recordings", "blobs", "frames"}


def files_of(spark, folder, **chosen):
    return probe.analysed(probe.probed(probe.read_files(spark, str(folder))), **chosen)


def wav(folder, name, n, rate=48_000, seed=0):
    x = np.random.default_rng(seed).integers(-3000, 3000, (n, 1))
    (folder / name).mkdir(parents=True)
    (folder / name / f"{name}.wav").write_bytes(formats.wav_file(x, rate))
    return x


def test_ids_of_deleted_recordings_are_not_given_again(spark, tmp_path):
    a, b, c = (wav(tmp_path / "files", name, n, seed=n) for name, n in (("a", 9000), ("b", 12_000), ("c", 12_000 + 500)))
    own = Archive.create(spark, str(tmp_path / "x"))
    own.import_files(files_of(spark, tmp_path / "files" / "a"))
    own.import_files(files_of(spark, tmp_path / "files" / "b"))
    own.delete(1)
    assert [r.rec_id for r in own.import_files(files_of(spark, tmp_path / "files" / "c")).collect()] == [2]
    assert list(own) == [0, 2] and (own.segment(2, 11_990, 14_000) == c[11_990:]).all() and (own.segment(0, 0, 20_000) == a).all()
    own.delete(2)
    own.vacuum()
    assert [r.rec_id for r in own.import_files(files_of(spark, tmp_path / "files" / "b")).collect()] == [3] and (own.segment(3, 0, 20_000) == b).all()


def test_an_import_that_fails_leaves_nothing_to_be_seen(spark, tmp_path, monkeypatch):
    a, b = wav(tmp_path / "files", "a", 5000), wav(tmp_path / "files", "b", 6000, seed=1)
    own = Archive.create(spark, str(tmp_path / "x"))
    with monkeypatch.context() as patch:
        patch.setattr("wavestrata.sources.archive.built_frames", lambda *_: 1 / 0)  # after the bytes are written
        with pytest.raises(ZeroDivisionError):
            own.import_files(files_of(spark, tmp_path / "files" / "a"))
    assert own.table("blobs").count() > 0 and len(own) == own.blobs.count() == 0
    assert [r.rec_id for r in own.import_files(files_of(spark, tmp_path / "files" / "b")).collect()] == [1]
    assert (own.segment(1, 0, 9999) == b).all() and own.blobs.where("rec_id = 0").count() == 0
    own.vacuum()
    assert own.table("blobs").where("rec_id = 0").count() == 0
    assert own.import_files(files_of(spark, tmp_path / "files" / "a")).first().rec_id == 2 and (own.segment(2, 0, 9999) == a).all()


def test_two_imports_get_different_ids(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    own = Archive.create(spark, str(tmp_path / "x"))
    with ThreadPoolExecutor(4) as pool:
        firsts = list(pool.map(own._claimed, [3, 2, 5, 1]))
    got = sorted(x for first, n in zip(firsts, [3, 2, 5, 1], strict=True) for x in range(first, first + n))
    assert got == list(range(11))


def test_a_replacement_that_broke_off_is_ended(spark, archive, tmp_path):
    own = Archive.create(spark, str(tmp_path / "y"))
    own.import_files(files_of(spark, archive.files / "a_mono.wav"))
    (tmp_path / "y" / "recordings").rename(tmp_path / "y" / "recordings.old")
    assert len(Archive.open(spark, str(tmp_path / "y"))) == 1
    own.recordings.write.parquet(str(tmp_path / "y" / "recordings.new"))
    (tmp_path / "y" / "recordings").rename(tmp_path / "y" / "recordings.old")
    assert len(Archive.open(spark, str(tmp_path / "y"))) == 1


def test_integer_pcm_becomes_flac(archive, signals):
    row, kept = archive[0], archive[2]
    assert (row.codec, row.copy_mode, row.n_samples, kept.copy_mode) == ("flac", False, 20_000, True)
    whole = b"".join(r.payload for r in archive.blobs.where("rec_id = 0").orderBy("chunk_no").collect())
    frames = formats.flac_frames(whole)
    assert (formats.flac_decode(whole[frames[0, 0] :], 16) == signals["mono"]).all()


@pytest.mark.parametrize(("transform", "n", "factor"), [("resampling", 6000, 1.0), ("reinterpreting", 12_000, 2.0)])
def test_transforms_change_rate_or_meaning(spark, tmp_path, transform, n, factor):
    from pyspark.sql import functions as F

    x = wav(tmp_path / "files", "a", 12_000)
    chosen = {"sample_rate": F.lit(24_000), "transform": F.lit(transform), "transform_rate": F.lit(24_000)}
    own = Archive.create(spark, str(tmp_path / "x"))
    row = own.import_files(files_of(spark, tmp_path / "files", **chosen)).first()
    got = own[0]
    assert (row.target_transform, row.target_sample_rate, row.copy_mode_used) == (transform, 24_000, False)
    assert (got.sample_rate, got.n_samples, got.sampling_rescale_factor) == (24_000, n, factor)
    y = own.segment(0, 0, n)
    assert len(y) == n and (transform == "resampling" or (y == x).all())
    if transform == "resampling":  # a low tone stays what it is
        assert abs(y.mean() - x.mean()) < 20


def test_a_stream_that_is_not_there_cannot_be_imported(spark, archive):
    from pyspark.sql import functions as F

    files = probe.probed(probe.read_files(spark, str(archive.files / "a_mono.wav")))
    chosen = [probe.analysed(files, selected=F.array(F.lit(k))).first() for k in (0, 3)]
    assert [r.can_be_imported for r in chosen] == [True, False] and chosen[0].stream["index"] == 0 and chosen[1].stream is None


def test_a_codec_can_be_registered(spark, archive, monkeypatch):
    from wavestrata.sources import codecs

    monkeypatch.setitem(codecs.CODECS, "aac", codecs.Codec(codecs.CODECS["aac"].frames, lambda data, *_: np.arange(1024 * len(formats.adts_frames(data)))[:, None]))
    assert archive.segment(3, 1030, 1033)[:, 0].tolist() == [6, 7, 8, 9]


def test_segments_name_recordings_and_chunks_in_their_scans(spark, archive):
    ask = spark.createDataFrame([(0, 2, 100, 300)], "request_id long, rec_id long, start_sample long, end_sample long")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = archive.segments(ask)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [x for x in re.findall(r"FileScan parquet.*?ReadSchema: struct<[^\n]*", plan, re.S) if "payload" in x]
    assert scans
    for x in scans:
        assert "EqualTo(rec_id,2)" in x and "GreaterThanOrEqual(chunk_no,0)" in x and "LessThanOrEqual(chunk_no,0)" in x


def test_results_say_what_was_stored(spark, tmp_path):
    wav(tmp_path / "files", "a", 4000)
    (tmp_path / "files" / "b.aac").write_bytes(b"".join(formats.adts_frame(bytes([k % 251] * 300)) for k in range(20)))
    rows = Archive.create(spark, str(tmp_path / "x")).import_files(files_of(spark, tmp_path / "files")).collect()
    assert [(r.input_no, r.target_format, r.copy_mode_used) for r in rows] == [(0, "flac", False), (1, "aac", True)]
    assert all(abs(r.compression_ratio - r.original_size_bytes / r.compressed_size_bytes) < 1e-9 for r in rows)


def test_index_summary_follows_the_settings(spark, archive):
    from wavestrata.config import EngineConf

    rows = {r.rec_id: r for r in archive.index_summary().collect()}
    assert rows[0].total_frames == 5 and rows[0].total_samples == 20_000 and rows[0].duration_ms == 416 and rows[0].index_chunk == 5000
    small = Archive(spark, archive.path, EngineConf(index_min_chunk_frames=2))
    assert {r.rec_id: r.index_chunk for r in small.index_summary().collect()}[0] == 5
