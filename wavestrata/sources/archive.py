"""The archive: recordings, their bytes in chunks and their frame index, as Parquet tables in one folder.

    archive_meta   magic, version                                one row
    recordings     one row a recording, written last: what is listed there is complete
    blobs          rec_id, chunk_no, byte_start, byte_end, payload
    frames         rec_id, frame_no, byte_offset, frame_size, sample_pos, n_samples

blobs and frames are sorted by recording and place, so a range of bytes or samples reads few row groups.
Ids are claimed under a lock before anything is written and never given twice, also when an import fails or its
recordings are deleted: rows of blobs and frames whose id is not listed are not seen, and vacuum removes them.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavestrata.config import EngineConf
from wavestrata.errors import ArchiveBusy, CodecUnavailable, DuplicateRecording, ImportBlocked, IncompleteArchive, NotAnArchive, VersionMismatch
from wavestrata.functions import signal
from wavestrata.operators import catalog, index, lookup
from wavestrata.operators.ranking import row_numbers
from wavestrata.sources import codecs, formats, probe

MAGIC, VERSION = "wavestrata-archive", "2"
META = "magic string, version string"
RECORDINGS = f"""rec_id bigint, filename string, sha256 string, size_bytes bigint, has_audio boolean, nb_streams int, codec string, nb_channels int, sample_rate int,
 sampling_rescale_factor double, n_samples bigint, payload_from bigint, chunk_bytes int, encoding string, copy_mode boolean, target_transform string, first_sample_ts timestamp_ntz,
 container {probe.CONTAINER}, streams array<{probe.STREAM}>, general_meta variant, user_meta variant"""
BLOBS = "rec_id bigint, chunk_no int, byte_start bigint, byte_end bigint, payload binary"
FRAMES = "rec_id bigint, frame_no bigint, byte_offset bigint, frame_size bigint, sample_pos bigint, n_samples int"
#: Codecs of which samples can be encoded anew as FLAC, with their bits.
TO_FLAC = {"pcm_u8": 8, "pcm_s16le": 16, "pcm_s24le": 24}
_FEW = 1000  # recordings up to which requests name them in the scans
TABLES = {"recordings": RECORDINGS, "blobs": BLOBS, "frames": FRAMES}


class Archive:
    """An opened archive; its tables are DataFrames."""

    def __init__(self, spark: SparkSession, path: str, conf: EngineConf | None = None):
        self.spark, self.path, self.conf = spark, path.rstrip("/"), conf or EngineConf()

    # opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, conf: EngineConf | None = None) -> Archive:
        """A new, empty archive; a folder with anything in it raises."""
        new = cls(spark, path, conf)
        if new._exists(""):
            raise NotAnArchive(f"{path} exists already")
        for name, schema in TABLES.items():
            spark.createDataFrame([], schema).write.parquet(new._at(name))
        spark.createDataFrame([(MAGIC, VERSION)], META).coalesce(1).write.parquet(new._at("archive_meta"))
        return new

    @classmethod
    def open(cls, spark: SparkSession, path: str, create: bool = True, conf: EngineConf | None = None) -> Archive:
        """The archive at the path; made if create is true and nothing is there."""
        opened = cls(spark, path, conf)
        if not opened._exists(""):
            if not create:
                raise IncompleteArchive(f"nothing at {path}")
            return cls.create(spark, path, conf)
        opened.check()
        return opened

    def check(self) -> None:
        """Raises unless this folder is a whole archive of this version; ends replacements of tables that broke off."""
        if not self._exists("archive_meta"):
            raise NotAnArchive(f"{self.path} has no archive_meta")
        rows = self.spark.read.schema(META).parquet(self._at("archive_meta")).limit(2).collect()
        if len(rows) != 1 or rows[0].magic != MAGIC:
            raise NotAnArchive(f"{self.path} is not an archive")
        if rows[0].version != VERSION:
            raise VersionMismatch(f"version {rows[0].version}, not {VERSION}")
        for name in TABLES:
            if not self._exists(name) and self._exists(f"{name}.old"):
                self._renamed(f"{name}.new" if self._exists(f"{name}.new/_SUCCESS") else f"{name}.old", name)
        missing = [name for name in TABLES if not self._exists(name)]
        if missing:
            raise IncompleteArchive(f"{self.path} lacks {', '.join(missing)}")

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _place(self, name: str):  # noqa: ANN202
        """The file system and the path of a name in the folder."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(name) if name else self.path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _exists(self, name: str) -> bool:
        fs, place = self._place(name)
        return fs.exists(place)

    def _renamed(self, name: str, to: str) -> None:
        fs, place = self._place(name)
        if not fs.rename(place, self._place(to)[1]):
            raise OSError(f"{name} cannot be renamed to {to}")

    # reading

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self._at(name))

    @property
    def recordings(self) -> DataFrame:
        return self.table("recordings")

    @property
    def frames(self) -> DataFrame:
        return self.table("frames").join(self.recordings.select("rec_id"), "rec_id", "left_semi")

    @property
    def blobs(self) -> DataFrame:
        return self.table("blobs").join(self.recordings.select("rec_id"), "rec_id", "left_semi")

    def __len__(self) -> int:
        return self.recordings.count()

    def __contains__(self, rec_id: int) -> bool:
        return bool(self.recordings.where(F.col("rec_id") == rec_id).limit(1).count())

    def __iter__(self) -> Iterator[int]:
        return (r.rec_id for r in self.recordings.select("rec_id").orderBy("rec_id").toLocalIterator())

    def __getitem__(self, rec_id: int) -> T.Row:
        rows = self.recordings.where(F.col("rec_id") == rec_id).limit(1).collect()
        if not rows:
            raise KeyError(rec_id)
        return rows[0]

    def __repr__(self) -> str:
        return f"Archive({self.path!r})"

    def where_meta(self, path: str, kind: str, condition: str, of: str = "user_meta") -> DataFrame:
        """Recordings whose metadata value at the JSON path, named v in the condition, fulfils it."""
        return self.recordings.withColumn("v", F.try_variant_get(of, path, kind)).where(condition).drop("v")

    def snapshot(self, text: int = 32, items: int = 32) -> dict[str, DataFrame]:
        plain = self.recordings.withColumns({c: F.to_json(c) for c in ("general_meta", "user_meta")})
        return {"recordings": catalog.snapshot(plain, text, items), "blobs": catalog.snapshot(self.blobs, text, items), "frames": self.frames}

    def index_summary(self) -> DataFrame:
        """Per recording the statistics of its frame index, and in chunks of how many frames the settings would cut it."""
        rates = self.recordings.select("rec_id", "sample_rate")
        c = self.conf
        stats = index.statistics(self.frames.join(rates, "rec_id").withColumnRenamed("sample_rate", "rate"), rate=None)
        return stats.withColumn("index_chunk", index.adaptive_chunk(F.col("total_frames"), c.index_chunk_frames, c.index_min_chunk_frames, c.index_max_chunks))

    # writing

    def is_known(self, files: DataFrame) -> DataFrame:
        """Analysed files with already_imported, by content hash."""
        return catalog.flag_known(files, self.recordings)

    def import_files(self, files: DataFrame, user_meta: dict | None = None, first_sample_ts: F.Column | None = None, on_duplicate: str = "raise") -> DataFrame:
        """Analysed files become recordings; one result row a file, in the order of paths.

        A batch with a file that cannot be imported raises and changes nothing; so does one with content that
        the archive or the batch has already, unless on_duplicate is "skip". Integer PCM and FLAC whose target is FLAC are
        encoded, or kept if they are FLAC at its rate already; all other bytes are kept as they are, and the result says so.
        """
        known = self.is_known(files.drop("content").withColumn("__copy", F.row_number().over(_by_content())))
        known = known.withColumn("already_imported", F.col("already_imported") | (F.col("__copy") > 1)).drop("__copy")
        staging = self._at(f"staging-{uuid.uuid4().hex}")
        try:
            known.write.parquet(staging)  # decided once; what is written below does not change it
            staged = self.spark.read.schema(known.schema).parquet(staging)
            self._refuse(staged, on_duplicate)
            fresh = staged.where("NOT already_imported")
            numbered = row_numbers(fresh, "path", "rec_id", start=self._claimed(fresh.count()))
            rows = _described(numbered, user_meta, first_sample_ts, self.conf)
            self._written(rows, files.select("path", "content"))
            return self._results(staged, rows)
        finally:
            self._delete(staging)

    def _claimed(self, n: int) -> int:
        """The first of n ids that nothing else gets. The highest claim is a file's name, written under a lock."""
        fs, lock = self._place("claims/lock")
        fs.mkdirs(lock.getParent())
        for _ in range(600):
            if self._made(fs, lock):
                break
            time.sleep(0.1)
        else:
            raise ArchiveBusy(f"{lock} is held; delete it if no import runs")
        try:
            names = [f.getPath().getName() for f in fs.listStatus(lock.getParent())]
            ends = [int(x.partition("-")[2]) for x in names if "-" in x]
            last = self.recordings.agg(F.max("rec_id")).first()[0]
            first = max([0 if last is None else last + 1, *ends])
            if n:
                fs.createNewFile(self._place(f"claims/{first}-{first + n}")[1])
                for x in names:
                    if "-" in x:
                        fs.delete(self._place(f"claims/{x}")[1], False)
            return first
        finally:
            fs.delete(lock, False)

    @staticmethod
    def _made(fs, place) -> bool:  # noqa: ANN001
        """Whether this call made the file; Hadoop's local file system does not do that in one step, so there the system call does."""
        if fs.getScheme() != "file":
            return fs.createNewFile(place)
        try:
            os.close(os.open(place.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True

    def _refuse(self, files: DataFrame, on_duplicate: str) -> None:
        bad = files.where("NOT can_be_imported").select("path", F.coalesce(F.try_element_at("conflicts.blocking", F.lit(1)), "probe_error", F.lit("no audio that can be stored")).alias("why")).limit(5).collect()
        if bad:
            raise ImportBlocked("; ".join(f"{r.path}: {r.why}" for r in bad))
        if on_duplicate == "raise" and (known := files.where("already_imported").select("path").limit(5).collect()):
            raise DuplicateRecording(", ".join(r.path for r in known))

    def _written(self, rows: DataFrame, contents: DataFrame) -> None:
        """The bytes as stored, their frame index and last the list of recordings."""
        fields = ["path", "rec_id", "source_codec", "source_rate", "bits", "nb_channels", "payload_from_source", "payload_to", "transform", "sample_rate", "copy_mode"]
        small = rows.select(*fields)
        if rows.count() <= 100_000:  # some hundred bytes a file: the contents need no exchange
            small = F.broadcast(small)
        chunk, names = self.conf.chunk_bytes, fields

        def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    data = stored_bytes(bytes(r.content), r)
                    for k, at in enumerate(range(0, len(data), chunk)):
                        part = data[at : at + chunk]
                        yield pd.DataFrame([(r.rec_id, k, at, at + len(part), part)], columns=["rec_id", "chunk_no", "byte_start", "byte_end", "payload"])

        blobs = contents.join(small, "path").select(*names, "content").mapInPandas(store, BLOBS)
        blobs.repartitionByRange("rec_id", "chunk_no").sortWithinPartitions("rec_id", "chunk_no").write.mode("append").parquet(self._at("blobs"))
        frames = built_frames(rows, self.table("blobs").join(rows.select("rec_id"), "rec_id", "left_semi"))
        frames.repartitionByRange("rec_id", "frame_no").sortWithinPartitions("rec_id", "frame_no").write.mode("append").parquet(self._at("frames"))
        rows.select(*[f.name for f in T.StructType.fromDDL(RECORDINGS)]).write.mode("append").parquet(self._at("recordings"))

    def _results(self, files: DataFrame, done: DataFrame) -> DataFrame:
        stored = self.table("blobs").join(done.select("rec_id"), "rec_id", "left_semi").groupBy("rec_id").agg(F.sum(F.col("byte_end") - F.col("byte_start")).alias("compressed_size_bytes"))
        done = done.select("path", "rec_id", F.col("codec").alias("target_format"), F.col("target_transform"), F.col("copy_mode").alias("copy_mode_used"), "sample_rate").join(stored, "rec_id", "left")
        rows = files.join(done, "path", "left").select(
            "path", F.col("rec_id").isNotNull().alias("success"), "rec_id", "target_format", "target_transform",
            F.col("stream.codec_name").alias("source_codec"), F.col("stream.sample_rate").alias("source_sample_rate"), F.col("sample_rate").alias("target_sample_rate"), F.col("stream.nb_channels").alias("source_channels"),
            F.col("length").alias("original_size_bytes"), "compressed_size_bytes", catalog.compression_ratio(F.col("length"), F.col("compressed_size_bytes")).alias("compression_ratio"), "copy_mode_used",
            F.concat("conflicts.quality", "conflicts.efficiency").alias("conflicts_detected"), "already_imported",
        )
        got = rows.orderBy("path").collect()  # one short row a file of the batch
        return self.spark.createDataFrame([(k, *r) for k, r in enumerate(got)], T.StructType([T.StructField("input_no", T.IntegerType()), *rows.schema.fields]))

    def delete(self, rec_id: int) -> None:
        """Takes a recording out of the list; its bytes stay until vacuum."""
        if rec_id not in self:
            raise KeyError(rec_id)
        self._replace("recordings", self.recordings.where(F.col("rec_id") != rec_id))

    def vacuum(self) -> None:
        """Rewrites blobs and frames without what no recording refers to."""
        self._replace("blobs", self.blobs)
        self._replace("frames", self.frames)

    def rebuild_index(self) -> None:
        """The frame index of all recordings, made anew from their bytes."""
        self._replace("frames", built_frames(self.recordings, self.blobs))

    def _replace(self, name: str, rows: DataFrame) -> None:
        """New rows for a table. The old ones stay until the new ones are in place; check() ends what breaks off between."""
        fresh, old = f"{name}.new", f"{name}.old"
        rows.write.mode("overwrite").parquet(self._at(fresh))
        self._delete(self._at(old))
        self._renamed(name, old)
        self._renamed(fresh, name)
        self._delete(self._at(old))
        self.spark.catalog.refreshByPath(self._at(name))

    def _delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    # extraction

    def segments(self, requests: DataFrame, dtype: str = "int16") -> DataFrame:
        """(request_id, rec_id, start_sample, samples, error): samples start to end, inclusive, as an array of channels.

        requests has request_id, rec_id, start_sample and end_sample. A request beyond the recording is cut, an empty
        one gives no samples; what cannot be decoded says so in error. Only the chunks that hold the request's frames are read.
        """
        return extracted(requests, self.recordings, self.frames, self.blobs, dtype)

    def segment(self, rec_id: int, start: int, end: int, dtype: str = "int16") -> np.ndarray:
        """(samples, channels) of one request."""
        if rec_id not in self:
            raise KeyError(rec_id)
        ask = self.spark.createDataFrame([(0, rec_id, start, end)], "request_id long, rec_id long, start_sample long, end_sample long")
        row = self.segments(ask, dtype).first()
        if row.error:
            raise CodecUnavailable(row.error)
        return np.array(row.samples, dtype).T if row.samples else np.zeros((0, self[rec_id].nb_channels), dtype)

    def export_wav(self, rec_id: int, start: int = 0, end: int | None = None) -> bytes:
        """A WAV file of the samples start to end, all if not given."""
        last = self[rec_id].n_samples - 1
        return formats.wav_file(self.segment(rec_id, start, last if end is None else end), self[rec_id].sample_rate)


def _by_content():
    from pyspark.sql import Window

    return Window.partitionBy("sha256").orderBy("path")


def _described(files: DataFrame, user_meta: dict | None, first_sample_ts: F.Column | None, conf: EngineConf) -> DataFrame:
    """Analysed files with the columns of recordings, and what stored_bytes needs to know."""
    s, target = F.col("stream"), F.col("target")
    source, rate = s["codec_name"], s["sample_rate"]
    moved = target["transform"].isin("resampling", "reinterpreting") & target["transform_rate"].isNotNull() & (target["transform_rate"] != rate)
    bits = F.coalesce(F.regexp_extract(s["sample_format"], "([0-9]+)", 1).try_cast("int"), F.lit(16))
    integers = source.isin(*TO_FLAC) | ((source == "flac") & moved)
    encode = (target["code"] == "flac") & integers & (s["nb_channels"] <= 8) & bits.isin(*TO_FLAC.values()) & (rate < 1 << 20)
    moved &= encode
    new_rate = F.when(moved, target["transform_rate"]).otherwise(rate)
    resampled = moved & (target["transform"] == "resampling")
    return files.withColumns({
        "source_codec": source, "source_rate": rate, "bits": bits, "payload_from_source": F.col("payload_from"), "transform": F.when(moved, target["transform"]),
        "filename": F.element_at(F.split("path", "/"), -1), "size_bytes": F.col("length"), "has_audio": F.size("streams") > 0, "nb_streams": F.size("streams"),
        "codec": F.when(encode, "flac").otherwise(source), "nb_channels": s["nb_channels"], "sample_rate": new_rate.cast("int"),
        "sampling_rescale_factor": F.when(moved & ~resampled, rate / target["transform_rate"]).otherwise(1.0).cast("double"),
        "n_samples": F.when(resampled, F.round(s["nb_samples"] * target["transform_rate"] / rate).cast("bigint")).otherwise(s["nb_samples"]),
        "chunk_bytes": F.lit(conf.chunk_bytes), "encoding": F.lit("bytes"), "copy_mode": ~encode, "target_transform": F.when(moved, target["transform"]).otherwise("exactly"),
        "first_sample_ts": F.lit(None).cast("timestamp_ntz") if first_sample_ts is None else first_sample_ts,
        "general_meta": F.parse_json(F.to_json(F.struct("container", "streams", "tags"))), "user_meta": F.parse_json(F.lit(json.dumps(user_meta or {}))),
    }).withColumn("payload_from", F.when(F.col("copy_mode"), F.col("payload_from")).otherwise(0))


def stored_bytes(content: bytes, r) -> bytes:  # noqa: ANN001
    """The bytes to keep of a file: itself, or its samples at the recording's rate as FLAC."""
    if r.copy_mode:
        return content
    frames = codecs.frame_table(content, r.source_codec, r.nb_channels, 0, 0)
    body = content[int(frames[0, 0]) :] if r.source_codec == "flac" and len(frames) else content[int(r.payload_from_source) : int(r.payload_to)]
    x = codecs.decoded(body, r.source_codec, int(r.nb_channels), int(r.bits))
    if r.transform == "resampling":
        top = 1 << (int(r.bits) - 1)
        x = np.clip(np.rint(signal.resampled(x.astype(np.float64), int(r.source_rate), int(r.sample_rate))), -top, top - 1).astype(np.int64)
    return codecs.encoded(x, "flac", int(r.sample_rate), int(r.bits))


def built_frames(recordings: DataFrame, blobs: DataFrame) -> DataFrame:
    """The frame index of recordings, from their stored bytes; a recording is indexed by one task."""

    def build(info: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        if not len(info) or not len(chunks):
            return pd.DataFrame({c: [] for c in FRAME_COLUMNS})
        r = info.iloc[0]
        content = b"".join(map(bytes, chunks.sort_values("chunk_no").payload))
        out = pd.DataFrame(codecs.frame_table(content, r.codec, int(r.nb_channels), int(r.n_samples), int(r.payload_from)), columns=FRAME_COLUMNS[2:])
        out.insert(0, "frame_no", np.arange(len(out)))
        out.insert(0, "rec_id", r.rec_id)
        return out

    info = recordings.select("rec_id", "codec", "nb_channels", "n_samples", "payload_from")
    return info.groupBy("rec_id").cogroup(blobs.select("rec_id", "chunk_no", "payload").groupBy("rec_id")).applyInPandas(build, FRAMES)


FRAME_COLUMNS = [f.split()[0] for f in FRAMES.split(", ")]


def extracted(requests: DataFrame, recordings: DataFrame, frames: DataFrame, blobs: DataFrame, dtype: str = "int16") -> DataFrame:
    """Segments for requests: frames by overlap join, byte ranges from the frames, chunks by number, then decode and trim.

    Up to _FEW recordings are named in the scans of frames and chunks, together with the range of chunk numbers asked for, so row groups and
    pages of others are not read. More recordings meet their chunks by the join alone. A request_id must not repeat.
    """
    if dtype not in ("int16", "float32"):
        raise ValueError("dtype must be int16 or float32")
    ids = [r.rec_id for r in requests.select("rec_id").where("rec_id IS NOT NULL").distinct().limit(_FEW + 1).collect()]
    if len(ids) <= _FEW:
        recordings, frames, blobs = (t.where(F.col("rec_id").isin(ids)) for t in (recordings, frames, blobs))
    ranged = frames.withColumn("last_sample", F.col("sample_pos") + F.col("n_samples") - 1)
    asked = requests.select("request_id", "rec_id", F.greatest("start_sample", F.lit(0)).alias("start_sample"), "end_sample")
    hit = lookup.overlap_join(asked, ranged, "rec_id", ("start_sample", "end_sample"), ("sample_pos", "last_sample"), 1 << 20)
    spans = hit.groupBy("request_id", "rec_id").agg(F.min("byte_offset").alias("byte_from"), F.max(F.col("byte_offset") + F.col("frame_size")).alias("byte_to"), F.min("sample_pos").alias("frame_start"))
    spans = spans.join(recordings.select("rec_id", "chunk_bytes"), "rec_id")
    if len(ids) <= _FEW:
        low, high = spans.agg(F.min(F.expr("byte_from div chunk_bytes")), F.max(F.expr("(byte_to - 1) div chunk_bytes"))).first()
        blobs = blobs.where(F.col("chunk_no").between(low or 0, high or 0))
    pieces = lookup.chunks_covering(spans, blobs, size="chunk_bytes").select(F.col("request_id").alias("of_request"), "chunk_no", "byte_start", "payload")
    info = recordings.select("rec_id", "codec", "nb_channels", F.coalesce(F.regexp_extract(F.col("streams")[0]["sample_format"], "([0-9]+)", 1).try_cast("int"), F.lit(16)).alias("bits"))
    jobs = asked.join(info, "rec_id", "left").join(spans.drop("rec_id", "chunk_bytes"), "request_id", "left")
    element = "smallint" if dtype == "int16" else "float"
    schema = f"request_id bigint, rec_id bigint, start_sample bigint, samples array<array<{element}>>, error string"

    def solve(key: tuple, job: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for j in job.itertuples():
            samples, error = None, None
            if pd.isna(j.codec):
                error = f"no recording {j.rec_id}"
            elif pd.isna(j.byte_from):
                samples = [[] for _ in range(int(j.nb_channels))]
            else:
                try:
                    parts = chunks.sort_values("chunk_no")
                    data, start = b"".join(map(bytes, parts.payload)), int(parts.byte_start.iloc[0])
                    x = codecs.decoded(data[int(j.byte_from) - start : int(j.byte_to) - start], j.codec, int(j.nb_channels), int(j.bits))
                    x = codecs.as_int16(x, codecs.pcm_bits(j.codec) if j.codec.startswith("pcm_") else int(j.bits))
                    off = int(j.start_sample - j.frame_start)
                    x = x[off : off + int(j.end_sample - j.start_sample) + 1]
                    samples = (x.T / 32767).tolist() if dtype == "float32" else x.T.tolist()
                except (CodecUnavailable, ValueError) as e:
                    error = str(e)
            out.append((j.request_id, j.rec_id, j.start_sample, samples, error))
        return pd.DataFrame(out, columns=["request_id", "rec_id", "start_sample", "samples", "error"])

    return jobs.groupBy("request_id").cogroup(pieces.groupBy("of_request")).applyInPandas(solve, schema)
