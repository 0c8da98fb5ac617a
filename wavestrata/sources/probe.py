"""Media probe: binary files to one row of parameters each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavestrata.config import EngineConf
from wavestrata.functions import rules, values
from wavestrata.sources import formats

STREAM = "struct<index:int,nb_channels:int,sample_rate:int,sample_format:string,codec_name:string,nb_samples:bigint,bit_rate:int>"
CONTAINER = "struct<format_name:string,duration:double,size:bigint,nb_streams:int>"
#: Codecs whose samples can be read here, and those that can be stored as they are.
DECODABLE = ("pcm_u8", "pcm_s16le", "pcm_s24le", "pcm_s32le", "pcm_f32le", "pcm_f64le", "flac")
STORABLE = (*DECODABLE, "aac", "opus")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files under the paths."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))


_FOUND = f"container {CONTAINER}, streams array<{STREAM}>, tags map<string,string>, payload_from bigint, payload_to bigint, probe_error string"


def probed(files: DataFrame) -> DataFrame:
    """files with sha256, container, streams, tags, payload_from, payload_to and probe_error; content stays.

    The rows pass through Python once, content included, and nothing is joined back. Empty, damaged and unknown files have no stream;
    a null content is empty. Columns of files with the names of added ones are replaced.
    """
    added = T.StructType.fromDDL(_FOUND)
    hashed = files.drop(*added.names).withColumn("sha256", values.content_hash(F.col("content")))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf.reset_index(drop=True), _parsed(pdf.content)], axis=1)

    return hashed.mapInPandas(parse, T.StructType([*hashed.schema.fields, *added.fields]))


def _parsed(contents: pd.Series) -> pd.DataFrame:
    rows = []
    for content in contents:
        data = b"" if content is None else bytes(content)
        error, s = None, None
        try:
            s = formats.parse(data)
        except (ValueError, StopIteration, IndexError, formats.OggFormatError) as e:
            error = str(e) or type(e).__name__
        if s is None:
            rows.append(({"format_name": None, "duration": None, "size": len(data), "nb_streams": 0}, [], {}, None, None, error))
            continue
        seconds = s.n_samples / s.sample_rate if s.n_samples is not None and s.sample_rate else None
        stream = {"index": 0, "nb_channels": s.channels, "sample_rate": s.sample_rate, "sample_format": s.sample_format, "codec_name": s.codec, "nb_samples": s.n_samples, "bit_rate": s.bit_rate}
        rows.append(({"format_name": s.container, "duration": seconds, "size": len(data), "nb_streams": 1}, [stream], s.tags, *s.payload, error))
    return pd.DataFrame(rows, columns=["container", "streams", "tags", "payload_from", "payload_to", "probe_error"]).astype({"payload_from": "Int64", "payload_to": "Int64"})


def _computed(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """rows with a column that filters above it refer to by name. Each rule uses the ones before many times; put in for each other, they outgrow the optimizer."""
    return rows.drop(name).select("*", F.explode(F.array(column)).alias(name))


def analysed(files: DataFrame, selected: Column | None = None, wanted_code: Column | None = None, conf: EngineConf | None = None, **chosen: Column) -> DataFrame:
    """probed files with stream, quality, target, conflicts and can_be_imported; chosen overrides fields of the target.

    Chosen bitrates from 32000 to 320000 and FLAC levels from 0 to 12 only; others raise. conf has the ultrasound limit and the default bitrate and level.
    stream is the selected one (selected holds the indexes of a file's selected streams), the first if none is selected; it is the one that is judged and imported.
    """
    conf = conf or EngineConf()
    for field, checked in (("aac_bitrate", rules.checked_bitrate), ("flac_compression_level", rules.checked_level)):
        if field in chosen:
            chosen[field] = checked(chosen[field].cast("int"))
    wanted = F.try_element_at(selected, F.lit(1)) if selected is not None else F.lit(None).cast("int")
    of_index = F.filter("streams", lambda s: wanted.isNull() | (s["index"] == wanted))
    files = _computed(files, "stream", F.try_element_at(of_index, F.lit(1)))
    first = F.col("stream")
    channels, rate = values.or_default(first["nb_channels"], 1), values.or_default(first["sample_rate"], 48_000)
    quality = rules.source_quality(first["codec_name"], rate, first["bit_rate"], channels, first["sample_format"], conf.ultrasound_threshold_hz)
    rows = _computed(files, "quality", F.when(F.size("streams") > 0, quality))
    rows = _computed(rows, "target", rules.with_overrides(rules.suggested_target(F.col("quality"), wanted_code, conf.aac_default_bitrate, conf.flac_default_level), **chosen))
    rows = _computed(rows, "conflicts", rules.conflicts(F.col("quality"), F.col("target")))
    rows = rows.withColumn("copy", rules.copy_report(first["codec_name"], F.col("target")))
    decodable = F.coalesce(first["codec_name"].isin(*STORABLE), F.lit(False))
    can = rules.importable(F.col("streams"), F.lit(None).cast("array<int>") if selected is None else selected, decodable)
    blocked = F.size(F.coalesce("conflicts.blocking", F.array().cast("array<string>"))) > 0
    return rows.withColumn("can_be_imported", F.coalesce(can, F.lit(False)) & ~blocked)


def diagnosed(files: DataFrame) -> DataFrame:
    """(path, has_signature, metadata_blocks, syncs, frames, issues) of FLAC files."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                data, issues, blocks, n = bytes(content), [], 0, 0
                signed = data[:4] == b"fLaC"
                syncs = sum(data.count(bytes([0xFF, b])) for b in (0xF8, 0xF9))
                try:
                    blocks, n = len(formats.flac_metadata(data)[0]), len(formats.flac_frames(data))
                except (ValueError, StopIteration, IndexError) as e:
                    issues.append(str(e) or type(e).__name__)
                issues += [] if signed else ["no fLaC signature"]
                issues += [] if n else ["no frame"]
                rows.append((path, signed, blocks, syncs, n, issues))
            yield pd.DataFrame(rows, columns=["path", "has_signature", "metadata_blocks", "syncs", "frames", "issues"])

    return files.select("path", "content").mapInPandas(look, "path string, has_signature boolean, metadata_blocks int, syncs int, frames int, issues array<string>")


def reports(analysed_files: DataFrame) -> DataFrame:
    """(path, report): a text about each analysed file."""
    from wavestrata.functions.metadata import report_text

    c = F.col
    text = report_text(c("path"), c("container"), c("quality"), c("target"), c("conflicts"), c("can_be_imported"), c("streams"), c("tags"), c("copy"), c("probe_error"))
    return analysed_files.select("path", text.alias("report"))
