"""Named queries over the test tables, with DuckDB SQL for the same rows.

The tables stand in for an archive: a user of events is a recording and its events, by ts, are samples
or frames; documents and pages are byte streams; embeddings are channels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavestrata.functions import metadata, rules, signal, values
from wavestrata.operators import catalog, index, lookup
from wavestrata.sources import codecs, formats, probe

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with the SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame index: each event is a frame of floor(10 * value) + 1 samples and length(props) bytes."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), "ts", "value", "props")
    rows = index.numbered(events, "rec_id", "ts")
    rows = rows.withColumns({"n_samples": F.floor(F.col("value") * 10).cast("long") + 1, "frame_size": F.length("props").cast("long")})
    rows = index.accumulated(rows, "rec_id", "frame_no")
    return index.accumulated(rows, "rec_id", "frame_no", "frame_size", "byte_offset")


FRAMES = """frames AS (
  SELECT user_id AS rec_id, frame_no, value, n_samples, frame_size,
         (coalesce(sum(n_samples) OVER w, 0))::BIGINT AS sample_pos, (coalesce(sum(frame_size) OVER w, 0))::BIGINT AS byte_offset
  FROM (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS frame_no,
               floor(value * 10)::BIGINT + 1 AS n_samples, length(props)::BIGINT AS frame_size FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests a customer for ranges of samples, some of them reversed, negative or beyond the end."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rec_id"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("k"))
    start = F.pmod(F.col("rec_id") * 7919 + F.col("k") * 104729, F.lit(30_000)) - 500
    rows = rows.select((F.col("rec_id") * 3 + F.col("k")).alias("request_id"), "rec_id", start.alias("start_sample"), F.col("k"))
    return rows.select("request_id", "rec_id", "start_sample", (F.col("start_sample") + F.pmod(F.col("rec_id") * 31 + F.col("k") * 17, F.lit(4000)) - 40).alias("end_sample"))


REQUESTS = """requests AS (
  SELECT c_custkey * 3 + k AS request_id, c_custkey AS rec_id, s AS start_sample, s + (c_custkey * 31 + k * 17) % 4000 - 40 AS end_sample
  FROM (SELECT c_custkey, k, (c_custkey * 7919 + k * 104729) % 30000 - 500 AS s FROM customer, (SELECT unnest(range(0, 3))::BIGINT AS k)))"""

SAMPLES = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos, ts, value, props FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.numbered(table(spark, sf_dir, "events").select("user_id", "ts", "value", "props"), "user_id", "ts", "pos")


@query(f"""WITH {SAMPLES}
SELECT user_id, pos // 16 AS frame_no, count(*) AS n_samples, round(sqrt(avg(value * value)), 6) AS rms FROM s GROUP BY user_id, pos // 16""")
def segment_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("user_id", F.expr("pos div 16").alias("frame_no"), "value")
    return rows.groupBy("user_id", "frame_no").agg(F.count("*").alias("n_samples"), F.round(signal.rms(F.col("value")), 6).alias("rms"))


@query(f"WITH {SAMPLES} SELECT user_id AS rec_id, pos AS frame_no, pos * 1024 AS sample_pos FROM s")
def index_fixed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.fixed_positions(samples(spark, sf_dir).select(F.col("user_id").alias("rec_id"), F.col("pos").alias("frame_no")))


@query(f"WITH {FRAMES} SELECT rec_id, frame_no, n_samples, sample_pos FROM frames")
def index_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("rec_id", "frame_no", "n_samples", "sample_pos")


@query(f"""WITH {FRAMES}, t AS (SELECT rec_id, byte_offset, sum(frame_size) OVER (PARTITION BY rec_id)::BIGINT AS total, frame_no FROM frames)
SELECT rec_id, frame_no, byte_offset, (lead(byte_offset, 1, total) OVER (PARTITION BY rec_id ORDER BY byte_offset) - byte_offset) AS frame_size FROM t""")
def index_frame_size_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("total", F.sum("frame_size").over(Window.partitionBy("rec_id")))
    return index.sized(rows.drop("frame_size"), "rec_id", "byte_offset", "total").select("rec_id", "frame_no", "byte_offset", "frame_size")


@query(f"""WITH {FRAMES}
SELECT rec_id, count(*) AS total_frames, max(sample_pos + n_samples) AS total_samples, min(frame_size) AS min_size, max(frame_size) AS max_size,
       round(avg(frame_size), 6) AS mean_size, round(stddev_pop(frame_size), 6) AS std_size, max(sample_pos + n_samples) * 1000 // 48000 AS duration_ms
FROM frames GROUP BY rec_id""")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.statistics(frames(spark, sf_dir)).withColumns({"mean_size": F.round("mean_size", 6), "std_size": F.round("std_size", 6)})


@query(f"""WITH {FRAMES}, t AS (
  SELECT *, sum(frame_size) OVER (PARTITION BY rec_id) AS total, coalesce(sample_pos >= lag(sample_pos) OVER (PARTITION BY rec_id ORDER BY frame_no), true) AS rising FROM frames)
SELECT rec_id, bool_and(rising) AS monotonic, bool_and(byte_offset >= 0 AND byte_offset < total) AS in_bounds, bool_and(frame_size BETWEEN 1 AND 9) AS sizes_ok,
       bool_and(rising) AND bool_and(byte_offset >= 0 AND byte_offset < total) AND bool_and(frame_size BETWEEN 1 AND 9) AS valid
FROM t GROUP BY rec_id""")
def index_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("total_bytes", F.sum("frame_size").over(Window.partitionBy("rec_id")))
    return index.validated(rows, longest=9)


@query(f"""WITH {FRAMES}, n AS (SELECT rec_id, count(*) AS n FROM frames GROUP BY rec_id)
SELECT rec_id, n, greatest(5000, CASE WHEN n <= 5000 THEN n WHEN n <= 50000 THEN greatest(10000, n // 4) ELSE greatest(greatest(5000, n // 50), least(20000, n // 20)) END)::BIGINT AS chunk FROM n""")
def index_adaptive_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("rec_id").agg(F.count("*").alias("n")).withColumn("chunk", index.adaptive_chunk(F.col("n")))


_RANGE = f"""WITH {FRAMES}, {REQUESTS},
z AS (SELECT rec_id, count(*) AS n, max(sample_pos) AS last FROM frames GROUP BY rec_id),
r AS (SELECT q.*, z.n, {{a}} AS a, {{b}} AS b FROM requests q LEFT JOIN z USING (rec_id)),
c AS (SELECT r.*, (SELECT count(*) FROM frames f WHERE f.rec_id = r.rec_id AND f.sample_pos <= r.a) AS na,
             (SELECT count(*) FROM frames f WHERE f.rec_id = r.rec_id AND f.sample_pos <= r.b) AS nb FROM r),
e AS (SELECT *, greatest(0, na - 1) AS s, least(nb, n - 1) AS e FROM c)
SELECT request_id, rec_id, start_sample, end_sample, CASE WHEN n IS NOT NULL AND s <= e THEN greatest(0, s - {{back}}) END AS first_frame, CASE WHEN n IS NOT NULL AND s <= e THEN e END AS last_frame FROM e"""


@query(_RANGE.format(a="start_sample", b="end_sample", back=0))
def frame_range_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.frame_range(requests(spark, sf_dir), frames(spark, sf_dir))


@query(_RANGE.format(a="greatest(start_sample, 0)", b="least(end_sample, last + 1023)", back=1))
def frame_range_aac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.frame_range(requests(spark, sf_dir), frames(spark, sf_dir), overlap=1, frame=index.AAC_FRAME)


@query(f"""WITH {FRAMES}, {REQUESTS}
SELECT request_id, count(*) AS n_frames, min(frame_no) AS first_frame, max(frame_no) AS last_frame,
       sum(least(end_sample, sample_pos + n_samples - 1) - greatest(start_sample, sample_pos) + 1)::BIGINT AS n_samples, round(sum(value), 4) AS total_value
FROM requests q JOIN frames f ON q.rec_id = f.rec_id AND f.sample_pos <= q.end_sample AND f.sample_pos + f.n_samples - 1 >= q.start_sample AND q.start_sample <= q.end_sample
GROUP BY request_id""")
def segment_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = frames(spark, sf_dir).withColumn("last_sample", F.col("sample_pos") + F.col("n_samples") - 1)
    both = lookup.overlap_join(requests(spark, sf_dir), ranged, "rec_id", ("start_sample", "end_sample"), ("sample_pos", "last_sample"), 4096)
    cut = F.least("end_sample", "last_sample") - F.greatest("start_sample", "sample_pos") + 1
    return both.groupBy("request_id").agg(
        F.count("*").alias("n_frames"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"),
        F.sum(cut).alias("n_samples"), F.round(F.sum("value"), 4).alias("total_value"),
    )


@query(f"""WITH {SAMPLES}, a AS (SELECT user_id, list(pos ORDER BY pos) AS x FROM s GROUP BY user_id), r(k, lo, hi) AS (VALUES (0, -5, 3), (1, 10, 10), (2, 20, 100000), (3, 5, 2), (4, 1000000, 1000001))
SELECT user_id, k, len(y) AS n, y[1] AS first_pos, y[len(y)] AS last_pos
FROM (SELECT user_id, k, list_filter(x, lambda p: p >= lo AND p <= hi) AS y FROM a, r)""")
def segment_extract_trim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = samples(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list("pos")).alias("x"))
    asked = spark.createDataFrame([(0, -5, 3), (1, 10, 10), (2, 20, 100_000), (3, 5, 2), (4, 1_000_000, 1_000_001)], "k int, lo long, hi long")
    each = whole.crossJoin(F.broadcast(asked)).withColumn("y", lookup.trimmed(F.col("x"), F.lit(0), F.col("lo"), F.col("hi")))
    return each.select("user_id", "k", F.size("y").cast("long").alias("n"), F.try_element_at("y", F.lit(1)).alias("first_pos"), F.try_element_at("y", F.lit(-1)).alias("last_pos"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS sha256, doc_id % 2 = 0 AS stored FROM documents)
SELECT doc_id, sha256, sha256 IN (SELECT sha256 FROM h WHERE stored) AS already_imported FROM h WHERE NOT stored""")
def duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", values.content_hash(F.col("text").cast("binary")).alias("sha256"), (F.col("doc_id") % 2 == 0).alias("stored"))
    return catalog.flag_known(hashed.where("NOT stored").select("doc_id", "sha256"), hashed.where("stored"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS sha256, length(text) AS size_bytes, source FROM documents), k AS (SELECT * FROM h WHERE doc_id % 2 = 0)
SELECT doc_id FROM h WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM k WHERE k.sha256 = h.sha256 AND k.source = h.source AND k.size_bytes = h.size_bytes)""")
def duplicate_check_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.char_length("text").alias("size_bytes"), values.content_hash(F.col("text").cast("binary")).alias("sha256"))
    return catalog.fresh(rows.where("doc_id % 2 = 1"), rows.where("doc_id % 2 = 0"), ("sha256", "source", "size_bytes")).select("doc_id")


@query("SELECT o_orderkey, (SELECT coalesce(max(c_custkey), -1) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS rec_id FROM orders")
def next_recording_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    return catalog.assigned_ids(table(spark, sf_dir, "orders").select("o_orderkey"), last, "o_orderkey")


@query("SELECT page_id, len(regexp_extract_all(html, '(?s)th.{0,14}'))::BIGINT AS syncs, length(html) AS n_chars FROM pages")
def sync_pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", index.pattern_count(F.col("html"), "(?s)th.{0,14}").alias("syncs"), F.char_length("html").cast("long").alias("n_chars"))


_NAMES = ["pcm_s16le", "FLAC", "mp3", "aac", "adpcm-ms", "g723_1", "opus", "wmalossless", "dst", "s302m", "dsd_lsbf", "other", "u8", "truehd", "acelp.kelvin", "dolby_e"]
_RATES = [8000, 44100, 48000, 88200, 96000, 96001, 250000, 700000, 22050, 192000]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's parameters for each document, by its id and length."""
    pick = lambda options, by: F.element_at(F.array(*map(F.lit, options)), (by % len(options) + 1).cast("int"))
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", pick(_NAMES, d).alias("codec"), pick(_RATES, F.floor(d / 3)).alias("rate"), pick([1, 2, 3, 8, 12], F.floor(d / 7)).alias("channels"),
        (F.col("n_chars") * 37 % 400_000).cast("int").alias("bit_rate"), pick(["aac", "flac"], F.floor(d / 11)).alias("wanted"),
    )


_SOURCES = f"""src AS (
  SELECT doc_id, list_extract({_NAMES}, (doc_id % {len(_NAMES)} + 1)::INT) AS codec, list_extract({_RATES}, (doc_id // 3 % {len(_RATES)} + 1)::INT)::INT AS rate,
         list_extract([1, 2, 3, 8, 12], (doc_id // 7 % 5 + 1)::INT)::INT AS channels, (n_chars * 37 % 400000)::INT AS bit_rate, list_extract(['aac', 'flac'], (doc_id // 11 % 2 + 1)::INT) AS wanted
  FROM documents),
kinds AS (SELECT *, CASE WHEN codec LIKE 'pcm\\_%' ESCAPE '\\' OR codec LIKE 'dsd\\_%' ESCAPE '\\' OR codec IN ('u8', 's302m') THEN 'uncompressed'
  WHEN lower(codec) IN ('flac', 'truehd', 'dst') THEN 'lossless_compressed' WHEN codec = 'other' THEN 'unknown' ELSE 'lossy_compressed' END AS kind FROM src),
graded AS (SELECT *, CASE WHEN kind = 'lossy_compressed' AND bit_rate <> 0 THEN
    CASE WHEN x < l[1] THEN 'low' WHEN x < l[2] THEN 'medium' WHEN x < l[3] THEN 'high' ELSE 'excessive' END ELSE 'unknown' END AS grade
  FROM (SELECT *, CASE WHEN channels <= 2 THEN bit_rate ELSE bit_rate / (channels * 0.7::DOUBLE) END AS x, CASE WHEN channels = 2 THEN [110000, 159000, 225000] ELSE [86000, 128000, 196000] END AS l FROM kinds)),
tiers AS (SELECT *, CASE WHEN rate > 96000 THEN 'ultrasound' WHEN kind IN ('uncompressed', 'lossless_compressed') THEN CASE WHEN rate >= 96000 THEN 'studio' WHEN rate >= 48000 THEN 'high' ELSE 'standard' END
  WHEN grade IN ('medium', 'high', 'excessive') THEN 'standard' ELSE 'low' END AS tier FROM graded),
raised AS (SELECT *, least(320000, greatest(CASE channels WHEN 1 THEN 160000 WHEN 2 THEN 190000 ELSE 220000 END,
  trunc(coalesce(nullif(bit_rate, 0), 128000) * CASE WHEN b < 96000 THEN 1.40 WHEN b < 128000 THEN 1.35 WHEN b < 160000 THEN 1.30 WHEN b < 192000 THEN 1.25 WHEN b < 256000 THEN 1.18 ELSE 1.15 END::DOUBLE)::INT)) AS up
  FROM (SELECT *, coalesce(nullif(bit_rate, 0), 128000) AS b FROM tiers))"""


@query(f"WITH {_SOURCES} SELECT doc_id, codec, kind FROM kinds")
def codec_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("doc_id", "codec", rules.compression_class("codec").alias("kind"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice AS b, (o_orderkey % 4 + 1)::INT AS ch FROM orders)
SELECT o_orderkey, CASE WHEN x < l[1] THEN 'low' WHEN x < l[2] THEN 'medium' WHEN x < l[3] THEN 'high' ELSE 'excessive' END AS bitrate_class
FROM (SELECT o_orderkey, CASE WHEN ch <= 2 THEN b ELSE b / (ch * 0.7::DOUBLE) END AS x, CASE WHEN ch = 2 THEN [110000, 159000, 225000] ELSE [86000, 128000, 196000] END AS l FROM o)""")
def bitrate_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.bitrate_class("o_totalprice", (F.col("o_orderkey") % 4 + 1).cast("int")).alias("bitrate_class"))


@query("""SELECT o_orderkey, least(320000, greatest(CASE o_orderkey % 3 + 1 WHEN 1 THEN 160000 WHEN 2 THEN 190000 ELSE 220000 END,
  trunc(o_totalprice * CASE WHEN o_totalprice < 96000 THEN 1.40 WHEN o_totalprice < 128000 THEN 1.35 WHEN o_totalprice < 160000 THEN 1.30 WHEN o_totalprice < 192000 THEN 1.25 WHEN o_totalprice < 256000 THEN 1.18 ELSE 1.15 END::DOUBLE)::INT)) AS aac_bitrate FROM orders""")
def aac_upgrade_bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.raised_bitrate("o_totalprice", (F.col("o_orderkey") % 3 + 1).cast("int")).alias("aac_bitrate"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).withColumn("q", rules.source_quality("codec", "rate", "bit_rate", "channels"))


@query(f"WITH {_SOURCES} SELECT doc_id, kind AS compression_type, grade AS bitrate_class, tier AS quality_tier, rate > 96000 AS is_ultrasound FROM tiers")
def quality_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("doc_id", "q.compression_type", "q.bitrate_class", "q.quality_tier", "q.is_ultrasound")


_TARGETS = f"""{_SOURCES},
named AS (SELECT *, CASE
    WHEN codec = 'aac' AND wanted = 'aac' THEN 'copy_aac' WHEN rate > 96000 AND kind IN ('uncompressed', 'lossless_compressed') THEN CASE WHEN rate <= 655350 THEN 'flac_loud' ELSE 'flac_beyond' END
    WHEN rate > 96000 THEN 'aac_loud' WHEN kind = 'lossy_compressed' THEN 'raise' WHEN kind IN ('uncompressed', 'lossless_compressed') THEN CASE WHEN lower(codec) = 'flac' AND wanted = 'flac' THEN 'copy_flac' ELSE 'keep' END ELSE 'careful' END AS way FROM raised),
targets AS (SELECT *,
    CASE WHEN way IN ('copy_flac', 'flac_loud', 'flac_beyond', 'keep') THEN 'flac' ELSE 'aac' END AS code,
    CASE way WHEN 'copy_aac' THEN CASE WHEN rate IN (8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000) THEN rate END
             WHEN 'flac_beyond' THEN 96000 WHEN 'aac_loud' THEN 32000 WHEN 'raise' THEN CASE WHEN rate IN (44100, 48000) THEN rate END WHEN 'careful' THEN CASE WHEN rate IN (44100, 48000) THEN rate END
             WHEN 'copy_flac' THEN CASE WHEN rate IN (8000, 16000, 22050, 24000, 32000, 44100, 48000, 88200, 96000, 176400, 192000) THEN rate END
             WHEN 'keep' THEN CASE WHEN rate IN (44100, 48000, 88200, 96000) THEN rate END END::INT AS target_rate,
    CASE WHEN way IN ('flac_beyond', 'aac_loud') THEN 'reinterpreting' ELSE 'exactly' END AS transform,
    CASE way WHEN 'flac_beyond' THEN 96000 WHEN 'aac_loud' THEN 32000 END::INT AS transform_rate,
    CASE way WHEN 'copy_aac' THEN coalesce(nullif(bit_rate, 0), 160000) WHEN 'aac_loud' THEN 192000 WHEN 'raise' THEN up WHEN 'careful' THEN CASE WHEN channels = 2 THEN 192000 ELSE 160000 END END::INT AS aac_bitrate,
    CASE WHEN way IN ('flac_loud', 'flac_beyond') THEN 6 WHEN way IN ('copy_flac', 'keep') THEN 4 END::INT AS level,
    way IN ('copy_aac', 'copy_flac') AS copy_mode FROM named)"""


@query(f"WITH {_TARGETS} SELECT doc_id, code, target_rate, transform, transform_rate, aac_bitrate, level, copy_mode FROM targets")
def suggest_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).withColumn("t", rules.suggested_target(F.col("q"), F.col("wanted")))
    return rows.select("doc_id", "t.code", F.col("t.sample_rate").alias("target_rate"), "t.transform", "t.transform_rate", "t.aac_bitrate", F.col("t.flac_compression_level").alias("level"), "t.copy_mode")


@query(f"""WITH {_TARGETS}, given AS (
  SELECT doc_id, codec, rate, channels, bit_rate, kind, grade, tier, wanted AS code, CASE WHEN doc_id % 5 = 0 THEN 48000 END::INT AS target_rate,
         list_extract(['exactly', 'resampling', 'reinterpreting'], (doc_id % 3 + 1)::INT) AS transform, 48000 AS transform_rate, CASE WHEN doc_id % 4 <> 0 THEN 100000 + doc_id % 5 * 50000 END::INT AS aac, doc_id % 6 = 0 AS copy FROM targets),
f AS (SELECT *, coalesce(aac, 160000) AS a, kind IN ('uncompressed', 'lossless_compressed') AND code = 'aac' AND NOT copy AS p, rate > 96000 AS loud, CASE WHEN transform = 'resampling' THEN transform_rate / rate::DOUBLE END AS ratio FROM given)
SELECT doc_id,
  ((code = 'flac' AND channels > 8)::INT + coalesce(target_rate <> rate AND transform = 'exactly', false)::INT + (loud AND code = 'aac' AND NOT copy AND transform = 'resampling')::INT)::INT AS blocking,
  ((code = 'aac' AND channels > 2 AND NOT copy AND codec <> 'aac')::INT + (codec = 'aac' AND code = 'aac' AND NOT copy)::INT + coalesce(ratio < 0.5, false)::INT + (loud AND code = 'flac' AND rate > 655350)::INT
   + (p AND channels = 1 AND a < 160000)::INT + (p AND channels = 2 AND a < 190000)::INT + (p AND tier = 'studio' AND a < 256000)::INT + (p AND tier = 'high' AND a < 192000)::INT + (p AND tier = 'ultrasound')::INT
   + (kind = 'lossy_compressed' AND code = 'aac' AND NOT copy AND a < bit_rate * 1.2::DOUBLE)::INT)::INT AS quality,
  ((code = 'aac' AND channels > 2 AND (copy OR codec = 'aac'))::INT + (codec = 'FLAC' AND code = 'flac' AND NOT copy AND transform <> 'exactly')::INT + coalesce(ratio > 2, false)::INT
   + (kind = 'lossy_compressed' AND code = 'flac' AND grade IN ('low', 'medium'))::INT + coalesce(aac > 256000 AND aac / channels::DOUBLE > 192000, false)::INT)::INT AS efficiency
FROM f""")
def conflict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    target = F.struct(
        F.col("wanted").alias("code"), F.when(d % 5 == 0, 48_000).cast("int").alias("sample_rate"), F.element_at(F.array(*map(F.lit, ("exactly", "resampling", "reinterpreting"))), (d % 3 + 1).cast("int")).alias("transform"),
        F.lit(48_000).alias("transform_rate"), F.when(d % 4 != 0, 100_000 + d % 5 * 50_000).cast("int").alias("aac_bitrate"), (d % 6 == 0).alias("copy_mode"),
    )
    rows = _judged(spark, sf_dir).withColumn("c", rules.conflicts(F.col("q"), target))
    return rows.select("doc_id", *[F.size(f"c.{k}").alias(k) for k in ("blocking", "quality", "efficiency")])


@query("""SELECT p_partkey, arg_min(r, abs(x - r)::BIGINT * 1000000 + r) AS rate FROM (SELECT p_partkey, (p_partkey * 131 % 60000)::INT AS x FROM part), (SELECT unnest([8000, 12000, 16000, 24000, 48000])::INT AS r) GROUP BY p_partkey""")
def nearest_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", values.nearest((F.col("p_partkey") * 131 % 60_000).cast("int"), [8000, 12000, 16000, 24000, 48000]).alias("rate"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 0 THEN trunc(c_acctbal)::INT END, trunc(o_totalprice)::INT) AS aac_bitrate, c_acctbal > 0 AS user_defined FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def override_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    both = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    suggested = F.struct(F.col("o_totalprice").cast("int").alias("aac_bitrate"))
    rows = both.withColumn("t", rules.with_overrides(suggested, aac_bitrate=F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("int"))))
    return rows.select("o_orderkey", "t.aac_bitrate", (F.col("c_acctbal") > 0).alias("user_defined"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 50")


@query("""SELECT event_id, trunc(try_cast(split_part(t, ' ', 1) AS DOUBLE))::BIGINT AS as_int, try_cast(t AS DOUBLE) AS as_float
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN value::VARCHAR WHEN 1 THEN event_type WHEN 2 THEN event_id::VARCHAR || ' Hz' ELSE '' END AS t FROM events)""")
def safe_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    text = F.when(i % 4 == 0, F.col("value").cast("string")).when(i % 4 == 1, F.col("event_type")).when(i % 4 == 2, F.concat(i.cast("string"), F.lit(" Hz"))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", values.safe_int(text).alias("as_int"), values.safe_float(text).alias("as_float"))


@query("SELECT doc_id, substr(text, 1, 32) AS text, substr(lang, 1, 32) AS lang, substr(source, 1, 32) AS source, n_chars FROM documents")
def snapshot_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.snapshot(table(spark, sf_dir, "documents"), text=32)


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM (SELECT doc_id, (n_chars % 2)::INT AS quality FROM documents WHERE doc_id % 7 <> 0) d FULL JOIN (SELECT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id
WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR d.quality IS DISTINCT FROM l.quality""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return catalog.difference(left, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", ("quality",))


@query("SELECT vec_id, round(0.7::DOUBLE * embedding[1]::DOUBLE + 0.3::DOUBLE * embedding[2]::DOUBLE, 6) AS mixed FROM embeddings")
def channel_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(signal.mixed(e[0], e[1]), 6).alias("mixed"))


@query(f"""WITH {SAMPLES} SELECT user_id, pos, lag(value, 3, 0.0) OVER w AS later, lead(value, 2, 0.0) OVER w AS earlier FROM s WINDOW w AS (PARTITION BY user_id ORDER BY pos)""")
def signal_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("pos")
    v = F.col("value")
    return samples(spark, sf_dir).select("user_id", "pos", signal.delayed(v, 3, w).alias("later"), signal.delayed(v, -2, w).alias("earlier"))


@query("SELECT vec_id, round(20 * log10((abs(embedding[1]::DOUBLE) + 1e-6) / (abs(embedding[2]::DOUBLE) + 1e-6)), 4) AS ild_db FROM embeddings")
def level_difference_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(signal.level_difference_db(e[0], e[1]), 4).alias("ild_db"))


@query("SELECT vec_id, i - 1 AS channel, greatest(-32768, least(32767, trunc(embedding[i]::DOUBLE * 3 * 32767)))::SMALLINT AS sample FROM embeddings, (SELECT unnest(range(1, 65))::INT AS i)")
def float_to_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("channel", "x"))
    return rows.select("vec_id", "channel", signal.to_int16(F.col("x").cast("double") * 3).alias("sample"))


@query("SELECT vec_id, i - 1 AS channel, (trunc(embedding[i]::DOUBLE * 32767)::SMALLINT / 32767.0::DOUBLE)::FLOAT::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65))::INT AS i)")
def int16_to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("channel", "x"))
    return rows.select("vec_id", "channel", signal.to_float32(signal.to_int16(F.col("x"))).cast("double").alias("x"))


@query(None)
def frame_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "cluster")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY ALL""")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavestrata.streaming.segments import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour").withColumnRenamed("start", "hour").withColumn("rms", F.round("rms", 6)).select("hour", "event_type", "n", "rms")


@query(f"""WITH {SAMPLES}, d AS (SELECT user_id, value AS a, CASE WHEN pos % 10 = 0 THEN value + 1 ELSE value END AS b FROM s)
SELECT user_id, round(avg((a = b)::INT::DOUBLE), 6) AS match_rate, count(*) FILTER (a <> b) AS n_different, round(max(abs(a - b)), 6) AS max_diff, round(avg(abs(a - b)), 6) AS mean_diff FROM d GROUP BY user_id""")
def sample_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("user_id", F.col("value").alias("a"), F.when(F.col("pos") % 10 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("b"))
    found = signal.match(F.col("a"), F.col("b"))
    return rows.groupBy("user_id").agg(*[(c if k == "n_different" else F.round(c, 6)).alias(k) for k, c in found.items()])


@query(f"WITH {FRAMES} SELECT rec_id, frame_no, sample_pos * 1000 // 44100 AS ms FROM frames")
def duration_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("rec_id", "frame_no", values.millis(F.col("sample_pos"), F.lit(44_100)).alias("ms"))



@query("""SELECT page_id, (k // 1024)::INT AS chunk_no, k AS byte_start, least(k + 1024, strlen(html)) AS byte_end FROM (SELECT page_id, html, unnest(range(0, strlen(html), 1024)) AS k FROM pages)""")
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.split_chunks(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html", 1024).select("page_id", "chunk_no", "byte_start", "byte_end")


@query("""WITH c AS (SELECT page_id, k // 1024 AS chunk_no, k AS byte_start, least(k + 1024, strlen(html)) AS byte_end FROM (SELECT page_id, html, unnest(range(0, strlen(html), 1024)) AS k FROM pages)),
r AS (SELECT page_id, page_id * 37 % 3000 AS byte_from, page_id * 37 % 3000 + 1500 AS byte_to FROM pages)
SELECT page_id, count(*) AS n_chunks, min(chunk_no)::INT AS first_chunk, max(chunk_no)::INT AS last_chunk, sum(byte_end - byte_start)::BIGINT AS bytes_read FROM r JOIN c USING (page_id) WHERE byte_end > byte_from AND byte_start < byte_to GROUP BY page_id""")
def chunk_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    chunks = index.split_chunks(pages.select("page_id", "html"), "page_id", "html", 1024).drop("payload")
    asked = pages.select("page_id", (F.col("page_id") * 37 % 3000).alias("byte_from"), (F.col("page_id") * 37 % 3000 + 1500).alias("byte_to"))
    found = lookup.chunks_covering(asked, chunks, "page_id", 1024)
    return found.groupBy("page_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_no").alias("first_chunk"), F.max("chunk_no").alias("last_chunk"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes_read"))


@query("""SELECT o.o_orderkey, e.value AS value FROM orders o ASOF LEFT JOIN (SELECT user_id, ts, value FROM events) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts - INTERVAL 9125 DAY""")
def asof_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_orderdate")
    events = table(spark, sf_dir, "events").select("user_id", (F.col("ts") - F.expr("INTERVAL 9125 DAY")).alias("since"), "value")
    return lookup.latest_at(orders, events, "user_id", "o_orderdate", "since", "value", 30 * 86_400).select("o_orderkey", "value")


@query("""SELECT event_type, count(*) FILTER (value >= 0.5 * 100) AS loud, count(*) FILTER (user_id % 2 = 0) AS copied, count(DISTINCT user_id) AS n_recordings FROM events GROUP BY event_type""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.batch_summary(table(spark, sf_dir, "events"), "event_type", F.col("value") >= 50, F.col("user_id") % 2 == 0, "user_id")


@query("""SELECT o_orderkey, CASE WHEN c > 0 THEN round(o_totalprice / c, 9) ELSE 0 END AS compression_ratio FROM (SELECT o_orderkey, o_totalprice, (o_orderkey % 5 * 1000)::DOUBLE AS c FROM orders)""")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = (F.col("o_orderkey") % 5 * 1000).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(catalog.compression_ratio(F.col("o_totalprice"), c), 9).alias("compression_ratio"))


@query("""SELECT o_orderkey, printf('%02d:%02d:%02d.%02d', h // 360000, h // 6000 % 60, h // 100 % 60, h % 100) AS duration FROM (SELECT o_orderkey, floor(o_totalprice * 100)::BIGINT AS h FROM orders)""")
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", values.duration_text(F.col("o_totalprice")).alias("duration"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'FLAC_44100' WHEN vec_id % 3 = 1 THEN 'AAC_48000' ELSE 'FLAC' END AS name, CASE WHEN vec_id % 3 = 1 THEN 'aac' ELSE 'flac' END AS code,
  CASE vec_id % 3 WHEN 0 THEN 44100 WHEN 1 THEN 48000 END::INT AS sample_rate, CASE WHEN vec_id % 2 = 0 THEN 'RESAMPLING_NEAREST' ELSE 'REINTERPRETING_32000' END AS transform FROM embeddings""")
def target_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    name = F.when(i % 3 == 0, "flac44100").when(i % 3 == 1, " aac_48000").otherwise("FLAC")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", values.target_format(name).alias("f"), values.sampling_transform(F.when(i % 2 == 0, "resampling").otherwise("reinterpreting32000")).alias("t"))
    return rows.select("vec_id", "f.name", "f.code", "f.sample_rate", F.col("t.name").alias("transform"))


@query("""SELECT doc_id, substr(sha256(encode(text)[1:64]), 1, 16) AS frame_hash FROM documents""")
def frame_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", values.frame_hash(F.col("text").cast("binary")).alias("frame_hash"))


@query("""SELECT user_id, count(*) AS frames, count(*) FILTER (value > m) AS louder FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS m FROM events) GROUP BY user_id""")
def sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.rising_count(table(spark, sf_dir, "events"), "user_id", "ts", "value")


def _probe_report() -> F.Column:
    """A probe report with an audio stream whose index comes last, a picture and an audio stream without index."""
    d = F.col("doc_id")
    stream = lambda i, kind, codec, rate, channels: F.struct(i.alias("index"), F.lit(kind).alias("codec_type"), F.lit(codec).alias("codec_name"), rate.alias("sample_rate"), channels.alias("channels"), F.lit("kept").alias("extra"))
    none = F.lit(None).cast("string")
    streams = F.array(stream(none, "audio", "mp3", F.lit("N/A"), none), stream((d % 7 + 2).cast("string"), "audio", "flac", (d * 10).cast("string"), (d % 4).cast("string")), stream(F.lit("1"), "video", "png", none, none))
    form = F.struct(F.col("source").alias("format_name"), (d / 2).cast("string").alias("duration"), F.col("n_chars").cast("string").alias("size"), F.lit("odd").alias("bit_rate"), F.lit("me").alias("maker"))
    return F.to_json(F.struct(form.alias("format"), streams.alias("streams"), F.array(d).alias("chapters")))


@query("""SELECT doc_id, source AS format_name, doc_id / 2 AS duration, n_chars AS size, NULL::BIGINT AS bit_rate, 2 AS n_audio, 1 AS n_other, (doc_id % 4)::INT AS channels,
  (doc_id % 7 + 2)::INT AS first_index, 'flac' AS first_codec, (doc_id * 10)::INT AS first_rate, 'me' AS maker, 'kept' AS extra FROM documents""")
def stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("report", _probe_report())
    r = F.col("report")
    rows = rows.withColumns({"c": metadata.container_info(r), "a": metadata.audio_streams(r), "o": metadata.other_streams(r), "rest": metadata.rest(r)})
    first = F.col("a")[0]
    return rows.select(
        "doc_id", "c.format_name", "c.duration", "c.size", "c.bit_rate", F.size("a").alias("n_audio"), F.size("o").alias("n_other"), metadata.channel_total(F.col("a")).alias("channels"),
        first["index"].alias("first_index"), first["codec_name"].alias("first_codec"), first["sample_rate"].alias("first_rate"),
        F.variant_get("rest", "$.format.maker", "string").alias("maker"), F.variant_get("rest", "$.streams[0].extra", "string").alias("extra"),
    )


@query("""SELECT doc_id, len(list_distinct([doc_id % 2, doc_id % 3])) <= 1 AS compatible, doc_id % 5 IN (0, 1) AS valid FROM documents""")
def stream_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    stream = lambda i, n: F.struct(F.lit(i).alias("index"), n.alias("nb_samples"), F.lit(48_000).alias("sample_rate"))
    rows = table(spark, sf_dir, "documents").withColumn("streams", F.array(stream(0, d % 2), stream(1, d % 3)))
    chosen = F.array((d % 5).cast("int"))
    return rows.select("doc_id", rules.same_shape(F.col("streams")).alias("compatible"), rules.importable(F.col("streams"), chosen, F.lit(True)).alias("valid"))


@query("""SELECT doc_id, 4096::BIGINT * (doc_id + 1) AS n_samples FROM documents""")
def total_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") + 1) * 4096
    odd = F.col("doc_id") % 2 == 1
    base = F.when(odd, F.lit("1/48000")).otherwise("1/1000")
    found = values.total_samples(F.when(odd, n).otherwise(1), base, F.lit(48_000), F.when(odd, F.lit(0.0)).otherwise((n + 0.5) / 48_000), F.lit(None).cast("double"))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("n_samples"))


def _little(n: F.Column) -> F.Column:
    """A 32-bit number as the hex digits of its bytes, the lowest first."""
    h = F.lpad(F.hex(n), 8, "0")
    return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])


@query("""SELECT page_id, 'pcm_s16le' AS codec, 2 AS channels, 8000 AS sample_rate, strlen(html) // 4 AS n_samples, 44::BIGINT AS payload_from, (strlen(html) // 4) / 8000 AS duration, 256000 AS bit_rate FROM pages""")
def wav_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe on WAV files whose samples are the bytes of pages."""
    size = F.octet_length("html").cast("long")
    head = F.concat(F.lit("52494646"), _little(size + 36), F.lit("57415645666d74201000000001000200401f0000007d00000400100064617461"), _little(size))
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.unhex(head), F.col("html").cast("binary")).alias("content"))
    found = probe.probed(files)
    s = F.col("streams")[0]
    return found.select("page_id", s["codec_name"].alias("codec"), s["nb_channels"].alias("channels"), s["sample_rate"].alias("sample_rate"), s["nb_samples"].alias("n_samples"), "payload_from", "container.duration", s["bit_rate"].alias("bit_rate"))


@query("""SELECT doc_id, k AS frame_no, 507 * k AS byte_offset, least(500, strlen(text) - 500 * k) + 7 AS frame_size, 1024 * k AS sample_pos FROM (SELECT doc_id, text, unnest(range(0, (strlen(text) + 499) // 500)) AS k FROM documents)""")
def adts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame index of ADTS streams whose frames hold the bytes of documents."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, text in zip(pdf.doc_id, pdf.text, strict=True):
                data = bytes(text or b"")
                stream = b"".join(formats.adts_frame(data[k : k + 500]) for k in range(0, len(data), 500))
                rows = codecs.frame_table(stream, "aac", 1, 0, 0)
                yield pd.DataFrame({"doc_id": doc_id, "frame_no": range(len(rows)), "byte_offset": rows[:, 0], "frame_size": rows[:, 1], "sample_pos": rows[:, 2]})

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text"))
    return docs.mapInPandas(build, "doc_id long, frame_no long, byte_offset long, frame_size long, sample_pos long")


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: trunc(x::DOUBLE * 8000)::BIGINT) AS x, vec_id % 50 AS a FROM embeddings)
SELECT vec_id, len(y) AS n_samples, list_sum(y)::BIGINT AS total, list_sum(list_transform(range(1, len(y) + 1), lambda i: y[i] * i))::BIGINT AS weighted, (least(63, a + 20) // 16 - a // 16 + 1)::BIGINT AS frames_read
FROM (SELECT vec_id, a, list_slice(x, a + 1, a + 21) AS y FROM s)""")
def flac_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of FLAC files whose samples are embeddings: encode, index, decode the frames that hold the segment, trim."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for vec_id, x in zip(pdf.vec_id, pdf.embedding, strict=True):
                samples = np.trunc(np.asarray(x, np.float64) * 8000).astype(np.int64)[:, None]
                content = codecs.CODECS["flac"].encode(samples, 48_000, 24, 16)
                y, hit = codecs.cut(content, "flac", 1, 24, vec_id % 50, vec_id % 50 + 20)
                rows.append((vec_id, len(y), y.sum(), (y[:, 0] * np.arange(1, len(y) + 1)).sum(), len(hit)))
            yield pd.DataFrame(rows, columns=["vec_id", "n_samples", "total", "weighted", "frames_read"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(read, "vec_id long, n_samples long, total long, weighted long, frames_read long")
