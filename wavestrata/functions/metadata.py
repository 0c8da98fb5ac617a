"""Probe reports (JSON text with format, streams, chapters, programs) as typed columns and a rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavestrata.functions import values

CONTAINER = "format_name format_long_name duration size bit_rate probe_score start_time nb_streams nb_programs".split()
_CONTAINER_TYPES = {"duration": "double", "start_time": "double", "size": "bigint", "bit_rate": "bigint", "probe_score": "int", "nb_streams": "int", "nb_programs": "int"}
_SHARED = "index:string,codec_name:string,codec_long_name:string,codec_type:string,codec_tag_string:string,time_base:string,start_time:string,duration_ts:string,duration:string,bit_rate:string,nb_frames:string,disposition:map<string,int>,tags:map<string,string>"
_AUDIO = "profile:string,sample_fmt:string,sample_rate:string,channels:string,channel_layout:string,bits_per_sample:string"
STREAM = f"struct<{_SHARED},{_AUDIO}>"
_WHOLE = {"index": "int", "duration_ts": "bigint", "bit_rate": "bigint", "nb_frames": "bigint", "sample_rate": "int", "channels": "int", "bits_per_sample": "int"}
_REAL = {"start_time": "double", "duration": "double"}
#: What the typed columns hold already; the rest of the report keeps everything else.
TAKEN = frozenset(x.split(":")[0] for x in f"{_SHARED},{_AUDIO}".replace("map<string,int>", "m").replace("map<string,string>", "m").split(",")) - {"tags"}


def container_info(report: Column) -> Column:
    """The nine container fields as a struct; what isn't a number is null."""
    given = F.from_json(F.get_json_object(report, "$.format"), "map<string,string>")
    put = lambda k: given[k].try_cast("double").try_cast(_CONTAINER_TYPES[k]) if k in _CONTAINER_TYPES else given[k]
    return F.struct(*[put(k).alias(k) for k in CONTAINER])


def _streams(report: Column) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(report, "$.streams"), f"array<{STREAM}>"), F.array().cast(f"array<{STREAM}>"))


def _typed(s: Column, fields: list[str]) -> Column:
    def put(k: str) -> Column:
        if k in _WHOLE:
            return s[k].try_cast("double").try_cast(_WHOLE[k])
        return s[k].try_cast(_REAL[k]) if k in _REAL else s[k]

    return F.struct(*[put(k).alias(k) for k in fields])


_SHARED_NAMES = [x for x in "index codec_name codec_long_name codec_type codec_tag_string time_base start_time duration_ts duration bit_rate nb_frames disposition tags".split()]
_AUDIO_NAMES = [*_SHARED_NAMES, *"profile sample_fmt sample_rate channels channel_layout bits_per_sample".split()]


def _by_index(streams: Column) -> Column:
    """Sorted by index; a stream without one counts as 999."""
    keyed = F.transform(streams, lambda s: F.struct(F.coalesce(s["index"], F.lit(999)).alias("k"), F.to_json(s).alias("tie"), s.alias("s")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)), lambda x: x["s"])


def audio_streams(report: Column) -> Column:
    """The audio streams, typed and sorted by index."""
    return _by_index(F.transform(F.filter(_streams(report), lambda s: s["codec_type"] == "audio"), lambda s: _typed(s, _AUDIO_NAMES)))


def other_streams(report: Column) -> Column:
    return _by_index(F.transform(F.filter(_streams(report), lambda s: ~F.coalesce(s["codec_type"] == "audio", F.lit(False))), lambda s: _typed(s, _SHARED_NAMES)))


def channel_total(streams: Column) -> Column:
    return F.aggregate(streams, F.lit(0), lambda n, s: n + F.coalesce(s["channels"], F.lit(0)))


def rest(report: Column, user_meta: Column | None = None) -> Column:
    """The report without what the typed columns hold, and the user's metadata, as a variant."""
    drop = lambda m, names: F.map_filter(m, lambda k, _: ~k.isin(*names))
    form = drop(F.from_json(F.get_json_object(report, "$.format"), "map<string,string>"), CONTAINER)
    streams = F.transform(F.from_json(F.get_json_object(report, "$.streams"), "array<map<string,string>>"), lambda m: drop(m, sorted(TAKEN)))
    whole = drop(F.from_json(report, "map<string,string>"), ["format", "streams"])
    return F.parse_json(F.to_json(F.struct(form.alias("format"), streams.alias("streams"), whole.alias("other"), *([] if user_meta is None else [user_meta.alias("user_meta")]))))


def typed(text: Column, schema: str) -> Column:
    """JSON text as a struct of this schema; text that doesn't fit it raises."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


#: Tags that a report names first, and how many others it lists.
FIRST_TAGS, MORE_TAGS = ("title", "artist", "album", "date", "comment", "encoder"), 20


def report_text(row_name: Column, container: Column, quality: Column, target: Column, conflicts: Column, can: Column, streams: Column, tags: Column, copy: Column, error: Column) -> Column:
    """A report about a source for people to read: container, streams, tags, settings, warnings and status."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    line = lambda label, value: F.concat(F.lit(f"{label:<12}"), text(value))
    listed = lambda mark, texts: F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: F.concat(F.lit(mark), t))
    head = F.array(
        line("file", row_name), line("container", container["format_name"]), line("size", values.size_text(container["size"])), line("duration", values.duration_text(container["duration"])),
        line("codec", quality["codec_name"]), line("quality", F.concat_ws(", ", quality["compression_type"], quality["quality_tier"], F.when(quality["bitrate_class"] != "unknown", quality["bitrate_class"]))),
    )
    described = lambda s: F.concat_ws(", ", s["codec_name"], F.concat(s["nb_channels"].cast("string"), F.lit(" channels")), F.concat(s["sample_rate"].cast("string"), F.lit(" Hz")), s["sample_format"], values.bitrate_text(s["bit_rate"]))
    each = F.transform(F.coalesce(streams, F.array()), lambda s: F.concat(F.lit("stream "), text(s["index"]), F.lit("    "), described(s)))
    known = F.coalesce(tags, F.create_map().cast("map<string,string>"))
    lower = F.transform(F.array_sort(F.map_entries(known)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    rank = lambda e: F.array_position(F.array(*map(F.lit, FIRST_TAGS)), e["key"])
    named = F.concat(F.filter(lower, lambda e: rank(e) > 0), F.slice(F.filter(lower, lambda e: rank(e) == 0), 1, MORE_TAGS))
    tag_lines = F.transform(named, lambda e: F.concat(F.lit("tag         "), e["key"], F.lit(": "), text(e["value"])))
    settings = F.array(
        line("store as", F.concat_ws(" ", target["code"], target["sample_rate"].cast("string"), target["transform"], target["transform_rate"].cast("string"))), line("bitrate", target["aac_bitrate"]),
        line("level", target["flac_compression_level"]), line("copy", F.concat_ws(", ", copy["possible"].cast("string"), copy["reencoding"])), line("importable", can),
    )
    failed = F.when(error.isNotNull(), F.array(F.concat(F.lit("! "), error))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, each, tag_lines, settings, failed, listed("! ", conflicts["blocking"]), listed("? ", conflicts["quality"]), listed("~ ", conflicts["efficiency"])), "\n")
