"""Plans: scans read only what a query needs, joins of ranges go by keys, nothing pairs all rows."""

import re

import pytest

from wavestrata.plans import catalogue


def plan(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("segment_rms", {"ts", "user_id", "value"}), ("index_accumulate", {"ts", "user_id", "value"}), ("chunk_prune", {"page_id", "html"}), ("codec_classify", {"doc_id"}),
        ("float_to_int16", {"vec_id", "embedding"}), ("frame_hash", {"doc_id", "text"}), ("bitrate_class", {"o_orderkey", "o_totalprice"}),
    ],
)
def test_scans_read_only_the_columns_needed(spark, data, name, columns):
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<(.*?)>(?:$|\n|,? )", plan(spark, data, name)) for c in re.split(r",(?![^<]*>)", s)}
    assert read and read <= columns


@pytest.mark.parametrize("name", ["segment_extract", "frame_range_flac", "frame_range_aac", "chunk_prune", "asof_frame", "duplicate_check"])
def test_no_join_pairs_all_rows(spark, data, name):
    assert not re.search("NestedLoop|CartesianProduct", plan(spark, data, name))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - {"frame_cluster", "wav_probe", "adts_index", "flac_segment"}))
def test_catalogue_queries_stay_in_the_jvm(spark, data, name):
    assert not re.search("Python|Pandas|InArrow", plan(spark, data, name))
