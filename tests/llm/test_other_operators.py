"""Chat formatting, URL filters, top-k search and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm import tricky
from tests.llm.test_text_operators import plain_components, plain_dedup
from wavestrata.llm import chat, knn, mixing, packing, quality, url_filter


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escape_is_reversible():
    rng = random.Random(0)
    bits = ["<", "\\", "|turn|>", "[", "INST]", "/INST]", "|end|>", "/s>", "s>", "<SYS>>", "</SYS>>", "|text|>", "a", "|im_end|>", "|endoftext|>"]
    for _ in range(20_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in (chat.TURN, chat.TEXT, chat.END, "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>"))


def test_chat(spark):
    rows = [
        (1, 0, "system", "be [INST] brief"), (1, 2, "assistant", "second </s>"), (1, 1, "user", None), (1, 3, "user", "<|end|><|turn|>"), (1, 4, "assistant", "é"), (1, 5, "user", "left over"),
        (2, 0, "user", "alone"), (3, 0, None, None), (4, 0, "assistant", ""), (4, 0, "assistant", ""), (5, None, "assistant", "early"), (5, 1, "user", "late"), (None, 0, "assistant", "no id"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r.conv_id: r for r in chat.summarize(chat.format_conversations(df)).collect()}
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{role}\n{t}\n" for _, _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), digest(loss))
    examples = chat.format_conversations(df).where("conv_id = 1").orderBy("example").collect()
    assert [len(e.mask) for e in examples] == [1, 1, 0] and all(b.formatted.startswith(a.formatted) for a, b in zip(examples, examples[1:], strict=False))
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_of_long_texts_and_many_turns(spark):
    long = "[INST] word </s> " * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), *((2, k, ("user", "assistant")[k % 2], f"turn {k} <|end|>") for k in range(120))]
    got = {r.conv_id: r for r in chat.summarize(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))).collect()}
    for c in (1, 2):
        turns = [r for r in rows if r[0] == c]
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), digest("".join(f"{r}\n{t}\n" for _, _, r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), digest(loss))


def test_chat_on_the_tables(spark, data):
    got = {r.conv_id: r for r in chat.op4_chat_formatting(spark, data).collect()}
    convs = collections.defaultdict(list)
    for c, turn, role, text in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{data}/conversations.parquet'").fetchall():
        convs[c].append((turn, role, text or ""))
    assert set(got) == {*convs, -1} and got[-1].n_turns == 2
    for c, turns in convs.items():
        assert got[c].turns_sha256 == digest("".join(f"{r}\n{t}\n" for _, r, t in sorted(turns)))


def test_urls(spark):
    urls = {
        "http://Example.ORG/es/1": ("example.org", "/es/1", "example.org/es/", "block"), "https://a.b.example.org/en/123?x=/de/": ("a.b.example.org", "/en/123", "example.org/en/1", "block"),
        "http://example.org/en/2#f": ("example.org", "/en/2", "org/", "allow"), "http://notexample.org": ("notexample.org", "", None, "allow"), "http://x.com/FR/": ("x.com", "/FR/", None, "allow"),
        "http://x.com/de/?q=http://y.org/": ("x.com", "/de/", "com/de/", "block"), "mailto:nobody": ("", "", None, "allow"), "://com/fr/": ("com", "/fr/", "com/fr/", "allow"), "http://com.evil/de/": ("com.evil", "/de/", None, "allow"),
        "http://org:80/": ("org:80", "/", None, "allow"), "": ("", "", None, "allow"),
    }
    rows = [(k, u, "mine") for k, u in enumerate(urls)] + [(99, None, "mine"), (0, next(iter(urls)), "mine")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {(r.page_id, r.url): tuple(r)[-4:] for r in url_filter.filter_urls(df).collect()}
    assert got == {**{(k, u): v for k, (u, v) in enumerate(urls.items())}, (99, None): ("", "", None, "allow")}
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    wild = url_filter.filter_urls(df, [("block", "*/es/"), ("allow", "example.*/es/1")])
    assert {r.page_id: r.verdict for r in wild.collect()}[0] == "allow"


def test_urls_with_ties_and_long_ones(spark):
    """Of rules of one length the one with the longer host wins, then the earlier one; a url of a megabyte is judged whole."""
    rules = [("block", "a.org/x/"), ("allow", "org/x/abc/"), ("block", "a.org/x/y/"), ("allow", "a.org/x/y/"), ("block", "long.net/end/")]
    far = "http://long.net/end/" + "p/" * 500_000
    df = spark.createDataFrame([(1, "http://a.org/x/y/z"), (2, "http://a.org/x/abc/"), (3, far), (4, "http://" + "s." * 100_000 + "long.net/end/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, len(r.host), len(r.path)) for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {1: ("a.org/x/y/", "block", 5, 6), 2: ("org/x/abc/", "allow", 5, 7), 3: ("long.net/end/", "block", 8, 1_000_005), 4: ("long.net/end/", "block", 200_008, 5)}


def test_only_candidates_run_expressions():
    rules = [url_filter.Rule("block", f"site{k}.com/a/") for k in range(50)]
    index = url_filter.RuleIndex(rules, {".com": 1000, "/a": 500})
    assert all(next(iter(t)) == "." and t != ".com" for t in index.by_token)
    assert index.judge("www.site7.com", "/a/b") == ("site7.com/a/", "block") and index.judge("site8.com", "/b/") is None


def plain_top_k(rows, k=5, every=50):
    vectors = []
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            vectors.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in e]))
    out = []
    for own, (q, u) in enumerate(vectors):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(u, v, strict=False)), i) for at, (i, v) in enumerate(vectors) if at != own)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    same = rows[3][1]
    rows += [(1000 + k, same) for k in range(60)] + [(2000, None), (2050, []), (2100, [1.0, None]), (2150, [float("nan")] * 8), (2200, [float("inf")] * 8), (None, same), (2250, [0.5, -0.5])]
    rows += [(50, rows[50][1]), (50, rows[51][1]), (100, same), (7, same), (7, same)]  # repeated ids, with equal and with other vectors
    df = spark.createDataFrame([(*r, "mine") for r in rows], "vec_id long, embedding array<float>, cell string").repartition(5)
    assert sorted(tuple(r) for r in knn.top_k(df).collect()) == plain_top_k(rows)
    assert knn.top_k(df.limit(0)).count() == 0 and knn.top_k(df.where("vec_id IN (50, 1)")).count() == 3 * 3 and knn.top_k(df.where("vec_id = 150")).count() == 0
    two = spark.createDataFrame([(50, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in knn.top_k(two).collect()) == [(50, 1, 50, 256 * 512)] * 2


def clustered(n, centres=12):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(centres, 8)) * 4
    return [(i, (middle[i % centres] + rng.normal(size=8) * 0.1).astype(np.float32).tolist()) for i in range(n)]


def test_top_k_of_clustered_vectors_with_many_cells_and_blocks(spark, monkeypatch):
    """Many cells, several blocks of queries and salts of data; the bounds exclude most of the rows."""
    monkeypatch.setattr(knn, "BLOCK", 4)
    monkeypatch.setattr(knn, "SALT_ROWS", 50)
    monkeypatch.setattr(knn, "SAMPLE", 300)
    monkeypatch.setattr(knn, "_COPY", 1)
    rows = clustered(2400)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(tuple(r) for r in knn.top_k(df).collect()) == plain_top_k(rows)


def test_cells_follow_the_vectors():
    """Clusters get many cells that exclude most rows; vectors without any get one cell, whatever the number of rows."""
    x = np.floor(256 * np.array([e for _, e in clustered(2048)]))
    pivots, share = knn.chosen_cells(x, 100_000, 5)
    assert len(pivots) > 8 and share < 0.25
    pivots, share = knn.chosen_cells(np.floor(256 * np.random.default_rng(0).normal(size=(2048, 64))), 100_000, 5)
    assert len(pivots) == 1 and share == 1


def test_pipeline(spark, data):
    """Each stage against a plain version on what the stage before it kept."""
    import corpus_pipeline
    from wavestrata.llm.store import written

    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
        docs = written(stage(spark, docs, data), name)
        stages.append((name, before, docs))
    (_, first, good), (_, kept, single), (_, texts, cut), (_, sources, mixed), (_, last, packed) = stages
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score_quality(spark.read.parquet(f"{data}/documents.parquet"), labels).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, *_ in first if scores[i] >= 0.5)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for (_, _, c) in plain_components(kept, 5, 80, 100)})
    assert collections.Counter((r.doc_id, digest(" ".join(r.text.split()))) for r in cut.collect()) == collections.Counter({(i, h): n for (i, _, _, h), n in plain_dedup(texts, 20).items()})
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    copies = collections.Counter(tuple(r) for r in mixed.collect())
    mass = collections.Counter()
    for _, t, _, s, _ in sources:
        mass[s] += len(t)
    for row in sources:
        rate = sum(mass.values()) / len(mass) / mass[row[3]]
        u = int(hashlib.md5(f"{mixing.SEED}|{row[0]}|1".encode()).hexdigest()[:13], 16) / 2**52
        if rate <= 16:
            assert copies[row] == sum(p <= u for p in mixing.poisson_table(rate))
    encoder = __import__("tokenizers").Tokenizer.from_file(packing.vocabulary())
    expected = collections.Counter()
    for i, t, *_ in last:
        ids = np.array(encoder.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for s in range(0, len(ids), 2048):
            expected[i, s // 2048, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed.collect()) == expected
    run = corpus_pipeline.run(spark, data)
    assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in run.collect()) == collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed.collect())


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_tricky_tables(spark, tmp_path, empty):
    """Nulls, empty and long texts, repeated rows and clashing columns go through all stages; each keeps what it should."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    rows = [] if empty else tricky.documents()
    docs = spark.createDataFrame(rows, tricky.SCHEMA).repartition(4)
    for name in ("score", "predicted", "n_removed", "copy", "key", "length"):
        docs = docs.withColumn(name, F.lit("mine"))
    labels = [(r[0], int(not (r[1] or "").startswith("again"))) for r in rows if r[0] is not None and r[0] < 200] + [(None, 1), (7, None)]
    spark.createDataFrame([] if empty else labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        got = docs.collect()
        kept.append((name, got))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            docs = spark.createDataFrame(got, tricky.SCHEMA).repartition(3)
    if empty:
        assert not any(got for _, got in kept)
        return
    (_, good), (_, single), (_, cut), (_, mixed), (_, packed) = kept
    assert set(map(tuple, good)) <= set(rows) and len(good) > 5
    plain = plain_components([tuple(r) for r in good], 5, 80, 100)
    assert collections.Counter(r.doc_id for r in single if r.doc_id is not None) == collections.Counter({c for _, _, c in plain if c is not None})
    assert sum(r.doc_id is None for r in single) == sum(r.doc_id is None for r in good)
    expected = plain_dedup([tuple(r) for r in single], 20)
    assert collections.Counter((r.doc_id, digest(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))) for r in cut) == collections.Counter({(i, h): n for (i, _, _, h), n in expected.items()})
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in cut}
    tokens = collections.Counter()
    for r in packed:
        tokens[r.sequence_id] += r.length
    assert max(tokens.values()) <= 2048 and {r.doc_id for r in packed} == {r.doc_id for r in mixed}


@pytest.mark.parametrize("name", ["op2_ngram_jaccard", "op3_url_filters", "op4_chat_formatting", "op7_substring_dedup", "op9_poisson_mixing", "op10_voronoi_top_k"])
def test_oracles(spark, data, name):
    from wavestrata.llm import queries

    df = queries.QUERIES[name](spark, data)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(map(str, found.fetchall())) == collections.Counter(str(tuple(r[c] for c in names)) for r in df.collect())


def test_written_tables_can_be_dropped(spark):
    from wavestrata.llm import store

    df = store.written(spark.range(5).toDF("x"), "mine")
    assert df.count() == 5
    path = store._written[df]
    store.dropped(df)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def test_batches_are_only_ever_made_smaller(spark):
    from wavestrata.llm import store

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for given, expected in (("67108864", 4 << 20), ("1000", 1000), (str(4 << 20), 4 << 20)):
        spark.conf.set(key, given)
        store.small_batches(spark)
        assert int(spark.conf.get(key).rstrip("b")) == expected
    spark.conf.set(key, before.rstrip("b"))
