"""The operators over documents against brute-force versions, on tables with nulls, ties, repeats and clashes."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import tricky
from wavestrata.llm import components, fingerprint, jaccard_join, license_scan, mixing, packing, quality, substring_dedup, textkit
from wavestrata.llm.tokens import WordTokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    return tricky.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clashing = spark.createDataFrame(rows, tricky.SCHEMA).repartition(5)
    for name in ("n_words", "score", "copy", "length", "key", "token", "start", "label", "cell"):
        clashing = clashing.withColumn(name, F.lit("mine"))
    return clashing


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], tricky.SCHEMA)


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["a b  c\td", None, "", " x ", "A B c", "é日本 z\x0bq\x85r", "a b c d e", "x" * 700_000 + " y"]
    data, offsets = textkit.text_buffers(pa.array(texts))
    starts, ends, bounds = textkit.word_spans(data, offsets)
    for k, t in enumerate(texts):
        assert [bytes(data[starts[i] : ends[i]]).decode() for i in range(bounds[k], bounds[k + 1])] == WORDS.findall(t or "")
    assert [len(s) for s in textkit.shingle_sets(pa.array(texts), 4)] == [1, 0, 0, 1, 1, 1, 2, 1]


@pytest.mark.parametrize("n", [8, 9, 63, 64, 65, 1024, 2048, 4096])
def test_like_words_have_different_hashes(n):
    import pyarrow as pa

    texts = [*tricky.alike(n), tricky.alike(n)[0] + "a"]
    data, offsets = textkit.text_buffers(pa.array(texts))
    starts, ends, _ = textkit.word_spans(data, offsets)
    assert len(set(textkit.hash_words(data, starts, ends).tolist())) == 3
    assert textkit.same_words(data, starts[[0, 0]], ends[[0, 0]], data, starts[:2], ends[:2]).tolist() == [True, False]


def test_fingerprints(docs, none, rows):
    got = [tuple(r) for r in fingerprint.fingerprints_with_edits(docs).collect()]
    texts = {}
    ids = [r[0] for r in rows]
    for r in rows:
        texts.setdefault(r[0], r[1] or "")
    order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
    expected = collections.Counter()
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, u = texts[i], texts[j]
        cut = len(t) // 3
        expected[i, len(t), hashlib.sha256((t[: len(t) - cut] + u[:cut]).encode()).hexdigest()] += 1
    assert collections.Counter(r[:3] for r in got) == expected
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[texts[r[0]]].add(r[3])
        assert 0 <= r[5] <= 1 and 0 <= r[6] <= 1
        assert (fingerprint.as_text(fingerprint.from_text(r[3]))) == r[3]
    assert all(len(v) == 1 for v in by_text.values())
    x = fingerprint.from_text(got[0][3])[None]
    assert fingerprint.likeness(x, x)[0] == 1
    assert fingerprint.fingerprints_with_edits(none).count() == 0


def plain_digest(text):
    """The digest by a loop over places: 256 buckets of three triplets a place, quartile codes, ratios and length."""
    data, count = text.encode(), [0] * 256
    for k, triplet in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3))):
        for at in range(len(data) - triplet[2]):
            h = (k + 1) * 0x27D4EB2F
            for place, factor in zip(triplet, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=True):
                h += data[at + place] * factor
            h &= 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            count[h >> 24] += 1
    q1, q2, q3 = (sorted(count)[k] for k in (63, 127, 191))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in count]
    body = bytes(codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, 256, 4))
    return f"{min(255, round(math.log(1 + len(data)) / math.log(1.1))):02x}{q1 * 15 // max(1, q3):x}{q2 * 15 // max(1, q3):x}{body.hex()}", codes


def plain_likeness(x, y):
    (a, u), (b, v) = x, y
    body = sum((0, 1, 2, 6)[abs(i - j)] for i, j in zip(u, v, strict=True))
    head = min(2 * abs(int(a[:2], 16) - int(b[:2], 16)), 24) + min(abs(int(a[2], 16) - int(b[2], 16)) + abs(int(a[3], 16) - int(b[3], 16)), 12)
    return 1 - min(1, (body + head) / (min(416, 6 * (sum(i > 0 for i in u) + sum(j > 0 for j in v))) + 36))


def test_fingerprints_equal_a_loop_over_triplets(spark, rows):
    few = [(k, t) for k, (_, t, *_) in enumerate(rows) if len(t or "") < 3000] + [(900, "abc"), (901, "ab"), (902, "é"), (903, "abcd" * 50)]
    texts = {k: t or "" for k, t in few}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in fingerprint.fingerprints_with_edits(spark.createDataFrame(few, "doc_id long, text string")).collect():
        t, u = texts[r.doc_id], texts[following[r.doc_id]]
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        own, new, then = plain_digest(t), plain_digest(edited), plain_digest(u)
        assert (r.fingerprint, r.edited_fingerprint) == (own[0], new[0]), r.doc_id
        assert abs(r.near_edited - plain_likeness(own, new)) < 1e-12 and abs(r.near_next - plain_likeness(own, then)) < 1e-12


def test_one_document_follows_itself(spark):
    row = fingerprint.fingerprints_with_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1


def plain_components(rows, n, num, den):
    sets = []
    for i, t, *_ in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_jaccard_join(docs, none, rows, n, num, den):
    got = collections.Counter(tuple(r) for r in jaccard_join.near_duplicates(docs, n, num, den).collect())
    assert got == plain_components(rows, n, num, den)
    assert jaccard_join.near_duplicates(none, n, num, den).count() == 0


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    """Copies with different numbers of edits: some link to the centre only, some to others only, some to none."""
    import random

    rng = random.Random(3)
    base = [f"t{k}" for k in range(150)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(150)] = f"u{rng.randrange(10_000)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert collections.Counter(tuple(r) for r in jaccard_join.near_duplicates(df, 4, 85, 100).collect()) == plain_components(rows, 4, 85, 100)


def test_candidates_of_a_block_are_all_pairs_with_the_similarity_once():
    """Random prefixes: what the blocks of all groups propose holds every linked pair of different components, none twice."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(60, int(rng.integers(20, 40)), replace=False)).astype(np.uint64) for _ in range(60)]
    for k in range(0, 60, 3):  # near copies
        sets[k + 1] = np.unique(np.append(np.delete(sets[k], rng.integers(len(sets[k]))), np.uint64(100 + k)))
    num, den = 80, 100
    count = collections.Counter(x for s in sets for x in s.tolist())
    order = [sorted(s.tolist(), key=lambda x: (count[x], x))[: jaccard_join.prefix_length(len(s), num, den)] for s in sets]
    group_of = {x: x % 4 for x in count}
    seen = collections.Counter()
    for g in range(4):
        rows = [k for k, o in enumerate(order) if any(group_of[x] == g for x in o)]
        entries = [(i, x, p, group_of[x]) for i, k in enumerate(rows * 2) for p, x in enumerate(order[k])]
        row, token, place, of_group = map(np.array, zip(*entries, strict=True))
        n = np.array([len(sets[k]) for k in rows * 2])
        block = {
            "key": np.array(rows * 2), "component": np.array(rows * 2) + 1000, "probe": np.arange(2 * len(rows)) >= len(rows), "n": n, "row": row, "token": token, "place": place,
            "of_group": of_group, "centre": np.zeros(len(row), bool), "ranges": np.array([jaccard_join._ranges(sets[k]) for k in rows * 2]).astype(np.int16),
        }
        for p, m in jaccard_join._candidates(g, block, num, den):
            seen.update((min(x, y), max(x, y)) for x, y in zip(block["key"][p].tolist(), block["key"][m].tolist(), strict=True))
    linked = {(a, b) for b in range(60) for a in range(b) if den * len(np.intersect1d(sets[a], sets[b])) >= num * len(np.union1d(sets[a], sets[b]))}
    assert linked and linked <= set(seen) and set(seen.values()) == {1}


def test_keep_one(docs, rows):
    kept = jaccard_join.keep_one(docs, 5, 80, 100)
    assert kept.columns == docs.columns
    expected = {c for (i, _, c) in plain_components(rows, 5, 80, 100) if i is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in got if i is not None) == sorted(expected) and got.count(None) == 1


@pytest.mark.parametrize("links", [1 << 18, 7])
def test_components(spark, monkeypatch, links):
    monkeypatch.setattr(components, "_LINKS", links)  # all in one task, or many tasks and rounds
    edges = [(k, k + 1) for k in range(50)] + [(100, 200), (200, 300), (7, 7)] + [(1000, 2000 + k) for k in range(300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 200: 100, 300: 100, 1000: 1000, **{2000 + k: 1000 for k in range(300)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_dedup(rows, window):
    """(doc_id, n_words, n_removed, kept) by the definition: a word goes if its window starts earlier too."""
    last = 2**63 - 1
    first = {}
    split = [(last if i is None else i, i, WORDS.findall(t or "")) for i, t, *_ in rows]
    for key, _, w in split:
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, (key, s)), (key, s))
    out = collections.Counter()
    for key, i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (key, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substring_dedup(docs, none, rows):
    got = substring_dedup.dedup_substrings(docs, 20)
    assert set(got.columns) == {*docs.columns, "n_words", "n_removed", "kept_sha256"} and got.select("label").distinct().count() == 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain_dedup(rows, 20)
    same = {(r.doc_id, r.text) for r in got.where("n_removed = 0").collect()}
    assert same <= {(r[0], r[1]) for r in rows}
    assert substring_dedup.dedup_substrings(none, 20).count() == 0


def test_a_full_sketch_changes_nothing(docs, rows, monkeypatch):
    """With so few cells that nearly every window is estimated repeated, the exact pass still decides; also with a tree of merges."""
    from wavestrata.llm import sketch

    monkeypatch.setattr(sketch, "_MERGED", 50)
    got = substring_dedup.dedup_substrings(docs, 20, most_bits=10)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain_dedup(rows, 20)


def test_sketch_never_estimates_too_low(spark, monkeypatch):
    from wavestrata.llm import sketch

    monkeypatch.setattr(sketch, "_HELD", 1000)
    monkeypatch.setattr(sketch, "_MERGED", 400)
    rng = np.random.default_rng(2)
    values = rng.integers(0, 3000, 6000)
    n = collections.Counter(values.tolist())
    layout = [sketch.Rows(1, 16), sketch.Rows(2, 12, least=4, start=1 << 16, seed=1)]
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(5)
    bits = sketch.flagged_cells(df, lambda batch: [textkit.mix(batch.column(0).to_numpy().astype(np.uint64))] * 2, layout, 18_000)
    keys = np.array(sorted(n), np.uint64)
    count = np.array([n[int(k)] for k in keys])
    twice, four = (sketch.flagged(bits, r, textkit.mix(keys)) for r in layout)
    assert twice[count >= 2].all() and four[count >= 4].all() and twice[count == 1].mean() < 0.1 and four[count < 4].mean() < 0.6


def test_the_sketch_filters_alike_at_every_size():
    """Cells grow with the input up to the bound, so the load of each row stays under a half."""
    for n_bytes in (10**5, 10**7, 10**8, 9 * 10**8):
        (seen, least, often), _ = substring_dedup.sketch_rows(n_bytes, 20, 8, 28)
        assert n_bytes / 7 <= 0.5 * 2**seen.bits and n_bytes / 49 <= 0.5 * 2**least.bits and 200 <= often.least <= 256


def test_places_of_sketches_survive_their_encoding():
    from wavestrata.llm import sketch

    at = np.array([0, 1, 254, 255, 256, 511, 4_000_000, 4_194_303], np.uint32)
    count = np.array([1, 2, 1, 300, 1, 1, 7, 1])
    assert [x.tolist() for x in sketch._decoded(*sketch._encoded(at, count))] == [at.tolist(), count.tolist()]


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    encoder = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, 256).collect()
    expected = collections.Counter()
    for i, t, *_ in rows:
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), 256):
            part = np.array(ids[s : s + 256], "<u4")
            expected[i, s // 256, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [p for p, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 256
    fewest = max(math.ceil(sum(r.length for r in got) / 256), sum(r.length > 128 for r in got))  # two over half never share
    assert len(bins) <= 1.01 * fewest
    assert packing.pack_documents(none, path, 256).count() == 0


def test_fullest_combination_is_the_fullest():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 30, 5)}
        room = int(rng.integers(0, 60))
        sums = {0}
        for x, c in counts.items():
            sums = {s + k * x for s in sums for k in range(c + 1) if s + k * x <= room}
        found = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(x * n for x, n in found) == max(sums) and all(n <= counts[x] for x, n in found)


def test_plan_holds_every_piece_once():
    rng = np.random.default_rng(1)
    counts = {int(x): int(c) for x, c in zip(rng.integers(1, 2049, 300), rng.integers(1, 1000, 300), strict=True)}
    used = collections.Counter()
    for bins, pattern in packing.packing_plan(counts):
        assert bins > 0 and sum(x * n for x, n in pattern) <= 2048
        for x, n in pattern:
            used[x] += n * bins
    assert used == counts


def test_tokens_by_word_equal_tokens_by_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["It's a TEST,don't\tpanic!", "", "ÀÉ é ﬁ ½ Σας ΣΑΣ", "a b c ́d", "<|endoftext|> x <|startoftext|>y", "1234 ''' --- 🙂🙂"]
    words = WordTokenizer(packing.vocabulary())
    encoder = Tokenizer.from_file(packing.vocabulary())
    for _ in range(2):
        flat, bounds = words.encode(*textkit.text_buffers(pa.array(texts)))
        for k, t in enumerate(texts):
            assert flat[bounds[k] : bounds[k + 1]].tolist() == encoder.encode(t, add_special_tokens=False).ids + [0]


def test_words_with_one_hash_get_their_own_ids(monkeypatch):
    import pyarrow as pa

    from wavestrata.llm import tokens

    real = tokens.hash_words
    monkeypatch.setattr(tokens, "hash_words", lambda *a: real(*a) % np.uint64(7))
    texts = [t or "" for _, t, *_ in tricky.documents()[:20]]
    words = WordTokenizer(packing.vocabulary())
    for _ in range(2):
        flat, bounds = words.encode(*textkit.text_buffers(pa.array(texts)))
        for k, t in enumerate(texts):
            assert flat[bounds[k] : bounds[k + 1]].tolist() == words.encoder.encode(t, add_special_tokens=False).ids + [0]


def test_mixing(spark, docs, none, rows):
    got = mixing.mix_sources(docs, mixing.WEIGHTS, 7)
    again = collections.Counter(tuple(r) for r in mixing.mix_sources(docs.repartition(3), mixing.WEIGHTS, 7).collect())
    found = got.collect()
    assert collections.Counter(tuple(r) for r in found) == again
    plain = collections.Counter((r.doc_id, r.text) for r in found if r.source not in mixing.WEIGHTS)
    assert plain == collections.Counter((r[0], r[1]) for r in rows if r[3] not in mixing.WEIGHTS)
    assert mixing.mix_sources(none, mixing.WEIGHTS, 7).count() == 0
    many = spark.createDataFrame([(k, "x" * 10, "big" if k % 10 else "small") for k in range(20_000)], "doc_id long, text string, source string")
    shares = {r.source: r["count"] for r in mixing.mix_sources(many, {"big": 1.0, "small": 1.0}, 3).groupBy("source").count().collect()}
    assert abs(shares["big"] - 10_000) < 500 and abs(shares["small"] - 10_000) < 500
    rare = spark.createDataFrame([(k, "x" * 10, "small" if k < 20 else "big") for k in range(20_000)], "doc_id long, text string, source string")
    counts = [r.n for r in mixing.mix_sources(rare, {"big": 1.0, "small": 1.0}, 3).where("source = 'small'").groupBy("doc_id").agg(F.max("copy").alias("n")).collect()]
    assert len(counts) == 20 and abs(np.mean(counts) - 500) < 25  # a rate far over the table's step


def test_poisson_table():
    table = np.array(mixing.poisson_table(3.5))
    terms = [math.exp(-3.5) * 3.5**k / math.factorial(k) for k in range(len(table))]
    assert np.allclose(table, np.cumsum(terms)) and table[-1] > 1 - 1e-12


def test_quality(spark, docs, none, data):
    labels = spark.createDataFrame([(k * 3 + 1, int(k % 6 != 3)) for k in range(60)] + [(1, 1), (None, 1), (4, None), (99_999, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "held_out", "score", "predicted"]
    found = got.collect()
    assert len(found) == docs.count()
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    for no_labels in (labels.where("false"), labels.where("quality = 1")):
        assert {r.predicted for r in quality.score_quality(docs, no_labels).collect()} == {1}
    assert quality.score_quality(none, labels).count() == 0


def test_held_out_labels_do_not_change_scores(spark, docs):
    labels = [(k * 3 + 1, int(k % 6 != 3)) for k in range(60)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    scores = [sorted((r.doc_id or -1, r.score) for r in quality.score_quality(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_held_out_accuracy(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op5_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95


def test_isotonic():
    at, value = quality.isotonic(np.arange(5.0), np.array([0.1, 0.4, 0.2, 0.9, 0.8]), np.array([1.0, 1, 3, 1, 1]))
    assert np.allclose(at, [0, 1.75, 3.5]) and np.allclose(value, [0.1, 0.25, 0.85])


def plain_statistics(text):
    """The statistics of one text, by their names."""
    data, words = text.encode(), [w.encode() for w in WORDS.findall(text)]
    if not data:
        return dict.fromkeys(quality.FEATURES, 0.0)
    share = lambda test, of: sum(map(test, of)) / max(1, len(of))
    out = {f"{c} share": share(lambda x, c=c: x in quality._CLASSES[c], data) for c in quality._CLASSES}
    counts = collections.Counter(data)
    has = lambda w, c: any(x in quality._CLASSES[c] for x in w)
    length = [len(w) for w in words]
    mean = sum(length) / max(1, len(words))
    equal = [k > 0 and w == words[k - 1] for k, w in enumerate(words)]
    symbol = [has(w, "symbol") for w in words]
    capital = [len(w) > 1 and sum(x in quality._CLASSES["upper"] for x in w) >= 0.6 * len(w) for w in words]
    bar = [w == b"|" for w in words]
    old = [w in words[:k] for k, w in enumerate(words)]
    most = lambda flags: max((sum(flags[k : k + 32]) / max(16, len(flags[k : k + 32])) for k in range(0, len(flags), 32)), default=0)
    pairs = list(zip(words, words[1:], strict=False))
    out |= {
        "log bytes": math.log1p(len(data)), "log words": math.log1p(len(words)), "byte entropy": -sum(n / len(data) * math.log2(n / len(data)) for n in counts.values()), "mean word length": mean,
        "word length deviation": math.sqrt(max(0, sum(x * x for x in length) / max(1, len(words)) - mean**2)), "longest word": math.log1p(max(length, default=0)), "distinct words": len(set(words)) / max(1, len(words)),
        "distinct pairs": len(set(pairs)) / max(1, len(words) - 1), "equal neighbours": share(bool, equal), "short words": share(lambda x: x <= 3, length), "symbol words": share(bool, symbol),
        "capital words": share(bool, capital), "bar words": share(bool, bar), "most equal neighbours": most(equal), "most symbol words": most(symbol), "most capital words": most(capital), "most bar words": most(bar),
        "least distinct words": most(old), "words a line": math.log1p(len(words) / (data.count(b"\n") + 1)),
    }
    return out


def test_scores_equal_a_plain_fit(spark, docs, rows):
    """Ridge on the same features by one least-squares call over all rows, calibrated by the definition of the isotonic fit."""
    few = [r for r in rows if len(r[1] or "") < 50_000]
    labels = [(k * 3 + 1, int(k % 6 != 3)) for k in range(60)]
    got = {(r.doc_id, r.text): r.score for r in quality.score_quality(spark.createDataFrame(few, tricky.SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = np.array([[plain_statistics(t or "")[f] for f in quality.FEATURES] for _, t, *_ in few])
    z = quality.random_features(x, x.mean(0), np.maximum(1e-6, x.std(0)))
    known = dict(labels)
    crc = lambda i: zlib.crc32(str(i).encode()) % 3
    rows_of = {f: [k for k, r in enumerate(few) if r[0] in known and (crc(r[0]) == 0 if f == 0 else crc(r[0]) == 2)] for f in (0, 1)}
    y = np.array([known.get(r[0], 0) for r in few], float)

    def ridge(at):
        penalty = np.sqrt([quality.RIDGE * max(1, len(at))] * quality.RANDOM + [1e-9])
        return np.linalg.lstsq(np.concatenate([z[at], np.diag(penalty)]), np.append(y[at], np.zeros(len(penalty))), rcond=None)[0]

    own = {f: ridge(at) for f, at in rows_of.items()}
    both = rows_of[0] + rows_of[1]
    crossed = np.concatenate([z[rows_of[0]] @ own[1], z[rows_of[1]] @ own[0]])
    bins = np.clip(((crossed - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int), 0, quality.BINS - 1)
    used = np.unique(bins)
    n, ones = (np.array([(y[both] >= limit)[bins == b].sum() for b in used]) for limit in (0, 1))
    best = np.array([max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))])  # minimax form
    centre = quality.LOW + (used + 0.5) * (quality.HIGH - quality.LOW) / quality.BINS
    levels = sorted(set(np.round(best, 12)))
    at = [np.average(centre[np.isclose(best, v)], weights=n[np.isclose(best, v)]) for v in levels]
    for (i, t, *_), raw in zip(few, z @ ridge(both), strict=True):
        assert abs(got[i, t] - np.interp(raw, at, levels)) < 1e-3, i


def test_license_scan(spark, docs, none, rows):
    texts = license_scan.TEMPLATES
    filler = " ".join(f"f{k}" for k in range(97))
    planted = [(k, f"{filler} {t} {filler}") for k, t in enumerate(texts.values())]
    mit = texts["MIT-grant"].split()
    mit[10] = "edited"
    planted += [(50, f"{filler} {' '.join(mit)}"), (51, " ".join(mit[:20])), (52, texts["MIT"].upper()), (None, texts["GPL-3.0"]), (54, None), (55, "")]
    got = {(r.doc_id, r.template): r for r in license_scan.scan_licenses(spark.createDataFrame(planted, "doc_id long, text string")).collect()}
    for k, name in enumerate(texts):
        assert got[k, name].containment == 1
    assert 0.8 <= got[50, "MIT-grant"].containment < 1 and (52, "MIT") in got and (None, "GPL-3.0") in got
    assert not [k for k in got if k[0] in (51, 54, 55)]
    assert license_scan.scan_licenses(docs).count() == 0 and license_scan.scan_licenses(none).count() == 0


@pytest.mark.parametrize("n", [1024, 4096])
def test_license_scan_of_like_words(spark, n):
    words = [" ".join(["a b c d", w, "e f g h"]) for w in tricky.alike(n)]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), {"first": words[0]}).collect()
    assert [(r.doc_id, r.containment) for r in got] == [(0, 1.0)]


def test_license_scan_equals_the_exact_share_of_every_window(data):
    import duckdb
    import pyarrow as pa

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{data}/documents.parquet'").fetchall()]
    groups = license_scan.template_groups(license_scan.TEMPLATES)
    edge = re.compile(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$")
    split = lambda t: [x for x in (edge.sub("", w) for w in WORDS.findall(t.translate(LOWER))) if x]
    expected = {}
    for row, t in enumerate(texts):
        w = split(t)
        for g in groups:
            for name in g.names:
                v = split(license_scan.TEMPLATES[name])
                s = {tuple(v[k : k + g.shingle]) for k in range(len(v) - g.shingle + 1)}
                last = len(w) - g.shingle + 1
                for at in range(0, max(0, last), g.block):
                    share = len(s & {tuple(w[k : k + g.shingle]) for k in range(at, min(last, at + 2 * g.block))}) / len(s)
                    if share >= 0.8 and share > expected.get((row, name), 0):
                        expected[row, name] = share
    assert {(r, n): s for r, n, s, _, _ in license_scan.scan(pa.array(texts), groups, 0.8)} == expected and expected
