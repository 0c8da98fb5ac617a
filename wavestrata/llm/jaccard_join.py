"""N-gram Jaccard join: sets of word n-grams with a similarity of at least num/den are linked.

Equal sets are one class, known by a 64-bit digest of the set. Between classes:

1. Each batch sends its classes' n-grams, packed, to hash buckets whose number follows from the size of the input.
   A bucket counts every n-gram exactly (how many classes of batches hold it) and finds those that several classes share.
2. The order of all n-grams is rare first: those of one class only, then the shared ones by count, then by token. The
   prefix of a set of n are its first n - ceil(n * num / den) + 1. Two sets with the similarity share a prefix n-gram; those of
   one class only fill places but are not looked at any further.
3. Each shared prefix n-gram first proposes the pairs of its holders with its most central one. Pairs that pass the length and
   positional filters are made distinct, pass the suffix filter (counts of the n-grams in 64 hash ranges bound what two sets do not
   share) and are verified on the whole sets. What is linked becomes a component.
4. The holders of the n-grams whose central one is in a component are its group. A member outside the component meets
   the other components' members in blocks of bounded size: joined on prefix n-grams, under the length, positional and suffix filters.
   A pair is looked at in the group of its first common prefix n-gram alone and not if step 3 has verified it, so every pair is
   verified once at most. A member that is linked to a component needs no other link to it.

A group of near copies thus costs a few pairs per member, not all pairs, and no link that joins two components is lost.

Sets are compared by 64-bit n-gram hashes; a wrong link would need a collision of them (2**-64 a pair). Tokens have 40 bits of the
hash within a bucket; tokens that different n-grams share only add candidates, and a set's own ones are told apart by their number.

Rows: a text without words, or null, has no n-grams and links to nothing; each row is a document, repeated rows are
equal sets and so linked; the component of documents without doc_id only is null; other columns play no part. An empty table
gives an empty one. docs is read twice and must give the same rows both times, as tables do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavestrata.llm.components import components
from wavestrata.llm.runs import run_starts, whole_runs
from wavestrata.llm.store import dropped, partitions, small_batches, written
from wavestrata.llm.textkit import U64, as_long, mix, row_groups, shingle_sets, tidy

_RANGES, _MEMBERS, _HITS = 64, 1024, 1 << 18
_BUCKET = 1 << 20  # n-grams in a bucket, about
_LOW = 5  # bytes of a hash beside its bucket
_NO_ID = -(1 << 63)


def _key(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _ranges(grams: np.ndarray) -> np.ndarray:
    """How many n-grams fall into each hash range, 255 at most (which keeps the bound a bound)."""
    return np.minimum(np.bincount((grams >> U64(58)).astype(np.int64), minlength=_RANGES), 255).astype(np.uint8)


def least_overlap(x: np.ndarray | int, y: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """The smallest overlap of sets of these sizes with the similarity."""
    return -(-num * (x + y) // (num + den))


def prefix_length(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    return n - -(-num * n // den) + 1


def _near(n1, i1, n2, i2, num: int, den: int):  # noqa: ANN001, ANN202
    """Length and positional filters of sets of n1 and n2 n-grams whose first common one is at places i1 and i2."""
    rest = np.minimum(n1 - i1, n2 - i2)
    return (n1 * den >= n2 * num) & (n2 * den >= n1 * num) & (rest >= least_overlap(n1, n2, num, den))


def _near_columns(n1: F.Column, i1: F.Column, n2: F.Column, i2: F.Column, num: int, den: int) -> F.Column:
    """The same for columns."""
    enough = F.least(n1 - i1, n2 - i2) * (num + den) >= num * (n1 + n2)
    return (n1 * den >= n2 * num) & (n2 * den >= n1 * num) & enough


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each hash among n, by its high bits."""
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bucket: its number, its rows, and the owners and sizes of the runs of rows with one owner. owner never falls."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    b, o = bucket[order], owner[order]
    runs = run_starts([b, o])
    size = np.diff(np.append(runs, len(b)))
    starts = run_starts([b])
    of = np.searchsorted(runs, np.append(starts, len(b)))
    for k, (s, e) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True)):
        yield int(b[s]), order[s:e], o[runs[of[k] : of[k + 1]]], size[of[k] : of[k + 1]]


_PACKED = "bucket long, kind int, doc_id long, key long, n long, keys binary, sizes binary, grams binary, counts binary"
_NAMES = [f.split()[0] for f in _PACKED.split(", ")]


def _packed(kind: int, **columns: list) -> pa.RecordBatch:
    """A batch of _PACKED rows of one kind: 0 a document (doc_id, key, n), 1 n-grams of a bucket, 2 sizes of classes."""
    rows = len(columns["bucket"])
    kinds = {"bucket": pa.int64(), "kind": pa.int32(), "doc_id": pa.int64(), "key": pa.int64(), "n": pa.int64()}
    given = columns | {"kind": [kind] * rows}
    return pa.RecordBatch.from_arrays([pa.array(given[c], kinds.get(c, pa.binary())) if c in given else pa.nulls(rows, kinds.get(c, pa.binary())) for c in _NAMES], _NAMES)


def _numbers(columns: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(columns.to_pylist()), kind)


def _prefixes(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Rows of kind 0: documents (doc_id, key, n); of kind 1: shared n-grams in the prefix of a class (token, key, n, place, central)."""
    spark = docs.sparkSession
    parts = partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 22, max(parts, size // (6 * _BUCKET)))

    def send(parted: list, ids: list, heads: list) -> Iterator[pa.RecordBatch]:
        """One batch's documents, and its classes' n-grams and sizes by bucket."""
        spread = mix(np.arange(len(ids)).astype(U64) + U64(len(parted)))
        yield _packed(0, bucket=_bucket(spread, buckets), doc_id=ids, key=[h[0] for h in heads], n=[h[1] for h in heads])
        if not parted:
            return
        keys = np.array([k for k, _ in parted], np.int64)
        sizes = np.array([len(g) for _, g in parted])
        grams, owner = np.concatenate([g for _, g in parted]), np.repeat(np.arange(len(parted)), sizes)
        low = grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_LOW]
        out = [(b, keys[o].tobytes(), s.astype("<u4").tobytes(), low[rows].tobytes()) for b, rows, o, s in _by_bucket(_bucket(grams, buckets), owner)]
        b, k, s, g = zip(*out, strict=True)
        yield _packed(1, bucket=b, keys=k, sizes=s, grams=g)
        out = [(b, keys[rows].tobytes(), sizes[rows].astype("<u4").tobytes()) for b, rows, _, _ in _by_bucket(_bucket(mix(keys.view(U64)), buckets), np.arange(len(keys)))]
        b, k, s = zip(*out, strict=True)
        yield _packed(2, bucket=b, keys=k, sizes=s)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, seen = batch.column(0).to_pylist(), set()
            parted, ids, heads, held = [], [], [], 0
            for row, grams in enumerate(shingle_sets(batch.column(1), n)):
                key = _key(grams) if len(grams) else None
                ids.append(given[row])
                heads.append((key, len(grams)))
                if key is not None and key not in seen:
                    seen.add(key)
                    parted.append((key, grams))
                    held += len(grams)
                if held > 500_000:
                    yield from send(parted, ids, heads)
                    parted, ids, heads, held = [], [], [], 0
            if ids:
                yield from send(parted, ids, heads)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passes documents and sizes on; of a bucket's n-grams those that several classes hold, with their counts, by bucket of the class."""
        for table in whole_runs(batches, 1):
            kind = table["kind"].to_numpy()
            other = table.filter(pa.array(kind != 1))
            if other.num_rows:
                yield from other.to_batches()
            for s, e in _runs_of(table["bucket"].to_numpy()):
                part = table.slice(s, e - s).filter(pa.array(kind[s:e] == 1))
                if part.num_rows:
                    yield from _shared(part, buckets)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, 1):
            kind = table["kind"].to_numpy()
            rows = table.filter(pa.array(kind == 0))
            if rows.num_rows:
                none = pa.nulls(rows.num_rows, pa.int64())
                yield from pa.table([rows["kind"], rows["doc_id"], rows["key"], rows["n"], none, none, none], names=_CHOSEN).to_batches()
            for s, e in _runs_of(table["bucket"].to_numpy()):
                part = table.slice(s, e - s)
                yield from _chosen(part.filter(pa.array(kind[s:e] == 1)), part.filter(pa.array(kind[s:e] == 2)), num, den)

    dealt = lambda rows: rows.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket")
    sent = docs.mapInArrow(tidy(describe), _PACKED)
    shared = dealt(sent).mapInArrow(tidy(share), _PACKED)
    return dealt(shared).mapInArrow(tidy(choose), "kind int, doc_id long, key long, n long, token long, place long, central long")


_CHOSEN = ["kind", "doc_id", "key", "n", "token", "place", "central"]


def _runs_of(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = run_starts(list(columns))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(columns[0])], strict=True)


def _shared(part: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of one bucket that several classes hold."""
    raw = _numbers(part["grams"], "u1").reshape(-1, _LOW)
    low = np.zeros((len(raw), 8), np.uint8)
    low[:, :_LOW] = raw
    low = low.view("<u8")[:, 0]
    keys, sizes = _numbers(part["keys"], "<i8"), _numbers(part["sizes"], "<u4")
    run = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.argsort(low, kind="stable")
    low, run = low[order], run[order]
    owner = keys[run]
    starts = run_starts([low])
    count = np.diff(np.append(starts, len(low)))
    several = np.minimum.reduceat(owner, starts) < np.maximum.reduceat(owner, starts)
    keep = np.flatnonzero(np.repeat(several, count))
    if not len(keep):
        return
    token, count, owner, run = low[keep], np.repeat(count, count)[keep], owner[keep], run[keep]
    again = np.zeros(len(token), np.uint64)  # different n-grams of one set with one token get numbers
    for k in np.flatnonzero((token[1:] == token[:-1]) & (run[1:] == run[:-1])).tolist():
        again[k + 1] = again[k] + U64(1)
    bucket = U64(part["bucket"][0].as_py())
    token = (bucket << U64(8 * _LOW) | token) ^ again << U64(62)
    order = np.argsort(owner, kind="stable")
    token, count, owner = token[order], count[order], owner[order]
    out = []
    for b, rows, o, s in _by_bucket(_bucket(mix(owner.view(U64)), buckets), np.cumsum(np.append(0, owner[1:] != owner[:-1]))):
        out.append((b, owner[rows[np.cumsum(s) - s]].tobytes(), s.astype("<u4").tobytes(), token[rows].tobytes(), count[rows].astype("<u4").tobytes()))
    b, k, s, g, c = zip(*out, strict=True)
    yield _packed(1, bucket=b, keys=k, sizes=s, grams=g, counts=c)


def _chosen(grams: pa.Table, classes: pa.Table, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The shared n-grams that lie in the prefixes of the classes of one bucket."""
    if not grams.num_rows:
        return
    keys, sizes = _numbers(grams["keys"], "<i8"), _numbers(grams["sizes"], "<u4")
    key, token, count = np.repeat(keys, sizes), _numbers(grams["grams"], "<u8"), _numbers(grams["counts"], "<u4")
    order = np.lexsort((token, count, key))
    key, token = key[order], token[order]
    new = run_starts([key, token])  # a class that several batches hold comes several times
    key, token = key[new], token[new]
    starts = run_starts([key])
    shared = np.diff(np.append(starts, len(key)))
    known, at = np.unique(_numbers(classes["keys"], "<i8"), return_index=True)
    n = _numbers(classes["sizes"], "<u4").astype(np.int64)[at][np.searchsorted(known, key[starts])]
    place = np.arange(len(key)) - np.repeat(starts, shared) + np.repeat(n - shared, shared)
    each, central = np.repeat(n, shared), np.repeat(1_000_000 * shared // n, shared)
    keep = np.flatnonzero(place < prefix_length(each, num, den))
    none = pa.nulls(len(keep), pa.int64())
    columns = [pa.array(np.ones(len(keep), np.int32)), none, *(pa.array(x[keep]) for x in (key, each, as_long(token), place, central))]
    yield pa.RecordBatch.from_arrays(columns, _CHOSEN)


def _sets(docs: DataFrame, described: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, ranges, grams) of the wanted classes, from one document of each; a few others may be among them."""
    first = described.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("own_id").alias("own_id"))
    first = written(first.select("own_id").distinct(), "wanted")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                found = {_key(g): g for g in shingle_sets(batch.column(0).slice(s, 500), n) if len(g)}
                columns = [pa.array(found, pa.int64()), pa.array([_ranges(g).tobytes() for g in found.values()], pa.binary()), pa.array([g.tobytes() for g in found.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "ranges", "grams"])

    texts = docs.withColumn("own_id", F.coalesce("doc_id", F.lit(_NO_ID))).join(first, "own_id", "left_semi").select("text")
    return texts.mapInArrow(tidy(collect), "key long, ranges binary, grams binary").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s in range(0, batch.num_rows, 256):
                few = batch.slice(s, 256)
                for k, (x, y) in enumerate(zip(few.column(2).to_pylist(), few.column(3).to_pylist(), strict=True), s):
                    x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                    least = least_overlap(len(x), len(y), num, den)
                    apart = np.abs(_ranges(x).astype(np.int64) - _ranges(y)).sum()
                    if apart <= len(x) + len(y) - 2 * least and len(np.intersect1d(x, y, assume_unique=True)) >= least:
                        keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    left = sets.select(F.col("key").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(tidy(check), "a long, b long")


def _candidates(group: int, block: dict[str, np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(probe, member) rows of a block that share a prefix n-gram and pass all filters, probe after probe.

    block has for each row key, component, probe, n and ranges, and for each prefix n-gram its row (never falling), token, place,
    of_group and centre (whether the row is the n-gram's central one).
    """
    row, token, place, centre, n = (block[c] for c in ("row", "token", "place", "centre", "n"))
    members = np.flatnonzero(~block["probe"][row])
    members = members[np.argsort(token[members], kind="stable")]
    asked = np.flatnonzero(block["probe"][row])
    left, right = (np.searchsorted(token[members], token[asked], side) for side in ("left", "right"))
    hits = right - left
    probes = run_starts([row[asked]])
    upto = np.append(0, np.cumsum(hits))[np.append(probes, len(asked))]
    for a, b in row_groups(upto, _HITS):
        lo, hi = probes[a], probes[b] if b < len(probes) else len(asked)
        h = hits[lo:hi]
        x = np.repeat(asked[lo:hi], h)
        y = members[np.repeat(left[lo:hi] - (np.cumsum(h) - h), h) + np.arange(len(x))]
        p, m = row[x], row[y]
        apart = block["component"][p] != block["component"][m]
        apart &= (block["component"][m] == group) | (block["key"][p] < block["key"][m])  # two outside members meet once
        keep = np.flatnonzero(apart & (n[p] * den >= n[m] * num) & (n[m] * den >= n[p] * num))
        keep = keep[np.lexsort((place[x[keep]], m[keep], p[keep]))]
        if not len(keep):
            continue
        x, y, p, m = x[keep], y[keep], p[keep], m[keep]
        near = _near(n[p], place[x], n[m], place[y], num, den)
        first = run_starts([p, m])
        known = np.logical_or.reduceat((centre[x] | centre[y]) & near, first)  # verified with the central one already
        found = first[near[first] & ~known & (block["of_group"][x[first]] == group)]
        p, m = p[found], m[found]
        bound = n[p] + n[m] - 2 * least_overlap(n[p], n[m], num, den)
        for s in range(0, len(p), 4096):
            few = slice(s, s + 4096)
            ok = np.abs(block["ranges"][p[few]] - block["ranges"][m[few]]).sum(1) <= bound[few]
            yield p[few][ok], m[few][ok]


def _probed(num: int, den: int):  # noqa: ANN202
    """A link of each outside member to each component that it links to, for sorted (group, part, block) runs."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, 3):
            group, part, block = (table[c].to_numpy() for c in ("group", "part", "block"))
            for s, e in _runs_of(group, part, block):
                rows = table.slice(s, e - s)
                sets = [np.frombuffer(x, U64) for x in rows["grams"].to_pylist()]
                prefix = rows["prefix"].combine_chunks()
                flat = prefix.flatten()
                own = {c: rows[c].to_numpy() for c in ("key", "component", "probe")}
                own |= {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("token", "place", "of_group", "centre")}
                own |= {"row": np.repeat(np.arange(e - s), prefix.value_lengths().to_numpy()), "n": np.array([len(x) for x in sets])}
                own["ranges"] = np.frombuffer(b"".join(rows["ranges"].to_pylist()), np.uint8).reshape(-1, _RANGES).astype(np.int16)
                out, linked = [], set()
                for p, m in _candidates(int(group[s]), own, num, den):
                    for x, y in zip(p.tolist(), m.tolist(), strict=True):
                        to = x, own["component"][y]
                        if to not in linked and len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= least_overlap(len(sets[x]), len(sets[y]), num, den):
                            linked.add(to)
                            out.append((own["key"][x], own["key"][y]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return links


def class_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n) of every document, and (node, component) of the classes linked to another class."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    prefixes = written(_prefixes(docs, n, num, den), "prefixes")
    described = prefixes.where("kind = 0").select("doc_id", "key", "n", F.coalesce("doc_id", F.lit(_NO_ID)).alias("own_id"))
    live = prefixes.where("kind = 1").select("key", "n", "token", "place", "central")

    # Sides of joins that could meet frequent keys are tables: with an exchange of its own each, Spark can split such a key.
    centre = live.groupBy("token").agg(F.max(F.struct("central", "key", "n", "place")).alias("c"), F.count("*").alias("holders")).where("holders > 1")
    centre = written(centre.select("token", "holders", F.col("c.key").alias("c_key"), F.col("c.n").alias("c_n"), F.col("c.place").alias("c_place")), "centre")
    starred = written(live.join(centre, "token").drop("central"), "starred")
    near = starred.where((F.col("key") != F.col("c_key")) & _near_columns(F.col("n"), F.col("place"), F.col("c_n"), F.col("c_place"), num, den))
    pairs = written(near.select(F.least("key", "c_key").alias("a"), F.greatest("key", "c_key").alias("b")).distinct(), "pairs")
    several = starred.where("holders > 2")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).unionByName(several.select("key")).distinct()
    sets = written(_sets(docs, described, wanted, n), "sets")
    joined = written(components(_verified(pairs, sets, num, den)), "joined")

    of_key, of_centre = (joined.select(F.col("node").alias(k), F.col("component").alias(c)) for k, c in (("key", "component"), ("c_key", "of_group")))
    placed = several.select("key", "c_key").distinct().join(of_key, "key", "left").join(of_centre, "c_key", "left")
    placed = placed.select("key", F.coalesce("component", "key").alias("component"), F.coalesce("of_group", "c_key").alias("group")).distinct()
    placed = written(placed, "placed")
    outside = F.col("component") != F.col("group")
    open_ = placed.groupBy("group").agg(F.count("*").alias("members"), F.count_if(outside).alias("asking")).where("asking > 0")
    open_ = open_.select("group", F.ceil(F.col("members") / _MEMBERS).cast("int").alias("parts"), F.ceil(F.col("asking") / _MEMBERS).cast("int").alias("blocks"))
    open_ = written(open_, "open")
    members = written(placed.join(open_, "group"), "members")
    entry = F.struct("token", "place", F.coalesce("of_group", "c_key").alias("of_group"), (F.col("key") == F.col("c_key")).alias("centre"))
    prefix = starred.join(members.select("key").distinct(), "key", "left_semi").join(of_centre, "c_key", "left").groupBy("key").agg(F.collect_list(entry).alias("prefix"))
    described_sets = written(sets.join(prefix, "key"), "asked")
    known = members.join(described_sets, "key").withColumn("probe", outside)
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ["key", "component", "ranges", "grams", "prefix"]
    asked = known.select("group", own("parts").alias("part"), all_("blocks").alias("block"), *fields, F.lit(False).alias("probe"))
    probes = known.where("probe").select("group", all_("parts").alias("part"), own("blocks").alias("block"), *fields, "probe")
    dealt = asked.unionByName(probes).repartition(partitions(spark), "group", "part", "block").sortWithinPartitions("group", "part", "block")
    second = dealt.mapInArrow(tidy(_probed(num, den)), "a long, b long")
    old = joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    linked = components(old.unionByName(second))
    dropped(centre, starred, pairs, sets, joined, placed, open_, members, described_sets)
    return described.select("doc_id", "key", "n"), linked


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the least doc_id reachable by links."""
    described, linked = class_components(docs, n, num, den)
    classes = described.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"))
    of_class = written(classes.join(linked.withColumnRenamed("node", "key"), "key", "left"), "classes")
    least = written(of_class.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least")), "least")
    alone = of_class.where("component IS NULL").select("key", F.col("first").alias("component_id"))
    joint = of_class.where("component IS NOT NULL").join(least.hint("merge"), "component").select("key", F.col("least").alias("component_id"))
    known = written(alone.unionByName(joint), "components")
    dropped(of_class, least)
    full = described.where("key IS NOT NULL").join(known.hint("merge"), "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(described.where("key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id.

    Rows of one doc_id are one document and one of them stays; rows without doc_id all stay.
    """
    kept = near_duplicates(docs, n, num, den).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    found = docs.where("doc_id IS NOT NULL").join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return found.withColumn("__again", again).where("__again = 1").drop("__again").unionByName(docs.where("doc_id IS NULL"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN edges b ON r.y = b.x)
SELECT s.doc_id, len(s.s) AS n_shingles, r.c AS component_id FROM sets s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON s.doc_id = r.x
"""
