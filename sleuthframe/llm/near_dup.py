"""Near-duplicate groups by a MinHash containment ensemble.

A document is redundant if one at least as large contains THRESHOLD of its
shingles. Documents with equal shingle sets are one class; the search is among
classes, partitioned by the size of their sets (powers of two).

Each partition has a plan of its own (PLAN): a query is looked up by the `bands`
least hashes of its set, and a set at least as large that reaches THRESHOLD
holds `hits` of them with probability RECALL or more. A query therefore leaves
out its hits - 1 fullest buckets, and one whose shingles aren't found elsewhere
often enough is none at all: a passage that thousands of documents share fills
its own buckets only. Up to ALL shingles, all are bands, and nothing is missed.

Why least hashes and not rows of independent ones: containment THRESHOLD of a
query of q shingles in a set of u is the Jaccard similarity s = t / (1 + u/q -
t), and a banding of r rows needs log(1 - RECALL) / log(1 - s**r) bands. That
is 320 single rows at u = 64 q, and any r above 1 is out of reach from u = 4 q
on. So the index keeps, instead of one value a slot, every shingle of a set
that some query may have as a band; then a band is found with probability t
whatever the sizes, the Jaccard threshold of each pair of partitions is met by
one plan for each partition of queries, and far partitions cost as much as near ones.

All members of a bucket are compared. Small queries (up to ALL shingles) are
compared with patterns, the distinct parts that larger sets have of the small
queries' keys: documents that share a boilerplate sentence, and nothing else
that is in a small document, are one pattern. Others are compared set by set, in cells that large
groups are split into; copies are compared once, as their class.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import remove
from .common import U64, Hashed, Scratch, distinct, mix, opaque, picked, place, row_key, sized, table

SHINGLE = 5
THRESHOLD = 0.6
RECALL = 0.97
#: Least hashes that a query is looked up by, from a size on: the more there are, the more full buckets it leaves out, and
#: the larger its set, the fewer shingles of others are in the index for one of them. All of its shingles, if no more than ALL.
BANDS = {0: 16, 512: 24, 2048: 32}
ALL = 64
#: Bits of the filter of bands, for each document and at most; beyond the latter it only lets more shingles through to the index.
FILTER_BITS = 512
FILTER_MOST = 30
#: The same for each row of the filter of those whose words are compared; beyond FILTER_MOST more words are computed, and dropped by the join.
ROW_BITS = 16
#: Pairs compared in one cell, and shingles held in it; cells of more are split into a grid.
CELL = 20_000_000
CELL_WORDS = 2_000_000
#: Numbers in the matrix of a cell; an eighth of it is counted at once.
DENSE = 4_000_000
SIZES = 32


def jaccard(t: float, q: float, u: float) -> float:
    """The Jaccard threshold for a query of q shingles and a set of u."""
    return t / (1 + max(u, q) / q - t)


def chance(n: int, good: int, drawn: int, hits: int) -> float:
    """Of n shingles, `good` are in the other set: the probability that of `drawn` ones at least `hits` are."""
    total = math.comb(n, drawn)
    return sum(math.comb(good, k) * math.comb(n - good, drawn - k) for k in range(hits, min(good, drawn) + 1)) / total


def plan(p: int) -> tuple[int, int]:
    """(bands, hits) of the partition of sizes from 2**p to 2**(p+1) - 1: as many hits as keep RECALL for its least and its largest sets."""
    bands = hits = max(b for n, b in BANDS.items() if n <= 2**p)
    for n in (2**p, 2 ** (p + 1) - 1):
        n = min(n, 1 << 14)  # the same to four digits from here on
        if n > ALL:
            while chance(n, math.ceil(THRESHOLD * n), bands, hits) < RECALL:
                hits -= 1
    return bands, hits


PLAN = [plan(p) for p in range(SIZES)]


def needed(n: F.Column) -> F.Column:
    """The bands that a container has of a query of n shingles."""
    part = F.length(F.bin(n))
    return F.when(n <= ALL, F.ceil(n * THRESHOLD - 1e-9)).otherwise(F.element_at(F.array(*(F.lit(h) for _, h in PLAN)), part)).cast("int")


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted set of 48-bit shingle hashes."""
    return distinct(Hashed(text).runs(SHINGLE) >> U64(16))


def packed(s: np.ndarray) -> bytes:
    """Six bytes a shingle."""
    return s.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes()


def unpacked(*data: bytes) -> np.ndarray:
    x = np.frombuffer(b"".join(data), "<u2").reshape(-1, 3)
    out = np.zeros((len(x), 4), "<u2")
    out[:, :3] = x
    return out.view("<u8").ravel()


def set_key(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    whole = mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)
    return int(mix(np.array([whole + U64(len(s))]))[0].astype(np.int64)) if len(s) else 0


def bands(s: np.ndarray) -> int:
    """How many of a set's least hashes it is looked up by."""
    return len(s) if len(s) <= ALL else PLAN[len(s).bit_length() - 1][0]


def coded(s: np.ndarray) -> bytes:
    """Sorted distinct numbers of 32 bits: their last three bytes (two of long sets), and before them, in order, a bit for each, moved on by a place at each step of what is above."""
    width = 3 if len(s) < 8192 else 2
    steps = np.zeros(len(s) + (1 << (32 - 8 * width)), np.uint8)
    steps[(s >> np.uint32(8 * width)).astype(np.int64) + np.arange(len(s))] = 1
    return np.array([len(s)], "<u4").tobytes() + np.packbits(steps).tobytes() + s.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def decoded(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    width = 3 if n < 8192 else 2
    out = np.zeros((n, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8)[len(data) - n * width :].reshape(n, width)
    steps = np.unpackbits(np.frombuffer(data, np.uint8)[4 : len(data) - n * width])
    return out.view("<u4").ravel() | ((np.flatnonzero(steps) - np.arange(n)) << 8 * width).astype("<u4")


def _sets(docs: DataFrame, s: Scratch) -> DataFrame:
    """(doc_id, late, h, cid, n, low): of each row its set's key, size and bands; late puts negative ids and then null ones last. The sets themselves, as large as the texts, are written nowhere: who needs them makes them of the texts again."""
    rows = picked(docs, doc_id="long", text="string").withColumn("h", row_key())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                x = b.slice(i, 256)
                got = [shingle_set(t) for t in x["text"].to_pylist()]
                cols = [pa.array([set_key(g) for g in got], pa.int64()), pa.array([len(g) for g in got], pa.int32()), pa.array([packed(g[: bands(g)]) for g in got], pa.binary())]
                yield pa.RecordBatch.from_arrays([x["doc_id"], x["h"], *cols], ["doc_id", "h", "cid", "n", "low"])

    late = F.when(F.col("doc_id").isNull(), 2).when(F.col("doc_id") < 0, 1).otherwise(0)
    return s.table(rows.select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, cid long, n int, low binary").withColumn("late", late), "none")


def _filter(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], each: int) -> Broadcast:
    """A bit for two hashes of each key of any row: an array of `each` bits a row, at most 2**FILTER_MOST."""
    bits = min(FILTER_MOST, max(19, math.ceil(math.log2(max(1, rows.count()) * each))))
    block = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            at = distinct(np.concatenate(places(keys(b), bits)))
            if len(at):
                first = np.flatnonzero(np.r_[True, at[1:] >> 3 != at[:-1] >> 3])
                whole[at[first] >> 3] |= np.bitwise_or.reduceat(np.uint8(1) << (at & 7).astype(np.uint8), first)
        whole = whole.reshape(-1, block)
        for i in np.flatnonzero(whole.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sparse(whole[i])], pa.binary())], ["block", "bits"])

    def either(t: pa.Table) -> pa.Table:
        out = np.zeros(block, np.uint8)
        for x in t["bits"]:
            out |= dense(x.as_py(), block)
        return pa.table([t["block"].slice(0, 1).cast(pa.int32()), pa.array([sparse(out)], pa.binary())], names=["block", "bits"])

    parts = rows.mapInArrow(run, "block int, bits binary")
    # Of many, by sixty-fourths first, so that no task holds one block of all others.
    some = parts
    if rows.rdd.getNumPartitions() > 64:
        some = parts.groupBy("block", F.pmod(F.spark_partition_id(), F.lit(64))).applyInArrow(either, "block int, bits binary")
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in some.groupBy("block").applyInArrow(either, "block int, bits binary").collect():
        whole[r.block * block : (r.block + 1) * block] = dense(bytes(r.bits), block)
    return rows.sparkSession.sparkContext.broadcast((bits, whole))


def among(keys: np.ndarray, shared: tuple[int, np.ndarray]) -> np.ndarray:
    """Whether the filter has each key, or seems to."""
    bits, seen = shared
    p, q = places(keys, bits)
    return ((seen[p >> 3] >> (p & 7).astype(np.uint8)) & (seen[q >> 3] >> (q & 7).astype(np.uint8)) & 1).astype(bool)


def sparse(bits: np.ndarray) -> bytes:
    """A block of the filter: the gaps between its bits, of two bytes each, where that is shorter; else as it is."""
    gaps = np.diff(np.flatnonzero(np.unpackbits(bits, bitorder="little")), prepend=0)
    return gaps.astype("<u2").tobytes() if 2 * len(gaps) < len(bits) and gaps.max(initial=0) < 1 << 16 else bits.tobytes()


def dense(data: bytes, size: int) -> np.ndarray:
    if len(data) == size:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(8 * size, np.uint8)
    bits[np.cumsum(np.frombuffer(data, "<u2").astype(np.int64))] = 1
    return np.packbits(bits, bitorder="little")


def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + U64(1))
    return (h & U64((1 << bits) - 1)).astype(np.int64), (h >> U64(64 - bits)).astype(np.int64)


def _buckets(docs: DataFrame, sets: DataFrame, s: Scratch) -> DataFrame:
    """(key, cid, n, band, many, tiny): the members of buckets that more than one class is in, at least once each; band tells whether the member may be looked up there, tiny whether one of up to ALL shingles may."""
    shared = _filter(sets.select("low"), lambda b: unpacked(*b["low"].to_pylist()), FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                keys, cids, ns, band = [], [], [], []
                for t in b.slice(i, 256)["text"].to_pylist():
                    g = shingle_set(t)
                    cid = set_key(g)
                    if len(g) and cid not in done:
                        done.add(cid)
                        own, more = g[: bands(g)], g[bands(g) :]
                        more = more[among(more, shared.value)]
                        keys += [own, more]
                        m = len(own) + len(more)
                        cids.append(np.full(m, cid, np.int64))
                        ns.append(np.full(m, len(g), np.int32))
                        band.append(np.arange(m) < len(own))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cids)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(band))], ["key", "cid", "n", "band"])

    rows = picked(docs, text="string").mapInArrow(run, "key long, cid long, n int, band boolean")
    # All that is known of a bucket comes of the one exchange that brings its members together.
    own = Window.partitionBy("key")
    tiny = F.max(F.col("band") & (F.col("n") <= ALL)).over(own).alias("tiny")
    rows = rows.select("*", F.count("*").over(own).alias("many"), F.min("cid").over(own).alias("a"), F.max("cid").over(own).alias("b"), F.max("band").over(own).alias("any"), tiny)
    found = s.table(rows.filter("a <> b and any").drop("a", "b", "any"))
    shared.unpersist()
    return found


def _queries(buckets: DataFrame, s: Scratch) -> DataFrame:
    """(cid, n, keys): the queries, and the shared bands of each, those of the fullest buckets first."""
    bands = F.sort_array(F.collect_set(F.struct("many", "key")), asc=False)
    return s.table(buckets.filter("band").groupBy("cid", "n").agg(bands.alias("keys")).filter(F.size("keys") >= needed(F.col("n"))))


def _order(prefix: str = "") -> list[str]:
    return [prefix + c for c in ("late", "id", "h")]


def _small(queries: DataFrame, buckets: DataFrame, classes: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of queries of up to ALL shingles the containers (cid, parent, containment, m), and (cid, links) of all that is linked to them, compared by patterns: what a set has of all small queries' keys."""
    asked = s.table(queries.filter(F.col("n") <= ALL).select("cid", "n", F.col("keys.key").alias("keys"), needed(F.col("n")).alias("need")))
    words = asked.select(F.explode("keys").alias("key")).distinct()
    has = buckets.filter("tiny").select("cid", "n", "key").join(words, "key", "left_semi").groupBy("cid", "n").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    # Sizes beyond any query's count as one.
    has = has.withColumn("size", F.least("n", F.lit(ALL + 1))).withColumn("pattern", F.xxhash64("keys", "size"))
    member = s.table(has.join(classes.select("cid", *_order()), "cid"))
    lead = F.min(F.struct((-F.col("n")).alias("less"), *_order(), "cid"))
    kinds = s.table(member.groupBy("pattern", "size").agg(F.first("keys").alias("keys"), F.count("*").alias("members"), lead.alias("lead")))
    # As with larger queries, the need - 1 fullest buckets are left out; what is met in the others is counted over all keys.
    keys = s.table(asked.select("cid", "n", F.explode(F.slice("keys", F.col("need"), F.lit(ALL))).alias("key")))
    own = member.select("cid", F.col("pattern").alias("own"), *_order())
    mine = asked.select("cid", F.col("keys").alias("words")).join(own, "cid")
    held = kinds.select(F.col("pattern").alias("x"), "members", (-F.col("lead.less")).alias("m"), F.col("lead.cid").alias("parent"), *(F.col(f"lead.{c}").alias(c) for c in _order()), F.col("keys").alias("words"))
    met = _met(keys, kinds.select(F.col("pattern").alias("x"), F.col("size").alias("xn"), F.explode("keys").alias("key")), s, mine, held)
    below = met.filter("held").groupBy(F.col("cid").alias("pattern")).agg(F.sum("links").alias("links"))
    links = met.filter("not held").select("cid", "links").unionByName(member.select("cid", "pattern").join(below, "pattern").select("cid", "links"))
    return _chosen(met.filter("not held")), links


def _looked_up(queries: DataFrame, s: Scratch) -> DataFrame:
    """(cid, n, key): queries with their buckets but for the hits - 1 fullest."""
    return s.table(queries.select("cid", "n", F.explode(F.slice("keys", needed(F.col("n")), F.lit(max(ALL, *BANDS.values())))).alias("k")).select("cid", "n", "k.key"))


def _words(some: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, words): of the classes that have the rows `some` (h), and perhaps of a few others: 32 bits of each shingle, coded; two sets of n agree by chance in n * n / 2**32."""
    shared = _filter(some, lambda b: b["h"].to_numpy().view(U64), ROW_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                x = b.slice(i, 256)
                x = x.filter(pa.array(among(x["h"].to_numpy().view(U64), shared.value)))
                got = [shingle_set(t) for t in x["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(g) for g in got], pa.int64()), pa.array([coded(distinct(g.astype("<u4"))) for g in got], pa.binary())], ["cid", "words"])

    rows = picked(docs, doc_id="long", text="string").withColumn("h", row_key())
    return rows.select("h", "text").mapInArrow(run, "cid long, words binary")


class Held:
    """Sets of a cell, by their words: those in many sets as columns of a matrix, the others with lists of their sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(self.n), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        flat, self.owner = flat[order], owner[order]
        self.start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
        self.words = flat[self.start]
        self.times = np.diff(np.r_[self.start, len(flat)])
        often = np.flatnonzero(self.times * 16 >= self.n)
        often = often[np.argsort(-self.times[often], kind="stable")[: max(1, DENSE // self.n)]]
        self.column = np.full(len(self.words), -1, np.int64)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.n), np.float32)
        column = np.repeat(self.column, self.times)
        self.matrix[column[column >= 0], self.owner[column >= 0]] = 1

    def common(self, sets: list[np.ndarray]) -> np.ndarray:
        """Of each given set, how many words it has in common with each one held."""
        flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(self.words, flat)
        at[at == len(self.words)] = 0
        hit = self.words[at] == flat
        at, who = at[hit], who[hit]
        column = self.column[at]
        some = column >= 0
        asked = np.zeros((len(sets), len(self.matrix)), np.float32)
        asked[who[some], column[some]] = 1
        out = np.rint(asked @ self.matrix).astype(np.int64)
        at, who = at[~some], who[~some]
        done = np.cumsum(self.times[at])
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + DENSE // 8, side="right")))
            many = self.times[at[a:b]]
            place = np.arange(many.sum()) + np.repeat(self.start[at[a:b]] - (np.cumsum(many) - many), many)
            out += np.bincount(np.repeat(who[a:b], many) * self.n + self.owner[place], minlength=out.size).reshape(out.shape)
            a = b
        return out


#: What _met tells of each query and of each set compared with it: its links, and of its best container common, m, and so on.
MET = "held boolean, cid long, n int, links long, common long, m int, late int, id long, h long, parent long, tie long"


def _met(asked: DataFrame, members: DataFrame, s: Scratch, mine: DataFrame | None = None, held: DataFrame | None = None, known: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """MET: asked (cid, n, key) compared with the members (x, xn, key) of its buckets that are at least as large.

    Each member lives in one cell, named by the bucket of its own that most
    queries look up, so that near copies share a few cells however many they
    are. A query goes to the cells of all its buckets' members and is compared
    with all that live there; only sums and the best of each leave a cell, never
    a pair. One that asks where it lives finds its words there, and takes none along. mine (cid, own, order, words) and held (x, members, m, parent, order,
    words) tell what is compared; of own itself one member doesn't count. Where
    both sides are sets, `known` gives (cid, m, order, words) of those (cid) that go anywhere,
    and their words are exchanged once for either side. Two
    sets of one size may ask for each other: if both do, or neither is a set, each
    counts what it finds; else the one that asks counts for the other too.
    """
    both = known is None
    wanted = asked.groupBy("key").agg(F.count("*").alias("asks"), F.min("n").alias("least"))
    homes = members.join(wanted, "key").filter("xn >= least").groupBy("x", "xn").agg(F.sort_array(F.collect_set(F.struct("asks", "key")), asc=False).alias("keys"))
    homes = s.table(homes.select("x", "xn", F.col("keys")[0].key.alias("cell"), F.col("keys.key").alias("keys")))
    via = homes.select("x", "xn", "cell", F.explode("keys").alias("key")).groupBy("key", "cell").agg(F.max("xn").alias("top"), F.min("x").alias("a"), F.max("x").alias("b"))
    alone = (F.col("a") == F.col("cid")) & (F.col("b") == F.col("cid"))
    routes = s.table(asked.join(via, "key").filter((F.col("top") >= F.col("n")) & ~alone).select("cid", "n", "cell").distinct())
    space = homes.groupBy("cell").agg(F.sum(F.greatest("xn", F.size("keys"))).alias("words"), F.count("*").alias("many"))
    kx = F.ceil(F.col("words") / CELL_WORDS)
    wide = routes.groupBy("cell").agg(F.count("*").alias("asks")).join(space, "cell").select("cell", kx.alias("kx"), F.ceil(F.col("many") * F.col("asks") / (kx * CELL)).alias("kq"))
    wide = s.table(wide)
    split = wide.filter("kx > 1 or kq > 1")
    some = sized(s.table(split), 24)
    part = lambda c, k: F.pmod(F.xxhash64(c), F.col(k))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    spread = lambda df: df.join(some, "cell", "left").fillna(1, ["kx", "kq"])
    live = spread(homes.select("x", "xn", "cell").join(wide.select("cell"), "cell", "left_semi")).select("x", "xn", "cell", part("x", "kx").alias("px"), "kx", each("kq").alias("pq"))
    go = spread(routes).select("cid", "n", "cell", part("cid", "kq").alias("pq"), "kx", each("kx").alias("px"))
    sub = (F.col("pq") * F.col("kx") + F.col("px")).alias("sub")
    void = lambda kind, name: F.lit(None).cast(kind).alias(name)
    live = live.select(F.col("x").alias("cid"), F.col("xn").alias("n"), "cell", sub, F.lit(False).alias("asks"), void("long", "home"), F.lit(False).alias("here"))
    if both:
        live = live.join(held.withColumnRenamed("x", "cid"), "cid").withColumn("routes", void("array<long>", "routes"))
        go = go.select("cid", "n", "cell", sub, F.lit(True).alias("asks"), void("long", "home"), F.lit(False).alias("here"), void("array<long>", "routes"), void("long", "members"), void("int", "m"))
        stream = live.unionByName(go.join(mine.withColumnRenamed("own", "parent"), "cid"))
    else:
        live = live.join(routes.groupBy("cid").agg(F.collect_list("cell").alias("routes")), "cid", "left")
        go = go.join(homes.select(F.col("x").alias("cid"), F.col("cell").alias("home")), "cid")
        here = (F.col("cell") == F.col("home")) & (F.col("px") == part("cid", "kx"))
        go = go.select("cid", "n", "cell", sub, F.lit(True).alias("asks"), "home", F.coalesce(here, F.lit(False)).alias("here"), void("array<long>", "routes"))
        ways = s.table(live.unionByName(go))
        stream = ways.join(known(ways.select("cid")), "cid").withColumn("members", F.lit(1).cast("long")).withColumn("parent", F.col("cid"))
    stream = stream.select("cell", "sub", "asks", "cid", "n", "members", "m", "parent", *_order(), F.when(~F.col("here"), F.col("words")).alias("words"), "routes", "home")
    stream = stream.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, rows = None, Cell(both), []
        for b in batches:
            for i in range(0, b.num_rows, 128):
                x = b.slice(i, 128)
                for row in zip(*(c.to_pylist() for c in x.columns)):
                    if now != row[:2]:
                        rows += cell.ask() + cell.end()
                        now, cell = row[:2], Cell(both)
                    rows += cell.add(row[2], row[3:])
                if len(rows) >= 1000:
                    yield table_of(rows)
                    rows = []
        yield table_of(rows + cell.ask() + cell.end())

    return s.table(stream.mapInArrow(run, MET))


def table_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64()}
    fields = [f.split() for f in MET.split(", ")]
    cols = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


class Cell:
    """Rows of one cell, first the sets that live there and then those that ask for them, a block at a time."""

    def __init__(self, both: bool):
        self.both = both
        self.live: list[tuple] = []
        self.asking: list[tuple] = []
        self.held: Held | None = None
        self.words: dict[int, np.ndarray] = {}
        self.size = 0

    def add(self, asks: bool, row: tuple) -> list[tuple]:
        words = decoded(row[8]) if isinstance(row[8], bytes) else self.words[row[0]] if row[8] is None else np.array(row[8], np.int64)
        row = (*row[:8], words, *row[9:])
        if not asks:
            self.words[row[0]] = words
            self.live.append(row)
            return []
        self.asking.append(row)
        self.size += len(words)
        return self.ask() if self.size >= CELL_WORDS // 8 or len(self.asking) * len(self.live) >= DENSE // 8 else []

    def start(self) -> None:
        cid, self.n, self.members, self.m, parent, late, ids, h, words, routes, _ = zip(*self.live)
        self.held = Held(words)
        self.live = []
        self.cid, self.parent = np.array(cid, np.int64), np.array(parent, np.int64)
        self.n, self.members, self.m = (np.array(x, np.int64) for x in (self.n, self.members, self.m))
        self.order = places_of(late, ids, h)
        self.routes = [set(r or ()) for r in routes]
        self.homes: dict[int, np.ndarray] = {}
        # Of containers with as many common words the largest, then the earliest, then the greatest number is best.
        self.rank = np.empty(len(cid), np.int64)
        self.rank[np.lexsort((self.cid, *(~x for x in self.order[1::-1]), self.m))] = np.arange(len(cid))
        self.links = np.zeros(len(cid), np.int64)
        self.best: dict[int, tuple] = {}

    def mutual(self, home: int) -> np.ndarray:
        """Of each set here, whether it asks in the given cell."""
        if home not in self.homes:
            self.homes[home] = np.fromiter((home in r for r in self.routes), bool, len(self.routes))
        return self.homes[home]

    def ask(self) -> list[tuple]:
        asking, self.asking, self.size = self.asking, [], 0
        if not asking or not (self.held or self.live):
            return []
        if self.held is None:
            self.start()
        cid, n, _, _, own, late, ids, h, words, _, home = zip(*asking)
        cid, n, own = (np.array(x, np.int64) for x in (cid, n, own))
        order = places_of(late, ids, h)
        common = self.held.common(words)
        need = np.ceil(n * THRESHOLD - 1e-9)
        others = self.members - (own[:, None] == self.cid)
        ok = (common >= need[:, None]) & (self.n >= n[:, None]) & (others > 0)
        equal = ok & (self.n == n[:, None])
        i, j = np.nonzero(equal)
        before = np.zeros(len(i), bool)  # the one that lives here is the earlier one
        same = np.ones(len(i), bool)
        for x, y in zip((x[j] for x in self.order), (y[i] for y in order)):
            before |= same & (x < y)
            same &= x == y
        up = ok.copy()
        up[i, j] = before
        links = (others * ok).sum(axis=1)
        given = ok & ~equal
        if not self.both:
            one = ~np.array([self.mutual(c) for c in home])[i, j] if len(i) else before
            given[i, j] = one
            for y, x in sorted(zip(i[one & ~before].tolist(), j[one & ~before].tolist())):
                self.better(x, (int(common[y, x]), int(n[y]), -late[y], ~order[1][y], int(cid[y]), late[y], ids[y], h[y], int(cid[y])))
        self.links += given.sum(axis=0)
        key = np.where(up, common * (len(self.cid) + 1) + self.rank, -1)
        top = key.argmax(axis=1)
        out = []
        for y in np.flatnonzero(links).tolist():
            x = top[y]
            found = (int(common[y, x]), int(self.m[x]), *self.place(x), int(self.parent[x]), int(self.cid[x])) if key[y, x] >= 0 else (None,) * 7
            out.append((False, int(cid[y]), int(n[y]), int(links[y]), *found))
        return out

    def place(self, x: int) -> tuple:
        late, i, h = (int(c[x]) for c in self.order)
        return late, None if late == 2 else i, h

    def better(self, x: int, found: tuple) -> None:
        if x not in self.best or self.best[x][:5] < found[:5]:
            self.best[x] = found

    def end(self) -> list[tuple]:
        if self.held is None:
            return []
        out = []
        for x in np.flatnonzero(self.links).tolist():
            common, m, _, _, tie, late, i, h, parent = self.best.get(x, (None,) * 9)
            out.append((True, int(self.cid[x]), int(self.n[x]), int(self.links[x]), common, m, late, i, h, parent, tie))
        return out


def places_of(late: tuple, ids: tuple, h: tuple) -> tuple[np.ndarray, ...]:
    """(late, id, h) as numbers, of which the least comes first; a null id is the only one with late 2."""
    return np.array(late, np.int64), np.array([i or 0 for i in ids], np.int64), np.array(h, np.int64)


def _chosen(met: DataFrame) -> DataFrame:
    """(cid, parent, containment, m): the container with the most in common, then the largest, the earliest."""
    best = F.max_by(F.struct("parent", (F.col("common") / F.col("n")).alias("containment"), "m"), F.struct("common", "m", (-F.col("late")).alias("l"), F.bitwise_not("id").alias("i"), "tie"))
    return met.filter("parent is not null").groupBy("cid").agg(best.alias("b")).select("cid", "b.*")


def _large(queries: DataFrame, buckets: DataFrame, docs: DataFrame, classes: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame]:
    """As _small, of queries of more than ALL shingles, compared set by set."""
    asked = _looked_up(queries.filter(F.col("n") > ALL), s)
    members = buckets.filter(F.col("n") > ALL).select(F.col("cid").alias("x"), F.col("n").alias("xn"), "key")

    def known(ids: DataFrame) -> DataFrame:
        some = s.table(classes.join(ids, "cid", "left_semi").select("cid", F.col("n").alias("m"), *_order()))
        return some.join(_words(some.select("h"), docs), "cid").dropDuplicates(["cid"])

    met = _met(asked, members, s, known=known)
    return _chosen(met), met.select("cid", "links")


def _roots(forest: DataFrame, s: Scratch) -> DataFrame:
    """(cid, parent, containment, root): follows the parents to the top by pointer doubling; each step goes to a larger set, or one of an earlier document."""
    now = forest.withColumn("root", F.col("parent"))
    while True:
        up = now.select(F.col("cid").alias("root"), F.col("root").alias("up"))
        step = s.table(now.join(up, "root", "left").select("cid", "parent", "containment", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def _search(docs: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, classes, forest, links): (doc_id, late, h, cid, n) of each row, one class for each distinct set, the container chosen for each redundant class, and counts of linked classes to be summed by cid."""
    sets = _sets(docs, s)
    bare = f"{s.at}/{s.n}"
    heads = s.table(sets.select("doc_id", "late", "h", "cid", "n"))
    first = F.min(F.struct("late", F.col("doc_id").alias("id"), "h"))
    classes = s.table(heads.filter("n > 0").groupBy("cid").agg(first.alias("first"), F.first("n").alias("n"), (F.min("h") < F.max("h")).alias("copied")).select("cid", "n", "copied", "first.*"))
    buckets = _buckets(docs, sets, s)
    remove(s.spark, bare)  # nobody reads the bands any more
    queries = _queries(buckets, s)
    none = [s.spark.createDataFrame([], x) for x in ("cid long, parent long, containment double, m int", "cid long, links long")]
    least, most = queries.agg(F.min("n"), F.max("n")).first()
    small, few = _small(queries, buckets, classes, s) if least and least <= ALL else none
    large, many = _large(queries, buckets, docs, classes, s) if most and most > ALL else none
    forest = small.unionByName(large).drop("m")
    return heads, classes, s.table(forest), few.unionByName(many)


def groups(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, kept_id, container_id, containment, n_links): each redundant document, the document of its group that stays, the one chosen of those that contain it, and how many different sets are linked to its own, as containers or contained.

    Every link has a redundant end, so none is without a row. Documents without
    a word (null or empty text too) are in no group. Rows with the same doc_id
    and text are one document; a doc_id with two texts is two documents. Of
    equal sets the least doc_id stays, negative ones after others and null ones
    last; of linked sets of one size too. Of several containers the one with the
    most in common is named, of equal ones the largest. Other columns are
    ignored; an empty table gives no rows. docs is read several times, and must
    have the same rows each time.
    """
    with Scratch(docs.sparkSession) as s:
        heads, classes, forest, links = _search(docs, s)
        roots = _roots(forest, s)
        counts = links.groupBy("cid").agg(F.sum("links").alias("n_links"))
        name = lambda c: classes.select(F.col("cid").alias(c), F.col("id").alias(f"{c}_id"))
        known = classes.join(roots, "cid", "left").filter("copied or root is not null").join(counts, "cid", "left")
        known = known.join(name("parent"), "parent", "left").join(name("root"), "root", "left")
        known = s.table(known.select("cid", "id", F.col("h").alias("first"), F.col("parent_id"), F.col("root").isNotNull().alias("below"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("root_id")).alias("kept_id"), "containment", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
        rows = heads.filter("n > 0").select("doc_id", "h", "cid").distinct().join(known, "cid")
        own = F.col("h") == F.col("first")
        rows = rows.filter(~own | F.col("below"))
        return s.result(rows.select("doc_id", "kept_id", F.when(own, F.col("parent_id")).otherwise(F.col("id")).alias("container_id"), F.when(own, F.col("containment")).otherwise(F.lit(1.0)).alias("containment"), "n_links"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: redundant documents go, so that one of each group stays; documents without a word stay.

    Of rows repeated with the same doc_id and text one stays, any of them where
    other columns differ. Null ids and texts are as in groups. docs' own
    columns, whatever their names; an empty table stays empty.
    """
    with Scratch(spark) as s:
        heads, classes, forest, _ = _search(docs, s)
        copies = heads.filter("n > 0").select("cid", "h", F.col("doc_id").alias("id")).join(classes.filter("copied").select("cid", F.col("h").alias("first")), "cid").filter("h <> first").select("id", "h")
        below = forest.join(classes, "cid").select("id", "h")
        gone = s.result(copies.unionByName(below).distinct())
        twice = s.result(heads.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1").select("h"))
    names = docs.columns
    at = [F.col(f"c{place(names, c)}") for c in ("doc_id", "text")]
    rows = opaque(docs).withColumn("h", F.xxhash64(at[0].cast("long"), F.coalesce(at[1].cast("string"), F.lit(""))))
    small = sized(gone.withColumnRenamed("h", "g"), 24)
    kept = rows.join(small, (rows["h"] == small["g"]) & at[0].cast("long").eqNullSafe(small["id"]), "left_anti")
    if not twice.isEmpty():
        kept = kept.join(sized(twice), "h", "left_anti").unionByName(kept.join(sized(twice), "h", "left_semi").dropDuplicates(["h", f"c{place(names, 'doc_id')}"]))
    return kept.drop("h").toDF(*names)


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op1_near_dup": op1_near_dup}
SQL: dict[str, str] = {}
