"""Passages of LENGTH words or more that occur more than once, found in two ways.

Both start from winnowed anchors: of every window of LENGTH words the run of
GRAM words with the least hash. Equal windows pick equal anchors at equal
offsets, so only anchors found twice (not counting whole copies of a text) can
lie in a repeat, and each window need be looked at only beside the anchor it
picks. Nothing shorter than LENGTH is reported, nothing longer missed.

Suffix arrays (op 2): the suffixes that begin at such anchors are sorted in
runs, front-coded, exchanged by ranges of their first GRAM words, and merged by
a loser tree that carries common-prefix lengths. In the merged order two
suffixes share w words if and only if all prefix lengths between them are at
least w; with the words left of the anchors that settles every window.

Seed and extend (op 6): occurrences are joined on anchors, each is matched with
the earliest, overlapping matches on one diagonal are made one, and each of
these is extended over both texts to the first word that differs.

The earliest occurrence of each window, by doc_id and place, is the original;
all others are repeats of it. So a passage found in a million documents gives
a million rows, not their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, Hashed, Scratch, keep_ids, mix, opaque, picked, place, row_key, sized, table, word_spans

LENGTH = 50
GRAM = 12
#: Runs of GRAM words in a window: an anchor lies at most so many words less one after its start.
SPAN = LENGTH - GRAM + 1
RUN = 40_000
#: Occurrences in a range of keys, on average: a range is merged in memory, one at a time.
RANGE = 8_000
#: Anchors of more occurrences are settled window by window, with the same result.
HOT = 20_000
NULL_LAST = 2**63 - 1
#: Parts that share the matches against one text.
SALT = 16


def anchors(h: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors' places and hashes, and the least and greatest offset of the windows that pick them."""
    if h.n < LENGTH:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, U64), z, z
    g = h.runs(GRAM)
    picks = np.empty(h.n - LENGTH + 1, np.int64)
    for i in range(0, len(picks), 8192):
        block = np.lib.stride_tricks.sliding_window_view(g[i : i + 8192 + SPAN - 1], SPAN)[: len(picks) - i]
        picks[i : i + len(block)] = np.argmin(block, axis=1)
    picks += np.arange(len(picks))
    first = np.flatnonzero(np.r_[True, picks[1:] != picks[:-1]])
    last = np.r_[first[1:], len(picks)] - 1
    at = picks[first]
    return at, g[at], at - last, at - first


def _order() -> F.Column:
    return F.struct(F.coalesce("doc_id", F.lit(NULL_LAST)).alias("o"), "uid")


def _rows(docs: DataFrame) -> DataFrame:
    return picked(docs, doc_id="long", text="string").withColumn("uid", row_key())


def _repeated(rows: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Whole copies (uid, doc_id, n, first); of each other document its repeated anchors (uid, keys, hot), those of more than HOT occurrences apart; and how many occurrences the others have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                x = b.slice(i, 256)
                ns, keys, times = [], [], []
                for text in x["text"].to_pylist():
                    h = Hashed(text)
                    k, n = np.unique(anchors(h)[1], return_counts=True)
                    ns.append(h.n)
                    keys.append(k)
                    times.append(n)
                ends = pa.array(np.r_[0, np.cumsum([len(k) for k in keys])], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c).view(np.int64))) for c in (keys, times)]
                yield pa.RecordBatch.from_arrays([x["uid"], x["doc_id"], x["same"], pa.array(ns, pa.int32()), *lists], ["uid", "doc_id", "same", "n", "keys", "times"])

    texts = rows.select("uid", "doc_id", F.xxhash64("text").alias("same"), "text")
    found = s.table(texts.mapInArrow(run, "uid long, doc_id long, same long, n int, keys array<long>, times array<long>").filter(F.col("n") >= LENGTH))
    heads = found.groupBy("same").agg(F.min(_order()).alias("first"), F.max(_order()).alias("last")).filter("first <> last").select("same", "first")
    copies = s.table(found.select("uid", "doc_id", "same", "n").join(heads, "same").filter("first.uid <> uid").select("uid", "doc_id", "n", "first").dropDuplicates(["uid"]))
    # From here on of each group of copies only the first counts, once.
    own = found.join(copies.select("uid"), "uid", "left_anti").select("uid", F.explode(F.arrays_zip("keys", "times")).alias("a")).select("uid", F.col("a.keys").alias("key"), F.col("a.times").alias("times"))
    total = F.sum("times")
    twice = s.table(own.groupBy("key").agg((F.min("uid") < F.max("uid")).alias("apart"), F.max("times").alias("most"), total.alias("total")).filter("apart or most > 1").select("key", "total"))
    mine = own.join(sized(twice), "key").groupBy("uid").agg(F.collect_set(F.when(F.col("total") <= HOT, F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("total") > HOT, F.col("key"))).alias("hot"))
    count = twice.filter(F.col("total") <= HOT).agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    return copies, s.table(mine), count


def _texts(rows: DataFrame, lists: DataFrame) -> DataFrame:
    return keep_ids(rows, "uid", lists.select("uid")).dropDuplicates(["uid"]).join(lists, "uid")


def _hot_matches(texts: DataFrame, s: Scratch) -> DataFrame:
    """The windows at anchors of more than HOT occurrences, each with the earliest equal one: a least value for each window, combined before it is exchanged, so that no task holds all occurrences of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                x = b.slice(i, 64)
                out = [np.zeros((4, 0), np.int64)]
                for uid, doc_id, text, hot in zip(*(x[c].to_pylist() for c in ("uid", "doc_id", "text", "hot"))):
                    h = Hashed(text)
                    at, key, low, high = anchors(h)
                    ok = np.isin(key, np.array(hot, np.int64).view(U64))
                    at, key, low, many = at[ok], key[ok], low[ok], (high - low + 1)[ok]
                    start = np.repeat(at - low, many) - (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                    whole = h.runs(LENGTH)[start]
                    out.append(np.stack([np.repeat(key, many).view(np.int64), whole.view(np.int64), np.full(len(start), uid), start]))
                rows = np.concatenate(out, axis=1)
                ids = dict(zip(x["uid"].to_pylist(), x["doc_id"].to_pylist()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows), pa.array([ids[u] for u in rows[2].tolist()], pa.int64())], ["key", "window", "uid", "start", "doc_id"])

    windows = s.table(texts.filter(F.size("hot") > 0).select("uid", "doc_id", "text", "hot").mapInArrow(run, "key long, window long, uid long, start long, doc_id long"))
    place = F.struct(F.coalesce("doc_id", F.lit(NULL_LAST)).alias("o"), "uid", "start")
    heads = s.table(windows.groupBy("key", "window").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("key", "window", "first"))
    dup = windows.join(sized(heads, 48), ["key", "window"]).filter(place != F.col("first"))
    first_id = F.when(F.col("first.o") < NULL_LAST, F.col("first.o"))
    return dup.select("uid", "doc_id", "start", (F.col("start") + LENGTH).alias("end"), F.col("first.uid").alias("first_uid"), first_id.alias("first_id"), F.col("first.start").alias("first_start"))


class Seeds:
    """Anchor occurrences with the words beside them, as columns."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, uid: int, doc_id: int | None, text: str, keys: list[int]) -> None:
        h = Hashed(text)
        at, key, low, high = anchors(h)
        ok = np.isin(key, np.array(keys, np.int64).view(U64))
        at, key, low, high = at[ok], key[ok], low[ok], high[ok]
        if not len(at):
            return
        # A blank border lets every occurrence take as many words.
        words = np.zeros(h.n + 2 * LENGTH, np.uint32)
        words[LENGTH:-LENGTH] = h.runs(1).astype(np.uint32)
        left = words[(at + LENGTH)[:, None] - np.arange(1, SPAN)]
        right = words[(at + LENGTH)[:, None] + np.arange(GRAM, LENGTH)]
        m = len(at)
        self.parts.append((key, np.full(m, uid), np.full(m, NULL_LAST if doc_id is None else doc_id), at, low, high, left, right))
        self.n += m

    def columns(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(c) for c in zip(*self.parts))


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(uid, doc_id, text, keys) of each row; 128 rows at a time are Python objects, not a whole batch of texts."""
    for b in batches:
        for i in range(0, b.num_rows, 128):
            x = b.slice(i, 128)
            yield from zip(*(x[c].to_pylist() for c in ("uid", "doc_id", "text", "keys")))


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)


# -- suffix runs

#: Word numbers of a suffix: the anchor's hash counts as two, then one for each word after it.
HEAD = 2


def suffix_bytes(key: np.ndarray, right: np.ndarray, low: np.ndarray) -> list[bytes]:
    """Suffixes as byte strings in big-endian order, each as long as its longest window needs."""
    whole = np.empty((len(key), HEAD + LENGTH - GRAM), ">u4")
    whole[:, 0] = key >> U64(32)
    whole[:, 1] = key & U64(0xFFFFFFFF)
    whole[:, HEAD:] = right
    data, width = whole.tobytes(), whole.shape[1] * 4
    ends = (HEAD + LENGTH - GRAM - low) * 4
    return [data[i * width : i * width + e] for i, e in enumerate(ends.tolist())]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Word numbers that a and b share, given that the first `known` are equal; a shared half of the anchor's hash counts as none."""
    if not known:
        if a[:8] != b[:8]:
            return 0
        known = HEAD
    m = min(len(a), len(b))
    x = int.from_bytes(a[known * 4 : m], "big") ^ int.from_bytes(b[known * 4 : m], "big")
    return m // 4 if not x else known + ((m - known * 4) * 8 - x.bit_length()) // 32


def front_code(run: list[bytes]) -> tuple[bytes, bytes]:
    """Shared lengths with the suffix before, one byte each, and what follows them, each with its length in a byte."""
    shared, rest, before = bytearray(), bytearray(), b""
    for x in run:
        c = common(before, x) if before else 0
        shared.append(c)
        rest.append(len(x) // 4 - c)
        rest += x[c * 4 :]
        before = x
    return bytes(shared), bytes(rest)


def front_decode(shared: bytes, rest: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for c in shared:
        n = rest[at] * 4
        before = before[: c * 4] + rest[at + 1 : at + 1 + n]
        out.append(before)
        at += 1 + n
    return out


def loser_merge(runs: list[tuple[list[bytes], bytes]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs given with their common-prefix lengths: (run, place) in order, and the lengths each shares with the one before.

    Of two contenders, both known to share so much with the last winner, the
    one that shares more comes first; only if they share equally are words
    compared, from there on. The loser keeps what it shares with the winner.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
    places = [0] * size
    shares = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        c = common(x, y, shares[a])
        if (x[c * 4 :], a) < (y[c * 4 :], b):
            shares[b] = c
            return a, b
        shares[a] = c
        return b, a

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for i in range(size - 1, 0, -1):
        winners[i], losers[i] = play(winners[2 * i], winners[2 * i + 1])
    top = winners[1] if size > 1 else 0
    order: list[tuple[int, int]] = []
    lcps: list[int] = []
    while heads[top] is not None:
        order.append((top, places[top]))
        lcps.append(shares[top])
        run, lengths = runs[top]
        places[top] += 1
        k = places[top]
        if k < len(run):
            heads[top], shares[top] = run[k], lengths[k]
        else:
            heads[top] = None
        node = (size + top) >> 1
        while node:
            top, losers[node] = play(top, losers[node])
            node >>= 1
    return order, lcps


def left_hashes(left: np.ndarray) -> np.ndarray:
    """Of each occurrence, hashes of the 0, 1, 2 ... words before it."""
    out = np.zeros((len(left), SPAN), U64)
    for j in range(1, SPAN):
        out[:, j] = mix(out[:, j - 1] * U64(0x9E3779B97F4A7C15) + left[:, j - 1] + U64(1))
    return out


def firsts(groups: np.ndarray, sides: np.ndarray, o: np.ndarray, uid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each occurrence, the earliest with the same group and side."""
    order = np.lexsort((at, uid, o, sides, groups))
    g, x = groups[order], sides[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.empty(len(order), np.int64)
    out[order] = lead
    return out


def duplicates(match: list[np.ndarray], key: np.ndarray, o: np.ndarray, uid: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, its earliest equal, offset) for every window that isn't the earliest of its kind.

    match has, for each offset, labels of the occurrences that are equal if and
    only if the words from the anchor to the window's end are.
    """
    sides = left_hashes(left)
    out = []
    for off in range(SPAN):
        some = np.flatnonzero((low <= off) & (off <= high))
        if len(some) > 1:
            lead = some[firsts(match[off][some], sides[some, off], o[some], uid[some], at[some])]
            dup = lead != some
            out.append((some[dup], lead[dup], np.full(int(dup.sum()), off)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


FOUND = "uid long, doc_id long, start long, end long, first_uid long, first_id long, first_start long"


def _found(uid: np.ndarray, o: np.ndarray, start: np.ndarray, end: np.ndarray, first_uid: np.ndarray, first_o: np.ndarray, first_start: np.ndarray) -> pa.Table:
    """Overlapping or touching matches on one diagonal made one."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    if len(uid):
        order = np.lexsort((start, start - first_start, first_uid, uid))
        uid, o, start, end, first_uid, first_o, first_start = (x[order] for x in (uid, o, start, end, first_uid, first_o, first_start))
        group = np.r_[True, (uid[1:] != uid[:-1]) | (first_uid[1:] != first_uid[:-1]) | (start[1:] - first_start[1:] != start[:-1] - first_start[:-1])]
        gid = np.cumsum(group)
        # Groups are laid one after the other, so that one running maximum serves all.
        wide = int(end.max()) + 1
        reach = np.maximum.accumulate(end + gid * wide) - gid * wide
        new = group | np.r_[True, start[1:] > reach[:-1]]
        lead = np.flatnonzero(new)
        end = np.maximum.reduceat(end, lead)
        uid, o, start, first_uid, first_o, first_start = (x[lead] for x in (uid, o, start, first_uid, first_o, first_start))
    null = lambda x: pa.array(x, pa.int64(), mask=x == NULL_LAST)
    return pa.table([pa.array(uid, pa.int64()), null(o), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(first_uid, pa.int64()), null(first_o), pa.array(first_start, pa.int64())], names=names)


def _suffix_matches(texts: DataFrame, count: int) -> DataFrame:
    parts = 1 + count // RANGE

    def send(seeds: Seeds) -> Iterator[pa.RecordBatch]:
        key, uid, o, at, low, high, left, right = seeds.columns()
        suffixes = suffix_bytes(key, right, low)
        order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__))
        part = _part(key[order], parts)
        edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
        for a, b in zip(edges, edges[1:]):
            x = order[a:b]
            shared, rest = front_code([suffixes[i] for i in x])
            near = b"".join(left[i, : high[i]].tobytes() for i in x)
            meta = np.stack([uid[x], o[x], at[x]], 1).tobytes()
            sides = np.stack([low[x], high[x]], 1).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), *(pa.array([v], pa.binary()) for v in (shared, rest, meta, sides, near))], ["part", "shared", "rest", "meta", "sides", "near"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds()
        for row in text_rows(batches):
            seeds.add(*row)
            if seeds.n >= RUN:
                yield from send(seeds)
                seeds = Seeds()
        if seeds.n:
            yield from send(seeds)

    def merge(t: pa.Table) -> pa.Table:
        got, metas, offs, lefts = [], [], [], []
        for shared, rest, meta, sides, near in zip(*(t[c].to_pylist() for c in ("shared", "rest", "meta", "sides", "near"))):
            got.append((front_decode(shared, rest), shared))
            metas.append(np.frombuffer(meta, np.int64).reshape(-1, 3))
            side = np.frombuffer(sides, np.uint8).reshape(-1, 2).astype(np.int64)
            offs.append(side)
            left = np.zeros((len(side), SPAN - 1), np.uint32)
            left[np.arange(SPAN - 1) < side[:, 1:]] = np.frombuffer(near, np.uint32)
            lefts.append(left)
        starts = np.r_[0, np.cumsum([len(m) for m in metas])]
        order, lcps = loser_merge(got)
        pick = np.array([starts[r] + i for r, i in order])
        meta, off, left = np.concatenate(metas)[pick], np.concatenate(offs)[pick], np.concatenate(lefts)[pick]
        lcp = np.array(lcps)
        words = np.where(lcp >= HEAD, lcp - HEAD + GRAM, 0)
        match = [np.cumsum(words < LENGTH - x) for x in range(SPAN)]
        uid, o, at = meta.T
        i, j, x = duplicates(match, lcp, o, uid, at, off[:, 0], off[:, 1], left)
        return _found(uid[i], o[i], at[i] - x, at[i] - x + LENGTH, uid[j], o[j], at[j] - x)

    return texts.select("uid", "doc_id", "text", "keys").mapInArrow(runs, "part int, shared binary, rest binary, meta binary, sides binary, near binary").groupBy("part").applyInArrow(merge, FOUND)


def _spans(docs: DataFrame, s: Scratch) -> DataFrame:
    """(uid, doc_id, start, end, sources): the repeated stretches of each document, in words."""
    rows = _rows(docs)
    copies, lists, count = _repeated(rows, s)
    texts = s.table(_texts(rows, lists))
    found = s.table(_suffix_matches(texts, count).unionByName(_hot_matches(texts, s)))
    w = W.partitionBy("uid").orderBy("start")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    isles = found.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("isle", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = isles.groupBy("uid", "doc_id", "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set("first_id")).alias("sources")).drop("isle")
    whole = copies.select("uid", "doc_id", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"), F.when(F.col("first.o") < NULL_LAST, F.array("first.o")).otherwise(F.array().cast("array<long>")).alias("sources"))
    return spans.unionByName(whole)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, start_word, end_word, n_words, source_ids): stretches of LENGTH words or more whose every window occurs before, in the documents source_ids or earlier in the same one.

    Null, empty and shorter texts have none. Rows with the same doc_id and text
    are one document; other copies of a text are repeated whole. A null doc_id
    comes after all others and is not named in source_ids. Other columns are
    ignored; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as s:
        return s.result(_spans(docs, s).select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("sources").alias("source_ids")))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word spans, each up to the next word or the end."""
    at = word_spans(text)
    out, done = [], 0
    for a, b in sorted(spans):
        out.append(text[done : at[a][0]])
        done = at[b][0] if b < len(at) else len(text)
    return "".join([*out, text[done:]])


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated stretches are cut out of the texts, their first occurrence stays; n_chars follows where it is a column; a document that loses all its words goes.

    Rows without a repeat stay as they are, null and empty texts and repeated
    rows with one doc_id too; of equal texts under different ids the first
    stays whole. docs' own columns, whatever their names; an empty table stays
    empty.
    """
    with Scratch(spark) as s:
        spans = s.result(_spans(docs, s).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    names = docs.columns
    at, size = place(names, "text"), place(names, "n_chars") if "n_chars" in [x.lower() for x in names] else None
    rows = opaque(docs)
    uid = F.xxhash64(F.col(f"c{place(names, 'doc_id')}").cast("long"), F.coalesce(F.col(f"c{at}").cast("string"), F.lit("")))
    both = rows.withColumn("uid", uid).join(spans, "uid", "left").select(*rows.columns, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = b.column(len(names)).is_valid().to_numpy(zero_copy_only=False)
            cols = [b.column(i) for i in range(len(names))]
            keep = np.ones(b.num_rows, bool)
            if hit.any():
                texts = cols[at].to_pylist()
                sizes = cols[size].to_pylist() if size is not None else []
                for i in np.flatnonzero(hit):
                    texts[i] = cut(texts[i], [(x["start"], x["end"]) for x in b.column(len(names))[int(i)].as_py()])
                    keep[i] = Hashed(texts[i]).n > 0
                    if size is not None:
                        sizes[i] = len(texts[i])
                cols[at] = pa.array(texts, cols[at].type)
                if size is not None:
                    cols[size] = pa.array(sizes, cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, [f"c{i}" for i in range(len(names))]).filter(pa.array(keep))

    return both.mapInArrow(run, rows.schema).toDF(*names)


# -- seed and extend


def _seed_matches(texts: DataFrame, count: int) -> DataFrame:
    parts = 1 + count // RANGE
    cols = ["key", "uid", "o", "at", "low", "high", "left", "right"]

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                c = b.slice(i, 128)
                seeds = Seeds()
                for row in zip(c["uid"].to_pylist(), c["doc_id"].to_pylist(), c["text"].to_pylist(), c["keys"].to_pylist()):
                    seeds.add(*row)
                if seeds.n:
                    key, uid, o, at, low, high, left, right = seeds.columns()
                    near = [left[k, :h].tobytes() for k, h in enumerate(high)]
                    after = [right[k, : LENGTH - GRAM - x].tobytes() for k, x in enumerate(low)]
                    yield pa.RecordBatch.from_arrays([pa.array(_part(key, parts)), pa.array(key.view(np.int64)), pa.array(uid), pa.array(o), pa.array(at), pa.array(low), pa.array(high), pa.array(near, pa.binary()), pa.array(after, pa.binary())], ["part", *cols])

    def extend(t: pa.Table) -> pa.Table:
        key, uid, o, at, low, high = (t[c].to_numpy() for c in cols[:6])
        left, right = np.zeros((len(key), SPAN - 1), np.uint32), np.zeros((len(key), LENGTH - GRAM), np.uint32)
        left[np.arange(SPAN - 1) < high[:, None]] = np.frombuffer(b"".join(t["left"].to_pylist()), np.uint32)
        right[np.arange(LENGTH - GRAM) < (LENGTH - GRAM - low)[:, None]] = np.frombuffer(b"".join(t["right"].to_pylist()), np.uint32)
        ahead = np.empty((len(key), LENGTH - GRAM + 1), U64)
        ahead[:, 0] = key.view(U64)
        for j in range(LENGTH - GRAM):
            ahead[:, j + 1] = mix(ahead[:, j] * U64(0x9E3779B97F4A7C15) + right[:, j] + U64(1))
        match = [ahead[:, LENGTH - GRAM - x] for x in range(SPAN)]
        i, j, _ = duplicates(match, key, o, uid, at, low, high, left)
        pairs = np.unique(np.stack([i, j], 1), axis=0)
        i, j = pairs[:, 0], pairs[:, 1]
        # Both ways from the anchor, as far as both have words that are equal.
        step = np.arange(SPAN - 1)
        same = (left[i] == left[j]) & (step < np.minimum(high[i], high[j])[:, None])
        back = np.where(same.all(1), SPAN - 1, np.argmin(same, axis=1)) if len(i) else i
        step = np.arange(LENGTH - GRAM)
        same = (right[i] == right[j]) & (step < (LENGTH - GRAM - np.maximum(low[i], low[j]))[:, None])
        forth = np.where(same.all(1), LENGTH - GRAM, np.argmin(same, axis=1)) if len(i) else i
        return _found(uid[i], o[i], at[i] - back, at[i] + GRAM + forth, uid[j], o[j], at[j] - back)

    return texts.select("uid", "doc_id", "text", "keys").mapInArrow(seed, "part int, key long, uid long, o long, at long, low long, high long, left binary, right binary").groupBy("part").applyInArrow(extend, FOUND)


def _extended(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The matches, each as far both ways as the two texts are equal; what becomes one match counts once.

    A text that many others match goes before them in one sorted stream, once
    for each of SALT parts, and not with each of them.
    """
    by = ["first_uid", "salt", "uid"]
    lists = found.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALT))).groupBy(*by, "doc_id", "first_id").agg(F.collect_list(F.struct("start", "end", "diagonal")).alias("matches"))
    none = lambda c: F.lit(None).cast(dict(lists.dtypes)[c]).alias(c)
    firsts = lists.select("first_uid", "salt").distinct().join(rows.select(F.col("uid").alias("first_uid"), "text"), "first_uid").select("first_uid", "salt", none("uid"), none("doc_id"), none("first_id"), none("matches"), "text")
    others = lists.join(rows.select("uid", "text"), "uid").select(*by, "doc_id", "first_id", "matches", "text")
    stream = firsts.unionByName(others).repartition("first_uid", "salt").sortWithinPartitions("first_uid", "salt", F.col("matches").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = np.zeros(0, U64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                x = batch.slice(k, 256)
                out = []
                for doc_id, first_id, matches, text in zip(*(x[c].to_pylist() for c in ("doc_id", "first_id", "matches", "text"))):
                    words = Hashed(text).runs(1)
                    if matches is None:
                        b = words
                    else:
                        out += [(doc_id, first_id, *m) for m in grown(words, b, [(m["start"], m["end"], m["diagonal"]) for m in matches])]
                cols = list(zip(*out)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "first_id", "start", "end", "diagonal"])

    return stream.mapInArrow(run, "doc_id long, first_id long, start long, end long, diagonal long")


def grown(a: np.ndarray, b: np.ndarray, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, diagonal) of matches between two texts' words, extended to the first word that differs."""
    by: dict[int, list[tuple[int, int]]] = {}
    for start, end, d in matches:
        by.setdefault(d, []).append((start, end))
    out = []
    for d, spans in by.items():
        low, high = max(0, d), min(len(a), len(b) + d)
        other = low + np.flatnonzero(a[low:high] != b[low - d : high - d])
        edges = np.concatenate([[low - 1], other, [high]])
        out += [(x, y, d) for x, y in sorted({(int(edges[k - 1]) + 1, int(edges[k])) for k in np.searchsorted(edges, [s for s, _ in spans], side="right").tolist()})]
    return out


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, start_word, end_word, n_words, other_id, other_start_word): a stretch of LENGTH words or more of a document that is equal to one which begins at other_start_word of other_id, the earliest document with some LENGTH words of it (or earlier in the same one); the words before and after the two differ.

    Null, empty and shorter texts have none. Rows with the same doc_id and text
    are one document; other copies of a text match the first one whole. A null
    doc_id comes after all others. Other columns are ignored; an empty table
    gives no rows.
    """
    with Scratch(docs.sparkSession) as s:
        rows = _rows(docs)
        copies, lists, count = _repeated(rows, s)
        texts = s.table(_texts(rows, lists))
        found = _seed_matches(texts, count).unionByName(_hot_matches(texts, s)).withColumn("diagonal", F.col("start") - F.col("first_start"))
        by = ["uid", "first_uid", "diagonal"]
        w = W.partitionBy(*by).orderBy("start")
        reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
        isles = found.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("isle", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        long = isles.groupBy(*by, "isle").agg(F.first("doc_id").alias("doc_id"), F.first("first_id").alias("first_id"), F.min("start").alias("start"), F.max("end").alias("end"))
        long = _extended(long.filter(F.col("end") - F.col("start") >= LENGTH), texts).select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("first_id").alias("other_id"), (F.col("start") - F.col("diagonal")).alias("other_start_word"))
        zero = F.lit(0).cast("long")
        whole = copies.select("doc_id", zero.alias("start_word"), F.col("n").cast("long").alias("end_word"), F.col("n").cast("long").alias("n_words"), F.when(F.col("first.o") < NULL_LAST, F.col("first.o")).alias("other_id"), zero.alias("other_start_word"))
        return s.result(long.unionByName(whole))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def op6_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op2_suffix_array": op2_suffix_array, "op6_seed_extend": op6_seed_extend}
SQL: dict[str, str] = {}
