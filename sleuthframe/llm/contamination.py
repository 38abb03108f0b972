"""Benchmark decontamination: rare word seeds, then Smith-Waterman alignment.

An alignment that reaches SCORE matches at least that share of the item's
words, so of any set of places that leaves out fewer it matches some: the
rarest such places of each item, by the documents they are in, are its seeds. Where
enough of them lie close together, the score that the item's words could reach
in any order bounds that of an alignment; only where this bound suffices are the
item and the stretch aligned word by word. Neither step can lose a match, so
the result is that of aligning every item with every document; how rare a word
is decides the time alone. The alignment's score over that of a perfect copy
tells copies, edited and paraphrased ones too, from chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Hashed, opaque, picked, place, table

#: Items of up to 2 * GRAM words, of which a few match by chance, need a run of GRAM words in common; it alone reaches SCORE.
GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of a perfect copy's score.
SCORE = 0.5
#: Words of test items searched for in one pass over the documents; more are taken in further passes.
PASS_WORDS = 2_000_000


@dataclass
class Items:
    ids: list[int]
    words: list[np.ndarray]  # a hash for each word
    vocabulary: np.ndarray  # all items' words, sorted
    numbers: list[np.ndarray]  # of each item, its words' numbers
    sizes: np.ndarray
    need: np.ndarray  # seeds that a match holds at least
    first: np.ndarray | None = None  # of each word, where in seeds the items begin that it is a seed of; the end last
    seeds: np.ndarray | None = None


def index(rows: list[tuple[int, str]]) -> Items:
    ids, words = [], []
    for i, text in rows:
        h = Hashed(text)
        if h.n >= GRAM:
            ids.append(i)
            words.append(h.runs(1))
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, U64)
    sizes = np.array([len(w) for w in words], np.int64)
    return Items(ids, words, vocabulary, [np.searchsorted(vocabulary, w) for w in words], sizes, 1 + sizes // 6)


def numbered(items: Items, words: np.ndarray) -> np.ndarray:
    """The number of each word of a document, -1 if no item has it."""
    if not len(words) or not len(items.vocabulary):
        return np.full(len(words), -1)
    at = np.searchsorted(items.vocabulary, words)
    at[at == len(items.vocabulary)] = 0
    return np.where(items.vocabulary[at] == words, at, -1)


def choose(items: Items, docs_with: np.ndarray) -> None:
    """The rarest places of each item, so many that a match holds `need` of them."""
    pairs = [np.zeros((0, 2), np.int64)]
    for i, w in enumerate(items.numbers):
        keep = len(w) - math.ceil(SCORE * len(w)) + int(items.need[i])
        own = np.unique(w[np.lexsort((w, docs_with[w]))[:keep]])
        pairs.append(np.stack([own, np.full(len(own), i)], 1))
    both = np.concatenate(pairs)
    both = both[np.argsort(both[:, 0], kind="stable")]
    items.first = np.searchsorted(both[:, 0], np.arange(len(items.vocabulary) + 1))
    items.seeds = both[:, 1]


def align(item: np.ndarray, text: np.ndarray, least: float = 1) -> tuple[int, int, int]:
    """Best local alignment's score and the words of text it ends before and begins at; the latter are 0 where the score is below `least`."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        slope = -GAP * np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        top, end = 0, 0
        for x in a:
            new = np.maximum(row + GAP, 0)
            new[1:] = np.maximum(new[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH))
            row = np.maximum.accumulate(new + slope) - slope
            j = int(row.argmax())
            if row[j] > top:
                top, end = int(row[j]), j
        return top, end

    score, end = best(item, text)
    if score < least:
        return score, 0, 0
    _, back = best(item[::-1], text[:end][::-1])
    return score, end, end - back


def near(items: Items, at: np.ndarray) -> dict[int, list[list[int]]]:
    """Of each item with enough seeds close together, the stretches of a document's word numbers that hold all its matches."""
    places = np.flatnonzero(at >= 0)
    lo = items.first[at[places]]
    many = items.first[at[places] + 1] - lo
    total = int(many.sum())
    out: dict[int, list[list[int]]] = {}
    if not total:
        return out
    item = items.seeds[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(total)]
    place = np.repeat(places, many)
    order = np.argsort(item, kind="stable")
    item, place = item[order], place[order]
    # A match has as many words of the document as twice the item's at most: each word that doesn't match costs a point.
    wide = 2 * items.sizes[item]
    last = np.arange(total) + items.need[item] - 1
    ok = np.flatnonzero(last < total)
    ok = ok[(item[last[ok]] == item[ok]) & (place[last[ok]] - place[ok] < wide[ok])]
    for i, a, b in zip(item[ok].tolist(), np.maximum(0, place[last[ok]] - wide[ok]).tolist(), np.minimum(len(at), place[ok] + wide[ok]).tolist()):
        own = out.setdefault(i, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    return out


def stretches(item: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Where in a run of word numbers an alignment with the item may reach SCORE."""
    n = len(item)
    if n <= 2 * GRAM:
        k = min(n, GRAM)
        if len(at) < k:
            return []
        runs = {tuple(item[j : j + k].tolist()) for j in range(n - k + 1)}
        return [(max(0, p - 2 * n), p + 2 * n) for p, x in enumerate(zip(*(at[j:].tolist() for j in range(k)))) if x in runs]
    has = np.zeros(max(int(item.max()), int(at.max())) + 2, bool)  # the last is that of -1
    has[item] = True
    same = has[at]
    if np.count_nonzero(same) < SCORE * n:
        return []
    score = np.zeros(len(at) + 1, np.int64)
    np.cumsum(np.where(same, MATCH, max(MISMATCH, GAP)), out=score[1:])
    reach = score - np.minimum.accumulate(score)
    if reach.max() < SCORE * MATCH * n:
        return []
    good = np.flatnonzero(reach >= SCORE * MATCH * n)
    # An alignment's words so far always score above 0, so it lies between two places where nothing is reached.
    zero = np.flatnonzero(reach == 0)
    begin = zero[np.searchsorted(zero, good) - 1]
    new = np.flatnonzero(np.r_[True, begin[1:] != begin[:-1]])
    return list(zip(begin[new].tolist(), good[np.r_[new[1:], len(good)] - 1].tolist()))


def search(items: Items, text: str | None) -> list[tuple[int, float, int, int]]:
    """(item id, score, start word, end word) of each item found in a text, its best place."""
    words = Hashed(text).runs(1)
    at = numbered(items, words)
    out = []
    for i, found in near(items, at).items():
        n = len(items.words[i])
        best: tuple[float, int, int] | None = None
        for low, high in found:
            for a, b in stretches(items.numbers[i], at[low:high]):
                score, end, start = align(items.words[i], words[low + a : low + b], SCORE * MATCH * n)
                share = score / (MATCH * n)
                if share >= SCORE and (best is None or share > best[0]):
                    best = (share, low + a + start, low + a + end)
        if best:
            out.append((items.ids[i], *best))
    return sorted(out)


def load(docs: DataFrame, benchmark: DataFrame) -> Iterator[Items]:
    """The test items with their seeds, one pass's worth at a time."""
    bench = picked(benchmark, item_id="long", text="string").filter("text is not null").distinct()
    total = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = 1 + total // (6 * PASS_WORDS)
    for k in range(passes):
        rows = bench.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        items = index([(r[0], r[1]) for r in rows])
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(shared.value.vocabulary) + 1, np.int64)
            for b in batches:
                for x in b["text"].to_pylist():
                    n[np.unique(numbered(shared.value, Hashed(x).runs(1)))] += 1
            at = np.flatnonzero(n[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["word", "n"])

        counts = picked(docs, text="string").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
        docs_with = np.zeros(len(items.vocabulary), np.int64)
        docs_with[counts["word"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
        choose(items, docs_with)
        yield items


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, score, start_word, end_word), for each document and test item it holds the best place.

    Null or empty texts hold nothing. Items of fewer than GRAM words, or a null
    text, are not searched for; equal rows of the benchmark count once, and an
    id with two texts may give two rows. Repeated documents give repeated
    results; other columns are ignored; either table may be empty.
    """
    spark = docs.sparkSession
    out = None
    for items in load(docs, benchmark):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [(d, *x) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) for x in search(shared.value, t)]
                cols = list(zip(*got)) if got else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()])], ["doc_id", "item_id", "score", "start_word", "end_word"])

        found = picked(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, item_id long, score double, start_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a test item go; the others stay as they are. One narrow pass for each load of items.

    Null and empty texts stay, repeated rows stay or go together. docs' own
    columns, whatever their names; an empty table stays empty.
    """
    names, at = docs.columns, place(docs.columns, "text")
    kept = opaque(docs)
    schema = kept.schema
    for items in load(docs, table(spark, sf_dir, "benchmark")):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not search(shared.value, x) for x in b.column(at).to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(run, schema)
    return kept.toDF(*names)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
SQL: dict[str, str] = {}
