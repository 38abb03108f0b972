"""Language ID with language-bitmask n-gram filters.

Training counts the character n-grams of each language in a bounded sample of
labelled rows and puts the most frequent ones in one bit-sliced Bloom filter: a
slot has one bit for each language, so one probe sequence (the AND of its
slots) gives the set of all languages that contain an n-gram. A document is
decided by the popcount of each language's bit over all its n-grams, corrected
for the filter's false positives.

Labelled rows held out from that tell how large this share is in a language's
own texts: each language's threshold is the share that all but FIT of them
reach. What stays below, beyond what chance explains at its length, is in none
of the languages, or in several, and is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, Scratch, mix, opaque, picked, place, sized, table

LETTERS = re.compile(r"[^\W\d_]+")

#: Labelled rows taken per language to fit the filter, and as many more to fit its threshold; the n-grams kept of each language.
TRAIN_ROWS = 1500
GRAMS = 12_000
SLOT_BITS = 17
PROBES = 3
WIDTH = 4
#: Languages in one mask; more take further masks.
MASK = 64
#: An n-gram is left out of a language in which its share is below this part of its share in another.
STRAY = 0.1
#: Share of a language's held-out rows that may lie below its threshold; MIN_SHARE where no row is held out.
FIT = 0.002
MIN_SHARE = 0.35
#: Held-out rows of fewer n-grams say nothing on the threshold.
FIT_GRAMS = 50
#: Standard deviations that a share may lie below the threshold by chance.
SLACK = 2.6


def grams(text: str | None) -> np.ndarray:
    """The text's byte 4-grams as integers: letters in lower case, every other run of characters one blank."""
    b = np.frombuffer((" " + " ".join(LETTERS.findall((text or "").lower())) + " ").encode(), np.uint8).astype(np.uint32)
    if len(b) < WIDTH:
        return np.zeros(0, np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def slots(g: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(g.astype(U64) + U64(0x9E3779B97F4A7C15))
    return [((h >> U64(21 * i)) & U64((1 << bits) - 1)).astype(np.int64) for i in range(PROBES)]


@dataclass
class Filter:
    langs: list[str]
    masks: list[np.ndarray]  # of each MASK languages, an integer with a bit for each of them, per slot
    wrong: np.ndarray  # false-positive rate of each language's slice
    least: np.ndarray  # of each language, the share that its texts reach

    def shares(self, g: np.ndarray) -> np.ndarray:
        """Of each language, the share of n-grams it contains, less what false positives add."""
        if not len(g) or not self.langs:
            return np.zeros(len(self.langs))
        a, b, c = slots(g, self.masks[0].size.bit_length() - 1)
        hits = [m[a] & m[b] & m[c] for m in self.masks]
        seen = np.array([np.count_nonzero(hits[i // MASK] & hits[0].dtype.type(1 << i % MASK)) for i in range(len(self.langs))]) / len(g)
        return np.clip((seen - self.wrong) / (1 - self.wrong), 0, 1)


def build(tops: dict[str, np.ndarray], bits: int = SLOT_BITS) -> Filter:
    langs = sorted(tops)
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    masks = [np.zeros(1 << bits, kind) for _ in range(0, max(1, len(langs)), MASK)]
    for i, lang in enumerate(langs):
        for s in slots(tops[lang], bits):
            masks[i // MASK][s] |= kind(1 << i % MASK)
    fill = np.array([np.count_nonzero(masks[i // MASK] & kind(1 << i % MASK)) for i in range(len(langs))]) / (1 << bits)
    return Filter(langs, masks, fill**PROBES, np.full(len(langs), MIN_SHARE))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Filter:
    """Fit on at most 2 * rows different texts of each language, those with the least hash, so that any input gives a like sample: every other one for the filter, the rest for the threshold.

    Rows without text or label don't count. Only a few thousand sampled texts
    and, at the end, GRAMS integers and a threshold per language reach the driver.
    """
    with Scratch(labelled.sparkSession) as s:
        return _fit(labelled, rows, s)


def _fit(labelled: DataFrame, rows: int, s: Scratch) -> Filter:
    ok = picked(labelled, lang="string", text="string").filter("lang is not null and text is not null and text <> ''").withColumn("h", F.xxhash64("text"))
    rank = F.dense_rank().over(W.partitionBy("lang").orderBy("h"))
    chosen = ok.select("lang", "h").distinct().withColumn("n", rank).filter(F.col("n") <= 2 * rows)
    sample = ok.join(sized(s.table(chosen), 40), ["lang", "h"]).groupBy("lang", "h", "n").agg(F.first("text").alias("text"))
    sample = s.table(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                g, n = np.unique(grams(text), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = sample.filter("n % 2 = 1").select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("lang"))
    # Foreign words strayed into a language's texts are far rarer there than at home.
    own = counts.withColumn("share", share).withColumn("top", F.max("share").over(W.partitionBy("gram"))).filter(F.col("share") >= STRAY * F.col("top"))
    best = own.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= GRAMS)
    got = best.select("lang", "gram").toPandas()
    model = build({lang: x["gram"].to_numpy(np.uint32) for lang, x in got.groupby("lang")})

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                g = grams(text)
                if len(g) >= FIT_GRAMS and lang in model.langs:
                    out.append((lang, float(model.shares(g)[model.langs.index(lang)])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["lang", "share"])

    held = sample.filter("n % 2 = 0").select("lang", "text").mapInArrow(reach, "lang string, share double")
    for lang, least in held.groupBy("lang").agg(F.expr(f"percentile(share, {FIT})")).collect():
        model.least[model.langs.index(lang)] = least
    return model


def decide(model: Filter, text: str | None) -> tuple[str | None, float, bool]:
    """The language, its corrected share of the n-grams, and whether the document is accepted; ties go to the first language by name."""
    g = grams(text)
    share = model.shares(g)
    if not len(g) or not len(share):
        return None, 0.0, False
    i = int(np.argmax(share))
    least = float(model.least[i])
    ok = bool(share[i] > 0 and share[i] >= least - SLACK * np.sqrt(least * (1 - least) / len(g)))
    return model.langs[i] if ok else None, float(share[i]), ok


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """Rows (doc_id, language, share, accepted), one for each row of docs.

    Null, empty or letterless text: language null, share 0, not accepted.
    Repeated rows give repeated results; other columns are ignored; an empty
    table gives an empty result, as does a model of no language reject all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [decide(m, x) for x in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())], ["doc_id", "language", "share", "accepted"])

    return picked(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, language string, share double, accepted boolean")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows whose language is decided, with docs' own columns, whatever their names; one narrow pass, no join.

    Null, empty and letterless texts go, and all rows if no row has a label.
    Repeated rows stay repeated; an empty table stays empty.
    """
    shared = spark.sparkContext.broadcast(train(docs))
    names, at = docs.columns, place(docs.columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([decide(shared.value, x)[2] for x in b.column(at).to_pylist()], pa.bool_()))

    rows = opaque(docs)
    return rows.mapInArrow(run, rows.schema).toDF(*names)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
