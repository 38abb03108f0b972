"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A
document is cut into chunks of CHUNK bytes and each is compressed with both;
the difference of the summed sizes, over the document's length, is its margin:
text like the good sample compresses better with the good dictionary. A
logistic curve fitted to held-out labelled rows turns the margin into a
probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, picked, sized, table

#: Labelled rows taken per class to build the dictionaries, and as many more per class to fit the curve.
TRAIN_ROWS = 1200
#: Bytes of text per class that the dictionaries are built from, at most; a text of more than a sixteenth of that is no sample.
TRAIN_BYTES = 16 << 20
DICT_BYTES = 110_000
CHUNK = 2048
LEVEL = 3
#: A document is kept if it is good with at least this probability.
KEEP = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    a: float
    b: float

    def coders(self) -> tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]:
        make = lambda d: zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT) if not d.startswith(b"\x37\xa4\x30\xec") else zstd.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        return make(self.good), make(self.bad)

    def probability(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.a * margin + self.b))))


def margin(text: str | None, coders: tuple[zstd.ZstdCompressor, zstd.ZstdCompressor]) -> float:
    """(size with the bad dictionary - size with the good one) / bytes; 0 for a null or empty text."""
    data = (text or "").encode()
    if not data:
        return 0.0
    good, bad = coders
    diff = 0
    for i in range(0, len(data), CHUNK):
        x = data[i : i + CHUNK]
        diff += len(bad.compress(x)) - len(good.compress(x))
    return diff / len(data)


def dictionary(texts: list[str]) -> bytes:
    """A dictionary trained on chunks of the texts; where they are too few to train on, their own bytes."""
    parts = [x[i : i + CHUNK] for x in (t.encode() for t in texts) for i in range(0, len(x), CHUNK)]
    try:
        return zstd.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstd.ZstdError:
        return b"".join(parts)[-DICT_BYTES:]


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (margin, label) with both classes of equal weight, by Newton's method with a slight ridge."""
    if len(set(y.tolist())) < 2:
        return 0.0, 50.0 if len(y) and y[0] else (-50.0 if len(y) else 0.0)
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2), z.T @ (w * (y - p)) - 1e-4 * theta)
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most 2 * rows labelled texts per class, those with the least hash; a row is good if its quality is 1.

    Repeated rows count once; a doc_id labelled both ways, and a text of which
    one copy is good and another bad, not at all, nor rows with a null or empty
    text or a null quality. So the model is the same whatever the order of the
    rows. At most TRAIN_BYTES of text per class reach the driver, and two
    numbers for each text of the curve.
    """
    clear = lambda df, key: df.groupBy(key).agg(F.min("good").alias("good"), F.max("good").alias("most")).filter("good = most").select(key, "good")
    marks = picked(labels, doc_id="long", quality="int").filter("doc_id is not null and quality is not null")
    marks = clear(marks.select("doc_id", (F.col("quality") == 1).cast("int").alias("good")), "doc_id")
    texts = picked(docs, doc_id="long", text="string").filter("doc_id is not null and text is not null and text <> ''").withColumn("h", F.xxhash64("text"))
    ids = clear(texts.select("doc_id", "h", F.octet_length("text").alias("size")).filter(F.col("size") <= TRAIN_BYTES // 16).join(marks, "doc_id"), "h")
    w = W.partitionBy("good").orderBy("h")
    chosen = ids.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2 * rows)
    with Scratch(docs.sparkSession) as s:
        got = s.table(texts.select("h", "text").join(sized(s.table(chosen), 24), "h").groupBy("h", "good", "r").agg(F.first("text").alias("text")))
        size = F.sum(F.octet_length("text")).over(W.partitionBy("good").orderBy("r"))
        first = got.filter("r % 2 = 1").withColumn("size", size).filter(F.col("size") <= TRAIN_BYTES).select("good", "r", "text").toPandas().sort_values("r")
        m = Model(dictionary(list(first[first.good == 1].text)), dictionary(list(first[first.good == 0].text)), 0.0, 0.0)

        def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coders = m.coders()
            for b in batches:
                yield pa.RecordBatch.from_arrays([b["h"], b["good"], pa.array([margin(x, coders) for x in b["text"].to_pylist()], pa.float64())], ["h", "good", "margin"])

        second = got.filter("r % 2 = 0").select("h", "good", "text").mapInArrow(margins, "h long, good int, margin double").toPandas().sort_values("h")
    return Model(m.good, m.bad, *calibrate(second.margin.to_numpy(dtype=float), second.good.to_numpy(dtype=float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, margin, score, keep), one for each row of docs.

    A null or empty text has margin 0 and the score of that margin. Repeated
    rows give repeated results; other columns are ignored; an empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        coders = m.coders()
        for b in batches:
            d = [margin(x, coders) for x in b["text"].to_pylist()]
            p = [m.probability(x) for x in d]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(d, pa.float64()), pa.array(p, pa.float64()), pa.array([x >= KEEP for x in p], pa.bool_())], ["doc_id", "margin", "score", "keep"])

    return picked(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, margin double, score double, keep boolean")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
