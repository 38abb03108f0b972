"""Word splitting, substring hashing and shared scratch tables used by the text operators.

A word is a maximal run of ``\\w`` characters, compared in lower case. Null text
counts as the empty text everywhere.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import Scratch, shared_dir

__all__ = ["BROADCAST_BYTES", "U64", "WORD", "Hashed", "Scratch", "distinct", "joined_words", "keep_ids", "mix", "opaque", "picked", "place", "row_key", "shared_dir", "sized", "table", "word_spans"]

WORD = re.compile(r"\w+")
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, 2 * len(_pow), 1 << 14)
        both = []
        for base in (_BASE, _INV):
            x = np.full(m, base, U64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=U64))
        _pow, _inv = both
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, so that every bit depends on the whole value."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Of each byte of an ASCII text: its lower case where it belongs to a word, else a blank.
_ASCII = bytes(ord(chr(i).lower()) if i < 128 and (chr(i).isalnum() or chr(i) == "_") else 32 for i in range(256))
_wordly: np.ndarray | None = None


def joined_words(text: str | None) -> bytes:
    """``" ".join(WORD.findall(text)).lower()`` in UTF-8, without a match object for each word."""
    global _wordly
    if not text:
        return b""
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split())
    if _wordly is None:
        _wordly = np.array([chr(i).isalnum() for i in range(0x110000)])
        _wordly[ord("_")] = True
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_wordly[points], points, np.uint32(32))
    return b" ".join(points.tobytes().decode("utf-32-le").lower().encode().split())


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; several times as fast as np.unique on short arrays."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Hashed:
    """A text's words with constant-time hashes of any run of words.

    The hash is a polynomial over the UTF-8 bytes of the words joined by single
    blanks, kept as prefix sums modulo 2**64 (the base is odd, so it can be
    divided out) and mixed.
    """

    __slots__ = ("n", "starts", "ends", "sums")

    def __init__(self, text: str | None):
        data = joined_words(text)
        self.n = 0
        if not data:
            return
        b = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero(b == 32)
        self.n = len(gaps) + 1
        self.starts = np.empty(self.n, np.int64)
        self.starts[0] = 0
        self.starts[1:] = gaps + 1
        self.ends = np.empty(self.n, np.int64)
        self.ends[:-1] = gaps
        self.ends[-1] = len(b)
        power, _ = _powers(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, U64)
        np.cumsum((b.astype(U64) + U64(1)) * power[: len(b)], out=self.sums[1:])

    def runs(self, k: int) -> np.ndarray:
        """Hashes of all runs of k words; of the whole text where it has fewer than k, none if it has no word."""
        if not self.n:
            return np.zeros(0, U64)
        k = min(k, self.n)
        s, e = self.starts[: self.n - k + 1], self.ends[k - 1 :]
        return mix((self.sums[e] - self.sums[s]) * _inv[s])


def word_spans(text: str) -> np.ndarray:
    """Start and end character of each word, in the order Hashed numbers them."""
    return np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Rows with the same id and text are one document; the same id with another text is another document."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(names: list[str], name: str) -> int:
    """Where a column is: by its exact name, else by the first one that differs in case alone."""
    return names.index(name) if name in names else [x.lower() for x in names].index(name)


def opaque(docs: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ..., so that no name of a caller's column can clash with one of ours."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def picked(docs: DataFrame, **kinds: str) -> DataFrame:
    """Some columns by name and type, wherever they are and whatever else there is; each must be there."""
    plain = opaque(docs)
    return plain.select(*(F.col(f"c{place(docs.columns, k)}").cast(kind).alias(k) for k, kind in kinds.items()))


#: A side of at most so many bytes (rows times their width) may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 4 << 20


def sized(df: DataFrame, width: int = 16) -> DataFrame:
    """Marked for broadcast if its rows, of at most `width` bytes each, are few enough; else the join shuffles. df is a written table: counting it reads its footers."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def keep_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Left-semi join on key with a written table of keys: broadcast behind a check of its size, shuffled beyond it."""
    return df.join(sized(ids), key, "left_semi")
