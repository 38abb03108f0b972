"""BPE encoding and decoding by tree concatenation.

Texts of up to LEAF characters are encoded where they lie. A longer one is cut
into leaves that are encoded in parallel; neighbouring results are then joined
two by two. At each join a window around the seam is encoded again and grows
until its first and last unit equal what both sides had there.

Why that is exact. The splitting pattern scans from left to right, looks at
most one piece ahead and never back, so a boundary both runs share fixes all
that follows. Inside an unsplit piece, a token sequence is the BPE encoding if
and only if each two neighbours are the encoding of their own bytes, so a
window whose outer tokens are unchanged leaves every pair valid.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, row_key, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN = regex.compile(SPLIT)
#: Characters of a leaf; bytes of an unsplit piece above which it is encoded as a tree itself.
LEAF = 32_768
PIECE = 2_048


def encoding(path: str) -> tiktoken.Encoding:
    return _encoding(Path(path).read_bytes())


def shipped(spark: SparkSession, path: str) -> Callable[[], tiktoken.Encoding]:
    """The encoding for executors: the driver reads the vocabulary, a file of a few MB, and sends it."""
    shared = spark.sparkContext.broadcast(Path(path).read_bytes())
    return lambda: _encoding(shared.value)


@lru_cache(maxsize=4)
def _encoding(data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def join_tokens(enc: tiktoken.Encoding, left: list[int], right: list[int]) -> list[int]:
    """The encoding of one unsplit piece from those of its two halves."""
    if not left or not right:
        return left + right
    n = 4
    while True:
        i, j = min(n, len(left)), min(n, len(right))
        new = enc._core_bpe.encode_single_piece(enc.decode_bytes(left[-i:] + right[:j]))
        if (i == len(left) or new[0] == left[-i]) and (j == len(right) or new[-1] == right[j - 1]):
            return left[:-i] + new + right[j:]
        n *= 2


def encode_piece(enc: tiktoken.Encoding, data: bytes, leaf: int = PIECE) -> list[int]:
    if len(data) <= leaf:
        return enc._core_bpe.encode_single_piece(data)
    parts = [enc._core_bpe.encode_single_piece(data[i : i + leaf]) for i in range(0, len(data), leaf)]
    while len(parts) > 1:
        parts = [join_tokens(enc, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


Pieces = list[tuple[str, list[int]]]


def encode_leaf(enc: tiktoken.Encoding, text: str) -> Pieces:
    return [(p, encode_piece(enc, p.encode())) for p in PATTERN.findall(text)]


def join_pieces(enc: tiktoken.Encoding, left: Pieces, right: Pieces) -> Pieces:
    """The pieces of two neighbouring texts as one text has them."""
    if not left or not right:
        return left + right
    n = 3
    while True:
        i, j = min(n, len(left)), min(n, len(right))
        new = PATTERN.findall("".join(p for p, _ in left[-i:]) + "".join(p for p, _ in right[:j]))
        if (i == len(left) or new[0] == left[-i][0]) and (j == len(right) or new[-1] == right[j - 1][0]):
            break
        n *= 2
    old: dict[int, tuple[str, list[int]]] = {}
    at = 0
    for p in left[-i:] + right[:j]:
        old[at] = p
        at += len(p[0])
    made: Pieces = []
    at = 0
    for p in new:
        end, tokens, x = at + len(p), [], at
        # A piece made of whole old ones is joined from their tokens, whatever its length.
        while x < end and x in old and x + len(old[x][0]) <= end:
            tokens = join_tokens(enc, tokens, old[x][1])
            x += len(old[x][0])
        made.append((p, tokens if x == end else encode_piece(enc, p.encode())))
        at = end
    return left[:-i] + made + right[j:]


def merge(enc: tiktoken.Encoding, parts: list[Pieces]) -> Pieces:
    while len(parts) > 1:
        parts = [join_pieces(enc, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def encode_text(enc: tiktoken.Encoding, text: str, leaf: int = LEAF) -> list[int]:
    """All of it in one process, by the same tree."""
    return [t for _, ts in merge(enc, [encode_leaf(enc, text[i : i + leaf]) for i in range(0, len(text), leaf)]) for t in ts]


OUT = "doc_id long, tokens array<int>, n_tokens long, exact boolean"


def _batch(enc: tiktoken.Encoding, ids: pa.Array, texts: list[str | None], tokens: list[np.ndarray | list[int] | None]) -> pa.RecordBatch:
    offsets = np.zeros(len(texts) + 1, np.int32)
    np.cumsum([0 if t is None else len(t) for t in tokens], out=offsets[1:])
    flat = [np.asarray(t, np.int32) for t in tokens if t is not None]
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)), mask=pa.array([t is None for t in tokens], pa.bool_()))
    exact = [None if t is None else enc.decode_bytes(t if isinstance(t, list) else t.tolist()) == x.encode() for t, x in zip(tokens, texts)]
    return pa.RecordBatch.from_arrays([ids, lists, pa.array([0 if t is None else len(t) for t in tokens], pa.int64()), pa.array(exact, pa.bool_())], ["doc_id", "tokens", "n_tokens", "exact"])


def encode(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """Rows (doc_id, tokens, n_tokens, exact), one for each row of docs; exact says that decoding gives back the text.

    A null text has null tokens, 0 of them, exact null; an empty text an empty
    list, exact; a null doc_id stays null. Repeated rows give repeated results.
    Very long texts, with or without blanks, go through the distributed tree.
    Other columns, whatever their names, are ignored; an empty table gives none.
    """
    own = shipped(docs.sparkSession, f"{tokenizers}/{vocabulary}")
    rows = picked(docs, doc_id="long", text="string")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > leaf

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = own()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = part["text"].to_pylist()
                yield _batch(enc, part["doc_id"], texts, [None if x is None else enc.encode_to_numpy(x) for x in texts])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, i, x in zip(b["uid"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist()):
                at = range(0, len(x), leaf)
                for k in range(0, len(at), 64):
                    some = at[k : k + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * len(some)), pa.array([i] * len(some), pa.int64()), pa.array([p // leaf for p in some], pa.int32()), pa.array([x[p : p + leaf] for p in some])], ["uid", "doc_id", "part", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = own()
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                got = encode_leaf(enc, row["text"][0].as_py())
                yield pa.RecordBatch.from_arrays([row["uid"], row["doc_id"], row["part"], row["text"], pa.array([[len(p) for p, _ in got]], pa.list_(pa.int32())), pa.array([[len(t) for _, t in got]], pa.list_(pa.int32())), pa.array([[t for _, ts in got for t in ts]], pa.list_(pa.int32()))], ["uid", "doc_id", "part", "text", "chars", "counts", "tokens"])

    def join(t: pa.Table) -> pa.Table:
        enc = own()
        seen: dict[int, tuple] = {}
        copies = 0
        for part, text, chars, counts, tokens in zip(*(t[c].to_pylist() for c in ("part", "text", "chars", "counts", "tokens"))):
            copies += part == 0
            if part not in seen:
                seen[part] = (text, chars, counts, tokens)
        parts: list[Pieces] = []
        for _, (text, chars, counts, tokens) in sorted(seen.items()):
            c, k, pieces = 0, 0, []
            for a, b in zip(chars, counts):
                pieces.append((text[c : c + a], tokens[k : k + b]))
                c, k = c + a, k + b
            parts.append(pieces)
        whole = "".join(seen[p][0] for p in sorted(seen))
        flat = [x for _, ts in merge(enc, parts) for x in ts]
        one = _batch(enc, pa.array(t["doc_id"].to_pylist()[:1], pa.int64()), [whole], [flat])
        return pa.Table.from_batches([one] * copies)

    wide = rows.filter(is_long).withColumn("uid", row_key()).select("uid", "doc_id", "text").mapInArrow(cut, "uid long, doc_id long, part int, text string")
    done = wide.repartition("uid", "part").mapInArrow(leaves, "uid long, doc_id long, part int, text string, chars array<int>, counts array<int>, tokens array<int>").groupBy("uid").applyInArrow(join, OUT)
    return rows.filter(~is_long).mapInArrow(short, OUT).unionByName(done)


def decode(encoded: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, text) from rows (doc_id, tokens); null tokens give a null text, bytes that aren't UTF-8 the replacement character."""
    own = shipped(encoded.sparkSession, f"{tokenizers}/{vocabulary}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = own()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([None if x is None else enc.decode_bytes(x).decode(errors="replace") for x in b["tokens"].to_pylist()], pa.string())], ["doc_id", "text"])

    return picked(encoded, doc_id="long", tokens="array<int>").mapInArrow(run, "doc_id long, text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents as tokens, as encode has them: nulls, empty texts, repeats and other columns too."""
    return encode(docs)


QUERIES = {"op3_bpe": op3_bpe}
SQL: dict[str, str] = {}
