"""Token totals kept by deltas.

A batch of changes is turned into signed rows: an insert adds a document's
count, a delete takes it away, a revision takes the old count away and adds the
new one. Summed by (source, language, tokenizer version) they are appended as
one folder per batch id; a batch becomes visible when its marker file is
renamed into place, so committing the same id again, after a crash or twice,
changes nothing. Totals are the sum over committed folders.

Compaction sums the live folders into one and folds their markers into a
snapshot. What it replaces is deleted by a later sweep only, so that totals
taken before it can still be read. A rename that never replaces decides which
of two commits of one id counts; where the file system has no such rename
(object stores), there must be one writer at a time.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, picked, table

KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, docs long, tokens long, unknown long"
#: Seconds for which replaced and uncommitted folders are kept: readers and writers must be done with them by then.
GRACE = 24 * 3600.0


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows from changes (op, source, lang, version, old_tokens, new_tokens).

    op is insert, delete or revise; a null or other op changes no total and is
    counted as unknown. Null counts are 0; null source, lang or version are a
    group of their own. A row repeated in a batch counts each time, since two
    documents may change alike; other columns are ignored; no rows give none.
    """
    rows = picked(changes, op="string", source="string", lang="string", version="string", old_tokens="long", new_tokens="long")
    old, new = F.coalesce(F.col("old_tokens"), F.lit(0)), F.coalesce(F.col("new_tokens"), F.lit(0))
    op = lambda i, d, r, other: F.when(F.col("op") == "insert", i).when(F.col("op") == "delete", d).when(F.col("op") == "revise", r).otherwise(other).cast("long")
    zero, one = F.lit(0), F.lit(1)
    return rows.select(*KEYS, op(one, -one, zero, zero).alias("docs"), op(new, -old, new - old, zero).alias("tokens"), op(zero, zero, zero, one).alias("unknown"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "unknown")))


class Rollup:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._p().getFileSystem(self._conf)

    def _p(self, *parts: str) -> object:
        return self._fs.Path("/".join([self.path, *parts]))

    def _names(self, folder: str) -> dict[str, float]:
        """Of each entry, when it was last changed."""
        at = self._p(folder)
        return {f.getPath().getName(): f.getModificationTime() / 1000 for f in self.fs.listStatus(at)} if self.fs.exists(at) else {}

    def _read(self, name: str) -> dict:
        stream = self.fs.open(self._p("log", name))
        said = json.loads(bytes(stream.readAllBytes()))
        stream.close()
        return said

    def _state(self) -> tuple[int, dict[str, list[str]], set[str]]:
        """The last snapshot's number, of each live folder the batch ids it holds, and the markers that the snapshot has folded in."""
        names = self._names("log")
        last = max((int(x[9:-5]) for x in names if x.startswith("snapshot-")), default=0)
        live: dict[str, list[str]] = {}
        folded: set[str] = set()
        if last:
            said = self._read(f"snapshot-{last}.json")
            live, folded = {said["folder"]: said["batches"]}, {_marker(b) for b in said["batches"]}
        for x in sorted(names):
            if x.startswith("batch-") and x not in folded:
                said = self._read(x)
                live[said["folder"]] = said["batches"]
        return last, live, folded

    def committed(self) -> dict[str, list[str]]:
        """Of each live folder, the batch ids it holds."""
        return self._state()[1]

    def _mark(self, name: str, said: dict) -> bool:
        tmp, to = self._p("log", f".{uuid.uuid4().hex}"), self._p("log", name)
        out = self.fs.create(tmp)
        out.write(json.dumps(said).encode())
        out.close()
        context = self._fs.FileContext.getFileContext(to.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(tmp), context.makeQualified(to), options)  # fails if it exists
            return True
        except Exception:
            if not self.fs.exists(to):
                raise
            self.fs.delete(tmp, False)
            return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch, an empty one too; False, and nothing changes, where that id was committed before."""
        if any(batch in x for x in self.committed().values()):
            return False
        folder = f"data/{uuid.uuid4().hex}"
        _sums(signed(changes)).write.parquet(f"{self.path}/{folder}")
        return self._mark(_marker(batch), {"folder": folder, "batches": [batch]})

    def _sum(self, live: dict[str, list[str]]) -> DataFrame:
        rows = self.spark.read.schema(DELTA).parquet(*(f"{self.path}/{x}" for x in sorted(live))) if live else self.spark.createDataFrame([], DELTA)
        return _sums(rows)

    def totals(self) -> DataFrame:
        """Totals (source, lang, version, docs, tokens); groups that no document is left in don't appear."""
        return self._sum(self.committed()).filter("docs <> 0 or tokens <> 0").drop("unknown")

    def unknown(self) -> DataFrame:
        """(source, lang, version, unknown): how many changes of no known op were committed."""
        return self._sum(self.committed()).filter("unknown > 0").select(*KEYS, "unknown")

    def compact(self) -> None:
        """Replace all live folders by one and their markers by a snapshot; readers see either the old or the new, and may go on with the old until a sweep."""
        last, live, _ = self._state()
        if len(live) > 1:
            folder = f"data/{uuid.uuid4().hex}"
            self._sum(live).write.parquet(f"{self.path}/{folder}")
            self._mark(f"snapshot-{last + 1}.json", {"folder": folder, "batches": sorted(b for v in live.values() for b in v)})

    def sweep(self, grace: float = GRACE) -> int:
        """Delete what no reader or writer needs any more, if it is older than `grace` seconds: folders replaced or never committed, folded markers, old snapshots, unfinished files. The number of entries deleted."""
        last, live, folded = self._state()
        before = time.time() - grace
        gone = [("data", x) for x, t in self._names("data").items() if f"data/{x}" not in live and t < before]
        gone += [("log", x) for x, t in self._names("log").items() if t < before and (x in folded or x.startswith(".") or x.startswith("snapshot-") and x != f"snapshot-{last}.json")]
        for at in gone:
            self.fs.delete(self._p(*at), True)
        return len(gone)


def _marker(batch: str) -> str:
    return f"batch-{batch.encode().hex()}.json"


#: Tokenizer versions that need no vocabulary, as (Spark's, DuckDB's) expressions over a text column.
VERSIONS = {
    "blank-1": r"[^ \t\r\n]+",
    "word-2": r"[\p{L}\p{N}]+|[^ \t\r\n\p{L}\p{N}]",
}
EMAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"


def count(version: str, text: str | Column = "text") -> Column:
    """Tokens of a text; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all documents after four batches: the load under the first version, the same documents under the second, deletion of those labelled toxic, and revision of all others by redacting mail addresses. The load is committed twice, to no effect."""
    docs = picked(table(spark, sf_dir, "documents"), doc_id="long", source="string", lang="string", text="string")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    with Scratch(spark) as s:
        redacted = F.regexp_replace("text", EMAIL, " ")
        has = F.col("text").contains("@")
        counts = docs.select("doc_id", "source", "lang", *(count(v).alias(v) for v in VERSIONS), *(F.when(has, count(v, redacted)).otherwise(count(v)).alias(f"{v}-new") for v in VERSIONS))
        counts = s.table(counts)

        def rows(df: DataFrame, op: str, version: str) -> DataFrame:
            old = F.lit(None).cast("long") if op == "insert" else F.col(f"`{version}`")
            new = F.col(f"`{version}`") if op == "insert" else F.col(f"`{version}-new`")
            return df.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), old.alias("old_tokens"), new.alias("new_tokens"))

        gone, kept = counts.join(toxic, "doc_id", "left_semi"), counts.join(toxic, "doc_id", "left_anti")
        both = lambda df, op: rows(df, op, "blank-1").unionByName(rows(df, op, "word-2"))
        r = Rollup(spark, f"{s.at}/rollup")
        for batch, changes in (("load", rows(counts, "insert", "blank-1")), ("upgrade", rows(counts, "insert", "word-2")), ("load", rows(counts, "insert", "blank-1")), ("purge", both(gone, "delete")), ("redact", both(kept, "revise"))):
            r.commit(batch, changes)
        r.compact()
        return s.result(r.totals())


QUERIES = {"op5_token_counts": op5_token_counts}
_TEXT = f"regexp_replace(text, '{EMAIL}', ' ', 'g')"
SQL = {
    "op5_token_counts": "with kept as (select * from documents where doc_id not in (select doc_id from labels where toxic = 1)) "
    + " union all ".join(f"select source, lang, '{v}' as version, count(*)::bigint as docs, sum(len(regexp_extract_all({_TEXT}, '{p}')))::bigint as tokens from kept group by source, lang" for v, p in VERSIONS.items())
}
