"""Every check reports its sample's first variant and leaves the second one alone."""

from __future__ import annotations

import ast
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sleuthframe.plans import code, history, history_samples, samples
from sleuthframe.sources import python_code

CODE = "file_ord long, path string, src string"


def base(spark, files):
    order = sorted(files, key=lambda f: f[0].split("/"))
    return code.Code(code.extract(spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(order)], CODE)))


def test_every_check_has_a_sample():
    assert set(samples.SAMPLES) == set(code.CHECKS)
    assert len(code.CHECKS) == 54 and len(history.CHECKS) == 17


@pytest.mark.parametrize("name", list(code.CHECKS))
def test_code_check(spark, name):
    s = samples.SAMPLES[name]
    files = [*s.files(1, 5, True), *s.files(2, 6, False)]
    got = code.run(base(spark, files), [name]).collect()
    assert [(r.file, r.line, r.check, r.severity) for r in got] == [(f"pkg1/{s.prefix}mod5.py", s.line, name, s.severity)]
    assert got[0].message


def test_unparsable_files_and_nulls_are_dropped(spark):
    files = [("a.py", "def (:"), ("b.py", None), ("c.py", ""), ("d.py", "x = '\\ud800'"), ("e.py", "def orphan():\n    return 1\n")]
    got = code.run(base(spark, files), ["dead-code"]).collect()
    assert [r.file for r in got] == ["e.py"]


def test_no_files(spark):
    assert code.run(base(spark, []), ["dead-code", "param-clumps", "inconsistent-error-handling", "long-function"]).count() == 0


def test_order_of_paths_without_ordinals(spark):
    rows = [("a-b/m.py", "import ftplib"), ("a/m.py", "import ftplib")]
    got = code.run(code.Code.read(spark.createDataFrame(rows, "path string, src string")), ["stdlib-alternatives"]).collect()
    assert [r.file for r in got] == ["a/m.py"]


def test_facts_written_by_kind(spark, tmp_path):
    s = samples.SAMPLES["dead-code"]
    df = spark.createDataFrame(s.files(1, 5, True), "path string, src string")
    got = code.run(code.Code.read(df, str(tmp_path / "facts")), ["dead-code"]).collect()
    assert [r.line for r in got] == [1]


class Rows:
    """Two suppliers, one of each variant."""

    @staticmethod
    def frame(spark):
        return spark.createDataFrame([(1, 5000.0), (2, 10.0)], "s_suppkey long, s_acctbal double")


@pytest.mark.parametrize("name", list(history.CHECKS))
def test_history_check(spark, name):
    got = history.run(history_samples.history(Rows.frame(spark), name), [name]).collect()
    assert [(r.file, r.line, r.check, r.severity) for r in got] == [("pkg1/mod1.py", 1, name, history.CHECKS[name][1])]


def test_gate_on_poor_messages(spark):
    h = history_samples.history(Rows.frame(spark), "bug-magnet")
    h.messages = "unstructured"
    assert history.run(h, ["bug-magnet"]).count() == 0


def test_review_resets_the_history(spark):
    from datetime import datetime

    h = history_samples.history(Rows.frame(spark), "bug-magnet")
    h.reviews = spark.createDataFrame([("pkg1/mod1.py", datetime(2024, 3, 1))], "path string, ts timestamp")
    assert history.run(h, ["bug-magnet"]).count() == 0


def test_expected_coupling_is_left_out(spark):
    h = history_samples.history(Rows.frame(spark), "change-coupling")
    h.expected = [["*mod1_b.py", "pkg1/*"]]
    assert history.run(h, ["change-coupling"]).count() == 0


def test_facts_of_some_kinds_are_those_of_all_in_the_same_order():
    own = Path(python_code.__file__)
    files = [(str(own), own.read_text())] + [f for s in samples.SAMPLES.values() for bad in (True, False) for f in s.files(1, 5, bad)]
    for path, src in files:
        rows = python_code.facts_of(3, path, src)
        for kinds in {*code.KINDS.values()}:
            got = python_code.facts_of(3, path, src, frozenset(kinds))
            assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in rows if r[2] in kinds] and [r[3] for r in got] == sorted(r[3] for r in got)


def test_blocks_of_a_long_function_cost_a_slice_each():
    known = [python_code.levels(s) for s in ast.parse("step(x)\nif a:\n    b.c = d(1, k=2)\npass\n" * 30).body]
    got = list(python_code.shapes(known, range(5, 20)))
    assert got == [(n, i, python_code.shape(known[i : i + n])) for n in range(5, 20) for i in range(len(known) - n + 1)]


def test_suppliers_become_many_tasks_and_few_batches(spark):
    df = spark.range(1000).selectExpr("id as s_suppkey", "cast(id % 25 as int) as s_nationkey", "5000.0d as s_acctbal").coalesce(1)
    base = samples.code_base(df, "long-function")
    assert base.rdd.getNumPartitions() > 1 and base.count() == 1000
    got = code.run(code.Code(code.extract(base.withColumn("file_ord", F.lit(0)), code.KINDS["long-function"])), ["long-function"])
    assert got.count() == 1000 and got.select("file").distinct().count() == 1000
    assert code.extract(base.withColumn("file_ord", F.lit(0)), ("found",)).select("kind").distinct().collect() == [("found",)]


class Caught:
    """Stands for a frame of suppliers: keeps the functions that are to run over its batches."""

    def __init__(self, spark):
        self.sparkSession, self.maps = spark, []

    def select(self, *_):
        return self

    filter = select

    def count(self):
        return 1

    def mapInArrow(self, f, _):  # noqa: N802
        self.maps.append(f)
        return self


@pytest.mark.parametrize("name", ["test-erosion", "blast-radius"])
def test_a_worker_holds_the_commits_of_few_suppliers(spark, name):
    df = Caught(spark)
    history_samples.history(df, name)
    batch = pa.RecordBatch.from_pydict({"s_suppkey": list(range(2000)), "s_acctbal": [5000.0] * 2000})
    found = [sum(b.num_rows for b in f(iter([batch]))) for f in df.maps]
    assert max(found) >= 2000 * 27
    tracemalloc.start()
    for f in df.maps:
        for b in f(iter([batch])):
            assert b.num_rows < 5000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6


def test_files_are_numbered_in_ranges(spark):
    paths = [f"p{k % 7}/{d}m{k}.py" for k in range(300) for d in ("", "a/", "a-b/")] + ["p1.py", "p1", "p1/a"]
    df = spark.createDataFrame([(p, "x") for p in paths] + [(None, "x")], "path string, src string")
    got = code.in_order(df)
    assert [r.path for r in got.orderBy("file_ord").collect()] == sorted(paths, key=lambda p: p.split("/"))
    assert sorted(r.file_ord for r in got.collect()) == list(range(1, len(paths) + 1))
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 5 and max(r["count"] for r in sizes) < len(paths) / 3
    assert code.in_order(df.limit(0)).count() == 0
