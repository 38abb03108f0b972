"""Settings, git and the command line."""

from __future__ import annotations

import subprocess
from datetime import UTC, datetime

import pytest

from sleuthframe import __main__ as cli
from sleuthframe import config
from sleuthframe.functions import messages, paths
from sleuthframe.sources import repository as repo


@pytest.mark.parametrize(
    ("settings", "said"),
    [
        ({"odd": 1}, "no such key"), ({"skip": "a"}, "must be a list"), ({"skip": [1]}, "must be strings"), ({"check": 1}, "must be a string"), ({"min-severity": "x"}, "invalid min-severity"),
        ({"check": "x"}, "unknown check"), ({"skip": ["x"]}, "skip names"), ({"git-window": "6w"}, "git-window"), ({"commit-messages": "x"}, "commit-messages"), ({"expected-coupling": ["a"]}, "2-element"), (dict.fromkeys(["expected-coupling"], [[7, 8]]), "contain strings"),
    ],
)
def test_bad_settings(settings, said):
    with pytest.raises(config.ConfigError, match=said):
        config.validate(settings, "f", ["dead-code"])


def test_settings_files(tmp_path):
    tmp_path.joinpath("pyproject.toml").write_text('[tool.sleuthframe]\nskip = ["dead-code"]\n')
    assert config.load(tmp_path, ["dead-code"]) == {"skip": ["dead-code"]}
    tmp_path.joinpath(".sleuthframe.toml").write_text('min-severity="high"')
    assert config.load(tmp_path, []) == {"min-severity": "high"}
    (tmp_path / "sub").mkdir()
    assert config.load(tmp_path / "sub", []) == {} and config.above(tmp_path / "sub") == tmp_path


def test_exclude():
    assert repo.excluded("a/b/c.py", ["c.py"]) and repo.excluded("a/b/c.py", ["a/*"]) and repo.excluded("a/b/c.py", ["a/b/"])
    assert not repo.excluded("a/b/c.py", ["b.py", "b/*", "c.py/"])


def test_diff_lines():
    text = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,2 @@ f\n@@ -9 +9,0 @@\n@@ -1 +20 @@\n+++ /dev/null\n@@ -1 +1 @@\n"
    assert repo.parse_diff(text) == [("x.py", 3), ("x.py", 4), ("x.py", 20)]


def test_labels(spark):
    subjects = ["fix: a", "fixes it", "hotfix x", "feat(auth): b", "✅ tests", "TODO later", "WIP"]
    df = spark.createDataFrame([(s,) for s in subjects], "s string")
    got = [sorted(r[0]) for r in df.select(messages.labels(df.s)).collect()]
    assert got == [["fix"], [], ["emergency", "fix"], ["feature"], ["fix"], ["debt"], []]
    assert [r[0] for r in df.select(messages.is_good(df.s)).collect()] == [False, False, False, True, False, False, False]
    assert df.select(messages.number(df.s.isNotNull().cast("double") * 2.25, ".1f")).first()[0] == "2.2"


def test_paths(spark):
    df = spark.createDataFrame([("a/migrations/0001_x.py",), ("migrations/x/migrations/1.py",), ("tests/a.py",), ("conftest.py",), ("settings/a.py",)], "p string")
    rows = df.select(paths.is_migration(df.p), paths.is_test(df.p), paths.is_test_history(df.p), paths.is_settings(df.p)).collect()
    assert [tuple(r) for r in rows] == [(True, False, False, False), (False, False, False, False), (False, True, False, False), (False, True, False, False), (False, False, False, True)]


@pytest.fixture
def project(tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=ann", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.py").write_text("def orphan():\n    return 1\n\n\ndef spare():  # sleuthframe: ignore[dead-code]\n    return 2\n")
    (tmp_path / "b.py").write_text("class Lost" + "Error(Exception):\n    pass\n")
    git("add", ".")
    git("commit", "-qm", "feat: a first version")
    for i in range(4):
        (tmp_path / "a.py").write_text((tmp_path / "a.py").read_text() + f"# {i}\n")
        git("commit", "-qam", f"fix: the case {i}")
    git(*"commit -q --allow-empty -m done -m".split(), f"{repo.REVIEW} b.py")
    return tmp_path


def test_analyze(spark, project, capsys):
    assert cli.main(["analyze", str(project), "--check", "dead-code"], spark) == 1
    out = capsys.readouterr().out
    assert "a.py:1: orphan() has no callers" in out and "spare" not in out and "Total: 1 finding(s)" in out
    assert cli.main(["analyze", str(project), "--check", "dead-code", "--diff", "HEAD"], spark) == 0
    assert "All checks passed." in capsys.readouterr().out
    assert cli.main(["analyze", str(project), "--check", "none"], spark) == 1
    assert cli.main(["analyze", "--list-checks"], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 54


def test_git_history(spark, project, capsys):
    assert cli.main(["git-history", str(project), "--check", "bug-magnet"], spark) == 1
    assert "a.py — 4 of 5 commits (80%) are fixes" in capsys.readouterr().out
    log = repo.log(spark, project, 180)
    assert log["commits"].count() == 5 and {r.path for r in log["reviews"].collect()} == {"b.py"}
    assert log["numstat"].filter("path = 'a.py'").count() == 5


def test_reviewed(spark, project, capsys, monkeypatch):
    monkeypatch.chdir(project)
    for k in ("user.name", "user.email"):
        subprocess.run(["git", "config", k, "ann@x"], check=True)
    (project / "pkg").mkdir()
    (project / "pkg" / "c.py").write_text("x = 1\n")
    (project / "empty").mkdir()
    assert cli.main(["git-history", "reviewed"]) == 1 and cli.main(["git-history", "reviewed", "none.py"]) == 1 and cli.main(["git-history", "reviewed", "empty"]) == 1
    assert "doesn't exist" in capsys.readouterr().err
    assert cli.main(["git-history", "reviewed", "a.py", "pkg"]) == 0 and "Marked 2 file(s)" in capsys.readouterr().out
    assert {r.path for r in repo.log(spark, project, 180)["reviews"].collect()} == {"a.py", "b.py", "pkg/c.py"}
    assert cli.main(["git-history", str(project), "--check", "bug-magnet"], spark) == 0
    assert cli.main(["git-history", str(project), "--check", "bug-magnet", "--ignore-reviewed", "--no-context"], spark) == 1
    out = capsys.readouterr().out
    assert "a.py — 4 of 5 commits" in out and cli.NOTES["git-history"] not in out


def test_version_and_list(capsys):
    with pytest.raises(SystemExit):
        cli.main(["--version"])
    assert capsys.readouterr().out.startswith("sleuthframe ")
    assert cli.main(["git-history", "--list-checks"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 17 and all("[history]" in x and len(x) > 60 for x in lines)


def test_no_repository(spark, tmp_path):
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv" / "x.py").write_text("")
    (tmp_path / "m.py").write_text("x = 1")
    assert [p.name for p in repo.listing(tmp_path)] == ["m.py"]
    assert [r.path for r in repo.tree(spark, str(tmp_path)).collect()] == ["m.py"]
    with pytest.raises(repo.NotARepository):
        repo.top(tmp_path)
    assert repo.changed(spark, tmp_path, "HEAD") is None


def test_reviews_table(spark):
    old = spark.createDataFrame([], "path string, ts timestamp")
    assert [r.path for r in repo.mark_reviewed(old, ["a.py"], datetime(2024, 1, 1, tzinfo=UTC)).collect()] == ["a.py"]


def test_stream(spark, tmp_path):
    from sleuthframe.streaming.commits import COMMIT, activity

    rows = [("h1", datetime(2024, 1, 1), "ann", "fix: a", ["a.py", None]), ("h1", datetime(2024, 1, 1), "ann", "fix: a", ["a.py"]), ("h2", datetime(2024, 1, 2), "bob", "add b", ["a.py", "b.py"]), ("h3", None, "bob", "x", ["a.py"])]
    df = spark.createDataFrame(rows, COMMIT)
    want = sorted((r.path, r.commits, r.fixes) for r in activity(df).collect())
    assert want == [("a.py", 2, 1), ("b.py", 1, 0)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = activity(spark.readStream.schema(COMMIT).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("weeks").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.path, r.commits, r.fixes) for r in spark.sql("select * from weeks").collect()) == want


def test_streams_of_bursts_fixes_and_reviews(spark, tmp_path):
    from datetime import timedelta

    from sleuthframe.streaming.commits import COMMIT, bursts, fixes_after_features, unreviewed

    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    rows = [("f1", day(0), "ann", "feat: add a", ["a.py", "b.py"]), ("x1", day(3), "ann", "fix: mend a", ["a.py"]), ("x2", day(5), "bob", "fix: mend a again", ["a.py"]), ("x3", day(40), "bob", "fix: mend b", ["b.py"]), ("x4", day(41), "bob", "docs: say more", ["a.py", None]), ("x5", None, "bob", "fix: no time", ["a.py"])]
    df = spark.createDataFrame(rows, COMMIT)
    reviews = spark.createDataFrame([("a.py", day(4)), ("a.py", day(1))], "path string, ts timestamp")
    plans = {"bursts": lambda d: bursts(d), "fixes": lambda d: fixes_after_features(d), "since": lambda d: bursts(unreviewed(d, reviews), least=1)}
    want = {k: sorted(map(tuple, f(df).collect())) for k, f in plans.items()}
    assert want["bursts"] == [("a.py", day(0), day(12), 3)]
    assert want["fixes"] == [("a.py", "f1", "x1", day(0), day(3)), ("a.py", "f1", "x2", day(0), day(5))]
    assert [(p, a, n) for p, a, _, n in want["since"]] == [("a.py", day(5), 1), ("a.py", day(41), 1), ("b.py", day(0), 1), ("b.py", day(40), 1)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    # A last commit, much later, lets the watermark pass all others.
    spark.createDataFrame([("z", day(400), "ann", "end", ["z.py"])], COMMIT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k, f in plans.items():
        q = f(spark.readStream.schema(COMMIT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(f"s_{k}").outputMode("append").option("checkpointLocation", str(tmp_path / k)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.sql(f"select * from s_{k} where path <> 'z.py'").collect())) == want[k], k
