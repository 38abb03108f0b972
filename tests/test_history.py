"""History checks at the edges of their thresholds, on rows made here: many files in one history for each check."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest

from sleuthframe.plans import history

START = datetime(2024, 1, 1, tzinfo=UTC)
COMMITS = "hash string, seq int, ts timestamp, ts_raw string, author string, subject string"


class Log:
    """Commits put down one by one; days count from the first of January."""

    def __init__(self, **files: int):
        self.files = {k.replace("__", "/") + ".py": n for k, n in files.items()}
        self.commits: list[tuple] = []
        self.touched: list[tuple] = []
        self.stats: list[tuple] = []
        self.reviews: list[tuple] = []

    def add(self, day: float, subject: str, *paths: str, author: str = "ann", ins: int = 0, dels: int = 0) -> None:
        ts = START + timedelta(days=day)
        h = f"{len(self.commits):040x}"
        self.commits.append((h, ts, ts.isoformat(), author, subject))
        for p in paths:
            self.touched.append((h, p))
            if ins or dels:
                self.stats.append((h, p, ins, dels))

    def many(self, n: int, subject: str, *paths: str, first: float = 0, step: float = 1, **more) -> None:
        for i in range(n):
            self.add(first + i * step, f"{subject} number {i}", *paths, **more)

    def run(self, spark, check: str, **more) -> dict[str, str]:
        newest = sorted(range(len(self.commits)), key=lambda i: self.commits[i][1], reverse=True)
        commits = [(self.commits[i][0], k, *self.commits[i][1:]) for k, i in enumerate(newest)]
        order = sorted(self.files, key=lambda p: p.split("/"))
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        h = history.History(
            frame([(i, p, self.files[p]) for i, p in enumerate(order)], "file_ord long, path string, n_lines_ast int"), frame(commits, COMMITS), frame(self.touched, "hash string, path string"),
            frame(self.stats, "hash string, path string, ins int, del int"), frame(self.reviews, "path string, ts timestamp"), frame([], "path string, module string, level int, from_import boolean"), **more,
        )
        return {r.file: r.message for r in history.run(h, [check]).collect()}


FIX, FEAT = "fix: repair the case", "feat: add the thing"


def test_bug_magnet(spark):
    log = Log(half=9, less=9, few=9, test_a=9, bulk=9, old=9, since=9)
    log.many(5, FIX, "half.py")
    log.many(5, FEAT, "half.py")
    log.many(4, FIX, "less.py")
    log.many(5, FEAT, "less.py")
    log.many(4, FIX, "few.py")
    log.many(8, FIX, "test_a.py")
    for k in range(8):  # 30 files and more don't count
        log.add(k, f"{FIX} {k}", "bulk.py", *(f"b{j}.py" for j in range(29)))
    log.many(8, FIX, "old.py")
    log.many(8, FIX, "since.py", first=10)
    log.reviews = [("old.py", START + timedelta(days=9)), ("since.py", START + timedelta(days=12))]
    got = log.run(spark, "bug-magnet")
    assert set(got) == {"half.py", "since.py"} and "5 of 10" in got["half.py"] and "(50%)" in got["half.py"] and "5 of 5" in got["since.py"]
    assert log.run(spark, "bug-magnet", messages="unstructured") == {}


def test_messages_that_say_nothing_gate(spark):
    log = Log(a=9)
    log.many(8, "fix: b", "a.py")
    assert set(log.run(spark, "bug-magnet", messages="structured")) == {"a.py"}
    log = Log(a=9)
    for k in range(10):
        log.add(k, "wip" if k % 2 else f"{FIX} {k}", "a.py")
    assert set(log.run(spark, "bug-magnet")) == {"a.py"}  # half of them is enough
    log.add(11, "wip", "a.py")
    assert log.run(spark, "bug-magnet") == {}


def test_fix_propagation(spark):
    log = Log()
    log.files = {"a.py": 9, "b.py": 9, "c.py": 9, "d.py": 9, "e.py": 9, "f.py": 9, "pkg/__init__.py": 9, "test_a.py": 9} | {f"x{j}.py": 9 for j in range(18)}
    log.many(3, FIX, "a.py", "b.py")
    log.many(2, FIX, "b.py")  # the smaller count is a's
    log.many(2, FIX, "c.py", "d.py")
    log.many(3, FIX, "e.py", "f.py")
    log.many(3, FIX, "e.py")
    log.many(3, FIX, "f.py")  # three of six is below three fifths
    log.many(3, FIX, "a.py", "pkg/__init__.py", "test_a.py")  # neither packages nor a test with its source
    for k in range(3):
        log.add(k, f"{FIX} {k}", "c.py", "f.py", *(f"x{j}.py" for j in range(18)))  # twenty files are too many for pairs
    got = log.run(spark, "fix-propagation")
    assert list(got) == ["a.py"] and "a.py and b.py — 3 of 5 fix commits" in got["a.py"]


def test_change_coupling(spark):
    log = Log()
    log.files = {p: 9 for p in ("a.py", "b.py", "c.py", "d.py", "e.py", "f.py", "test_a.py")}
    log.many(5, FEAT, "a.py", "b.py")
    log.many(2, FEAT, "a.py")
    log.many(2, FEAT, "b.py")  # five of seven
    log.many(4, FEAT, "c.py", "d.py")
    log.many(5, FEAT, "e.py", "f.py", "test_a.py")
    log.many(3, FEAT, "e.py")
    log.many(3, FEAT, "f.py")  # five of eight
    assert set(log.run(spark, "change-coupling")) == {"a.py"}
    assert log.run(spark, "change-coupling", expected=[["b.py", "a*"]]) == {}


def test_blast_radius(spark):
    log = Log(wide=9, eight=9, few=9, test_w=9)
    for k in range(40):
        log.add(k, f"{FEAT} {k}", "small.py")
    others = lambda n, k: [f"o{k}_{j}.py" for j in range(n)]
    for k in range(5):
        log.add(k, f"{FEAT} w{k}", "wide.py", *others(8, k))
        log.add(k, f"{FEAT} e{k}", "eight.py", *others(7, k))
        log.add(k, f"{FEAT} t{k}", "test_w.py", *others(9, k))
        if k < 4:
            log.add(k, f"{FEAT} f{k}", "few.py", *others(9, k))
        log.add(k, f"{FEAT} x{k}", "few.py", *others(20, k))  # too large to count
    got = log.run(spark, "blast-radius")
    assert set(got) == {"wide.py"} and "median of 8" in got["wide.py"]


def test_stabilization_failure(spark):
    log = Log(three=9, two=9, few=9, last=9)
    log.add(0, "start", "last.py")
    log.add(170, "end", "last.py")
    for path, bursts, each in (("three.py", 3, 3), ("two.py", 2, 5), ("few.py", 3, 1)):
        for b in range(bursts):
            for k in range(2):  # two slices of a week in a row
                for j in range(each if k else 1):
                    log.add(28 * b + 7 * k + 0.1 * j, "work", path)
    got = log.run(spark, "stabilization-failure")
    assert set(got) == {"three.py"} and "3 activity bursts" in got["three.py"]


@pytest.mark.parametrize(("check", "rows"), [
    ("yo-yo-code", {"yes": (100, 5, 30, 30), "less": (100, 5, 30, 29), "short": (99, 5, 60, 60), "few": (100, 4, 90, 90), "test_y": (100, 5, 60, 60)}),
    ("churn-without-growth", {"yes": (50, 10, 10, 10), "ten": (100, 10, 2, 1), "more": (50, 10, 2, 1), "few": (50, 9, 9, 9), "short": (49, 10, 9, 9), "shrunk": (80, 10, 1, 5)}),
    ("growth-trajectory", {"yes": (400, 1, 200, 0), "small": (398, 1, 199, 0), "slow": (500, 1, 249, 0), "new": (300, 1, 300, 0), "short": (99, 1, 98, 0)}),
])
def test_churn(spark, check, rows):
    """Of each file its lines, commits, and the lines that each adds and deletes."""
    log = Log(**{k: v[0] for k, v in rows.items()})
    for k, (_, n, ins, dels) in rows.items():
        log.many(n, "work on it", f"{k}.py", ins=ins, dels=dels)
    want = {"yo-yo-code": {"yes.py"}, "churn-without-growth": {"yes.py", "ten.py", "shrunk.py"}, "growth-trajectory": {"yes.py"}}
    got = log.run(spark, check)
    assert set(got) == want[check]
    log.reviews = [(p, START + timedelta(days=60)) for p in got]
    assert log.run(spark, check) == {}


def test_emergency_and_debt(spark):
    log = Log(hot=9, calm=9, one=9, debt=9)
    log.many(3, "hotfix the outage", "hot.py")
    log.many(7, "add more of it", "hot.py")
    log.many(3, "hotfix the outage", "calm.py")
    log.many(8, "add more of it", "calm.py")
    log.many(2, "hotfix the outage", "one.py")
    log.many(20, "add something else", "other.py")
    got = log.run(spark, "emergency-hotspots")
    assert set(got) == {"hot.py"} and "3 of 10" in got["hot.py"]
    log.many(40, "hotfix all over", "other.py")  # where hotfixes are the rule, none stands out
    assert log.run(spark, "emergency-hotspots") == {}
    log.add(3, "temporary workaround for the cache", "debt.py")
    got = log.run(spark, "conscious-debt", messages="structured")
    assert set(got) == {"debt.py"} and "temporary workaround for the cache" in got["debt.py"]


def test_no_refactoring(spark):
    log = Log(yes=50, short=49, tidy=50, few=50, other=50)
    for p in ("yes", "short", "tidy", "other"):
        log.many(5, FIX, f"{p}.py")
    for p in ("yes", "short"):
        log.many(1, FEAT, f"{p}.py")
        log.many(2, "docs: say more about it", f"{p}.py")
    log.many(2, FEAT, "tidy.py")
    log.many(1, "refactor: split the module", "tidy.py")
    log.many(3, "docs: say more about it", "other.py")
    log.many(7, FIX, "few.py")
    got = log.run(spark, "no-refactoring")
    assert set(got) == {"yes.py"} and "8 commits (5 fixes, 1 features)" in got["yes.py"]


def test_test_erosion(spark):
    log = Log(a=50, test_a=9, b=50, test_b=9, c=50, d=49, test_d=9, pkg__e=50, pkg__tests__test_e=9, few=50, test_few=9)
    log.many(6, "work on it", "a.py")
    log.many(2, "test it", "test_a.py")
    log.many(5, "work on it", "b.py")
    log.many(2, "test it", "test_b.py")
    log.many(9, "work on it", "c.py")  # has no test file
    log.many(9, "work on it", "d.py")
    log.many(5, "work on it", "pkg/e.py")
    log.many(4, "work on it", "few.py")
    assert set(log.run(spark, "test-erosion")) == {"a.py", "pkg/e.py"}


def test_abandoned_code(spark):
    log = Log(p__a=20, p__b=20, p__c=20, p__short=19, q__a=20, q__b=20, r__a=20, r__b=20, r__c=20, p__d=20, p__e=20, p__f=20)
    for f in ("a", "b", "d", "e", "f"):
        log.add(1, "work on it", f"p/{f}.py")
    log.add(1, "work on it", "q/a.py")  # two in all are too few
    log.add(1, "work on it", "r/a.py")  # one of three is less than two thirds
    got = log.run(spark, "abandoned-code")
    assert set(got) == {"p/c.py"} and "5 of 7 peers" in got["p/c.py"]
    log.reviews = [("p/c.py", START + timedelta(days=2))]
    assert log.run(spark, "abandoned-code") == {}


def test_knowledge_silo(spark):
    log = Log(one=9, shared=9, few=9, test_k=9)
    log.many(4, "work", "one.py", author="ann")
    log.many(1, "work", "one.py", author="bob")
    log.many(7, "work", "shared.py", author="ann")
    log.many(2, "work", "shared.py", author="bob")
    log.many(4, "work", "few.py", author="ann")
    log.many(9, "work", "test_k.py", author="ann")
    assert log.run(spark, "knowledge-silo") == {}  # two authors are no team
    log.many(1, "work", "other.py", author="cid")
    got = log.run(spark, "knowledge-silo")
    assert set(got) == {"one.py"} and "ann authored 4 of 5 commits (80%)" in got["one.py"]


def test_divergent_change(spark):
    log = Log(many=50, three=50, short=49, settings=50)
    for k, s in enumerate(("auth", "bill", "mail", "shop")):
        for p in ("many", "short", "settings"):
            log.many(2, f"feat({s}): add a part", f"{p}.py", first=k)
        if k < 3:
            log.many(2, f"feat({s}): add a part", "three.py", first=k)
    log.many(1, "feat(once): add a part", "three.py")
    got = log.run(spark, "divergent-change")
    assert "many.py" in got and "4 different concerns (auth, bill, mail, shop)" in got["many.py"] and not {"three.py", "short.py"} & set(got)


def test_hotspot_acceleration(spark):
    log = Log(faster=9, steady=9, few=9, fresh=9)
    log.add(0, "start", "x.py")
    log.add(55.9, "end", "x.py")  # eight slices of a week
    for week in range(8):
        late = week >= 4
        log.many(2 if late else 1, "work", "faster.py", first=7 * week + 1, step=0.1)
        log.many(2, "work", "steady.py", first=7 * week + 1, step=0.1)
        log.many(2 if late else 0, "work", "fresh.py", first=7 * week + 1, step=0.1)
        log.many(1 if late else 0, "work", "few.py", first=7 * week + 1)
    got = log.run(spark, "hotspot-acceleration")
    assert set(got) == {"faster.py", "fresh.py"} and "median 1→2" in got["faster.py"] and "median 0→2" in got["fresh.py"]


def test_fix_follows_feature(spark):
    log = Log(three=9, two=9, late=9)
    log.add(0, "docs: say how it starts", "x.py")
    log.add(83.9, "docs: say how it ends", "x.py")
    for w in range(12):
        log.many(2, "docs: say more about it", "x.py", first=7 * w + 1, step=0.1)
    for k in range(3):
        log.add(28 * k + 1, f"{FEAT} {k}", "three.py")
        log.add(28 * k + 15, f"{FIX} {k}", "three.py")  # two slices later
        log.add(28 * k + 1, f"{FEAT} {k}", "late.py")
        log.add(28 * k + 22.5, f"{FIX} {k}", "late.py")  # three slices later
        if k < 2:
            log.add(28 * k + 1, f"{FEAT} {k}", "two.py")
            log.add(28 * k + 8, f"{FIX} {k}", "two.py")
    got = log.run(spark, "fix-follows-feature")
    assert set(got) == {"three.py"} and "3 feature" in got["three.py"]
