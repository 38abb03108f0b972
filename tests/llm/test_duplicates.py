"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sleuthframe.cluster import BATCH_ROWS, Scratch
from sleuthframe.llm import near_dup, repeats
from sleuthframe.llm.common import WORD, Hashed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}" for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "rt ln sk mp nd st vo xi qu ze".split()]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(30)) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts], DOCS)


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else prose(rng, 1) for w in text.split())


@pytest.fixture(scope="module")
def texts():
    """Prose with copies, edited copies, parts of larger documents and a passage that many share."""
    rng = random.Random(5)
    shared = prose(rng, 60)
    out = []
    for i in range(60):
        t = prose(rng, rng.choice([30, 80, 200, 400]))
        if i % 4 == 0:
            t = f"{t} {shared} {prose(rng, 40)}"
        out.append((i, t))
    for k, i in enumerate(range(0, 24)):
        out.append((100 + k, edited(rng, out[i][1], 0.03)))
    for k, i in enumerate(range(24, 34)):
        out.append((200 + k, out[i][1]))
    for k, i in enumerate(range(34, 42)):
        out.append((300 + k, f"{prose(rng, 150)} {out[i][1]} {prose(rng, 20)}"))
    rng.shuffle(out)
    return out


def sets(texts):
    return {i: set(Hashed(t).runs(near_dup.SHINGLE).tolist()) for i, t in texts}


def brute(texts):
    """Of each redundant document, how many different sets are linked to its own."""
    s = sets(texts)
    later = lambda i: (i is None, (i or 0) < 0, i or 0)
    kinds = {}
    for i, x in sorted(s.items(), key=lambda p: later(p[0])):
        if x:
            kinds.setdefault(frozenset(x), []).append(i)
    out = {}
    for a, own in kinds.items():
        up = [b for b in kinds if b != a and len(b) >= len(a) and len(a & b) >= near_dup.THRESHOLD * len(a)]
        down = [b for b in kinds if len(b) < len(a) and len(a & b) >= near_dup.THRESHOLD * len(b)]
        redundant = any(len(b) > len(a) or later(kinds[b][0]) < later(own[0]) for b in up)
        out |= {i: len(up) + len(down) for i in (own if redundant else own[1:])}
    return out


def test_near_duplicates_against_brute_force(spark, texts):
    s, want = sets(texts), brute(texts)
    got = near_dup.groups(frame(spark, texts)).collect()
    found = {r.doc_id: r.n_links for r in got}
    assert len(found) == len(got)
    for r in got:
        assert len(s[r.doc_id] & s[r.container_id]) / len(s[r.doc_id]) == pytest.approx(r.containment, abs=1e-3) and r.containment >= near_dup.THRESHOLD
        assert r.kept_id not in found
    assert set(found) <= set(want) and len(found) >= near_dup.RECALL * len(want)
    assert sum(found.values()) >= near_dup.RECALL * sum(want.values()) and all(n <= want[i] for i, n in found.items())


def test_the_stage_drops_what_groups_names(spark, texts):
    rng = random.Random(22)
    lines = [prose(rng, 9) for _ in range(4)]
    rows = texts + [(1000 + i, f"{prose(rng, i % 6)} {rng.choice(lines)}") for i in range(60)] + [(2000 + i, f"{prose(rng, 100)} {rng.choice(lines)}") for i in range(20)]
    df = frame(spark, rows)
    gone = {r.doc_id for r in near_dup.groups(df).collect()}
    kept = {r.doc_id for r in near_dup.drop_near_duplicates(spark, df, "").collect()}
    assert kept == {i for i, _ in rows} - gone and len(gone) > 60


def test_near_copies_of_one_text_are_counted_without_a_row_for_each_pair(spark, monkeypatch):
    """All links of 300 near copies, of 250 small documents with one line and of what contains them; no table of the search has a row for each."""
    rng = random.Random(31)
    base, line = prose(rng, 120), prose(rng, 14)
    rows = [(i, edited(rng, base, 0.01)) for i in range(300)]
    rows += [(1000 + i, f"{prose(rng, rng.randrange(1, 4))} {line}") for i in range(250)] + [(2000 + i, f"{prose(rng, 100)} {line}") for i in range(50)]
    rows += [(3000 + i, f"{prose(rng, 90)} {base} {prose(rng, 90)}") for i in range(20)]
    sizes, write = [], near_dup.Scratch.table

    def counted(self, df, *kind):
        out = write(self, df, *kind)
        if "band" not in out.columns and "key" not in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(near_dup.Scratch, "table", counted)
    want = brute(rows)
    assert {r.doc_id: r.n_links for r in near_dup.groups(frame(spark, rows)).collect()} == want
    assert sum(want.values()) > 100_000 and max(sizes) < 10 * len(rows)


@pytest.mark.parametrize("limits", [{}, {"CELL": 500, "CELL_WORDS": 3000}, {"DENSE": 900}])
def test_cells_of_any_size_and_split_count_the_same(spark, texts, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(near_dup, k, v)
    want = {tuple(r) for r in near_dup.groups(frame(spark, texts)).collect()}
    found = {r[0]: r[4] for r in want}
    assert found == {i: n for i, n in brute(texts).items() if i in found} and len(found) >= near_dup.RECALL * len(brute(texts))


def test_small_documents_lose_nothing(spark):
    rng = random.Random(21)
    lines = [prose(rng, 9) for _ in range(6)]
    rows = [(i, f"{prose(rng, rng.randrange(0, 6))} {rng.choice(lines)} {prose(rng, rng.randrange(0, 6))}") for i in range(150)]
    rows += [(200 + i, " ".join([prose(rng, 100), *rng.sample(lines, 3), prose(rng, 40)])) for i in range(60)]
    assert {r.doc_id: r.n_links for r in near_dup.groups(frame(spark, rows)).collect()} == brute(rows)


def test_a_passage_that_all_share_pairs_nothing(spark):
    rng = random.Random(9)
    shared = prose(rng, 60)
    rows = [(i, f"{prose(rng, 60)} {shared}") for i in range(80)]
    assert near_dup.groups(frame(spark, rows)).count() == 0


def test_near_duplicate_edges(spark):
    long = prose(random.Random(1), 30_000)
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "one two"), (5, "one two"), (6, long), (7, long), (None, long), (-3, "one two"), (8, None)]
    got = {(r.doc_id, r.kept_id) for r in near_dup.groups(frame(spark, rows)).collect()}
    assert got == {(5, 4), (-3, 4), (7, 6), (None, 6)}
    kept = near_dup.drop_near_duplicates(spark, frame(spark, rows).withColumnRenamed("lang", "uid").withColumnRenamed("source", "__uid"), "")
    assert kept.columns == ["doc_id", "text", "uid", "__uid", "n_chars"]
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 6, 8)]
    assert near_dup.groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("names", [("doc_id", "Text", "h", "__UID", "n"), ("DOC_ID", "text", "cid", "g", "c0")])
def test_clashing_names(spark, names):
    rows = [(1, "a b c d e f", "x", "y", 7), (2, "a b c d e f", "x", "y", 8), (2, "a b c d e f", "x", "y", 8), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).toDF(*names)
    assert [(r.doc_id, r.kept_id) for r in near_dup.groups(df).collect()] == [(2, 1)]
    kept = near_dup.drop_near_duplicates(spark, df, "")
    assert kept.columns == list(names) and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[3]]


def test_many_texts_under_one_id_all_stay(spark):
    rows = [(7, f"text{i} number{i} with words{i} of its own{i} only{i}") for i in range(40_000)]
    kept = near_dup.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert kept.count() == 40_000


def test_the_least_id_stays_whatever_its_size(spark):
    rng = random.Random(3)
    bases = [0, 1 << 38, 1 << 40, (1 << 63) - 9, -(1 << 63)]
    rows = [(base + i, text) for base in bases for text in [prose(rng, 90)] for i in range(8)]
    kept = near_dup.drop_near_duplicates(spark, frame(spark, rows), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(bases)


def test_plans_reach_recall():
    assert near_dup.jaccard(0.6, 100, 100) == pytest.approx(0.6 / 1.4)
    for p in range(6, 20):
        bands, hits = near_dup.PLAN[p]
        for n in (max(near_dup.ALL + 1, 2**p), 2 ** (p + 1) - 1):
            n = min(n, 1 << 14)
            assert near_dup.chance(n, -(-n * 6 // 10), bands, hits) >= near_dup.RECALL
    assert near_dup.PLAN[6][0] < near_dup.PLAN[9][0] < near_dup.PLAN[12][0] and near_dup.PLAN[6][1] > 1


def test_packing():
    s = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 99, dtype=np.uint64))
    assert (near_dup.unpacked(near_dup.packed(s[:40]), near_dup.packed(s[40:])) == s).all() and not len(near_dup.unpacked(b""))


def test_blocks_of_the_filter_come_back_and_are_short():
    rng = np.random.default_rng(3)
    for many in (0, 1, 1_250, 30_000, 1 << 19):
        bits = np.zeros(1 << 19, np.uint8)
        bits[rng.choice(1 << 19, many, replace=False)] = 1
        block = np.packbits(bits, bitorder="little")
        data = near_dup.sparse(block)
        assert (near_dup.dense(data, len(block)) == block).all()
        assert many not in (0, 1_250, 30_000) or len(data) == 2 * many


def test_one_that_asks_where_it_lives_takes_no_words_along(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 200)
    docs = [(k, edited(rng, base, 0.02)) for k in range(60)]
    home = spark.sparkContext.accumulator(0)
    plain = near_dup.Cell.add

    def counted(self, asks, row):
        home.add(int(asks and row[8] is None))
        return plain(self, asks, row)

    class Counted(near_dup.Cell):
        add = counted

    monkeypatch.setattr(near_dup, "Cell", Counted)
    got = {r.doc_id: r.n_links for r in near_dup.groups(frame(spark, docs)).collect()}
    assert got == brute(docs)
    # One that lives alone in its cell doesn't ask there.
    assert home.value > len(docs) / 2


@pytest.mark.parametrize("n", [0, 1, 65, 700, 8_191, 8_192, 50_000])
def test_coded_words_come_back_and_are_short(n):
    s = np.unique(np.r_[0, (1 << 32) - 1, np.random.default_rng(n).integers(0, 1 << 32, 2 * n)].astype("<u4"))[:n] if n else np.zeros(0, "<u4")
    for x in (s, np.sort(~s)):
        assert (near_dup.decoded(near_dup.coded(x)) == x).all() and len(near_dup.decoded(near_dup.coded(x))) == n
        assert n < 700 or len(near_dup.coded(x)) < 0.82 * 4 * n


def test_sets_as_large_as_the_texts_are_not_written(spark, monkeypatch):
    """What the search has in its folder at any time, with texts that resemble none and with near copies."""
    rng = random.Random(41)
    base = prose(rng, 800)
    rows = [(i, prose(rng, 800)) for i in range(200)] + [(1000 + i, edited(rng, base, 0.02)) for i in range(60)]
    most, write = [], near_dup.Scratch.table

    def measured(self, df, *kind):
        out = write(self, df, *kind)
        most.append(sum(p.stat().st_size for p in Path(self.at.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(near_dup.Scratch, "table", measured)
    assert {r.doc_id: r.n_links for r in near_dup.groups(frame(spark, rows)).collect()} == brute(rows)
    assert 0 < max(most) < 0.4 * sum(len(t) for _, t in rows)


def test_filters_that_let_all_through_change_nothing(spark, texts, monkeypatch):
    want = {tuple(r) for r in near_dup.groups(frame(spark, texts)).collect()}
    monkeypatch.setattr(near_dup, "among", lambda keys, shared: np.ones(len(keys), bool))
    assert {tuple(r) for r in near_dup.groups(frame(spark, texts)).collect()} == want and want


def test_containers_many_times_as_large(spark):
    """Documents contained whole and edited, in ones of 2 to 256 times their size; recall counts for each ratio."""
    rng = random.Random(16)
    rows, inside = [], {}
    for ratio in (2, 8, 16, 32, 64, 128, 256):
        for share in (0.0, 0.04):
            parts = [prose(rng, 130) for _ in range(40)]
            at, base = min(4, max(1, ratio // 2)), 10_000 * ratio + (1000 if share else 0)
            rows += [(base + i, edited(rng, t, share)) for i, t in enumerate(parts)]
            rows += [(base + 100 + k, f"{' '.join(parts[k::40 // at][:at])} {prose(rng, 130 * (ratio - at))}") for k in range(40 // at)]
            inside |= {base + i: base + 100 + i % (40 // at) for i in range(40)}
    s = sets(rows)
    want = {i for i, x in inside.items() if len(s[i] & s[x]) >= near_dup.THRESHOLD * len(s[i])}
    got = {r.doc_id for r in near_dup.groups(frame(spark, rows)).collect()}
    assert got <= want
    for ratio in {i // 10_000 for i in want}:
        for odd in (0, 1):
            some = {i for i in want if i // 10_000 == ratio and i // 1000 % 10 == odd}
            assert len(some) >= (30 if odd else 40) and len(got & some) >= near_dup.RECALL * len(some) - 1


def test_other_documents_in_a_bucket_hide_no_container(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        a, b, c = prose(rng, 100), prose(rng, 100), prose(rng, 400)
        rows += [(10 * i, f"{a} {b}"), (10 * i + 1, f"{a} {prose(rng, 150)}"), (10 * i + 2, f"{prose(rng, 150)} {b}"), (10 * i + 3, f"{c[:900]} {a} {b} {c[900:]}"), (10 * i + 4, f"{a} {prose(rng, 900)}")]
    got = {r.doc_id: r.container_id for r in near_dup.groups(frame(spark, rows)).collect()}
    assert got == {10 * i: 10 * i + 3 for i in range(40)}


def test_a_batch_of_texts_is_not_held_as_python_objects():
    texts = ["x" * 10_000] * 4_000
    whole = range(len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(whole), pa.array(whole), pa.array(texts), pa.array([[i] for i in whole])], ["uid", "doc_id", "text", "keys"])
    tracemalloc.start()
    try:
        assert [r[0] for r in repeats.text_rows(iter([batch]))] == list(whole)
        assert tracemalloc.get_traced_memory()[1] < 8_000_000
    finally:
        tracemalloc.stop()


def test_scratch_tables_are_written_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["rows"])

    df = spark.range(0, 5000, 1, 1).mapInArrow(run, "rows long")
    with Scratch(spark) as s:
        for kept in (s.table(df), s.result(df)):
            got = [r.rows for r in kept.collect()]
            assert sum(got) == 5000 and max(got) <= BATCH_ROWS
    assert spark.conf.get(key) == before


def covered(texts):
    """Of each document, the words in windows that occur before it, by id and place."""
    n = repeats.LENGTH
    seen: set[tuple] = set()
    whole: dict[str, int] = {}
    out: dict[int, set[int]] = {}
    for i, t in sorted(set(texts)):
        words = [w.lower() for w in WORD.findall(t)]
        own = out.setdefault(i, set())
        if t in whole:
            if len(words) >= n:
                own |= set(range(len(words)))
            continue
        whole[t] = i
        for at in range(len(words) - n + 1):
            w = tuple(words[at : at + n])
            if w in seen:
                own |= set(range(at, at + n))
            seen.add(w)
    return {i: x for i, x in out.items() if x}


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(3)
    a, b, short = prose(rng, 70), prose(rng, 120), prose(rng, 49)
    out = []
    for i in range(40):
        t = prose(rng, rng.choice([20, 60, 150]))
        if i % 3 == 0:
            t += f" {a} {prose(rng, 10)}"
        if i % 5 == 0:
            t = f"{b} {t}"
        if i % 7 == 0:
            t = f"{short} {t} {short}"
        out.append((i, t))
    out += [(50, f"{a}, {a}!"), (51, out[3][1]), (52, out[4][1]), (53, "na " * 200), (54, f"{a.upper()} x"), (55, out[0][1])]
    return out


def test_suffix_spans_against_brute_force(spark, passages):
    got: dict[int, set[int]] = {}
    for r in repeats.repeated_spans(frame(spark, passages)).collect():
        assert r.n_words == r.end_word - r.start_word >= repeats.LENGTH and r.source_ids
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == covered(passages)


def test_seed_and_extend_against_brute_force(spark, passages):
    words = {i: [w.lower() for w in WORD.findall(t)] for i, t in passages}
    got: dict[int, set[int]] = {}
    for r in repeats.maximal_repeats(frame(spark, passages)).collect():
        a, b = words[r.doc_id][r.start_word : r.end_word], words[r.other_id][r.other_start_word : r.other_start_word + r.n_words]
        assert a == b and len(a) == r.n_words >= repeats.LENGTH
        assert (r.other_id, r.other_start_word) < (r.doc_id, r.start_word)
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == covered(passages)


def test_no_repeat_can_be_extended(spark, passages):
    rng = random.Random(6)
    p, q = prose(rng, 200), prose(rng, 200)
    nested = [(1000, f"{prose(rng, 30)} {p} {prose(rng, 30)}"), (1001, f"{p} {q}"), (1002, f"{prose(rng, 9)} {p} {q} end")]
    rows = passages + nested
    words = {i: [w.lower() for w in WORD.findall(t)] for i, t in rows}
    got = repeats.maximal_repeats(frame(spark, rows)).collect()
    assert len(set(got)) == len(got)
    for r in got:
        a, b, d = words[r.doc_id], words[r.other_id], r.start_word - r.other_start_word
        assert not r.other_start_word or not r.start_word or a[r.start_word - 1] != b[r.other_start_word - 1]
        assert r.end_word == len(a) or r.end_word - d == len(b) or a[r.end_word] != b[r.end_word - d]
    assert {(r.start_word, r.n_words, r.other_id, r.other_start_word) for r in got if r.doc_id == 1002} == {(9, 200, 1000, 30), (9, 400, 1001, 0)}


def test_repeat_edges(spark):
    long = prose(random.Random(2), 20_000)
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, long), (5, long), (None, long)]
    assert {(r.doc_id, r.n_words) for r in repeats.repeated_spans(frame(spark, rows)).collect()} == {(5, 20_000), (None, 20_000)}
    assert {(r.doc_id, r.other_id) for r in repeats.maximal_repeats(frame(spark, rows)).collect()} == {(5, 4), (None, 4)}
    assert repeats.repeated_spans(frame(spark, [])).count() == repeats.maximal_repeats(frame(spark, [])).count() == 0


def test_repeats_are_cut_out(spark):
    rng = random.Random(8)
    p, x, y = prose(rng, 60), prose(rng, 20), prose(rng, 20)
    rows = [(1, f"{x} {p}"), (2, f"{y} {p}. The end."), (3, p), (4, None), (5, "")]
    df = frame(spark, rows).withColumnRenamed("lang", "__uid").withColumnRenamed("source", "__spans")
    got = {r.doc_id: (r.text, r.n_chars) for r in repeats.drop_repeats(spark, df, "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: (f"{y} The end.", len(f"{y} The end.")), 4: (None, 0), 5: ("", 0)}


def test_loser_tree_and_front_coding():
    rng = np.random.default_rng(4)
    runs = [sorted(rng.integers(0, 3, 10, dtype=np.uint32).astype(">u4").tobytes()[: 4 * int(rng.integers(2, 11))] for _ in range(n)) for n in (0, 1, 7, 30, 2)]
    coded = [repeats.front_code(r) for r in runs]
    assert [repeats.front_decode(*c) for c in coded] == runs
    order, lcps = repeats.loser_merge([(r, c[0]) for r, c in zip(runs, coded)])
    merged = [runs[a][b] for a, b in order]
    assert merged == sorted(x for r in runs for x in r)
    assert lcps[1:] == [repeats.common(a, b) for a, b in zip(merged, merged[1:])]


@pytest.mark.parametrize("hot", [1, 8])
def test_anchors_of_many_occurrences_give_the_same_rows(spark, passages, monkeypatch, hot):
    """Anchors beyond HOT are settled window by window; ranges and their number change nothing either."""
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "RANGE", 10)
    df = frame(spark, passages)
    cold = lambda f: sorted(f(df).collect(), key=str)
    got = cold(repeats.repeated_spans), cold(repeats.maximal_repeats)
    monkeypatch.setattr(repeats, "HOT", 10**9)
    assert got == (cold(repeats.repeated_spans), cold(repeats.maximal_repeats))
    assert len(got[0]) > 20


def test_one_passage_in_thousands_of_documents(spark):
    rng = random.Random(31)
    shared = prose(rng, 55)
    rows = [(i, f"a{i} b{i} c{i} {shared} d{i} e{i}") for i in range(repeats.HOT // 8)]
    old, repeats.HOT = repeats.HOT, repeats.HOT // 20
    try:
        got = repeats.repeated_spans(frame(spark, rows)).collect()
    finally:
        repeats.HOT = old
    assert {(r.doc_id, r.start_word, r.end_word, tuple(r.source_ids)) for r in got} == {(i, 3, 58, (0,)) for i in range(1, len(rows))}
