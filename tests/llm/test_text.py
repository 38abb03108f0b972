"""Tokens, languages, benchmark passages, URLs and quality."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from sleuthframe.llm import bpe, contamination, language_id, quality, token_counts, url_filter

SF = "/root/testdata/sf0.01"
BIG = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string"


def test_bpe_equals_the_plain_encoder(spark):
    enc = bpe.encoding(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    rng = random.Random(1)
    alphabet = "aab  \n\t'dll éß你𝄞1-."
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(60)] + ["a" * 3000, "ab" * 900 + " " * 50, " " * 500, "x" * 70_000, "word " * 20_000, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, DOCS)
    got = bpe.encode(df, leaf=64).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        t = texts[r.doc_id]
        assert r.tokens == (None if t is None else enc.encode_ordinary(t)) and r.n_tokens == len(r.tokens or []) and r.exact == (None if t is None else True)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == dict(enumerate(texts))
    assert bpe.encode(df.limit(0)).count() == 0
    odd = df.selectExpr("doc_id as DOC_ID", "text as Text", "1 as uid", "2 as part", "3 as tokens", "4 as TOKENS", "5 as exact").filter("DOC_ID < 9")
    assert sorted(map(str, bpe.encode(odd, leaf=64).collect())) == sorted(map(str, bpe.encode(df.filter("doc_id < 9"), leaf=64).collect()))


def test_long_unsplit_pieces():
    enc = bpe.encoding(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    rng = random.Random(2)
    for leaf in (3, 17, 64):
        t = "".join(rng.choice("abcde") for _ in range(1500))
        assert bpe.encode_piece(enc, t.encode(), leaf) == enc.encode_ordinary(t)


def test_token_rollup(spark, tmp_path):
    schema = "op string, source string, lang string, version string, old_tokens long, new_tokens long"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    first = rows(("insert", "web", "en", "v1", None, 10), ("insert", "web", "en", "v1", None, 5), ("insert", None, "fr", "v1", None, None), ("other", "web", "en", "v1", 1, 1), (None, "web", "en", "v1", 1, 1))
    assert r.commit("a", first) and not r.commit("a", first)
    assert r.commit("b", rows(("delete", "web", "en", "v1", 5, None), ("revise", "web", "en", "v1", 10, 7), ("insert", "web", "en", "v2", None, 9)))
    want = {("web", "en", "v1", 1, 7), (None, "fr", "v1", 1, 0), ("web", "en", "v2", 1, 9)}
    assert {tuple(x) for x in r.totals().collect()} == want
    assert [tuple(x) for x in r.unknown().collect()] == [("web", "en", "v1", 2)]
    old = r.totals()
    r.compact()
    assert {tuple(x) for x in old.collect()} == {tuple(x) for x in r.totals().collect()} == want and not r.commit("b", first) and len(r.committed()) == 1
    assert r.sweep() == 0 and {tuple(x) for x in old.collect()} == want
    assert r.sweep(grace=-60) == 4 and r.sweep(grace=-60) == 0 and {tuple(x) for x in r.totals().collect()} == want
    assert not r.commit("a", first) and [x.unknown for x in r.unknown().collect()] == [2]
    assert r.commit("c", rows(("delete", "web", "en", "v1", 7, None)))
    assert ("web", "en", "v1") not in {tuple(x)[:3] for x in r.totals().collect()}


def test_rollup_edges(spark, tmp_path):
    schema = "op string, source string, lang string, version string, old_tokens long, new_tokens long"
    one = ("insert", "web", "en", "v1", None, 4)
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    r.compact()
    assert r.commit("none", spark.createDataFrame([], schema)) and not r.commit("none", spark.createDataFrame([one], schema)) and r.totals().count() == 0
    wide = spark.createDataFrame([one, one], schema).selectExpr("*", "1 as docs", "2 as tokens", "3 as Unknown").withColumnRenamed("op", "OP")
    assert r.commit("twice", wide)
    # Two writers of one id: both see it missing, one marker counts.
    other = token_counts.Rollup(spark, str(tmp_path / "r"))
    seen = other.committed
    other.committed = lambda: {k: v for k, v in seen().items() if "twice" not in v}
    assert not other.commit("twice", wide)
    assert [tuple(x) for x in r.totals().collect()] == [("web", "en", "v1", 2, 8)]
    for k in range(3):
        r.commit(f"more{k}", spark.createDataFrame([one], schema))
        r.compact()
    assert len(r.committed()) == 1 and [x.docs for x in r.totals().collect()] == [5]
    r.sweep(grace=-60)
    assert len(list((tmp_path / "r" / "data").glob("*"))) == 1 and [x.docs for x in r.totals().collect()] == [5]


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter("doc_id % 2 = 0"))
    got = language_id.identify(docs.filter("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("n_chars > 200 and lang is not null").collect()
    assert np.mean([r.language == r.lang for r in got if r.accepted]) >= 0.97
    assert np.mean([r.accepted for r in got]) >= 0.9


def test_language_against_exact_sets(spark):
    """The whole query with sets of n-grams instead of the filter."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
    model = language_id.train(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    by = {}
    for lang in sorted({r.lang for r in rows.values()}):
        texts = sorted({r.text for r in rows.values() if r.lang == lang and r.text})
        keyed = docs.filter(docs.lang == lang).selectExpr("text", "xxhash64(text) as h").distinct().orderBy("h").collect()
        assert len(keyed) == len(texts)
        by[lang] = [r.text for r in keyed][::2]
    counts = {lang: dict(zip(*np.unique(np.concatenate([language_id.grams(t) for t in ts]), return_counts=True))) for lang, ts in by.items()}
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = {}
    for c in share.values():
        for g, x in c.items():
            top[g] = max(top.get(g, 0), x)
    exact = {lang: set(sorted((g for g in c if share[lang][g] >= language_id.STRAY * top[g]), key=lambda g: (-c[g], g))[: language_id.GRAMS]) for lang, c in counts.items()}
    same = near = 0
    for r in language_id.identify(docs, model).collect():
        g = language_id.grams(rows[r.doc_id].text).tolist()
        want = {lang: sum(x in own for x in g) / max(1, len(g)) for lang, own in exact.items()}
        best = max(want.values())
        assert abs(r.share - best) < 0.02
        least = dict(zip(model.langs, model.least))
        lang = max(sorted(want), key=want.get)
        bound = least[lang] - language_id.SLACK * (least[lang] * (1 - least[lang]) / max(1, len(g))) ** 0.5
        if abs(best - bound) > 0.02:
            same += (r.accepted, r.language) == ((best >= bound, lang) if best >= bound else (False, None))
            near += 1
    assert same == near > 150


def test_languages_of_which_nothing_is_known_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs.filter("lang <> 'de'"))
    got = language_id.identify(docs, model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("n_chars > 200").collect()
    assert np.mean([not r.accepted for r in got if r.lang == "de"]) >= 0.95
    assert np.mean([r.accepted for r in got if r.lang != "de"]) >= 0.99
    rng = random.Random(8)
    junk = [(i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(3, 12))) for _ in range(60))) for i in range(100)]
    assert sum(r.accepted for r in language_id.identify(spark.createDataFrame(junk, DOCS), model).collect()) <= 2


def test_more_languages_than_a_mask_holds():
    rng = np.random.default_rng(5)
    own = {f"l{k:03}": rng.integers(0, 1 << 32, 200, dtype=np.uint32) for k in range(150)}
    f = language_id.build(own)
    assert len(f.masks) == 3
    for lang, g in own.items():
        share = f.shares(g)
        assert f.langs[int(np.argmax(share))] == lang and share.max() == 1 and np.sort(share)[-2] < 0.1


def test_language_edges(spark):
    labelled = spark.createDataFrame([("en", "the cat and the dog sat on the mat with the hat " * 5), ("de", "der hund und die katze sitzen auf der matte mit dem hut " * 5), (None, "x"), ("fr", None)], "lang string, text string")
    model = language_id.train(labelled)
    assert model.langs == ["de", "en"]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the dog and the cat"), (4, "the dog and the cat"), (5, "der hund und die katze " * 9000), (None, "zzxq qqxz " * 9)], DOCS)
    got = sorted((r.doc_id or 0, r.language, r.accepted) for r in language_id.identify(docs, model).collect())
    assert got == [(0, None, False), (1, None, False), (2, None, False), (3, None, False), (4, "en", True), (4, "en", True), (5, "de", True)]
    kept = language_id.keep_identified(spark, docs.selectExpr("doc_id", "text", "'en' as lang", "1 as share").filter("doc_id = 4"), "")
    assert kept.columns == ["doc_id", "text", "lang", "share"] and kept.count() == 2
    none = language_id.train(labelled.limit(0))
    assert not any(r.accepted for r in language_id.identify(docs, none).collect())


def test_masks_hold_every_gram_and_few_others():
    rng = np.random.default_rng(1)
    own = {k: rng.integers(0, 1 << 32, 9000, dtype=np.uint32) for k in ("a", "b")}
    f = language_id.build(own)
    assert f.shares(own["a"])[0] == 1 and f.shares(own["b"])[1] == 1
    assert f.shares(rng.integers(0, 1 << 32, 50_000, dtype=np.uint32)).max() < 0.02


def naive_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j] + contamination.GAP, h[i, j - 1] + contamination.GAP, h[i - 1, j - 1] + (contamination.MATCH if x == y else contamination.MISMATCH))
    return int(h.max())


def test_alignment_against_the_full_matrix():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(0, 30))
        score, end, start = contamination.align(a, b)[0], *contamination.align(a, b)[1:]
        assert score == naive_align(a, b)
        assert not score or naive_align(a, b[start:end]) == score


def test_leaks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda n: [word() for _ in range(n)]
    items = [(k, prose(25)) for k in range(8)] + [(90, ["too", "short"])]
    docs = [(100 + k, prose(60)) for k in range(20)]
    for k, w in items[:4]:
        docs.append((k, prose(50) + w + prose(50)))
    for k, w in items[4:8]:
        docs.append((k, prose(50) + [x if i % 6 else word() for i, x in enumerate(w)] + prose(50)))
    rows = [(i, " ".join(w)) for i, w in docs] + [(None, " ".join(items[0][1])), (200, None), (201, ""), (202, " ".join(prose(20_000) + items[1][1]))]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(0, " ".join(items[0][1])), (91, None)], "item_id long, text string")
    df = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.item_id): r for r in contamination.leaks(df, bench).collect()}
    assert set(got) == {(k, k) for k in range(8)} | {(None, 0), (202, 1)}
    assert got[0, 0].score == 1 and got[0, 0].start_word == 50 and got[0, 0].end_word == 75
    assert contamination.leaks(df.limit(0), bench).count() == 0 and contamination.leaks(df, bench.limit(0)).count() == 0
    odd = df.filter("doc_id < 8").selectExpr("doc_id as DOC_ID", "text as Text", "1 as item_id", "2 as score", "3 as Score", "4 as word", "5 as n")
    twice = [(r.doc_id, r.item_id) for r in contamination.leaks(odd, bench.withColumnRenamed("text", "TEXT")).collect()]
    assert sorted(twice) == [(k, k) for k in range(8)]
    again = df.filter("doc_id < 8").union(df.filter("doc_id < 8"))
    assert sorted((r.doc_id, r.item_id) for r in contamination.leaks(again, bench).collect()) == sorted([(k, k) for k in range(8)] * 2)


def test_leaks_query_against_aligning_everything(spark):
    """All items against all documents of the smallest tables, with no seeds."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    items = contamination.index([(r.item_id, r.text) for r in bench.collect()])
    want = {}
    for r in docs.collect():
        words = contamination.Hashed(r.text).runs(1)
        at = contamination.numbered(items, words)
        for k, item in enumerate(items.words):
            # Where fewer of the item's words occur at all, no alignment can reach the score.
            if np.isin(items.numbers[k], at).sum() >= contamination.SCORE * len(item):
                score = contamination.align(item, words)[0] / (contamination.MATCH * len(item))
                if score >= contamination.SCORE:
                    want[r.doc_id, items.ids[k]] = score
    got = {(r.doc_id, r.item_id): r.score for r in contamination.op8_decontamination(spark, "/root/testdata/sf0.001").collect()}
    assert got == pytest.approx(want) and len(want) >= 3


def test_edited_leaks_against_aligning_everything():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(400)]
    prose = lambda n: rng.choices(words, k=n)
    made = [prose(n) for n in (16, 25, 40, 64) for _ in range(3)]
    items = contamination.index([(k, " ".join(w)) for k, w in enumerate(made)])
    want, docs = set(), []
    for k, w in enumerate(made):
        for step in (3, 4, 5, 6):
            for first in range(step):
                want.add((len(docs), k))
                docs.append(prose(30) + ["new" if i % step == first else x for i, x in enumerate(w)] + prose(30))
        docs.append(prose(30) + [x for y in w[: len(w) * 3 // 4] for x in (y, "new")] + prose(30))
        docs.append(prose(30) + w[::2] + prose(300) + w[1::2])
    docs += [prose(n) for n in (0, 1, 60, 900)]
    # Counts, and none at all, may decide the time alone; an item's own grams may be in no document.
    for seen in (docs, []):
        n = np.zeros(len(items.vocabulary), np.int64)
        for d in seen:
            n[np.unique(contamination.numbered(items, contamination.Hashed(" ".join(d)).runs(1)))[1:]] += 1
        contamination.choose(items, n)
        got = {(d, k, s) for d, w in enumerate(docs) for k, s, _, _ in contamination.search(items, " ".join(w))}
        full = {(d, k): contamination.align(items.words[k], contamination.Hashed(" ".join(w)).runs(1))[0] / (2 * len(made[k])) for d, w in enumerate(docs) for k in range(len(made))}
        assert got == {(*x, s) for x, s in full.items() if s >= contamination.SCORE}
        lost = want - {(d, k) for d, k, _ in got}
        assert all(full[x] < contamination.SCORE for x in lost) and len(lost) <= len(want) // 20


def test_urls_against_all_rules(spark):
    rng = random.Random(4)
    pages = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("url").collect()]
    extra = ["", None, "https://x.example/" + "a/" * 5000, "https://ADULT-X.example/", "http://spam-farm.example.org/", "http://notspam-farm.example.org.uk/", pages[0], pages[0]]
    urls = pages + extra
    rng.shuffle(urls)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("page_id", "url", "'x' as rule_id", "1 as token")
    got = sorted((r.page_id, r.rule_id) for r in url_filter.filter_urls(df).collect())
    assert got == sorted((i, r) for i, u in enumerate(urls) if u is not None for r, _, p in url_filter.RULES if re.search(p, u))
    assert url_filter.filter_urls(df.limit(0)).count() == 0 and url_filter.filter_urls(df, []).count() == 0


@pytest.mark.parametrize(("pattern", "tokens"), [(r"://ads\.", ["ads"]), (r"ads", []), (r"/a(b|c)/x/", ["x"]), (r"[?&]id=", ["id"]), (r"/fo+o/", []), (r"/(a|b)$", [])])
def test_tokens_that_a_rule_needs(pattern, tokens):
    assert url_filter.literal_tokens(pattern) == tokens


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    model = quality.train(docs, labels.filter("doc_id % 3 <> 0"))
    got = quality.score(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert len(good) > 20 and len(bad) > 20
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc >= 0.75
    assert abs(np.mean([g >= 0.5 for g in good]) - 1) < 0.4


def test_quality_model_depends_on_no_order(spark):
    """Labels that clash, of one doc_id or of one text, count for neither class."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["calm", "river", "stone", "light"] if i % 2 else ["BUY", "NOW", "CLICK", "$$$"]) for _ in range(40))) for i in range(60)]
    docs += [(100, docs[1][1]), (101, docs[2][1])]
    labels = [(i, i % 2) for i in range(60)] + [(3, 0), (5, None), (100, 0), (101, 1), (7, 1)]
    models = set()
    for _ in range(3):
        rng.shuffle(docs)
        rng.shuffle(labels)
        m = quality.train(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int").repartition(2), rows=20)
        models.add((m.good, m.bad, m.a, m.b))
    assert len(models) == 1


def test_quality_query_against_plain_compression(spark):
    import zstandard

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    make = lambda d: zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
    good, bad = make(m.good), make(m.bad)
    got = quality.op10_quality(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        parts = [data[k : k + quality.CHUNK] for k in range(0, len(data), quality.CHUNK)]
        diff = sum(len(bad.compress(x)) - len(good.compress(x)) for x in parts) / max(1, len(data))
        assert r.margin == pytest.approx(diff) and r.score == pytest.approx(1 / (1 + np.exp(-np.clip(m.a * diff + m.b, -50, 50)))) and r.keep == (r.score >= quality.KEEP)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good prose about a quiet river"), (2, "BUY NOW $$$ CLICK"), (3, None), (4, ""), (4, ""), (None, "x" * 200_000)], DOCS)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs.selectExpr("*", "1 as margin", "2 as score"), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and {r.margin for r in got if r.doc_id in (3, 4)} == {0.0}
    none = quality.train(docs, labels.limit(0))
    assert quality.score(docs, none).count() == 6 and quality.score(docs.limit(0), none).count() == 0
