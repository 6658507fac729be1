import random

import numpy as np
import pytest

from codelattice.llm import decontaminate as op


def brute(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_nearest():
    rng = random.Random(1)
    for _ in range(300):
        p = [rng.randrange(4) for _ in range(rng.randrange(1, 90))]
        t = [rng.randrange(4) for _ in range(rng.randrange(0, 99))]
        assert op.nearest(p, t)[0] == brute(p, t)


def test_words_fold_case_and_punctuation():
    same = ["Été, the END!", "été the end", "«été» - The... eNd"]
    got = [op.words_of_text(t).tolist() for t in same]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3
    assert op.words_of_text("a1 b").tolist() != op.words_of_text("a b1").tolist() and not len(op.words_of_text(" .,"))


def test_words_of_other_scripts():
    n = lambda t: len(op.words_of_text(t))
    assert n("今日は、良い天気。") == 7 and n("สวัสดี") == 6 and n("a今b") == 3 and n("𠀀𠀁") == 2
    assert n("one\u00a0two\u2003three\u2014four") == 4 and n("\u201cone\u201d \u2026 \u00ab\u00bb") == 1 and n("год мир") == 2 and n("안녕 세상") == 2
    same = [op.words_of_text(t).tolist() for t in ("\u201cdon\u2019t\u201d \u2014 stop", "don t stop")]
    assert same[0] == same[1]
    assert op.words_of_text("日本").tolist() == [*op.words_of_text("日").tolist(), *op.words_of_text("本").tolist()]


def test_words_stop_at_document_ends():
    data = np.frombuffer(b"abcd ef", np.uint8)
    assert len(op.words_of(data, np.array([0, 2]))[0]) == 3


def sample(seed, errors):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, say(rng.randrange(9, 60))) for i in range(40)]
    docs, planted = [], set()
    for d in range(200):
        body = say(rng.randrange(20, 300))
        if d % 2:
            k, words = rng.choice(items)
            words = list(words)
            for _ in range(int(errors * len(words))):
                at = rng.randrange(len(words))
                kind = rng.randrange(3)
                if kind == 0:
                    words[at] = "changed"
                elif kind == 1:
                    words.insert(at, "added")
                elif len(words) > 1:
                    del words[at]
            at = rng.randrange(len(body))
            body[at:at] = words
            planted.add((d, k))
        docs.append((d, " ".join(body)))
    return items, docs, planted


@pytest.mark.parametrize("errors", [0, 0.1, 0.2])
def test_recall_and_exactness(spark, errors):
    items, docs, planted = sample(5, errors)
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    hits = op.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), benchmark).collect()
    found = {(r["doc_id"], r["item_id"]) for r in hits}
    assert len(found & planted) >= 0.97 * len(planted) and (errors or found >= planted)
    text, words = dict(docs), {i: op.words_of_text(" ".join(w)).tolist() for i, w in items}
    for r in hits:
        whole = op.words_of_text(text[r["doc_id"]]).tolist()
        assert r["distance"] == brute(words[r["item_id"]], whole) <= op.allowed(len(words[r["item_id"]]))
        place = op.words_of_text(text[r["doc_id"]][r["first_char"] : r["last_char"]]).tolist()
        assert brute(words[r["item_id"]], place) == r["distance"]


def test_blocks_and_edges(spark, monkeypatch):
    items, docs, _ = sample(6, 0)
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(900, None), (901, "not in any of them"), (902, " ., ")], "item_id bigint, text string")
    frame = spark.createDataFrame([*docs, (777, None), (778, ""), (None, docs[1][1]), docs[1]], "doc_id bigint, text string")
    one = sorted(map(tuple, op.leaks(frame, benchmark).collect()), key=str)
    monkeypatch.setattr(op, "BLOCK_WORDS", 200)
    assert sorted(map(tuple, op.leaks(frame, benchmark).collect()), key=str) == one
    kept = {r["doc_id"] for r in op.clean(frame, benchmark).collect()}
    assert kept == {d for d, _ in docs} - {r[0] for r in one} | {777, 778}
    assert op.leaks(frame, benchmark.limit(0)).count() == 0 and op.leaks(frame.limit(0), benchmark).count() == 0
    assert op.clean(frame, benchmark.limit(0)).count() == frame.count()


def test_cgk_prefers_near_windows():
    rng = np.random.default_rng(1)
    walks, words = op.Walks(40, 8), rng.integers(1, 2**62, 40, dtype=np.uint64)
    near, far = op._mutate(words, 3, rng), rng.integers(1, 2**62, 40, dtype=np.uint64)
    keys = walks.keys(np.stack([words, near, far]))
    assert (keys[0] == keys[1]).any() and not (keys[0] == keys[2]).any()


def all_windows(docs, items):
    """(document, item, distance) of each leak, by edit distance to every run of words."""
    out = set()
    for d, text in docs:
        words = op.words_of_text(text or "").tolist()
        for i, item in items:
            pattern = op.words_of_text(item or "").tolist()
            if pattern and (best := brute(pattern, words)) <= op.allowed(len(pattern)):
                out.add((d, i, best))
    return out


def test_against_all_windows(spark):
    """Few words, so that chance matches near the limit occur, and items of every length."""
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 30])] + [(98, "zz"), (99, "a b zz"), (100, "b a b"), (101, None)]
    docs = [(d, say(rng.randrange(0, 60))) for d in range(60)]
    for d in range(60, 190):
        words = items[7 + d % 8][1].split()
        for _ in range(rng.randrange(op.allowed(len(words)) + 2)):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 1)] = [rng.choice("abcdefg")] if kind else []
        docs.append((d, " ".join([say(rng.randrange(9)), *words, say(rng.randrange(9))])))
    docs += [(200, items[11][1]), (201, "x " + items[14][1] + " y"), (202, None)]
    want = all_windows(docs, items)
    got = op.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in got}
    assert found <= want and len(found) == len(got)
    short = {i for i, t in items if len((t or "").split()) < op.MIN_WORDS}
    assert {x for x in found if x[1] in short} == {x for x in want if x[1] in short}
    long = [x for x in want if x[1] not in short]
    assert len(long) > 100 and len(found & set(long)) >= 0.98 * len(long)


def test_items_in_a_script_without_spaces(spark):
    item = "今日は良い天気ですね"
    docs = spark.createDataFrame([(1, "前置き。" + item + "。後書き"), (2, "前置き。今日は悪い天気ですね"), (3, "無関係")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["distance"] for r in op.leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 1}


@pytest.mark.parametrize("n", [8, 15, 40, 100, 300])
def test_recall_of_the_plan(n):
    """Items with all their edits, drawn anew."""
    rng = np.random.default_rng(n)
    items = [rng.integers(1, 2**62, n, dtype=np.uint64) for _ in range(20)]
    walk = op.Walks(n, op.plan_walks(items)[n])
    words = [items[k] for k in rng.integers(0, 20, 600)]
    hit = (walk.keys(np.stack(words)) == walk.keys(np.stack([op._mutate(w, op.allowed(n), rng) for w in words]))).any(axis=1)
    assert hit.mean() >= 0.965


def test_a_plan_that_cannot_be_met_is_refused(monkeypatch):
    monkeypatch.setattr(op, "MOST_WALKS", 4)
    monkeypatch.setattr(op, "ERRORS", 0.7)
    with pytest.raises(ValueError):
        op.plan_walks([np.arange(1, 60, dtype=np.uint64)])


def test_long_texts_long_items_and_clashing_columns(spark):
    rng = random.Random(2)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(2_000))
    body = " ".join(f"v{rng.randrange(10**6)}" for _ in range(30_000))
    docs = spark.createDataFrame([(1, body + " " + item), (2, body), (3, item.replace("1", "1x", 50))], "doc_id bigint, text string").selectExpr("doc_id", "'t' as item_id", "text", "1 as distance", "2 as `a b`")
    benchmark = spark.createDataFrame([(5, item)], "item_id bigint, text string").selectExpr("item_id", "text", "3 as doc_id")
    assert {(r["doc_id"], r["item_id"]) for r in op.leaks(docs, benchmark).collect()} == {(1, 5), (3, 5)}
    kept = op.clean(docs, benchmark)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
