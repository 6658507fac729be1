import random
import re

import numpy as np
import pytest
import xxhash

from codelattice.llm import simhash as op


def reference(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, budget):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= budget and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("text", ["", "  ", "one", "A b\tC", "a b c d", "É e É f g a b\u00a0c d e f " * 30, "x " * 70000])
def test_fingerprint(text):
    assert op.fingerprint(text) == reference(text)


def near(rng, n, spread):
    base = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        x = rng.choice(base) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randrange(spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("budget,spread", [(4, 7), (4, 3), (10, 9)])
def test_trie_joins_all(budget, spread):
    keys = near(random.Random(budget + spread), 150, spread)
    arr, groups = np.array(keys, np.uint64), np.zeros(len(keys), np.int64)
    child, parent = op.trie_links(arr, groups, budget)
    label = np.arange(len(keys))
    label[child] = parent
    want = components(keys, budget)
    assert len({(a, b) for a, b in zip(label.tolist(), want)}) == len(set(want)) == len(set(label.tolist()))
    n = op.PAIRS_TRIE
    a, b, done = op.first_links(np.repeat(arr[:n, None], op.FIRST_WORDS, axis=1), np.full(n, 500), budget)
    assert done
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if bin(keys[i] ^ keys[j]).count("1") <= budget}


def test_changed_copies_hang_on_what_they_were_copied_from():
    rng = random.Random(1)
    base, other = rng.getrandbits(64), rng.getrandbits(64)
    flip = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), 6))
    prints = sorted({(base, other)} | {(flip(base), flip(other)) for _ in range(80)})
    keys, second = np.array([p[0] for p in prints], np.uint64), np.array([p[1] for p in prints], np.uint64)
    # Copies of copies' bits in the other words: near enough to be dense.
    words = np.column_stack([keys, second, *[np.full(len(keys), 5, np.uint64)] * (op.FIRST_WORDS - 2)])
    a, b, done = op.first_links(words, np.full(len(keys), 500), 14)
    assert not done and len(a) == 80 and set(keys[b].tolist()) == {base}


def test_sampled_masks_reach_the_recall():
    rng, hit = random.Random(3), 0
    found = op.sampled_masks(50_000, 10, 0.95)
    for _ in range(1000):
        diff = sum(1 << b for b in rng.sample(range(64), 10))
        hit += any(not diff & x for x in found)
    assert hit > 930


def test_trie_keeps_groups_apart():
    keys = np.array([5, 6, 5, 7], np.uint64)
    child, _ = op.trie_links(keys, np.array([0, 0, 1, 1]), 4)
    assert child.tolist() == [1, 3]


@pytest.mark.parametrize("budget,m", [(4, 5), (4, 7), (10, 12)])
def test_masks_leave_no_pair_out(budget, m):
    rng, found = random.Random(1), op.masks(m, budget)
    for _ in range(300):
        diff = sum(1 << b for b in rng.sample(range(64), budget))
        assert any(not diff & x for x in found)


@pytest.mark.parametrize("large", [op.LARGE_TRIE, 10])
def test_components_against_brute_force(spark, large):
    rng = random.Random(7)
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    rows = []
    for i in range(150):
        t = rng.choice(base).split()
        if rng.random() < 0.7:
            t[rng.randrange(len(t))] = "changed"
        rows.append((i, " ".join(t)))
    rows += [(900, None), (901, ""), (902, "one"), (903, "one"), (903, "one"), (None, "one"), (None, "two words")]
    got = op.simhash_components(spark.createDataFrame(rows, "doc_id bigint, text string"), large=large).collect()
    fps = [reference(t) for _, t in rows]
    label = components(fps, 4)
    want = {}
    for (i, _), fp, c in zip(rows, fps, label):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None]
        want[(i, fp)] = min(ids) if ids else None
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["fp"] & (2**64 - 1)): r["component_id"] for r in got} == want


def test_verified_near_dedup(spark):
    rng = random.Random(2)
    text = [" ".join(f"w{rng.randrange(9999)}" for _ in range(400)) for _ in range(20)]
    close = [t.replace(t.split()[7], "other") for t in text[:10]]
    far = [" ".join(t.split()[:150]) for t in text[10:15]]
    rows = [(i, t) for i, t in enumerate(text + close + far)] + [(50, text[0]), (3, text[3]), (None, "no id"), (60, None), (61, "")]
    kept = op.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [*range(20), *range(30, 35), 60]
    assert kept.filter("doc_id is null").count() == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, fp int")
    assert op.simhash_components(docs).count() == 0 and op.near_dedup(docs).count() == 0


def shared_passage(rng, n, copies, passage=300, own=240):
    """Texts on one passage, and near copies of some: similar to their original only."""
    common = [f"c{i}" for i in range(passage)]
    texts = [common + [f"w{rng.randrange(10**6)}" for _ in range(own)] for _ in range(n)]
    for k in range(copies):
        t = list(texts[k])
        for _ in range(8):
            t[rng.randrange(passage, len(t))] = f"x{rng.randrange(10**6)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def similar_components(texts, least=0.8):
    """Smallest position in each text's component by brute-force similarity of 5-word shingles."""
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(grams[i] & grams[j]) >= least * len(grams[i] | grams[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_shared_passage_against_brute_force(spark):
    texts = shared_passage(random.Random(5), 200, 70)
    want = similar_components(texts)
    got = dict(op.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    copies = [i for i, c in enumerate(want) if c != i]
    assert len(copies) >= 60 and all(got[i] == i for i in range(200) if want[i] == i)
    assert sum(got[i] == want[i] for i in copies) >= 0.9 * len(copies)


def bucket(rng, n, label, block=None, spread=160):
    """Rows of a bucket: sketches that differ from one another in few bits, node, size, label, block."""
    base = [rng.getrandbits(64) for _ in range(op.WORDS)]
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    prints = np.array([[flip(x, rng.randrange(spread // op.WORDS)) for x in base] for _ in range(n)], np.uint64).view(np.int64)
    return np.column_stack([prints, np.arange(n) + 1000, np.full(n, 300), label, np.zeros(n, np.int64) if block is None else block])


@pytest.mark.parametrize("blocks", [1, 3])
def test_all_candidates_between_labels(blocks):
    rng = random.Random(4)
    block = np.array([rng.randrange(blocks) for _ in range(60)])
    rows = bucket(rng, 60, np.arange(60) * 7 % 9, block)
    want = {}
    for i in range(60):
        for j in range(i):
            words = [bin(int(x) & (2**64 - 1)).count("1") for x in rows[i, : op.WORDS] ^ rows[j, : op.WORDS]]
            if rows[i, op.WORDS + 2] != rows[j, op.WORDS + 2] and words[0] <= 18 and words[1] <= 18 and sum(words) <= op.sketch_budget(np.array(300), op.WORDS) and (blocks == 1 or block[i] != block[j]):
                want[j, i] = sum(words)
    assert len(want) > 100
    a, b, far = op.close_pairs(rows, 18)
    assert {tuple(sorted(p)): d for p, d in zip(zip(a.tolist(), b.tolist()), far.tolist())} == want and len(a) == len(want)
    chosen, more = op.nearest_first(a, b, far, 3)
    for i in range(60):
        mine = sorted((d, k) for k, (x, y, d) in enumerate(zip(a, b, far)) if i in (x, y))
        assert all(chosen[k] for _, k in mine[:3])
        assert (i in more) == any(not chosen[k] for _, k in mine)


def test_a_crowded_bucket_in_blocks(spark, monkeypatch):
    """Dealt to blocks, groups are those of one bucket."""
    monkeypatch.setattr(op, "DENSE_KEYS", 8)
    texts = shared_passage(random.Random(5), 40, 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = similar_components(texts)
    got = dict(op.near_duplicates(docs, most=16).collect())
    assert sum(got[i] == want[i] for i in range(70)) >= 68


def test_a_chain_of_edited_copies(spark):
    """60 texts, each an edited copy of the one before: one group, whichever text is the medoid."""
    rng = random.Random(12)
    text = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for _ in range(60):
        texts.append(" ".join(text))
        for _ in range(3):
            text[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    pairs = [(i, j) for i in range(60) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    got = dict(op.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    assert len(pairs) > 100 and all(got[i] == got[j] for i, j in pairs) and set(got.values()) == {0}


def test_repeated_lines_do_not_hide_copies(spark):
    rng = random.Random(6)
    line = " ".join(f"r{i}" for i in range(13))
    tails = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(12)]
    texts = [" ".join([line] * 200 + t) for t in tails]
    for t in tails[1:]:
        texts.append(" ".join([line] * 200 + t[:100] + ["other"] + t[101:]))
    want = similar_components(texts)
    assert want == [*range(12), *range(1, 12)]
    got = dict(op.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    assert [got[i] for i in range(len(texts))] == want


def test_equal_fingerprints_are_all_compared():
    keys = np.full(70, 9, np.uint64)
    words = np.full((70, op.FIRST_WORDS), 9, np.uint64)
    a, _, done = op.first_links(words[:16], keys[:16].astype(np.int64), 14)
    assert done and len(a) == 120
    a, b, done = op.first_links(words, keys.astype(np.int64), 14)
    assert not done and len(a) == 69 and len(set(b.tolist())) == 1
    rows = np.column_stack([np.full((70, op.WORDS), 9), np.arange(70), np.full(70, 100), np.arange(70), np.zeros(70, np.int64)])
    assert len(op.close_pairs(rows, 18)[0]) == 70 * 69 // 2


def test_sketches_of_similar_sets_are_within_their_budget():
    """Shares of pairs at a similarity of just 0.8 or more, for small and large sets, and of pairs far below."""
    rng = random.Random(3)
    for n, least in ((9, 0.93), (30, 0.95), (200, 0.97)):
        kept, far, trials = 0, 0, 300
        for _ in range(trials):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
            cut = max(1, round(0.2 * n))
            one, two = op.sketch(" ".join(words), 5, op.WORDS), op.sketch(" ".join(words[: len(words) - cut]), 5, op.WORDS)
            half = op.sketch(" ".join(words[: max(5, int(0.45 * n))] + [f"y{rng.randrange(10**9)}" for _ in range(int(0.55 * n))]), 5, op.WORDS)
            bits = lambda x, y: int(np.bitwise_count(x[0] ^ y[0]).sum())
            kept += bits(one, two) <= op.sketch_budget(np.array(min(one[1], two[1])), op.WORDS)
            far += bits(one, half) <= op.sketch_budget(np.array(min(one[1], half[1])), op.WORDS)
        assert kept >= least * trials and (n < 100 or far < 0.01 * trials), (n, kept, far)


@pytest.mark.parametrize("n", [9_296, 1_000_000, 9_000_000])
def test_recall_at_every_size(n):
    rng = np.random.default_rng(n)
    found = np.array(op.sampled_masks(n, op.near_bits(op.NEAR_SIMILARITY, op.NEAR_BUDGET), op.NEAR_RECALL, op.NEAR_KEYS), np.uint64)
    apart = np.arccos(2 * 0.8 / 1.8) / np.pi
    differ = rng.random((4000, 2, 64)) < apart
    fp = (differ[:, 0] * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
    hit = (differ.sum(axis=2) <= op.NEAR_BUDGET).all(axis=1) & ((fp[:, None] & found) == 0).any(axis=1)
    assert hit.mean() > 0.95


def test_texts_under_one_id_are_decided_each(spark):
    rng = random.Random(8)
    text = [" ".join(f"w{rng.randrange(9999)}" for _ in range(100)) for _ in range(4)]
    rows = [(1, text[0]), (1, text[1]), (1, text[1]), (2, text[1]), (3, text[2]), (None, text[2]), (None, text[3]), (None, text[3])]
    kept = op.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, text.index(r["text"])) for r in kept) == [(0, 3), (1, 0), (1, 1), (3, 2)]
