import math
import random

import numpy as np

from codelattice.llm import quality as op


def prose(rng, n):
    return " ".join(rng.choice("the of and river stone walk light summer evening".split()) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def junk(rng, n):
    return " ".join(rng.choice("river stone walk".split()) + rng.choice(["###", "$$$", "%%%"]) for _ in range(n))


def data(spark, n=240):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(n):
        good = rng.random() < 0.7
        body = [prose(rng, 60) for _ in range(4)]
        if not good:
            body[rng.randrange(4)] = junk(rng, 120)
        rows.append((i, "\n".join(body)))
        marks.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int"), dict(marks)


def test_held_out_accuracy_and_attention(spark):
    docs, labels, marks = data(spark)
    rows = op.quality_scores(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40 and np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    many = np.array([1, 3, 2])
    x = rng.normal(size=(6, op.N_FEATURES))
    model = op.AttentionMIL.fresh(np.zeros(op.N_FEATURES), np.ones(op.N_FEATURES))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    y = np.array([0.0, 1.0, 1.0])

    def loss():
        logit = model.forward(x, many)[5]
        return np.mean(np.log1p(np.exp(logit)) - y * logit)

    grads = model.gradients(x, many, y)
    for name in ("W", "V", "U", "w", "c", "d", "b"):
        at = np.unravel_index(3 % model.p[name].size, model.p[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


def test_encoding_does_not_depend_on_neighbours():
    texts = [b"one two", b"", b"x" * 3000, "Ä b".encode()]
    whole, many = op.encode(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts[:-1]]))
    assert many.tolist() == [1, 1, 4, 1]
    at = 0
    for t, n in zip(texts, many):
        alone, _ = op.encode(np.frombuffer(t, np.uint8), np.zeros(1, np.int64))
        assert np.allclose(alone, whole[at : at + n], atol=1e-6)
        at += n


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 4), (None, "a", 5), (1, "b", 6)], "doc_id bigint, text string, score int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r["score"] for r in op.quality_scores(docs, none).collect()] == [1.0] * 4
    _, labels, _ = data(spark, 60)
    assert op.quality_scores(docs, labels).count() == 4
    assert op.quality_scores(docs.limit(0), labels).count() == 0
    one = spark.createDataFrame([(i, 0) for i in range(9)] + [(3, None)], "doc_id bigint, quality int")
    assert op.train(docs, one) == 0.0


def test_scores_of_an_independent_forward_pass(spark):
    """Each document by plain loops over its passages."""
    docs, labels, _ = data(spark)
    docs = docs.unionByName(spark.createDataFrame([(1000, "long " * 400_000), (1001, ""), (1002, None)], "doc_id bigint, text string"))
    model = op.train(docs, labels)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rows = {r["doc_id"]: r for r in op.with_scores(docs, model).collect()}
    for i, text in docs.collect():
        if i % 9 and i < 1000:
            continue
        raw, hs, logits = (text or "").encode(), [], []
        for k in range(0, max(1, len(raw)), op.PASSAGE):
            x = op.encode(np.frombuffer(raw[k : k + op.PASSAGE], np.uint8), np.zeros(1, np.int64))[0][0]
            x = np.clip((x - p["mean"]) / p["std"], -8, 8)
            h = np.tanh(x @ p["W"] + p["b"])
            hs.append(h)
            logits.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
        e = [math.exp(a - max(logits)) for a in logits]
        z = sum(w * h for w, h in zip(e, hs)) / sum(e)
        want = 1 / (1 + math.exp(-(float(z @ p["c"]) + p["d"][0] + p["shift"][0])))
        assert abs(rows[i]["score"] - want) < 1e-4
        assert abs(rows[i]["top_weight"] - max(e) / sum(e)) < 1e-4


def test_held_out_figures_of_the_test_table(spark):
    path = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = op.quality_scores(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()
    held = [(r["score"], marks[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    accuracy = np.mean([(s >= 0.5) == bool(q) for s, q in held])
    print("held out", len(held), "AUC", auc, "accuracy", accuracy)
    assert len(held) > 80 and auc > 0.97 and accuracy > 0.95


def test_clashing_columns(spark):
    docs, labels, _ = data(spark, 60)
    odd = docs.selectExpr("doc_id", "text", "1 as score", "'x' as top_weight", "2 as `a b`", "array(1) as label")
    model = op.train(odd, labels)
    assert op.keep(odd, model).columns == odd.columns and {r["score"] for r in op.keep(odd, model).collect()} == {1}
    out = op.with_scores(odd, model)
    assert out.columns == ["doc_id", "text", "a b", "label", "score", "top_passage", "top_weight"] and out.count() == 60
    plain = {r["doc_id"]: r["score"] for r in op.with_scores(docs, model).collect()}
    assert {r["doc_id"] for r in op.keep(odd, model, 0.5).collect()} == {i for i, s in plain.items() if s >= 0.5}


def test_the_sample_is_bounded_by_passages_of_whole_rows(spark):
    docs, labels, _ = data(spark, 120)
    known = labels.selectExpr("doc_id", "quality as label")
    got = op._sample(docs, known, 100, 20).join(docs, "doc_id").collect()
    for label in (0, 1):
        assert 0 < sum(max(1, -(-len(r["text"].encode()) // op.PASSAGE)) for r in got if r["label"] == label) <= 20
