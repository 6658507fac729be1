"""Operator 3: quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Every passage is encoded
(a learned layer over transitions between byte classes, word repetition, word
lengths and hashed words), gated attention learned from document labels
weighs the passages, and the weighted passage representation is scored
(Ilse, Tomczak and Welling, 2018). Scoring streams the documents through one
map without any shuffle.

The model is fitted on the driver on a bounded sample of labelled rows: at
most ``TRAIN_DOCS`` documents of each class in the order of a hash of the id,
while all their passages together stay within ``TRAIN_PASSAGES`` for a class
(a document that no longer fits is passed over; one that is used is used
whole). Only rows whose crc32(doc_id) mod 3 is not 1 are used. Scores look at
the text alone, at all of it; a very long text is encoded piece by piece, and
its attention weights are summed as the pieces come.

Defined results. Null and empty texts have one empty passage and a score like
any other. Labels without a class are not used; of repeated labels the mean
decides, a tie for class 1. If only one class (or no label) is known, the
score is its share, 1 if nothing is known. An empty table gives no rows.
Repeated rows score alike. Columns of the input that are called like those
added (score, top_passage, top_weight) are replaced; ``keep`` adds none.
"""

from __future__ import annotations

import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import text_or_empty
from .decontaminate import _chunks, words_of

PASSAGE = 768
#: Labelled documents of each class the model is fitted on, at most.
TRAIN_DOCS = 2000
#: Passages of the documents of each class the model is fitted on, at most (528 bytes each).
TRAIN_PASSAGES = 60_000
HIDDEN = 32
#: Bytes of text that are encoded together: whole passages.
CHUNK = 680 * PASSAGE
EPOCHS = 20
BATCH_DOCS = 128

#: Byte classes of the encoder; bytes above 127 are a class, all others another.
CLASSES = (" ", "\n\r", "\t\v\f", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,", "!?", "|/\\_", "#$%&*@^~+=", "\"'`()[]{}<>-:;")
N_CLASSES = len(CLASSES) + 2
HASHED = 64
N_FEATURES = N_CLASSES * N_CLASSES + HASHED + 4

_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate(CLASSES):
    for _c in _chars:
        _CLASS[ord(_c)] = _i + 1
_CLASS[128:] = N_CLASSES - 1


def encode(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, number of passages of each document)."""
    ends = np.concatenate([starts[1:], [len(data)]])
    many = np.maximum(1, -(-(ends - starts) // PASSAGE))
    base = np.cumsum(many) - many
    total = int(many.sum())
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(data):
        return out, many
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    passage = (base[doc] + (np.arange(len(data)) - starts[doc]) // PASSAGE).astype(np.int64)
    # Words end with their passage, so no passage depends on its neighbours.
    of_doc = np.repeat(np.arange(len(starts)), many)
    first = starts[of_doc] + PASSAGE * (np.arange(total) - base[of_doc])
    size = np.bincount(passage, minlength=total)
    kind = _CLASS[data].astype(np.int64)
    k2 = N_CLASSES * N_CLASSES
    key = passage[:-1] * k2 + kind[:-1] * N_CLASSES + kind[1:]
    key = key[passage[:-1] == passage[1:]]
    moves = np.bincount(key, minlength=total * k2).reshape(total, k2)
    per = np.maximum(size, 1)[:, None]
    out[:, :k2] = np.sqrt(moves / per)
    h, at, to = words_of(data, first)
    if len(h):
        of = passage[at]
        words = np.bincount(of, minlength=total)
        hashed = np.bincount(of * HASHED + (h >> np.uint64(58)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED)
        out[:, k2 : k2 + HASHED] = np.sqrt(hashed / np.maximum(words, 1)[:, None])
        tagged = np.sort((of.astype(np.uint64) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1)))
        new = np.ones(len(tagged), bool)
        new[1:] = tagged[1:] != tagged[:-1]
        distinct = np.bincount((tagged[new] >> np.uint64(40)).astype(np.int64), minlength=total)
        again = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=total)
        out[:, k2 + HASHED] = distinct / np.maximum(words, 1)
        out[:, k2 + HASHED + 1] = again / np.maximum(words, 1)
        out[:, k2 + HASHED + 2] = np.log1p(np.bincount(of, weights=(to - at), minlength=total) / np.maximum(words, 1))
    out[:, k2 + HASHED + 3] = np.log1p(size) / math.log(PASSAGE)
    return out, many


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionMIL:
    """Gated attention over encoded passages."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, mean, std, seed: int = 3) -> AttentionMIL:
        rng = np.random.default_rng(seed)
        w = lambda a, b: (rng.normal(size=(a, b)) / math.sqrt(a)).astype(np.float32)
        z = lambda *n: np.zeros(n, np.float32)
        return cls({"mean": mean, "std": std, "W": w(N_FEATURES, HIDDEN), "b": z(HIDDEN), "V": w(HIDDEN, HIDDEN), "U": w(HIDDEN, HIDDEN), "w": w(HIDDEN, 1)[:, 0], "c": w(HIDDEN, 1)[:, 0], "d": z(1), "shift": z(1)})

    def attend(self, x: np.ndarray):
        """Representation, the two halves of the gate, and attention logit of each passage."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, s, (t * s) @ p["w"]

    def forward(self, x: np.ndarray, many: np.ndarray):
        p, first = self.p, np.cumsum(many) - many
        doc = np.repeat(np.arange(len(many)), many)
        h, t, s, a = self.attend(x)
        a = np.exp(a - np.maximum.reduceat(a, first)[doc])
        a = a / np.add.reduceat(a, first)[doc]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, t, s, a, z, z @ p["c"] + p["d"][0], doc, first

    def norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.p["mean"]) / self.p["std"], -8, 8)

    def gradients(self, x, many, y):
        p = self.p
        h, t, s, a, z, logit, doc, first = self.forward(x, many)
        dl = (_sigmoid(logit) - y) / len(y)
        dz = dl[:, None] * p["c"]
        dh = a[:, None] * dz[doc]
        da = (h * dz[doc]).sum(axis=1)
        da = a * (da - np.add.reduceat(a * da, first)[doc])
        g = da[:, None] * p["w"]
        dt, ds = g * s * (1 - t * t), g * t * s * (1 - s)
        dh += dt @ p["V"].T + ds @ p["U"].T
        dp = dh * (1 - h * h)
        return {"W": x.T @ dp, "b": dp.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ da, "c": z.T @ dl, "d": np.array([dl.sum()])}

    def fit(self, x: np.ndarray, many: np.ndarray, y: np.ndarray, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> None:
        rng, first = np.random.default_rng(seed), np.cumsum(many) - many
        x = self.norm(x).astype(np.float32)
        m1, m2, step = {}, {}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH_DOCS):
                pick = order[i : i + BATCH_DOCS]
                at = np.concatenate([np.arange(first[k], first[k] + many[k]) for k in pick])
                step += 1
                for name, g in self.gradients(x[at], many[pick], y[pick]).items():
                    g = g.astype(np.float32) + decay * self.p[name]
                    m1[name] = 0.9 * m1.get(name, 0) + 0.1 * g
                    m2[name] = 0.999 * m2.get(name, 0) + 0.001 * g * g
                    self.p[name] = self.p[name] - (rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def score(self, x: np.ndarray, many: np.ndarray):
        """(score of each document, attention of each passage)."""
        _, _, _, a, _, logit, _, _ = self.forward(self.norm(x).astype(np.float32), many)
        return _sigmoid(logit.astype(np.float64) + float(self.p["shift"][0])), a

    def score_pieces(self, pieces) -> tuple[float, int, float]:
        """(score, passage that weighs most, its weight) of one document, whose features come in pieces."""
        high, total, z, at, best, best_a = -math.inf, 0.0, np.zeros(HIDDEN), 0, 0, -math.inf
        for x in pieces:
            h, _, _, a = self.attend(self.norm(x).astype(np.float32))
            a = a.astype(np.float64)
            now = max(high, float(a.max()))
            e = np.exp(a - now)
            total, z, high = total * math.exp(high - now) + e.sum(), z * math.exp(high - now) + e @ h, now
            if a.max() > best_a:
                best, best_a = at + int(a.argmax()), float(a.max())
            at += len(a)
        logit = z / total @ self.p["c"].astype(np.float64) + float(self.p["d"][0]) + float(self.p["shift"][0])
        return float(_sigmoid(logit)), best, math.exp(best_a - high) / total

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> AttentionMIL:
        with np.load(io.BytesIO(raw)) as held:
            return cls({k: held[k] for k in held.files})


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def _pieces(data: np.ndarray):
    """Features of one document, some whole passages at a time."""
    for i in range(0, max(1, len(data)), CHUNK):
        yield encode(data[i : i + CHUNK], np.zeros(1, np.int64))[0]


def _sample_features(batches):
    for batch in batches:
        ids, labels, out = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), []
        for data, starts, base in _chunks(batch.column("text"), CHUNK):
            if len(starts) == 1:
                out.append((ids[base], labels[base], b"".join(x.astype(np.float16).tobytes() for x in _pieces(data))))
                continue
            x, many = encode(data, starts)
            first = np.cumsum(many) - many
            for k, n in enumerate(many.tolist()):
                out.append((ids[base + k], labels[base + k], x[first[k] : first[k] + n].astype(np.float16).tobytes()))
        if out:
            a, b, c = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], ["doc_id", "label", "features"])


def _sample(texts: DataFrame, known: DataFrame, train_docs: int, passages: int) -> DataFrame:
    """The labelled ids (doc_id, label) that the model is fitted on."""
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.filter("label = 0").orderBy(*order).limit(train_docs).unionByName(known.filter("label = 1").orderBy(*order).limit(train_docs))
    # At most 2 * train_docs ids: bounded, so it may be broadcast, and their sums may come to the driver.
    many = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(PASSAGE)))
    sizes = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.sum(many).alias("n")).withColumn("h", F.xxhash64("doc_id")).collect()
    left, chosen = {0: passages, 1: passages}, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= left[r["label"]]:
            left[r["label"]] -= r["n"]
            chosen.append((r["doc_id"], r["label"]))
    return texts.sparkSession.createDataFrame(chosen, "doc_id bigint, label int")


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, passages: int = TRAIN_PASSAGES) -> AttentionMIL | float:
    """The fitted model; the share of class 1 if there are not two classes."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("q")).filter("doc_id is not null and q is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("int").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    if len(counts) < 2:
        return float(next(iter(counts), 1))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    some = texts.join(F.broadcast(_sample(texts, known, train_docs, passages)), "doc_id").select("doc_id", "label", "text")
    rows = sorted(some.mapInArrow(_sample_features, "doc_id bigint, label int, features binary").collect(), key=lambda r: (r[0], bytes(r[2])))
    x = [np.frombuffer(r[2], np.float16).reshape(-1, N_FEATURES).astype(np.float32) for r in rows]
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 1.0
    many = np.array([len(a) for a in x])
    x = np.concatenate(x)
    model = AttentionMIL.fresh(x.mean(axis=0), x.std(axis=0) + 1e-2)
    model.fit(x, many, y)
    # The sample is balanced, the corpus is not: move the log-odds to its prior.
    prior, seen = counts[1] / counts[0], y.sum() / (len(y) - y.sum())
    model.p["shift"] = np.array([math.log(prior / seen)], np.float32)
    return model


def _scorer(model: AttentionMIL | float):
    """A function from a column of texts to score, top passage and its weight of each."""
    raw = model.to_bytes() if isinstance(model, AttentionMIL) else model
    held = []

    def score(texts):
        if not held:
            held.append(AttentionMIL.from_bytes(raw) if isinstance(raw, bytes) else None)
        own, n = held[0], len(texts)
        if own is None:
            return np.full(n, raw), np.zeros(n, np.int32), np.ones(n)
        out, top, weight = np.zeros(n), np.zeros(n, np.int32), np.ones(n)
        for data, starts, base in _chunks(texts, CHUNK):
            if len(starts) == 1:
                out[base], top[base], weight[base] = own.score_pieces(_pieces(data))
                continue
            x, many = encode(data, starts)
            out[base : base + len(starts)], a = own.score(x, many)
            first = np.cumsum(many) - many
            high = np.maximum.reduceat(a, first)
            at = np.flatnonzero(a == np.repeat(high, many))
            doc = np.searchsorted(first, at, "right") - 1
            one = np.unique(doc, return_index=True)[1]
            top[base : base + len(starts)], weight[base : base + len(starts)] = at[one] - first, high
        return out, top, weight

    return score


def _nullable(fields) -> list[StructField]:
    return [StructField(f.name, f.dataType, True) for f in fields]


def keep(docs: DataFrame, model: AttentionMIL | float, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their columns as they are."""
    place, score = docs.columns.index("text"), _scorer(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(place).fill_null(""))[0] >= least))

    return docs.mapInArrow(run, StructType(_nullable(docs.schema.fields)))


def with_scores(docs: DataFrame, model: AttentionMIL | float) -> DataFrame:
    """``docs`` with score, top_passage (the one that weighs most) and top_weight."""
    added = [StructField("score", DoubleType()), StructField("top_passage", IntegerType()), StructField("top_weight", DoubleType())]
    docs = docs.drop(*[f.name for f in added])
    place, score = docs.columns.index("text"), _scorer(model)

    def run(batches):
        for batch in batches:
            more = [pa.array(x) for x in score(batch.column(place).fill_null(""))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, StructType(_nullable(docs.schema.fields) + added))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, top_passage, top_weight for each row."""
    scored = with_scores(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "top_passage", "top_weight")
