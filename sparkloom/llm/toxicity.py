"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Tokens are runs of letters and digits of the lower-cased text. Features, hashed to 32 bits and binary per text: each
word, each word's stems (its first 4 to 8 bytes, one-word grams over stems, so that inflected forms are known), each pair of neighbours
(bigram) and each pair with one word between (skip-gram). FTRL-proximal keeps a rate per coordinate, and its L1 term
leaves most weights at zero; what is left is a sorted list of feature ids and weights of a few thousand entries, which is
what is broadcast. A text's features are first looked up in a bitmap of the weights' low bits, so that almost all are
dropped at a byte each.

Training: a bounded sample of labelled rows, at most ``TRAIN_DOCS`` ids of each label, those of least hash; of an id's
rows the text of least hash is learned from, and of a text ``MOST_FEATURES`` features at most (those of least hash, the
same ones in every text), so that what reaches the driver is bounded whatever rows repeat. The intercept is corrected for the labels' shares in all rows that may be learned from. Label 1 against 0; rows whose label
is null are not learned from, and of an id with several labels the largest counts.

Defined cases: null or empty text: the score of a text without features; no labels, or labels of one kind: every score
is that kind's share (0 if there are none); repeated rows each get their row; an empty table gives an empty result.
Whole texts are read, in slices of bounded size. Other columns are neither read nor returned.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bound_batches, crc_mod, mix64, plain_words, slices, staged

TRAIN_DOCS, EPOCHS = 4000, 10
ALPHA, BETA, L1, L2 = 0.3, 1.0, 6.0, 1.0
LEAST_DOCS = 3
THRESHOLD = 0.3
STEMS = (4, 5, 6, 7, 8)
MOST_FEATURES = 1 << 14
BITMAP = 1 << 22
SKETCH = 1 << 24


class Words(dict):
    """Word to a row of its hashes (itself, its stems), kept for a bounded number of words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word, 1))
        for k, n in enumerate(STEMS):
            self.hashes.append(xxhash.xxh64_intdigest(word[:n], 2 + k))
        return row

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.hashes = array("Q")
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.array(self.hashes, np.uint64).reshape(-1, 1 + len(STEMS))[at] if len(words) else np.empty((0, 1 + len(STEMS)), np.uint64)


def features(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (32 bits) of all texts, and the text each belongs to."""
    split = [plain_words(t) for t in texts]
    doc = np.repeat(np.arange(len(split)), [len(x) for x in split])
    h = words.rows([w for x in split for w in x])
    out, of = [h.ravel(order="F")], [np.tile(doc, h.shape[1])]
    for gap, salt in ((1, 0x9E37), (2, 0x79B9)):
        if len(doc) > gap:
            same = doc[:-gap] == doc[gap:]
            out.append(mix64((h[:-gap, 0] * np.uint64(0xD6E8FEB86659FD93 + salt) + h[gap:, 0])[same]))
            of.append(doc[:-gap][same])
    return (np.concatenate(out) >> np.uint64(32)).astype(np.uint32), np.concatenate(of)


@dataclass
class Weights:
    ids: np.ndarray  # sorted uint32
    values: np.ndarray
    intercept: float
    bitmap: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.ids, self.values, self.intercept

    def __setstate__(self, state):
        self.ids, self.values, self.intercept = state
        self.bitmap = None

    def score(self, texts: list[str | None], words: Words) -> np.ndarray:
        if self.bitmap is None:
            self.bitmap = np.zeros(BITMAP, bool)
            self.bitmap[self.ids & np.uint32(BITMAP - 1)] = True
        z = np.full(len(texts), self.intercept)
        if len(self.ids):
            f, doc = features(texts, words)
            some = np.flatnonzero(self.bitmap[f & np.uint32(BITMAP - 1)])
            f, doc = f[some], doc[some]
            at = np.minimum(np.searchsorted(self.ids, f), len(self.ids) - 1)
            hit = self.ids[at] == f
            pairs = np.unique(doc[hit].astype(np.int64) * len(self.ids) + at[hit])
            z += np.bincount(pairs // len(self.ids), self.values[pairs % len(self.ids)], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def ftrl(docs: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Weights:
    """FTRL-proximal over the texts' distinct features; features of fewer than LEAST_DOCS texts are left at zero."""
    ids, n = np.unique(np.concatenate(docs), return_counts=True) if docs else (np.empty(0, np.uint32), np.empty(0))
    ids = ids[n >= LEAST_DOCS]
    own = []
    for d in docs:
        at = np.minimum(np.searchsorted(ids, d), max(0, len(ids) - 1))
        own.append(at[ids[at] == d] if len(ids) else np.empty(0, np.int64))
    z, s, zb, sb = np.zeros(len(ids)), np.zeros(len(ids)), 0.0, 0.0
    rng = np.random.default_rng(seed)

    def weight(z, s):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(s)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(own)):
            at = own[i]
            w, b = weight(z[at], s[at]), -zb / ((BETA + np.sqrt(sb)) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -50, 50))) - y[i]
            z[at] += g - (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / ALPHA * w
            s[at] += g * g
            zb += g - (np.sqrt(sb + g * g) - np.sqrt(sb)) / ALPHA * b
            sb += g * g
    w = weight(z, s)
    some = np.flatnonzero(w)
    return Weights(ids[some], w[some], float(-zb / ((BETA + np.sqrt(sb)) / ALPHA)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column, train_docs: int = TRAIN_DOCS) -> Weights:
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(may_learn)
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        sure = 50.0 if 1 in n else -50.0
        return Weights(np.empty(0, np.uint32), np.empty(0), sure)
    # twice as many as wanted pass a threshold on the hash, so that little is sorted
    drawn = F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("string"))
    share = lambda label: min(1.0, 2 * train_docs / n[label] + 1e-6)
    of = lambda label: known.filter((F.col("toxic") == label) & (F.shiftrightunsigned(drawn, 11) / float(1 << 53) < share(label))).orderBy(drawn, "doc_id").limit(train_docs)
    sample = staged(of(0).unionByName(of(1)), "toxicity-ids")  # 2 * train_docs rows at most
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))  # map-side, so that a hot id is a few rows by then

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for pdf in batches:
            yield pd.DataFrame([(i, int(y), np.unique(features([t], words)[0])[:MOST_FEATURES].tobytes()) for i, y, t in zip(pdf["doc_id"], pdf["toxic"], pdf["text"], strict=True)], columns=["doc_id", "toxic", "f"])

    # written once and read twice, a partition at a time: the driver holds one partition and what is learned from
    found = staged(texts.select("doc_id", "toxic", "text").mapInPandas(extract, "doc_id long, toxic int, f binary"), "toxicity-sample")
    seen = np.zeros(SKETCH, np.uint8)  # in how many texts a feature is, at least: features that share a place are counted together
    for r in found.select("f").toLocalIterator():
        at = np.frombuffer(r["f"], np.uint32) & np.uint32(SKETCH - 1)
        seen[at] = np.minimum(seen[at], 254) + 1
    rows = []
    for r in found.toLocalIterator():
        f = np.frombuffer(r["f"], np.uint32)
        rows.append((r["doc_id"], r["toxic"], f[seen[f & np.uint32(SKETCH - 1)] >= LEAST_DOCS].tobytes()))
    rows.sort()
    y = np.array([r[1] for r in rows], float)
    model = ftrl([np.frombuffer(r[2], np.uint32) for r in rows], y)
    if 0 < y.sum() < len(y):  # from the sample's shares to those of all labelled rows
        model.intercept += float(np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_toxicity(docs: DataFrame, model: Weights, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, z in slices(texts):
                s = sent.value.score(texts[a:z], words)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], batch.column(2)[a:z], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), held_out.alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def held_out() -> Column:
    return crc_mod(F.col("doc_id"), 4) == 2
