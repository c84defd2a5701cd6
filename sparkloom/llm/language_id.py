"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text is lower-cased, all but letters (ASCII letters and every other byte beyond ASCII) becomes white space, and each
run of 2, 3 and 4 bytes that lies in a word or touches its edge is hashed into ``BUCKETS`` rows of an embedding. The
text's vector is their average, and a linear softmax over it gives the languages' probabilities. As both are linear, a
model of up to ``DIM`` languages is folded into one table of bucket by language (about 2 MB for 4 languages); one of more
is broadcast as embedding and weights (about 8 MB, and 128 bytes a language).

Training: a bounded sample of labelled texts, ``TRAIN_DOCS`` over all languages, the same number of each language at most, or
``LEAST_EACH`` of each where there are so many languages that they would get fewer. Equal texts count once, the texts of
least hash are taken, and ``MOST_RUNS`` distinct runs of a text at most (the most frequent), so that what reaches the
driver is bounded whatever rows repeat. Every label is learned: a language that the fit would leave out gets a text. A part of the sample is kept out of the fit and gives the
temperature (by likelihood) and the rejection threshold: a document is rejected if its calibrated score is below the
score that ``1 - REJECT_SHARE`` of the correctly labelled kept-out documents exceed, ``MAX_THRESHOLD`` at most, or if it is
``und``. Short excerpts of each document are trained on too, so that short texts score well.

Defined cases: null text, or none with a letter: ``und``, score 0, rejected; no labelled row at all: every document is
``und``; repeated rows each get their row; an empty table gives an empty result. Whole texts are read, in slices of a
bounded number of documents. Other columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import bound_batches, crc_mod, slices, staged

BUCKETS, DIM, SIZES = 1 << 16, 16, (2, 3, 4)
TRAIN_DOCS, LEAST_EACH, EPOCHS, RATE = 4000, 8, 6, 0.5
MOST_RUNS = 4096
REJECT_SHARE, MAX_THRESHOLD = 0.001, 0.5
#: Probabilities held at once.
MOST_CELLS = 1 << 22
UNKNOWN = "und"
_KEEP = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _bytes(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode("utf-8", "replace").translate(_KEEP) + b" "


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each size of run, the bucket at each byte (BUCKETS where there is no run), and the texts' starts in it."""
    parts = [_bytes(t) for t in texts]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    a = np.frombuffer(b"".join(parts) + b"    ", np.uint8).astype(np.uint32)
    n = len(a) - 4
    space = a == 0x20
    out = np.empty((len(SIZES), n), np.uint32)
    code, inner = a[:n].copy(), np.zeros(n, bool)
    for k in range(1, max(SIZES)):
        code |= a[k : n + k] << np.uint32(8 * k)
        if k + 1 in SIZES:
            hashed = ((code + np.uint32(k * 0x51ED27)) * np.uint32(2654435761)) >> np.uint32(16)
            both = space[:n] & space[k : n + k]  # nothing but white space, or white space at both edges of nothing
            out[SIZES.index(k + 1)] = np.where(inner | (both if k == 1 else False), BUCKETS, hashed)
        inner |= space[k : n + k]
    return out, starts


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages), or (BUCKETS + 1, DIM) where there are weights; the last row is zero
    bias: np.ndarray
    temperature: float
    threshold: float
    weights: np.ndarray | None = None  # (DIM, languages)


def logits(model: Model, texts: list[str | None]) -> np.ndarray:
    runs, starts = buckets(texts)
    out = np.zeros((len(texts), model.table.shape[1]))
    count = np.zeros(len(texts))
    for row in runs:
        count += np.add.reduceat((row != BUCKETS).astype(np.int64), starts)
        for j in range(out.shape[1]):
            out[:, j] += np.add.reduceat(model.table[row, j], starts)
    out /= np.maximum(count, 1)[:, None]
    return (out if model.weights is None else out @ model.weights) + model.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], held: np.ndarray, seed: int = 7) -> Model:
    """``docs``: distinct buckets and their counts; ``held``: not fitted, for calibration."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS + 1, DIM))
    w, b = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    fit = np.flatnonzero(~held) if (~held).any() else np.arange(len(docs))
    steps, total = 0, EPOCHS * len(fit) * 2
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            ids, n = docs[i]
            if not len(ids):
                continue
            few = min(len(ids), int(rng.integers(8, 40)))
            some = rng.choice(len(ids), few, replace=False)
            for own, share in ((ids, n / n.sum()), (ids[some], np.full(few, 1 / few))):
                rate = RATE * (1 - steps / total)
                steps += 1
                v = share @ e[own]
                g = softmax(v @ w + b)
                g[y[i]] -= 1
                back = w @ g
                w -= rate * np.outer(v, g)
                b -= rate * 0.1 * g
                # the average spreads a step over the text's runs; their number gives the step its size back
                e[own] -= rate * min(len(own), 64) * share[:, None] * back
    e[BUCKETS] = 0
    folded = len(langs) <= DIM
    table, weights = (e @ w, None) if folded else (e, w)
    table[BUCKETS] = 0
    check = np.flatnonzero(held) if held.any() else fit
    check = rng.permutation(check)[: max(1, MOST_CELLS // len(langs))] if len(check) * len(langs) > MOST_CELLS else check
    z = np.array([(docs[i][1] / max(1, docs[i][1].sum())) @ table[docs[i][0]] for i in check])
    z = (z if folded else z @ w) + b
    right = y[check]
    best = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: -np.log(softmax(z / t)[np.arange(len(z)), right] + 1e-12).mean())
    p = softmax(z / best)
    sure = np.sort(p.max(axis=1)[p.argmax(axis=1) == right])
    threshold = float(min(MAX_THRESHOLD, sure[int(len(sure) * REJECT_SHARE)])) if len(sure) else 0.0
    return Model(langs, table, b, best, threshold, weights)


def sample_texts(docs: DataFrame, may_learn: Column, train_docs: int = TRAIN_DOCS) -> DataFrame | None:
    """(lang, text, hash) of the texts to learn from: distinct, a bounded number of each language; None if there is no labelled row."""
    spark = docs.sparkSession
    labelled = docs.select(F.col("lang").alias("lang"), F.col("text").alias("text"), may_learn.alias("may")).filter("may and lang is not null and text is not null")
    labelled = labelled.select("lang", "text", F.xxhash64(F.lit("language"), "text").alias("hash"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()  # a row for each language
    if not counts:
        return None
    each = max(LEAST_EACH, train_docs // len(counts))
    # twice as many as wanted pass a threshold on the hash, so that no sort of all rows is needed; where few do, all are taken
    shares = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, 2 * (each + LEAST_EACH) / max(1, r["n"]))) for r in counts], "lang string, share double"))  # a row for each language
    drawn = F.shiftrightunsigned("hash", 11) / float(1 << 53)
    few = labelled.select("lang", "hash").join(shares, "lang").filter(drawn < F.col("share")).groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("hash", 11), "hash"))  # of about twice ``each``
    keys = staged(few.withColumn("place", first).filter(F.col("place") <= each).select("lang", "hash"), "language-sample")
    return labelled.join(F.broadcast(keys), ["lang", "hash"]).groupBy("lang", "hash").agg(F.first("text").alias("text"))


def fit_languages(docs: DataFrame, may_learn: Column, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learns from a bounded sample of the rows where ``may_learn``; None if there is no labelled row."""
    bound_batches(docs.sparkSession)
    sample = sample_texts(docs, may_learn, train_docs)
    if sample is None:
        return None

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for lang, text, held in zip(pdf["lang"], pdf["text"], pdf["held"], strict=True):
                runs, _ = buckets([text])
                ids, n = np.unique(runs[runs != BUCKETS], return_counts=True)
                most = np.sort(np.argsort(-n, kind="stable")[:MOST_RUNS])
                rows.append((lang, ids[most].astype("<u2").tobytes(), np.minimum(n[most], 65535).astype("<u2").tobytes(), held))
            yield pd.DataFrame(rows, columns=["lang", "ids", "n", "held"])

    held = (F.pmod("hash", F.lit(6)) == 0).alias("held")
    got = sample.select("lang", "text", held).mapInPandas(features, "lang string, ids binary, n binary, held boolean").toPandas()
    got["held"] = got["held"].astype(bool) & (~got["held"].astype(bool)).groupby(got["lang"]).transform("any")  # each language is fitted
    got = got.sort_values(["lang", "ids", "n"], kind="stable").reset_index(drop=True)  # the order of arrival doesn't matter
    langs = sorted(set(got["lang"]))
    number = {x: i for i, x in enumerate(langs)}
    data = [(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(n, "<u2").astype(float)) for i, n in zip(got["ids"], got["n"], strict=True)]
    return train(data, got["lang"].map(number).to_numpy(np.int64), langs, got["held"].to_numpy(bool)) if data else None


def predict_texts(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated score and rejection of each text."""
    known = np.array([has_letter(t) for t in texts], bool)
    if model is None or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    most = max(1, MOST_CELLS // len(model.langs))
    if len(texts) > most:
        parts = [predict_texts(model, texts[a : a + most]) for a in range(0, len(texts), most)]
        return [x for p in parts for x in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    p = softmax(logits(model, texts) / model.temperature)
    best = p.argmax(axis=1)
    score = np.where(known, p[np.arange(len(texts)), best], 0.0)
    return [model.langs[j] if k else UNKNOWN for j, k in zip(best, known, strict=True)], score, ~known | (score < model.threshold)


def identify_languages(docs: DataFrame, model: Model | None, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, z in slices(texts):
                langs, score, rejected = predict_texts(sent.value, texts[a:z])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], batch.column(2)[a:z], pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held = F.lit(False) if held_out is None else held_out
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), held.alias("held_out")).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, z in slices(texts):
                yield batch.slice(a, z - a).filter(pa.array(~predict_texts(sent.value, texts[a:z])[2]))

    at = docs.columns.index("text")
    return docs.mapInArrow(keep, docs.schema)


def held_out(fold: int = 5) -> Column:
    return crc_mod(F.col("doc_id"), fold) == 0
