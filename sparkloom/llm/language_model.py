"""LM scoring: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

Tokens: words with A-Z lower-cased, then one end token a text. Counts of every token of the training texts are made over all of
them. The vocabulary is every word that occurs ``LEAST`` times or more, the ``VOCABULARY`` most frequent of them at most (a
bound on what a worker holds: 2.4 MB of parameters, 2 bytes a token in the shuffle); it grows with the input up to there.
In byte order it is cut into clusters of ``MEMBERS`` words, and any other word belongs to the cluster that its bytes fall
into, as the cluster's unit for others: words that begin alike are together.

With vectors R of units, S of clusters, one matrix C_i for each of the two places before a token, and biases, the
prediction after (u, v) is q = R[v] C_1 + R[u] C_2. A token's probability is that of its cluster, exp(q . S[c] + a[c])
normalised over clusters, times that of its unit, exp(q . R[w] + b[w]) normalised over the cluster's units: both by batched
matrix products. A word that is not in the vocabulary has its unit's probability times its own share (c + 1) / (n + v + 1) of
it, n and v being the count and number of the unit's training tokens: probabilities over all tokens, unseen ones being one in
each cluster, sum to one. A text begins as if after two ends.

Training: noise-contrastive estimation at both levels, AdaGrad steps. Noise clusters come from their frequencies and are
shared by a batch; noise units from their frequencies within the token's cluster. Every training text is read: texts are
dealt by a hash to shards of about ``SHARD_TOKENS`` tokens (``SHARDS`` at most; beyond that shards grow) and read in the order of that
hash, each shard fits the common start, and the fits are averaged in the order of shards, each row of parameters weighted
by its uses (one round of iterative parameter mixing). So neither the layout of the table nor lost executors change the model.

Counts of unboundedly many words are never broadcast: words with at least 1 / ``HEAD`` of all training tokens (so HEAD at
most) are; the other occurrences, about an eighth of all, are joined to the counts by shuffle. No word is hot there, as hot ones
are in the head (a word that is hot in held-out texts alone is split by the skew join).

Defined cases: null text is an empty one: one token, the end; a null doc_id counts as remainder 0 and is learned from;
without training texts all counts are 0 and the score is that of the base, log10(1 / 1) a token; repeated rows each get
their row; an empty table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import bound_batches, crc_mod, lower_words, slices, staged

VOCABULARY, LEAST, DIM = 1 << 15, 5, 16
MEMBERS = 128
HEAD = 1 << 20
BATCH, NOISE, UNIT_NOISE, RATE = 3072, 32, 2, 0.1
SHARD_TOKENS, SHARDS = 3_000_000, 4096
PIECE = 256
CHUNK = 1024
COUNTER = 300_000
SLICE = 1 << 22
END = b" "  # no word holds a space
LOG10 = float(np.log(10))


@dataclass
class Units:
    """The vocabulary in byte order, in clusters of ``MEMBERS`` words, each with a unit for all others after them."""

    words: list[bytes]
    counts: np.ndarray  # of each unit, in training tokens

    def __post_init__(self):
        n = len(self.words)
        self.bounds = self.words[MEMBERS::MEMBERS]  # the first word of each cluster but the first
        self.clusters = len(self.bounds) + 1
        self.of_word = np.arange(n) + np.arange(n) // MEMBERS
        self.starts = np.minimum(np.arange(self.clusters + 1) * (MEMBERS + 1), n + self.clusters)
        self.cluster = np.repeat(np.arange(self.clusters), np.diff(self.starts))
        self.others = self.starts[1:] - 1

    def __len__(self) -> int:
        return len(self.cluster)

    def cluster_of(self, word: bytes) -> int:
        return bisect_right(self.bounds, word)


@dataclass
class Model:
    """Fitted parameters and the counts that scoring needs."""

    units: Units
    table: np.ndarray  # a row for each unit, then each cluster: vector and bias; then the rows of C_1 and C_2
    words: list[bytes]  # the head
    counts: np.ndarray
    tokens: int
    types: int
    other_types: np.ndarray  # of each cluster, the training words that are not in the vocabulary
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def count_tokens(docs: DataFrame, may_learn: Column) -> DataFrame:
    """(word, n) over the texts where ``may_learn``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter = Counter()

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], ["word", "n"])
            own.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own.update(lower_words(text))
                own[END] += 1
                if len(own) > COUNTER:
                    yield made()
        yield made()

    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("text").alias("text"), may_learn.alias("may")).filter("may").select("text")
    return staged(texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


class Lookup(dict):
    """Word to its place; for others, which are not kept, -1 less their cluster."""

    def __init__(self, places: dict[bytes, int], bounds: list[bytes]):
        super().__init__(places)
        self.bounds = bounds

    def __missing__(self, word):
        return -1 - bisect_right(self.bounds, word)


def places_of(texts: list[str | None], find: Lookup) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Places of all tokens (or -1 less a cluster), the ends included, the texts' bounds among them, and the tokens."""
    tokens: list[bytes] = []
    bounds = [0]
    for t in texts:
        tokens += lower_words(t)
        tokens.append(END)
        bounds.append(len(tokens))
    return np.fromiter(map(find.__getitem__, tokens), np.int64, len(tokens)), np.array(bounds), tokens


def unit_ids(place: np.ndarray, unit_of: np.ndarray, units: Units) -> np.ndarray:
    return np.where(place >= 0, unit_of[place], units.others[np.where(place >= 0, 0, -1 - place)])


def contexts(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two places before each token."""
    one, two = np.concatenate([[end], ids[:-1]]), np.concatenate([[end, end], ids[:-2]])
    starts = bounds[:-1]
    one[starts] = end
    two[starts] = end
    two[starts[np.diff(bounds) > 1] + 1] = end
    return one, two[: len(ids)]


class Trainer:
    """Noise-contrastive estimation from a common start."""

    def __init__(self, units: Units, seed: int = 5):
        self.units, self.rng = units, np.random.default_rng(seed)
        n = units.counts + 1.0
        self.cumulated = np.cumsum(n)
        by_cluster = np.add.reduceat(n, units.starts[:-1])
        share = by_cluster / by_cluster.sum()
        self.cluster_cumulated = np.cumsum(share)
        self.low = np.concatenate([[0.0], self.cumulated])[units.starts[:-1]]
        self.width = by_cluster
        own = n / by_cluster[units.cluster]
        self.cluster_offset, self.offset = np.log(NOISE * share).astype(np.float32), np.log(UNIT_NOISE * own).astype(np.float32)
        self.r = self.rng.normal(0, 0.1, (len(n), DIM)).astype(np.float32)
        self.s = self.rng.normal(0, 0.1, (units.clusters, DIM)).astype(np.float32)
        self.c = np.stack([np.eye(DIM), np.eye(DIM) * 0.5]).astype(np.float32)
        self.b, self.a = np.log(own).astype(np.float32), np.log(share).astype(np.float32)
        self.seen = [np.full(x.shape[:k], 1e-2, np.float32) for x, k in ((self.r, 1), (self.s, 1), (self.c, 1), (self.b, 1), (self.a, 1))]
        self.uses = np.zeros(len(n), np.int64)
        self.tokens = 0
        self.rest = [np.empty(0, np.int64)] * 3

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        r, s, c, b, a, n = self.r, self.s, self.c, self.b, self.a, len(w)
        seen_r, seen_s, seen_c, seen_b, seen_a = self.seen
        k = self.units.cluster[w]
        far = np.minimum(np.searchsorted(self.cluster_cumulated, self.rng.random(NOISE)), len(a) - 1)
        drawn = self.low[k][:, None] + self.rng.random((n, UNIT_NOISE)) * self.width[k][:, None]
        near = np.clip(np.searchsorted(self.cumulated, drawn, "right"), self.units.starts[k][:, None], self.units.others[k][:, None])
        r1, r2, rw, sk, sf, rn = r[one], r[two], r[w], s[k], s[far], r[near]
        q = r1 @ c[0] + r2 @ c[1]
        # each gradient: the logistic's error, of what is true and of the noise
        true = lambda z: -1 / (1 + np.exp(np.clip(z, -30, 30)))
        false = lambda z: 1 / (1 + np.exp(np.clip(-z, -30, 30)))
        gk = true((q * sk).sum(axis=1) + a[k] - self.cluster_offset[k])
        gf = false(q @ sf.T + (a[far] - self.cluster_offset[far]))
        gw = true((q * rw).sum(axis=1) + b[w] - self.offset[w])
        gn = false((rn @ q[:, :, None])[:, :, 0] + b[near] - self.offset[near])
        dq = gk[:, None] * sk + gf @ sf + gw[:, None] * rw + (gn[:, None, :] @ rn)[:, 0]
        dc = np.stack([r1.T @ dq, r2.T @ dq]) / n
        rows = np.concatenate([w, near.ravel(), one, two]).astype(np.uint16)  # which sorts faster; units are fewer
        d = np.concatenate([gw[:, None] * q, (gn[:, :, None] * q[:, None, :]).reshape(-1, DIM), dq @ c[0].T, dq @ c[1].T])
        g = np.concatenate([gw, gn.ravel(), np.zeros(2 * n, np.float32)])
        self._rows(r, b, seen_r, seen_b, rows, d, g, n, self.uses)
        self._rows(s, a, seen_s, seen_a, np.concatenate([k, far]).astype(np.uint16), np.concatenate([gk[:, None] * q, gf.T @ q]), np.concatenate([gk, gf.sum(axis=0)]), n)
        seen_c += (dc * dc).mean(axis=(1, 2))
        c -= RATE * 0.1 * dc / np.sqrt(seen_c)[:, None, None]
        self.tokens += n

    @staticmethod
    def _rows(x, bias, seen, seen_bias, rows, d, g, n, count=None) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        ids, uses = rows[first], np.diff(np.concatenate([first, [len(rows)]]))
        # by the root of its uses, so that frequent rows don't run away within a batch
        dx = np.add.reduceat(d[order], first, axis=0)
        db = np.add.reduceat(g[order], first) / np.float32(np.sqrt(n))
        own = seen[ids] + np.einsum("nd,nd->n", dx, dx) / (uses * DIM).astype(np.float32)
        seen[ids] = own
        dx *= (RATE / np.sqrt(uses * own)).astype(np.float32)[:, None]
        x[ids] -= dx
        own = seen_bias[ids] + db * db
        seen_bias[ids] = own
        bias[ids] -= np.float32(RATE * 0.2) * db / np.sqrt(own)
        if count is not None:
            count[ids] += uses

    def fit(self, ids: np.ndarray, bounds: np.ndarray, end: int) -> None:
        """Steps of BATCH tokens each, whatever the texts' borders; what is left waits for more."""
        ready = [np.concatenate(x) for x in zip(self.rest, (ids, *contexts(ids, bounds, end)), strict=True)]
        whole = len(ready[0]) // BATCH * BATCH
        for i in range(0, whole, BATCH):
            self.step(*(x[i : i + BATCH] for x in ready))
        self.rest = [x[whole:] for x in ready]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All parameters as rows, and the weight of each row in an average."""
        if len(self.rest[0]):
            self.step(*self.rest)
            self.rest = [np.empty(0, np.int64)] * 3
        square = np.concatenate([self.c.reshape(-1, DIM), np.zeros((2 * DIM, 1))], axis=1)
        rows = np.concatenate([np.column_stack([self.r, self.b]), np.column_stack([self.s, self.a]), square])
        return rows.astype(np.float32), np.concatenate([self.uses, np.full(len(self.s) + 2 * DIM, self.tokens)])


def train(docs: DataFrame, may_learn: Column, units: Units, tokens: int) -> np.ndarray:
    """The averaged parameters."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(units)
    shards = int(min(SHARDS, max(1, round(tokens / SHARD_TOKENS))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = sent.value
        find = Lookup(dict(zip(units.words, units.of_word.tolist(), strict=True)), units.bounds)
        same = np.arange(len(units))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, z in slices(texts):
                place, bounds, _ = places_of(texts[a:z], find)
                ids = unit_ids(place, same, units).astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.array([ids[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)], pa.binary())], ["hash", "ids"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, shard, trainer = sent.value, -1, None
        end = int(units.of_word[units.words.index(END)])

        def made() -> pa.RecordBatch:
            rows, weight = trainer.table()
            pieces = range(0, len(rows), PIECE)
            columns = [list(range(len(pieces))), [shard] * len(pieces), [rows[i : i + PIECE].astype("<f4").tobytes() for i in pieces], [weight[i : i + PIECE].astype("<i8").tobytes() for i in pieces]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["piece", "shard", "rows", "weight"])

        for batch in batches:
            owners, texts = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for own in np.unique(owners):
                if own != shard:
                    if trainer is not None:
                        yield made()
                    shard, trainer = int(own), Trainer(units)
                parts = [np.frombuffer(x, "<u2") for x, o in zip(texts, owners, strict=True) if o == own]
                trainer.fit(np.concatenate(parts).astype(np.int64), np.cumsum([0, *map(len, parts)]), end)
        if trainer is not None:
            yield made()

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        rows, total = np.zeros(1), np.zeros(1)
        for x, n in zip(pdf["rows"], pdf["weight"], strict=True):
            weight = np.frombuffer(n, "<i8") + 1e-9  # what no shard uses keeps the common start
            rows = rows + np.frombuffer(x, "<f4").reshape(len(weight), -1) * weight[:, None]
            total = total + weight
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "rows": [(rows / total[:, None]).astype("<f8").tobytes()]})

    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), may_learn.alias("may")).filter("may").select(order.alias("hash"), "text")
    dealt = texts.mapInArrow(encode, "hash long, ids binary").withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int")).select("shard", "hash", "ids")
    fitted = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "hash").mapInArrow(fit, "piece int, shard int, rows binary, weight binary")
    # SHARDS rows of a piece at most
    merged = staged(fitted, "lm-fits").groupBy("piece").applyInPandas(average, "piece int, rows binary").collect()
    return np.concatenate([np.frombuffer(r["rows"], "<f8").reshape(-1, DIM + 1) for r in sorted(merged, key=lambda r: r["piece"])])


def fit_model(docs: DataFrame, may_learn: Column, counts: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts of the words outside its head."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    least = max(1, -(-total["n"] // HEAD))
    head = sorted(((r["n"], r["word"].encode()) for r in counts.filter(F.col("n") >= least).collect()), key=lambda x: (-x[0], x[1]))
    own = {w: n for n, w in head[:VOCABULARY] if n >= LEAST}
    if END not in own and total["n"]:  # the end is always known
        own = dict(list(own.items())[: VOCABULARY - 1]) | {END: counts.filter(F.col("word") == END.decode()).first()["n"]}
        if all(w != END for _, w in head):
            head.append((own[END], END))
    words = sorted(own) or [END]
    units = Units(words, np.zeros(0))
    sent = docs.sparkSession.sparkContext.broadcast((words, units.bounds))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bounds = set(sent.value[0]), sent.value[1]
        tokens, types = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for batch in batches:
            for w, n in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w not in known:
                    c = bisect_right(bounds, w)
                    tokens[c] += n
                    types[c] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens))), pa.array(tokens), pa.array(types)], ["c", "n", "v"])

    # of each cluster, the tokens and words that are not in the vocabulary
    units.counts, types = np.zeros(len(units)), np.zeros(units.clusters, np.int64)
    units.counts[units.of_word] = [own.get(w, 0) for w in words]
    for r in counts.select("word", "n").mapInArrow(fold, "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        units.counts[units.others[r["c"]]], types[r["c"]] = r["n"], r["v"]
    table = train(docs, may_learn, units, total["n"]) if total["n"] else np.zeros((len(units) + units.clusters + 2 * DIM, DIM + 1))
    model = Model(units, table, [w for _, w in head], np.array([n for n, _ in head], np.float64), total["n"], total["v"], types)
    return model, counts.filter(F.col("n") < least)


class Scorer:
    """Normalised log probabilities of tokens."""

    def __init__(self, m: Model):
        u, self.units = m.units, m.units
        n, k = len(u), u.clusters
        r = m.table[:n, :DIM].astype(np.float32)
        # biases are one more dimension, in which every prediction is 1
        self.top = m.table[n : n + k].astype(np.float32)
        self.s = np.ascontiguousarray(self.top.T)
        self.ahead = r @ m.table[n + k : n + k + DIM, :DIM].astype(np.float32), r @ m.table[n + k + DIM :, :DIM].astype(np.float32)
        self.within = [np.ascontiguousarray(m.table[i:j].T, np.float32) for i, j in zip(u.starts, u.starts[1:], strict=False)]
        self.longest = float(np.sqrt((m.table[: n + k] ** 2).sum(axis=1)).max())
        self.find = Lookup(dict(zip(m.words, range(len(m.words)), strict=True)), u.bounds)
        self.logs = np.append(np.log10(m.counts + 1), 0.0)  # the last is for those not in the head
        place = dict(zip(u.words, u.of_word.tolist(), strict=True))
        self.unit_of = np.array([place[w] if w in place else u.others[u.cluster_of(w)] for w in m.words] + [0], np.int64)
        self.end = place.get(END, 0)
        self.base = np.log10(m.tokens + m.types + 1)
        # a word that is not in the vocabulary has a share of its unit
        self.other, self.shares = np.zeros(n, bool), np.zeros(n)
        self.other[u.others] = True
        self.shares[u.others] = np.log10(u.counts[u.others] + m.other_types + 1)
        self.learned = m.tokens > 0

    def unit_logs(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logarithms of the units' probabilities after their contexts."""
        out = np.empty(len(ids))
        cluster = self.units.cluster[ids]
        order = np.argsort(cluster.astype(np.uint16), kind="stable")
        q = np.ones((len(ids), DIM + 1), np.float32)
        q[:, :DIM] = self.ahead[0][one[order]]
        q[:, :DIM] += self.ahead[1][two[order]]
        # no score is beyond the product of the longest vectors, so that exponentials mostly need no scaling
        small = len(q) == 0 or self.longest * float(np.sqrt((q * q).sum(axis=1).max())) < 80
        at, place = cluster[order], (ids - self.units.starts[cluster])[order]
        # clusters' normalisers depend on the context alone, and contexts repeat
        _, some, same = np.unique((one * len(self.units) + two)[order], return_index=True, return_inverse=True)
        whole = np.empty(len(some))
        for i in range(0, len(some), CHUNK):
            whole[i : i + CHUNK] = _log_total(q[some[i : i + CHUNK]] @ self.s, small)
        logs = np.einsum("nd,nd->n", q, self.top[at]) - whole[same]
        ends = np.searchsorted(at, np.arange(self.units.clusters + 1))
        for c in np.flatnonzero(np.diff(ends)):
            for i in range(ends[c], ends[c + 1], CHUNK):
                j = min(i + CHUNK, ends[c + 1])
                z = q[i:j] @ self.within[c]
                logs[i:j] += z[np.arange(j - i), place[i:j]]
                logs[i:j] -= _log_total(z, small)
        out[order] = logs
        return out

    def __call__(self, texts: list[str | None]) -> tuple:
        """Per text: tokens, head tokens, and base and model scores but for what tail tokens add; and the tail tokens of all with their counts per text."""
        place, bounds, tokens = places_of(texts, self.find)
        head = place >= 0
        logs = self.logs[np.where(head, place, len(self.logs) - 1)]
        if self.learned:
            ids = unit_ids(place, self.unit_of, self.units)
            one, two = contexts(ids, bounds, self.end)
            p = self.unit_logs(ids, one, two) / LOG10 + np.where(self.other[ids], logs - self.shares[ids], 0.0)
        else:
            p = logs - self.base
        starts, n = bounds[:-1], np.diff(bounds)
        tail = np.flatnonzero(~head)
        per = np.bincount(np.searchsorted(bounds, tail, "right") - 1, minlength=len(texts))
        return n, n - per, np.add.reduceat(logs, starts) - n * self.base, np.add.reduceat(p, starts), [tokens[i] for i in tail], per


def _log_total(z: np.ndarray, small: bool) -> np.ndarray:
    """Of each row, the logarithm of the sum of its exponentials; ``small``: none can overflow."""
    top = 0.0 if small else z.max(axis=1)
    if not small:
        z -= top[:, None]
    np.exp(z, out=z)
    return top + np.log(z.sum(axis=1))


_scorers: dict[str, Scorer] = {}


def score_texts(docs: DataFrame, model: Model, tail: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    train_tokens = int(model.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sent.value.name
        if key not in _scorers:  # kept for the worker's later tasks
            _scorers.clear()
            _scorers[key] = Scorer(sent.value)
        score = _scorers[key]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, z in slices(texts, SLICE):
                n, known, base, own, words, per = score(texts[a:z])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(words, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], batch.column(2)[a:z], pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(own), lists], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<string>"
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), held_out.alias("held_out")).mapInArrow(run, schema)
    rows = staged(read.withColumn("row", F.monotonically_increasing_id()), "lm-rows")  # fixes the row numbers
    found = rows.select("row", F.explode("tail").alias("word")).join(tail, "word")
    added = found.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("add"))
    more, add = F.coalesce("more", F.lit(0)), F.coalesce("add", F.lit(0.0))
    return rows.drop("tail").join(added, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base_score") + add).alias("base_score"), (F.col("score") + add).alias("score"))


def held_out() -> Column:
    return crc_mod(F.col("doc_id"), 7) == 2


def score_documents(docs: DataFrame) -> DataFrame:
    held = held_out()
    model, tail = fit_model(docs, ~held, count_tokens(docs, ~held))
    return score_texts(docs, model, tail, held)
