"""Benchmark decontamination: rare seeds of an item, its rarest words, join documents to it, Smith-Waterman alignment scores them.

Words are runs of letters and digits of the lower-cased text. Alignment is local, over words: +1 for an equal pair, -0.5
for an unequal pair or a skipped word. A document is contaminated by an item if its alignment has equal words for at least
``SIMILARITY`` of the item's.

Which documents are aligned with an item follows from that criterion alone, so no edited copy is lost to it. An alignment
that meets it leaves out at most a fifth of the item's n words, and as its score is above 0 it lies within 3 n words of
text. So of any choice of the item's words, no more are absent from those 3 n words than a fifth of the item can hold: of
its n / 5 + k rarest ones (its signature), k are there. A first pass over all documents counts how often each of the
items' words occurs, and by that each item gets the k that costs least; the counts change no result. A second pass finds
the signatures' words, and where a text has k of an item's within 3 n words, and as many words of the item as the
criterion asks for, these are aligned. Copies in very many documents are all aligned, whatever their words' frequency.

Seeds are n-grams of n = 1: a longer one is lost to edits that the criterion allows, for short items most of all. Items of
any length are searched; of one with fewer than five words all must be there, so that items of a word or two mark every
document with those words (``least_words`` leaves them out for those who want that).

Items of one text are searched once and counted as often as they occur. The benchmark is read in blocks of about ``BLOCK_WORDS`` words; a block's words and signatures are broadcast (about 40
bytes a word, so 40 MB at most), and all documents pass each block. With several blocks the documents are first staged with
a row number, by which the blocks' verdicts are merged.

Defined cases: items that are null or hold no word are in no text; null and empty texts are clean; repeated items count each, under
the smallest of their ids; repeated rows are each judged; empty tables give empty results. Only doc_id and text
are read by ``contaminated``; ``keep_clean`` returns the columns of its input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import HashCache, bound_batches, plain_words, slices, staged

LEAST_WORDS, SIMILARITY = 1, 0.8
GAP, UNEQUAL = 0.5, 0.5
#: An alignment whose score is above 0 spans fewer words of text than this many times the item's.
SPAN = 3
#: What a pair of text and item costs that must be looked at, in occurrences of a signature's words; the most owners met at once.
PAIR_COST, MOST_OWNED = 500, 1 << 22
BLOCK_WORDS = 1_000_000
BITMAP = 1 << 22


class Lookup:
    """Sorted, distinct word hashes, found in long arrays of them by a bitmap first."""

    def __init__(self, words: np.ndarray):
        self.words, self.bitmap = words, None

    def __getstate__(self):
        return {**self.__dict__, "bitmap": None}

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that hold one of the words, and which."""
        if self.bitmap is None:
            self.bitmap = np.zeros(BITMAP, bool)
            self.bitmap[self.words & np.uint64(BITMAP - 1)] = True
        some = np.flatnonzero(self.bitmap[h & np.uint64(BITMAP - 1)])
        if not len(some) or not len(self.words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, h[some]), len(self.words) - 1)
        same = self.words[at] == h[some]
        return some[same], at[same]


@dataclass
class Block:
    """Items of the benchmark."""

    ids: list
    copies: list[int]  # how often the benchmark has each item
    words: list[np.ndarray]  # word hashes of each item
    known: Lookup  # of all items' words
    often: np.ndarray  # how often each of them occurs in the documents
    documents: int = 0


@dataclass
class Index:
    """A block's items by the words of their signatures, for one similarity."""

    ids: list
    copies: list[int]
    words: list[np.ndarray]
    sizes: np.ndarray  # words of each item
    need: np.ndarray  # of each item: equal words asked for
    least: np.ndarray  # of each item: distinct words of its signature that a similar passage holds at least
    signs: Lookup  # all signatures' words
    first: np.ndarray  # of each of these words, where its items begin in owners; one more
    owners: np.ndarray


def word_cache() -> HashCache:
    return HashCache(xxhash.xxh64_intdigest)


def block_of(items: list[tuple], least_words: int = LEAST_WORDS) -> Block:
    """``items``: (id, text, copies). Those of the same words are one."""
    cache, found = word_cache(), {}
    for i, text, copies in items:
        h = cache.array(plain_words(text))
        if len(h) >= max(1, least_words):
            one = found.setdefault(h.tobytes(), [i, 0, h])
            one[0] = i if one[0] is None else one[0] if i is None else min(i, one[0])
            one[1] += copies
    words = [x[2] for x in found.values()]
    known = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
    return Block([x[0] for x in found.values()], [x[1] for x in found.values()], words, Lookup(known), np.zeros(len(known), np.int64))


def signature(times: np.ndarray, rate: np.ndarray, miss: int) -> tuple[int, int]:
    """How many of an item's words, rarest first, make its signature, and how many of these a passage without ``miss`` words holds.

    ``times``: how often the item has each distinct word; ``rate``: how often a document has it.
    """
    best, load = None, np.cumsum(rate)  # the item has more than ``miss`` words, so some size does
    for size in range(1, min(len(times), miss + 8) + 1):
        # the most words that can be absent are those that the item has fewest times
        held = size - int(np.searchsorted(np.cumsum(np.sort(times[:size])), miss, "right"))
        if held > 0:
            cost = load[size - 1] + PAIR_COST * min(1.0, load[size - 1] ** held / math.factorial(held))
            if best is None or cost < best[0]:
                best = cost, size, held
    return best[1:]


def index_of(block: Block, similarity: float = SIMILARITY) -> Index:
    sizes = np.array([len(w) for w in block.words], np.int64)
    need = np.array([max(1, math.ceil(similarity * n)) for n in sizes.tolist()], np.int64)
    least, words, owners = np.ones(len(sizes), np.int64), [], []
    for i, w in enumerate(block.words):
        own, times = np.unique(w, return_counts=True)
        rate = block.often[np.searchsorted(block.known.words, own)] / max(1, block.documents)
        order = np.argsort(rate, kind="stable")
        size, least[i] = signature(times[order], rate[order], int(sizes[i] - need[i]))
        words.append(own[order[:size]])
        owners.append(np.full(size, i, np.int32))
    words, owners = np.concatenate(words), np.concatenate(owners)
    order = np.argsort(words, kind="stable")
    signs, first = np.unique(words[order], return_index=True)
    return Index(block.ids, block.copies, block.words, sizes, need, least, Lookup(signs), np.append(first, len(words)), owners[order])


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, float, int, int]:
    """Best local alignment: equal words, score, and its first and last word in ``text`` (one past). Of equal scores, the first end."""
    n = len(text)
    step = np.arange(n + 1) * GAP
    score, equal, begin = np.zeros(n + 1), np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0.0, 0, 0)
    for w in item:
        same = text == w
        diagonal = np.concatenate([[0.0], score[:-1] + np.where(same, 1.0, -UNEQUAL)])
        above = score - GAP
        s = np.maximum(np.maximum(diagonal, above), 0.0)
        by_diagonal, fresh = diagonal >= np.maximum(above, 0.0), np.maximum(diagonal, above) <= 0
        by_diagonal[0] = False
        e = np.where(by_diagonal, np.concatenate([[0], equal[:-1] + same]), equal)
        b = np.where(by_diagonal, np.concatenate([[0], begin[:-1]]), begin)
        e[fresh], b[fresh] = 0, np.arange(n + 1)[fresh]
        # a run of skipped words of the text: the best start to the left, at GAP a word
        reach = np.maximum.accumulate(s + step)
        source = np.maximum.accumulate(np.where(s + step >= reach, np.arange(n + 1), 0))
        left = reach - step
        use = left > s
        score, equal, begin = np.where(use, left, s), np.where(use, e[source], e), np.where(use, b[source], b)
        top = int(score.argmax())
        if score[top] > best[1]:
            best = int(equal[top]), float(score[top]), int(begin[top]), top
    return best


def judge(of: Index, item: int, h: np.ndarray, places: np.ndarray, signs: np.ndarray) -> tuple[int, float, float, int, int] | None:
    """The item in a text (word hashes ``h``) with its signature's words at ``places``: (item, share of equal words, score, first word, one past the last)."""
    words, need, reach, found = of.words[item], int(of.need[item]), SPAN * int(of.sizes[item]), None
    for group in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) >= reach) + 1):
        if len(np.unique(signs[group])) < of.least[item]:
            continue
        a, z = max(0, int(places[group[0]]) - reach), min(len(h), int(places[group[-1]]) + reach)
        own = np.isin(h[a:z], words)
        before = np.concatenate([[0], np.cumsum(own)])
        ends = np.minimum(np.arange(z - a) + reach, z - a)
        starts = np.flatnonzero(own & (before[ends] - before[:-1] >= need))  # an alignment may begin here
        if not len(starts):
            continue
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > reach) + 1):
            begin = a + int(run[0])
            here = h[begin : a + int(ends[run[-1]])]
            if np.isin(words, here).sum() >= need:  # else no alignment can reach it
                equal, score, first, last = align(words, here)
                if equal >= need and (found is None or (equal, score) > found[:2]):
                    found = equal, score, begin + first, begin + last
    return None if found is None else (item, found[0] / len(words), *found[1:])


def _hashes(texts: list[str | None], cache: HashCache) -> tuple[np.ndarray, np.ndarray]:
    split = [plain_words(t) for t in texts]
    return cache.array([w for x in split for w in x]), np.cumsum([0, *map(len, split)])


def blocks_of(benchmark: DataFrame, docs: DataFrame, block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> Iterator[Block]:
    """The benchmark's blocks one by one, with the occurrences of their words counted over all documents."""
    bound_batches(docs.sparkSession)
    # texts that many items share are one row, so that a block is bounded whatever repeats
    items = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")).filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("copies"))
    size = F.sum(F.char_length("text"))
    n = max(1, -(-int(items.agg(size).first()[0] or 0) // (6 * block_words)))
    for k in range(n):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()  # a block
        block = block_of(sorted(((r["item_id"], r["text"], r["copies"]) for r in own), key=lambda x: (x[0] is None, x[0], x[1])), least_words)
        if not block.ids:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            cache, of = word_cache(), sent.value
            held, rows = np.zeros(len(of.often), np.int64), 0
            for batch in batches:
                texts = batch.column(0).to_pylist()
                rows += len(texts)
                for a, z in slices(texts):
                    held += np.bincount(of.known.find(_hashes(texts[a:z], cache)[0])[1], minlength=len(held))
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([rows, *held[some]], pa.int64())], ["word", "n"])

        counted = docs.select(F.col("text").alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most a row for each word of the block
        found = {r["word"]: r["n"] for r in counted}
        block.documents = found.pop(-1, 0)
        for w, c in found.items():
            block.often[w] = c
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each contaminated document: doc_id, item_id (the most similar item), similarity, score, first_word, last_word, n_items."""
    parts = []
    schema = "row long, doc_id long, item_id long, similarity double, score double, first_word long, last_word long, n_items long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    blocks = blocks_of(benchmark, docs, least_words=least_words)
    ahead = list(islice(blocks, 2))
    if len(ahead) > 1:  # a pass over a shuffle may number its rows anew; what is staged keeps its numbers
        read = staged(read, "decontamination-rows")
    for block in chain(ahead, blocks):
        sent = docs.sparkSession.sparkContext.broadcast(index_of(block, similarity))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            cache, of = word_cache(), sent.value
            for batch in batches:
                texts, rows = batch.column(2).to_pylist(), []
                for a, z in slices(texts):
                    for i, found in verdicts(of, texts[a:z], cache):
                        item, share, score, first, last = min(found, key=lambda x: (-x[1], -x[2], of.ids[x[0]] is None, of.ids[x[0]]))
                        rows.append((batch.column(0)[a + i].as_py(), batch.column(1)[a + i].as_py(), of.ids[item], share, score, first, last, sum(of.copies[x[0]] for x in found)))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

        parts.append(read.mapInArrow(run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema).drop("row")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:
        best = F.max_by(F.struct(*names[1:-1]), F.struct("similarity", "score"))
        out = out.groupBy("row").agg(best.alias("b"), F.sum("n_items").alias("n_items")).select("row", "b.*", "n_items")
    return out.drop("row")


def verdicts(of: Index, texts: list[str | None], cache: HashCache) -> Iterator[tuple[int, list]]:
    """(text, items found in it) of the texts that hold any."""
    h, bounds = _hashes(texts, cache)
    places, signs = of.signs.find(h)
    doc = np.searchsorted(bounds[1:], places, "right")
    # texts by about MOST_OWNED items of their words, one at least
    owned = np.cumsum(of.first[signs + 1] - of.first[signs])
    a = 0
    while a < len(places):
        past = int(np.searchsorted(owned, (owned[a - 1] if a else 0) + MOST_OWNED, "right"))
        z = len(places) if past >= len(places) else max(int(np.searchsorted(doc, doc[past])), int(np.searchsorted(doc, doc[a], "right")))
        yield from _found(of, h, bounds, doc[a:z], places[a:z], signs[a:z])
        a = z


def _found(of: Index, h: np.ndarray, bounds: np.ndarray, doc: np.ndarray, places: np.ndarray, signs: np.ndarray) -> Iterator[tuple[int, list]]:
    times = of.first[signs + 1] - of.first[signs]
    hit = np.repeat(np.arange(len(places)), times)
    item = of.owners[np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times) + of.first[signs][hit]].astype(np.int64)
    pair = doc[hit] * len(of.ids) + item
    order = np.argsort(pair, kind="stable")
    pair, item, place, sign = pair[order], item[order], places[hit][order], signs[hit][order]
    # as many of an item's signature as it asks for, near enough
    last = np.arange(len(pair)) + of.least[item] - 1
    inside, last = last < len(pair), np.minimum(last, len(pair) - 1)
    near = inside & (pair[last] == pair) & (place[last] - place < SPAN * of.sizes[item])
    now, out = -1, []
    for p in np.unique(pair[near]).tolist():
        i, one = divmod(p, len(of.ids))
        if i != now and out:
            yield now, out
            out = []
        now = i
        a, z = np.searchsorted(pair, p), np.searchsorted(pair, p, "right")
        found = judge(of, one, h[bounds[i] : bounds[i + 1]], place[a:z] - bounds[i], sign[a:z])
        if found is not None:
            out.append(found)
    if out:
        yield now, out


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark."""
    at = docs.columns.index("text")
    out = docs
    for block in blocks_of(benchmark, docs, least_words=least_words):
        sent = docs.sparkSession.sparkContext.broadcast(index_of(block, similarity))

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            cache = word_cache()
            for batch in batches:
                texts = batch.column(at).to_pylist()
                for a, z in slices(texts):
                    clean = np.ones(z - a, bool)
                    clean[[i for i, _ in verdicts(sent.value, texts[a:z], cache)]] = False
                    yield batch.slice(a, z - a).filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out
