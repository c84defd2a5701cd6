"""Token ids in a binary file format: canonical length-limited Huffman codes from global counts.

The file is a folder. ``codebook``: one row per token id with its code length; codes are canonical (ordered by length,
then id), so lengths are all that decoding needs. ``blocks``: Parquet files in ascending doc_id order whose rows are
blocks, each decodable alone: ``part`` and ``block`` (their order), ``first_token`` (ids before it in its part), the ids
of its documents with their token counts, ``bits`` (each document begins on a byte), and ``checkpoints``: the bit offset
of every ``STRIDE``-th token of each document. Decoding runs all checkpoints of a block in step, a table look-up of
``MAX_LENGTH`` bits for each token.

Texts are tokenized once, into a table in the shared folder, and their ids counted on the way (a sum per id; at most the
vocabulary's size reaches the driver). Then documents are coded where that table is read, and only their codes are
shuffled, to the part of their doc_id: parts are bounded by quantiles of the ids. An id that many rows share is several quantiles at once, and its rows are dealt over all
parts between those, so it is no single task.

Defined cases: a null text is an empty one, and gives the end id alone; null doc_ids come first; rows of the same doc_id
follow each other, in an order that their codes settle; an empty table gives an empty file and an empty result. Texts are
encoded by the tokenizers library word by word (between ASCII white space): no pre-token of the vocabulary spans white
space, so the ids are those of the whole text, and a word's ids are remembered. A tokenizer that normalises or splits in
any other way than ``BY_WORD`` says encodes whole texts. Columns other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import bound_batches, fresh_path, slices

END = 2
MAX_LENGTH = 16
STRIDE = 128
BLOCK_TOKENS = 1 << 18
CACHE = 500_000
STOPS = b".,;:!?*#$%&|<>)]}\""
SIGMA = "\u03a3"  # lower-cased by its place in a word in Python, alone in the library
NULL_ID = -(1 << 63)
TOKENIZER = "word_bpe_49k.json"
#: The normaliser and the splits of a vocabulary whose pre-tokens lie between white space, in its file's own words.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def code_lengths(counts: np.ndarray, most: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits, by package-merge; 0 for ids that never occur."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(ids) == 1:
        out[ids] = 1
    if len(ids) < 2:
        return out
    if len(ids) > 1 << most:
        raise ValueError(f"{len(ids)} ids don't fit codes of {most} bits")
    order = ids[np.argsort(counts[ids], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # each level holds the leaves and the pairs of the level below; a boolean marks the leaves in its sorted order
    leaf_marks, packages = [], np.empty(0)
    for _ in range(most):
        both = np.concatenate([weight, packages])
        by = np.argsort(both, kind="stable")
        leaf_marks.append(by < n)
        row = both[by]
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for leaf in reversed(leaf_marks):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


@lru_cache(maxsize=2)
def _decode_table(lengths: bytes, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next ``most`` bits: the id and its length."""
    n = np.frombuffer(lengths, np.uint8)
    ids, sizes = np.zeros(1 << most, np.uint32), np.ones(1 << most, np.int64)
    order = np.lexsort((np.arange(len(n)), n))
    order = order[n[order] > 0]
    spans = np.left_shift(1, most - n[order].astype(np.int64))
    ids[: spans.sum()] = np.repeat(order, spans)  # canonical codes fill the table in their own order
    sizes[: spans.sum()] = np.repeat(n[order], spans)
    return ids, sizes


def pack(ids: np.ndarray, bounds: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> list[tuple[bytes, np.ndarray]]:
    """For documents ``ids[bounds[i]:bounds[i+1]]``: their bits from a byte's start, and the bit offsets of every stride-th token."""
    size = lengths[ids].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    n_bytes = (total[bounds[1:]] - total[bounds[:-1]] + 7) // 8
    starts = np.concatenate([[0], np.cumsum(n_bytes)])
    counts = np.diff(bounds)
    at = total[:-1] + np.repeat(starts[:-1] * 8 - total[bounds[:-1]], counts)  # bit of each token
    words = np.zeros(int(starts[-1]) // 4 + 3, np.uint64)  # of 32 bits each, in the low half
    if len(ids):
        # a code of at most 32 bits, moved to its bit, lies in two words
        both = (codes.astype(np.uint64) << (64 - lengths.astype(np.uint64)) % np.uint64(64))[ids] >> (at & 31).astype(np.uint64)
        slot = at >> 5
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        words[slot[first]] = np.bitwise_or.reduceat(both >> np.uint64(32), first)
        low = both & np.uint64(0xFFFFFFFF)
        over = np.flatnonzero(low)  # the last code of a word at most
        words[slot[over] + 1] |= low[over]
    raw = words.astype(">u4").tobytes()
    out = []
    for i in range(len(counts)):
        own = at[bounds[i] : bounds[i + 1] : stride] - starts[i] * 8
        out.append((raw[starts[i] : starts[i + 1]], own))
    return out


def unpack(bits: bytes, starts: np.ndarray, counts: np.ndarray, lengths: bytes, most: int = MAX_LENGTH) -> np.ndarray:
    """Decodes runs of ``counts`` tokens from the bit offsets ``starts``, all in step; the runs' ids one after the other."""
    ids, sizes = _decode_table(lengths, most)
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    out = np.empty(int(counts.sum()), np.uint32)
    place = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    order = np.argsort(-counts, kind="stable")  # the longest first, so that those still running are a prefix
    bit, place, left = starts[order].astype(np.int64), place[order], counts[order]
    running = len(order)
    mask, shift = np.uint32((1 << most) - 1), 32 - most
    for step in range(int(left[0]) if len(left) else 0):
        while running and left[running - 1] <= step:
            running -= 1
        b = bit[:running]
        key = (window[b >> 3] >> (shift - (b & 7)).astype(np.uint32)) & mask
        out[place[:running] + step] = ids[key]
        bit[:running] += sizes[key]
    return out


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others in order from U+0100 on. Only those that differ."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + i) for i, b in enumerate(b for b in range(0x100) if b not in printable)}


class Generation(dict):
    """Words' ids; one that isn't there is learned."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word):
        return self.learn(word)


class Encoder:
    """A text's ids as little-endian unsigned 32-bit integers, the end id last.

    Words' ids are remembered in two generations of ``most`` words each: when the young one is full it becomes the old
    one, so words in use stay. The vocabulary composes a text before it lower-cases it, so only ASCII may be lower-cased
    ahead: a capital with a mark may have a composed form in lower case alone. Stops at a word's end are split off: they
    are one pre-token, and never one with a letter or digit. A word of letters in composed form is one pre-token, which
    the library's normaliser only lower-cases, so the library's model takes it directly; every other word takes the
    library's whole way, and so does one with ``<|``, where a special token may be.
    """

    def __init__(self, path: str, end: int = END, most: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_at_white_space(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.end = np.uint32(end).tobytes()
        self.most, self.young, self.old = most, Generation(self._learn), {}

    def _encoded(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids(self, word: bytes) -> bytes:
        own, plain = word.decode("utf-8", "replace"), None
        if own.isalpha() and SIGMA not in own and is_normalized("NFC", own):
            low = own.lower()
            if low.isalpha():
                plain = low.encode().decode("latin-1").translate(self.letters)  # the model's vocabulary writes bytes as letters
        if plain is None:
            return self._encoded([own])[0]
        return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def _known(self, word: bytes) -> bytes:
        ids = dict.get(self.young, word) or self.old.get(word)
        if ids is None:
            ids = self.young[word] = self._ids(word)
        return ids

    def _learn(self, word: bytes) -> bytes:
        if (known := self.old.get(word)) is None:
            stem = word.rstrip(STOPS)
            if b"<|" in word:
                known = self._ids(word)
            elif word.isascii() and (low := word.lower()) != word:
                known = self.young[low]
            # lower-casing, or taking apart what has no composed form, may end a letter in a mark, which is one pre-token with what follows
            elif stem and len(stem) < len(word) and (stem.isalnum() or (own := stem.decode("utf-8", "replace")).lower().isalnum() and is_normalized("NFC", own)):
                known = self._known(stem) + self._known(word[len(stem) :])
            else:
                known = self._ids(word)
        self.young[word] = known
        return known

    def rest(self) -> None:
        """Between tasks only the young generation is kept: words not used since it began are rare."""
        self.old = {}

    def __call__(self, texts: list[bytes | str | None]) -> list[bytes]:
        if not self.by_word:
            whole = [t.decode("utf-8", "replace") if isinstance(t, bytes) else t or "" for t in texts]
            return [x + self.end for x in self._encoded(whole)]
        if len(self.young) > self.most:
            self.young, self.old = Generation(self._learn), dict(self.young)
        get, end = self.young.__getitem__, self.end
        out = []
        for t in texts:
            if not t:
                out.append(end)
                continue
            if isinstance(t, str):
                t = t.encode("utf-8", "replace")
            if t.isascii() and b"<|" not in t:
                t = t.lower()
            out.append(b"".join(map(get, t.split())) + end)
        return out


def splits_at_white_space(path: str) -> bool:
    """Whether a tokenizer file normalises and splits as ``BY_WORD`` says, so that its words can be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    splits = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    plain = all(not x["normalized"] and not x["lstrip"] and not x["rstrip"] and "<|" in x["content"] for x in told.get("added_tokens", []))
    return plain and told.get("normalizer") == BY_WORD["normalizer"] and splits[0].get("pattern") == {"Regex": BY_WORD["pattern"]}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker: its memory of words outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


IDS = "doc_id long, n long, ids binary, counts binary"


def stage_ids(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """Every text's ids, in 2 bytes each where the vocabulary allows, written to the shared folder; and a row per task with its counts of ids."""
    narrow = "<u2" if size <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kinds = np.zeros(size, np.int64), (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        made = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n", "ids", "counts"])
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, z in slices(texts, 1 << 18):
                raw = encoder(tokenizer)(texts[a:z])
                ids = np.frombuffer(b"".join(raw), "<u4")
                own += np.bincount(ids, minlength=size)
                n = [len(x) // 4 for x in raw]
                ends, short = np.cumsum([0, *n]), ids.astype(narrow)
                yield made(batch.column(0)[a:z], n, [short[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], [None] * len(n))
        encoder(tokenizer).rest()
        yield made([None], [None], [None], [own.tobytes()])

    bound_batches(docs.sparkSession)
    path = fresh_path(docs.sparkSession, "token-ids")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    read.mapInArrow(encode, IDS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(IDS).parquet(path)


def count_ids(staged: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all texts, end ids included: the sum of the tasks' counts."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.int64)
        for batch in batches:
            for counts in batch.column(0).drop_null().to_pylist():
                own += np.frombuffer(counts, np.int64)
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(own[some], pa.int64())], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in staged.select("counts").mapInArrow(unfold, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        out[r["id"]] = r["n"]
    return out


BLOCKS = "part int, block int, first_token long, n_tokens long, doc_ids array<long>, counts array<long>, bits binary, checkpoints binary"


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, end: int = END, stride: int = STRIDE, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes codebook and blocks to ``out_dir``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end + 1)
    staged = stage_ids(docs, tokenizer, size)
    lengths = code_lengths(count_ids(staged, size))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(bytes(lengths), stride, end)], "lengths binary, stride int, end int").coalesce(1).write.parquet(f"{out_dir}/codebook")
    sent = spark.sparkContext.broadcast((codes, lengths))
    rows = staged.filter("n is not null").select("doc_id", "n", "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    found = rows.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    bounds = np.array(found or [], np.int64)
    narrow = "<u2" if size <= 1 << 16 else "<u4"

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lengths = sent.value
        for batch in batches:
            raw, n = batch.column(2).to_pylist(), batch.column(1).to_numpy()
            keys = batch.column(0).fill_null(NULL_ID).to_numpy()
            first, last = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
            for a, z in slices(raw):
                packed = pack(np.frombuffer(b"".join(raw[a:z]), narrow), np.concatenate([[0], np.cumsum(n[a:z])]), codes, lengths, stride)
                spread = np.array([zlib.crc32(x) for x in raw[a:z]], np.int64) + np.arange(a, z)
                part = first[a:z] + spread % (last[a:z] - first[a:z] + 1)
                marks = [c.astype("<u8").tobytes() if len(c) > 1 else b"" for _, c in packed]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), batch.column(0)[a:z], batch.column(1)[a:z], pa.array([x for x, _ in packed], pa.binary()), pa.array(marks, pa.binary())], ["part", "doc_id", "n", "bits", "checkpoints"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, rows, held = -1, 0, 0, [], 0

        def made() -> pa.RecordBatch:
            bits, marks, at = [], [], 0
            for _, _, b, c in rows:
                marks.append((np.frombuffer(c, "<u8") if c else np.zeros(1, "<u8")) + at * 8)
                bits.append(b)
                at += len(b)
            columns = [[part], [block], [before], [held], [[x[0] for x in rows]], [[x[1] for x in rows]], [b"".join(bits)], [np.concatenate(marks).astype("<u8").tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "block", "first_token", "n_tokens", "doc_ids", "counts", "bits", "checkpoints"])

        for batch in batches:
            for own, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if own != part:
                    if rows:
                        yield made()
                    part, block, before, rows, held = own, 0, 0, [], 0
                rows.append(row)
                held += row[1]
                if held >= block_tokens:
                    yield made()
                    block, before, rows, held = block + 1, before + held, [], 0
        if rows:
            yield made()

    coded = rows.mapInArrow(pack_rows, "part int, doc_id long, n long, bits binary, checkpoints binary")
    order = [F.col("part"), F.col("doc_id").asc_nulls_first(), F.xxhash64("bits"), F.col("n")]
    coded.repartitionById(parts, F.col("part")).sortWithinPartitions(*order).mapInArrow(blocks, BLOCKS).write.parquet(f"{out_dir}/blocks")


def read_tokens(spark: SparkSession, out_dir: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids (array<int>)."""
    bound_batches(spark)
    book = spark.read.parquet(f"{out_dir}/codebook").first()
    lengths, stride = bytes(book["lengths"]), book["stride"]
    read = spark.read.schema(BLOCKS).parquet(f"{out_dir}/blocks")
    # a row for each part: as many as the writer had tasks
    base, total = [], 0
    for r in sorted(read.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base.append((r["part"], total))
        total += r["n"]
    starts = spark.createDataFrame(base, "part int, base long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                counts = np.array(row["counts"], np.int64)
                runs = (counts + stride - 1) // stride
                sizes = np.full(int(runs.sum()), stride, np.int64)
                sizes[np.cumsum(runs) - 1] = counts - (runs - 1) * stride
                ids = unpack(row["bits"], np.frombuffer(row["checkpoints"], "<u8"), sizes, lengths).astype("<u4")
                ends = np.cumsum(counts)
                own = ends - counts
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(own, ends, strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(counts), row["part"]), pa.int32()), pa.array(own + row["first_token"], pa.int64()), pa.array(counts), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "part", "own", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    out = read.mapInArrow(decode, "doc_id long, part int, own long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the token file to the shared folder and returns doc_id, start, n_tokens, ids_crc32 as read from it."""
    out = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, tokenizer or tokenizer_path())
    return read_tokens(docs.sparkSession, out, with_ids=False)
