"""SimHash near-duplicates: documents whose fingerprints differ in at most 2 of 64 bits are linked; classes are components.

A fingerprint's bit is 1 if it is set in over half the XXH64 hashes (seed 42) of the text's shingles: 3 words, repeats
included, A-Z lower-cased, joined by a space. A text of fewer words is one shingle; one without words has fingerprint 0
and is linked like any other.

Candidates come from pigeonring filtering. The 64 bits are a ring of 8 segments; if two fingerprints differ in at most 2
bits, some segment starts a chain in which any first l segments differ in at most l * 2 / 8 bits: none in the first 3, at
most 1 in the first 7. So the first 3 segments are equal, and of the next 4 the first two or the last two are: an
equi-join on 40 bits for each of 8 starts and 2 halves. Pairs that meet are held against the whole chain, then against
the full distance.

Only distinct fingerprints are joined; copies are their members. Buckets (fingerprints with equal 40 bits) of up to
``PAIRS_BELOW`` are paired. In larger ones all pairs would be too many: there, each fingerprint is sent to itself and to the
points one bit away; fingerprints that meet at a point (65 at most do) are within 2 bits, and any two within 2 bits meet
at one. Each is linked to the smallest of its point, so no link between classes is lost and rows stay linear.

Components: alternating large and small stars over the links of distinct fingerprints, each round written to the shared
folder. Nothing of the documents reaches the driver but counts.

Defined cases: null text is an empty one; a null doc_id takes part but names no class unless all of a class are null (then the class is
null); repeated rows each get a row; empty tables give empty results. Only doc_id and text are read by ``near_duplicates``; ``keep_one``
returns the columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import bound_batches, fresh_path, lower_words, slices, staged
from sparkloom.llm.files import make_dir, open_in, put

BITS, DISTANCE, SEGMENTS, SHINGLE, SEED = 64, 2, 8, 3, 42
PAIRS_BELOW = 16


def fingerprint_all(texts: list[str | None]) -> np.ndarray:
    """Fingerprints as signed 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        w = lower_words(text)
        if not w:
            continue
        shingles = map(b" ".join, zip(w, w[1:], w[2:], strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
        h = np.array([digest(s, SEED) for s in shingles], "<u8")
        votes = np.zeros(BITS, np.int64)
        for a in range(0, len(h), 1 << 16):
            votes += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[i] = np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def _masks() -> list[tuple[int, int]]:
    """(start, mask) of the 16 keys: 3 segments of the chain and a half of the next 4."""
    width = BITS // SEGMENTS
    piece = lambda j: ((1 << width) - 1) << (width * (j % SEGMENTS))
    out = []
    for i in range(SEGMENTS):
        chain = piece(i) | piece(i + 1) | piece(i + 2)
        out += [(i, chain | piece(i + 3) | piece(i + 4)), (i, chain | piece(i + 5) | piece(i + 6))]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _chain(diff: Column, start: Column) -> Column:
    """Whether the differing bits keep the ring's budgets from segment ``start`` on."""
    width = BITS // SEGMENTS
    # the ring turned so that the start is the lowest segment
    turned = F.when(start == 0, diff).otherwise(F.call_function("shiftrightunsigned", diff, (start * width).cast("int")).bitwiseOR(F.call_function("shiftleft", diff, (F.lit(BITS) - start * width).cast("int"))))
    ok = F.lit(True)
    for n in range(1, SEGMENTS + 1):
        mask = _signed((1 << (width * n)) - 1)
        ok = ok & (F.bit_count(turned.bitwiseAND(F.lit(mask).cast("long"))) <= n * DISTANCE // SEGMENTS)
    return ok


def links(nodes: DataFrame, pairs_below: int = PAIRS_BELOW) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints ``fp``, enough for the components of all pairs within 2 bits."""
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(start).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("part")) for k, (start, mask) in enumerate(_masks())])
    rows = nodes.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.start", "key.part")
    sizes = rows.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = staged(rows.join(sizes, ["k", "part"]), "simhash-buckets")  # random fingerprints rarely share 40 bits
    small = met.filter(F.col("n") <= pairs_below)
    a, b = small.select("k", "part", "start", F.col("fp").alias("a")), small.select("k", "part", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    paired = a.join(b, ["k", "part"]).filter("a < b").filter(_chain(diff, F.col("start"))).filter(F.bit_count(diff) <= DISTANCE).select("a", "b")
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(BITS)])
    dense = met.filter(F.col("n") > pairs_below).select("fp").distinct().select("fp", F.explode(points).alias("point"))
    stars = dense.groupBy("point").agg(F.collect_set("fp").alias("at")).filter(F.size("at") > 1)  # 65 at most meet at a point
    starred = stars.select(F.array_min("at").alias("a"), F.explode("at").alias("b")).filter("a < b")
    return paired.unionByName(starred).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component. Roots map to themselves."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    e = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "components")
    before = state(e)
    while before[0]:
        # large star: every larger neighbour of a node goes to the smallest neighbour
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = staged(both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct(), "components")
        # small star: every smaller neighbour of a node, and the node, go to the smallest
        least = e.groupBy("b").agg(F.min("a").alias("m"))
        moved = e.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        e = staged(moved.filter("a < b").distinct(), "components")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, z in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.array(fingerprint_all(texts[a:z]))], ["doc_id", "fp"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def classes(nodes: DataFrame, best: Column) -> DataFrame:
    """Per distinct fingerprint: ``first``, the smallest ``best`` of its component. ``nodes`` (fp, first) is read several times."""
    star = components(links(nodes.select("fp")))
    linked = nodes.join(star, F.col("fp") == F.col("node")).select("fp", "root", "first")
    of_root = linked.groupBy("root").agg(best.alias("first"))
    inside = staged(linked.select("fp", "root").join(of_root, "root").select(F.col("fp").alias("linked"), F.col("first").alias("smallest")), "simhash-classes")
    return nodes.join(inside, F.col("fp") == F.col("linked"), "left").select("fp", F.when(F.col("linked").isNotNull(), F.col("smallest")).otherwise(F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    prints = staged(_fingerprints(docs), "simhash-prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    found = staged(classes(nodes, F.min("first")), "simhash-first")
    out = prints.join(found, "fp")  # both sides are scans, so a fingerprint with a third of all rows is split
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: that of the smallest doc_id (null last), then the first read."""
    bound_batches(docs.sparkSession)
    at, names = docs.columns.index("text"), docs.columns
    fp = next(c for c in ("fp", *(f"fp_{i}" for i in range(len(names) + 1))) if c.lower() not in {n.lower() for n in names})
    uid = f"{fp}_row"
    while uid.lower() in {n.lower() for n in names}:
        uid += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, z in slices(texts):
                part = batch.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fingerprint_all(texts[a:z]))], [*names, fp])

    schema = T.StructType([*docs.schema.fields])
    schema.add(fp, "long")
    rows = staged(docs.mapInArrow(run, schema).withColumn(uid, F.monotonically_increasing_id()), "simhash-rows")  # the row numbers are fixed by this
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(uid).alias("u"))
    nodes = staged(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first")), "simhash-nodes")
    first = staged(classes(nodes, F.min("first")).select("fp", F.col("first.u").alias("u")), "simhash-stay")
    ids = rows.select(F.col(fp).alias("fp"), F.col(uid).alias("uid"))
    return without(rows, uid, ids.join(first, "fp").filter("uid <> u").select("uid")).select(*[F.col(f"`{c}`") for c in names])


def without(rows: DataFrame, uid: str, gone: DataFrame) -> DataFrame:
    """Staged ``rows`` less those whose number ``uid`` is among ``gone`` (uid). Only numbers are shuffled: a number's upper bits
    name the part of the table that the row was written in, so each part's numbers are a file that its reader looks into.
    """
    folder = fresh_path(rows.sparkSession, "simhash-gone")
    make_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = -1, []
        for batch in batches:
            parts, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(parts).tolist():
                if p != part and held:
                    put(f"{folder}/{part}", np.concatenate(held).astype("<i8").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], ["part"])
                    held = []
                part = p
                held.append(numbers[parts == p])
        if held:
            put(f"{folder}/{part}", np.concatenate(held).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], ["part"])

    numbered = gone.select(F.shiftright("uid", 33).alias("part"), "uid").repartition("part").sortWithinPartitions("part", "uid")
    told = frozenset(r["part"] for r in numbered.mapInArrow(write, "part long").collect())  # a number for each part of the table
    sent = rows.sparkSession.sparkContext.broadcast(told)
    at = rows.columns.index(uid)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbers = -1, None
        for batch in batches:
            own = batch.column(at).to_numpy()
            stay = np.ones(len(own), bool)
            for p in np.unique(own >> 33).tolist():
                if p not in sent.value:
                    continue
                if p != part:
                    with open_in(f"{folder}/{p}") as f:
                        part, numbers = p, np.frombuffer(f.read(), "<i8")
                inside = own >> 33 == p
                place = np.minimum(np.searchsorted(numbers, own[inside]), len(numbers) - 1)
                stay[inside] = numbers[place] != own[inside]
            yield batch.filter(pa.array(stay))

    return rows.mapInArrow(keep, rows.schema)
