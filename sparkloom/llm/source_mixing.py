"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas, then seeded documents.

A document belongs to one or more sources. Documents are aggregated by membership pattern (the set of their sources);
each pattern offers its words once at cost 0, and again, up to ``MAX_COPIES`` times, at a cost that grows with each copy
(convex, so that flow spreads before it repeats). The flow routes words from patterns to the quotas of their sources at
least cost. It is solved on this aggregated graph, component by component; the graph has a node per pattern and per
source, and the operator refuses more than ``MAX_NODES`` of them, as they are configuration rather than data.
A pattern alone with a source needs no search.

A pattern's flow then picks documents: full copies for all, and for the rest a seeded part of the documents. The part is
taken in strata of size (powers of two), the largest first, as a prefix of ``BUCKETS`` hash buckets in each stratum; what
a stratum is over or under its share is carried to the next smaller one, so that each source ends near its quota and
keeps its distribution of sizes, without a sort or a running sum over documents. Rows of one doc_id, text and pattern would share a
bucket, which no prefix can split: the n of them are numbered, in runs of ``RUN`` rows so that no task holds them all, and
dealt evenly over all buckets. Their numbers are 0 to n - 1 whatever the order of rows, so that reruns agree.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating; they share ``FACTOR`` of all words by weight; a
target stops at MAX_COPIES times its source's words, and the excess is shared again by weight until none is above.

Defined cases: null text has size 0 and is never taken; a null source is a source; repeated rows are taken one by one; empty texts and empty tables give zero targets. Only doc_id, source and text are read by ``mix``; ``repeat_mixed`` returns
the columns of its input, each row as often as it is taken.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import staged
from sparkloom.llm.quality_rules import words_of

WEIGHTS = (3, 1, 2)
FACTOR, MAX_COPIES = 1.5, 2
BUCKETS, SEED = 512, "mixing-1"
MAX_NODES, BROADCAST_ROWS, SALTS = 10_000, 200_000, 32
RUN = 1 << 18


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, factor: float = FACTOR, copies: int = MAX_COPIES) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, factor * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > copies * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(copies * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def _components(members: dict[str, list]) -> list[tuple[list, list]]:
    """Patterns and sources that are linked by membership."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, sources in members.items():
        for s in sources:
            root[find(("p", p))] = find(("s", s))
    groups: dict = defaultdict(lambda: ([], []))
    for x in list(root):
        groups[find(x)][x[0] == "s"].append(x[1])
    return [(sorted(p), sorted(s, key=lambda y: (y is None, y or ""))) for p, s in groups.values()]


def min_cost_flow(supply: dict[str, int], members: dict[str, list], quota: dict, copies: int = MAX_COPIES) -> dict[str, dict]:
    """Words from each pattern to each of its sources. Copy k of a pattern's words costs k*k a word."""
    flow: dict[str, dict] = {p: {} for p in supply}
    for patterns, sources in _components(members):
        if len(patterns) == len(sources) == 1:
            flow[patterns[0]] = {s: n for s in sources if (n := min(round(quota[s]), copies * supply[patterns[0]]))}
            continue
        node = {("p", p): i + 1 for i, p in enumerate(patterns)} | {("s", s): len(patterns) + 1 + i for i, s in enumerate(sources)}
        sink, n = len(node) + 1, len(node) + 2
        to, room, cost, out = [], [], [], [[] for _ in range(n)]

        def arc(a, b, cap, c, to=to, room=room, cost=cost, out=out):
            for x, y, r, k in ((a, b, cap, c), (b, a, 0, -c)):
                out[x].append(len(to))
                to.append(y)
                room.append(r)
                cost.append(k)
            return len(to) - 2

        routes = {}
        for p in patterns:
            for k in range(copies):
                arc(0, node["p", p], supply[p], k * k)
            for s in members[p]:
                routes[p, s] = arc(node["p", p], node["s", s], copies * supply[p], 0)
        for s in sources:
            arc(node["s", s], sink, round(quota[s]), 0)
        price = [0] * n  # potentials keep reduced costs from falling below zero, so Dijkstra finds each cheapest path
        while True:
            dist, via, heap = [float("inf")] * n, [-1] * n, [(0, 0)]
            dist[0] = 0
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x]:
                    continue
                for e in out[x]:
                    if room[e] > 0 and (new := d + cost[e] + price[x] - price[to[e]]) < dist[to[e]]:
                        dist[to[e]], via[to[e]] = new, e
                        heapq.heappush(heap, (new, to[e]))
            if via[sink] < 0:
                break
            price = [p + d if d < float("inf") else p for p, d in zip(price, dist, strict=True)]
            path, x = [], sink
            while x:
                path.append(via[x])
                x = to[via[x] ^ 1]
            most = min(room[e] for e in path)
            for e in path:
                room[e] -= most
                room[e ^ 1] += most
        for (p, s), e in routes.items():
            if room[e ^ 1]:
                flow[p][s] = room[e ^ 1]
    return flow


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def pattern_of(sources: Column) -> Column:
    """A text key of the set of sources, any characters in them; a null source counts as one."""
    return F.to_json(F.array_sort(F.array_distinct(F.transform(sources, _key))))


def _members(pattern: str) -> list[str | None]:
    return [None if x == "n" else x[1:] for x in json.loads(pattern)]


def _hash(seed: str) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def _size() -> Column:
    return F.size(words_of(F.col("text"))).cast("bigint")


def _stratum() -> Column:
    return F.floor(F.log2(F.col("size") + 1)).cast("int")


def _dealt(rows: DataFrame, times: DataFrame) -> DataFrame:
    """``rows`` (hash, pattern, ...) that ``times`` counts, with the bucket of each; staged, so that row numbers stay."""
    found = staged(rows.join(times, ["hash", "pattern"]).withColumn("row", F.monotonically_increasing_id()), "mixing-repeated")
    run = F.shiftright("row", RUN.bit_length() - 1).alias("run")
    runs = found.groupBy("hash", "pattern", run).agg(F.count(F.lit(1)).alias("held"))
    # a row for each run of a group, RUN times fewer than its rows, and one more for each partition
    before = runs.withColumn("before", F.sum("held").over(Window.partitionBy("hash", "pattern").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = found.withColumn("run", run).withColumn("own", F.row_number().over(Window.partitionBy("hash", "pattern", "run").orderBy("row")))
    at = numbered.join(before.drop("held"), ["hash", "pattern", "run"])
    place = F.coalesce("before", F.lit(0)) + F.col("own") - 1
    bucket = F.pmod(F.col("hash") + F.floor(place * BUCKETS / F.col("times")), F.lit(BUCKETS)).cast("int")
    return at.withColumn("bucket", bucket).drop("row", "run", "own", "before", "times")


def _repeated(sized: DataFrame) -> DataFrame:
    """Groups of rows with one doc_id, text and pattern: (hash, pattern, times). Counted map-side, so a hot group is a few rows by then."""
    return staged(sized.groupBy("hash", "pattern").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "mixing-times")


def _bucketed(rows: DataFrame, times: DataFrame) -> DataFrame:
    """``rows`` (hash, pattern, ...) with their buckets."""
    once = rows.join(times.select("hash", "pattern"), ["hash", "pattern"], "left_anti").withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int"))
    return once.unionByName(_dealt(rows, times))


def _measured(docs: DataFrame, sources: Column, seed: str) -> tuple[DataFrame, DataFrame]:
    """Of each row: doc_id, first source, pattern, size, stratum, hash, bucket. And the groups of repeated rows."""
    d = docs.select(F.col("doc_id").alias("doc_id"), sources.alias("sources"), F.col("text").alias("text"))
    sized = d.select("doc_id", _key(F.col("sources")[0]).alias("key"), pattern_of(F.col("sources")).alias("pattern"), _size().alias("size"), _hash(seed).alias("hash"))
    sized = staged(sized.withColumn("stratum", _stratum()), "mixing-sizes")
    times = _repeated(sized)
    return staged(_bucketed(sized, times), "mixing-buckets"), times


def _plan(measured: DataFrame) -> tuple[DataFrame, dict, dict]:
    """Per pattern and stratum: full copies and the number of hash buckets that get one more; source sizes and targets."""
    cells = staged(measured.groupBy("pattern", "stratum", "bucket").agg(F.sum("size").alias("size")), "mixing-cells")
    rows = cells.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} membership patterns: sources must be a configured set")
    supply = {r["pattern"]: int(r["size"]) for r in rows}
    members = {p: _members(p) for p in supply}
    sizes: dict = defaultdict(int)
    for p, n in supply.items():
        for s in members[p]:
            sizes[s] += n
    # a word of several sources is offered by each of them but exists once
    aims = targets(dict(sizes)) if all(len(m) == 1 for m in members.values()) else targets(dict(sizes), factor=FACTOR * sum(supply.values()) / max(1, sum(sizes.values())))
    flow = min_cost_flow(supply, members, aims)
    wanted = {p: sum(f.values()) for p, f in flow.items()}

    def thresholds(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total, want = int(pdf["size"].sum()), wanted.get(key[0], 0)
        full = min(MAX_COPIES, want // total) if total else 0
        share, carry, out = (want - full * total) / total if total else 0.0, 0.0, []
        for stratum, part in sorted(pdf.groupby("stratum"), key=lambda x: -x[0]):
            sums = part.set_index("bucket")["size"].reindex(range(BUCKETS), fill_value=0).cumsum()
            quota = carry + share * float(sums.iloc[-1])
            ends = [0.0, *map(float, sums)]
            best = min(range(BUCKETS + 1), key=lambda k: abs(ends[k] - quota))
            carry = quota - ends[best]
            out.append((key[0], int(stratum), int(full), best))
        return pd.DataFrame(out, columns=["pattern", "stratum", "full", "some"])

    # cells of a pattern: at most 64 strata of BUCKETS each, whatever the number of documents
    plan = staged(cells.groupBy("pattern").applyInPandas(thresholds, "pattern string, stratum int, full int, some int"), "mixing-plan")
    return plan, dict(sizes), aims


def _taken(measured: DataFrame, plan: DataFrame) -> DataFrame:
    copies = F.coalesce(F.col("full") + (F.col("bucket") < F.col("some")).cast("int"), F.lit(0))
    if plan.count() <= BROADCAST_ROWS:
        return measured.join(F.broadcast(plan), ["pattern", "stratum"], "left").withColumn("copies", copies)
    # few cells hold most rows: a plan row for each salt
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return measured.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int")).join(salted, ["pattern", "stratum", "salt"], "left").withColumn("copies", copies)


def mix(docs: DataFrame, sources: Column | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document, sizes and targets of its first source."""
    measured, _ = _measured(docs, F.array("source") if sources is None else sources, seed)
    plan, sizes, aims = _plan(measured)
    spark = docs.sparkSession
    own = spark.createDataFrame([("n" if s is None else f"s{s}", int(sizes[s]), float(aims[s])) for s in sizes], "key string, source_size long, target double")
    out = _taken(measured, plan)
    return out.join(F.broadcast(own), "key", "left").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_mixed(docs: DataFrame, sources: Column | None = None, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    sources = F.array("source") if sources is None else sources
    measured, times = _measured(docs, sources, seed)
    plan, _, _ = _plan(measured)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id").alias("doc_id"), sources.alias("sources"), F.col("text").alias("text"))
    m = packed.select("whole", pattern_of(F.col("sources")).alias("pattern"), _size().alias("size"), _hash(seed).alias("hash")).withColumn("stratum", _stratum())
    taken = _taken(_bucketed(m.filter("size > 0"), times), plan).filter("copies > 0")
    return taken.select("whole", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("whole.*")
