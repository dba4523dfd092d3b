"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``distance`` bits are linked. The bits are grouped into m
partitions, correlated bits together; a query gives partition p a threshold
t_p >= -1 (-1: not probed) with sum(t_p + 1) = distance + 1. If a pair differed
by more than t_p in every partition it would differ by more than ``distance``
in all, so probing each partition up to its threshold finds every link. The
thresholds of each fingerprint come from a dynamic programme over candidate
counts estimated on a bounded sample, so a crowded partition value is probed
by few. Estimates steer the work; the links found are the same for any.

Only distinct fingerprints take part: copies meet in one row by pre-aggregation.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_value, materialise

by_value(__name__)

BITS = 64
SEED = 42
SAMPLE = 1024  # fingerprints on which candidate counts are estimated
PARTS = (2, 3, 4)  # numbers of partitions to choose from
PROBE_COST, CANDIDATE_COST = 4.0, 1.0  # a shuffled probe against a compared candidate
CHUNK = 1 << 16


def simhash(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint: a bit is 1 if set in over half of the XXH64 values
    of the word shingles (repeats included); a shorter text is one shingle;
    one without words has fingerprint zero."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space separates
    if not words:
        return 0
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) > shingle else iter([words])
    while part := list(itertools.islice(grams, CHUNK)):
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_py(), shingle) for t in texts], pa.int64())

    return prints(text.cast("string"))


def bit_correlations(nodes: DataFrame) -> np.ndarray:
    """64 x 64 correlations of the bits over all distinct fingerprints."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fps, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        cell = np.append(both.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cell)), pa.int32()), pa.array(cell)], names=["cell", "n"])

    cells = nodes.select("fp").mapInArrow(counted, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    found = np.zeros(BITS * BITS + 1)
    for r in cells.collect():  # 4097 rows whatever the input
        found[r["cell"]] = r["n"]
    n = max(found[-1], 1.0)
    both = found[:-1].reshape(BITS, BITS) / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return (both - np.outer(mean, mean)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal width; each grows by the bit most correlated
    with those it has."""
    near = np.abs(correlation)
    free = set(range(BITS))
    groups = []
    for g in range(m):
        width = (BITS - sum(map(len, groups)) + (m - g) - 1) // (m - g)
        own = [max(sorted(free), key=lambda b: sum(near[b, c] for c in free))]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: near[b, own].sum())
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def flips(bits: list[int], most: int) -> np.ndarray:
    """XOR masks that flip at most ``most`` of the bits."""
    return np.array([_mask(list(c)) for k in range(most + 1) for c in itertools.combinations(bits, k)], dtype=np.uint64)


def thresholds(fps: np.ndarray, groups: list[list[int]], distance: int, sample: np.ndarray, total: int) -> tuple:
    """(units per row and partition, cost per row): the cheapest allocation of
    distance + 1 units, u units meaning threshold u - 1. Candidates within a
    threshold: the share seen in the sample, or a uniform spread if larger."""
    units = distance + 1
    fps = fps.astype(np.uint64)
    cost = np.zeros((len(groups), units + 1, len(fps)))
    for p, bits in enumerate(groups):
        apart = np.bitwise_count((fps[:, None] ^ sample[None, :]) & np.uint64(_mask(bits)))
        probes, seen = 0.0, np.zeros(len(fps))
        for u in range(1, units + 1):
            probes += len(list(itertools.combinations(range(len(bits)), u - 1)))
            seen = seen + (apart == u - 1).sum(axis=1)
            expected = np.maximum(seen * (total / max(len(sample), 1)), total * probes / 2.0 ** len(bits))
            cost[p, u] = PROBE_COST * probes + CANDIDATE_COST * expected
    best = np.full((units + 1, len(fps)), np.inf)
    best[0] = 0.0
    picks = []
    for p in range(len(groups)):
        new = np.full_like(best, np.inf)
        pick = np.zeros(best.shape, dtype=np.int64)
        for have in range(units + 1):
            for u in range(have + 1):
                c = best[have - u] + cost[p, u]
                better = c < new[have]
                new[have] = np.where(better, c, new[have])
                pick[have] = np.where(better, u, pick[have])
        best = new
        picks.append(pick)
    given, left = np.zeros((len(fps), len(groups)), dtype=np.int64), np.full(len(fps), units)
    rows = np.arange(len(fps))
    for p in reversed(range(len(groups))):
        given[:, p] = picks[p][left, rows]
        left = left - given[:, p]
    return given, best[units]


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) with a > b: every pair of distinct fingerprints ``fp`` that
    differ in at most ``distance`` bits. A fingerprint has a bounded number of
    such neighbours, so the pairs are linear in the distinct fingerprints."""
    total = nodes.count()
    # a chance sample (by hash), bounded by SAMPLE rows
    sample = np.array([r["fp"] for r in nodes.select("fp").orderBy(F.xxhash64(F.col("fp") + 1), "fp").limit(SAMPLE).collect()],
                      dtype=np.int64).view(np.uint64)
    correlation = bit_correlations(nodes)
    plans = [group_bits(correlation, m) for m in PARTS]
    groups = min(plans, key=lambda g: thresholds(sample, g, distance, sample, total)[1].mean() if len(sample) else 0)
    masks = [_mask(g) for g in groups]
    # XOR masks by partition, nearest first, and how many a threshold takes
    near = [flips(bits, distance) for bits in groups]
    counts = [[0, *itertools.accumulate(len(list(itertools.combinations(bits, k))) for k in range(distance + 1))] for bits in groups]

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for at in range(0, len(every), 2048):
                fps = every[at:at + 2048]
                given, _ = thresholds(fps, groups, distance, sample, total)
                for p in range(len(groups)):
                    for u in range(1, distance + 2):
                        own = fps[given[:, p] == u]
                        if len(own):
                            value = ((own & np.uint64(masks[p]))[:, None] ^ near[p][None, :counts[p][u]]).ravel()
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(value), p), pa.int32()), pa.array(value.view(np.int64)),
                                 pa.array(np.repeat(own, counts[p][u]).view(np.int64))], names=["part", "value", "a"])

    asked = nodes.select("fp").mapInArrow(probes, "part int, value bigint, a bigint")
    index = nodes.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
        for p, m in enumerate(masks)])).alias("i"), F.col("fp").alias("b")).select("i.*", "b")
    # the Hamming check is part of the join: candidates are compared, not emitted
    near_enough = (F.col("b") < F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return (asked.join(index, ["part", "value"]).where(near_enough).select("a", "b").distinct())


def _settled(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(b, a) as decimal(38,0)))")).first())


def stars(edges: DataFrame) -> DataFrame:
    """Connected components as stars (a, root), root the smallest member, by
    alternating large-star and small-star steps; each step is an aggregate of
    minima and a join, written to the shared folder."""
    edges = materialise(edges)
    before = None
    while (now := _settled(edges)) != before and now[0]:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select("a", F.col("b").alias("root"))


def components(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(fp, component_id, keeper) of every distinct fingerprint of ``prints``
    (key, fp): component_id is the smallest key reachable over links, keeper
    the fingerprint it has there (the smallest, if rows share that key). Null
    keys count last: they are component_id only where no other is."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("key").alias("key")))
    roots = stars(links(nodes, distance))
    rooted = nodes.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select(
        "fp", "key", F.coalesce("root", "fp").alias("root"))
    first = F.min(F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("key"), F.col("fp").alias("fp"))).alias("f")
    return rooted.join(rooted.groupBy("root").agg(first), "root").select(
        "fp", F.col("f.key").alias("component_id"), F.col("f.fp").alias("keeper"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 2) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) of every row.

    Null and empty texts have fingerprint zero and link like any other.
    Repeated rows each get their row; an empty table gives none; only key and
    text are read, so other columns cannot clash. Whole texts are hashed, in
    blocks of shingles, so a very long text needs memory for its words only."""
    prints = materialise(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle).alias("fp")))
    out = prints.join(components(prints, distance), "fp")
    return out.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """One row of each group, all columns as they were: the row with the
    smallest key. Of rows that share key and fingerprint the one with the
    smallest digest of its text stays, once. A null key counts as the largest;
    null and empty texts are equal; an empty table gives none; all columns
    travel in a struct, so names cannot clash.

    Each fingerprint is made once: the rows are met again by key and digest of
    the text, which costs a small part of a fingerprint."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    prints = materialise(docs.select(F.col(key).alias("key"), digest.alias("digest"), fingerprint(F.col(text), shingle).alias("fp")))
    chosen = components(prints.select("key", "fp"), distance).where("fp = keeper").select(
        F.col("fp").alias("f"), F.col("component_id").alias("k"))
    firsts = prints.join(chosen, (F.col("fp") == F.col("f")) & F.col("key").eqNullSafe(F.col("k"))) \
        .groupBy("k", "f").agg(F.min("digest").alias("d")).select("k", "d")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"), digest.alias("digest"))
    kept = packed.join(firsts, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left_semi")
    return kept.dropDuplicates(["key", "digest"]).select("row.*")
