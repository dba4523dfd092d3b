"""Removal of long word sequences that an earlier document already has, by
prefix-partitioned suffix trees.

1. Exact copies are found by a digest aggregate; only the first of each goes on.
2. Pruning without loss: the smallest hash of the word n-grams inside a window
   (its anchor) is the same for equal windows, so a window can repeat only if
   its anchor occurs in two documents. Anchors are few and are counted by one
   aggregate; suffixes (window starts) without a shared anchor are dropped.
3. The remaining suffixes, cut at the window length, are dealt into groups by
   variable-length prefixes: one word where that is rare, more words where a
   prefix has more suffixes than a group may hold. A suffix carries its first
   six words and a 128-bit fingerprint of all, which stands for the edge
   below them. In a group the sorted suffixes are the leaves of its subtree in
   order; an internal node as deep as the window is a run of equal leaves and
   gives a repeat with its first document.
4. Occurrences in later documents are marked; covered words go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_value, discard, materialise, shuffle_partitions

by_value(__name__)

WINDOW = 50
GRAM = 20  # words in an anchor
GROUP = 100_000  # suffixes of a subtree
EDGE = 6  # words that a suffix carries; its fingerprint has the rest
LADDER = (1, 2, 3, 4, EDGE)  # prefix lengths in words, then the fingerprint too
TABLE = 50_000  # distinct suffixes that a task holds before it hands them on
#: Odd multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

_powers: dict = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse modulo 2^64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 14)
        _powers[base] = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b, dtype=np.uint64)]))
                              for b in (base, pow(base, -1, 1 << 64)))
    up, down = _powers[base]
    return up[:n], down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of each ``width`` consecutive words."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _power(base, n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return _mixed((total[width:] - total[:-width]) * down[:n - width + 1])


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    return window_minimum(rolling(hashes, gram), window - gram + 1) if len(hashes) >= window else np.empty(0, np.uint64)


def _anchors(window: int, gram: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, values = batch.column(2), [], []
            for i in range(batch.num_rows):
                own = np.unique(window_anchors(word_hashes(texts[i].as_py().encode().split()), window, gram))
                if len(own):
                    rows.append(np.full(len(own), i, np.int32))
                    values.append(own)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (0, 1)),
                                                  pa.array(np.concatenate(values).view(np.int64))],
                                                 names=["d1", "d2", "anchor"])
    return found


def _windows(window: int, gram: int):
    """Occurrences (key, d1, d2, start, w1, w2) of the windows whose anchor is
    shared, and once per task and distinct window its first words with the
    first and last key (start -1)."""
    names = ["key", "d1", "d2", "start", "w1", "w2", "words", "last"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict = {}

        def flush(kind):
            rows = [(lo, hi, w1, w2, t) for (w1, w2), (t, lo, hi) in table.items()]
            table.clear()
            if rows:
                lo, hi, w1, w2, t = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lo, kind), *[pa.nulls(len(rows), pa.int64())] * 2, pa.array([-1] * len(rows), pa.int32()),
                     pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(t, pa.string()), pa.array(hi, kind)],
                    names=names)

        for batch in batches:
            kind = batch.column(0).type
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                words = batch.column(2)[i].as_py().encode().split()
                hashes = word_hashes(words)
                shared = batch.column(4)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                live = np.flatnonzero(np.isin(window_anchors(hashes, window, gram), shared))
                first, second = (rolling(hashes, window, b)[live].view(np.int64) for b in BASES)
                for start, w1, w2 in zip(live.tolist(), first.tolist(), second.tolist()):
                    have = table.get((w1, w2))
                    if have is None:
                        table[w1, w2] = [b" ".join(words[start:start + EDGE]).decode(), key, key]
                    else:
                        have[1], have[2] = min(have[1], key), max(have[2], key)
                row = pa.array([i] * len(live), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(row) for c in (0, 1, 3)), pa.array(live, pa.int32()), pa.array(first),
                     pa.array(second), pa.nulls(len(live), pa.string()), pa.nulls(len(live), kind)], names=names)
                if len(table) > TABLE:
                    yield from flush(kind)
        if table:
            yield from flush(kind)
    return found


def _deep_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the leaves of the subtrees in order. Leaves are as long as the
    window, so a node of that depth is a run of equal leaves; it is a repeat
    if its occurrences lie in two documents or more. Works on any amount of
    leaves with one open node."""
    node, kind = None, None

    def close(rows):
        if node is not None and node[3] < node[4]:
            rows.append(node[1:4])

    for batch in batches:
        kind = batch.column(3).type
        out: list = []
        for words, w1, w2, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
            if node is not None and [words, w1, w2] == node[:3]:
                node[3], node[4] = min(node[3], lo), max(node[4], hi)
            else:
                close(out)
                node = [words, w1, w2, lo, hi]
        yield _nodes(out, kind)
    if node is not None:
        out = []
        close(out)
        yield _nodes(out, kind)


def _nodes(rows: list, kind) -> pa.RecordBatch:
    w1, w2, lo = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), pa.array(lo, kind)],
                                      names=["w1", "w2", "first"])


def with_prefix(leaves: DataFrame, group: int = GROUP) -> DataFrame:
    """The leaves (``words``) with the shortest prefix of the ladder that at
    most ``group`` leaves have (at last with the fingerprint: equal windows
    come once per task)."""
    cut = lambda n: F.substring_index("words", " ", n)
    out = leaves.withColumn("n", F.lit(LADDER[0])).withColumn("prefix", cut(LADDER[0]))
    for n, more in zip(LADDER, (*LADDER[1:], None)):
        crowded = materialise(out.where(F.col("n") == n).groupBy("prefix").count()
                              .where(F.col("count") > group).select("prefix", F.lit(True).alias("crowded")))
        if crowded.isEmpty():
            break
        out = (out.join(crowded, "prefix", "left")
               .withColumn("n", F.when(F.col("crowded"), F.lit(more or 1 << 30)).otherwise(F.col("n")))
               .withColumn("prefix", F.when(F.col("crowded"), cut(more) if more else F.concat_ws(" ", "words", "w1")).otherwise(F.col("prefix")))
               .drop("crowded"))
    return out


def repeated_windows(rows: DataFrame, firsts: DataFrame, window: int = WINDOW, gram: int = GRAM,
                     group: int = GROUP) -> DataFrame:
    """(key, d1, d2, starts) of the windows of ``rows`` (key, text, d1, d2)
    that also start in a row with a smaller key, for the first row of each
    text (``firsts``: d1, d2, first)."""
    kind = rows.schema["key"].dataType.simpleString()
    texts = rows.select("key", "d1", "text", "d2")
    anchors = materialise(rows.select("d1", "d2", "text").mapInArrow(
        _anchors(window, gram), "d1 bigint, d2 bigint, anchor bigint"))
    shared = anchors.groupBy("anchor").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi").select("anchor")
    own = (anchors.join(shared, "anchor").groupBy("d1", "d2").agg(F.collect_set("anchor").alias("anchors"))
           .join(firsts.withColumnRenamed("first", "key"), ["d1", "d2"]))  # a document's own anchors, so bounded
    found = (texts.join(own, ["key", "d1", "d2"]).select("key", "d1", "text", "d2", "anchors")
             .mapInArrow(_windows(window, gram), f"key {kind}, d1 bigint, d2 bigint, start int, w1 bigint, w2 bigint, "
                                                 f"words string, last {kind}"))
    found = materialise(found)
    leaves = with_prefix(found.where("start < 0").select(
        "words", "w1", "w2", F.col("key").alias("lo"), F.col("last").alias("hi")), group)
    n = shuffle_partitions(rows.sparkSession)
    nodes = (leaves.select("words", "w1", "w2", "lo", "hi", F.xxhash64("prefix").alias("group")).repartition(n, "group")
             .sortWithinPartitions("words", "w1", "w2").drop("group").mapInArrow(_deep_nodes, f"w1 bigint, w2 bigint, first {kind}"))
    later = (found.where("start >= 0").select("key", "d1", "d2", "start", "w1", "w2").join(nodes, ["w1", "w2"])
             .where("key > first"))
    starts = materialise(later.groupBy("key", "d1", "d2").agg(F.collect_set("start").alias("starts")))
    for spent in (anchors, found):
        discard(spent)
    return starts


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, starts, copy in zip(*(batch.column(i) for i in (1, 2, 3))):
                words = text.as_py().encode().split()
                n = len(words)
                gone = np.zeros(n + 1, np.int64)
                if copy.as_py() and n >= window:
                    gone[0] = 1
                elif starts.is_valid:
                    at = starts.values.to_numpy(zero_copy_only=False)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                cover = np.cumsum(gone)[:n] > 0
                totals.append(n)
                removed.append(int(cover.sum()))
                kept.append(b" ".join(words if not removed[-1] else [words[i] for i in np.flatnonzero(~cover)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])
    return cut


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
                   group: int = GROUP, carry: list[str] | tuple | None = None) -> DataFrame:
    """(row struct of the carried columns (default: key), n_words, n_removed,
    kept) of every row; kept: the remaining words joined by one space.

    A word goes if it lies in a window whose word sequence also starts in a
    row with a smaller key. Rows with equal keys do not remove from each
    other; null keys neither remove nor lose. Null and empty texts have no
    words. Repeated rows get equal results; empty tables give no rows; carried
    columns travel in a struct, so their names cannot clash. A very long text
    is held by one task at a time, as words."""
    carry = [key] if carry is None else list(carry)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # two hashes of different seeds name a text
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(key).alias("key"), body.alias("text"),
                       F.xxhash64(body).alias("d1"), F.xxhash64(F.lit(1), body).alias("d2"))
    keyed = rows.where("key is not null")
    names = materialise(keyed.select("key", "d1", "d2").distinct())
    firsts = names.groupBy("d1", "d2").agg(F.min("key").alias("first"))
    starts = repeated_windows(keyed, firsts, window, gram, group)
    copies = names.join(firsts, ["d1", "d2"]).where("key > first").select("key", "d1", "d2", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy"))
    verdict = copies.union(starts.select("key", "d1", "d2", "starts", F.lit(False)))
    out = rows.join(verdict, ["key", "d1", "d2"], "left").select("row", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    kind = out.schema["row"].dataType.simpleString()
    return out.mapInArrow(_cut(window), f"row {kind}, n_words bigint, n_removed bigint, kept string")
