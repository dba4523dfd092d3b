"""Maximal runs of periodically repeated words, by descending-LCP Kruskal.

The suffixes of a document's words are sorted by prefix doubling, on blocks of
documents at once; a word that only one place of its document has is settled
after the first step. Neighbours in that order with their common-prefix length
(LCP) are the edges of a forest over the positions. Edges are united by falling
LCP with union-find; a class keeps its positions in order, and the smaller of
two classes goes into the larger. Two positions u < v that become neighbours
in a class at LCP l agree on l words, so if q = v - u <= l the words from u
repeat with period q over q + l words: a seed. It is a run if the word before
u differs from the word before v, as l already is the longest extension to
the right.

Each run of two periods or more comes once and with its smallest period q. If
it starts at s, then s and s + q have LCP length - q >= q, and no k between
them is in their class at that LCP: k - s would be a second period on at least
q + (k - s) words, so the greatest common divisor of both would be a period,
against q being the smallest. For the same reason neighbours never seed a
multiple of a period: the place one period on is in the class before.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_value

by_value(__name__)

EXPONENT = 4  # a run has at least so many periods
LENGTH = 6  # and at least so many words
BLOCK_WORDS = 250_000  # sorted together; a longer document is a block of its own


def least_lcp(exponent: int, length: int) -> int:
    """The smallest LCP that the seed of a run can have."""
    return min(max(length - q, (exponent - 1) * q) for q in range(1, length + 1))


def word_ids(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the words of all documents as numbers that no two
    documents share, each document after a number of its own that ends the
    one before; where each document's words start."""
    parts, first, at, base = [], [], 0, 0
    for words in documents:
        own = dict.fromkeys(words)
        own.update(zip(own, range(base + 1, base + 1 + len(own))))
        part = np.empty(len(words) + 1, np.int64)
        part[0] = base
        part[1:] = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
        parts.append(part)
        first.append(at + 1)
        at += len(part)
        base += len(own) + 1
    parts.append(np.array([base], np.int64))
    return np.concatenate(parts), np.array(first, np.int64)


def sorted_neighbours(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, lcp): neighbours in the sorted order of the suffixes that agree
    on ``least`` words or more. Places with equal rank after step k agree on
    2^k words; a place alone in its rank has its final one."""
    n = len(ids)
    count = np.bincount(ids)
    rank = (np.cumsum(count) - count)[ids]
    live = np.flatnonzero(count[ids] > 1)
    levels, reach, kept = [rank], 1, live
    while len(live):
        after = np.minimum(live + reach, n - 1)  # beyond the end is the last end mark, as good as any
        key = rank[live] * (n + 1) + rank[after]
        order = np.argsort(key, kind="stable")
        places, key = live[order], key[order]
        new = np.empty(len(key), bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        # within an old rank, a new one is the old plus the places before it
        old = rank[places]
        head = np.empty(len(key), bool)
        head[0] = True
        np.not_equal(old[1:], old[:-1], out=head[1:])
        before = start - np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))[start]
        rank = rank.copy()
        rank[places] = np.repeat(old[start] + before, size)
        levels.append(rank)
        live = np.sort(places[np.repeat(size > 1, size)])
        reach *= 2
        if reach <= least:
            kept = live  # only these can agree on as many words
    order = kept[np.argsort(rank[kept], kind="stable")]
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        # an end mark stops every match, so no place passes the end
        lcp += (levels[k][np.minimum(a + lcp, n - 1)] == levels[k][np.minimum(b + lcp, n - 1)]).astype(np.int64) << k
    good = lcp >= least
    return a[good], b[good], lcp[good]


def seeds(a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(u, v, l): places u < v that become neighbours in a class when classes
    are united by falling LCP, with the LCP at that moment."""
    order = np.argsort(-lcp, kind="stable")
    owner: dict[int, int] = {}  # place or class -> the class it went into
    places: dict[int, list[int]] = {}

    def root(x):
        while (up := owner.get(x, x)) != x:
            owner[x] = owner.get(up, up)
            x = up
        return x

    for x, y, at in zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist()):
        x, y = root(x), root(y)
        large, small = places.get(x) or [x], places.get(y) or [y]
        if len(large) < len(small):
            x, y, large, small = y, x, small, large
        last = len(small) - 1
        for i, p in enumerate(small):
            k = bisect(large, p)
            if k and (i == 0 or small[i - 1] < large[k - 1]):
                yield large[k - 1], p, at
            if k < len(large) and (i == last or small[i + 1] > large[k]):
                yield p, large[k], at
        if last:
            large += small
            large.sort()  # two ascending stretches are merged
        else:
            insort(large, small[0])
        owner[y] = x
        places[x] = large
        places.pop(y, None)


def runs_of(documents: list[list[bytes]], exponent: int = EXPONENT, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, in that order."""
    ids, first = word_ids(documents)
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    spots = []
    for u, v, at in seeds(*sorted_neighbours(ids, least_lcp(exponent, length))):
        q = v - u
        if q <= at and q + at >= length and q + at >= exponent * q and ids[u - 1] != ids[v - 1]:
            spots.append((u, q + at, q))
    for u, size, q in sorted(spots):
        d = int(np.searchsorted(first, u, side="right")) - 1
        found[d].append((u - int(first[d]), size, q))
    for own in found:
        own.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, size, q in runs:
        change[start + q] += 1
        change[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _blocks(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of the texts, some at a time."""
    block, held = [], 0
    for text in texts:
        words = text.as_py().encode().split()
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append(words)
        held += len(words)
    if block:
        yield block


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT,
                  length: int = LENGTH) -> DataFrame:
    """(key, n_words, runs, kept) of every row: the maximal runs (start,
    length, period; by start, then period) of at least ``length`` words and
    ``exponent`` (2 at least) smallest periods, and the text without the words
    that repeat in them, joined by one space.

    Null and empty texts have no words and no runs; null keys are keys like
    any other. Repeated rows each get their row; an empty table gives none;
    only key and text are read, so other columns cannot clash. No shuffle: a
    hot key or group of copies is spread as its rows are. A very long text is
    held whole by one task, at some 150 bytes a word."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1)):
                runs = runs_of(block, exponent, length)
                kept = [b" ".join(collapsed(w, r)).decode() for w, r in zip(block, runs)]
                items = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(block)), pa.array(list(map(len, block)), pa.int64()),
                     pa.array(items, RUNS), pa.array(kept, pa.string())], names=["key", "n_words", "runs", "kept"])
                at += len(block)

    out = rows.mapInArrow(found, f"key {kind}, n_words bigint, "
                                 "runs array<struct<start bigint, length bigint, period bigint>>, kept string")
    return out.withColumnRenamed("key", key)
