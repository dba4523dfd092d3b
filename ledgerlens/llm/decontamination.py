"""Benchmark decontamination by SimHash over item-sized windows.

For every length that items have, a document's windows of that many words get
a weighted SimHash of their word shingles. A multi-index over the items (the
fingerprint in blocks, each with all block values within its share of the
radius) yields every item within the Hamming radius, and the exact weighted
Jaccard similarity of the shingles decides.

A window without any shingle of an item has similarity zero with it, so
windows are only made where a document has an item's shingle; nothing can be
lost by it. Words are looked up once as numbers (zero if no item has the word),
a rolling sum of these finds the places that may have such a shingle, and only
the shingles there are hashed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACE, by_value, materialise

by_value(__name__)

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
#: A similarity of 0.8 turns 9.7 of 64 bits on average (deviation 2.9) with
#: equal weights, which differ by a factor of 1.5 at most; the radius is over
#: four deviations above that.
RADIUS = 22
BLOCKS = 4
BLOCK_BITS = BITS // BLOCKS
COARSE_BITS = 20  # of the rolling sum of a shingle's words, looked up before the shingle is hashed
PASS_BYTES = 16 << 20  # item text that one pass over the documents ships to each task
ROLL = np.uint64(0x9E3779B97F4A7C15)  # an odd factor
GROUP = 64  # items of one multi-index (one bit each in a word)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    """Word shingles; a shorter sequence is one, no words are none."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]


def hashes(grams: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams))


def signs(values: np.ndarray) -> np.ndarray:
    """+1 / -1 for each bit of each hash."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _ball() -> np.ndarray:
    """Block values within the block's share of the radius of zero."""
    every = np.arange(1 << BLOCK_BITS, dtype=np.uint32)
    return every[np.bitwise_count(every) <= RADIUS // BLOCKS]


@dataclass
class Items:
    """The items of one pass, with weights of their shingles and the index."""
    ids: list
    lengths: np.ndarray
    fingerprints: np.ndarray
    counts: list  # Counter of shingle hashes of each item
    totals: list  # weight of all of them, per item
    weights: dict  # shingle hash -> weight
    words: dict  # word of an item -> number, from 1
    values: np.ndarray  # number -> factor in the rolling sum; 0 -> 0
    coarse: np.ndarray  # whether the rolling sum of any item's shingle starts with these bits
    tables: list  # per group of items: BLOCKS x 65536 words, bit g for item g


def weight_of(df: int, n: int) -> float:
    """Rarer among items weighs more, from 1 (in all items) to 1.5 (in one)
    whatever the number of items, so changed words cannot outweigh a passage
    that many items share; a shingle of no item weighs as one of a single item."""
    return 1.0 + 0.5 * math.log(n / max(df, 1)) / math.log(n) if n > 1 else 1.0


def rolled(values: np.ndarray, size: int) -> np.ndarray:
    """A number for each ``size`` consecutive words; equal words, equal numbers."""
    n = len(values) - size + 1
    out = values[:n].copy()
    for j in range(1, size):
        out = out * ROLL + values[j:j + n]
    return out


def prefix(sums: np.ndarray) -> np.ndarray:
    return (sums >> np.uint64(BITS - COARSE_BITS)).astype(np.int64)


def prepare(rows: list[tuple], n_items: int, df: dict[int, int]) -> Items:
    """``rows``: (digest, text) with at least one word; ``df``: over the
    distinct texts of all items, not only this pass."""
    ball = _ball()
    ids, lengths, prints, counts, totals, weights, numbers = [], [], [], [], [], {}, {}
    for item, text in rows:
        words = words_of(text)
        for x in words:
            numbers.setdefault(x, len(numbers) + 1)
        h = hashes(shingles(words))
        own = Counter(h.tolist())
        for x in own:
            weights[x] = weight_of(df.get(x, 1), n_items)
        w = np.array([weights[x] for x in h.tolist()], np.float32)
        ids.append(item)
        lengths.append(len(words))
        counts.append(own)
        totals.append(float(w.sum()))
        prints.append(pack((signs(h) * w[:, None]).sum(axis=0, keepdims=True))[0])
    prints = np.array(prints, np.uint64)
    tables = []
    for at in range(0, len(ids), GROUP):
        table = np.zeros((BLOCKS, 1 << BLOCK_BITS), np.uint64)
        for g, fp in enumerate(prints[at:at + GROUP].tolist()):
            for b in range(BLOCKS):
                value = (fp >> (b * BLOCK_BITS)) & ((1 << BLOCK_BITS) - 1)
                table[b, ball ^ np.uint32(value)] |= np.uint64(1 << g)
        tables.append(table)
    values = np.concatenate([np.zeros(1, np.uint64), hashes(list(numbers))])
    coarse = np.zeros(1 << COARSE_BITS, bool)
    for _, text in rows:
        own = values[[numbers[x] for x in words_of(text)]]
        coarse[prefix(rolled(own, min(SHINGLE, len(own))))] = True
    return Items(ids, np.array(lengths), prints, counts, totals, weights, numbers, values, coarse, tables)


def candidates(items: Items, prints: np.ndarray, length_mask: list[np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
    """(windows within the radius, ascending; item): the blocks propose, the
    whole fingerprint confirms."""
    block = [((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64) for b in range(BLOCKS)]
    for g, table in enumerate(items.tables):
        if not length_mask[g]:
            continue
        hit = (table[0, block[0]] | table[1, block[1]] | table[2, block[2]] | table[3, block[3]]) & length_mask[g]
        some = np.flatnonzero(hit)
        bit, at = np.nonzero(np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T)
        item, window = bit + g * GROUP, some[at]
        near = np.bitwise_count(prints[window] ^ items.fingerprints[item]) <= RADIUS
        item, window = item[near], window[near]
        if len(item):
            starts = np.flatnonzero(np.diff(item, prepend=-1))
            for i, own in zip(item[starts].tolist(), np.split(window, starts[1:])):
                yield own, i


def similarity(items: Items, i: int, window: Counter, default: float) -> float:
    """Weighted Jaccard of shingle counts; a shingle that the item lacks weighs
    as one of a single item, so the score depends on no other item's text."""
    own = items.counts[i]
    low = high = 0.0
    for x in own.keys() | window.keys():
        w = items.weights[x] if x in own else default
        a, b = own.get(x, 0), window.get(x, 0)
        low += w * min(a, b)
        high += w * max(a, b)
    return low / high if high else 0.0


def spans(places: np.ndarray, length: int, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of window starts that can cover one of the places (of shingles)
    with ``length`` words, merged; n: words of the document."""
    lo = np.maximum(places - length + 1, 0)
    hi = np.minimum(places, max(n - length, 0))
    begin, end = int(lo[0]), int(hi[0])
    for a, b in zip(lo[1:].tolist(), hi[1:].tolist()):
        if a > end + 1:
            yield begin, end
            begin = a
        end = max(end, b)
    yield begin, end


def total_weight(w: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(w, dtype=np.float64)])


def matches(items: Items, n_items: int, words: list[bytes], masks: dict, threshold: float = SIMILARITY) -> dict:
    """item -> (similarity, start, words) of its best window."""
    best: dict = {}
    n = len(words)
    default = weight_of(1, n_items)
    numbers = np.fromiter(map(items.words.get, words, repeat(0)), np.int32, n)
    if not numbers.any():
        return best
    values = items.values[numbers]
    for size in sorted({min(SHINGLE, int(x)) for x in items.lengths}):
        # items of fewer than five words are one shingle of their own length
        lengths = [int(x) for x in np.unique(items.lengths) if (int(x) == size if size < SHINGLE else x >= size)]
        if n < size:
            h, lengths = hashes(shingles(words)), [x for x in lengths if x >= SHINGLE]
            places = np.array([0] if int(h[0]) in items.weights else [], np.int64)
        else:
            places = np.flatnonzero(items.coarse[prefix(rolled(values, size))])
            sure = [xxhash.xxh64_intdigest(b" ".join(words[p:p + size])) in items.weights for p in places.tolist()]
            places = places[np.array(sure, bool)]
        if not len(places):
            continue
        if n >= size:  # shingles of all windows around the places; the longest windows cover the shorter
            h = np.zeros(n - size + 1, np.uint64)
            own = min(max(lengths), n)
            for begin, end in spans(places, own, n):
                end += max(own - size + 1, 1)
                h[begin:end] = hashes([b" ".join(words[i:i + size]) for i in range(begin, end)])
        for length in lengths:
            own = min(length, n)  # a document shorter than the item is one window
            each = max(own - size + 1, 1)  # shingles of a window
            for begin, end in spans(places, own, n):
                part = h[begin:end + each]
                w = np.array([items.weights.get(x, default) for x in part.tolist()], np.float32)
                total = np.vstack([np.zeros((1, BITS)), np.cumsum(signs(part) * w[:, None], axis=0, dtype=np.float64)])
                prints = pack(np.round(total[each:] - total[:-each], 4))
                weight, grams = total_weight(w), part.tolist()
                whole = weight[each:] - weight[:-each]
                for windows, i in candidates(items, prints, masks[length]):
                    # no more in common than the weight of the window's shingles that the item has
                    mine = total_weight(w * np.fromiter(map(items.counts[i].__contains__, grams), bool, len(grams)))
                    most = (mine[each:] - mine[:-each]) / np.maximum(whole, items.totals[i])
                    for k in windows[most[windows] >= threshold - 1e-3].tolist():
                        score = similarity(items, i, Counter(grams[k:k + each]), default)
                        if score >= threshold and score > best.get(i, (0.0,))[0]:
                            best[i] = (score, begin + k, own)
    return best


def length_masks(items: Items) -> dict:
    """length -> per group of items, the bits of those of that length."""
    out = {}
    for length in np.unique(items.lengths).tolist():
        out[int(length)] = [np.uint64(sum(1 << g for g, x in enumerate(items.lengths[at:at + GROUP]) if x == length))
                            for at in range(0, len(items.ids), GROUP)]
    return out


def _texts(benchmark: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(item, digest, t): items with a word. ``t``: the words, lower-cased
    (A-Z), joined by one space, so items of the same words share a digest."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = F.trim(F.regexp_replace(F.translate(F.col(item_text).cast("string"), upper, upper.lower()), SPACE, " "))
    return materialise(benchmark.select(F.col(item_key).alias("item"), t.alias("t")).where("t <> ''")
                       .select("item", F.sha2("t", 256).alias("digest"), "t"))


def _passes(texts: DataFrame, pass_bytes: int) -> int:
    """Number of passes by hash of the distinct texts at which no pass of
    several texts has more than ``pass_bytes``; counted, not assumed."""
    size = F.sum(F.octet_length("t"))
    passes = max(1, -(-(texts.agg(size).first()[0] or 0) // pass_bytes))
    while passes > 1:
        parts = texts.groupBy(_number(passes)).agg(size.alias("size"), F.count("*").alias("n"))
        if not parts.where((F.col("size") > pass_bytes) & (F.col("n") > 1)).head(1):
            break
        passes *= 2
    return passes


def _number(passes: int):
    return F.pmod(F.xxhash64("digest"), F.lit(passes))


def _found(rows: DataFrame, items: DataFrame, threshold: float, pass_bytes: int) -> DataFrame:
    """(key, digest, similarity, word_start, n_words) of ``rows`` (key, text):
    each distinct item text is shipped once."""
    spark = rows.sparkSession
    texts = materialise(items.select("digest", "t").distinct())
    n_items, passes = texts.count(), _passes(texts, pass_bytes)
    # distinct texts that have a shingle, counted over the whole benchmark
    spread = (texts.select("t", _number(passes).alias("p")).mapInArrow(_item_shingles, "h bigint, p bigint")
              .groupBy("h").agg(F.count("*").alias("n"), F.collect_set("p").alias("ps")))
    spread = materialise(spread) if passes > 1 else spread  # read by every pass
    schema = (f"key {rows.schema['key'].dataType.simpleString()}, digest string, similarity double, word_start int, n_words int")
    out = None
    for p in range(passes):
        own = [tuple(r) for r in texts.where(_number(passes) == p).collect()]  # at most pass_bytes, or one text
        df = {r["h"] & ((1 << BITS) - 1): r["n"] for r in spread.where(F.array_contains("ps", F.lit(p).cast("bigint"))).collect()}
        shipped = spark.sparkContext.broadcast((own, df))
        found = rows.mapInArrow(_scan(shipped, n_items, threshold), schema)
        out = found if out is None else out.union(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text", similarity_at_least: float = SIMILARITY,
                 pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(key, item, similarity, word_start, n_words): each pair of a row and an
    item with a window that is similar enough, with its best window (the first
    of several as good).

    Words are lower-cased (A-Z) and separated by ASCII white space; shingles
    have five words. Null or empty texts and items match nothing; a very long
    text is held by its task, with windows only around shingles of items.
    Repeated rows and items give their own pairs; empty tables give no rows;
    other columns are not read. The benchmark is a stated query set: its
    distinct texts (by which shingles are weighed too) are shipped to the tasks
    in passes of at most ``pass_bytes`` of text, or one text, and items get the
    matches of their text by a join."""
    items = _texts(benchmark, item_key, item_text)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = _found(rows, items, similarity_at_least, pass_bytes)
    return found.join(items.select("item", "digest"), "digest").select(
        F.col("key").alias(key), F.col("item").alias(item_key), "similarity", "word_start", "n_words")


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, p in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.unique(hashes(shingles(words_of(text)))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([p] * len(own), pa.int64())], names=["h", "p"])


def _scan(shipped, n_items: int, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, df = shipped.value
        items = prepare(own, n_items, df) if own else None
        masks = length_masks(items) if own else {}
        for batch in batches:
            rows = []
            if items is not None:
                texts = batch.column(1)
                for r in range(batch.num_rows):
                    for i, (score, start, n) in matches(items, n_items, words_of(texts[r].as_py()), masks, threshold).items():
                        rows.append((r, items.ids[i], score, start, n))
            at, item, score, start, n = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array(item, pa.string()),
                 pa.array(score, pa.float64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                names=["key", "digest", "similarity", "word_start", "n_words"])
    return scan


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text", similarity_at_least: float = SIMILARITY,
          pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows without a passage of a benchmark item, all columns as they
    were. Each row is judged on its own text and keeps its columns in a
    struct, so repeated or null keys and clashing names do no harm; ties,
    very long and empty texts and tables are as in ``contaminated``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.struct(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h")).alias("id"))
    rows = packed.select(F.col("id").alias("key"), F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")).alias("text"))
    found = _found(rows, _texts(benchmark, item_key, item_text), similarity_at_least, pass_bytes)
    bad = found.select(F.col("key.k").alias("bad_key"), F.col("key.h").alias("bad_hash")).distinct()
    same = F.col("id.k").eqNullSafe(F.col("bad_key")) & (F.col("id.h") == F.col("bad_hash"))
    return packed.join(bad, same, "left_anti").select("row.*")
