"""Document fingerprints by MinHash, and near duplicates by their bands.

A text is the set of its five-word shingles (a shorter one is one shingle, one
without words the empty set). Each of 125 universal hash functions
x -> a x + b modulo 2^64 (a odd, so it permutes the 64-bit hashes of the
shingles) keeps the least value of the set; the share of functions on which
two sets agree estimates their Jaccard similarity. A fingerprint has 16 bits
of each.

Every text is also held against an edited one, whose second half comes from
the next text in key order. Rows are dealt once into chunks of neighbouring
keys; the first row of a chunk goes to the chunk before it too, and of the
very first chunk to the last one, so a chunk is one backward pass.

Near duplicates: 25 bands of five values are joined. The texts of a bucket
meet its first text; pairs whose shingle sets have Jaccard 0.8 or more are
links, and the links give classes. Then buckets with texts of several classes
compare those across classes, all of them, so no link between classes is
lost, while a large group of copies, one class by then, is not compared pair
by pair.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_value, discard, materialise, shuffle_partitions
from ledgerlens.llm.simhash_dedup import stars
from ledgerlens.llm.substring_dedup import rolling, word_hashes

by_value(__name__)

SHINGLE = 5
BANDS, WIDTH = 25, 5  # a pair at 0.8 shares a band but for a chance of 5e-5
SIMILAR = 0.8
SEED = 20
BLOCK = 4096  # shingles hashed at a time
CHUNK_ROWS = 50_000  # of neighbouring keys, sorted in one task
CHUNKS = 100_000  # at most; beyond, they grow instead
TEXT_PASSES = 4  # shares of the texts that are looked through for those to verify


def permutations(n: int = BANDS * WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of the hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, (n, 1), np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, (n, 1), np.uint64)


class MinHash:
    def __init__(self, n: int = BANDS * WIDTH, shingle: int = SHINGLE):
        (self.factor, self.summand), self.shingle = permutations(n), shingle

    def shingles(self, text: str) -> np.ndarray:
        """64-bit hashes of the word shingles, repeats included."""
        words = word_hashes(text.encode().split())
        return rolling(words, min(self.shingle, max(len(words), 1)))

    def fingerprint(self, text: str) -> np.ndarray:
        """The least value under each function, 16 bits of each; the empty set
        has the largest."""
        values = self.shingles(text)
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(values), BLOCK):
            block = self.factor * values[at:at + BLOCK]
            block += self.summand
            np.minimum(least, block.min(axis=1), out=least)
        # a product's upper bits depend on all of the value
        return (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) characters replaced by the first as
    many (or all) of the one that follows."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def in_key_order(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` (key: a number, text, d1, d2) with ``chunk`` and ``extra``, in
    descending order of (chunk, key) within partitions. The rows of a chunk's
    first key come in the chunk before too, marked ``extra`` and ahead of its
    own. Rows without a key are in chunks below zero.

    The texts are shuffled once. One key of each chunk reaches the driver, and
    there are at most ``CHUNKS`` chunks."""
    spark = rows.sparkSession
    width = shuffle_partitions(spark)
    wanted = max(2 * width, min(-(-rows.where("key is not null").count() // chunk_rows), CHUNKS))
    shares = [i / wanted for i in range(1, wanted)]
    cuts = rows.agg(F.percentile_approx("key", shares, max(10_000, 20 * wanted))).first()[0] or []
    cuts = spark.sparkContext.broadcast(np.unique(np.array(cuts)))

    @F.arrow_udf("int")
    def chunk_of(keys: pa.Array) -> pa.Array:
        place = np.searchsorted(cuts.value, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(place, pa.int32(), mask=keys.is_null().to_numpy(zero_copy_only=False))

    firsts = (rows.where("key is not null").select("key", chunk_of("key").alias("chunk")).groupBy("chunk")
              .agg(F.min("key").alias("first")).orderBy("chunk").collect())
    kind = rows.schema["key"].dataType.simpleString()
    before = spark.createDataFrame([(r["first"], firsts[i - 1]["chunk"]) for i, r in enumerate(firsts)], f"first {kind}, before int")
    loose = -1 - F.pmod("d1", F.lit(wanted)).cast("int")
    own = F.array(F.struct(F.coalesce(chunk_of("key"), loose).alias("chunk"), F.lit(False).alias("extra")))
    ahead = F.array(F.struct(F.col("before").alias("chunk"), F.lit(True).alias("extra")))
    dealt = rows.join(F.broadcast(before), F.col("key") == F.col("first"), "left").select(
        "key", "text", "d1", "d2", F.explode(F.when(F.col("before").isNull(), own).otherwise(F.concat(own, ahead))).alias("p"))
    return (dealt.select("key", "text", "d1", "d2", "p.chunk", "p.extra")
            .repartitionById(width, F.pmod("chunk", F.lit(width)).cast("int"))
            .sortWithinPartitions("chunk", F.desc("extra"), F.desc("key"), "d1", "d2"))


def _backward(minhash: MinHash):
    """Fingerprint every row, and hold it against the rows of the next larger
    key, which have just gone by."""
    names = ["key", "d1", "d2", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = group = last = following = None
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            kept = []
            for i, (key, text, at, extra) in enumerate(zip(*(batch.column(c) for c in (0, 1, 4, 5)))):
                text, at, extra = text.as_py(), at.as_py(), extra.as_py()
                if at != chunk:
                    chunk, group, last = at, None, None
                if group != (extra, key.as_py()):
                    group, following = (extra, key.as_py()), last
                own = minhash.fingerprint(text)
                last = text, own
                if extra:
                    continue
                kept.append(i)
                ordered = at >= 0
                changed = edited(text, following[0] if ordered else "")
                theirs = minhash.fingerprint(changed)
                for col, v in zip(cols, (len(text), hashlib.sha256(changed.encode()).digest(), own.tobytes(), theirs.tobytes(),
                                         likeness(own, theirs), likeness(own, following[1]) if ordered else None)):
                    col.append(v)
            taken = batch.take(pa.array(kept, pa.int32()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in (0, 2, 3)), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             names=names)
    return rows


def _similar_prints(least: float):
    """Pairs whose fingerprints agree often enough for the similarity."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.array(batch.column(c).to_pylist(), dtype=object) for c in (2, 3))
                a, b = (np.frombuffer(b"".join(side), ">u2").reshape(len(side), -1) for side in (a, b))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least))
    return rows


def _similar_sets(similar: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= similar * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return rows


def _both_sides(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """(a, b, x, y): the pairs with ``value`` of either node."""
    return (pairs.join(table.select(F.col("node").alias("a"), F.col(value).alias("x")), "a")
            .join(table.select(F.col("node").alias("b"), F.col(value).alias("y")), "b").select("a", "b", "x", "y"))


def classes(prints: DataFrame, texts: DataFrame, similar: float = SIMILAR, bands: int = BANDS, width: int = WIDTH,
            shingle: int = SHINGLE) -> DataFrame:
    """(d1, d2, class_id) of the distinct texts of ``prints`` (key, d1, d2,
    fingerprint): the smallest key in the class of the texts linked to it.
    ``texts`` (key, text, d1, d2) has the texts to verify links with. Null keys
    are class_id only where no other is."""
    nodes = materialise(prints.groupBy("d1", "d2").agg(F.min("key").alias("key"), F.first("fingerprint").alias("fingerprint"))
                        .withColumn("node", F.monotonically_increasing_id()))
    of_band = [F.xxhash64(F.lit(i), F.expr(f"substring(fingerprint, {2 * width * i + 1}, {2 * width})")) for i in range(bands)]
    banded = nodes.select("node", F.explode(F.array(*of_band)).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("other")).where("lead < other")
    met = materialise(banded.join(shared, "bucket").select("bucket", "node", "lead"))
    minhash = MinHash(bands * width, shingle)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(minhash.shingles(t.as_py())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "shingles"])

    least = similar - 6 * (similar * (1 - similar) / (bands * width)) ** 0.5  # a chance of 1e-9

    def linked(pairs: DataFrame) -> DataFrame:
        likely = _both_sides(pairs, nodes, "fingerprint").mapInArrow(_similar_prints(least), "a bigint, b bigint")
        likely = materialise(likely)
        asked = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        asked = materialise(nodes.join(asked, "node", "left_semi").select("d1", "d2", F.col("key").alias("k"), "node"))
        # a share of the texts at a time, so that no shuffle holds them all
        parts = []
        for p in range(TEXT_PASSES):
            own = texts.where(F.pmod("d1", F.lit(TEXT_PASSES)) == p).join(asked, ["d1", "d2"])
            parts.append(materialise(own.where(F.col("key").eqNullSafe(F.col("k"))).dropDuplicates(["node"])
                                     .select("node", "text").mapInArrow(sets, "node bigint, shingles binary")))
        wanted = functools.reduce(DataFrame.union, parts)
        links = materialise(_both_sides(likely, wanted, "shingles").mapInArrow(_similar_sets(similar), "a bigint, b bigint"))
        for spent in (likely, asked, *parts):
            discard(spent)
        return links

    first = materialise(met.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
    links = linked(first)
    roots = stars(links)
    placed = met.select("bucket", "node").join(roots.withColumnRenamed("a", "node"), "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    placed = materialise(placed.join(mixed.select("bucket"), "bucket"))
    across = (placed.alias("p").join(placed.alias("q"), "bucket").where(F.expr("p.root <> q.root and p.node > q.node"))
              .select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct().join(first, ["a", "b"], "left_anti"))
    roots = stars(links.union(linked(across)))
    rooted = nodes.join(roots.withColumnRenamed("a", "node"), "node", "left").select(
        "d1", "d2", "key", F.coalesce("root", "node").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("key").alias("class_id")), "root").select("d1", "d2", "class_id")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("key"), body.alias("text"), F.xxhash64(body).alias("d1"), F.xxhash64(F.lit(1), body).alias("d2"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 size: int = BANDS * WIDTH) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row: characters; digest of the edited
    text; both fingerprints as hex digits; the likeness of the fingerprint to
    the edited text's and to the next document's.

    The key is a number. The next document is the one with the next larger
    key, after the last the first; of rows that share a key the one with the
    largest digest of its text. Rows with a null key have none: their text is
    cut, not filled, and near_next is null. Null and empty texts have no
    characters and the fingerprint of no words, which is like itself. Repeated
    rows get equal rows; an empty table gives none; only key and text are
    read. Texts are read whole; a very long one is held by one task."""
    rows = _rows(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    out = in_key_order(rows).mapInArrow(_backward(MinHash(size, shingle)), (
        f"key {kind}, d1 bigint, d2 bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, "
        "edited_fingerprint binary, near_edited double, near_next double"))
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return out.select(F.col("key").alias(key), "n_chars", *hexed, "near_edited", "near_next")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bands: int = BANDS,
                    width: int = WIDTH, similar: float = SIMILAR) -> DataFrame:
    """(key, fingerprint, class_id) of every row; class_id: the smallest key
    among its near duplicates, itself included (null only where all are).

    Equal texts have one class; texts without words are alike. Null texts are
    empty, repeated rows get equal rows, an empty table gives none, and only
    key and text are read. A group of texts that share bands but are not
    similar is compared pair by pair."""
    rows = _rows(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    minhash = MinHash(bands * width, shingle)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [minhash.fingerprint(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(found, pa.binary())],
                                             names=["key", "d1", "d2", "fingerprint"])

    prints = materialise(rows.mapInArrow(printed, f"key {kind}, d1 bigint, d2 bigint, fingerprint binary"))
    return prints.join(classes(prints, rows, similar, bands, width, shingle), ["d1", "d2"]).select(
        F.col("key").alias(key), F.lower(F.hex("fingerprint")).alias("fingerprint"), "class_id")
