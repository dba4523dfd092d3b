"""Document log-likelihood under a recurrent language model trained here.

Word counts come from every training text. The words above a share of the
tokens, and at least the 2,046 most frequent, are the model's outputs
(class-factored softmax); any other word costs the model's
probability of an unlisted word times the word's share among those, smoothed
by one, from the counts. Replicas of the model are trained on the partitions
of a round's documents by truncated back-propagation; their weights, weighted
by tokens, are averaged by an aggregate over single weights, and the next
round starts from the average. Each training text is used once, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_value, materialise
from ledgerlens.llm.gru import HIDDEN, Gru, classes, initial

by_value(__name__)

LISTED = 2046  # least number of output words of the model, besides the end and "any other"
SHARE = 1 / 25_000  # of the training tokens, from which a word is an output word in any case (so they are 25,000 at most)
HEAD = 1 << 16  # most frequent words, whose counts every task holds
ROUNDS = 2
TABLE = 1_000_000  # words with counts a task holds; with over half as many distinct ones, it hands them on
GROUP_TOKENS = 4_000_000  # a replica trains on at a time, some 60 MB
SLICE = 8 << 20  # bytes of text cut into words at a time, if not one text is longer
END = b""  # no word is empty
OTHER_ID, END_ID = 0, 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(key: Column) -> Column:
    """Whether the crc32 of the key as text leaves 2 divided by 7; a null key
    does not."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(7)) == 2, F.lit(False))


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with few bytes in the column ``text``."""
    for batch in batches:
        place = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            if end > at:
                yield batch.slice(at, end - at)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each word of the texts as its place among their distinct words, these,
    and the number of words of each text: ``words_of`` by Arrow, whose ASCII
    functions lower and split at the same bytes."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.flatten().dictionary_encode()
    codes, ends = found.indices.to_numpy(), lists.offsets.to_numpy()
    words = found.dictionary.cast(pa.binary())
    empty = pc.index(words, pa.scalar(b"", pa.binary())).as_py()  # before the first space and after the last
    if empty < 0:
        return codes, words, np.diff(ends)
    real = codes != empty
    return codes[real], words, np.diff(np.concatenate([[0], np.cumsum(real)])[ends])


def _placed(index: dict[bytes, int], words: pa.Array, other: int) -> np.ndarray:
    return np.fromiter(map(index.get, words.to_numpy(zero_copy_only=False).tolist(), repeat(other)), np.int32, len(words))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, ends = [], 0

    def summed():
        if held:
            table = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            held[:] = [table.select(["word", "c_sum"]).rename_columns(["word", "c"])]
        return sum(t.num_rows for t in held)

    for part in _slices(batches, 0):
        codes, words, _ = _words(part.column(0))
        table = pa.table({"word": words, "c": np.bincount(codes, minlength=len(words))})
        held.append(table.filter(pc.greater(table["c"], 0)))
        ends += part.num_rows
        if sum(t.num_rows for t in held) > TABLE and summed() > TABLE // 2:
            yield from held.pop().to_batches()
    if ends:
        held.append(pa.table({"word": pa.array([END], pa.binary()), "c": pa.array([ends], pa.int64())}))
        summed()
        yield from held.pop().to_batches()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; the end of a text counts as the empty word."""
    return materialise(texts.mapInArrow(_count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")))


def _documents(ids: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The ids of each text, which has ``n`` of them, and the end."""
    out = np.full(len(ids) + len(n), END_ID, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return np.split(out, np.cumsum(n + 1)[:-1])


def _replica(shipped):
    """Train a copy of the model on the texts of a partition; yield its
    weights times its tokens, and the tokens."""
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, bounds, index = shipped.value
        model, docs, held, tokens = Gru(params, bounds), [], 0, 0
        for part in _slices(batches, 0):
            codes, words, n = _words(part.column(0))
            for doc in _documents(_placed(index, words, OTHER_ID)[codes], n):
                docs.append(doc)
                held += len(doc)
                if held > GROUP_TOKENS:
                    model.train(docs, END_ID)
                    tokens, docs, held = tokens + held, [], 0
        if docs:
            model.train(docs, END_ID)
            tokens += held
        if tokens:
            flat = np.concatenate([model.p[k].ravel() for k in sorted(model.p)]).astype(np.float64)
            at = 0
            while at < len(flat):
                part = flat[at:at + 4096] * tokens
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part)), pa.int32()), pa.array(part),
                                                  pa.array(np.full(len(part), float(tokens)))], names=["i", "w", "n"])
                at += len(part)
    return train


def average(replicas: DataFrame, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Token-weighted mean of the replicas; as many rows reach the driver as
    the model has weights."""
    rows = replicas.groupBy("i").agg((F.sum("w") / F.sum("n")).cast("float").alias("w")).toPandas()
    if not len(rows):
        return like
    flat = np.empty(sum(v.size for v in like.values()), np.float32)
    flat[rows["i"].to_numpy()] = rows["w"].to_numpy()
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _scorer(shipped, other_log: float):
    """Sums over the words whose counts the task holds; the rest of the
    distinct words and how often each comes are handed on. ``other_log``:
    log10 of the denominator that unlisted words share."""
    names = ["key", "held_out", "n_tokens", "n_known", "base", "score", "words", "counts"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, bounds, order, sizes, listed, ends = shipped.value
        model = Gru(params, bounds)
        place = {w: i for i, w in enumerate(order)}  # by falling count: the listed words lead
        logs = np.append(np.log10(np.array(sizes, np.float64) + 1), 0.0)  # the last for words that are not held
        end_log = math.log10(ends + 1)
        for part in _slices(batches, 2):
            codes, words, n = _words(part.column(2))
            places, rows = _placed(place, words, -1)[codes], np.repeat(np.arange(len(n)), n)
            rare, other = places < 0, (places < 0) | (places >= listed)
            per_row = lambda of, w=None: np.bincount(rows[of], w if w is None else w[of], len(n))  # noqa: B023, E731
            each = logs[places]
            unlisted, shares = per_row(other), per_row(other, each)
            known = n - per_row(rare) + (ends > 0)
            base = per_row(slice(None), each) + end_log
            score = model.score(_documents(np.where(other, OTHER_ID, places + 2), n), END_ID) / math.log(10) + shares - unlisted * other_log
            # each rare word of a text once, with how often it comes
            pairs, times = np.unique(rows[rare] * len(words) + codes[rare], return_counts=True)
            cuts = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * len(words)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in (n + 1, known)), pa.array(base, pa.float64()),
                 pa.array(score, pa.float64()), pa.ListArray.from_arrays(cuts, words.take(pa.array(pairs % max(len(words), 1)))),
                 pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64()))], names=names)
    return scored


def frequent(counts: DataFrame, distinct: int, most: int) -> dict[bytes, int]:
    """The ``most`` most frequent words with their counts, by falling count.

    A count that some more words reach is looked up first, so that a number of
    rows that does not grow with the input is sorted and sent to the driver."""
    if distinct > 4 * most:  # four times as many, as the quantile is approximate
        least = counts.agg(F.percentile_approx("c", 1 - 4 * most / distinct, 100_000)).first()[0]
        counts = counts.where(F.col("c") >= least)
    rows = counts.orderBy(F.desc("c"), "word").limit(most).collect()
    return {bytes(r["word"]): r["c"] for r in rows}


def listing(counts: list[int], total: int) -> int:
    """How many of the words, by falling count, the model lists."""
    return max(min(LISTED, len(counts)), sum(c >= SHARE * total for c in counts))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", listed: int | None = None, rounds: int = ROUNDS,
                    hidden: int = HIDDEN, n_classes: int | None = None, head_words: int = HEAD) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row: log10 probability of the whole text and its end under smoothed
    unigram counts and under the recurrent model.

    Null and empty texts are one token, the end. Null keys train. Repeated
    rows are scored each; an empty table gives no rows; other columns are not
    read. State is carried through a text of any length. With no training row
    the model keeps its initial weights. Weights depend on how documents lie
    in partitions, so scores are reproducible for the same input files."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = word_counts(training.select("text"))
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"),
                                       F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))).first()
    head = frequent(counts.where("octet_length(word) > 0"), distinct - bool(ends), head_words)
    order = list(head)[:listing(list(head.values()), total) if listed is None else listed]
    if n_classes is None:  # by the square root; a third of it, as a class costs a few calls whatever its size
        n_classes = max(1, round(math.sqrt(len(order)) / 3))
    listed_tokens = sum(head[w] for w in order)
    # ids by falling count, so that classes are runs of ids; the two special
    # ids lead, each of them a class if it is frequent
    others, other_kinds = total - ends - listed_tokens, distinct - bool(ends) - len(order)
    index = {END: END_ID, **{w: i + 2 for i, w in enumerate(order)}}
    sizes = np.array([others, ends, *(head[w] for w in order)], np.float64)
    bounds = np.concatenate([[0, 1], 2 + classes(sizes[2:], n_classes)]) if order else np.array([0, 1, 2])
    params = initial(sizes, bounds, hidden)
    for r in range(rounds):
        own = training.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r) if rounds > 1 else training
        shipped = spark.sparkContext.broadcast((params, bounds, index))
        params = average(own.select("text").mapInArrow(_replica(shipped), "i int, w double, n double"), params)
    shipped = spark.sparkContext.broadcast((params, bounds, list(head), list(head.values()), len(order), ends))
    kind = rows.schema["key"].dataType.simpleString()
    other_log = math.log10(others + other_kinds + 1)
    per_doc = rows.mapInArrow(_scorer(shipped, other_log), f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, "
                                                "score double, words array<binary>, counts array<bigint>")
    per_doc = materialise(per_doc.withColumn("row", F.monotonically_increasing_id()))
    # the rarer words of a text meet their counts by a join
    tail = per_doc.select("row", F.explode(F.arrays_zip("words", "counts")).alias("t")).select(
        "row", F.col("t.words").alias("word"), F.col("t.counts").alias("n"))
    log = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    tail = (tail.join(counts, "word", "left").groupBy("row")
            .agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("tail_known"), F.sum(log).alias("tail_log")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return per_doc.drop("words", "counts").join(tail, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + zero("tail_known")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_log") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("score") + zero("tail_log")).alias("score"))
