"""Spelling variants: words one inserted, deleted or replaced letter apart, by
PartEnum signatures of their letters.

1. Words are counted in every text, combined in the tasks before the shuffle.
2. The letters of a word are a binary vector: one dimension for the k-th
   occurrence of a letter. Words with the same vector (anagrams) travel
   together, some at a time. A replaced letter changes two dimensions and
   leaves the size, an inserted or deleted one changes one dimension.
3. PartEnum: the dimensions are dealt into m partitions of near-equal entropy.
   Vectors of equal size at distance two agree outside some two partitions,
   and vectors of neighbouring sizes at distance one outside some one. So the
   signatures are the vector without each two partitions, together with its
   size, and the vector without each one, together with the smaller size.
   They are exact: every pair within the distance shares one.
4. An equi-join on the signatures compares vectors folded to 128 bits (a fold
   never adds to the distance), then the difference of the two vectors, which
   names the letters, is looked up in the words: replacing the one letter by
   the other, or leaving it out, at each of its places.
5. A pair that shares several signatures counts at one of them only.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import by_value, discard, materialise

by_value(__name__)

LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10  # of the counts of a form and its variant
TABLE = 500_000  # distinct words a task counts before it hands them on
ANAGRAMS = 64  # words of one vector that travel in a row, about
#: Partitions by the number of vectors from which they pay: more of them make
#: more signatures, each with fewer candidates.
PARTS = ((0, 6), (2_000_000, 8), (20_000_000, 10))
COMMON = 1 / 1000  # share of the vectors from which a dimension is dealt by its entropy, others by hash
LONG = 64  # letters from which words are compared as they are
SAME, SHORT, LONGER = 0, 1, 2  # roles: equal sizes, and the two sides of neighbouring sizes


def counted_words(docs: DataFrame, key: str, text: str, least: int, plant: int | None) -> DataFrame:
    """(word, n): how often each word of ``least`` letters comes in the texts.
    A word is a maximal run of letters, A-Z in lower case. With ``plant``,
    misspellings are set in: where it divides the crc32 of ``<key>:<run>``,
    the run loses its letter number crc32 % length."""
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                runs = pattern.findall(text.as_py().encode().lower().decode())  # of bytes, only A-Z change
                if plant is None:
                    seen.update(runs)
                else:
                    start = zlib.crc32(f"{name.as_py()}:".encode())
                    for run, n in Counter(runs).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % plant == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < least:
                                continue
                        seen[run] += n
                if len(seen) > TABLE:
                    yield flush()
        if seen:
            yield flush()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def dimensions(letters: str) -> list[str]:
    """The dimensions that a sorted run of letters sets."""
    return [f"{c}{k}" for c, own in itertools.groupby(letters) for k, _ in enumerate(own)]


class Vectors:
    """Where the dimensions lie, and the signatures of vectors."""

    def __init__(self, shares: dict[str, float], parts: int):
        self.parts, self.known = parts, {}
        self.part: dict[str, int] = {}
        held = [0.0] * parts
        entropy = {d: -p * math.log2(p) - (1 - p) * math.log2(1 - p) if 0 < p < 1 else 0.0 for d, p in shares.items()}
        for d in sorted(entropy, key=lambda d: (-entropy[d], d)):
            least = min(range(parts), key=lambda i: held[i])
            held[least] += entropy[d]
            self.part[d] = least
        self.pairs = list(itertools.combinations(range(parts), 2))

    def place(self, d: str) -> tuple[int, int, int]:
        """(partition, 64-bit hash, bit of the fold) of a dimension."""
        got = self.known.get(d)
        if got is None:
            h = xxhash.xxh64_intdigest(d)
            got = (self.part.get(d, h % self.parts), h, 1 << xxhash.xxh32_intdigest(d) % 128)
            if len(self.known) < 100_000:
                self.known[d] = got
        return got

    def signatures(self, letters: str) -> tuple[int, list[tuple[int, int, int]]]:
        """The folded vector and its (role, partitions left out, signature)s."""
        sums, fold, size = [0] * self.parts, 0, len(letters)
        for d in dimensions(letters):
            p, h, bit = self.place(d)
            sums[p] += h
            fold ^= bit
        total = sum(sums)
        out = [(SAME, c, total - sums[i] - sums[j], size) for c, (i, j) in enumerate(self.pairs)]
        out += [(role, -1 - p, total - sums[p], s) for p in range(self.parts) for role, s in ((SHORT, size), (LONGER, size - 1))]
        return fold, [(role, c, signed(xxhash.xxh64_intdigest(f"{c} {s} {rest % (1 << 64)}"))) for role, c, rest, s in out]

    def canonical(self, p: int, q: int) -> int:
        """Which two partitions count for a pair that differs in p and q."""
        return self.pairs.index(tuple(sorted((p, q if p != q else (p + 1) % self.parts))))


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def first_difference(a: str, b: str) -> int:
    """Length of the common prefix, by slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def letter_change(a: str, b: str) -> tuple[str, str] | None:
    """(letter of a, letter of b) by which the sorted letters differ, if they
    differ by one replaced letter; for a longer b, ("", letter)."""
    k = first_difference(a, b)
    a, b = a[k:], b[k:]
    if len(a) < len(b):
        return ("", b[0]) if a == b[1:] else None
    if not a:
        return None
    j = first_difference(a[::-1], b[::-1])
    a, b = a[:len(a) - j], b[:len(b) - j]
    if a[1:] == b[:-1]:
        return a[0], b[-1]
    return (a[-1], b[0]) if a[:-1] == b[1:] else None


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    k = first_difference(a, b)
    return a != b and (a[k:] == b[k + 1:] if len(a) < len(b) else a[k + 1:] == b[k + 1:])


def changed(word: str, old: str, new: str) -> set[str]:
    """The word with one of its letters ``old`` replaced by ``new``."""
    out, at = set(), word.find(old)
    while at >= 0:
        out.add(word[:at] + new + word[at + 1:])
        at = word.find(old, at + 1)
    return out


def near_words(left: dict[str, int], right: dict[str, int], old: str, new: str) -> Iterator[tuple[str, str]]:
    """The near pairs of two vectors, whose words differ by the letter ``old``
    (none: one letter is missing) against ``new``."""
    if len(next(iter(right))) > LONG:
        yield from ((a, b) for a in left for b in right if one_apart(a, b))
    elif old and len(left) < len(right):
        yield from ((a, b) for a in left for b in changed(a, old, new) if b in right)
    else:
        yield from ((a, b) for b in right for a in changed(b, new, old) if a in left)


UNIT = "array<struct<word string, n bigint>>"


def _signed_units(shipped):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shipped.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                at, cols = [], ([], [], [], [], [])
                for i, letters in enumerate(part.column(0).to_pylist()):
                    fold, found = vectors.signatures(letters)
                    low, high = signed(fold), signed(fold >> 64)
                    for role, left_out, value in found:
                        at.append(i)
                        for col, v in zip(cols, (value, role, left_out, low, high)):
                            col.append(v)
                kinds = (pa.int64(), pa.int8(), pa.int16(), pa.int64(), pa.int64())
                taken = part.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, k) for c, k in zip(cols, kinds)), taken.column(0), taken.column(1)],
                    names=["sig", "role", "left_out", "low", "high", "letters", "words"])
    return rows


def _lists(units: pa.ListArray):
    """The words of row i with their counts, from columns read once a batch."""
    at = units.offsets.to_pylist()
    held = units.values.slice(0, at[-1])
    words, counts = held.field("word").to_pylist(), held.field("n").to_pylist()
    return lambda i: dict(zip(words[at[i]:at[i + 1]], counts[at[i]:at[i + 1]]))


def _verified(shipped):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shipped.value
        for batch in batches:
            out: list[tuple] = []
            ours, theirs = _lists(batch.column(3)), _lists(batch.column(4))
            for i, (left_out, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                change = letter_change(a, b)
                if change is None:
                    continue
                if change[0]:
                    # the dimension that goes is the last of its letter, as is the one that comes
                    p, q = (vectors.place(f"{c}{of.count(c) - 1}")[0] for c, of in zip(change, (a, b)))
                    if vectors.canonical(p, q) != left_out:
                        continue
                left, right = ours(i), theirs(i)
                out += ((x, left[x], y, right[y]) for x, y in near_words(left, right, *change))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64()) * 2)],
                                             names=["a", "a_n", "b", "b_n"])
    return rows


def dimension_shares(letters: DataFrame, total: int) -> dict[str, float]:
    """The share of the vectors that set a dimension, for those that many do;
    their number is at most the mean length over ``COMMON``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(d for v in batch.column(0).to_pylist() for d in dimensions(v))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                             names=["d", "n"])

    found = letters.mapInArrow(count, "d string, n bigint").groupBy("d").agg(F.sum("n").alias("n"))
    return {r["d"]: r["n"] / total for r in found.where(F.col("n") >= COMMON * total).collect()}


def near_pairs(words: DataFrame, anagrams: int = ANAGRAMS, parts: int | None = None) -> DataFrame:
    """(a, a_n, b, b_n): every two words of ``words`` (word, n; distinct) one
    inserted, deleted or replaced letter apart, once.

    Words of one vector come in rows of about ``anagrams`` words, so none is
    held whole; rows of a crowded signature are joined by the planner's
    sort-merge join, which splits them. An empty table gives no rows."""
    spark = words.sparkSession
    spelt = words.select("word", "n", F.array_join(F.array_sort(F.split("word", "")), "").alias("letters"))
    crowded = (spelt.groupBy("letters").count().where(F.col("count") > anagrams)
               .select("letters", F.ceil(F.col("count") / anagrams).alias("pieces")))
    piece = F.pmod(F.xxhash64("word"), F.coalesce("pieces", F.lit(1)))
    units = (spelt.join(crowded, "letters", "left").groupBy("letters", piece.alias("piece"))
             .agg(F.collect_list(F.struct("word", "n")).alias("words")).select("letters", "words"))
    units = materialise(units)
    total = units.count()
    parts = parts or max(p for least, p in PARTS if total >= least)
    shipped = spark.sparkContext.broadcast(Vectors(dimension_shares(units.select("letters"), max(total, 1)), parts))
    signatures = units.mapInArrow(_signed_units(shipped), "sig bigint, role tinyint, left_out smallint, low bigint, high bigint, "
                                                          f"letters string, words {UNIT}")
    # one exchange serves both sides: the roles are tested together, so neither side is filtered by itself;
    # sort-merge, as the planner's size of a side is that of the units and not of their signatures
    apart = F.bit_count(F.expr("a.low ^ b.low")) + F.bit_count(F.expr("a.high ^ b.high"))
    same = F.expr(f"a.role + 3 * b.role = {SAME + 3 * SAME} and a.letters < b.letters") & (apart <= 2)
    step = F.expr(f"a.role + 3 * b.role = {SHORT + 3 * LONGER}") & (apart == 1)
    met = signatures.alias("a").join(signatures.alias("b").hint("merge"),
                                     F.expr("a.sig = b.sig and a.left_out = b.left_out") & (same | step))
    found = met.select("a.left_out", "a.letters", F.col("b.letters").alias("other"), "a.words", F.col("b.words").alias("others"))
    pairs = materialise(found.mapInArrow(_verified(shipped), "a string, a_n bigint, b string, b_n bigint"))
    discard(units)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), forms followed to the last, by
    doubling; counts grow along the way, so there is no circle."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ups = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        new = materialise(now.join(ups, "root", "left").select(
            "word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        discard(now)
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS,
                      least_count: int = LEAST_COUNT, ratio: int = RATIO, plant: int | None = None,
                      anagrams: int = ANAGRAMS, parts: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least
    ``least_letters`` letters and ``least_count`` occurrences: its near words'
    number; its form, the near word of largest n (ties: the first in
    code-point order) if that n is ``ratio`` (2 at least) times its own or more, else null;
    its root, the last of the forms followed from it (else itself).

    Null and empty texts have no words; a null key counts as an empty one
    where misspellings are planted. Repeated rows count each; an empty table
    gives no rows; only key and text are read. Texts are read whole, of a very
    long one the words are held by one task; words of any length are kept."""
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = materialise(counted_words(docs, key, text, least_letters, plant).where(F.col("n") >= least_count))
    pairs = near_pairs(words, anagrams, parts)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    known = materialise(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.col1") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.col1")).alias("n"))).alias("f")))
    ends = roots(known.where("f is not null").select("word", F.col("f.form").alias("form")))
    return known.join(ends, "word", "left").select(
        "word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near",
        F.col("f.n").alias("form_n"))
