"""Near duplicates, substring dedup and decontamination against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination as D
from ledgerlens.llm import simhash_dedup as S
from ledgerlens.llm import substring_dedup as R

ODD = [(1, None), (2, ""), (2, ""), (None, "a b c d"), (None, "a b c d"), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "one two"),
       (7, "w " * 30_000), (8, "w " * 30_001), (9, "É é x y z")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, fp int, row int, key string")


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(values, distance=2):
    """value -> smallest value linked to it, by comparing all pairs."""
    values = np.array(sorted(set(values)), np.uint64)
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= distance):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            parent[b] = a
    return {int(v): int(values[find(i)]) for i, v in enumerate(values)}


def brute_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    root = roots([f for _, f in prints])
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return collections.Counter((i, f"{f:016x}", least.get(root[f])) for i, f in prints)


def near_copies(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 400]))]
        rows.append((3 * i + 1, " ".join(words)))
        if i % 3 == 0:
            words[rng.randrange(len(words))] = "changed"
            rows.append((3 * i, " ".join(words)))
        if i % 4 == 0:
            rows.append((3 * i + 2, rows[-1][1].upper()))
    return rows


@pytest.mark.parametrize("rows", [ODD, [], near_copies(120)])
def test_near_duplicates_match_all_pairs(spark, rows):
    out = S.near_duplicates(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == brute_components(rows)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("kind", ["chain", "hot part", "ball", "random"])
def test_links_and_components_of_hard_sets(spark, kind):
    rng = random.Random(kind)
    base = rng.getrandbits(64)
    if kind == "chain":  # long components
        found, x = set(), base
        for _ in range(300):
            found.add(x)
            x ^= 1 << rng.randrange(64)
    elif kind == "hot part":  # a third of all share the low half
        found = {(base & 0xFFFFFFFF) | rng.getrandbits(32) << 32 for _ in range(500)} | {rng.getrandbits(64) for _ in range(1000)}
    elif kind == "ball":  # many within two bits of one another
        found = {base ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(24), 2)} | {base}
    else:
        found = {rng.getrandbits(64) & 0xFFFF0000FFFF for _ in range(800)}
    nodes = spark.createDataFrame([(signed(x), i) for i, x in enumerate(sorted(found))], "fp long, key long")
    got = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in S.links(nodes).collect()}
    values = np.array(sorted(found), np.uint64)
    want = set()
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ v) <= 2):
            a, b = int(v), int(values[j])
            want.add((a, b) if signed(a) > signed(b) else (b, a))
    assert got == want
    root = roots(found)
    comp = {r.fp & (1 << 64) - 1: r.component_id for r in S.components(nodes).collect()}
    keys = {x: i for i, x in enumerate(sorted(found))}
    assert comp == {x: keys[root[x]] for x in found}


def test_thresholds_satisfy_the_pigeonhole():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**64, 256, np.uint64)
    sample[:200] &= np.uint64(0xFFFFFFFF00000000)  # a crowded lower half
    for m in S.PARTS:
        groups = S.group_bits(np.eye(64), m)
        assert sorted(itertools.chain(*groups)) == list(range(64))
        given, cost = S.thresholds(sample, groups, 2, sample, 10_000_000)
        assert (given.sum(axis=1) == 3).all() and np.isfinite(cost).all()
    halves = [list(range(32)), list(range(32, 64))]
    crowded, _ = S.thresholds(sample[:200], halves, 2, sample, 10_000_000)
    assert crowded[:, 0].mean() < crowded[:, 1].mean()  # few probes where it is crowded


def test_keep_one_of_each_group(spark):
    rows = near_copies(40) + [(1, None), (2, ""), (500, "same text here now"), (500, "same text here now"), (None, "same text here now")]
    docs = frame(spark, rows)
    out = S.keep_one(docs)
    assert out.columns == docs.columns
    want = {c for _, _, c in brute_components(rows)}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def brute_removal(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s:s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s:s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return collections.Counter(out)


def passages(seed, n=60, window=50):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 3)
    shared = [[word() for _ in range(rng.randint(window // 2, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [[word() for _ in range(rng.randint(0, window))]]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            cut = rng.randint(0, 10)
            parts += [p[cut:], [word() for _ in range(rng.randint(0, 20))]]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(itertools.chain(*parts))))
    return rows + [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (1, rows[1][1]), (None, rows[5][1]), (n + 3, None), (n + 4, "x " * 400)]


@pytest.mark.parametrize("seed,window,gram", [(0, 50, 20), (1, 50, 20), (2, 12, 5)])
def test_removal_matches_brute_force(spark, seed, window, gram):
    rows = passages(seed, window=window)
    out = R.remove_repeats(frame(spark, rows), window=window, gram=gram, group=20).collect()  # tiny groups: long prefixes
    assert collections.Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == brute_removal(rows, window)


def test_removal_of_odd_rows(spark):
    out = R.remove_repeats(frame(spark, ODD), carry=["doc_id", "row", "text"]).collect()
    assert collections.Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == brute_removal(ODD, 50)
    assert R.remove_repeats(frame(spark, [])).count() == 0


def test_one_passage_in_a_third_of_all_documents(spark):
    rng = random.Random(4)
    common = " ".join(f"c{j}" for j in range(70))
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(rng.randint(5, 60))) + (f" {common} tail{i}" if i % 3 == 0 else "")) for i in range(900)]
    out = {r.row.doc_id: r.n_removed for r in R.remove_repeats(frame(spark, rows).repartition(9)).collect()}
    assert all(out[i] == (70 if i % 3 == 0 and i else 0) for i in out)


def test_window_minimum_and_rolling_hash():
    x = np.random.default_rng(0).integers(0, 2**64, 100, np.uint64)
    for w in (1, 2, 5, 31, 32, 33):
        assert (R.window_minimum(x, w) == [x[i:i + w].min() for i in range(101 - w)]).all()
    y = np.concatenate([x[10:40], x[10:40]])
    a, b = R.rolling(x, 20), R.rolling(y, 20)
    assert (a[10:21] == b[:11]).all() and (b[30:] == b[:11]).all() and len(R.rolling(x[:5], 20)) == 0


def brute_leaks(docs, items, threshold=0.8):
    """Best weighted-shingle similarity over every window of the item's size."""
    grams = {i: collections.Counter(D.shingles(D.words_of(t))) for i, t in items}
    grams = {i: g for i, g in grams.items() if g}
    distinct = {tuple(D.words_of(t)): grams[i] for i, t in items if i in grams}  # copies of an item count once
    df = collections.Counter(x for g in distinct.values() for x in g)
    found = {}
    for d, text in docs:
        words = D.words_of(text)
        for i, own in grams.items():
            n = len(D.words_of(dict(items)[i]))
            size = min(n, len(words))
            best = 0.0
            for s in range(len(words) - size + 1 if words else 0):
                w = words[s:s + size]
                k = min(5, n) if n < 5 else 5
                other = collections.Counter(b" ".join(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) > k else collections.Counter([b" ".join(w)])
                keys = own.keys() | other.keys()
                weight = {x: D.weight_of(df[x] if x in own else 1, len(distinct)) for x in keys}
                low, high = (sum(weight[x] * f(own[x], other[x]) for x in keys) for f in (min, max))
                best = max(best, low / high)
            if best >= threshold:
                found[d, i] = round(best, 9)
    return found


def leak_fixture(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"v{j}" for j in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([3, 4, 5, 8, 15, 30, 30, 45, 59])]
    items += [(20, None), (21, ""), (22, items[5][1].upper().replace(" ", " \n")), (23, " ".join(items[5][1].split()[:20] + text(10)))]
    docs = []
    for d in range(40):
        words = text(rng.randint(0, 80))
        if d % 2:
            p = dict(items)[rng.choice([0, 2, 3, 4, 5, 6, 7, 8, 23])].split()
            if d % 4 == 1 and len(p) > 12:
                p[rng.randrange(len(p))] = "edit"
            words += [w.upper() for w in p] + text(rng.randint(0, 30))
        docs.append((d, "\n".join(words)))
    return docs + [(100, None), (101, ""), (102, items[8][1]), (103, " ".join(items[8][1].split()[:-2]))], items


@pytest.mark.parametrize("pass_bytes", [1 << 20, 300])
def test_contamination_matches_all_windows(spark, pass_bytes):
    docs, items = leak_fixture()
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9)
           for r in D.contaminated(frame(spark, docs), bench, pass_bytes=pass_bytes).collect()}
    assert got == brute_leaks(docs, items)


@pytest.mark.parametrize("n_items", [60, 1000])
def test_near_copy_of_an_item_that_is_a_third_of_the_benchmark(spark, n_items):
    words = [f"q{j}" for j in range(40)]
    items = [(i, " ".join(words if i % 3 == 0 else [f"o{i}x{j}" for j in range(12)])) for i in range(n_items)]
    near = " ".join(["before"] * 9 + words[:38] + ["changed", words[39]] + ["after"] * 9)  # two of 36 shingles
    out = D.contaminated(spark.createDataFrame([(1, near)], "doc_id int, text string"),
                         spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {r.item_id for r in out} == {i for i, _ in items if i % 3 == 0}
    assert D.weight_of(1, 100_000) <= 1.5 * D.weight_of(100_000, 100_000)


def test_copies_of_an_item_change_no_similarity_and_fill_no_pass(spark):
    docs, items = leak_fixture()
    copies = items + [(1000 + j, items[5][1]) for j in range(len(items) // 2)]  # a third of the benchmark
    schema = "item_id int, text string"
    once, often = ({(r.doc_id, r.item_id): (round(r.similarity, 9), r.word_start) for r in D.contaminated(
        frame(spark, docs), spark.createDataFrame(rows, schema), pass_bytes=300).collect()} for rows in (items, copies))
    assert {k: v for k, v in often.items() if k[1] < 1000} == once
    assert {d for d, i in often if i == 1000} == {d for d, i in once if i == 5}
    texts = D._texts(spark.createDataFrame(copies, schema), "item_id", "text").select("digest", "t").distinct()
    passes = D._passes(texts, 300)
    for r in texts.groupBy(D._number(passes)).agg(F.sum(F.octet_length("t")).alias("size"), F.count("*").alias("n")).collect():
        assert r.size <= 300 or r.n == 1


def test_first_of_equal_windows_and_a_very_long_text(spark):
    item = " ".join(f"z{j}" for j in range(12))
    text = "start " + (item + " between ") * 2 + "filler words " * 200_000 + item
    out = D.contaminated(spark.createDataFrame([(1, text)], "doc_id int, text string"),
                         spark.createDataFrame([(7, item)], "item_id int, text string")).collect()
    assert [(r.item_id, r.similarity, r.word_start, r.n_words) for r in out] == [(7, 1.0, 1, 12)]


def test_clean_drops_only_contaminated_rows(spark):
    docs, items = leak_fixture()
    bench = spark.createDataFrame(items, "item_id int, text string")
    bad = {d for d, _ in brute_leaks(docs, items)}
    rows = docs + [(1000, docs[1][1]), (1000, "other words only"), (None, docs[0][1]), (None, items[7][1])]
    out = D.clean(frame(spark, rows), bench)
    kept = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns[:2] == ["doc_id", "text"]
    assert kept == collections.Counter([r for r in docs if r[0] not in bad] + [(1000, "other words only"), (None, docs[0][1])]
                                       + ([(1000, docs[1][1])] if 1 not in bad else []))
    assert D.clean(frame(spark, docs), bench.limit(0)).count() == len(docs)
    assert D.contaminated(frame(spark, []), bench).count() == 0


def test_op7_digest(spark):
    import __spark_entry__ as E
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_removal(rows, 50)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in E.queries()["op7_substring_dedup"](spark, d).collect()}
    assert got == want


def test_multi_index_holds_every_item_within_the_radius():
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(12))) for i in range(100)]
    items = D.prepare(rows, 100, {})
    masks = D.length_masks(items)[12]
    for i in range(0, 100, 7):
        fp = int(items.fingerprints[i])
        for flips in (0, 1, D.RADIUS):
            x = fp
            for b in rng.sample(range(64), flips):
                x ^= 1 << b
            near = {j for j in range(100) if (x ^ int(items.fingerprints[j])).bit_count() <= D.RADIUS}
            assert {j for _, j in D.candidates(items, np.array([x], np.uint64), masks)} == near


def test_components_of_repeated_rows_use_little(spark):
    """Copies meet in one node, so their number adds no links."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    out = S.near_duplicates(docs)
    assert out.agg(F.max("component_id")).first()[0] == 0 and out.count() == 3000


def test_keep_one_with_repeated_and_null_keys(spark):
    rows = [(1, "Alpha beta gamma delta"), (1, "alpha  beta gamma delta"), (1, "Alpha beta gamma delta"),
            (2, "alpha beta gamma DELTA"), (None, None), (None, ""), (None, "one two three four five six seven"),
            (3, "one two three four five six seven"), (None, "eight nine ten eleven twelve")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text or "") for r in S.keep_one(docs).collect()))
    first = min(("Alpha beta gamma delta", "alpha  beta gamma delta"), key=lambda s: hashlib.md5(s.encode()).hexdigest())
    assert got == [(0, ""), (0, "eight nine ten eleven twelve"), (1, first), (3, "one two three four five six seven")]
