"""Periodic runs, spelling variants and fingerprints against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import fingerprints as FP
from ledgerlens.llm import periodic_runs as P
from ledgerlens.llm import queries as Q
from ledgerlens.llm import spelling_variants as V

ODD = [(1, None), (2, ""), (2, ""), (None, "a b a b a b a b a b"), (None, None), (3, " \t\n "), (4, "one"), (5, "x x x x x x x"),
       (7, "w " * 20_000), (8, "u v\tu v\nu v u\x0bv u v"), (9, "É é É é É é É é"), (10, "a b " * 5 + "c " + "a b " * 5)]


def frame(spark, rows):
    """Rows with more columns, whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "k", 1, "r") for i, t in rows],
                                 "doc_id long, text string, key string, chunk int, runs string")


def brute_runs(words, exponent=4, length=6):
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            own = words[i:j + q]
            if j > i and len(own) >= max(length, exponent * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((i, len(own), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng, letters, pieces):
    words = []
    for _ in range(rng.randrange(pieces)):
        unit = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(1, 7))]
        words += (unit * rng.randrange(1, 9))[:rng.randrange(1, 50)]
    return words


@pytest.mark.parametrize("exponent,length", [(4, 6), (2, 2), (3, 10)])
def test_runs_match_every_period(exponent, length):
    rng = random.Random(exponent)
    for _ in range(150):
        block = [periodic_words(rng, rng.choice([1, 2, 3, 5]), 8) for _ in range(rng.randrange(1, 6))]
        assert P.runs_of(block, exponent, length) == [brute_runs(w, exponent, length) for w in block]


def test_classes_are_united_by_falling_lcp():
    ids, first = P.word_ids([b"a b a b a b a b c".split()])
    a, b, lcp = P.sorted_neighbours(ids, 2)
    assert sorted(lcp.tolist(), reverse=True) == [6, 5, 4, 3, 2]
    got = list(P.seeds(a, b, lcp))
    assert (first[0], first[0] + 2, 6) == got[0] and [l for _, _, l in got] == sorted((l for _, _, l in got), reverse=True)


def test_a_long_run_is_one_run():
    assert P.runs_of([[b"w"] * 100_000, [b"%d" % (i % 7) for i in range(100_000)]]) == [[(0, 100_000, 1)], [(0, 100_000, 7)]]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(key, text):
    words = words_of(text)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def run_row(key, text):
    words = planted(key, text)
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(1)
    rows = [r for r in ODD if len(r[1] or "") < 10_000]
    for i in range(11, 211):
        rows.append((i, b" ".join(periodic_words(rng, 4, 10)).decode() if i % 3 else " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(90)))))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.queries()["op11_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(run_row(*r) for r in rows)
    assert sum(r.n_runs for r in out.collect()) > 100


def test_runs_of_odd_rows_and_empty_tables(spark):
    got = {r.doc_id: r for r in P.periodic_runs(frame(spark, ODD).where("doc_id is not null")).collect()}
    assert got[7].n_words == 20_000 and got[7].kept == "w" and [tuple(x) for x in got[7].runs] == [(0, 20_000, 1)]
    assert got[10].kept == "a b c a b" and got[1].kept == "" and got[1].runs == []
    assert P.periodic_runs(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        P.periodic_runs(frame(spark, []), exponent=1)


# --- spelling variants ---------------------------------------------------------------

def apart(a, b):
    """Exactly one inserted, deleted or replaced letter, by all places."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@pytest.mark.parametrize("anagrams,parts", [(64, None), (3, 4), (1000, 10)])
def test_near_words_match_all_pairs(spark, anagrams, parts):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(900)}
    words |= {"a" * 100, "a" * 99 + "b", "a" * 101, "a" * 50 + "b" + "a" * 50, "b" * 100}
    df = spark.createDataFrame([(w, rng.randrange(2, 99)) for w in words], "word string, n long")
    n = {r.word: r.n for r in df.collect()}
    got = [(frozenset((r.a, r.b)), n[r.a] == r.a_n, n[r.b] == r.b_n) for r in V.near_pairs(df, anagrams, parts).collect()]
    want = {frozenset(p) for p in itertools.combinations(words, 2) if apart(*p)}
    assert all(x and y for _, x, y in got) and len(got) == len(want) and {p for p, _, _ in got} == want


def test_signatures_meet_at_one_counted_place():
    vectors = V.Vectors({f"{c}0": 0.5 for c in "abcdef"}, 6)
    for a, b in (("abcdef", "abcdeg"), ("aabcde", "abbcde"), ("abcdef", "abcdefg")):
        (_, ours), (_, theirs) = vectors.signatures(a), vectors.signatures(b)
        same = {(c, s) for r, c, s in ours if r == V.SAME} & {(c, s) for r, c, s in theirs if r == V.SAME}
        step = {(c, s) for r, c, s in ours if r == V.SHORT} & {(c, s) for r, c, s in theirs if r == V.LONGER}
        assert bool(same) == (len(a) == len(b)) and bool(step) == (len(a) < len(b))


def brute_variants(rows, plant=31):
    count = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if plant and h % plant == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    near = {w: [v for v in count if apart(w, v)] for w in count}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= 10 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), form[w] and count[form[w]]))
    return out


def spelt_rows(seed=2):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeinrstéÉ") for _ in range(rng.randrange(7, 11))) for _ in range(25)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(stems[:rng.choice([2, 4, 25])])
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] + "n"]) + w[at + 1:]
            words.append(rng.choice([w, w.upper(), f"{w}7{w}", w + "."]))
        rows.append((i, " ".join(words)))
    return rows + [(None, "Zzzzzzzz zzzzzzzz Zzzzzzzz"), (None, None), (1, ""), (1, ""), (4, "ab" * 50_000), (5, "ab" * 50_000), (6, "×÷×÷×÷× ×÷×÷×÷×"),
                   (7, "chainaaa " * 2 + "chainaab " * 20 + "chainabb " * 200)]


def test_variants_match_brute_force(spark, tmp_path):
    rows = spelt_rows()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.queries()["op12_spelling_variants"](spark, str(tmp_path)).collect()
    want = brute_variants(rows)
    assert len(out) == len(want) and {tuple(r) for r in out} == want
    assert any(f for _, f, *_ in want) and any(r != (f or w) for w, f, r, *_ in want)


def test_variants_of_empty_tables_and_ties(spark):
    assert V.spelling_variants(frame(spark, [])).collect() == []
    rows = [(1, "colours colourx " * 20 + "colour7 colourt colourt")]
    got = {r.word: (r.form, r.n_near) for r in V.spelling_variants(frame(spark, rows)).collect()}
    assert got["colourt"] == ("colours", 2)  # of equal counts the first in code-point order
    with pytest.raises(ValueError):
        V.spelling_variants(frame(spark, rows), ratio=1)


# --- fingerprints --------------------------------------------------------------------

def shingles(text, n=5):
    words = (text or "").encode().split()
    return {tuple(words[i:i + n]) for i in range(max(len(words) - n + 1, min(len(words), 1)))}


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def brute_classes(rows, similar=0.8):
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= similar:
            parent[find(j)] = find(i)
    least = {}
    for k, t in rows:
        if k is not None:
            r = find(texts.index(t or ""))
            least[r] = min(least.get(r, k), k)
    return {t: least.get(find(i)) for i, t in enumerate(texts)}


def near_texts(seed=4):
    rng = random.Random(seed)
    rows, k = [], 0
    for i in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 30, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            rows.append((k, " ".join(words)))
            k += rng.randrange(1, 4)
            words = list(words)
            for _ in range(rng.choice([0, 1, 3])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
    # a chain of small changes: its ends are no link, but one class
    words = [f"c{i}" for i in range(120)]
    for j in range(12):
        rows.append((k + 100 + j, " ".join(words)))
        words[10 * j] = "changed"
    return rows


@pytest.mark.parametrize("rows", [near_texts(), ODD, [(5, "only one")]])
def test_fingerprints_match_brute_force(spark, tmp_path, rows):
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = Q.queries()["op13_fingerprints"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    out = out.collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(k for k, _ in rows)
    text_of = {}
    by_key = dict(sorted(((k, t or "") for k, t in rows if k is not None), reverse=True))
    keys = sorted(by_key)
    for r in out:
        if r.doc_id is None:
            assert r.near_next is None
            continue
        text, after = by_key[r.doc_id], by_key[keys[(keys.index(r.doc_id) + 1) % len(keys)]]
        changed = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(shingles(text), shingles(changed))) < 0.25
        assert abs(r.near_next - jaccard(shingles(text), shingles(after))) < 0.25
        assert text_of.setdefault(text, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 500


@pytest.mark.parametrize("rows", [near_texts(), ODD, []])
def test_classes_match_all_pairs(spark, rows):
    group = brute_classes(rows)
    got = FP.near_duplicates(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == collections.Counter((k, group[t or ""]) for k, t in rows)


def test_chunks_hand_over_their_first_rows(spark):
    """Any number of chunks and partitions gives the same neighbours."""
    rows = frame(spark, [(3 * i, f"text {i} " * (i % 5)) for i in range(200)]).select(
        F.col("doc_id").alias("key"), "text", F.xxhash64("text").alias("d1"), F.lit(0).cast("long").alias("d2"))
    got = FP.in_key_order(rows, chunk_rows=7).mapInArrow(FP._backward(FP.MinHash(10)), (
        "key bigint, d1 bigint, d2 bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, "
        "edited_fingerprint binary, near_edited double, near_next double")).collect()
    texts = [f"text {i} " * (i % 5) for i in range(200)]
    want = {3 * i: hashlib.sha256(FP.edited(t, texts[(i + 1) % 200]).encode()).digest() for i, t in enumerate(texts)}
    assert len(got) == 200 and {r.key: r.edited_sha256 for r in got} == want


def test_likeness_estimates_similarity():
    rng = random.Random(6)
    minhash = FP.MinHash()
    errors = []
    for share in (0.1, 0.5, 0.8, 0.95):
        for _ in range(20):
            a = [f"a{rng.randrange(10 ** 6)}" for _ in range(300)]
            b = a[:int(300 * share)] + [f"b{rng.randrange(10 ** 6)}" for _ in range(300 - int(300 * share))]
            a, b = " ".join(a), " ".join(b)
            errors.append(FP.likeness(minhash.fingerprint(a), minhash.fingerprint(b)) - jaccard(shingles(a), shingles(b)))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


def test_fingerprints_of_an_empty_table(spark):
    assert FP.fingerprints(frame(spark, [])).collect() == []
