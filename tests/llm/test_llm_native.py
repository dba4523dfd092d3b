"""Sharding and quality rules: laws, odd input, agreement with plain Python."""

import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.quality_rules import Rule, apply_rules, cascade, default_rules, keep, with_statistics
from ledgerlens.llm.sharding import assign_shards, write_shards

SPACE = re.compile(r"[\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (2, ""), (None, "é ☃ x"), (3, " \t\n\x0b\x0c\r "), (4, "a" * 50_000), (5, "word " * 30_000),
       (5, "word " * 30_000), (6, "two lines\ntwo lines\n\n x"), (None, None)]


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 7, "x", 1.0) for i, t in rows],
                                 "doc_id long, text string, shard int, key string, n_words double")


def check_law(rows, texts, n):
    by_key = collections.Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in texts)
    assert collections.Counter((r.doc_id, r.text_crc32, r.size) for r in rows) == by_key
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    for s in {r.shard for r in rows}:
        own = [r for r in rows if r.shard == s]
        assert 0 <= s < n and sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / n) <= largest
    ids = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in order]
    assert ids == sorted(ids)  # contiguous in the order


@pytest.mark.parametrize("n", [1, 3, 24])
def test_shards_of_odd_rows(spark, n):
    check_law(assign_shards(frame(spark, ODD), n).collect(), ODD, n)


def test_shards_with_a_hot_key_and_copies(spark):
    rows = [(i % 3 and i, "copy" if i % 3 == 0 else f"text {i} " * (i % 40)) for i in range(3000)]
    out = assign_shards(frame(spark, rows).repartition(7), 8).collect()
    check_law(out, rows, 8)


def test_shards_of_nothing(spark):
    assert assign_shards(frame(spark, []), 4).count() == 0


def test_written_shards_hold_all_columns(spark, tmp_path):
    write_shards(frame(spark, ODD), str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(ODD)
    assert back.select("carried.*").columns == ["doc_id", "text", "shard", "key", "n_words"]


def plain(text):
    words = [w for w in SPACE.split(text or "") if w]
    seen = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    return (len(words), sum(map(len, words)), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)),
            len(covered))


@pytest.mark.parametrize("rows", [ODD, [], [(i, " ".join(f"w{(i * j) % 9}" for j in range(i))) for i in range(60)]])
def test_statistics_match_plain_python(spark, rows):
    out = apply_rules(frame(spark, rows)).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                              for r in out)
    want = collections.Counter((i, *(s := plain(t)), s[0] < 10 or 100 * s[4] > 20 * s[0]) for i, t in rows)
    assert got == want
    assert not any(r.kept for r in out if r.base_failed)


def test_order_of_the_cascade_does_not_change_the_verdict(spark):
    rows = [(i, " ".join(f"{'#' * (i % 3)}word{j}{'!' * (i % 4)}" for j in range(20))) for i in range(48)]
    docs = frame(spark, rows)
    a = {r.doc_id: r.kept for r in apply_rules(docs, rules=default_rules()).collect()}
    b = {r.doc_id: r.kept for r in apply_rules(docs, rules=default_rules()[::-1], sample_rows=5).collect()}
    assert a == b and len(set(a.values())) == 2


def test_cascade_prefers_rules_that_reject(spark):
    never, always = Rule("never", lambda: F.col("n_words") < 0), Rule("always", lambda: F.col("n_words") >= 0)
    texts = frame(spark, [(i, " ".join(f"w{j}" for j in range(30))) for i in range(20)]).select("text")
    assert [r.name for r in cascade(texts, [never, always])] == ["always", "never"]
    assert with_statistics(texts).count() == 20


def test_keep_returns_whole_rows(spark):
    good = " ".join(f"word{j}" for j in range(30))
    rows = [(1, good), (1, good), (2, "short"), (3, None), (None, good), (4, "## " * 40 + good)]
    out = keep(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "shard", "key", "n_words"]
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 1]


def test_clean_labelled_documents_stay(spark):
    """Nearly all documents labelled good that pass the base stay; nearly all
    labelled bad go."""
    d = "/root/testdata/sf0.1"
    out = apply_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    got = {(r.quality, r.base_failed, r.kept): r["count"] for r in out.groupBy("quality", "base_failed", "kept").count().collect()}
    good = {k: v for k, v in got.items() if k[0] == 1 and not k[1]}
    assert good.get((1, False, False), 0) <= 0.001 * sum(good.values())
    bad = {k: v for k, v in got.items() if k[0] == 0}
    assert sum(v for k, v in bad.items() if k[2]) <= 0.02 * sum(bad.values())
