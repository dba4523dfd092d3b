"""Boosted trees against a plain single-process version."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import boosting as B


def table(spark, n=600, seed=1, partitions=5, noise=1.0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n).round(2), rng.integers(0, 2, n)]).astype(float)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 10, 0) * x[:, 2] + noise * rng.normal(size=n)
    df = spark.createDataFrame([(f"c{i}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "CustomerID string, a double, b double, c double, y double")
    return df.repartition(partitions), x, y


def plain_tree(bins, g, columns, cfg):
    """Nodes {path: (rows, split or None)} by looking at every cut of every
    node, one split at a time, largest gain first."""
    def best(rows):
        found = (0.0, None)
        total, n = g[rows].sum(), len(rows)
        for f in columns:
            for cut in range(bins[:, f].max()):
                left = rows[bins[rows, f] <= cut]
                if min(len(left), n - len(left)) < max(cfg.min_rows, 1):
                    continue
                gl = g[left].sum()
                gain = gl ** 2 / (len(left) + cfg.l2) + (total - gl) ** 2 / (n - len(left) + cfg.l2) - total ** 2 / (n + cfg.l2)
                if gain > found[0] + 1e-9 * max(1, abs(gain)):
                    found = gain, (f, cut)
        return found

    rows = np.arange(len(g))
    nodes, queue, leaves = {1: (rows, None)}, [], 1

    def offer(path):
        if cfg.max_depth is None or path.bit_length() <= cfg.max_depth:
            gain, split = best(nodes[path][0])
            if split:
                heapq.heappush(queue, (-gain, path, split))

    offer(1)
    while queue and (cfg.max_leaves is None or leaves < cfg.max_leaves):
        _, path, (f, cut) = heapq.heappop(queue)
        rows = nodes[path][0]
        nodes[path] = rows, (f, cut)
        nodes[2 * path] = rows[bins[rows, f] <= cut], None
        nodes[2 * path + 1] = rows[bins[rows, f] > cut], None
        leaves += 1
        offer(2 * path)
        offer(2 * path + 1)
    return nodes


def plain_fit(x, y, edges, hashes, cfg):
    bins = B.binned(list(x.T), edges)
    lower = lambda v: np.sort(v)[(len(v) - 1) // 2]
    margin = np.full(len(y), y.mean() if cfg.loss == "squared" else lower(y))
    trees = []
    for turn in range(cfg.rounds):
        own = np.flatnonzero(B.drawn(hashes, cfg.seed, turn, cfg.row_share))
        g = (margin - y if cfg.loss == "squared" else np.sign(margin - y))[own]
        nodes = plain_tree(bins[own], g, B.columns_of(turn, x.shape[1], cfg), cfg)
        value = {p: cfg.rate * (-g[r].sum() / (len(r) + cfg.l2) if cfg.loss == "squared" else lower((y - margin)[own[r]]))
                 for p, (r, split) in nodes.items() if split is None}
        at = np.ones(len(y), int)
        while True:
            split = [nodes[p][1] for p in at]
            if not any(split):
                break
            at = np.array([p if s is None else 2 * p + (bins[i, s[0]] > s[1]) for i, (p, s) in enumerate(zip(at, split))])
        margin = margin + np.array([value[p] for p in at])
        trees.append({p: s for p, (_, s) in nodes.items() if s})
    return trees, margin


@pytest.mark.parametrize("cfg", [
    B.Boosting(rounds=4, max_depth=4, row_share=0.7, column_share=0.67, rate=0.3),
    B.Boosting(rounds=23, max_depth=2, row_share=1.0, rate=0.3, l2=0.0, min_rows=5),
    B.Boosting(rounds=3, loss="absolute", max_depth=None, max_leaves=9, l2=0.0, min_rows=20, row_share=1.0, column_share=1.0, rate=0.3),
    B.Boosting(rounds=2, loss="squared", max_depth=None, max_leaves=6, min_rows=10, row_share=1.0, column_share=1.0)])
def test_same_splits_as_a_plain_version(spark, cfg):
    df, x, y = table(spark, n=400)
    model = B.fit(df, ["a", "b", "c"], "y", cfg)
    hashes = np.array([r.h for r in spark.createDataFrame([(i, f"c{i}") for i in range(len(y))], "i int, k string")
                       .select("i", F.xxhash64("k").alias("h")).orderBy("i").collect()], np.int64)
    trees, margin = plain_fit(x, y, model.edges, hashes, cfg)
    assert [{t.nodes[i].path: (t.nodes[i].feature, t.nodes[i].bin) for i in t.split} for t in model.trees] == trees
    got = np.array([r.p for r in df.withColumn("p", model.predict()).orderBy(F.substring("CustomerID", 2, 9).cast("int")).collect()])
    assert np.allclose(got, margin, atol=1e-9)
    loss = (margin - y) ** 2 if cfg.loss == "squared" else np.abs(margin - y)
    assert model.history[-1][:2] == (cfg.rounds, pytest.approx(loss.mean() ** (0.5 if cfg.loss == "squared" else 1)))


def test_leaf_wise_defaults_and_rows_of_leaves(spark):
    df, x, y = table(spark, n=3000, noise=3.0)
    cfg = B.Boosting(**{**vars(B.LEAF_WISE), "rounds": 2})
    model = B.fit(df, ["a", "b", "c"], "y", cfg)
    for t in model.trees:
        assert len(t.leaves()) == 31 and max(t.nodes[i].depth for i in t.leaves()) > 5
        assert min(t.nodes[i].rows for i in t.leaves()) >= 20


def test_early_stopping_keeps_the_best_round(spark):
    df, _, _ = table(spark, n=300, noise=20.0)
    cfg = B.Boosting(rounds=80, rate=0.5, max_depth=4, patience=3, row_share=1.0, column_share=1.0)
    model = B.fit(df, ["a", "b", "c"], "y", cfg, validation=F.pmod(F.xxhash64("CustomerID"), F.lit(4)) == 0)
    errors = [v for _, _, v in model.history]
    best = int(np.argmin(errors))
    assert len(model.history) < 80 and len(model.trees) == best and len(errors) - 1 - best == 3
    rows = B.rounds_table(spark, model).collect()
    assert [r.is_best for r in rows].index(True) == best and sum(r.is_best for r in rows) == 1
    held = df.where(F.pmod(F.xxhash64("CustomerID"), F.lit(4)) == 0).withColumn("p", model.predict())
    assert held.agg(F.sqrt(F.avg((F.col("p") - F.col("y")) ** 2))).first()[0] == pytest.approx(errors[best])


def test_partitions_do_not_matter_and_models_are_kept(spark, tmp_path):
    cfg = B.Boosting(rounds=3)
    one, two = (B.fit(table(spark, n=500, partitions=p)[0], ["a", "b", "c"], "y", cfg, parts=q) for p, q in ((1, None), (7, 11)))
    assert [t.split for t in one.trees] == [t.split for t in two.trees] and np.allclose(one.importances(), two.importances())
    assert sum(one.importances()) == pytest.approx(1) and one.importances()[0] > 0.5
    B.save_model(spark, one, f"{tmp_path}/m")
    assert B.load_model(spark, f"{tmp_path}/m").to_json() == one.to_json()


def test_odd_tables(spark):
    df = spark.createDataFrame([(f"c{i}", None if i % 2 else float(i), 1.0, None if i == 3 else 2.0) for i in range(40)],
                               "CustomerID string, a double, b double, y double")
    model = B.fit(df, ["a", "b"], "y", B.Boosting(rounds=2))
    assert all(not t.split for t in model.trees)  # one target value: nothing to gain
    assert {r.p for r in df.withColumn("p", model.predict()).select("p").collect()} == {2.0}
    with pytest.raises(ValueError):
        B.fit(df.where("y is null"), ["a"], "y")
    with pytest.raises(ValueError):
        B.Boosting(loss="huber")


def test_a_fit_writes_no_table_and_many_partitions_add_up(spark):
    import glob

    from ledgerlens.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/cut-*"))
    cfg = B.Boosting(rounds=2, loss="absolute", max_depth=2, min_rows=5)
    few, many = (B.fit(table(spark, n=400)[0], ["a", "b", "c"], "y", cfg, parts=p) for p in (2, B.FEW_PARTS + 3))
    assert set(glob.glob(f"{folder}/cut-*")) == before  # rows stay in the cached blocks
    assert [t.split for t in few.trees] == [t.split for t in many.trees]
    assert few.history[-1] == pytest.approx(many.history[-1])


@pytest.mark.parametrize("copies", [1, 300])
def test_bounds_of_a_rank_meet_in_its_value(copies):
    rng = np.random.default_rng(copies)
    parts = [np.sort(np.repeat(rng.normal(size=40).round(1), copies)), np.sort(rng.normal(size=700)), np.empty(0)]
    whole = np.sort(np.concatenate(parts))
    for rank in (1, len(whole) // 2, len(whole)):
        low, high, steps = -np.inf, np.inf, 0
        while low != high:
            found = []
            for r in parts:
                below, end = np.searchsorted(r, low, side="left"), np.searchsorted(r, high, side="right")
                v, first, n = np.unique(r[below:end], return_index=True, return_counts=True)
                kept = np.unique(np.linspace(0, len(v) - 1, min(8, len(v))).astype(int))
                found.append((v[kept], below + first[kept], below + first[kept] + n[kept], (below, end)))
            low, high = B.bracket(found, rank)
            assert low <= whole[rank - 1] <= high and (steps := steps + 1) < 9
        assert low == whole[rank - 1]
