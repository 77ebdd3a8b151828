"""Boosted trees against a trainer that looks at every row, and their parts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stampcard.operators import boosting
from stampcard.operators.boosting import Settings


def sample(n=2000, seed=5):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 12, n), rng.exponential(size=n), rng.integers(0, 2, n), rng.normal(size=n).round(1)], axis=1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] + 0.3 * x[:, 1] - 2 * x[:, 3] * x[:, 2] - 2)))).astype(float)
    return x, y


def plain_fit(bins, y, numbers, s, width):
    """Trees by trying every cut of every drawn input on the rows of every node, one node at a time."""
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    trees = []

    def gain_of(g, h):
        shrunk = max(abs(g) - s.l1, 0.0)
        return shrunk * shrunk / (h + s.l2)

    for number in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        keep = boosting._drawn(numbers, number, s)
        splits, values = {}, {}

        def grow(node, rows, level):
            total_g, total_h = g[rows].sum(), h[rows].sum()
            values[node] = -np.sign(total_g) * max(abs(total_g) - s.l1, 0.0) / (total_h + s.l2)
            if level == s.depth:
                return
            found = []
            for k in boosting.drawn_inputs(width, number, s):
                for cut in range(s.bins - 1):
                    left = rows[bins[rows, k] <= cut]
                    right = rows[bins[rows, k] > cut]
                    if h[left].sum() >= s.child_weight and h[right].sum() >= s.child_weight:
                        found.append((gain_of(g[left].sum(), h[left].sum()) + gain_of(g[right].sum(), h[right].sum()) - gain_of(total_g, total_h), k, cut))
            top = max(found, default=(0,))[0]
            if top < s.gamma or top <= 1e-6:
                return
            _, k, cut = next(f for f in found if f[0] >= top * (1 - 1e-9))
            splits[node] = k, cut, top
            grow(2 * node + 1, rows[bins[rows, k] <= cut], level + 1)
            grow(2 * node + 2, rows[bins[rows, k] > cut], level + 1)

        grow(0, np.flatnonzero(keep), 0)
        for r in range(len(y)):
            node = 0
            while node in splits:
                node = 2 * node + 1 + (bins[r, splits[node][0]] > splits[node][1])
            margin[r] += s.rate * values[node]
        trees.append((splits, values))
    return trees, 1 / (1 + np.exp(-margin))


@pytest.fixture(scope="module")
def frame(spark):
    x, y = sample()
    return spark.createDataFrame([(k, *map(float, row), bool(label)) for k, (row, label) in enumerate(zip(x, y))], "id LONG, a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE, y BOOLEAN")


@pytest.mark.parametrize("settings", [Settings(trees=6, depth=3, bins=16, rate=0.3), Settings(trees=3, depth=4, bins=8, l1=3.0, l2=5.0, gamma=2.0, columns=1.0, rows=1.0)])
def test_equals_a_plain_trainer(spark, frame, settings, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)
    inputs = list("abcde")
    fitted = boosting.fit(frame.coalesce(1).orderBy("id").coalesce(1), inputs, "y", settings)
    x, y = sample()
    bins = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(fitted.edges)], axis=1)
    trees, p = plain_fit(bins, y, np.arange(len(y)), settings, len(inputs))
    for tree, (splits, values) in zip(fitted.trees, trees):
        assert {k: (int(tree.inputs[k]), int(tree.cuts[k])) for k in np.flatnonzero(tree.inputs >= 0)} == {k: v[:2] for k, v in splits.items()}
        assert all(tree.gains[k] == pytest.approx(v[2], rel=1e-6) for k, v in splits.items())
        assert all(tree.values[k] == pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in values.items())
    got = np.array([r.p for r in fitted.score(frame, "p").orderBy("id").collect()])
    assert got == pytest.approx(p, rel=1e-6)


def test_partitions_do_not_change_the_first_tree(frame):
    s = Settings(trees=1, depth=3, bins=16, rows=1.0)
    one, many = (boosting.fit(frame, list("abcde"), "y", s, tasks) for tasks in (1, 7))
    assert (one.trees[0].inputs == many.trees[0].inputs).all() and one.trees[0].values == pytest.approx(many.trees[0].values)


def test_it_learns_and_weighs_inputs(spark, frame):
    fitted = boosting.fit(frame.withColumn("noise", F.rand(3)), [*"abcd", "noise"], "y", Settings(trees=25, depth=4, rate=0.2, columns=1.0))
    weights = fitted.importance()
    assert sum(weights.values()) == pytest.approx(1) and max(weights, key=weights.get) in "ad" and weights["noise"] < weights["a"] / 3
    from stampcard.operators.evaluation import ranking_metrics

    assert ranking_metrics(fitted.score(frame.withColumn("noise", F.lit(0.5)), "p"), "p", "y").first().auc > 0.8


def test_saved_trees_score_alike(spark, frame, tmp_path):
    fitted = boosting.fit(frame, list("abcde"), "y", Settings(trees=3, depth=2))
    fitted.save(spark, str(tmp_path / "b"))
    restored = boosting.Booster.load(spark, str(tmp_path / "b"))
    assert restored.score(frame, "p").exceptAll(fitted.score(frame, "p")).count() == 0 and restored.settings == fitted.settings


def test_one_kind_of_label_is_refused(frame):
    with pytest.raises(ValueError):
        boosting.fit(frame.where("y"), list("abcde"), "y")


def jobs_of(spark, group, fit):
    spark.sparkContext.setJobGroup(group, "jobs of a fit")
    try:
        fit()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()


def test_a_level_is_one_job_at_most(spark, frame, monkeypatch):
    """Whatever the partitions: no query of its own and no shuffle a level; no job a level if one task has all rows."""
    s = Settings(trees=10, depth=3, bins=16)
    assert jobs_of(spark, "few rows", lambda: boosting.fit(frame.repartition(3), list("abcde"), "y", s)) <= 14
    monkeypatch.setattr(boosting, "FEW_ROWS", 0)
    assert jobs_of(spark, "many rows", lambda: boosting.fit(frame.repartition(3), list("abcde"), "y", s)) <= 10 * 3 + 14


@pytest.mark.parametrize("few_rows", [0, 25_000])
def test_held_and_stored_margins_are_those_of_all_trees(frame, monkeypatch, few_rows):
    s = Settings(trees=9, depth=3, bins=16)
    whole = boosting.fit(frame, list("abcde"), "y", s, 3)
    for name, value in (("HOLD_EVERY", 2), ("STORE_EVERY", 5), ("BLOCK_ROWS", 100), ("FEW_TASKS", 2), ("FEW_ROWS", few_rows)):
        monkeypatch.setattr(boosting, name, value)
    cut = boosting.fit(frame, list("abcde"), "y", s, 3)
    for one, two in zip(whole.trees, cut.trees):
        assert (one.inputs == two.inputs).all() and (one.cuts == two.cuts).all() and one.values == pytest.approx(two.values)


def test_rows_of_a_few_tables_need_no_job_a_level(spark, monkeypatch):
    """A sample of 30,000 rows: one task has the sums of a level long before a job has started."""
    monkeypatch.setattr(boosting, "level_sums", None)
    rows = spark.range(0, 30_000, 1, 4).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    fitted = boosting.fit(rows.withColumn("y", F.col("a") + F.col("b") > 1), ["a", "b"], "y", Settings(trees=2, depth=2, bins=16))
    assert len(fitted.trees) == 2 and fitted.trees[0].inputs[0] >= 0


def test_few_rows_walk_a_tree_once(monkeypatch):
    """The task that has all rows goes on from the nodes of the level before, and gets the sums that blocks of the rows get."""
    s = Settings(trees=4, depth=4, bins=16, rate=0.3)
    x, y = sample()
    bins = np.stack([np.searchsorted(np.quantile(c, np.arange(1, s.bins) / s.bins), c) for c in x.T], axis=1).astype(np.uint8)
    none = np.zeros(len(y))
    blocks = [boosting._packed(np.arange(len(y))[k : k + 300], y[k : k + 300], none[k : k + 300], none[k : k + 300], bins[k : k + 300]) for k in range(0, len(y), 300)]

    class Rows(list):
        def mapPartitions(self, run):
            return Rows(run(iter(self)))

        def collect(self):
            return self

    plain = []
    for number in range(s.trees):
        plain.append(boosting.grow(5, number, s, lambda *asked: boosting.part_sums(blocks, 5, plain, *asked)))
    walked, nodes = [], boosting.Tree.nodes
    monkeypatch.setattr(boosting.Tree, "nodes", lambda tree, rows, depth: walked.append(len(rows)) or nodes(tree, rows, depth))
    for one, two in zip(boosting.few_rows_trees(Rows(blocks), 5, [], range(s.trees), s), plain, strict=True):
        assert (one.inputs == two.inputs).all() and (one.cuts == two.cuts).all() and one.values == pytest.approx(two.values)
    assert sum(walked) == len(y) * s.trees
    walked_down = boosting.grown(none, bins, plain, s)
    assert boosting.margins(bins, plain, s) == pytest.approx(walked_down)


def test_a_level_reads_the_lesser_siblings_only(frame):
    """The sums of a node are those of its children, so at most half the open nodes are asked for, and the trees are those of all of them."""
    s = Settings(trees=1, depth=5, bins=16, rate=0.3, child_weight=1.0)
    x, y = sample()
    bins = np.stack([np.searchsorted(np.quantile(c, np.arange(1, s.bins) / s.bins), c) for c in x.T], axis=1).astype(np.uint8)
    none, asked = np.zeros(len(y)), []
    block = boosting._packed(np.arange(len(y)), y, none, none, bins)

    def sums(tree, level, number, chosen, nodes, settings):
        asked.append(nodes)
        return boosting.part_sums([block], 5, [], tree, level, number, chosen, nodes, settings)

    tree = boosting.grow(5, 0, s, sums)
    splits = [np.count_nonzero(tree.inputs[(1 << k) - 1 : (2 << k) - 1] >= 0) for k in range(s.depth)]
    assert [len(nodes) for nodes in asked] == [1, *splits[:-1]] and splits[2] > 2
    for nodes in asked[1:]:
        assert len({(n - 1) // 2 for n in nodes}) == len(nodes)


def test_many_rows_take_a_task_a_core(spark, monkeypatch):
    """Not a task for each so many rows: a level is one round of tasks, and their sums go to the driver at once."""
    parts, sums = [], boosting.level_sums
    monkeypatch.setattr(boosting, "FEW_ROWS", 0)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boosting, "level_sums", lambda blocks, *asked: parts.append(blocks.getNumPartitions()) or sums(blocks, *asked))
    rows = spark.range(0, 4000, 1, 4).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    boosting.fit(rows.withColumn("y", F.col("a") + F.col("b") > 1), ["a", "b"], "y", Settings(trees=1, depth=2, bins=16), 40)
    assert set(parts) == {spark.sparkContext.defaultParallelism}


def test_scores_keep_the_columns_asked_for(frame):
    fitted = boosting.fit(frame, list("abcde"), "y", Settings(trees=3, depth=2))
    kept = fitted.score(frame, "p", ["y", "id"])
    assert kept.columns == ["y", "id", "p"] and kept.exceptAll(fitted.score(frame, "p").select("y", "id", "p")).count() == 0
