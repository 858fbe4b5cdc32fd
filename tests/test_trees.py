import numpy as np

from blockyard.operators import trees
from blockyard.operators.trees import Model, Options, cross_validate, predict, softmax, train


def table(spark, n=300):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3)).round(3)
    y = np.where(x[:, 0] > 0.3, "a", np.where(x[:, 1] > 0, "b", "c"))
    return spark.createDataFrame([(i, [float(v) for v in r], str(c)) for i, (r, c) in enumerate(zip(x, y))], "id int, features array<double>, label string")


ALL = Options(rounds=4, depth=3, rate=0.4, row_share=1.1, column_share=1.0)


def test_fits_and_is_the_same_however_dealt(spark):
    df = table(spark)
    a, b = train(df, "label", 3, ALL), train(df.repartition(7), "label", 3, ALL)
    assert a.trees[0][0].keys() == b.trees[0][0].keys()
    x = np.array([r["features"] for r in df.collect()])
    assert np.allclose(a.scores(a.bin(x)), b.scores(b.bin(x)))
    out = predict(df, a)
    assert out.filter("tree_type = label").count() > 0.9 * 300
    again = Model.from_json(a.to_json())
    assert np.allclose(again.scores(again.bin(x)), a.scores(a.bin(x)))


def test_first_round_by_hand(spark):
    rows = [([float(i)], "a" if i < 10 else "b") for i in range(20)]
    m = train(spark.createDataFrame(rows, "features array<double>, label string"), "label", 1, Options(rounds=1, depth=1, row_share=1.1, column_share=1.0))
    f, b = m.trees[0][0][1]
    x = np.arange(20.0)[:, None]
    assert f == 0 and ((m.bin(x)[:, 0] > b) == (x[:, 0] >= 10)).all()
    g, h = 10 * (0.5 - 1), 10 * 0.25  # each class has half of the rows, so every p is 1/2
    assert np.isclose(m.trees[0][0][2][0], -g / (h + 1))


def test_ties_and_softmax():
    assert softmax(np.zeros((1, 3))).argmax(1)[0] == 0


def test_out_of_fold(spark):
    from pyspark.sql import functions as F

    df = table(spark, 120)
    out = cross_validate(df, "label", 3, 2, F.col("id") % 2, Options(rounds=2, depth=2, rate=0.4))
    assert out.count() == 120 and out.filter("tree_type = label").count() > 60


def test_rounds_beyond_the_held_scores(spark):
    df = table(spark, 150)
    m = train(df, "label", 3, Options(rounds=10, depth=1, rate=0.4, row_share=1.1, column_share=1.0))
    rows = df.collect()
    x, y = m.bin(np.array([r["features"] for r in rows])), [r["label"] for r in rows]
    s, n = np.tile(m.base, (len(x), 1)), len(rows)
    for trees in m.trees:  # brute force: the leaves of every round from the scores of all rounds before
        p, add = softmax(s), np.zeros_like(s)
        for k, nodes in trees.items():
            is_k = np.array([v == m.classes[k] for v in y])
            side = np.ones(n, int) if len(nodes) == 1 else 2 + (x[:, nodes[1][0]] > nodes[1][1])
            for node in set(side):
                g, h = (p[:, k] - is_k)[side == node], np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)[side == node]
                assert np.isclose(nodes[node][0], -g.sum() / (h.sum() + 1))
                add[side == node, k] = nodes[node][0] * 0.4
        s += add
    assert len(m.trees) == 10 and np.allclose(s, m.scores(x))


def test_thresholds_are_the_sorted_list_s(spark):
    from blockyard.operators.trees import fit_bins

    rng = np.random.default_rng(3)
    n = 997
    x = np.stack([rng.normal(size=n), rng.integers(-3, 4, n) / 2, np.zeros(n), (rng.random(n) < 0.02) * 1.0, -np.exp(rng.normal(size=n) * 30), np.where(rng.random(n) < 0.5, -0.0, 0.0), rng.normal(size=n).astype(np.float32)], 1)
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "features array<double>").repartition(5)
    for bins in (2, 32):
        want = [sorted({float(np.sort(x[:, j])[b * n // bins]) for b in range(1, bins)}) for j in range(x.shape[1])]
        assert fit_bins(df, x.shape[1], bins) == want
    assert fit_bins(df.limit(0), 7) == [[]] * 7


def nodes_of(model):
    return [[{n: v if len(v) == 2 else round(v[0], 9) for n, v in nodes.items()} for _, nodes in sorted(t.items())] for t in model.trees]


def wide(spark, n=240, classes=4):
    """Dense numbers, and sparse slots of which most are never set."""
    rng = np.random.default_rng(7)
    dense, hot, bag = rng.normal(size=(n, 4)), np.eye(30)[rng.integers(0, 6, n)], (rng.random((n, 60)) < 0.05) * rng.random((n, 60))
    x = np.concatenate([dense, hot, bag], 1)
    y = (np.digitize(dense[:, 0], [-0.5, 0.5]) + (hot[:, 2] > 0)) % classes
    rows = [(i, [float(v) for v in r], f"c{c}") for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, features array<double>, label string").repartition(3), x.shape[1]


def test_folds_in_one_pass_are_the_separate_fits(spark):
    from pyspark.sql import functions as F

    from blockyard.operators.trees import train_models

    df, dims = wide(spark)
    o = Options(rounds=3, depth=3, rate=0.3)
    members = {"0": F.col("id") % 3 != 0, "1": F.col("id") % 3 != 1, "2": F.col("id") % 3 != 2, "all": F.lit(True), "none": F.lit(False)}
    together = train_models(df, "label", dims, members, o)
    assert set(together) == {"0", "1", "2", "all"}
    for name, m in together.items():
        alone = train(df.filter(members[name]), "label", dims, o)
        assert (m.classes, m.thresholds) == (alone.classes, alone.thresholds) and nodes_of(m) == nodes_of(alone)
    tight = train_models(df, "label", dims, {"all": F.lit(True)}, o, hist_bytes=1000)["all"]
    assert nodes_of(tight) == nodes_of(together["all"])


def test_scans_do_not_grow_with_models(spark):
    from pyspark.sql import functions as F

    from blockyard.operators.trees import train_models

    df, dims = wide(spark, 120)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (1, 4):
        spark.sparkContext.setJobGroup(f"models-{n}", "")
        train_models(df, "label", dims, {str(i): F.col("id") % 4 != i if n > 1 else F.lit(True) for i in range(n)}, Options(rounds=2, depth=2))
        jobs.append(len(tracker.getJobIdsForGroup(f"models-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 6  # a selection step or two more, however many models


def test_splits_against_a_dense_scan(spark):
    """The first tree of each class by looking at every bin of every feature."""
    df, dims = wide(spark)
    o = Options(rounds=1, depth=2, row_share=1.1, column_share=1.0)
    m = train(df, "label", dims, o)
    rows = df.collect()
    x, y = m.bin(np.array([r["features"] for r in rows])), [r["label"] for r in rows]
    p = softmax(np.tile(m.base, (len(x), 1)))
    for k, name in enumerate(m.classes):
        g, h = p[:, k] - np.array([v == name for v in y]), np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)

        def check(node, here, k=k, g=g, h=h):
            score = lambda s: g[s].sum() ** 2 / (h[s].sum() + o.smooth)  # noqa: B023, E731
            gains = {(f, b): score(here & (x[:, f] <= b)) + score(here & (x[:, f] > b)) - score(here) for f in range(dims) for b in range(len(m.thresholds[f])) if min((here & (x[:, f] <= b)).sum(), (here & (x[:, f] > b)).sum()) >= o.min_leaf}
            own = m.trees[0][k][node]
            if len(own) == 1:
                assert node >= 4 or max(gains.values(), default=0) <= 1e-9
                assert np.isclose(own[0], -g[here].sum() / (h[here].sum() + o.smooth))
            else:
                assert np.isclose(gains[tuple(own)], max(gains.values()))
                check(2 * node, here & (x[:, own[0]] <= own[1]))
                check(2 * node + 1, here & (x[:, own[0]] > own[1]))

        check(1, np.ones(len(x), bool))


def test_blocks_bound_the_cells_of_a_sum():
    from blockyard.operators.trees import Cells

    thresholds = [list(range(31))] * 70 + [[0.0, 1.0]] * 919
    cells = Cells(thresholds, np.zeros(989, int), np.arange(989))
    assert sum(map(len, cells.blocks)) == 989 and max(cells.size(b) for b in range(len(cells.blocks))) <= 4097


def test_holdout_and_final_fit_carry_scores(spark, tmp_path):
    from pyspark.sql import functions as F

    from blockyard.operators.trees import holdout_fit
    from blockyard.sources.files import load_model, save_model

    df = table(spark, 200).withColumn("rule", F.lit("a"))
    dev, final = holdout_fit(df, "label", 3, F.col("id") % 4 == 0, Options(rounds=3, depth=2, rate=0.4), names=["x", "y", "z"], rule="rule")
    assert dev.holdout["n"] == 50 and dev.holdout == final.holdout
    held = predict(df.filter("id % 4 = 0"), dev)
    assert dev.holdout["trees"] == held.filter("tree_type = label").count() and dev.holdout["rules"] == held.filter("label = 'a'").count()
    assert dev.holdout["blend_0.7"] == held.filter("if(tree_conf >= 0.7, tree_type, rule) = label").count()
    assert nodes_of(dev) == nodes_of(train(df.filter("id % 4 <> 0"), "label", 3, Options(rounds=3, depth=2, rate=0.4)))
    save_model(spark, final.to_json(), str(tmp_path / "m"))
    again = Model.from_json(load_model(spark, str(tmp_path / "m")))
    assert again == final and again.names == ["x", "y", "z"] and again.options["rounds"] == 3


def test_null_features_and_labels(spark):
    rows = [([None, float(i)], "a" if i < 10 else "b") for i in range(20)] + [([1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "features array<double>, label string")
    m = train(df, "label", 2, Options(rounds=2, depth=1, row_share=1.1, column_share=1.0))
    assert m.thresholds[0] == [0.0] and predict(df, m).filter("tree_type = label").count() == 20


def test_values_in_few_bins_and_in_many_give_the_same_sums():
    """Features whose values lie mostly in one bin are added up value by value, others bin by bin; leaves need totals alone."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (500, 4)).astype(np.uint8)
    usual, thresholds = np.array([2, 5, 0, 8]), [[float(i) for i in range(8)]] * 4
    cells = trees.Cells(thresholds, usual, np.arange(4))
    table, (row, cell) = cells.table(x, 0), cells.entries(x, 0)
    dense = np.bincount(table.ravel(), np.broadcast_to(np.arange(500.0), table.shape).ravel(), cells.size(0))
    dense[cells.starts[0] + usual] = 0
    assert np.array_equal(dense, np.bincount(cell, np.arange(500.0)[row], cells.size(0)))
    x[:] = usual
    assert cells.table(x, 0) is None and not len(cells.entries(x, 0)[0])
    nodes = {1: [0, 3], 2: [0.5], 3: [1, 4], 6: [0.25], 7: []}
    x = rng.integers(0, 9, (200, 4)).astype(np.uint8)
    want = [2 if r[0] <= 3 else 6 if r[1] <= 4 else 7 for r in x]
    assert trees._places(x, nodes).tolist() == want and trees._places(x, {1: [0.1]}).tolist() == [1] * 200
