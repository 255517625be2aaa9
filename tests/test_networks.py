"""Networks: gradients against differences, weights against repeated rows, early stop, and runs that were cut off."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varigrade.operators import models, networks
from varigrade.plans import evaluation
from varigrade.sources.sinks import StateStore


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select(
        (F.col("id") % 4).cast("int").alias("ppv_bin"), ((F.col("id") % 4) * 0.25).alias("ppv"),
        F.when(F.col("id") % 50 != 0, F.concat(F.lit("g"), F.col("id") % 4)).alias("gene"),
        (F.col("id") % 7).cast("double").alias("noise"), F.lit(1).alias("constant"),
        (F.col("id") % 2).cast("int").alias("has_exact_mic"), F.lit(0).alias("has_variant_mic"),
        F.concat(F.lit("m"), F.col("id") % 60).alias("mutation_key"), ((F.col("id") % 60) % 5).cast("int").alias("fold"))
    return models.columns_to_vector(df, (*models.BASELINE_DROP, "fold")).cache()


def blocks(rows, weight=1.0, target="ppv"):
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return networks.blocks_of(rows, "features", (), F.col(target), weight, F.lit(-1), F.lit(False), 1)


@pytest.mark.parametrize("classes", [True, False])
def test_gradients_equal_differences(classes):
    rng = np.random.default_rng(2)
    net = networks.Network(inputs=3, tables=((5, 2), (4, 3)), uses=(0, 1, 1), hidden=(6, 5), outputs=4 if classes else 1, classes=classes)
    given = net.start(1)
    x, ids = rng.normal(size=(20, 3)), rng.integers(0, 4, (20, 3))
    target, weight = rng.integers(0, 4, 20).astype(float), rng.integers(1, 5, 20).astype(float)

    def loss(parameters):
        return (net.loss(net.forward(parameters, x, ids)[-1], target)[0] * weight).sum()

    layers = net.forward(given, x, ids)
    made = net.gradients(given, layers, net.loss(layers[-1], target)[1] * weight[:, None], ids)
    assert set(made) == set(given)
    for name in given:
        for at in [tuple(rng.integers(0, s) for s in given[name].shape) for _ in range(4)]:
            moved = [given | {name: given[name].copy()} for _ in range(2)]
            moved[0][name][at] += 1e-6
            moved[1][name][at] -= 1e-6
            assert made[name][at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-6, rel=1e-4, abs=1e-5)


def test_scaling_inside_the_first_layer_equals_scaled_features(rows):
    held = blocks(rows)
    scale = networks.feature_scales(held, 8, 1)[0]
    x = np.concatenate([b.dense(8) for b in held.collect()]).astype(float)
    assert scale.mean == pytest.approx(x.mean(axis=0)) and scale.deviation[1] == 1.0
    assert scale.deviation[0] == pytest.approx(x[:, 0].std())
    net = networks.Network(inputs=8, hidden=(5,), outputs=1)
    given, ids = net.start(3), np.zeros((len(x), 0), int)
    inside = net.forward(scale.inside(given), x, ids)
    plain = net.forward(given, (x - scale.mean) / scale.deviation, ids)
    assert inside[-1] == pytest.approx(plain[-1])
    slope = np.ones_like(plain[-1])
    assert scale.outside(net.gradients(scale.inside(given), inside, slope, ids))["W0"] == pytest.approx(
        net.gradients(given, plain, slope, ids)["W0"], abs=1e-8)


def test_weights_equal_repeated_rows(rows):
    weight = (F.col("has_exact_mic") * 3 + 1).cast("int")
    repeated = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), weight)))
    net, training = networks.Network(inputs=8, hidden=(6, 4), outputs=4, classes=True), networks.Training(epochs=5)
    once = networks.train(blocks(rows, weight=weight, target="ppv_bin"), net, 1, training)[0]
    often = networks.train(blocks(repeated, target="ppv_bin"), net, 1, training)[0]
    for name in once.parameters:
        assert once.parameters[name] == pytest.approx(often.parameters[name], abs=1e-9)
    assert np.array(once.losses) == pytest.approx(np.array(often.losses))


def test_classifier_and_regressor_learn_on_unseen_groups(rows):
    log, losses = evaluation.network_cv(rows, "ppv_bin", classes=4, training=networks.Training(epochs=150))
    assert log.count() == 600
    assert log.filter("actual = predicted").count() / 600 > 0.9  # a tenth of some folds has no gene
    assert losses.filter("best").count() == 5
    log, _ = evaluation.network_cv(rows, "ppv", training=networks.Training(epochs=150))
    spread = log.select(F.avg(F.abs(F.col("actual") - F.col("predicted")))).first()[0]
    assert spread < 0.1


def test_fits_share_the_products_with_the_features(rows, monkeypatch):
    """one product there and one back a block, whatever the number of fits; sums are those of each fit alone."""
    given = networks.blocks_of(rows, "features", (), F.col("ppv_bin"), F.lit(2.0), F.col("fold"), F.col("noise") == 3, 5).collect()
    for hidden in ((6, 4), ()):
        net = networks.Network(inputs=8, hidden=hidden, outputs=4, classes=True)
        starts = [net.start(seed) for seed in range(3)] + [None, net.start(4)]
        made, product = [], networks.SparseRows.__matmul__
        with monkeypatch.context() as patch:
            patch.setattr(networks.SparseRows, "__matmul__", lambda x, w: made.append(w.shape[1]) or product(x, w))
            together = networks.pass_sums(given, net, starts)[0]
        assert made == [4 * net.sizes[1]] * len(given)
        for fit, start in enumerate(starts):
            expected = np.zeros_like(together[fit])
            for block in given if start else []:
                at = np.flatnonzero(block.part[:, fit] != networks.NONE)
                train, weight, ids = block.part[at, fit] == networks.TRAIN, block.weight[at], block.ids[at]
                layers = net.forward(start, block.dense(8)[at].astype(float), ids)
                losses, slope = net.loss(layers[-1], block.target[at])
                sums = net.flat(net.gradients(start, layers, slope * (weight * train)[:, None], ids))
                expected += np.append(sums, [(losses * weight)[m].sum() if k % 2 == 0 else weight[m].sum()
                                             for k, m in enumerate((train, train, ~train, ~train))])
            assert together[fit] == pytest.approx(expected, abs=1e-9)


def test_a_fit_stops_by_patience_and_keeps_its_best_epoch(spark):
    noise = spark.range(300).select(F.col("id"), (F.xxhash64("id") % 100 / 50.0).alias("y"), F.xxhash64("id", F.lit(1)).alias("h"),
                                    (F.col("id") % 2 == 0).alias("held"))
    rows = noise.select("y", F.col("h").cast("double").alias("x"), "held")
    vectors = models.columns_to_vector(rows, drop=("y", "held"))
    given = networks.blocks_of(vectors, "features", (), F.col("y"), F.lit(1), F.lit(-1), F.col("held"), 1)
    scales = networks.feature_scales(given, 1, 1)
    fit = networks.train(given, networks.Network(inputs=1), 1, networks.Training(epochs=300, patience=4, warm_up=3, step=0.05), scales)[0]
    assert not fit.running and len(fit.losses) < 300
    held = [h for _, _, h in fit.losses]
    assert fit.best_epoch == int(np.argmin(held)) and fit.best_loss == min(held)
    assert any(np.any(fit.best[n] != fit.parameters[n]) for n in fit.best)


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(900).select(
        F.col("id").alias("uniqueid"), (F.col("id") % 5).alias("gene_id"), (F.col("id") % 3).alias("pos_id"), F.lit(1).alias("wt_aa"),
        (F.col("id") % 4).alias("mut_aa"), F.lit(0).alias("drug_id"), ((F.col("id") % 5) - 2).cast("float").alias("log2mic"))


def test_embeddings_learn_categories_and_losses_are_those_of_single_rows(ids):
    fitted = evaluation.fit_measurements(ids, networks.Training(epochs=60, decay=0.0))
    scores = {r.part: r for r in evaluation.measurement_scores(fitted.log).collect()}
    assert scores["validation"].r2 > 0.9 and scores["train"].n + scores["validation"].n == 900
    best = fitted.losses.filter("best").first()
    log = fitted.log.withColumn("e", F.pow(F.col("actual") - F.col("predicted"), 2) * F.col("n"))
    by = {r.part: r.e / r.n / 2 for r in log.groupBy("part").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).collect()}
    assert best.held_loss == pytest.approx(by["validation"]) and best.train_loss == pytest.approx(by["train"])


def test_a_resumed_run_equals_an_uncut_one(spark, ids, tmp_path):
    training, store = networks.Training(epochs=9, decay=0.0), StateStore(spark, str(tmp_path / "state"))
    assert store.load() is None
    whole = evaluation.fit_measurements(ids, training)
    cut = evaluation.fit_measurements(ids, training, store, stop_after=4)
    assert len(cut.state.losses) == 4 and store.load()[0] == 4
    resumed = evaluation.fit_measurements(ids, training, store)
    assert resumed.losses.collect() == whole.losses.collect()
    for name in whole.state.parameters:
        assert np.array_equal(resumed.state.parameters[name], whole.state.parameters[name])
        assert np.array_equal(resumed.state.best[name], whole.state.best[name])


def test_a_long_table_stays_on_the_executors(spark, ids, tmp_path, monkeypatch):
    """the driver never gets its gradient, and losses and predictions are those of the plain run."""
    training = networks.Training(epochs=12, decay=0.0)
    whole = evaluation.fit_measurements(ids, training)
    monkeypatch.setattr(networks, "DRIVER_ENTRIES", 100)
    monkeypatch.setattr(networks, "train", lambda *given, **more: pytest.fail("gradients of all tables went to the driver"))
    assert evaluation.fit_measurements(ids, networks.Training(epochs=1)).network.long_table() == 0
    spread = evaluation.fit_measurements(ids, training)
    assert "E0" not in spread.state.parameters and "E0" in whole.state.parameters
    assert np.array(spread.state.losses) == pytest.approx(np.array(whole.state.losses), rel=1e-9)
    assert spread.state.best_epoch == whole.state.best_epoch
    order = ["part", "actual", "n", "predicted"]
    one, other = ([tuple(r) for r in fit.log.select(order).orderBy(order).collect()] for fit in (whole, spread))
    assert len(one) == len(other) and all(a == pytest.approx(b, rel=1e-7, abs=1e-9) if i == 3 else a == b
                                          for x, y in zip(one, other) for i, (a, b) in enumerate(zip(x, y)))
    store = StateStore(spark, str(tmp_path / "state"))
    evaluation.fit_measurements(ids, training, store, stop_after=4)
    resumed = evaluation.fit_measurements(ids, training, store)
    assert resumed.losses.collect() == spread.losses.collect()
    assert sorted(resumed.log.collect()) == sorted(spread.log.collect())


@pytest.mark.parametrize("rows", [0, 1, 4096, 10_001])
def test_parts_of_a_long_table_start_as_the_whole(rows):
    net = networks.Network(tables=((3, 2), (rows, 4), (5, 2)), uses=(0, 1, 2))
    whole, without = net.start(7), net.start(7, 1)
    for part in range(6):
        assert np.array_equal(net.start_of(7, 1, part, 6), whole["E1"][part::6])
    assert "E1" not in without and all(np.array_equal(without[k], whole[k]) for k in without)


def test_the_store_keeps_the_last_whole_version(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    for version in (1, 2, 3):
        store.save(version, b"state %d" % version)
    assert store.load() == (3, b"state 3")
    for part in (tmp_path / "s" / "slot=1").glob("*.parquet"):  # as a writer leaves it that was cut off
        part.unlink()
    assert store.load() == (2, b"state 2")
    vocabulary = spark.createDataFrame([("a", 0)], "value string, id bigint")
    store.save_vocabularies({"gene": vocabulary})
    assert store.load_vocabularies(("gene",))["gene"].collect() == [("a", 0)]


def test_too_many_parameters_and_empty_tables(rows):
    with pytest.raises(ValueError):
        networks.Network(tables=((10 ** 9, 64),), uses=(0,)).start(1)
    log, losses = evaluation.network_cv(rows.limit(0).withColumn("fold", F.lit(0)).unionByName(rows.limit(1)), "ppv_bin", classes=4,
                                        training=networks.Training(epochs=2))
    assert log.count() == 1 and losses.filter("fit = 0").count() <= 2
