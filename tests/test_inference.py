import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import causal, drivers, experiment, metrics, modeling, shap, survival
from tidemark.operators.features import Features, Meta
from tidemark.plans.spec import Spec
from tidemark.plans.timeline import Timeline

D = dt.date


def lives(spark, rows):
    return spark.createDataFrame(rows, "duration_days int, event int, entry_days int")


def product_limit(rows):
    out, s = {}, 1.0
    for t in sorted({d for d, e, _ in rows if e}):
        n = sum(d >= t and a < t for d, _, a in rows)
        k = sum(d == t and e for d, e, _ in rows)
        s *= 1 - k / n
        out[t] = (n, s)
    return out


@pytest.mark.parametrize("late", [False, True])
def test_kaplan_meier(spark, late):
    r = random.Random(3)
    rows = [(d := r.randint(1, 299), int(r.random() < 0.6), r.randint(0, d - 1) if late else 0) for _ in range(400)]
    got = {x["t"]: x for x in survival.kaplan_meier(lives(spark, rows)).collect()}
    want = product_limit(rows)
    assert set(got) == set(want)
    for t, (n, s) in want.items():
        assert got[t]["n_at_risk"] == n and got[t]["survival"] == pytest.approx(s, abs=1e-9) and got[t]["ci_low"] <= s + 1e-12 <= got[t]["ci_high"] + 1e-9


def test_delayed_entry_lowers_early_survival(spark):
    d = [50, 60, 70, 200, 210, 220]
    late = survival.kaplan_meier(lives(spark, [(x, 1, 150 * (x > 100)) for x in d])).filter("t <= 100").agg(F.min("survival")).first()[0]
    naive = survival.kaplan_meier(lives(spark, [(x, 1, 0) for x in d])).filter("t <= 100").agg(F.min("survival")).first()[0]
    assert late == 0.0 and naive == 0.5
    assert survival.median_lifetime(survival.kaplan_meier(lives(spark, [(x, 1, 0) for x in d]))).first()[0] == 70


def test_logrank(spark):
    r = random.Random(1)
    rows = [(r.randint(1, 200) + (100 if g else 0), 1, "b" if g else "a") for g in (0, 1) for _ in range(80)]
    far = survival.logrank(spark.createDataFrame(rows, "duration_days int, event int, g string"), "g")
    same = survival.logrank(spark.createDataFrame([(d, e, "ab"[i % 2]) for i, (d, e, _) in enumerate(rows)], "duration_days int, event int, g string"), "g")
    assert far.p_value < 1e-6 and same.p_value > 0.01 and far.df == 1


def newton(x, t, event, b=0.0):
    """Partial likelihood with Efron's ties by brute force, one covariate."""
    for _ in range(30):
        w, g, h = np.exp(b * x), 0.0, 0.0
        for u in np.unique(t[event]):
            m, d = t >= u, (t == u) & event
            for k in range(d.sum()):
                z = [((w * x**i)[m].sum() - k / d.sum() * (w * x**i)[d].sum()) for i in range(3)]
                g -= z[1] / z[0]
                h += z[2] / z[0] - (z[1] / z[0]) ** 2
            g += x[d].sum()
        b += g / h
    return b


def test_cox_equals_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=400)
    t = np.ceil(50 * r.exponential(size=400) / np.exp(0.7 * x)).astype(int)
    event, t = t <= 100, np.minimum(t, 100)
    rows = [(int(a), int(e), 0, float(b)) for a, e, b in zip(t, event, x)]
    made = survival.design(spark.createDataFrame(rows, "duration_days int, event int, entry_days int, x1 double"), ["x1"], [])
    fit = survival.cox(made, 0.0)
    assert fit.coefficients[0] == pytest.approx(newton(x, t, event), abs=1e-6) and fit.concordance > 0.6
    assert fit.coefficients[0] == pytest.approx(0.7, abs=3 * fit.errors[0]) and 0.02 < fit.errors[0] < 0.1
    assert survival.proportionality(made, fit)[0]["p_value"] > 0.001


def plain_gradient(x, t, event, entry, beta, penalty):
    """The score of the penalised partial likelihood with Efron's ties, several covariates, delayed entry."""
    w, out = np.exp(x @ beta), -penalty * len(t) * beta
    for u in np.unique(t[event]):
        at, dead = (t >= u) & (entry < u), (t == u) & event
        for k in range(dead.sum()):
            part = w[at].sum() - k / dead.sum() * w[dead].sum()
            out = out - ((w[:, None] * x)[at].sum(0) - k / dead.sum() * (w[:, None] * x)[dead].sum(0)) / part
        out = out + x[dead].sum(0)
    return out


def test_cox_solves_the_score_equations(spark):
    """At the fitted coefficients the gradient is 0: numbers and levels, many ties, delayed entry, a ridge."""
    r = np.random.default_rng(8)
    n = 500
    number, kind = 40 + 12 * r.normal(size=n), r.integers(0, 3, n)
    t = np.ceil(30 * r.exponential(size=n) / np.exp(0.03 * (number - 40) + 0.4 * (kind == 1))).astype(int)
    entry = r.integers(0, 4, n)
    event, t = t <= 40, np.maximum(np.minimum(t, 40), entry + 1)
    rows = [(int(a), int(e), int(s), float(x), f"k{k}") for a, e, s, x, k in zip(t, event, entry, number, kind, strict=True)]
    made = survival.design(spark.createDataFrame(rows, "duration_days int, event int, entry_days int, age double, kind string"), ["age"], ["kind"])
    for penalty in (0.0, 0.1):
        fit = survival.cox(made, penalty)
        plain = np.column_stack([number, kind == 1, kind == 2]).astype(float)
        assert fit.names == ["age", "kind=k1", "kind=k2"]
        x = (plain - plain.mean(0)) / plain.std(0, ddof=1)
        assert np.abs(plain_gradient(x, t, event, entry, fit.beta, penalty)).max() < 1e-4
        assert np.allclose(fit.coefficients * plain.std(0, ddof=1), fit.beta)
    assert np.allclose(survival._tied(7, 5.0, 2.0, 3), survival._tied(7, 5.0, 2.0))


def test_tails():
    assert special.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert special.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and special.chi_square_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.f_tail(4.0, 2, 30) == pytest.approx(0.0288446, abs=1e-6) and special.t_two_sided(2.042272, 30) == pytest.approx(0.05, abs=1e-5)


def test_sample_ratio():
    assert not experiment.sample_ratio([{"variant": "a", "n": 700}, {"variant": "b", "n": 300}])["passed"]
    assert experiment.sample_ratio([{"variant": "a", "n": 505}, {"variant": "b", "n": 495}])["passed"]


def _trial(spark, rolling):
    r = random.Random(2)
    rows = []
    for i in range(3000):
        start = D(2023, 2, 1) + dt.timedelta(days=r.randint(0, 29)) if rolling else D(2022, 6, 1) + dt.timedelta(days=r.randint(0, 199))
        arm = "treatment" if r.random() < 0.5 else "control"
        gone = r.random() < (0.10 if arm == "treatment" else 0.20)
        base = start if rolling else D(2023, 3, 1)
        rows.append((f"c{i}", start, base + dt.timedelta(days=20) if gone else None, "north" if i % 2 else "south", arm))
    return spark.createDataFrame(rows, "id string, signup date, gone date, region string, variant string")


def _run(spark, own, rolling):
    s = Spec("x", id_column="id", start_column="signup", event_column="gone", segments=("region",), experiment={"enabled": True, "variant_column": "variant", "control_value": "control", "horizon_days": 60} | own)
    return experiment.run(s, _trial(spark, rolling), Timeline(D(2022, 1, 1), D(2023, 12, 31), D(2023, 12, 31), D(2022, 1, 1)))


def test_rolling_experiment(spark):
    out = _run(spark, {"start_date": "2023-02-01", "end_date": "2023-03-15", "covariates": ["region"]}, True)
    found = out.results[1]
    assert out.trustworthy and found["lift_pp"] == pytest.approx(-10, abs=3) and found["p_value"] < 0.001 and found["adjusted_lift_pp"] == pytest.approx(found["lift_pp"], abs=0.5)


def test_snapshot_experiment(spark):
    lost = _run(spark, {"start_date": "2023-03-01", "end_date": "2023-04-01"}, False)
    assert not lost.enabled and "assignment_date" in lost.notes[0]
    out = _run(spark, {"assignment_date": "2023-03-01"}, False)
    assert out.results[1]["lift_pp"] == pytest.approx(-10, abs=3)


def test_doubly_robust(spark):
    r = np.random.default_rng(11)
    c = r.normal(size=6000)
    t = (r.random(6000) < 1 / (1 + np.exp(-0.9 * c))).astype(int)
    p = np.clip(np.clip(0.20 + 0.10 * c, 0.02, 0.9) + 0.06 * t, 0.01, 0.99)
    y = (r.random(6000) < p).astype(int)
    rows = [(i, D(2023, 1, 1), int(a), int(b), float(x), int(np.floor(x * 4))) for i, (a, b, x) in enumerate(zip(y, t, c))]
    df = spark.createDataFrame(rows, "entity_id long, snapshot_date date, label int, treated int, c double, s int")
    found = causal.estimate(causal.stratified(df, ["s"]).filter("e > 0 and e < 1"), 0.02)
    assert found["ate"] == pytest.approx(0.06, abs=0.025) and found["ci"][0] < 0.06 < found["ci"][1]
    naive = causal.naive_difference(df).first()[0]
    assert naive > found["ate"] + 0.03
    fake = drivers.shuffled(df, "treated", 7)
    assert abs(causal.estimate(causal.stratified(fake, ["s"]).filter("e > 0 and e < 1"), 0.02)["ate"]) < 0.02 + 0.01


OPTIONS = {"max_iter": 10, "learning_rate": 0.2, "max_leaf_nodes": 7, "class_weight": "balanced"}


def confounded(spark, rare):
    """A treatment that raises risk by 0.06, and a confounder that raises both; `rare`: 15 % are treated, 12 % have the event."""
    r, n = np.random.default_rng(11), 8000 if rare else 6000
    c, noise = r.normal(size=n), r.normal(0, 0.5, n)
    t = (r.random(n) < 1 / (1 + np.exp(-(0.9 * c - 2.0 * rare)))).astype(int)
    risk = np.clip(0.11 + 0.06 * c, 0.01, 0.9) if rare else np.clip(0.20 + 0.10 * c, 0.02, 0.9)
    y = (r.random(n) < np.clip(risk + 0.06 * t, 0.01, 0.99)).astype(int)
    rows = [(i, D(2023, 1, 1), int(a), int(b), float(x), float(z)) for i, (a, b, x, z) in enumerate(zip(y, t, c, noise, strict=True))]
    return spark.createDataFrame(rows, "entity_id long, snapshot_date date, label int, treated int, g__c double, g__noise double").cache()


PLAIN = {n: Meta(n, "g", "entity", "numeric", "static", None, "normal", "", True) for n in ("g__c", "g__noise")}


@pytest.mark.parametrize("rare", [False, True])
def test_nuisances_recover_a_known_effect(spark, rare):
    df = confounded(spark, rare)
    fitted = causal.nuisances(df, PLAIN, OPTIONS, 4, 42).cache()
    found = causal.estimate(fitted, 0.02)
    means = fitted.agg(F.avg("e"), F.avg("treated"), F.avg("label")).first()
    assert found["valid"] and found["ate"] == pytest.approx(0.06, abs=0.025) and found["ci"][0] < 0.06 < found["ci"][1]
    assert abs(causal.naive_difference(df).first()[0] - 0.06) > abs(found["ate"] - 0.06)
    assert means[0] == pytest.approx(means[1], abs=0.04)  # chances, not of balanced classes
    assert fitted.agg(F.avg("m0")).first()[0] < means[2] + 0.05


def test_a_placebo_has_no_effect(spark):
    fake = drivers.shuffled(confounded(spark, False), "treated", 7)
    assert abs(causal.estimate(causal.nuisances(fake, PLAIN, OPTIONS, 4, 42), 0.02)["ate"]) < 0.02


def test_a_mirror_of_the_treatment_is_named(spark):
    df = confounded(spark, False).limit(1500).withColumn("g__mirror", F.col("treated") + 0.001 * F.col("g__noise"))
    assert causal.culprit(df, ["g__c", "g__mirror", "g__noise"])[0] == "g__mirror" and causal.culprit(df, []) is None
    meta = PLAIN | {n: Meta(n, "g", "entity", "numeric", "static", None, "normal", "", True) for n in ("g__mirror", "t__x")}
    features = Features(df.withColumn("t__x", F.col("treated").cast("double")).drop("treated"), meta)
    out = causal.run(features, {"feature": "t__x"}, {"confounders": {"mode": "explicit", "explicit": ["g__c", "g__mirror"]}, "estimator": {"cross_fit_folds": 2}}, OPTIONS | {"max_iter": 25, "learning_rate": 0.6})
    assert out.verdict in ("not estimable", "weak overlap") and any("g__mirror" in n for n in out.notes)


def test_class_weights_are_honoured(spark):
    df = spark.createDataFrame([(f"e{i}", D(2023, 1, 1), int(i % 10 == 0), float(i // 10 % 5), f"k{i // 50 % 4}") for i in range(1500)], "entity_id string, snapshot_date date, label int, x double, k string")
    for how in ("balanced", None):
        weights = {r["label"]: r["w"] for r in modeling.weighted(df, how).groupBy("label").agg(F.first("weight").alias("w")).collect()}
        assert weights == ({0: pytest.approx(1500 / 2700), 1: pytest.approx(5.0)} if how else {0: 1.0, 1: 1.0})
    meta = {"x": PLAIN["g__c"], "k": Meta("k", "g", "entity", "categorical", "static", None, "normal", "", True)}
    means = []
    for how in ("balanced", None):
        o = OPTIONS | {"class_weight": how, "max_iter": 3}
        tree = modeling.score_tree(modeling.fit_tree(df, meta, o, 1), df, meta).agg(F.avg("score")).first()[0]
        line = modeling.score_linear(modeling.fit_linear(df, meta, o)[0], df, meta).agg(F.avg("baseline")).first()[0]
        means.append((tree, line))
    assert means[0][0] > means[1][0] + 0.2 and means[0][1] > 0.35 and means[1][1] == pytest.approx(0.1, abs=0.03)


def test_levels_are_bounded(spark):
    rows = [(f"e{i}", D(2023, 1, 1), i % 2, f"id{i}", "a" if i % 3 else None) for i in range(900)] + [("x", D(2023, 1, 1), 1, "id0", "rare")]
    df = spark.createDataFrame(rows, "entity_id string, snapshot_date date, label int, name string, kind string")
    assert modeling.common_levels(df, ["name", "kind"], 1, 5)["kind"] == ["a", "__missing__", "rare"] and len(modeling.common_levels(df, ["name"], 1, 5)["name"]) == 5
    assert modeling.common_levels(df, ["name", "kind"], 20, 9) == {"name": [], "kind": ["a", "__missing__"]} and modeling.common_levels(df, [], 1, 5) == {}
    meta = {n: Meta(n, "g", "entity", "categorical", "static", None, "normal", "", True) for n in ("name", "kind")}
    o = OPTIONS | {"max_iter": 2}
    assert modeling.score_tree(modeling.fit_tree(df, meta, o, 1), df, meta).count() == 901
    assert modeling.score_linear(modeling.fit_linear(df, meta, o)[0], df, meta).count() == 901


def test_folds_are_even_in_treatment_and_outcome(spark):
    df = spark.createDataFrame([(i, D(2023, 1, 1), int(i % 10 == 0), int(i % 4 == 0)) for i in range(400)], "entity_id long, snapshot_date date, label int, treated int")
    rows = modeling.folds_of(df, 4, 42, ("treated", "label")).groupBy("fold", "treated", "label").count().collect()
    for t, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
        sizes = [r["count"] for r in rows if (r["treated"], r["label"]) == (t, y)]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    assert causal.fold_count(df, 5) == 5 and causal.fold_count(df.filter("label = 0 or entity_id < 25"), 5) == 3


def _meta(name, group="g", source="log", depends=(), window=90):
    return Meta(name, group, source, "numeric", "time_varying", window, "normal", "", True, depends)


def test_confounders_leave_out_siblings_and_heirs():
    names = {n: _meta(n, n.split("__")[0]) for n in ("b__failed__event_count_90d", "b__failed__amount__sum_90d", "b__amount__sum_90d", "u__sessions__sum_90d", "u__sessions__mean_30d", "u__spend__sum_90d")}
    names["r__share"] = _meta("r__share", "r", "derived", ("b__failed__event_count_90d",))
    f = Features(None, names)
    assert causal.confounders(f, "b__failed__event_count_90d", {}) == ["u__sessions__sum_90d", "u__sessions__mean_30d", "u__spend__sum_90d"]
    assert "u__sessions__mean_30d" not in causal.confounders(f, "u__sessions__sum_90d", {}) and "u__spend__sum_90d" in causal.confounders(f, "u__sessions__sum_90d", {})
    assert causal.confounders(f, "u__sessions__sum_90d", {"exclude": ["b__*", "r__*"]}) == ["u__spend__sum_90d"]
    assert causal.confounders(f, "u__sessions__sum_90d", {"mode": "explicit", "explicit": ["u__spend__sum_90d", "nope"]}) == ["u__spend__sum_90d"]


def test_model_on_a_clear_signal(spark):
    rows = [(f"e{i}", D(2023, 1 + i % 3, 1), int(i % 7 < 2), float(i % 7) if i % 11 else None, ("x", "y", None)[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "entity_id string, snapshot_date date, label int, signal double, kind string")
    meta = {"signal": Meta("signal", "g", "entity", "numeric", "static", None, "normal", "", True), "kind": Meta("kind", "g", "entity", "categorical", "static", None, "normal", "", True)}
    options = {"max_iter": 4, "learning_rate": 0.3, "max_leaf_nodes": 7, "calibrate": True}
    fitted = modeling.fit(df.filter("snapshot_date < '2023-03-01'"), df.filter("snapshot_date = '2023-03-01'"), meta, options, 2, 1)
    assert fitted.metrics["auc"] > 0.9 and 0 <= fitted.scored.agg(F.min("score")).first()[0] and len(fitted.cv) == 2
    weights = drivers.permutation(fitted.model, df, meta, 1, 3)
    assert weights["signal"] > 0.2 > weights["kind"]


def plain_shapley(trees, x, owner, features, rows):
    """By all subsets of features: the expected margin when only those of the subset are known, the others passing as the sample does."""
    from itertools import combinations

    def expected(tree, row, known):
        total = 0.0
        for leaf in tree:
            chance, reached = 1.0, np.ones(len(x), bool)
            for column, test in leaf.path:
                ok = test(x[:, column])
                share = (reached & ok).sum() / reached.sum() if reached.sum() else 0.5
                reached = reached & ok
                chance *= float(ok[row]) if owner[column] in known else share
            total += chance * leaf.value
        return total

    out = np.zeros((rows, features))
    for row in range(rows):
        for one in range(features):
            rest = [f for f in range(features) if f != one]
            for size in range(features):
                for known in combinations(rest, size):
                    w = math.factorial(size) * math.factorial(features - 1 - size) / math.factorial(features)
                    out[row, one] += w * sum(expected(t, row, {*known, one}) - expected(t, row, set(known)) for t in trees)
    return out


def test_shapley_values(spark):
    r = np.random.default_rng(4)
    rows = [(f"e{i}", D(2023, 1, 1), int(a + 0.5 * b * a > 0.4), float(a) if i % 9 else None, float(b), "xyz"[i % 3], 1.0) for i, (a, b) in enumerate(r.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "entity_id string, snapshot_date date, label int, a double, b double, kind string, flat double").cache()
    meta = {n: Meta(n, "g", "entity", "categorical" if n == "kind" else "numeric", "static", None, "normal", "", True) for n in ("kind", "a", "flat", "b")}
    model = modeling.fit_tree(df, meta, {"max_iter": 3, "learning_rate": 0.4, "max_leaf_nodes": 15, "class_weight": None}, 1)
    trees = shap.leaves(model.stages[-1].toDebugString)
    assert [len(t) for t in trees] == [(t.numNodes + 1) // 2 for t in model.stages[-1].trees] and len(trees) >= 2
    numeric, categorical = modeling.split_names(meta)
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    ready = PipelineModel(model.stages[:-1]).transform(modeling.tree_inputs(df, numeric, categorical)).select(vector_to_array("inputs").alias("x"), "entity_id")
    x = np.array([q["x"] for q in ready.orderBy("entity_id").collect()])
    owner = np.array([["kind", "a", "flat", "b"].index(n) for n in (*numeric, *numeric, *categorical)])
    got = shap.values(trees, x, owner, 4)
    assert np.allclose(got[:25], plain_shapley(trees, x, owner, 4, 25), atol=1e-9)
    # They add up to a row's margin less the mean one.
    margin = np.array([sum(leaf.value * all(t(x[i : i + 1, c])[0] for c, t in leaf.path) for tree in trees for leaf in tree) for i in range(len(x))])
    assert np.allclose(got.sum(axis=1), margin - margin.mean(), atol=1e-9)
    found = shap.importance(model, df, meta)
    assert found["a"] > found["b"] > found["flat"] == 0.0 and list(found) == list(meta)
    assert drivers.importances("auto", model, df, meta, 1, 42)[0] == found and "shuffled" in drivers.importances("permutation", model, df, meta, 1, 3)[1]
    assert set(shap.importance(model, df.limit(0), meta).values()) == {0.0}


def test_shuffle_keeps_the_values(spark):
    df = spark.range(100).selectExpr("id as entity_id", "date'2023-01-01' as snapshot_date", "id as v")
    out = [r["v"] for r in drivers.shuffled(df, "v", 1).orderBy("entity_id").collect()]
    assert sorted(out) == list(range(100)) and out != list(range(100))


def test_smd(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (0, 0.0), (0, 2.0)], "treated int, x double")
    assert metrics.smd(df, ["x"], "treated").first()["smd"] == pytest.approx(2 / math.sqrt(1))


def test_balance_takes_the_whole_crosstab(spark):
    from tidemark.operators import experiment

    rows = spark.range(120_000).selectExpr("if(id % 2 = 0, 'a', 'b') as variant", "cast(id div 2 as string) as place")
    found = experiment.balance(rows, ["place"])[0]
    assert abs(found["statistic"]) < 1e-6 and found["passed"]
    cells = experiment.contingency(rows.filter("place % 7 < 3 or variant = 'a'").selectExpr("variant", "cast(place % 7 as string) as place"), "place").collect()
    got = experiment.independence(rows.filter("place % 7 < 3 or variant = 'a'").selectExpr("variant", "cast(place % 7 as string) as place"), "place")
    want = experiment.chi_square(cells)
    assert got[1] == want[1] and abs(got[0] - want[0]) < 1e-6 * want[0]


def test_adjustment_keeps_every_level(spark):
    import numpy as np

    from tidemark.operators import experiment

    r = np.random.default_rng(3)
    n = 1500
    place, shop, size = r.integers(0, 60, n), r.integers(0, 25, n), r.normal(size=n)
    treated = r.random(n) < 0.2 + 0.6 * (place / 60)
    churned = (r.random(n) < 0.1 + 0.1 * treated + 0.5 * (place / 60) + 0.2 * (shop / 25)).astype(int)
    rows = spark.createDataFrame([("a" if t else "control", None if p == 0 else f"p{p}", f"s{s}", float(z), int(y)) for t, p, s, z, y in zip(treated, place, shop, size, churned, strict=True)], "variant string, place string, shop string, size double, churned int")
    x = np.column_stack([treated, size, place[:, None] == np.arange(60), shop[:, None] == np.arange(25)]).astype(float)
    assert abs(experiment.adjusted(rows, "a", "control", ["place", "shop", "size"]) - np.linalg.lstsq(x, churned, rcond=None)[0][0]) < 1e-9
