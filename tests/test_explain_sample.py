"""Attribution roll-up / top-k, linear attributions, exact seeded samples."""

import pytest
from pyspark.sql import functions as F

from tallyho.operators import explain, select


def test_rollup_and_topk_ties_stable(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0, 0.5, 0.5, -2.0, 0.0, 0.0, 0.0])], "id int, c array<double>")
    x = explain.rollup_attributions(df, "c", [0, 0, 1, 1, 2, 3, 3, 3], ["a", "b", "c", "d"])
    x = explain.top_factors(x, k=3)
    got = [(f.feature, f.impact, f.direction) for f in x.first().top_factors]
    # means: a=0, b=0.5, c=-2, d=0 -> |c| > |b| > tie(a, d) -> a (earlier base)
    assert got == [("c", -2.0, "negative"), ("b", 0.5, "positive"), ("a", 0.0, "positive")]


def test_sample_n_exact_and_partition_invariant(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    a = {r.k for r in select.sample_n(df, 123, key="k").collect()}
    b = {r.k for r in select.sample_n(df.repartition(13), 123, key="k").collect()}
    assert len(a) == 123 and a == b
    assert select.sample_n(df, 10_000, key="k").count() == 5000


def test_linear_contributions_additive(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from tests.conftest import SF001
    from tallyho import spec
    from tallyho.operators.features import build_preprocessor
    from tallyho.operators.metrics import add_class_weight
    from tallyho.operators.models import linear_contributions, logistic
    from tallyho.plans.catalog import labelled
    lab = labelled(spark, SF001)
    train = add_class_weight(lab.where(F.col("split") == "train"), spec.TARGET, "balanced")
    model = Pipeline(stages=[*build_preprocessor(train), logistic(train.count())]).fit(train)
    clf = model.stages[-1]
    test = lab.where(F.col("split") == "test")
    c = linear_contributions(model, test, train)
    out = model.transform(test).select("row_ix", vector_to_array("rawPrediction")[1].alias("margin")) \
        .join(c.select("row_ix", F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b).alias("s")), "row_ix")
    enc = model.transform(train).select(vector_to_array("features").alias("f"))
    means = enc.select(*[F.avg(F.col("f")[i]) for i in range(len(clf.coefficients))]).first()
    base = clf.intercept + sum(w * m for w, m in zip(clf.coefficients.toArray(), means))
    for r in out.collect():
        assert r.s + base == pytest.approx(r.margin, abs=1e-6)


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_tree_path_contributions_additive(spark, kind):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    from tests.conftest import SF001
    from tallyho import spec
    from tallyho.operators.features import build_preprocessor
    from tallyho.operators.metrics import add_class_weight
    from tallyho.operators.models import forest, gbt
    from tallyho.operators.tree_explain import explain_trees, tree_contributions
    from tallyho.plans.catalog import labelled
    lab = labelled(spark, SF001)
    train = add_class_weight(lab.where(F.col("split") == "train"), spec.TARGET, "balanced")
    est = gbt(5, 3) if kind == "gbt" else forest(num_trees=5, max_depth=4)
    model = Pipeline(stages=[*build_preprocessor(train), est]).fit(train)
    test = lab.where(F.col("split") != "train")
    c = tree_contributions(model, test, ["row_ix"])
    out_col = vector_to_array("rawPrediction")[1] if kind == "gbt" else vector_to_array("probability")[1]
    truth = model.transform(test).select("row_ix", out_col.alias("y"))
    j = truth.join(c.select("row_ix", "bias", F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
                            .alias("s")), "row_ix").collect()
    assert len(j) == test.count()
    for r in j:
        assert r.bias + r.s == pytest.approx(r.y, abs=1e-9)
    tf = explain_trees(model, test, ["row_ix"]).first().top_factors
    assert 1 <= len(tf) <= 3
