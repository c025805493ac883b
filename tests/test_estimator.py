import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from brute_force import all_d2
from prunecluster import PrunedKMeans, PrunedKMeansModel


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    middle = np.array([[0, 0], [20, 0], [0, 20]])
    matrix = middle[np.arange(3000) % 3] + rng.normal(size=(3000, 2))
    rows = [(i, Vectors.dense(x), float(i % 2)) for i, x in enumerate(matrix)]
    return spark.createDataFrame(rows, ["id", "features", "half"]).repartition(4).persist()


def test_fit_and_transform(vectors):
    model = PrunedKMeans(k=3, epsilon=0.05, seed=4, idCol="id").fit(vectors)
    centers = np.array(model.clusterCenters())
    assert sorted(map(tuple, centers.round(-1).tolist())) == [(0.0, 0.0), (0.0, 20.0), (20.0, 0.0)]
    summary = model.summary
    assert sum(summary.clusterSizes) == 3000 and sorted(summary.clusterSizes) == [1000, 1000, 1000]
    assert summary.k == 3 and summary.numIter >= 1 and model.hasSummary
    scored = model.transform(vectors)
    assert scored.columns == ["id", "features", "half", "prediction"]
    rows = scored.collect()
    d2 = all_d2([r.features.toArray() for r in rows], centers)
    assert [r.prediction for r in rows] == d2.argmin(axis=1).tolist()
    assert summary.trainingCost == pytest.approx(d2.min(axis=1).sum())
    assert model.predict(Vectors.dense([19.0, 1.0])) == int(all_d2([[19.0, 1.0]], centers).argmin())


def test_round_trips(vectors, tmp_path):
    estimator = PrunedKMeans(k=3, tol=0.1, delta=0.2, maxIter=3, seed=9, initMode="random")
    estimator.write().overwrite().save(str(tmp_path / "e"))
    loaded = PrunedKMeans.load(str(tmp_path / "e"))
    assert loaded.getK() == 3 and loaded.getEpsilon() == 0.1 and loaded.getDelta() == 0.2
    assert loaded.getSeed() == 9 and loaded.getMaxIter() == 3 and loaded.uid == estimator.uid
    model = loaded.setPredictionCol("label").fit(vectors)
    model.save(str(tmp_path / "m"))
    again = PrunedKMeansModel.load(str(tmp_path / "m"))
    assert np.array_equal(model.clusterCenters(), again.clusterCenters())
    assert again.trainingCost == model.trainingCost and again.numIter == model.numIter
    assert again.getPredictionCol() == "label" and not again.hasSummary
    with pytest.raises(RuntimeError):
        again.summary
    assert again.transform(vectors).select("label").exceptAll(model.transform(vectors).select("label")).isEmpty()


def test_in_a_pipeline(vectors, tmp_path):
    pipeline = Pipeline(stages=[PrunedKMeans(k=3, seed=2)]).fit(vectors)
    pipeline.save(str(tmp_path / "p"))
    assert PipelineModel.load(str(tmp_path / "p")).transform(vectors).where("prediction is null").isEmpty()


def test_array_columns_and_weights(vectors):
    arrays = vectors.withColumn("features", F.col("features").cast("string")).drop("features").join(
        vectors.select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("features")), "id"
    )
    model = PrunedKMeans(k=2, weightCol="half", seed=1).fit(arrays)
    assert len(model.clusterCenters()) == 2
    # rows of weight 0 count for nothing
    only = PrunedKMeans(k=1, weightCol="half").fit(arrays.where("id < 100")).clusterCenters()[0]
    assert only[1] == pytest.approx(np.arange(1, 100, 2).mean())


def test_negative_weight_fails(vectors):
    with pytest.raises(Exception, match="negative weight"):
        PrunedKMeans(k=2, weightCol="w").fit(vectors.withColumn("w", F.lit(-1.0)))


def test_cosine(spark):
    rows = [(i, [np.cos(a) * s, np.sin(a) * s]) for i, (a, s) in enumerate(
        [(0.1 + 0.01 * j, 1.0 + j) for j in range(20)] + [(1.4 + 0.005 * j, 50.0 + j) for j in range(20)]
    )]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "id int, x array<double>")
    df = df.select("id", array_to_vector("x").alias("features"))
    labels = [r.prediction for r in PrunedKMeans(k=2, distanceMeasure="cosine", seed=3).fit(df).transform(df).orderBy("id").collect()]
    assert len(set(labels[:20])) == 1 and len(set(labels[20:])) == 1 and labels[0] != labels[20]


@pytest.mark.parametrize("wrong", [
    dict(k=0), dict(m=0), dict(maxIter=-1), dict(epsilon=0.0), dict(epsilon=1.5), dict(delta=0.0), dict(initSteps=0),
    dict(initMode="grid"), dict(distanceMeasure="manhattan"),
])
def test_parameters_are_checked(wrong):
    with pytest.raises(ValueError):
        PrunedKMeans(**wrong)


def test_schema_is_checked(vectors):
    estimator = PrunedKMeans(k=2)
    assert estimator.transformSchema(vectors.schema).names[-1] == "prediction"
    for bad in (vectors.drop("features"), vectors.withColumn("features", F.lit("x")), vectors.withColumn("prediction", F.lit(1))):
        with pytest.raises(ValueError):
            estimator.fit(bad)


def test_setters():
    e = PrunedKMeans().setK(4).setM(2).setTol(0.2).setDelta(0.3).setSeed(5).setMaxIter(7).setInitSteps(3)
    e = e.setFeaturesCol("f").setPredictionCol("p").setWeightCol("w").setIdCol("i").setDistanceMeasure("cosine")
    assert (e.getK(), e.getM(), e.getEpsilon(), e.getTol(), e.getDelta(), e.getSeed()) == (4, 2, 0.2, 0.2, 0.3, 5)
    assert PrunedKMeans().getM() is None


def test_dense_vectors_are_read_as_they_are_stored(spark):
    rows = [(0, Vectors.dense([1.0, 0.0, 3.0])), (1, Vectors.sparse(3, [2], [5.0])), (2, Vectors.dense([]))]
    df = spark.createDataFrame(rows, ["id", "features"])
    found = df.select("id", PrunedKMeans(k=2)._coordinates(df.schema).alias("x"))
    assert {r.id: r.x for r in found.collect()} == {0: [1.0, 0.0, 3.0], 1: [0.0, 0.0, 5.0], 2: []}
    # no function reads a dense vector
    assert "CASE WHEN" in found._jdf.queryExecution().optimizedPlan().toString()
    nothing = df.select(F.when(F.col("id") > 5, F.col("features")).alias("features"))
    with pytest.raises(Exception, match="vector_to_array|null"):
        nothing.select(PrunedKMeans(k=2)._coordinates(nothing.schema)).collect()
