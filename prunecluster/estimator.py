"""Spark ML estimator and model around the sampled k-means."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasDistanceMeasure, HasFeaturesCol, HasMaxIter, HasPredictionCol, HasSeed, HasTol, HasWeightCol,
)
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.centers import Centers
from .functions.distance import nearest_finder
from .functions.sparse import SPARSE, is_sparse
from .operators import prep
from .operators.cost import risk
from .operators.nearest import predict
from .plans.blackbox import INNER_MAX_ITER, spark_kmeans
from .plans.sampled_kmeans import check_parameters, sampled_kmeans

# The mark of a dense vector in its stored form.
DENSE_VECTOR = 1


class _Common(HasFeaturesCol, HasPredictionCol, HasDistanceMeasure):
    """Parameters that estimator and model share."""

    def _coordinates(self, schema: T.StructType):
        name = self.getFeaturesCol()
        if name not in schema.names:
            raise ValueError(f"column {name!r} is missing")
        kind = schema[name].dataType
        if isinstance(kind, VectorUDT):
            # the numbers of a dense vector are an array already
            stored = F.unwrap_udt(F.col(f"`{name}`"))
            return F.when(stored["type"] == DENSE_VECTOR, stored["values"]).otherwise(vector_to_array(F.col(f"`{name}`")))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            return F.col(f"`{name}`").cast("array<double>")
        if kind.simpleString() == SPARSE:
            return F.col(f"`{name}`")
        raise ValueError(f"column {name!r} must hold vectors or arrays of numbers, found {kind.simpleString()}")

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        """The schema after scoring: the input and an integer prediction."""
        self._coordinates(schema)
        if self.getPredictionCol() in schema.names:
            raise ValueError(f"column {self.getPredictionCol()!r} exists already")
        return T.StructType([*schema.fields, T.StructField(self.getPredictionCol(), T.IntegerType(), False)])


class PrunedKMeans(
    Estimator, _Common, HasMaxIter, HasTol, HasSeed, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable
):
    """k-means by sampling and pruning.

    ``epsilon`` (also accepted as ``tol``) ties the sample size to the size of the data.
    ``idCol`` names a unique key; with it the result does not depend on the partitioning.
    ``initMode`` and ``initSteps`` go to the k-means inside the rounds.
    """

    k = Param(Params._dummy(), "k", "number of clusters, at least 1", TypeConverters.toInt)
    m = Param(Params._dummy(), "m", "partitions to spread the points over, at least 1", TypeConverters.toInt)
    delta = Param(Params._dummy(), "delta", "confidence, between 0 and 1", TypeConverters.toFloat)
    initMode = Param(Params._dummy(), "initMode", "'random' or 'k-means||'", TypeConverters.toString)
    initSteps = Param(Params._dummy(), "initSteps", "steps of the k-means|| start", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "unique key column", TypeConverters.toString)
    blackbox = Param(Params._dummy(), "blackbox", "'kmeans' or 'kmeans_parallel'", TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, k=2, m=None, epsilon=None, tol=None, delta=None, featuresCol=None, predictionCol=None,
        weightCol=None, idCol=None, maxIter=None, seed=None, distanceMeasure=None, initMode=None, initSteps=None,
        blackbox=None,
    ):
        super().__init__()
        self._setDefault(
            k=2, delta=0.1, tol=0.05, maxIter=20, seed=1, initMode="k-means||", initSteps=2,
            distanceMeasure="euclidean", featuresCol="features", predictionCol="prediction", blackbox="kmeans",
        )
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, **_):
        given = {name: value for name, value in self._input_kwargs.items() if value is not None}
        if "epsilon" in given:
            given["tol"] = given.pop("epsilon")
        self._set(**given)
        self._check()
        return self

    def setK(self, value):
        return self.setParams(k=value)

    def setM(self, value):
        return self.setParams(m=value)

    def setEpsilon(self, value):
        return self.setParams(epsilon=value)

    def setTol(self, value):
        return self.setParams(epsilon=value)

    def setDelta(self, value):
        return self.setParams(delta=value)

    def setFeaturesCol(self, value):
        return self.setParams(featuresCol=value)

    def setPredictionCol(self, value):
        return self.setParams(predictionCol=value)

    def setWeightCol(self, value):
        return self.setParams(weightCol=value)

    def setIdCol(self, value):
        return self.setParams(idCol=value)

    def setMaxIter(self, value):
        return self.setParams(maxIter=value)

    def setSeed(self, value):
        return self.setParams(seed=value)

    def setDistanceMeasure(self, value):
        return self.setParams(distanceMeasure=value)

    def setInitMode(self, value):
        return self.setParams(initMode=value)

    def setInitSteps(self, value):
        return self.setParams(initSteps=value)

    def getK(self):
        return self.getOrDefault(self.k)

    def getM(self):
        return self.getOrDefault(self.m) if self.isDefined(self.m) else None

    def getEpsilon(self):
        return self.getOrDefault(self.tol)

    def getDelta(self):
        return self.getOrDefault(self.delta)

    def _check(self) -> None:
        check_parameters(self.getK(), self.getEpsilon(), self.getDelta(), self.getMaxIter(), self.getM())
        if self.getOrDefault(self.initMode) not in ("random", "k-means||"):
            raise ValueError("initMode must be 'random' or 'k-means||'")
        if self.getOrDefault(self.initSteps) < 1:
            raise ValueError("initSteps must be at least 1")
        if self.getDistanceMeasure() not in ("euclidean", "cosine"):
            raise ValueError("distanceMeasure must be 'euclidean' or 'cosine'")

    def _points(self, dataset: DataFrame) -> DataFrame:
        columns = [self._coordinates(dataset.schema).alias("x")]
        if self.isDefined(self.idCol):
            columns.insert(0, F.col(f"`{self.getOrDefault(self.idCol)}`").alias("point_id"))
        if self.isDefined(self.weightCol) and self.getWeightCol():
            columns.append(prep.checked_weight(F.col(f"`{self.getWeightCol()}`")).alias("w"))
        return dataset.select(columns)

    def _fit(self, dataset: DataFrame) -> "PrunedKMeansModel":
        self._check()
        self.transformSchema(dataset.schema)
        measure = self.getDistanceMeasure()
        points = self._points(dataset)
        if measure == "cosine":
            # The threshold is derived for squared Euclidean distance; on unit vectors that is
            # twice the cosine distance.
            values = F.col("x.values") if is_sparse(points) else F.col("x")
            length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v))
            unit = F.transform(values, lambda v: v / length)
            points = points.withColumn("x", F.col("x").withField("values", unit) if is_sparse(points) else unit)
        box = spark_kmeans(
            INNER_MAX_ITER, init_mode=self.getOrDefault(self.initMode),
            init_steps=self.getOrDefault(self.initSteps), measure="euclidean",
        )
        choice = self.getOrDefault(self.blackbox)
        result = sampled_kmeans(
            points, self.getK(), self.getEpsilon(), self.getDelta(), m=self.getM(),
            blackbox=box if choice == "kmeans" else choice, reducer=box,
            max_iter=self.getMaxIter(), seed=self.getSeed(), final_risk=measure == "euclidean",
        )
        cost = result.risk_final if measure == "euclidean" else risk(points, result.centers, measure)
        model = PrunedKMeansModel(result.centers.matrix, cost, result.iterations)
        self._copyValues(model)
        model._setDefault(featuresCol="features", predictionCol="prediction", distanceMeasure="euclidean")
        model._summary = PrunedKMeansSummary(model, model.transform(dataset), result.candidate_count)
        return model


class PrunedKMeansSummary:
    """What the fit found, on the table it was fitted to."""

    def __init__(self, model: "PrunedKMeansModel", predictions: DataFrame, candidate_count: int):
        self.predictions = predictions
        self.predictionCol = model.getPredictionCol()
        self.featuresCol = model.getFeaturesCol()
        self.k = len(model.clusterCenters())
        self.numIter = model.numIter
        self.trainingCost = model.trainingCost
        self.candidateCount = candidate_count

    @property
    def cluster(self) -> DataFrame:
        return self.predictions.select(self.predictionCol)

    @property
    def clusterSizes(self) -> list[int]:
        """Rows per cluster, in the order of the centres."""
        counts = {r[0]: r[1] for r in self.predictions.groupBy(self.predictionCol).count().collect()}
        return [counts.get(i, 0) for i in range(self.k)]


class PrunedKMeansModel(Model, _Common, MLReadable, MLWritable):
    """Fitted centres; scores a table by the nearest of them."""

    def __init__(self, matrix=None, trainingCost: float = 0.0, numIter: int = 0):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction", distanceMeasure="euclidean")
        self._matrix = np.zeros((0, 0)) if matrix is None else np.asarray(matrix, dtype=float)
        self.trainingCost = trainingCost
        self.numIter = numIter
        self._summary = None

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self._matrix)

    @property
    def hasSummary(self) -> bool:
        return self._summary is not None

    @property
    def summary(self) -> PrunedKMeansSummary:
        if self._summary is None:
            raise RuntimeError("a model that was loaded has no summary")
        return self._summary

    def predict(self, value: DenseVector) -> int:
        point = np.asarray(value, dtype=float).reshape(1, -1)
        return int(nearest_finder(self._matrix, self.getDistanceMeasure())(point)[1][0])

    def copy(self, extra=None):
        other = super().copy(extra)
        other._matrix = self._matrix
        return other

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.transformSchema(dataset.schema)
        coordinates = dataset.select("*", self._coordinates(dataset.schema).alias("x__points"))
        scored = predict(
            coordinates, Centers(self._matrix), self.getPredictionCol(), self.getDistanceMeasure(), x="x__points"
        )
        return scored.drop("x__points")

    def write(self) -> "MLWriter":
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> "MLReader":
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, model: PrunedKMeansModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        extra = {"trainingCost": self.model.trainingCost, "numIter": self.model.numIter}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extra)
        Centers(self.model._matrix).to_df(self.sparkSession).coalesce(1).write.parquet(f"{path}/data")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> PrunedKMeansModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/data").collect()
        model = self.cls(Centers.from_rows(rows).matrix, metadata["trainingCost"], metadata["numIter"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
