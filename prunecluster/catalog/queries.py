"""One query per operator, over the whole of the given tables.

Draws use md5 here so that another engine can repeat them, and where a black box is needed it
is the rule "the rows lowest by hash": then a whole run has one right answer.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..estimator import PrunedKMeans, PrunedKMeansModel, PrunedKMeansSummary
from ..functions import formulas
from ..functions.centers import Centers
from ..functions.distance import squared_distance
from ..functions.formulas import COLUMNS
from ..functions.hashing import md5_uniform
from ..functions.sparse import SparseCenters
from ..operators import cost, nearest, prep, rounds, sampling
from ..plans import evaluate
from ..plans.blackbox import reduce_centers, spark_kmeans
from ..plans.kmeans_parallel import draw_step, kmeans_parallel
from ..plans.sample_prune import draw_round, nearer_sample, pivot_distance, sample_prune
from ..plans.sampled_kmeans import sampled_kmeans
from ..sources import gaussians, points as sources, sinks
from ..storage import RunTables

K, EPSILON, DELTA, SEED = 5, 0.05, 0.1, 7
PRUNE_EPSILON = 0.1
V = 100.0
DIMS = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lattice(spark: SparkSession, folder: str, weight: str | None = None) -> DataFrame:
    """Every line item as a point with integer coordinates, so that sums are exact."""
    needed = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    items = prep.spread(table(spark, folder, "lineitem").select(needed))
    key = [
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
        prep.rounded(F.col("l_extendedprice") * 100).cast("bigint"),
    ]
    x = F.array(
        F.col("l_quantity"), prep.rounded(F.col("l_extendedprice") / 1000),
        prep.rounded(F.col("l_discount") * 100), prep.rounded(F.col("l_tax") * 100),
    )
    return prep.point_table(items, key, x, None if weight is None else F.col(weight))


def lowest_by_hash(points: DataFrame, k: int, seed: int = SEED, salt: str = "c") -> Centers:
    """The k rows lowest by hash, in that order."""
    rows = sampling.random_rows(points, k, SEED, salt, "md5").select("x").collect()
    return Centers([r.x for r in rows])


def fixed_box(points: DataFrame, k: int, seed: int) -> Centers:
    return lowest_by_hash(points, k)


def coordinates(x="x", prefix="x", dims: int = DIMS, digits: int | None = None):
    values = [F.col(x)[j] for j in range(dims)]
    return [(v if digits is None else F.round(v, digits)).alias(f"{prefix}{j}") for j, v in enumerate(values)]


def whole(column, name: str):
    """A sum of integers, as integer."""
    return F.round(column).cast("bigint").alias(name)


def one_row(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([tuple(values)], schema)


def fixed_run(spark, folder, max_iter=20, **options):
    return sampled_kmeans(
        lattice(spark, folder), K, EPSILON, DELTA, blackbox=fixed_box, reducer=fixed_box, seed=SEED, uniform="md5",
        max_iter=max_iter, **options,
    )


# --- sources and sinks -------------------------------------------------------------------------


def csv_points(spark, folder):
    path = f"{RunTables(spark).root}/csv"
    table(spark, folder, "part").write.option("header", True).csv(path)
    read = sources.read_csv_points(spark, path, preparation=sources.Preparation(numeric_only=True, drop_nulls=True))
    return read.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_size", "p_retailprice")


def csv_limit(spark, folder):
    """The first half of the rows by key, one-hot and scaled."""
    path = f"{RunTables(spark).root}/csv"
    customers = table(spark, folder, "customer")
    customers.select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal").write.option("header", True).csv(path)
    read = sources.read_csv_points(
        spark, path, schema="c_custkey bigint, c_mktsegment string, c_nationkey int, c_acctbal double",
        limit=customers.count() // 2, order=["c_custkey"],
        preparation=sources.Preparation(one_hot=True, numeric_only=True, drop_nulls=True),
    )
    scaled = prep.min_max_scale(read, ["c_nationkey", "c_acctbal"])
    return scaled.select(*[F.round(c, 9).alias(c) if c in ("c_nationkey", "c_acctbal") else c for c in scaled.columns])


def _customer_files(spark, folder, head: list[str]) -> str:
    """Customers as three CSV files in the order of their keys, each with ``head`` before its header."""
    path = f"{RunTables(spark).root}/csv"
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    last = customers.agg(F.max("c_custkey")).first()[0]
    number = F.lpad(F.floor(3 * F.col("c_custkey") / F.lit(last + 1)).cast("string"), 2, "0")
    rows = customers.select(number.alias("number"), F.col("c_custkey").alias("place"), F.to_csv(F.struct("*")).alias("value"))
    above = [*head, ",".join(customers.columns)]
    first = F.explode(F.array(*[F.struct(F.lit(i - len(above)).alias("place"), F.lit(v).alias("value")) for i, v in enumerate(above)]))
    heads = rows.select("number").distinct().select("number", first.alias("h")).select("number", "h.place", "h.value")
    lines = rows.unionByName(heads).repartition("number").sortWithinPartitions("number", "place")
    lines.select("number", "value").write.partitionBy("number").text(path)
    return path


def csv_skip_line(spark, folder):
    """Files whose second line is the header; names and types are found in them, the numeric columns kept."""
    path = _customer_files(spark, folder, ["customers, as of today; \"all\" of them"])
    read = sources.read_csv_points(spark, path, skip_lines=1)
    return read.select(*[F.col(c).cast("bigint").alias(c) if c != "c_acctbal" else c for c in read.columns])


def csv_first_rows(spark, folder):
    """The first half of the rows as they stand in the files, by the name of the dataset."""
    count = table(spark, folder, "customer").count() // 2
    datasets = sources.Datasets(spark)
    path = _customer_files(spark, folder, ["", "one", "two"])
    read = datasets.get(path, skip_lines=2, limit=count, preparation=sources.Preparation(numeric_only=False, drop_nulls=False))
    return read.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment")


def libsvm_points(spark, folder):
    """Parts written as libsvm and read back."""
    path = f"{RunTables(spark).root}/libsvm"
    features = array_to_vector(prep.assemble_vector(["p_size", "p_retailprice"]))
    parts = table(spark, folder, "part").select(F.col("p_partkey").cast("double").alias("label"), features.alias("features"))
    parts.write.format("libsvm").save(path)
    read = sources.read_libsvm_points(spark, path, dims=2)
    return read.select(F.col("label").cast("bigint").alias("p_partkey"), *coordinates(dims=2))


def preset_points(spark, folder):
    orders = table(spark, folder, "orders")
    return sources.preset("census1990").apply(orders.withColumn("o_orderdate", F.unix_date(F.to_date("o_orderdate"))))


def gaussian_sizes(spark, folder):
    k = 25
    segments = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    ranked = segments.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("cluster"))
    size = gaussians.cluster_size(F.col("n"), F.col("cluster"), F.lit(gaussians.size_total(k)), on=COLUMNS)
    return ranked.select("l_returnflag", "l_linestatus", "cluster", size.alias("size"))


def gaussian_points(spark, folder):
    orders = table(spark, folder, "orders")
    k, n = table(spark, folder, "nation").count(), orders.count()
    made = gaussians.place(
        orders, F.col("o_orderkey"), gaussians.cluster_sizes(n, k), gaussians.mixture_centers(k, DIMS, SEED),
        gaussians.STD_DEV, SEED,
    )
    return made.select("point_id", "cluster", *coordinates(digits=6))


def run_results(spark, folder):
    run = fixed_run(spark, folder)
    row = evaluate.metrics_row(run, 0, DELTA, 1, EPSILON)
    metrics = spark.createDataFrame([row], evaluate.METRICS_SCHEMA)
    with RunTables(spark) as tables:
        sinks.write_csv(sinks.run_rows(metrics), f"{tables.root}/results")
        read = spark.read.option("header", True).csv(f"{tables.root}/results")
        read = spark.createDataFrame(read.collect(), read.schema)  # the row of one run
    return read.select(
        "test_name", F.col("k").cast("int").alias("k"), F.col("dt").cast("double").alias("dt"),
        F.col("m").cast("int").alias("m"), F.col("ep").cast("double").alias("ep"), F.col("l").cast("int").alias("l"),
        F.col("`len(C)`").cast("int").alias("num_centers"), F.col("iterations").cast("int").alias("iterations"),
        whole(F.col("risk").cast("double"), "risk"), whole(F.col("risk_final").cast("double"), "risk_final"),
    )


def _summary(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """The summary without times and without what depends on the layout of the table."""
    found = sinks.summarize(metrics).drop("comps_pm_avg", "comps_pm_stdv", *[c for c in sinks.SUMMARY_COLUMNS if "time" in c])
    keys = ["dataset", "steps", "algorithm", "k", "epsilon"]
    return found.select(*keys, *[F.round(c, digits).alias(c) for c in found.columns if c not in keys])


def run_summary(spark, folder):
    """Two runs of one round each, with seeds that follow each other."""
    metrics = evaluate.repeat_runs(
        lattice(spark, folder), "sampled_kmeans", K, EPSILON, rounds=2, seed=SEED, delta=DELTA, dataset="lineitem",
        blackbox=fixed_box, reducer=fixed_box, uniform="md5", max_iter=1,
    )
    return _summary(metrics).na.fill(0, ["steps"])


def shared_summary(spark, folder):
    """The same two runs, weighed and costed in shared scans."""
    metrics = evaluate.repeat_shared(
        lattice(spark, folder), K, EPSILON, rounds=2, seed=SEED, delta=DELTA, dataset="lineitem",
        blackbox=fixed_box, reducer=fixed_box, uniform="md5", max_iter=1,
    )
    return _summary(metrics).na.fill(0, ["steps"])


def order_points(spark, folder) -> DataFrame:
    """Orders as points with integer coordinates."""
    orders = prep.spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    x = F.array(prep.rounded(F.col("o_totalprice") / 10000), *[F.pmod("o_custkey", F.lit(m)).cast("double") for m in (7, 11, 13)])
    return prep.point_table(orders, [F.col("o_orderkey").cast("string")], x)


SWEPT = ("dataset", "steps", "algorithm", "k", "epsilon", "num_centers_avg", "final_risk_avg", "comps_tot_avg")


def _sweep(spark, folder, plan, **options) -> DataFrame:
    names = spark.createDataFrame([("lineitem",), ("orders",)], "dataset string")
    grid = evaluate.sweep_plan(names).where("k = 25").withColumn("k", F.lit(K))
    load = {"lineitem": lattice, "orders": order_points}
    return evaluate.run_sweep(
        spark, lambda name: load[name](spark, folder), names, rounds=1, seed=SEED, delta=DELTA, plan=plan(grid), uniform="md5",
        reducer=fixed_box, by_algorithm={"sampled_kmeans": {"blackbox": fixed_box, "max_iter": None}},
        **options,
    )


def sweep_summary(spark, folder):
    """A sweep of three algorithms over two tables, by epsilon and by steps; each run goes on until few enough rows are left."""
    metrics = _sweep(spark, folder, lambda grid: grid.where("epsilon >= 0.1 OR steps <= 2"))
    return _summary(metrics).select(*SWEPT).na.fill(0, ["steps"])


def sweep_restart(spark, folder):
    """A sweep that stopped half way and is started again: every run is there, and once."""
    path = f"{RunTables(spark).root}/sweep"
    _sweep(spark, folder, lambda grid: grid.where("steps <= 2 AND dataset = 'orders'"), results=path)
    metrics = _sweep(spark, folder, lambda grid: grid.where("steps <= 2"), results=path)
    runs = metrics.groupBy("dataset", "steps").agg(F.count("*").alias("runs"))
    return _summary(metrics).select(*SWEPT).join(runs, ["dataset", "steps"])


# --- preparation -------------------------------------------------------------------------------


def numeric_projection(spark, folder):
    return prep.numeric_projection(table(spark, folder, "orders"))


def _with_nulls(spark, folder):
    items = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left").select(
        "o_orderkey", "o_orderstatus", "l_linenumber", "l_quantity"
    )


def drop_nulls(spark, folder):
    return prep.drop_nulls(_with_nulls(spark, folder))


def one_hot(spark, folder):
    return prep.one_hot(table(spark, folder, "events").select("event_id", "event_type"))


def one_hot_sparse(spark, folder):
    """A text key of the orders, as many levels as rows."""
    keyed = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"))
    return prep.one_hot_sparse(keyed, "name")


def drop_index_column(spark, folder):
    return prep.drop_first_column(table(spark, folder, "part"))


def min_max_scale(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.lit(3.0).alias("same"))
    scaled = prep.min_max_scale(customers, ["c_nationkey", "c_acctbal", "same"])
    return scaled.select("c_custkey", *[F.round(c, 9).alias(c) for c in ("c_nationkey", "c_acctbal", "same")])


def min_max_scale_nan(spark, folder):
    """Negative balances become NaN; they have no part in the range."""
    balance = F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    scaled = prep.min_max_scale(table(spark, folder, "customer").select("c_custkey", balance.alias("balance")), ["balance"])
    return scaled.select("c_custkey", F.isnan("balance").cast("int").alias("missing"), F.round(F.nanvl("balance", F.lit(-1.0)), 9).alias("balance"))


def constant_scale(spark, folder):
    vectors = table(spark, folder, "embeddings")
    half = F.floor(F.size("embedding") / 2).cast("int")
    grid = F.array(F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, F.size("embedding") - half))
    flat = vectors.select("vec_id", F.posexplode(prep.constant_scale(grid)).alias("position", "value"))
    return flat.select("vec_id", "position", F.round("value", 9).alias("value"))


def assemble_vector(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", prep.assemble_vector(["p_size", "p_retailprice"]).alias("x"))
    return parts.select("p_partkey", F.posexplode("x").alias("position", "value"))


def profile_points(spark, folder):
    raw = _with_nulls(spark, folder)
    numeric = prep.numeric_projection(raw)
    return prep.profile({"raw": raw, "numeric": numeric, "clean": prep.drop_nulls(numeric)})


# --- sampling ----------------------------------------------------------------------------------


def _paired(spark, folder, disjoint):
    points = lattice(spark, folder)
    n = points.count()
    alpha = formulas.sampling_rate(formulas.max_subset(n, K, EPSILON, DELTA), n)
    drawn = sampling.paired_sample(points, alpha, SEED, method="md5", disjoint=disjoint)
    return drawn.select("point_id", F.col("p1").cast("int").alias("p1"), F.col("p2").cast("int").alias("p2"))


def paired_sample(spark, folder):
    return _paired(spark, folder, False)


def paired_sample_disjoint(spark, folder):
    return _paired(spark, folder, True)


def exact_sample(spark, folder):
    """Both samples of the first round with exactly round(alpha n) rows each."""
    points = lattice(spark, folder)
    n = points.count()
    alpha = formulas.sampling_rate(formulas.max_subset(n, K, EPSILON, DELTA), n)
    drawn = sampling.exact_samples(points, {"p1": alpha, "p2": alpha}, SEED, method="md5")
    return drawn.select("point_id", F.col("p1").cast("int").alias("p1"), F.col("p2").cast("int").alias("p2"))


def exact_rounds(spark, folder):
    """Two rounds of a run whose samples have exact sizes."""
    return _rounds(spark, folder, 2, exact_sizes=True)


def ene_sample(spark, folder):
    points = lattice(spark, folder)
    n = points.count()
    rates = (
        formulas.sample_rate_s(K, n, PRUNE_EPSILON, n),
        formulas.sample_rate_h(n, PRUNE_EPSILON, n),
    )
    drawn = sampling.two_samples(points, rates, ("s", "h"), SEED, method="md5")
    return drawn.select("point_id", F.col("s").cast("int").alias("s"), F.col("h").cast("int").alias("h"))


def first_center(spark, folder):
    drawn = sampling.random_rows(lattice(spark, folder), 1, SEED, "first", "md5")
    return drawn.select("point_id", *coordinates())


def weighted_sample(spark, folder):
    points = lattice(spark, folder)
    scored = nearest.with_nearest(points, lowest_by_hash(points, K))
    drawn = sampling.weighted_draw(scored, 2 * K, SEED, "draw", "md5")
    return drawn.select("point_id", whole(F.col("d2"), "d2"))


# --- nearest centre ----------------------------------------------------------------------------


def squared_distances(spark, folder):
    points = lattice(spark, folder)
    centers = lowest_by_hash(points, K)
    return points.select(
        "point_id", *[whole(squared_distance(F.col("x"), c), f"d2_{i}") for i, c in enumerate(centers.matrix)]
    )


def nearest_distance(spark, folder):
    points = lattice(spark, folder)
    return nearest.with_nearest(points, lowest_by_hash(points, K)).select("point_id", whole(F.col("d2"), "d2"))


def assign_nearest(spark, folder):
    points = lattice(spark, folder)
    return nearest.with_nearest(points, lowest_by_hash(points, K)).select("point_id", "center_id")


def incremental_distance(spark, folder):
    points = lattice(spark, folder)
    centers = lowest_by_hash(points, K).matrix
    first = nearest.with_nearest(points, Centers(centers[:3])).drop("center_id").withColumnRenamed("d2", "known")
    both = nearest.with_nearest(first, Centers(centers[3:])).drop("center_id")
    return nearest.closer_of(both, "known", "d2").select("point_id", whole(F.col("d2"), "d2"))


def _vectors(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("x")
    )


def nearest_cosine(spark, folder):
    points = _vectors(spark, folder)
    found = nearest.with_nearest(points, lowest_by_hash(points, 10), "cosine")
    return found.select("point_id", "center_id", F.round("d2", 6).alias("distance"))


def nearest_vectors(spark, folder):
    points = _vectors(spark, folder)
    found = nearest.with_nearest(points, lowest_by_hash(points, 10))
    return found.select("point_id", "center_id", F.round("d2", 6).alias("d2"))


def sparse_items(spark, folder) -> DataFrame:
    """Line items with a coordinate for each order, part and supplier."""
    items = table(spark, folder, "lineitem")
    keys = [
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint"),
    ]
    return prep.one_hot_points(prep.spread(items), keys, ["l_orderkey", "l_partkey", "l_suppkey"], ["l_quantity"])


def sparse_centers(points: DataFrame, k: int) -> SparseCenters:
    return SparseCenters.from_rows(sampling.random_rows(points, k, SEED, "c", "md5").select("x").collect(), None, "x")


def sparse_nearest(spark, folder):
    points = sparse_items(spark, folder)
    found = nearest.with_nearest(points, sparse_centers(points, 10))
    return found.select("point_id", "center_id", whole(F.col("d2"), "d2"), F.size("x.indices").alias("entries"))


def sparse_risk(spark, folder):
    points = sparse_items(spark, folder)
    centers = sparse_centers(points, 10)
    scored = nearest.with_nearest(points, centers)
    return one_row(
        spark, "risk bigint, truncated_risk bigint, dims int", round(cost.risk(points, centers)),
        round(cost.truncated_risk(scored, 409)), centers.dims,
    )


def sparse_weights(spark, folder):
    points = sparse_items(spark, folder)
    found = cost.weight_table(points, sparse_centers(points, 10))
    return found.select("center_id", whole(F.col("weight"), "weight"), whole(F.col("cost"), "cost"))


def sparse_libsvm(spark, folder):
    """Parts written as libsvm and read back as sparse points, with their entries one by one."""
    path = f"{RunTables(spark).root}/libsvm"
    features = array_to_vector(F.array(F.col("p_size").cast("double"), F.lit(0.0), "p_retailprice"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").cast("double").alias("label"), features.alias("features"))
    parts.write.format("libsvm").save(path)
    read = sources.read_libsvm_points(spark, path, dims=3, sparse=True)
    entries = read.select(F.col("label").cast("bigint").alias("p_partkey"), F.explode(F.arrays_zip("x.indices", "x.values")).alias("e"))
    return entries.select("p_partkey", F.col("e.indices").alias("position"), F.col("e.values").alias("value")).where("value <> 0")


def sparse_clustering(spark, folder):
    """The estimator on sparse points far apart by the priority of the order: rows of each cluster."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    points = prep.one_hot_points(prep.spread(orders), [F.col("o_orderkey")], ["o_orderpriority", "o_orderstatus"])
    # the levels of the priority come first and weigh much more than those of the status
    scaled = F.transform(F.arrays_zip("x.indices", "x.values"), lambda e: F.when(e["indices"] < 5, e["values"] * APART).otherwise(e["values"]))
    points = points.withColumn("x", F.col("x").withField("values", scaled))
    models = [PrunedKMeans(k=K, epsilon=EPSILON, seed=s, featuresCol="x", idCol="point_id").fit(points) for s in SEEDS]
    best = min(models, key=lambda m: m.summary.trainingCost)
    named = best.transform(points).select("prediction", F.col("x.indices")[0].alias("priority"))
    return named.groupBy("prediction").agg(F.count("*").alias("size"), F.min("priority").alias("low"), F.max("priority").alias("high")).drop("prediction")


def predict(spark, folder):
    points = lattice(spark, folder)
    model = PrunedKMeansModel(lowest_by_hash(points, K).matrix)
    vectors = points.select("point_id", array_to_vector("x").alias("features"))
    return model.transform(vectors).select("point_id", "prediction")


def predict_cosine(spark, folder):
    points = _vectors(spark, folder)
    model = PrunedKMeansModel(lowest_by_hash(points, 10).matrix)
    model._set(distanceMeasure="cosine")
    vectors = points.select("point_id", array_to_vector("x").alias("features"))
    return model.transform(vectors).select("point_id", "prediction")


def model_round_trip(spark, folder):
    """A model with fixed centres, saved, loaded and applied, through its summary: rows per cluster."""
    points = lattice(spark, folder)
    vectors = points.select("point_id", array_to_vector("x").alias("features"))
    with RunTables(spark) as tables:
        PrunedKMeansModel(lowest_by_hash(points, K).matrix).save(f"{tables.root}/model")
        model = PrunedKMeansModel.load(f"{tables.root}/model")
    sizes = PrunedKMeansSummary(model, model.transform(vectors), K).clusterSizes
    return spark.createDataFrame(list(enumerate(sizes)), "prediction int, size bigint")


def scored_schema(spark, folder):
    """Names and types of a scored table, with the rows that have a value."""
    points = lattice(spark, folder)
    model = PrunedKMeansModel(lowest_by_hash(points, K).matrix)
    scored = model.transform(points.select("point_id", F.col("x").alias("features")))
    assert [f.name for f in model.transformSchema(scored.drop("prediction").schema)] == scored.columns
    counts = scored.agg(*[F.count(c).alias(c) for c in scored.columns]).first()
    rows = [(i, f.name, f.dataType.simpleString(), counts[f.name]) for i, f in enumerate(scored.schema.fields)]
    return spark.createDataFrame(rows, "position int, field string, kind string, filled bigint")


def parameter_errors(spark, folder):
    """Which settings, taken from the line items, the estimator refuses."""
    items = table(spark, folder, "lineitem")
    settings = items.select((F.col("l_linenumber") - 2).cast("int").alias("k"), F.round(F.col("l_discount") * 10, 1).alias("epsilon"))
    rows = []
    for s in settings.distinct().collect():  # a few numbers of lines and discounts
        try:
            PrunedKMeans(k=s.k, epsilon=s.epsilon)
            wrong = ""
        except ValueError as error:
            wrong = str(error).split()[0]
        rows.append((s.k, s.epsilon, wrong))
    return spark.createDataFrame(rows, "k int, epsilon double, refused string")


# --- costs and order statistics ----------------------------------------------------------------


def risk(spark, folder):
    points = lattice(spark, folder)
    return one_row(spark, "risk bigint", round(cost.risk(points, lowest_by_hash(points, K))))


def _scored(spark, folder):
    points = lattice(spark, folder)
    return nearest.with_nearest(points, lowest_by_hash(points, K))


def truncated_risk(spark, folder):
    return one_row(spark, "truncated_risk bigint", round(cost.truncated_risk(_scored(spark, folder), 409)))


def truncated_risk_half(spark, folder):
    """Half of all rows left out, with weights and without."""
    scored = nearest.with_nearest(lattice(spark, folder, weight="l_quantity"), lowest_by_hash(lattice(spark, folder), K))
    half = scored.count() // 2
    plain, weighted = (cost.truncated_risk(df, half) for df in (scored.drop("w"), scored))
    return one_row(spark, "r bigint, truncated_risk bigint, weighted bigint", half, round(plain), round(weighted))


def truncated_risk_trivial(spark, folder):
    scored = _scored(spark, folder)
    n = scored.count()
    # a sample too small for the rows to leave out: that of the inner rounds of a large k
    r = formulas.outlier_rows(1.0, n, formulas.phi_alpha(1.0, n, DELTA, EPSILON))
    return one_row(spark, "r bigint, truncated_risk bigint", r, round(cost.truncated_risk(scored, r)))


def center_weights(spark, folder):
    points = lattice(spark, folder)
    found = cost.weight_table(points, lowest_by_hash(points, 20))
    return found.select("center_id", whole(F.col("weight"), "weight"), whole(F.col("cost"), "cost"))


SMALL_BYTES = 200  # a few centres


def weights_in_blocks(spark, folder):
    points = lattice(spark, folder)
    weighted, _ = cost.center_weights(points, lowest_by_hash(points, 20), max_bytes=SMALL_BYTES)
    return weighted.to_df(spark).select("center_id", whole(F.col("weight"), "weight"))


def costs_in_blocks(spark, folder):
    points = lattice(spark, folder)
    sets = {str(k): lowest_by_hash(points, k) for k in (5, 10, 20)}
    found = cost.costs(points, sets, max_bytes=SMALL_BYTES)
    return spark.createDataFrame([(int(k), round(v)) for k, v in found.items()], "k int, cost bigint")


def weighted_costs(spark, folder):
    """Instance weights in centre weights, cost and truncated cost."""
    points = lattice(spark, folder, weight="l_quantity")
    scored = nearest.with_nearest(points, lowest_by_hash(points, K))
    totals = scored.agg(F.sum("w").alias("w"), F.sum(F.col("d2") * F.col("w")).alias("risk")).first()
    return one_row(
        spark, "weight bigint, risk bigint, truncated_risk bigint",
        round(totals.w), round(totals.risk), round(cost.truncated_risk(scored, 409)),
    )


def _pruned(spark, folder):
    scored = _scored(spark, folder)
    with RunTables(spark) as tables:
        return rounds.prune(scored, V, tables, "survivors", ["point_id"])


def survivors(spark, folder):
    return rounds.beyond(_scored(spark, folder), V).select("point_id", whole(F.col("d2"), "d2"))


def handled_risk(spark, folder):
    found = _pruned(spark, folder)
    return one_row(spark, "handled bigint, handled_risk bigint", found.handled, round(found.handled_risk))


def remaining_count(spark, folder):
    found = _pruned(spark, folder)
    return one_row(spark, "remaining bigint", found.remaining)


def _tail(spark, folder, epsilon):
    points = lattice(spark, folder)
    n = points.count()
    rate = formulas.sample_rate_h(n, epsilon, n)
    pivots = points.where(md5_uniform(F.col("point_id"), SEED, "h") < rate)
    scored = nearest.with_nearest(pivots, lowest_by_hash(points, K))
    found, long_enough = cost.tail_distance(scored, formulas.tail_rank(n))
    return one_row(spark, "d2 bigint, long_enough boolean", round(found), long_enough).select(
        "d2", F.col("long_enough").cast("int").alias("long_enough")
    )


def tail_select(spark, folder):
    return _tail(spark, folder, 0.2)


def tail_select_short(spark, folder):
    return _tail(spark, folder, 0.01)


def cluster_summary(spark, folder):
    points = lattice(spark, folder)
    centers = lowest_by_hash(points, K)
    scored = nearest.with_nearest(points, centers)
    sizes = scored.groupBy(F.col("center_id").alias("prediction")).agg(
        F.count("*").alias("size"), whole(F.sum("d2"), "cost")
    )
    return sizes.select("prediction", "size", "cost", F.lit(len(centers)).alias("k"))


def comparison_counts(spark, folder):
    """In all, and of the machine with the most rows in each round; points are dealt to 50 machines by hash."""
    run = fixed_run(spark, folder, final_risk=False)
    steps = kmeans_parallel(
        lattice(spark, folder), K, iterations=3, m=4, reducer=fixed_box, seed=SEED, uniform="md5", final_risk=False
    )
    rows = [(r.algorithm, int(r.total_comps), int(r.comps_per_machine)) for r in (run, steps)]
    return spark.createDataFrame(rows, "algorithm string, total_comps bigint, comps_per_machine bigint")


def union_centers(spark, folder):
    points = lattice(spark, folder)
    first = lowest_by_hash(points, K).to_df(spark)
    more = lowest_by_hash(points, K, salt="c2").to_df(spark).withColumn("center_id", F.col("center_id") + K)
    return first.unionByName(more).select("center_id", *coordinates("c", "c"))


# --- formulas ----------------------------------------------------------------------------------


def _settings(spark, folder):
    """One setting per supplier: how its line items alone would be clustered."""
    items = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.max("l_linenumber").alias("k"), F.sum("l_quantity").alias("cost"),
        F.max("l_quantity").alias("known"), F.count_if(F.col("l_returnflag") != "R").alias("remaining"),
    )
    epsilon = F.element_at(F.array(*[F.lit(e) for e in evaluate.SWEEP_EPSILON]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    # where no row is left, or one alone, there is no rate: null
    return items.withColumn("remaining", F.nullif("remaining", F.lit(0))).withColumn("n", F.nullif("n", F.lit(1))).withColumn(
        "epsilon", epsilon
    )


def plan_parameters(spark, folder):
    n, k, e, d = F.col("n"), F.col("k"), F.col("epsilon"), F.lit(DELTA)
    subset = formulas.max_subset(n, k, e, d, COLUMNS)
    alpha = formulas.sampling_rate(subset, F.col("remaining"))
    phi = formulas.phi_alpha(alpha, k, d, e, COLUMNS)
    return _settings(spark, folder).select(
        "l_suppkey", "n", "k", "remaining",
        formulas.oversampled_k(k, d, e, COLUMNS).alias("kplus"), subset.alias("max_subset"),
        F.round(alpha, 6).alias("alpha"), F.round(phi, 6).alias("phi_alpha"),
        formulas.outlier_rows(alpha, k, phi, COLUMNS).alias("r"),
        formulas.draws_per_step(k, on=COLUMNS).alias("l"),
    )


def threshold(spark, folder):
    n, k, e, d = F.col("n"), F.col("k"), F.col("epsilon"), F.lit(DELTA)
    alpha = formulas.sampling_rate(formulas.max_subset(n, k, e, d, COLUMNS), F.col("remaining"))
    phi = formulas.phi_alpha(alpha, k, d, e, COLUMNS)
    psi = F.greatest(formulas.scaled_cost(F.col("cost"), alpha), F.col("known"))
    return _settings(spark, folder).select(
        "l_suppkey", F.round(psi, 6).alias("psi"), F.round(formulas.reach(psi, k, phi), 6).alias("v")
    )


def ene_parameters(spark, folder):
    n, k, e = F.col("n"), F.col("k"), F.col("epsilon")
    left = F.col("remaining")
    return _settings(spark, folder).select(
        "l_suppkey",
        F.round(formulas.sample_rate_s(k, n, e, left, COLUMNS), 6).alias("alpha_s"),
        F.round(formulas.sample_rate_h(n, e, left, COLUMNS), 6).alias("alpha_h"),
        F.round(formulas.sample_prune_subset(k, n, e, COLUMNS), 6).alias("max_subset"),
        formulas.tail_rank(n, COLUMNS).alias("tail_rank"),
    )


# --- rounds and whole runs ---------------------------------------------------------------------


def estimate_step(spark, folder):
    points = lattice(spark, folder)
    n = points.count()
    alpha = formulas.sampling_rate(formulas.max_subset(n, K, EPSILON, DELTA), n)
    drawn = sampling.paired_sample(points, alpha, SEED, method="md5")
    centers = fixed_box(drawn.where("p1"), formulas.oversampled_k(K, DELTA, EPSILON), SEED)
    step = rounds.estimate(drawn.where("p2"), centers, alpha, K, DELTA, EPSILON)
    return one_row(
        spark, "center_count int, r bigint, truncated_risk bigint, psi double, v double",
        len(centers), step.r, round(step.truncated_risk), round(step.psi, 6), round(step.v, 6),
    )


def _rounds(spark, folder, max_iter, **options):
    run = fixed_run(spark, folder, max_iter=max_iter, final_risk=False, **options)
    return run.rounds_df(spark).select(
        "round", "remaining", "p1_rows", "p2_rows", "center_count", "r", F.round("v", 6).alias("v"), "handled",
        "survivors", whole(F.col("truncated_risk"), "truncated_risk"), whole(F.col("handled_risk"), "handled_risk"),
    )


def one_round(spark, folder):
    return _rounds(spark, folder, 1)


def two_rounds(spark, folder):
    return _rounds(spark, folder, 2)


def candidate_weights(spark, folder):
    """All candidates of a whole run (rounds, last survivors) with their weights."""
    run = fixed_run(spark, folder, max_iter=2, final_risk=False)
    return run.candidates.to_df(spark).select("center_id", whole(F.col("weight"), "weight"), *coordinates("c", "c"))


def last_step_small(spark, folder):
    """The centres that the last survivors give: the rows themselves when there are few."""
    run = fixed_run(spark, folder, max_iter=2, final_risk=False)
    before = sum(r["center_count"] for r in run.rounds)
    return run.candidates.to_df(spark).where(F.col("center_id") >= before).select(*coordinates("c", "c"))


def last_step_large(spark, folder):
    """After a single round too many rows are left to be centres themselves: the box takes k of them."""
    run = fixed_run(spark, folder, max_iter=1, final_risk=False)
    before = sum(r["center_count"] for r in run.rounds)
    last = run.candidates.to_df(spark).where(F.col("center_id") >= before)
    return last.select(*coordinates("c", "c"), F.lit(int(run.rounds[-1]["survivors"] > K)).alias("many"))


APART = 10_000


def separated(spark, folder) -> DataFrame:
    """Orders around five places, one for each priority, far apart: a clustering has one right answer."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    orders = prep.spread(orders, per_split=16)
    place = F.substring("o_orderpriority", 1, 1).cast("int")
    x = F.array(
        place * APART, F.pow(place, F.lit(2)) * APART, prep.rounded(F.col("o_totalprice") / 10000), F.pmod("o_custkey", F.lit(11)),
    )
    return prep.point_table(orders, [F.col("o_orderkey").cast("string")], x)


def partition_found(points: DataFrame, centers: Centers) -> DataFrame:
    """Rows and mean of each cluster, in the order of the first coordinate."""
    found = nearest.with_nearest(points, centers)
    means = [F.round(F.avg(F.col("x")[j]), 6).alias(f"x{j}") for j in range(DIMS)]
    return found.groupBy("center_id").agg(F.count("*").alias("size"), *means).drop("center_id").withColumn("k", F.lit(len(centers)))


SEEDS = (7, 8, 9)


def _best(spark, folder, algorithm, epsilon=EPSILON, **options):
    points = separated(spark, folder)
    return partition_found(points, evaluate.best_run(points, algorithm, K, epsilon, SEEDS, **options).centers)


def sampled_kmeans_run(spark, folder):
    return _best(spark, folder, "sampled_kmeans")


def sampled_kmeans_parallel_inner(spark, folder):
    return _best(spark, folder, "sampled_kmeans", blackbox="kmeans_parallel")


def _cheapest(spark, points, boxes) -> DataFrame:
    """The partition by the cheapest of several centre sets, all measured in one scan."""
    sets = {str(i): c for i, c in enumerate(boxes)}
    found = cost.costs(points, sets)
    return partition_found(points, sets[min(found, key=found.get)])


def inner_kmeans(spark, folder):
    """The box inside the rounds, on the sample of the first."""
    points = separated(spark, folder)
    n = points.count()
    alpha = formulas.sampling_rate(formulas.max_subset(n, K, EPSILON, DELTA), n)
    sample = sampling.paired_sample(points, alpha, SEED, method="md5").where("p1")
    return _cheapest(spark, points, [spark_kmeans()(sample, K, s) for s in SEEDS])


def weighted_reduce(spark, folder):
    points = separated(spark, folder)
    weighted, _ = cost.center_weights(points, lowest_by_hash(points, 68))
    return _cheapest(spark, points, [reduce_centers(spark, weighted, K, s, spark_kmeans()) for s in SEEDS])


def plain_kmeans(spark, folder):
    points = separated(spark, folder)
    return _cheapest(spark, points, [spark_kmeans(max_iter=20)(points, K, s) for s in SEEDS])


def kmeans_parallel_step(spark, folder):
    """The first centre and two steps of draws."""
    points = lattice(spark, folder)
    first = sampling.random_rows(points, 1, SEED, "first", "md5").select("point_id", "x").collect()
    candidates, drawn = Centers([r.x for r in first]), [(0, r.point_id) for r in first]
    for step in (1, 2):
        rows = draw_step(points, candidates, 2 * K, SEED, step, "md5").collect()
        candidates = candidates.appended(Centers([r.x for r in rows]))
        drawn += [(step, r.point_id) for r in rows]
    return spark.createDataFrame(drawn, "step int, point_id string")


def kmeans_parallel_weights(spark, folder):
    """All candidates after two steps, with their weights."""
    run = kmeans_parallel(
        lattice(spark, folder), K, iterations=2, seed=SEED, uniform="md5", reducer=fixed_box, final_risk=False
    )
    return run.candidates.to_df(spark).select("center_id", whole(F.col("weight"), "weight"), *coordinates("c", "c"))


def kmeans_parallel_carried(spark, folder):
    """Three steps that measure the newest candidates only: all candidates, their weights, and comparisons."""
    run = kmeans_parallel(
        lattice(spark, folder), K, iterations=3, m=4, seed=SEED, uniform="md5", reducer=fixed_box, final_risk=False, carry=True
    )
    return run.candidates.to_df(spark).select(
        "center_id", whole(F.col("weight"), "weight"), *coordinates("c", "c"), F.lit(round(run.risk)).cast("bigint").alias("risk"),
        F.lit(int(run.total_comps)).cast("bigint").alias("total_comps"),
    )


def kmeans_parallel_run(spark, folder):
    points = separated(spark, folder)
    runs = [kmeans_parallel(points, K, seed=s) for s in SEEDS]
    return partition_found(points, min(runs, key=lambda r: r.risk_final).centers)


def _prune_round(spark, folder, tables):
    points = lattice(spark, folder)
    n = points.count()
    start = points.withColumn("d2", F.lit(float("inf")))
    sample, pivots, sizes = draw_round(start, K, n, PRUNE_EPSILON, n, SEED, 1, "md5", tables)
    v, long_enough = pivot_distance(pivots, sample, formulas.tail_rank(n), tables)
    return start, sample, sizes, v, long_enough


def ene_round(spark, folder):
    with RunTables(spark) as tables:
        start, sample, sizes, v, long_enough = _prune_round(spark, folder, tables)
        found = rounds.prune(nearer_sample(start, sample, tables), v, tables, "survivors", ["point_id"])
    return one_row(
        spark, "s_rows bigint, h_rows bigint, long_enough int, v bigint, survivors bigint, handled_risk bigint",
        sizes["s"], sizes["h"], int(long_enough), round(v), found.remaining, round(found.handled_risk),
    )


def ene_survivors(spark, folder):
    # not used as a context: the returned frame still reads the sample
    tables = RunTables(spark)
    start, sample, _, v, _ = _prune_round(spark, folder, tables)
    return rounds.beyond(nearer_sample(start, sample, tables), v).select("point_id", whole(F.col("d2"), "d2"))


def ene_two_rounds(spark, folder):
    """Two rounds, however many rows there are, and all that survives them in the sample."""
    run = sample_prune(
        lattice(spark, folder), 1, 0.2, max_iter=2, min_iter=2, seed=SEED, uniform="md5", reducer=fixed_box, final_risk=False
    )
    return run.rounds_df(spark).select(
        "round", "remaining", F.col("p1_rows").alias("s_rows"), F.col("p2_rows").alias("h_rows"),
        F.col("center_count").alias("sample_rows"), whole(F.col("v"), "v"), "survivors",
        whole(F.col("handled_risk"), "handled_risk"), F.lit(run.candidate_count).cast("bigint").alias("centers_in_all"),
        F.lit(round(run.risk)).cast("bigint").alias("risk"),
    )


def ene_to_stop_size(spark, folder):
    """Rounds without a bound, down to the stop size; the sample and what is left serve every point."""
    run = sample_prune(lattice(spark, folder), 1, 0.2, seed=SEED, uniform="md5", reducer=fixed_box, final_risk=False)
    left = run.rounds[-1]["survivors"] if run.rounds else run.candidate_count
    return one_row(
        spark, "stop_size double, reached int, capped int", round(float(run.capacity), 6), int(left <= run.capacity), int(run.capped)
    )


def ene_clustering(spark, folder):
    return _best(spark, folder, "sample_prune", PRUNE_EPSILON)


# --- evaluation --------------------------------------------------------------------------------


def compare_runs(spark, folder):
    """Runs of three algorithms: enough candidates, and a cost below that of rows taken by hash."""
    points = lattice(spark, folder)
    bound = cost.risk(points, lowest_by_hash(points, K))
    algorithms = ["sampled_kmeans", "kmeans_parallel", "sample_prune"]
    metrics = evaluate.compare_runs(points, algorithms, K, PRUNE_EPSILON, rounds=2, seed=SEED, dataset="lineitem")
    return metrics.select(
        "dataset", "algorithm", "round", "k", (F.col("num_centers") >= K).cast("int").alias("enough"),
        # one first centre, then l in each step
        F.when(F.col("algorithm") == "kmeans_parallel", F.col("num_centers")).otherwise(0).alias("drawn"),
        F.lit(round(bound)).cast("bigint").alias("bound"), (F.col("risk_final") <= bound).cast("int").alias("below"),
        (F.col("risk") <= F.col("risk_final")).cast("int").alias("candidates_cheaper"),
    )


def sweep_plan(spark, folder):
    mixture = F.concat(F.lit("gaussian_"), F.col("p_size").cast("string"))
    name = F.when(F.col("p_type") == "ECONOMY", mixture).otherwise(F.concat_ws("/", "p_brand", "p_type"))
    plan = evaluate.sweep_plan(table(spark, folder, "part").select(name.alias("dataset")).distinct())
    return plan.na.fill(0, ["epsilon", "steps"])


def compare_estimators(spark, folder):
    points = lattice(spark, folder)
    bound = cost.risk(points, lowest_by_hash(points, K))
    vectors = points.select("point_id", array_to_vector("x").alias("features"))
    ours = PrunedKMeans(k=K, epsilon=EPSILON, delta=DELTA, maxIter=3, seed=1, idCol="point_id")
    found = evaluate.fit_and_evaluate({"sampled": ours, "plain": KMeans(k=K, seed=1, maxIter=20)}, vectors)
    return found.select(
        "estimator", "num_centers", F.lit(round(bound)).cast("bigint").alias("bound"), (F.col("risk_final") <= bound).cast("int").alias("below")
    )


QUERIES = {
    "csv_points": csv_points,
    "csv_limit": csv_limit,
    "csv_skip_line": csv_skip_line,
    "csv_first_rows": csv_first_rows,
    "libsvm_points": libsvm_points,
    "preset_points": preset_points,
    "gaussian_sizes": gaussian_sizes,
    "gaussian_points": gaussian_points,
    "run_results": run_results,
    "run_summary": run_summary,
    "shared_summary": shared_summary,
    "sweep_summary": sweep_summary,
    "sweep_restart": sweep_restart,
    "numeric_projection": numeric_projection,
    "drop_nulls": drop_nulls,
    "one_hot": one_hot,
    "one_hot_sparse": one_hot_sparse,
    "drop_index_column": drop_index_column,
    "min_max_scale": min_max_scale,
    "min_max_scale_nan": min_max_scale_nan,
    "constant_scale": constant_scale,
    "assemble_vector": assemble_vector,
    "profile_points": profile_points,
    "survivors": survivors,
    "ene_survivors": ene_survivors,
    "paired_sample": paired_sample,
    "paired_sample_disjoint": paired_sample_disjoint,
    "ene_sample": ene_sample,
    "exact_sample": exact_sample,
    "exact_rounds": exact_rounds,
    "first_center": first_center,
    "weighted_sample": weighted_sample,
    "squared_distance": squared_distances,
    "nearest_distance": nearest_distance,
    "assign_nearest": assign_nearest,
    "incremental_distance": incremental_distance,
    "nearest_cosine": nearest_cosine,
    "nearest_vectors": nearest_vectors,
    "sparse_nearest": sparse_nearest,
    "sparse_risk": sparse_risk,
    "sparse_weights": sparse_weights,
    "sparse_libsvm": sparse_libsvm,
    "sparse_clustering": sparse_clustering,
    "predict": predict,
    "predict_cosine": predict_cosine,
    "model_round_trip": model_round_trip,
    "scored_schema": scored_schema,
    "parameter_errors": parameter_errors,
    "risk": risk,
    "truncated_risk": truncated_risk,
    "truncated_risk_half": truncated_risk_half,
    "truncated_risk_trivial": truncated_risk_trivial,
    "center_weights": center_weights,
    "weights_in_blocks": weights_in_blocks,
    "costs_in_blocks": costs_in_blocks,
    "weighted_costs": weighted_costs,
    "handled_risk": handled_risk,
    "tail_select": tail_select,
    "tail_select_short": tail_select_short,
    "remaining_count": remaining_count,
    "cluster_summary": cluster_summary,
    "comparison_counts": comparison_counts,
    "union_centers": union_centers,
    "plan_parameters": plan_parameters,
    "threshold": threshold,
    "ene_parameters": ene_parameters,
    "estimate_step": estimate_step,
    "one_round": one_round,
    "two_rounds": two_rounds,
    "candidate_weights": candidate_weights,
    "last_step_small": last_step_small,
    "last_step_large": last_step_large,
    "sampled_kmeans": sampled_kmeans_run,
    "sampled_kmeans_parallel_inner": sampled_kmeans_parallel_inner,
    "inner_kmeans": inner_kmeans,
    "weighted_reduce": weighted_reduce,
    "plain_kmeans": plain_kmeans,
    "kmeans_parallel_step": kmeans_parallel_step,
    "kmeans_parallel_weights": kmeans_parallel_weights,
    "kmeans_parallel_carried": kmeans_parallel_carried,
    "kmeans_parallel": kmeans_parallel_run,
    "ene_round": ene_round,
    "ene_two_rounds": ene_two_rounds,
    "ene_to_stop_size": ene_to_stop_size,
    "ene_clustering": ene_clustering,
    "compare_runs": compare_runs,
    "sweep_plan": sweep_plan,
    "compare_estimators": compare_estimators,
}
