"""Near-duplicate vectors by counting collisions in many sorted one-dimensional projections.

Projections. Each of a few random rotations gives 2d directions (its axes and their opposites); a
projection takes one direction of each rotation and sums them. There are (2d)^turns such projections, and a
vector's largest ones follow from the largest of each rotation, so all need never be computed. A
vector stands in the lists of its ``lists`` largest projections, where it is told apart best.

Collisions. A list is sorted by projected value. Two vectors collide in it if one lies in the window of
half-width ``window`` centred at the other. Pairs that collide in ``least`` lists or more are verified by
their cosine in double precision. Window and count are calibrated by simulation: of pairs at
exactly the threshold, the share ``recall`` or more must pass; closer pairs pass more often.

Work. A list carries the vectors and their lists, so a task counts all collisions of a pair by itself and no
pair is ever moved: the pair belongs to the first list in which it collides, where its links are counted and
joined into stars. As a pair must share ``least`` lists, a vector stands in all but its last ``least`` - 1
ones. Lists with many members are dealt out in blocks, one task for each two blocks; equal vectors are
one member with a weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from prunecluster.llm.batches import map_rows
from prunecluster.llm.components import components
from prunecluster.storage import RunTables

#: Members of a list that the number of projections aims at, and those of a block.
LIST_SIZE, BLOCK_SIZE = 256, 2048
#: Tried numbers of lists per vector, pairs in the simulation, share of collisions inside the window.
LIST_COUNTS, TRIALS, INSIDE = (8, 16, 24, 32, 48, 64, 96), 4000, 0.9995
#: Room for rounding when pairs are screened in single precision.
SLACK = 1e-5
ROWS_AT_ONCE, PAIRS_AT_ONCE = 512, 8192


@dataclass(frozen=True)
class Projections:
    dimension: int
    turns: int
    lists: int
    window: float
    least: int
    recall: float
    seed: int

    def rotations(self) -> list[np.ndarray]:
        rng = np.random.default_rng([self.seed, self.dimension])
        return [np.linalg.qr(rng.normal(size=(self.dimension, self.dimension)))[0] for _ in range(self.turns)]

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, ascending, and values of each row's largest projections."""
        rows = len(unit)
        numbers, values = np.zeros((rows, 1), np.int64), np.zeros((rows, 1))
        for rotation in self.rotations():
            own = unit @ rotation
            own = np.concatenate([own, -own], axis=1)
            keep = min(self.lists, own.shape[1])
            top = np.argpartition(-own, keep - 1, axis=1)[:, :keep]
            sums = (values[:, :, None] + np.take_along_axis(own, top, 1)[:, None, :]).reshape(rows, -1)
            named = (numbers[:, :, None] * own.shape[1] + top[:, None, :]).reshape(rows, -1)
            keep = min(self.lists, sums.shape[1])
            top = np.argpartition(-sums, keep - 1, axis=1)[:, :keep]
            numbers, values = np.take_along_axis(named, top, 1), np.take_along_axis(sums, top, 1)
        order = np.argsort(numbers, axis=1)
        return np.take_along_axis(numbers, order, 1), np.take_along_axis(values, order, 1) / np.sqrt(self.turns)


def calibrate(dimension: int, rows: int, threshold: float, recall: float, seed: int) -> Projections:
    """The fewest lists, and for them the highest count, that keep ``recall`` of the pairs at the threshold."""
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=(2, TRIALS, dimension))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(axis=1)[:, None] * x
    size = np.linalg.norm(z, axis=1)[:, None]
    z = np.divide(z, size, out=np.zeros_like(z), where=size > 1e-12)
    y = threshold * x + np.sqrt(1 - threshold**2) * z
    best = None
    for lists in LIST_COUNTS:
        turns = 1
        while turns < 4 and rows * lists > LIST_SIZE * (2 * dimension) ** turns and (2 * dimension) ** (turns + 1) < 1 << 31:
            turns += 1
        trial = Projections(dimension, turns, lists, 0.0, 1, 0.0, seed)
        (a, at), (b, bt) = trial.place(x), trial.place(y)
        same = a[:, :, None] == b[:, None, :]
        apart = np.abs(at[:, :, None] - bt[:, None, :])
        window = float(np.quantile(apart[same], INSIDE)) if same.any() else 2.0
        counts = (same & (apart <= window)).sum(axis=(1, 2))
        passing = [float((counts >= c).mean()) for c in range(1, a.shape[1] + 1)]
        least = max([1, *(c for c, share in enumerate(passing, 1) if share >= recall)])
        best = Projections(dimension, turns, lists, window, least, passing[least - 1], seed)
        # A count of two or more leaves out lists and pairs by chance.
        if best.recall >= recall and least > 1:
            break
    return best


def usable(vector: str):
    """Not null, not empty, all components finite numbers, not all zero."""
    c = F.col(vector)
    return F.coalesce(
        (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0),
        F.lit(False),
    )


def _units(joined: bytes, kind: str, dimension: int) -> np.ndarray:
    x = np.frombuffer(joined, kind).reshape(-1, dimension).astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _placed(vectors: DataFrame, plans: dict[int, Projections], kind: str) -> DataFrame:
    """Each different vector with its lists: (node, weight, dim, vector, numbers, places)."""

    def make(batches):
        for batch in batches:
            nodes, weights, rows = (batch.column(c).to_pylist() for c in ("node", "weight", "vector"))
            sizes = np.array([len(r) for r in rows])
            for dimension in np.unique(sizes):
                plan, where = plans[int(dimension)], np.flatnonzero(sizes == dimension)
                for start in range(0, len(where), ROWS_AT_ONCE):
                    part = where[start : start + ROWS_AT_ONCE]
                    raw = np.array([rows[i] for i in part], kind)
                    numbers, values = plan.place(_units(raw.tobytes(), kind, int(dimension)))
                    for i, r, n, v in zip(part, raw, numbers.astype("<i4"), values.astype("<f4")):
                        posted = n[: max(1, len(n) - plan.least + 1)].tolist()
                        yield nodes[i], weights[i], int(dimension), r.tobytes(), n.tobytes(), v.tobytes(), posted

    return map_rows(
        vectors, make, "node long, weight long, dim int, vector binary, numbers binary, places binary, posted array<int>"
    )


def _collisions(numbers, places, i, j, window):
    """For each pair of rows: collisions in all lists, and the first list with one."""
    counts, first = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for start in range(0, len(i), PAIRS_AT_ONCE):
        a, b = i[start : start + PAIRS_AT_ONCE], j[start : start + PAIRS_AT_ONCE]
        hit = numbers[a][:, :, None] == numbers[b][:, None, :]
        hit &= np.abs(places[a][:, :, None] - places[b][:, None, :]) <= window
        own = hit.any(axis=2)
        counts[start : start + len(a)] = own.sum(axis=1)
        first[start : start + len(a)] = np.where(own, numbers[a].astype(np.int64), np.iinfo(np.int64).max).min(axis=1)
    return counts, first


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that links reach from each row."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _matches(plan: Projections, threshold: float, kind: str, number: int, split: bool, rows: dict):
    """(node, links, star) of the members of a list, or of two blocks of one, that have links owned by it."""
    places = np.frombuffer(b"".join(rows["places"]), "<f4").reshape(len(rows["node"]), -1)
    place = places[np.arange(len(places)), rows["nth"]]
    order = np.argsort(place, kind="stable")
    place, places = place[order], places[order]
    unit = _units(b"".join(rows["vector"]), kind, plan.dimension)[order]
    numbers = np.frombuffer(b"".join(rows["numbers"]), "<i4").reshape(len(unit), -1)[order]
    nodes, weights = np.array(rows["node"])[order], np.array(rows["weight"])[order]
    block = np.array(rows["block"])[order]
    single = unit.astype(np.float32)
    ends = np.searchsorted(place, place + np.float32(plan.window), side="right")
    found = []
    for start in range(0, len(unit), ROWS_AT_ONCE):
        stop = min(start + ROWS_AT_ONCE, len(unit))
        until = int(ends[stop - 1])
        # Both conditions must hold; the cosine is the cheaper one to ask first.
        i, j = np.nonzero(single[start:stop] @ single[start:until].T >= threshold - SLACK)
        i, j = i + start, j + start
        keep = (i < j) & (j < ends[i])
        if split:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        counts, first = _collisions(numbers, places, i, j, np.float32(plan.window))
        keep = (counts >= plan.least) & (first == number)
        i, j = i[keep], j[keep]
        exact = np.concatenate([
            (unit[i[s : s + PAIRS_AT_ONCE]] * unit[j[s : s + PAIRS_AT_ONCE]]).sum(axis=1) for s in range(0, len(i), PAIRS_AT_ONCE)
        ] or [np.zeros(0)])
        found.append((i[exact >= threshold], j[exact >= threshold]))
    i, j = (np.concatenate(x) for x in zip(*found))
    if len(i):
        links = np.bincount(i, weights[j], len(unit)) + np.bincount(j, weights[i], len(unit))
        star = nodes[_stars(len(unit), i, j)]
        for row in np.flatnonzero(links):
            yield int(nodes[row]), int(links[row]), int(star[row])


def _linked(keyed: DataFrame, plans: dict[int, Projections], threshold: float, kind: str) -> DataFrame:
    key = ("dim", "number", "low", "high")
    names = ("node", "weight", "vector", "numbers", "places", "nth", "block")

    def make(batches):
        own, rows = None, None

        def done():
            if own is not None and len(rows["node"]) > 1:
                dimension, number, low, high = own
                yield from _matches(plans[dimension], threshold, kind, number, low != high, rows)

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            for k, values in zip(zip(*(batch.column(c).to_pylist() for c in key)), zip(*columns)):
                if k != own:
                    yield from done()
                    own, rows = k, {n: [] for n in names}
                for n, v in zip(names, values):
                    rows[n].append(v)
        yield from done()

    return map_rows(keyed.repartition(*key).sortWithinPartitions(*key), make, "node long, links long, star long")


def embedding_dedup(
    embeddings: DataFrame, threshold: float = 0.95, recall: float = 0.999, seed: int = 11, block_size: int = BLOCK_SIZE
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link from a cosine of ``threshold`` on. A vector that is null, empty, zero or has null or
    non-finite components links with nothing, and so do vectors of different lengths with each other.
    Rows that share a vec_id and vector are vectors of their own, linked as copies are. A row without
    vec_id links with nothing, has no component and is not kept. An empty table gives no rows. Other
    columns are not read.
    """
    run = RunTables(embeddings.sparkSession)
    kind = "<f4" if isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).withColumn(
        "usable", usable("vector") & F.col("vec_id").isNotNull()
    )
    good = rows.filter("usable").select("vec_id", "vector")
    # Equal vectors are one class, named by its least id.
    classes = run.write(good.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "classes")
    sizes = {r.dim: r.n for r in classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    plans = {d: calibrate(d, n, threshold, recall, seed) for d, n in sizes.items()}
    placed = run.write(_placed(classes, plans, kind), "placed")

    posts = placed.select("node", "dim", F.posexplode("posted").alias("nth", "number"))
    blocks = posts.groupBy("dim", "number").agg(F.ceil(F.count("*") / block_size).cast("int").alias("blocks")).filter("blocks > 1")
    # A member of a large list goes to the tasks of its block with each block.
    tasks = (
        posts.join(blocks, ["dim", "number"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "nth", "number", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    keyed = tasks.join(placed.drop("posted"), "node")
    linked = run.write(_linked(keyed, plans, threshold, kind), "linked")

    total = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(linked.select(F.col("node").alias("a"), F.col("star").alias("b")), run)
    of_class = (
        classes.join(total, "node", "left").join(joined, "node", "left")
        .select(
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
    )
    linked_rows = good.join(of_class, "vector").select("vec_id", "n_links", "component_id")
    others = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.union(others).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
