"""What filters do to a corpus in every order of applying them, from one scan of the texts.

A document's failures are a mask of bits, one for each filter. All documents of a part with the same mask fare
alike, so they are counted into cells first, at most 2^filters of a part. Each cell is then folded
across the array of all orders: ``transform`` over orders, ``aggregate`` over the steps of each, with
what the cell weighs (its documents, good and toxic ones). That gives a struct for each order and step;
those of a part's cells are added element by element. Nothing but SQL functions is used.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are what lies between ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[#$%&*|]"
#: Limits of the text filters: words, percent of distinct ones, percent of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
#: What a struct counts; ``unique_fails`` aside, at one step.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides, by letter; an empty text has no words."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def marked(rules: dict[str, Column], copy_rule: str) -> tuple[list[str], Column]:
    """The letters in order, and a mask of those that fail; the copy rule's bit is left 0."""
    letters = sorted([*rules, copy_rule])
    bits = [F.when(rules[l], F.lit(1 << i)).otherwise(F.lit(0)) for i, l in enumerate(letters) if l != copy_rule]
    return letters, reduce(lambda a, b: a + b, bits, F.lit(0))


def failure_cells(documents: DataFrame, labels: DataFrame, rules=text_rules, copy_rule: str = "E") -> tuple[list[str], DataFrame]:
    """The letters, and (part, mask, n, good, toxic): documents of a part whose failures are those in the mask.

    Texts are read once; only their SHA-256 goes on. Rows of one id, text and part are counted before any is
    moved, and so are those of one text, part and label, so a text that a third of all rows hold is one row a task.
    Of equal texts those with the smallest id don't fail the copy rule, rows that repeat this id included. A row
    without id is nobody's copy, nor is anyone's its copy, and has no label. Of repeated label rows any counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text")
    )
    letters, mask = marked(rules(F.col("text")), copy_rule)
    copy_bit = 1 << letters.index(copy_rule)
    rows = (
        read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
        .groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    )
    known = (
        labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t"))
        .where("of is not null").groupBy("of")
        .agg(F.max(F.coalesce(F.col("q") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("t") == 1, F.lit(False))).alias("toxic"))
    )
    # rows without an id are kept out of the join, where all would meet in one task
    no = F.lit(False)
    named = rows.where("doc_id is not null").join(known, F.col("doc_id") == F.col("of"), "left").select(
        "doc_id", "part", "digest", "mask", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )
    kinds = named.groupBy("digest", "part", "good", "toxic", "mask").agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first")
    )
    firsts = kinds.groupBy("digest").agg(F.min("first.doc_id").alias("least")).withColumnRenamed("digest", "same")
    originals = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = kinds.join(firsts, F.col("digest") == F.col("same")).select(
        "part", "good", "toxic", F.explode(F.array(
            F.struct(F.col("mask"), originals.alias("n")),
            F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - originals).alias("n")),
        )).alias("c")
    ).select("part", "c.mask", "c.n", "good", "toxic")
    nameless = rows.where("doc_id is null").select("part", "mask", "n", no.alias("good"), no.alias("toxic"))
    return letters, split.unionByName(nameless).where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def all_orders(letters: list[str]) -> Column:
    """Every order of the filters as an array of their numbers, a literal that goes along with the plan to each task."""
    return F.lit([list(order) for order in permutations(range(len(letters)))])


def fold_cell(orders: Column, mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """The structs of a cell, order by order and step by step, in one array."""
    one = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
    nothing = F.lit(0).cast("bigint")

    def along(order):
        def advance(state, number):
            bit = F.call_function("shiftleft", F.lit(1), number)
            fails = mask.bitwiseAND(bit) != 0
            now = fails & ~state["gone"]
            here = F.struct(
                F.when(state["gone"] | fails, nothing).otherwise(n).alias("kept"),
                F.when(now, n).otherwise(nothing).alias("removed"),
                F.when(fails & state["gone"], n).otherwise(nothing).alias("redundant"),
                F.when(mask == bit, n).otherwise(nothing).alias("unique_fails"),
                F.when(now, good).otherwise(nothing).alias("good_lost"),
                F.when(now, toxic).otherwise(nothing).alias("toxic_lost"),
            ).cast(one)
            return F.struct((state["gone"] | fails).alias("gone"), F.concat(state["steps"], F.array(here)).alias("steps"))

        start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<{one}>").alias("steps"))
        return F.aggregate(order, start, advance, lambda state: state["steps"])

    return F.flatten(F.transform(orders, along))


def interactions(cells: DataFrame, letters: list[str]) -> DataFrame:
    """(part, filter_order, step, filter, counts..., shapley) for every order and step, zeros included.

    ``cells`` as of ``failure_cells``. A part has no more cells than masks, each of factorial(filters) * filters structs.
    """
    steps, orders = len(letters), all_orders(letters)
    folded = cells.select("part", fold_cell(orders, F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")).alias("own"))

    def added(x, y):
        return F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS])

    gathered = folded.groupBy("part").agg(F.collect_list("own").alias("all"))
    merged = gathered.select("part", F.reduce(
        F.slice("all", 2, F.size("all")), F.col("all")[0], lambda x, y: F.zip_with(x, y, added)
    ).alias("own"))
    # of each filter what it removes, over all orders, at whatever step
    numbers = F.flatten(orders)
    removed = F.transform(F.lit(list(range(steps))), lambda f: F.aggregate(
        F.zip_with(numbers, F.transform("own", lambda s: s["removed"]), lambda g, r: F.when(g == f, r).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"), lambda a, b: a + b,
    ))
    names = F.lit(["".join(letters[i] for i in order) for order in permutations(range(steps))])
    rows = merged.withColumn("shares", removed).select("part", "shares", F.posexplode("own").alias("at", "s"))
    order = F.element_at(names, F.floor(F.col("at") / steps).cast("int") + 1)
    step = F.col("at") % steps + 1
    which = F.element_at(F.element_at(orders, F.floor(F.col("at") / steps).cast("int") + 1), step.cast("int"))
    return rows.select(
        "part", order.alias("filter_order"), step.cast("int").alias("step"),
        F.element_at(F.lit(letters), which + 1).alias("filter"), *[F.col(f"s.{c}").alias(c) for c in COUNTS],
        F.element_at("shares", which + 1).alias("shapley"),
    )


def filter_audit(documents: DataFrame, labels: DataFrame, rules=text_rules, copy_rule: str = "E") -> DataFrame:
    """What each filter removes at each step of each order, per language.

    ``rules`` maps the text column to failure conditions by letter; ``copy_rule`` is the letter of the filter
    that drops all but the first of equal texts. Null texts are empty ones, null languages the part ``""``. Texts
    of any length are read whole, by their row alone. Rows that repeat count one by one. An empty table has no
    part and gives no rows; empty labels lose nothing. Other columns are not read, whatever their names.
    """
    letters, cells = failure_cells(documents, labels, rules, copy_rule)
    return interactions(cells, letters)
