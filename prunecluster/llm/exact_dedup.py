"""Exact deduplication by polynomial fingerprints that compose, and a comparison of whole texts.

A text is cut into chunks. The hash of a chunk is a polynomial of its bytes at a fixed point modulo
2^31 - 1, at three points at once; hashes of neighbours combine by shifting the later one by the
length of the earlier, so chunks are hashed in any order and in parallel (one matrix product).
Texts with equal fingerprints and lengths are then compared chunk by chunk with the text that
stays; a text that differs in spite of its fingerprint opens a group of its own kind in the next turn.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunecluster.llm.batches import doc_texts, id_and_text, map_rows, row_key, without
from prunecluster.storage import RunTables

MODULUS = (1 << 31) - 1
#: Points at which the polynomials are taken; any residues do.
POINTS = (1_000_003_573, 715_827_947, 1_431_655_823)
#: Bytes of a chunk: 2^13 products of a byte and a residue stay below 2^53, exact in doubles.
CHUNK = 1 << 13
#: Bytes of a chunk in the comparison, and rows of a group that are compared in one share.
COMPARED_BYTES, SHARE_ROWS = 1 << 16, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def powers(points=POINTS, size: int = CHUNK) -> np.ndarray:
    """``points`` to the power of 0 .. size - 1, a column for each point."""
    return np.array([[pow(p, i, MODULUS) for p in points] for i in range(size)], dtype=np.float64)


def combine(first: tuple[tuple[int, ...], int], second: tuple[tuple[int, ...], int], points=POINTS):
    """(hashes, length) of two neighbours joined. Associative; ((0, ...), 0) is its neutral element."""
    (a, n), (b, m) = first, second
    return tuple((x + pow(p, n, MODULUS) * y) % MODULUS for x, y, p in zip(a, b, points)), n + m


def fingerprint(data: bytes, table: np.ndarray, points=POINTS) -> tuple[tuple[int, ...], int]:
    """(hashes, length) of ``data``: all chunks at once, then combined by their places."""
    size, n = len(table), len(data)
    if n <= size:
        row = np.frombuffer(data, np.uint8).astype(np.float64)
        return tuple(int(h) % MODULUS for h in row @ table[:n]), n
    total = ((0,) * len(points), 0)
    stride = size * 256  # bounds the doubles that stand for a very long text
    for start in range(0, n, stride):
        part = np.frombuffer(data, np.uint8, min(stride, n - start), start)
        whole = part[: len(part) // size * size].reshape(-1, size).astype(np.float64)
        for hashes in whole @ table:
            total = combine(total, (tuple(int(h) % MODULUS for h in hashes), size), points)
        rest = part[len(whole) * size :].astype(np.float64)
        if len(rest):
            total = combine(total, (tuple(int(h) % MODULUS for h in rest @ table[: len(rest)]), len(rest)), points)
    return total


def _marks(documents: DataFrame, points) -> DataFrame:
    keyed = id_and_text(documents).withColumn("row_key", row_key())

    def make(batches):
        table = powers(points)
        for batch in batches:
            keys = batch.column("row_key").to_pylist()
            for (doc_id, text), key in zip(doc_texts([batch]), keys):
                text = text.lower()  # of bytes: A-Z alone
                hashes, n = fingerprint(text, table, points)
                yield doc_id, key, ".".join(map(str, hashes)), n, hashlib.sha256(text).hexdigest()

    return map_rows(keyed, make, "doc_id long, row_key long, print string, n_bytes long, text_sha256 string")


def _unequal(documents: DataFrame, marks: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, row_key) of rows whose text isn't that of their group's row that stays.

    Only texts of groups of several rows are moved. A large group is dealt out in shares by row, each
    with a copy of the text that it is compared with.
    """
    key = ["print", "n_bytes", "turn"]
    members = (
        marks.join(groups, key)
        .groupBy("doc_id", "row_key", *key, "stays", "group_size").agg(F.lit(1).alias("one")).drop("one")
        .withColumnsRenamed({"doc_id": "id", "row_key": "rk"})
    )
    text = id_and_text(documents).withColumn("row_key", row_key())
    body = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).cast("binary")
    held = (
        text.join(
            members.hint("shuffle_hash"),
            (F.col("row_key") == F.col("rk")) & F.col("doc_id").eqNullSafe(F.col("id")),
        )
        .select("doc_id", "row_key", *key, "stays", "group_size", body.alias("body"))
    )
    shares = F.ceil(F.col("group_size") / SHARE_ROWS).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_bytes") / COMPARED_BYTES).cast("int") - 1)))

    def chunks(df):
        at = F.col("chunk") * COMPARED_BYTES + 1
        return df.withColumn("chunk", parts).withColumn("body", F.substring(F.col("body"), at, F.lit(COMPARED_BYTES)))

    is_model = F.struct("doc_id", "row_key").eqNullSafe(F.col("stays"))
    models = (
        chunks(held.filter(is_model).dropDuplicates(key))
        .withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
        .select(*key, "share", "chunk", F.col("body").alias("model"))
    )
    others = chunks(held.filter(~is_model)).withColumn("share", F.pmod("row_key", shares).cast("int"))
    return (
        others.join(models, [*key, "share", "chunk"])
        .filter(F.col("body") != F.col("model"))
        .select("doc_id", "row_key").distinct()
    )


def exact_dedup(documents: DataFrame, points=POINTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after lower-casing A-Z; of equal texts the largest doc_id stays.
    A null text counts as empty, and empty texts form one group. Rows that repeat both doc_id and
    text share their verdict, since the id stands for the row. A null doc_id is smaller than any
    other; a group of such rows only has a null keep_id and keeps them. An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    return _verdicts(documents, points).drop("row_key", "stays")


def _verdicts(documents: DataFrame, points) -> DataFrame:
    run = RunTables(documents.sparkSession)
    key = ["print", "n_bytes", "turn"]
    marks = run.write(_marks(documents, points), "marks").withColumn("turn", F.lit(0))
    turn = 0
    while True:
        groups = marks.groupBy(*key).agg(
            F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_key")).alias("stays")
        ).filter("group_size > 1")
        open_groups = groups.filter(F.col("turn") == turn)
        unequal = run.write(_unequal(documents, marks, open_groups), f"unequal{turn}")
        if unequal.isEmpty():
            break
        other = unequal.select(F.col("doc_id").alias("id"), F.col("row_key").alias("rk"), F.lit(turn + 1).alias("next"))
        turn += 1
        marks = run.write(
            marks.join(other, (F.col("row_key") == F.col("rk")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
            .withColumn("turn", F.coalesce("next", "turn")).drop("id", "rk", "next"),
            f"marks{turn}",
        )
    return marks.join(groups, key, "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True)
        .otherwise(F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))).alias("kept"),
        "text_sha256",
        "row_key",
        (F.col("group_size").isNull() | F.struct("doc_id", "row_key").eqNullSafe(F.col("stays"))).alias("stays"),
    )


def drop_copies(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, one for each text, with all their columns.

    Texts are equal as for ``exact_dedup``, and the row with the largest doc_id stays, of several with that id one,
    also if they repeat the whole row; a row without id stays only where no equal text has one. Null and
    empty texts are one text, texts of any length are compared whole, and an empty table stays empty. Columns may
    have any names.
    """
    run = RunTables(documents.sparkSession)
    verdicts = run.write(_verdicts(documents, POINTS).select("doc_id", "row_key", "stays"), "verdicts")
    repeated = verdicts.filter("stays").groupBy("doc_id", "row_key").count().filter("count > 1")
    return without(documents, verdicts.filter(~F.col("stays")), run.write(repeated, "repeated"))
