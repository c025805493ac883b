"""Best-fit packing planned on counts of lengths.

The tokenised pieces are counted by length: at most as many counts as a sequence has places, however
many documents there are. Best fit, longest first, runs over these counts and gives slots for
ranges of ranks; each piece then takes the slot of its rank within its length by a join.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prunecluster.llm.batches import doc_texts, id_and_text, map_rows, task_number, word_ids
from prunecluster.storage import RunTables

PIECES = "part int, doc_id long, piece int, start long, length int, place long, ids_crc32 long"
PLAN = "length int, first long, n long, sequence long, each long, offset long"


def plan_slots(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Slots for ``counts`` of pieces by length, and the number of sequences.

    A slot row (length, first, n, sequence, each, offset) seats the pieces ranked first .. first + n - 1 of
    that length, ``each`` to a sequence side by side from ``offset``, in consecutive sequences. Sequences
    with equal room are alike, so they are held as intervals of numbers: the work depends on
    the number of lengths, not on the number of pieces.
    """
    rooms: list[int] = []  # the rooms that some sequence has, ascending
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rows, opened = [], 0

    def give(room: int, start: int, n: int) -> None:
        if room and n:
            if not held[room]:
                insort(rooms, room)
            held[room].append((start, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                new = -(-left // (capacity // length))
                give(capacity, opened, new)
                opened += new
                continue
            room = rooms[at]
            start, n = held[room].pop()
            if not held[room]:
                rooms.pop(at)
            each, offset = room // length, capacity - room
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, start, each, offset))
                give(room - each * length, start, full)
                left, rank = left - full * each, rank + full * each
            if full < n:
                last = min(left, each)  # fewer than fill a sequence, or none
                if last:
                    rows.append((length, rank, last, start + full, last, offset))
                    give(room - last * length, start + full, 1)
                    left, rank = left - last, rank + last
                give(room, start + full + bool(last), n - full - bool(last))
    return rows, opened


def _pieces(documents: DataFrame, tokenizer_file: str, end_id: int, capacity: int) -> DataFrame:
    def make(batches):
        words, seen, part = word_ids(tokenizer_file), defaultdict(int), task_number()
        end = int(end_id).to_bytes(4, "little")
        for doc_id, ids in words.encode_all(doc_texts(batches)):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                data = ids[at : at + 4 * capacity]
                length = len(data) // 4
                yield part, doc_id, piece, at // 4, length, seen[length], zlib.crc32(data)
                seen[length] += 1

    return map_rows(id_and_text(documents), make, PIECES, keeps="ids")


def pack_documents(documents: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Rows that repeat a doc_id, or have none, are packed one
    by one like any others. An empty table gives no rows. Other columns are not read.
    The rank of a piece within its length is its place in its task plus what earlier tasks have of
    that length, so no length is gathered anywhere, however common it is.
    """
    spark = documents.sparkSession
    run = RunTables(spark)
    pieces = run.write(_pieces(documents, tokenizer_file, end_id, capacity), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # At most ``capacity`` rows.
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan_slots(counts, capacity)
    plan = spark.createDataFrame(rows, PLAN).withColumnRenamed("length", "of_length")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    slot = F.col("rank") - F.col("first")
    return ranked.join(
        # Proven small: its size follows from the number of lengths, not from the documents.
        F.broadcast(plan),
        (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first")) & (slot < F.col("n")),
    ).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence") + F.floor(slot / F.col("each"))).alias("sequence_id"),
        (F.col("offset") + (slot % F.col("each")) * F.col("length")).alias("offset"),
    )
