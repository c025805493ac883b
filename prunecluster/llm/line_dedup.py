"""Deduplication of runs of lines by winnowing over line hashes.

In every window of ``run`` neighbouring lines the line with the least hash (the last one, if several) is
selected. Equal runs of that length select the same line, so a run that repeats is sure to share a
fingerprint; lines whose fingerprint occurs once are done with after one count. Where a fingerprint
repeats, its matches are extended both ways: each window that selected it, reaching from ``run`` - 1 lines
before to as many after it, is compared by the hash of its lines with the earliest position of that
hash. A window that isn't the earliest repeats an earlier run, and its lines go; neighbouring windows join
to runs of any length. Earliest positions are minima, summed up before any exchange: no pairs of
occurrences are formed, however common a line is.

A passage may also be long in words and short in lines. So the fewest lines from a place on that reach
``least_words`` words are a window as well, where they are fewer than ``run``: a copy of the passage has the
same ones. Their least line hash, told apart by their number, is their fingerprint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunecluster.llm.batches import as_bytes, id_and_text, map_rows
from prunecluster.storage import RunTables

#: Words from which on a passage of fewer lines than a run is looked for too.
LEAST_WORDS = 50
FINGERPRINTS = "doc_id long, row_key long, fingerprint long, windows array<struct<start:int,lines:int,hash:binary>>"


def select(hashes: list[int], run: int) -> list[tuple[int, range]]:
    """(selected line, starts of the windows that select it), in order."""
    found: list[tuple[int, range]] = []
    for start in range(len(hashes) - run + 1):
        if found and found[-1][0] >= start:
            place, windows = found[-1]
            new = start + run - 1
            best = new if hashes[new] <= hashes[place] else place
        else:
            best = min(range(start, start + run), key=lambda i: (hashes[i], -i))
        if found and found[-1][0] == best:
            found[-1] = best, range(found[-1][1].start, start + 1)
        else:
            found.append((best, range(start, start + 1)))
    return found


def wordy(words: list[int], run: int, least_words: int) -> list[tuple[int, int]]:
    """(start, lines) of each window of the fewest lines that reach so many words, where they are fewer than ``run``."""
    found = []
    for start in range(len(words)):
        total = 0
        for lines, n in enumerate(words[start : start + run - 1], 1):
            total += n
            if total >= least_words:
                found.append((start, lines))
                break
    return found


def _fingerprints(keyed: DataFrame, run: int, least_words: int) -> DataFrame:
    def make(batches):
        import xxhash

        for batch in batches:
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), as_bytes(batch.column("text"))):
                own = (text or b"").split(b"\n")
                digests = [xxhash.xxh3_128_digest(line) for line in own]
                hashes = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
                for place, windows in select(hashes, run):
                    yield doc_id, key, hashes[place], [
                        {"start": s, "lines": run, "hash": xxhash.xxh3_128_digest(b"".join(digests[s : s + run]))} for s in windows
                    ]
                for s, lines in wordy([len(line.split()) for line in own], run, least_words):
                    joined = xxhash.xxh3_128_digest(b"".join(digests[s : s + lines]), seed=lines)
                    yield doc_id, key, min(hashes[s : s + lines]) ^ lines, [{"start": s, "lines": lines, "hash": joined}]

    return map_rows(keyed, make, FINGERPRINTS, weigh=lambda row: 40 * len(row[3]))


def repeated_windows(documents: DataFrame, run: int, least_words: int, tables: RunTables) -> DataFrame:
    """(doc_id, row_key, start, lines) of each window that occurs at an earlier place too."""
    prints = tables.write(_fingerprints(documents, run, least_words), "fingerprints")
    counts = prints.groupBy("fingerprint").agg(F.sum(F.size("windows")).alias("n")).filter("n > 1")
    windows = (
        prints.join(counts.select("fingerprint"), "fingerprint", "left_semi")
        .select("doc_id", "row_key", F.explode("windows").alias("window"))
        .select("doc_id", "row_key", "window.start", "window.lines", "window.hash")
    )
    place = F.struct("doc_id", "row_key", "start")
    earliest = windows.groupBy("hash").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).filter("n > 1")
    return (
        windows.join(earliest, "hash").filter(~place.eqNullSafe(F.col("earliest"))).select("doc_id", "row_key", "start", "lines")
    )


def line_dedup(documents: DataFrame, run: int = 3, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, text without repeated runs, n_lines, n_removed.

    A line is removed if it lies in ``run`` or more consecutive lines, or in fewer that have ``least_words`` words or
    more (between ASCII white space), that occur, in that order, at an earlier place: in a document with a smaller
    doc_id or further up in the same one. The first occurrence of any line stays. A document all of whose
    lines go has an empty text. A null text is one
    empty line and stays null; a null doc_id comes first. Rows that repeat doc_id and text count as
    one document, and each gets its result. An empty table gives no rows. Other columns are not read.
    """
    if run < 1:
        raise ValueError("run must be 1 or more")
    tables = RunTables(documents.sparkSession)
    keyed = id_and_text(documents).withColumn("row_key", F.xxhash64("doc_id", "text"))
    removed = tables.write(
        repeated_windows(keyed, run, least_words, tables).groupBy(F.col("doc_id").alias("id"), F.col("row_key").alias("rk"))
        .agg(F.collect_set(F.struct("start", "lines")).alias("starts")),
        "removed",
    )
    marked = keyed.join(
        removed.hint("shuffle_hash"), (F.col("row_key") == F.col("rk")) & F.col("doc_id").eqNullSafe(F.col("id")), "left"
    ).select("doc_id", "text", "starts")

    def make(batches):
        for batch in batches:
            for doc_id, text, starts in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("starts").to_pylist()):
                lines = (text or b"").split(b"\n")
                gone = {i for w in starts or () for i in range(w["start"], w["start"] + w["lines"])}
                kept = text if not gone else b"\n".join(line for i, line in enumerate(lines) if i not in gone)
                yield doc_id, None if kept is None else kept.decode(), len(lines), len(gone)

    return map_rows(marked, make, "doc_id long, text string, n_lines long, n_removed long", weigh=lambda row: len(row[1] or ""))
