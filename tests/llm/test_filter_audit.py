from collections import defaultdict
from itertools import permutations

import pytest

from prunecluster.llm import filter_audit
from prunecluster.llm.queries import op12_filter_audit

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text + " ":
        if c in WHITE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def failures(rows):
    """The letters that each (doc_id, text, lang) fails."""
    found = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = words_of(text)
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        found.append("".join(letter for letter, fails in (
            ("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)), ("D", any(c in "#$%&*|" for c in text)), ("E", copy),
        ) if fails))
    return found


def audited(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    table = {}
    fails = failures(rows)
    for part in {lang or "" for *_, lang in rows}:
        own = [(i, f) for (i, _, lang), f in zip(rows, fails) if (lang or "") == part]
        removed_by = defaultdict(int)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                here = [(i, f) for i, f in left if letter in f]
                gone = [x for x in own if set(x[1]) & set(order[: step - 1])]
                left = [(i, f) for i, f in left if letter not in f]
                removed_by[letter] += len(here)
                table[part, "".join(order), step] = [
                    len(left), len(here), sum(letter in f for _, f in gone), sum(f == letter for _, f in own),
                    sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), letter,
                ]
        for (p, _, _), values in table.items():
            if p == part:
                values[-1] = removed_by[values[-1]]
    return {k: tuple(v) for k, v in table.items()}


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (2, LONG, "en"), (1, LONG, "fr"),
    (4, "one two", "en"), (5, None, None), (6, "", "en"), (7, "", None), (None, LONG, "en"), (None, LONG, "en"), (None, None, None),
    (8, "UP " * 300, "de"), (9, LONG + " a|b", "de"), (10, "é\x0bÀ\x0cü\x1cx", "fr"), (11, "same " * 250, "en"), (12, "same " * 250, "fr"),
    (13, LONG + " x y", "en"), (14, LONG + " Ä" * 40, "en"), (15, "word " * 200_000, "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, 1, 1), (None, 1, 1), (9, None, 1), (99, 1, 1), (11, 1, 0)]
COUNTED = (*filter_audit.COUNTS, "shapley")


def answer(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTED) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("partitions", [1, 5])
def test_equals_brute_force(spark, partitions):
    full = [(i, t, lang, 0, 1, True) for i, t, lang in ROWS]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, n int, mask int, good boolean").repartition(partitions)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert answer(filter_audit.filter_audit(docs, labels)) == audited(ROWS, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    assert answer(filter_audit.filter_audit(one, labels)) == audited(ROWS, [])


def test_other_rules(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "bb", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.filter_audit(docs, labels, lambda t: {"L": F.length(t) > 1}, "C").collect()
    found = {(r.filter_order, r.step): (r.filter, r.kept, r.removed, r.shapley) for r in rows}
    assert found == {
        ("CL", 1): ("C", 2, 1, 2), ("CL", 2): ("L", 1, 1, 2), ("LC", 1): ("L", 2, 1, 2), ("LC", 2): ("C", 1, 1, 2),
    }


def test_query_counts_all_documents(spark, small):
    rows = op12_filter_audit(spark, small).where("filter_order = 'ABCDE'").collect()
    documents = spark.read.parquet(f"{small}/documents.parquet").count()
    assert sum(r.kept + r.removed for r in rows if r.step == 1) == documents
    lost = sum(r.removed for r in rows) + sum(r.kept for r in rows if r.step == 5)
    assert lost == documents
