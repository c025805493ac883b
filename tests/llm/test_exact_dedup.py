import hashlib
from collections import defaultdict

import numpy as np
import pytest

from prunecluster.llm import exact_dedup as e

ROWS = [
    (1, "Same text"), (2, "same TEXT"), (3, "same text "), (4, None), (5, ""), (6, "ÀB"), (7, "àb"), (8, "Àb"),
    (9, "long " * 40_000), (10, "LONG " * 40_000), (11, "long " * 39_999 + "lonG!"), (12, "x"), (12, "x"), (13, "y"),
]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lowered(text)].append(i)
    return sorted(
        (i, max(groups[b]), len(groups[b]), i == max(groups[b]), hashlib.sha256(b.encode()).hexdigest())
        for i, b in ((i, lowered(t)) for i, t in rows)
    )


def test_against_grouping(make_docs):
    assert sorted(map(tuple, e.exact_dedup(make_docs(ROWS)).collect())) == expected(ROWS)


def test_texts_decide_where_fingerprints_collide(make_docs, monkeypatch):
    # At the point 1 a polynomial is the sum of the bytes: anagrams collide.
    monkeypatch.setattr(e, "SHARE_ROWS", 2)
    rows = [(i, t) for i, t in enumerate(["abc", "bca", "cab", "ABC", "bca", "acb", "zzz", "cab", "abc", "abc"])]
    assert sorted(map(tuple, e.exact_dedup(make_docs(rows), points=(1,)).collect())) == expected(rows)


def test_null_ids_and_empty_table(make_docs):
    rows = e.exact_dedup(make_docs([(None, "a"), (None, "a"), (None, "b"), (3, "B")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows) == [
        (0, 0, 2, True), (0, 0, 2, True), (0, 3, 2, False), (3, 3, 2, True),
    ]
    assert e.exact_dedup(make_docs([(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("cut", [0, 1, 7, 8192, 8193, 20_000])
def test_fingerprints_compose(cut):
    data = np.random.default_rng(4).integers(0, 256, 20_001, dtype=np.uint8).tobytes()
    table = e.powers()
    whole = e.fingerprint(data, table)
    assert e.combine(e.fingerprint(data[:cut], table), e.fingerprint(data[cut:], table)) == whole
    direct = tuple(sum(b * pow(p, i, e.MODULUS) for i, b in enumerate(data[:500])) % e.MODULUS for p in e.POINTS)
    assert e.fingerprint(data[:500], table) == (direct, 500)


def test_drop_copies_keeps_columns(make_docs):
    docs = make_docs(ROWS)
    kept = e.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({r[0] for r in expected(ROWS) if r[3]})


def test_drop_copies_goes_by_row(make_docs):
    docs = make_docs([(5, "a"), (9, "A"), (5, "b"), (None, "c"), (4, "c"), (None, "d")]).withColumnRenamed("source", "dropped_0")
    kept = e.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "d"), (4, "c"), (5, "b"), (9, "A")]
