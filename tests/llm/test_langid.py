import itertools
import math
import zlib

import numpy as np
import pytest

from prunecluster.llm import langid as g

VOCABULARY = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab", "c"]


def all_ways(word, weights):
    """Sum over all segmentations, by enumeration of the cuts."""
    total = np.zeros(weights.shape[1])
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, part = [], word[0]
        for cut, char in zip(cuts, word[1:]):
            if cut:
                parts.append(part)
                part = char
            else:
                part += char
        parts.append(part)
        if all(p in VOCABULARY or len(p) == 1 for p in parts):
            total += np.prod([weights[VOCABULARY.index(p)] if p in VOCABULARY else np.full(weights.shape[1], g.STRAY) for p in parts], axis=0)
    return total


@pytest.fixture
def weights():
    w = np.random.default_rng(0).random((len(VOCABULARY), 3))
    return w / w.sum(axis=0)


def test_forward_sums_all_segmentations(weights):
    words = ["a", "b", "abab", "babab", "ac", "xay", "bbbb", "cab", "é"]
    found = g.forward(g.Pieces(VOCABULARY), weights, words)
    for word, row in zip(words, found):
        assert np.allclose(row, np.log(all_ways("▁" + word, weights)))


def test_long_words_do_not_vanish(weights):
    row = g.forward(g.Pieces(VOCABULARY), weights, ["ab" * 3000])[0]
    half = g.forward(g.Pieces(VOCABULARY), weights, ["ab" * 1500])[0]
    assert np.isfinite(row).all() and np.allclose(row / half, 2, rtol=0.01)
    uses = g.expected(g.Pieces(VOCABULARY), weights, ["ab" * 300], np.array([1]), np.array([1.0]))
    size = np.array([len(v) for v in VOCABULARY])
    assert math.isclose((uses[:, 1] * size).sum(), 601, rel_tol=1e-6)


def test_expected_uses(weights):
    words, times = ["abab", "bab", "cab"], np.array([2.0, 1.0, 5.0])
    language = np.array([0, 2, 0])
    found = g.expected(g.Pieces(VOCABULARY), weights, words, language, times)
    # The derivative of the log of a sum by the log of a probability is the expected number of uses.
    for piece in range(len(VOCABULARY)):
        for lang in range(3):
            step = 1e-6
            more = weights.copy()
            more[piece, lang] *= math.exp(step)
            change = [
                t * (np.log(all_ways("▁" + w, more)[lang]) - np.log(all_ways("▁" + w, weights)[lang]))
                for w, t, l in zip(words, times, language) if l == lang
            ]
            assert math.isclose(sum(change) / step, found[piece, lang], abs_tol=1e-4)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out int")


def test_predictions_and_odd_rows(spark):
    texts = {"en": "the house and the garden were there with them", "de": "das haus und der garten waren dort mit ihnen zu sehen"}
    rows = [(i, t, l, None, 1) for i in range(60) for l, t in texts.items()]
    rows += [(200, None, "en", None, 1), (201, "12 34 !?", "en", None, 1), (202, "", None, None, 1), (203, "Und das Haus", None, "z", 1), (None, "the garden", "en", None, 1), (204, "漢字", "en", None, 1)]
    docs = frame(spark, rows).repartition(3)
    found = g.language_id(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "de", "en"]
    assert by_id[204].lang_pred in texts and all(0 <= r.score <= 1 for r in found)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    kept = g.keep_languages(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {203, None, *range(60)}
    assert not {r.doc_id for r in kept.collect()} & {200, 201, 202}


def test_held_out_rows_teach_nothing(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = frame(spark, [(i, "aaa bbb", "xx", None, 1) for i in held] + [(1, "aaa", None, None, 1), (3, None, "yy", None, 1)])
    assert {r.lang_pred for r in g.language_id(docs).collect()} == {"und"}
    assert g.language_id(docs.limit(0)).count() == 0


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = g.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_a_worker_keeps_what_one_stage_needs():
    import pyarrow as pa

    from prunecluster.llm import batches as b

    model = g.Model(["x", "y"], VOCABULARY, np.full((len(VOCABULARY), 2), 1 / len(VOCABULARY)))
    b.word_ids(b.public_tokenizer())
    list(model.predict([b"ab ba"]))
    assert [kind for kind, _ in b._kept] == ["language"]
    scorer = b._kept["language", model.name]
    b.let_go("language")
    list(model.predict([b"ab"]))
    assert b._kept == {("language", model.name): scorer}
    b.let_go(None)
    assert not b._kept
    column = pa.array(["x" * n if n else None for n in [3, 0, 9, 1, 1, 30]])
    found = list(b.text_slices(column, 10))
    assert found == [(0, [b"xxx", None, b"x" * 9]), (3, [b"x", b"x", b"x" * 30])]
    assert list(b.text_slices(column.slice(4), 10)) == [(0, [b"x", b"x" * 30])] and not list(b.text_slices(column[:0], 10))
