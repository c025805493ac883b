import random
import re

import pytest

from prunecluster.llm import licenses
from prunecluster.llm.licenses import BASE, NOTICES, Index, Rule, digest, scan_licenses

LETTERS = dict(zip(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "abcdefghijklmnopqrstuvwxyz"))


def words_of(text):
    return re.findall(licenses.WORDS, (text or "").translate(LETTERS))


def brute(texts, rules, least=licenses.LEAST_SHARE):
    """(n_words, places) of each text, every rule tried at every place."""
    split = [words_of(t) for t in texts]
    vocabulary = {w for r in rules for w in r.words}
    weight = {w: max(1, (len(texts) // max(1, sum(w in s for s in split))).bit_length()) for w in vocabulary}
    answers = []
    for words in split:
        found = []
        for rule in rules:
            own, needed = rule.words, rule.required
            total = sum(weight[w] for w in own)
            for start in range(-len(own) + 1, len(words)):
                same = [0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(own)]
                share = sum(weight[w] for w, s in zip(own, same) if s)
                if all(s for s, n in zip(same, needed) if n) and 100 * share >= least * total:
                    found.append((start, rule.label, rule.base, len(own), share / total))
        answers.append((len(words), sorted(found)))
    return answers


def scanned(df):
    return sorted(
        ((r.doc_id, r.n_words, sorted((p.first_word, p.label, p.base, p.n_words, p.share) for p in r.places)) for r in df.collect()),
        key=repr,
    )


TEXTS = [
    None, "", " \n\t", "Released under the MIT License.", "under the mit license under the MIT-license",
    "Licensed under the Apache License, Version 2.0 (the 'License'); you may not use this file except in compliance with the License.",
    "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0, cc_by_nc! CC\x00BY\x7fNC", "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "permission is hereby denied, free of charge, to any person",
    "a creative commons attribution ShareAlike 4 0 international licence", "éCC by nc", "İcc by nc", "cc by ncé", "the license " * 50, "words of no licence at all", "cc by cc by nc cc by nc",
    "apache license version 2 0 the license you may not", "GNU Lesser General Public License", "x " * 3000 + "cc by nc " + "y " * 3000 + "under the mit license",
]


@pytest.mark.parametrize("at_once", [1, 7, 64, 1 << 20])
def test_equals_every_rule_at_every_place(at_once, monkeypatch):
    monkeypatch.setattr(licenses, "TEXT_AT_ONCE", at_once)
    rules = BASE + NOTICES
    vocabulary = {w for r in rules for w in r.words}
    split = [words_of(t) for t in TEXTS]
    weights = {w: max(1, (len(TEXTS) // max(1, sum(w in s for s in split))).bit_length()) for w in vocabulary}
    index = Index(rules, weights)
    for text, (n_words, places) in zip(TEXTS, brute(TEXTS, rules)):
        n, found = index.places((text or "").encode())
        assert n == n_words
        assert sorted((at, rules[r].label, rules[r].base, len(rules[r].words), share) for at, r, share in found) == places


def test_random_words(spark, make_docs):
    rng = random.Random(4)
    rules = (Rule("a", "x y x", True), Rule("b", "[x y] z x [w]"), Rule("c", "z", True), Rule("d", "x x x x [w] x x x"))
    texts = [" ".join(rng.choice("xyzw!") for _ in range(rng.randrange(60))) for _ in range(150)]
    docs = make_docs(list(enumerate(texts)))
    expected = sorted(((i, n, places) for i, (n, places) in enumerate(brute(texts, rules))), key=repr)
    assert scanned(scan_licenses(docs, rules)) == expected
    assert any(places for _, _, places in expected)


def test_odd_rows(spark, make_docs):
    rows = [(None if i % 5 == 4 else i // 2, t) for i, t in enumerate(TEXTS)]
    answers = brute(TEXTS, BASE + NOTICES)
    expected = sorted(((i, n, places) for (i, _), (n, places) in zip(rows, answers)), key=repr)
    assert scanned(scan_licenses(make_docs(rows))) == expected
    assert scan_licenses(make_docs([])).count() == 0
    assert digest(scan_licenses(make_docs([]))).count() == 0


def test_digest(spark, make_docs):
    rows = {r.doc_id: r for r in digest(scan_licenses(make_docs(list(enumerate(TEXTS))))).collect()}
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].labels, rows[0].score) == (0, 0, None, "", 0.0)
    assert (rows[4].n_base, rows[4].first_word, rows[4].last_word, rows[4].base_labels) == (2, 0, 4, "mit")
    assert rows[7].n_base == 3 and rows[7].score == 1.0
    assert (rows[8].n_base, rows[8].base_labels, rows[8].labels) == (0, "", "gpl-3")
    assert rows[13].n_base == 0 and rows[12].n_base == 0 and rows[14].n_base == 0  # a letter beyond ASCII belongs to the word
    assert rows[16].labels == "" and rows[15].labels == ""
    assert rows[20].base_labels == "cc-by-nc,mit" and rows[20].last_word == 6003


def test_a_very_long_text(spark, make_docs, monkeypatch):
    text = "word of text " * 400_000 + "Licensed under CC BY-NC 4.0."
    row = digest(scan_licenses(make_docs([(1, text), (2, "a")]))).where("doc_id = 1").first()
    assert (row.n_words, row.n_base, row.first_word) == (1_200_007, 1, 1_200_002)
