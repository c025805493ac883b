import re

import numpy as np
import pytest
import xxhash

from prunecluster.llm import simhash as s
from prunecluster.llm.components import components
from prunecluster.storage import RunTables


def slow_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, most=2):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if bin(prints[i] ^ prints[j]).count("1") <= most and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_the_code_is_perfect():
    table = s.error_patterns()
    assert len(np.unique(table)) == 2048
    words = np.random.default_rng(0).integers(0, 1 << 23, 500)
    assert (s.syndrome(words ^ table[s.syndrome(words)]) == 0).all()


def test_keys_of_all_neighbours_meet():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 1 << 63, 30, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for value in own[:5]:
        near = [value] + [value ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(64) for b in range(a)]
        near += [value ^ np.uint64(1 << a) for a in range(64)]
        rows, keys = s.golay_keys(np.array(near, np.uint64))
        base = set(keys[rows == 0].tolist())
        assert all(base & set(keys[rows == r].tolist()) for r in range(1, len(near)))
    rows, _ = s.golay_keys(own)
    assert np.bincount(rows).max() <= 16


ROWS = [
    (10, "The cat sat on the mat and then it went home again to sleep"), (11, "the CAT sat on\tthe mat and then it went home again to sleep"),
    (2, None), (3, ""), (4, " \n\t"), (5, "one"), (6, "one two"), (7, "ONE  two"), (8, "é x y z"), (9, "word " * 5000), (12, "word " * 5001),
]


def test_against_all_pairs(make_docs):
    rows = s.simhash_dedup(make_docs(ROWS)).collect()
    prints = {i: slow_print(t) for i, t in ROWS}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    ids = sorted(prints)
    label = slow_components([prints[i] for i in ids])
    assert {r.doc_id: r.component_id for r in rows} == {i: ids[l] for i, l in zip(ids, label)}
    kept = s.drop_near_copies(make_docs(ROWS), tables=1)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({ids[l] for l in label})


@pytest.mark.parametrize("hot_key", [1, 3, 4096])
def test_links_of_crowded_keys(spark, hot_key):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 6)
    values = {int(b) for b in base}
    for b in base:
        for _ in range(40):
            v = int(b)
            for bit in rng.choice(62, rng.integers(1, 6), replace=False):
                v ^= 1 << int(bit)
            values.add(v)
    values = sorted(values)
    run = RunTables(spark)
    frame = spark.createDataFrame([(v,) for v in values], "print long")
    links = s.near_prints(frame, run, 2, hot_key)
    found = {r.node: r.component for r in components(links, run).collect()}
    label = slow_components(values)
    assert {v: found.get(v, v) for v in values} == {v: values[l] for v, l in zip(values, label)}


def test_null_ids_and_empty_table(make_docs):
    rows = s.simhash_dedup(make_docs([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "q r s")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.print_rows) for r in rows) == [(0, 0, 1), (0, 4, 3), (4, 4, 3), (4, 4, 3)]
    assert s.simhash_dedup(make_docs([(1, "a")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        s.near_prints(None, None, most=3)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    label = {n: n for e in links for n in e if e[0] != e[1]}
    for _ in range(len(label)):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert {r.node: r.component for r in components(frame, RunTables(spark)).collect()} == label


def test_drop_near_copies_goes_by_row(make_docs):
    kept = s.drop_near_copies(make_docs([(5, "a b c"), (2, "A b  c"), (5, "q r s"), (None, "a b c")]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "A b  c"), (5, "q r s")]


def test_several_tables_against_all_pairs(make_docs):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(12):
        text = list(rng.choice(words, 150))
        for copy in range(4):
            for place in rng.choice(150, copy, replace=False):
                text[place] = "changed"
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, " ".join(rng.choice(words, 150))) for i in range(20)]
    prints = [s.fingerprints(t.encode(), tables=5) for _, t in rows]
    assert [p[0] for p in prints] == [slow_print(t) for _, t in rows]
    label, changed = list(range(len(rows))), True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                near = any(bin(a ^ b).count("1") <= 2 for a, b in zip(prints[i], prints[j]))
                if near and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    found = s.simhash_dedup(make_docs(rows), tables=5).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(label))
    assert len(set(label)) < len(rows) - 12 and set(label[-20:]) == set(range(len(rows) - 20, len(rows)))


def slow_share(a, b):
    own = []
    for text in (a, b):
        words = text.split()
        own.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    return len(own[0] & own[1]) / len(own[0] | own[1])


def edited(rng, words, group, size, copies, most):
    """Copies of a text, each with some words changed, and the text itself."""
    text = [f"g{group}-{w}" for w in rng.choice(words, size)]
    yield " ".join(text)
    for copy in range(copies):
        own = list(text)
        for place in rng.choice(size, rng.integers(1, most), replace=False):
            own[place] = f"changed{group}-{copy}-{place}"
        yield " ".join(own)


@pytest.mark.parametrize("few", [0, 3, 32])
def test_near_copies_against_all_shares_of_shingles(make_docs, monkeypatch, few):
    monkeypatch.setattr(s, "FEW", few)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(500)]
    texts = [t for g in range(25) for t in edited(rng, words, g, 200, 4, 9)]
    label, near, changed = list(range(len(texts))), [], True
    for i in range(len(texts)):
        near += [(i, j) for j in range(i) if slow_share(texts[i], texts[j]) >= 0.8]
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    kept = s.drop_near_copies(make_docs(list(enumerate(texts))))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert 25 < len(set(label)) < len(texts) - 25


def test_share_of_shingles_counts_sets():
    sets = [s.shingle_set(t) for t in (b"a b c d e f g h i", b"A b c d\te f g h i", b"a b c d e f g h", b"a b", b"")]
    assert [len(x) for x in sets] == [5, 5, 4, 1, 0]
    assert s.are_near(sets[0], sets[1]) and s.are_near(sets[0], sets[2]) and not s.are_near(sets[3], sets[4])
    assert s.band_keys(sets[0]) == s.band_keys(sets[1]) and len(set(s.band_keys(sets[0]))) == s.BANDS


def components_of(texts, least=0.8):
    near, label, changed = [], list(range(len(texts))), True
    for i in range(len(texts)):
        near += [(i, j) for j in range(i) if slow_share(texts[i], texts[j]) >= least]
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label, near


def test_a_large_group_of_copies_costs_few_pairs(spark, make_docs, monkeypatch):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(900)]
    texts = list(edited(rng, words, 0, 150, 220, 5))
    label, near = components_of(texts)
    looked = []
    real = s._near
    monkeypatch.setattr(s, "_near", lambda pairs, *rest: looked.append(pairs.count()) or real(pairs, *rest))
    kept = s.drop_near_copies(make_docs(list(enumerate(texts))))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    # a pair for each row and band at most, and far fewer than the pairs that are near
    assert sum(looked) < 10 * len(texts) < len(near)


def test_a_passage_in_many_texts_makes_no_pairs(make_docs, monkeypatch):
    rng = np.random.default_rng(13)
    passage = " ".join(f"p{i}" for i in range(110))
    texts = [passage + " " + " ".join(f"own{n}-{i}" for i in range(int(rng.integers(35, 50)))) for n in range(300)]
    looked = []
    real = s._near
    monkeypatch.setattr(s, "_near", lambda pairs, *rest: looked.append(pairs.count()) or real(pairs, *rest))
    assert s.drop_near_copies(make_docs(list(enumerate(texts)))).count() == 300
    assert sum(looked) < 20 * 300 and looked[1] == 0


def test_copies_far_from_the_text_but_not_from_each_other_make_few_pairs(make_docs, monkeypatch):
    monkeypatch.setattr(s, "FEW", 8)
    rng = np.random.default_rng(14)
    text = [f"g{w}" for w in range(150)]
    texts = [" ".join(text)]
    for copy in range(240):  # three to four changes: at the edge of what is near the text
        own = list(text)
        for place in rng.choice(150, rng.integers(3, 5), replace=False):
            own[place] = f"changed{copy}-{place}"
        texts.append(" ".join(own))
    # chains beside it: some are near a copy that is near the text, or one that is not, and not near the text
    for copy in rng.choice(range(1, 241), 12, replace=False):
        own = texts[copy].split()
        own[int(rng.integers(150))] = f"again{copy}"
        texts.append(" ".join(own))
    label, near = components_of(texts)
    looked = []
    real = s._near
    monkeypatch.setattr(s, "_near", lambda pairs, *rest: looked.append(pairs.count()) or real(pairs, *rest))
    kept = s.drop_near_copies(make_docs(list(enumerate(texts))))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    outside = sum(1 for x in label if x != label[0])
    assert outside > 40 and looked[1] < 4 * len(texts)
