import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prunecluster.llm import pieces as p


@pytest.fixture(scope="module")
def lattice():
    return p.Lattice(p.public_model())


def slow(lattice, text):
    """Best score and segmentation by positions, longest last piece first, without words or chunks."""
    text = p.SPACE + text.replace(" ", p.SPACE)
    best, cut = [0], [0]
    for end in range(1, len(text) + 1):
        ways = []
        for start in range(end):
            piece = text[start:end]
            if piece in lattice.score:
                ways.append((best[start] + lattice.score[piece], -start))
            elif len(piece) == 1:
                ways.append((best[start] + lattice.stray, -start))
        score, start = max(ways)
        best.append(score)
        cut.append(-start)
    ids, end = [], len(text)
    while end:
        piece = text[cut[end] : end]
        ids[:0] = [lattice.number[piece]] if piece in lattice.number else [lattice.bytes[b] for b in piece.encode()]
        end = cut[end]
    return ids


def chunked(lattice, text, size):
    t, k = p.SPACE + text.replace(" ", p.SPACE), lattice.longest
    parts = [p.Chunk(lattice, t[s : s + size + k - 1], min(size, len(t) - s)) for s in range(0, len(t), size)]
    scores, entered = np.full((1, k), p.NEVER, np.int64), []
    scores[0, 0] = 0
    for part in parts:
        entered.append(scores[0].tolist())
        scores = p.combine(scores, np.array(part.matrix(), np.int64).reshape(k, k))
    state, ids = 0, []
    for part, own in zip(reversed(parts), reversed(entered)):
        ids.insert(0, part.ids(own, state))
        state = part.entries(own)[state]
    return b"".join(ids)


TEXTS = ["the death of the theory", "  two  spaces ", "\n\tx", "日本語テスト", "½ ﬁ é", "ab" * 60, "the" * 40, " " * 50, "x"]


@pytest.mark.parametrize("text", TEXTS)
def test_whole_and_chunks_against_positions(lattice, text):
    want = slow(lattice, text)
    assert np.frombuffer(lattice.encode(text), "<u4").tolist() == want
    for size in (16, 17, 33, 64):
        assert np.frombuffer(chunked(lattice, text, size), "<u4").tolist() == want
    assert lattice.decode(np.array(want, "<u4")).decode() == text


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet=st.sampled_from(list("the anio\n½日")), min_size=1, max_size=80), st.integers(16, 40))
def test_any_text(text, size):
    own = test_any_text
    own.lattice = getattr(own, "lattice", None) or p.Lattice(p.public_model())
    ids = own.lattice.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == slow(own.lattice, text)
    assert chunked(own.lattice, text, size) == ids
    assert own.lattice.decode(np.frombuffer(ids, "<u4")).decode() == text


def test_new_words_are_solved_together(lattice, monkeypatch):
    rng = np.random.default_rng(3)
    letters = list("theandoriné½日\n.,!%A0")
    words = {"".join(rng.choice(letters, n)) for n in rng.integers(1, 40, 400)} | {"x" * 70}
    texts = [" ".join(sorted(words)[i::3]) for i in range(3)]
    fresh, one_by_one = p.Lattice(p.public_model()), []
    own = p.Lattice.solve
    monkeypatch.setattr(p.Lattice, "solve", lambda *given: one_by_one.append(given[1]) or own(*given))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in fresh.encode_all(texts)] == [slow(lattice, t) for t in texts]
    assert one_by_one == [p.SPACE + "x" * 70]
    for word, total in fresh.total.items():
        assert total == own(lattice, word, {0: 0}, len(word))[0][-1]


def test_matrices_combine_in_any_grouping(lattice):
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((5, 5)) < 0.3, p.NEVER, rng.integers(-99, 0, (5, 5))) for _ in range(3))
    assert (p.combine(p.combine(a, b), c) == p.combine(a, p.combine(b, c))).all()


@pytest.mark.parametrize("a,b", [(b"", b"x"), (b"x", b""), (b"hello ", b"world" * 999)])
def test_crc_of_neighbours(a, b):
    assert p.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


ROWS = [(1, "Hello there, the theory"), (2, None), (3, ""), (4, "word " * 3000), (4, "word " * 3000), (5, "nospace" * 400), (None, "a b"), (6, "▁"), (7, "x"), (7, "x")]


def test_documents(make_docs, lattice):
    docs = make_docs(ROWS)
    found = p.round_trip(docs, p.public_model(), size=1000).collect()
    want = sorted(
        (i or 0, len(ids) // 4, zlib.crc32(ids), t != "▁") for i, t in ROWS for ids in [lattice.encode(t or "")]
    )
    assert sorted((r.doc_id or 0, r.n_ids, r.ids_crc32, r.same) for r in found) == want
    assert all(r.text_crc32 == zlib.crc32((t or "").encode()) for r in found for i, t in ROWS if i == r.doc_id and r.same)
    assert p.round_trip(docs.limit(0), p.public_model()).count() == 0


def test_decode_gives_the_text(make_docs):
    docs = make_docs([(1, "Hello  there ½\n"), (2, "the theory " * 300)])
    rows = p.decode(p.encode(docs, p.public_model(), size=256), p.public_model()).collect()
    text = {}
    for r in sorted(rows, key=lambda r: r.chunk):
        text[r.doc_id] = text.get(r.doc_id, "") + r.text
    assert text == {1: "Hello  there ½\n", 2: "the theory " * 300} and len(rows) > 10
