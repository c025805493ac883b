import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from prunecluster.llm import batches, packing, token_file
from prunecluster.llm.batches import WordIds, public_tokenizer

ROWS = [
    (3, "Hello, world!"), (1, None), (2, ""), (5, "a b" * 3000), (4, "Émile's  café\n\t10 <|endoftext|> x"),
    (7, "Hello, world!"), (8, "x"), (9, "日本語 é   \x1c y"), (10, "word " * 2047), (11, "word " * 2048),
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizer())


@pytest.fixture(scope="module")
def words():
    return WordIds(public_tokenizer())


#: Letters whose lower case is several characters, or that join or take marks; all marks that are cut off; both sigmas.
ODD = "aAzZ é\n\t\r\x0b\x1c\x85 \u0301\u0307\u0130\u0131\u01c5\u1e9e\ufb01\u0345\u212a'sS1,.;:!?<|>\uff45\u03a3\u03c2-"


@settings(deadline=None, max_examples=600)
@given(st.text(alphabet=st.sampled_from(list(ODD)), max_size=30))
def test_ids_of_words_are_ids_of_the_text(text):
    own = test_ids_of_words_are_ids_of_the_text
    if not hasattr(own, "pair"):
        own.pair = WordIds(public_tokenizer()), Tokenizer.from_file(public_tokenizer())
    words, tokenizer = own.pair
    ids = np.frombuffer(words.encode(text.encode()), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_capital_whose_small_letter_ends_in_a_mark(words, tokenizer):
    for text in ("AK\u0130.", "\u00d6ZET\u0130: a", "\u0130!\u0130", "a\u0130\u0307?", "\u0130;\u0130:"):
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == ids_of(tokenizer, text, 0)[:-1]


def test_learning_and_forgetting_in_turn(monkeypatch, tokenizer):
    monkeypatch.setattr(batches, "KEPT_WORDS", 40)
    monkeypatch.setattr(batches, "TEXT_AT_ONCE", 60)
    rng, known = np.random.default_rng(5), WordIds(public_tokenizer())
    texts = [" ".join(f"Word{rng.integers(60)}{m}" for m in rng.choice(["", ".", "!?", "\u0130."], 12)) for _ in range(40)] + ["", "x" * 500]
    for i, ids in known.encode_all(enumerate(t.encode() for t in texts)):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(tokenizer, texts[i], 0)[:-1]


def ids_of(tokenizer, text, end):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_packing(make_docs, tokenizer):
    rows = packing.pack_documents(make_docs(ROWS), public_tokenizer()).collect()
    want = {}
    for i, text in ROWS:
        ids = ids_of(tokenizer, text, 0)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[i, piece] = (start, len(part), crc(part))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    check_places([(r.sequence_id, r.offset, r.length) for r in rows], 2048)


def check_places(places, capacity):
    by_sequence = defaultdict(list)
    for sequence, offset, length in places:
        by_sequence[sequence].append((offset, length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def best_fit(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(capacity - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
    rows, opened = packing.plan_slots(Counter(lengths), capacity)
    places = [
        (sequence + i // each, offset + i % each * length, length)
        for length, first, n, sequence, each, offset in rows for i in range(n)
    ]
    assert Counter(p[2] for p in places) == Counter(lengths)
    ranks = defaultdict(list)
    for length, first, n, *_ in rows:
        ranks[length].extend(range(first, first + n))
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    assert check_places(places, capacity) == opened == best_fit(lengths, capacity)


def test_plan_does_not_grow_with_counts():
    few = {n: 10 for n in range(1, 129)}
    many = {n: 10_000_000 for n in range(1, 129)}
    assert len(packing.plan_slots(many, 128)[0]) < 4 * len(packing.plan_slots(few, 128)[0])


def test_repeated_and_null_ids(make_docs):
    rows = packing.pack_documents(make_docs([(1, "a"), (1, "a"), (None, "b")]), public_tokenizer()).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]
    assert packing.pack_documents(make_docs([(1, "a")]).limit(0), public_tokenizer()).count() == 0


def test_token_files(make_docs, tokenizer):
    rows = sorted(token_file.token_output(make_docs(ROWS), public_tokenizer()).collect(), key=lambda r: r.doc_id)
    at = 0
    for row, (i, text) in zip(rows, sorted(ROWS)):
        ids = ids_of(tokenizer, text, 1)
        assert tuple(row) == (i, at, len(ids), crc(ids))
        at += len(ids)
    assert len(rows) == len(ROWS)


def test_token_files_with_repeated_and_null_ids(make_docs):
    docs = make_docs([(2, "a b c"), (2, "d"), (None, "e"), (1, None)])
    rows = sorted(token_file.token_output(docs, public_tokenizer()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert token_file.token_output(docs.limit(0), public_tokenizer()).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bits_and_random_access(tmp_path, bits):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4") for n in (0, 5, 100, 1, 0, 37)]
    system, path = fs.LocalFileSystem(), str(tmp_path / "t.ids")
    with system.open_output_stream(path) as sink:
        writer = token_file.TokenWriter(sink, bits, block_ids=16)
        for i, ids in enumerate(docs):
            writer.add(i or None, ids)
        writer.close()
    with system.open_input_file(path) as source:
        file = token_file.TokenFile(source)
        everything = np.concatenate(docs)
        assert file.ids(0, len(everything)).tolist() == everything.tolist()
        for start in range(0, 130, 7):
            assert file.ids(start, 9).tolist() == everything[start : start + 9].tolist()
        assert [file.document(n).tolist() for n in range(6)] == [d.tolist() for d in docs]
        assert [(i, n, c) for i, _, n, c in file.checksums()] == [
            (i or None, len(d), zlib.crc32(d.tobytes())) for i, d in enumerate(docs)
        ]
        assert int(file.offsets[1]) == 16 * bits // 8


def test_bits_of_vocabularies():
    assert [token_file.id_bits(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]
    with pytest.raises(ValueError):
        token_file.TokenWriter(None, 3).add(1, np.array([8], "<u4"))


def test_words_are_solved_once_whatever_marks_end_them():
    words, solved = WordIds(public_tokenizer()), []
    real = words._encode_new
    words._encode_new = lambda new: solved.extend(new) or real(new)
    texts = [b"Gredle### gredle,*** GREDLE gredle", "Gredle&&& grédle%% Grédle. gredle".encode()]
    for text, (_, ids) in zip(texts, words.encode_all(enumerate(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == words.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    assert sorted(solved) == sorted([b"gredle", b"###", b",***", b"&&&", b"%%", b".", "grédle".encode(), "Grédle".encode()])


def test_words_with_marks_have_the_ids_of_the_tokenizer():
    words = WordIds(public_tokenizer())
    marks = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
    stems = ["ab", "Ab", "AB's", "it'S", "x9", "9", "éA", "İ", "Å", "Σ", "a<|endoftext|>", "<|EndOfText|>", "<|", "a|", "中"]
    ends = marks + [a + b for a in marks for b in "'!<|>#s_"] + ["'s###", "###'s", "|>...", "...'ll", "̸="]
    for text in [s + e for s in stems for e in ends]:
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text
