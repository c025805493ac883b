"""Helpers of the Arrow stages: columns as Python bytes, rows as record batches, ids of whole texts."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of a batch that goes back to Spark.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20
#: Pieces of text kept with their ids; the dictionary starts again when it is full.
KEPT_WORDS, KEPT_LENGTH, SHORT_WORD, TEXT_AT_ONCE = 800_000, 64, 9, 1 << 19
#: Marks that may end a word: of ASCII those that are part neither of a contraction nor of a special token's name.
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def text_slices(column: pa.Array, together: int) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first, texts) of consecutive texts that have about ``together`` bytes; no more than these are copied at once."""
    data = column.cast(pa.binary())
    start, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(data), 0).to_pylist()):
        size += n
        if size >= together:
            yield start, data.slice(start, i + 1 - start).to_pylist()
            start, size = i + 1, 0
    if start < len(data):
        yield start, data.slice(start).to_pylist()


#: What this Python worker keeps for all tasks of a stage: one helper at most, by its kind and name.
_kept: dict[tuple, object] = {}


def kept(kind: str, name: str, make):
    """``make()``, once for all tasks of a Python worker until a stage comes that doesn't keep this kind."""
    if (kind, name) not in _kept:
        _kept.clear()
        _kept[kind, name] = make()
    return _kept[kind, name]


def let_go(keeps: str | None) -> None:
    """Lets what an earlier stage kept go, unless it is of the kind that this one keeps: workers outlive stages."""
    if any(kind != keeps for kind, _ in _kept):
        _kept.clear()


def to_batches(rows: Iterable[tuple], schema: pa.Schema, weigh=None) -> Iterator[pa.RecordBatch]:
    """Rows as record batches. ``weigh`` gives the bytes of a row where they vary widely."""
    kept, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(values, field.type) for values, field in zip(zip(*kept), schema)], schema=schema
        )

    for row in rows:
        kept.append(row)
        size += weigh(row) if weigh else 0
        if len(kept) >= OUT_ROWS or size >= OUT_BYTES:
            yield batch()
            kept, size = [], 0
    if kept:
        yield batch()


def map_rows(df: DataFrame, make, ddl: str, weigh=None, keeps: str | None = None) -> DataFrame:
    """``make`` takes the record batches of a partition and yields tuples of the columns in ``ddl``.

    ``keeps`` is the kind of helper that it asks ``kept`` for.
    """

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        let_go(keeps)
        return to_batches(make(batches), schema, weigh)

    return df.mapInArrow(run, ddl)


def id_and_text(documents: DataFrame) -> DataFrame:
    """The two columns that operators on texts read; whatever else there is stays out of their plans."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_key() -> Column:
    """Names a row among those that share a doc_id; rows that repeat doc_id and text share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def without(documents: DataFrame, dropped: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """The rows of ``documents`` that are not in ``dropped`` (doc_id, row_key), all columns as they are.

    Of rows whose id and key are in ``repeated`` one stays; only such rows are moved by their key.
    """
    names, n = [], 0
    while len(names) < 2:  # names that no column has
        names += [f"dropped_{n}"] if f"dropped_{n}" not in documents.columns else []
        n += 1
    same = (row_key() == F.col(names[1])) & F.col("doc_id").cast("long").eqNullSafe(F.col(names[0]))

    def keys(df):
        return df.select(F.col("doc_id").alias(names[0]), F.col("row_key").alias(names[1])).distinct()

    left = documents.join(keys(dropped), same, "left_anti")
    if repeated is None or repeated.isEmpty():
        return left
    again = left.join(keys(repeated), same).dropDuplicates(names).drop(*names)
    return left.join(keys(repeated), same, "left_anti").unionByName(again)


def doc_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, UTF-8 text) of each row, null texts as empty ones."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for start, texts in text_slices(batch.column("text"), TEXT_AT_ONCE):
            for doc_id, text in zip(ids[start:], texts):
                yield doc_id, text or b""


def task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def ends_in_letter(stem: bytes) -> bool:
    """Whether the stem, in lower case, ends in a letter; that of a capital may end in a combining mark, as U+0130's does."""
    last = stem.decode()[-1:].lower()
    return len(last) == 1 and last.isalpha()


class WordIds:
    """Ids of a text, each as four little-endian bytes, from the ids of its white-space-free runs.

    Holds for a tokenizer to which ASCII white space only separates words, as that of the default file;
    one that keeps white space in its tokens is refused.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        probe = "a 1\t' b\n\nc\r.\x0b,\x0c d"
        if self.tokenizer.encode(probe, add_special_tokens=False).ids != [
            i for word in probe.split() for i in self.tokenizer.encode(word, add_special_tokens=False).ids
        ]:
            raise ValueError(f"{tokenizer_file}: its tokens depend on white space")
        # Whether a mark behind a letter is encoded by itself, and case of no account.
        samples = ["ab.", "é,,", "It's;", "x9y!?", "Σά:", "AbC", *(f"Ab{chr(m)}{chr(m)}" for m in MARKS), f"é{MARKS.decode()}"]
        self.splits_marks = all(
            self._direct(s) == self._direct(s.rstrip(MARKS.decode()).lower()) + self._direct(s[len(s.rstrip(MARKS.decode())) :])
            for s in samples
        )
        # Which ids end a word, for tokenizers that mark it.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, number in self.tokenizer.get_vocab().items():
                self.ends[number] = token.endswith(suffix)

    def _direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_new(self, words: list[bytes]) -> None:
        # Words of letters alone are encoded as one text and told apart by the tokens that end a word: each has
        # one at least, so if there are as many as words, each has one. Otherwise all go one by one.
        plain, others = [], words
        if self.ends is not None:
            others = []
            for word in words:
                letters = word.isalpha() or (not word.isascii() and word.decode().isalpha())
                (plain if letters else others).append(word)
        if plain:
            # of a batch, as that leaves out where each token stands in the text
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(plain) and stops[-1] == len(ids):
                ends = (4 * stops).tolist()
                data = ids.tobytes()
                self.known.update(zip(plain, [data[i:j] for i, j in zip([0, *ends], ends)]))
            else:
                others = words
        words = others
        codes = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        self.known.update((word, array("I", code.ids).tobytes()) for word, code in zip(words, codes))

    def _learn(self, words: set[bytes]) -> None:
        """Adds words; one that ends in a mark behind a letter is the word and the mark, case apart if in ASCII."""
        if not self.splits_marks:
            self._encode_new(list(words))
            return
        known, fresh, made = self.known, set(), []
        for word in words:
            stem, mark = word, b""
            if word[-1] in MARKS:
                stem = word.rstrip(MARKS)
                if ends_in_letter(stem):
                    mark = word[len(stem) :]
                    fresh.add(mark)
                else:
                    stem = word
            if stem.isascii() and not stem.islower() and b"<|" not in stem:
                stem = stem.lower()
            fresh.add(stem)
            if mark or stem != word:
                made.append((word, stem, mark))
        self._encode_new([part for part in fresh if part not in known])
        for word, stem, mark in made:
            known[word] = known[stem] + known[mark] if mark else known[stem]

    def _make_room(self, coming: int) -> None:
        """Forgets long words, which seldom come again; all of them if that isn't enough."""
        if len(self.known) + coming > KEPT_WORDS:
            self.known = {w: ids for w, ids in self.known.items() if len(w) <= SHORT_WORD}
            if len(self.known) + coming > KEPT_WORDS * 3 // 4:
                self.known = {}

    def _ids(self, texts: list[bytes]) -> Iterator[bytes]:
        # bytes split at ASCII white space alone; where case is of no account, words of ASCII texts are known in lower case only
        split = [(text.lower() if self.splits_marks and text.isascii() and b"<|" not in text else text).split() for text in texts]
        words = list(chain.from_iterable(split))
        # each word is looked up once; those that lack are learned together
        found, unknown = list(map(self.known.get, words)), ()
        if None in found:
            gaps = [i for i, ids in enumerate(found) if ids is None]
            unknown = {words[i] for i in gaps}
            self._make_room(2 * len(unknown))
            self._learn(unknown)
            known = self.known
            for i in gaps:
                found[i] = known[words[i]]
        start = 0
        for own in split:
            yield b"".join(found[start : start + len(own)])
            start += len(own)
        for word in unknown:
            if len(word) > KEPT_LENGTH:
                self.known.pop(word, None)

    def encode(self, text: bytes) -> bytes:
        return next(self._ids([text]))

    def encode_all(self, rows: Iterable[tuple[int | None, bytes]]) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) for (doc_id, text), some texts at a time."""
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[1])
            if size >= TEXT_AT_ONCE:
                yield from zip([i for i, _ in held], self._ids([t for _, t in held]))
                held, size = [], 0
        yield from zip([i for i, _ in held], self._ids([t for _, t in held]))


def word_ids(tokenizer_file: str) -> WordIds:
    """One for all tasks of a stage in a Python worker; the stage keeps "ids"."""
    return kept("ids", tokenizer_file, lambda: WordIds(tokenizer_file))


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
