"""SentencePiece encoding as a max-plus scan, and decoding.

A text is segmented into the pieces of a model so that the sum of their scores is largest (ties: the
longer last piece). A piece spans at most K characters, so all that a chunk of a text need know of
the text before it is how far the last piece reaches into it: K states. A chunk's best scores from each
state at its start to each state at its end are a K x K matrix over (max, +). Matrices are
combined in order, which gives each chunk its entry scores; each chunk then says from which state
it is entered for each state it may be left in, these maps are followed from the end, and every chunk
is traced back by itself. No piece holds a word's end and the next one's start, so within a chunk
everything between its first and last start of a word is the sum of its words, each solved once
and remembered. Documents of one chunk need no matrices.

The model is read as a unigram lattice, whatever it was made for: pieces, scores, byte pieces for characters
without a piece, a space in front of the text. Text comes back from decoding as it was (but for the
sign that stands for a space in pieces, which becomes one).
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import partial
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunecluster.llm.batches import as_bytes, id_and_text, kept, text_slices
from prunecluster.llm.batches import map_rows as map_rows_of
from prunecluster.storage import RunTables

SPACE = "▁"
#: Characters of a chunk; words and ids that are remembered; lowest score of all.
CHUNK, KEPT_WORDS, KEPT_LENGTH, SHORT_WORD, NEVER = 1 << 15, 500_000, 64, 9, -(1 << 62)
#: Bytes of texts encoded together; fewest words that are solved together, and most.
TEXT_AT_ONCE, FEW_WORDS, WORDS_AT_ONCE = 1 << 19, 48, 4096
MARKS = ".,;:!?"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
STARTS = re.compile(f"(?<=[^{SPACE}]){SPACE}")
ENCODED = "doc_id long, row_key long, copies long, source_crc long, chunk long, chunks long, ids binary"
#: Polynomial of crc32, lowest power in the highest bit.
CRC_POLYNOMIAL = 0xEDB88320


map_rows = partial(map_rows_of, keeps="lattice")


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Steps:
    """Best segmentations of many words at once: ``Lattice.solve`` for all words together, position by position.

    Beginnings of pieces are numbered; a step leads from one to the next by a character.
    """

    def __init__(self, lattice: "Lattice"):
        starts = sorted(lattice.begins)  # each behind its own beginning
        number = {start: i + 1 for i, start in enumerate(starts)} | {"": 0}
        chars = sorted({start[-1] for start in starts})
        self.width = len(chars) + 1
        self.code = np.zeros(0x110000, np.int32)  # 0: a character of no piece
        self.code[[ord(c) for c in chars]] = np.arange(1, self.width)
        before = np.array([number[start[:-1]] for start in starts], np.int64)
        keys = before * self.width + self.code[[ord(start[-1]) for start in starts]]
        order = np.argsort(keys)
        self.keys, self.after = keys[order], order + 1
        self.score = np.array([NEVER] + [lattice.begins[start] for start in starts], np.int64)
        self.number = np.array([-1] + [lattice.number.get(start, -1) for start in starts], np.int64)
        self.stray, self.longest, self.bytes = lattice.stray, lattice.longest, lattice.bytes

    def solve(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids, four bytes each, and score of each word."""
        n, lengths = len(words), np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")  # the words that reach a position come first
        lengths = lengths[order]
        width, points = int(lengths[0]), np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le"), "<u4")
        reach = np.searchsorted(-lengths, -np.arange(width), side="left")  # words of more than ``at`` characters
        first = np.cumsum(lengths) - lengths
        codes = [self.code[points[first[:count] + at]] for at, count in enumerate(reach)]
        best = np.full((width + 1, n), NEVER, np.int64)
        size_of, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int64)
        best[0] = 0
        for at, count in enumerate(reach):
            here, alive, state = best[at], np.arange(count), np.zeros(count, np.int64)
            for size in range(1, min(self.longest, width - at) + 1):
                end = at + size
                held = np.searchsorted(alive, reach[end - 1])
                alive, state = alive[:held], state[:held]
                key = state * self.width + codes[end - 1][alive]
                step = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                known = self.keys[step] == key
                state = np.where(known, self.after[step], 0)
                own = self.score[state]
                if size == 1:
                    own = np.where(own > NEVER, own, self.stray)
                rows = np.flatnonzero(own > NEVER)
                value = own[rows] + here[alive[rows]]
                rows, value = (kept[value > best[end, alive[rows]]] for kept in (rows, value))
                best[end, alive[rows]], size_of[end, alive[rows]], piece[end, alive[rows]] = value, size, self.number[state[rows]]
                alive, state = alive[known], state[known]
                if not len(alive):
                    break
        # The ends of the pieces on the way back.
        ends, rows, at = np.zeros((n, width + 1), bool), np.arange(n), lengths.copy()
        while len(rows):
            ends[rows, at] = True
            at = at - size_of[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        row, end = np.nonzero(ends)
        ids = piece[end, row]
        strays = np.flatnonzero(ids < 0)
        if len(strays):
            ids, row = self._with_bytes(ids, row, strays, points[first[row[strays]] + end[strays] - 1])
        stops = 4 * np.cumsum(np.bincount(row, minlength=n))
        data, ends_at = ids.astype("<u4").tobytes(), stops.tolist()
        found: list[bytes] = [b""] * n
        total = [0] * n
        scores = best[lengths, np.arange(n)].tolist()
        for place, start, stop, score in zip(order.tolist(), [0, *ends_at], ends_at, scores):
            found[place], total[place] = data[start:stop], score
        return found, total

    def _with_bytes(self, ids, row, strays, points) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece in place of the ids ``strays`` become those of their bytes."""
        different, which = np.unique(points, return_inverse=True)
        coded = [chr(c).encode() for c in different.tolist()]
        times = np.ones(len(ids), np.int64)
        times[strays] = np.array([len(c) for c in coded])[which]
        first = (np.cumsum(times) - times)[strays]
        ids, row = np.repeat(ids, times), np.repeat(row, times)
        for place in range(4):
            byte = np.array([self.bytes[c[place]] if place < len(c) else -1 for c in coded])[which]
            ids[first[byte >= 0] + place] = byte[byte >= 0]
        return ids, row


class Lattice:
    """Best segmentations over the pieces of a model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        usual = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # Scores that are whole numbers are summed exactly, others after scaling.
        scores = [model.get_score(i) for i in usual]
        scale = 1 if all(float(s).is_integer() for s in scores) else 1 << 20
        self.score = {model.id_to_piece(i): round(s * scale) for i, s in zip(usual, scores)}
        self.number = {model.id_to_piece(i): i for i in usual}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError(f"{model_file}: no byte pieces for characters that are no piece")
        self.stray = min(self.score.values()) - 10 * scale
        self.longest = max(map(len, self.score))
        if any(STARTS.search(p) for p in self.score):
            raise ValueError(f"{model_file}: a piece holds the start of a word inside")
        # Scores of pieces, and NEVER for what merely begins one: any other stretch need not be tried further.
        self.begins = {p[:n]: NEVER for p in self.score for n in range(1, len(p) + 1)} | self.score
        # A mark begins a piece of its own behind any character that no piece has in front of it.
        self.joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1) if p[i + 1] in MARKS}
        self.text = {i: p.replace(SPACE, " ").encode() for p, i in self.number.items()} | {
            i: bytes([b]) for b, i in self.bytes.items()
        }
        self.known: dict[str, bytes] = {}
        self.total: dict[str, int] = {}
        self.steps = Steps(self)

    def solve(self, text: str, starts: dict[int, int], inside: int) -> tuple[list[int], list[int]]:
        """Best scores of all positions from scored ``starts``, and where the last piece began (-1: a start).

        Pieces begin before ``inside``.
        """
        n, score, longest, begins = len(text), self.score, self.longest, self.begins
        best, back = [NEVER] * (n + 1), [-1] * (n + 1)
        for at, value in starts.items():
            best[at] = value
        for at in range(min(inside, n)):
            here = best[at]
            if here == NEVER:
                continue
            single = text[at] not in score
            if single and here + self.stray > best[at + 1]:
                best[at + 1], back[at + 1] = here + self.stray, at
            for end in range(at + 1, min(n, at + longest) + 1):
                own = begins.get(text[at:end])
                if own is None:
                    break
                if own + here > best[end] and own > NEVER:
                    best[end], back[end] = here + own, at
        return best, back

    def follow(self, text: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the pieces up to ``end``, and the start that they come from."""
        spans = []
        while back[end] >= 0:
            spans.append((back[end], end))
            end = back[end]
        ids: list[int] = []
        for start, stop in reversed(spans):
            piece = text[start:stop]
            number = self.number.get(piece)
            ids.extend([number] if number is not None else (self.bytes[b] for b in piece.encode()))
        return ids, end

    def _learn(self, words: set[str]) -> None:
        fresh, made = set(), []
        for word in words:
            stem = word.rstrip(MARKS)
            if stem and stem != word and word[len(stem) - 1 : len(stem) + 1] not in self.joined:
                fresh.add(stem)
                fresh.add(word[len(stem) :])
                made.append((word, stem, word[len(stem) :]))
            else:
                fresh.add(word)
        self._solve_words([word for word in fresh if word not in self.known])
        for word, stem, mark in made:
            self.known[word] = self.known[stem] + self.known[mark]
            self.total[word] = self.total[stem] + self.total[mark]

    def _solve_words(self, words: list[str]) -> None:
        alone = words
        if len(words) >= FEW_WORDS:
            alone = [word for word in words if len(word) > KEPT_LENGTH]
            others = sorted((word for word in words if len(word) <= KEPT_LENGTH), key=len)
            for start in range(0, len(others), WORDS_AT_ONCE):
                together = others[start : start + WORDS_AT_ONCE]
                ids, scores = self.steps.solve(together)
                self.known.update(zip(together, ids))
                self.total.update(zip(together, scores))
        for word in alone:
            best, back = self.solve(word, {0: 0}, len(word))
            self.known[word] = array("I", self.follow(word, back, len(word))[0]).tobytes()
            self.total[word] = best[-1]

    def _make_room(self, coming: int) -> None:
        """Forgets long words, which seldom come again; all of them if that isn't enough."""
        if len(self.known) + coming > KEPT_WORDS:
            short = [w for w in self.known if len(w) <= SHORT_WORD]
            if len(short) + coming > KEPT_WORDS * 3 // 4:
                short = []
            self.known = {w: self.known[w] for w in short}
            self.total = {w: self.total[w] for w in short}

    def _ids(self, words: list[str], scored: bool) -> tuple[list[bytes], int]:
        """Ids of each word, and the score of all (0 if not asked for)."""
        found, unknown = list(map(self.known.get, words)), ()
        if None in found:
            gaps = [i for i, ids in enumerate(found) if ids is None]
            unknown = {words[i] for i in gaps}
            self._make_room(2 * len(unknown))
            if scored:  # what was forgotten just now has lost its score
                unknown = set(words).difference(self.known)
            self._learn(unknown)
            known = self.known
            for i in gaps:
                found[i] = known[words[i]]
        total = sum(map(self.total.__getitem__, words)) if scored else 0
        for word in unknown:
            if len(word) > KEPT_LENGTH:
                self.known.pop(word, None)
                self.total.pop(word, None)
        return found, total

    def words(self, words: list[str], scored: bool = True) -> tuple[bytes, int]:
        """Ids, four bytes each, and score (0 if not asked for) of consecutive words."""
        found, total = self._ids(words, scored)
        return b"".join(found), total

    def _words_of(self, text: str) -> list[str]:
        if not text:
            return []
        escaped = SPACE + text.replace(" ", SPACE)
        # Where every space stands alone, splitting at it is the same and faster.
        lonely = 2 * SPACE not in escaped and escaped[-1] != SPACE
        return list(map(SPACE.__add__, escaped[1:].split(SPACE))) if lonely else WORDS.findall(escaped)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text in one go."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts; words that are new are solved together."""
        split = [self._words_of(text) for text in texts]
        found, start, out = self._ids(list(chain.from_iterable(split)), scored=False)[0], 0, []
        for words in split:
            out.append(b"".join(found[start : start + len(words)]))
            start += len(words)
        return out

    def decode(self, ids: np.ndarray, first: bool = True) -> bytes:
        text = b"".join(map(self.text.__getitem__, ids.tolist()))
        return text[1:] if first and text[:1] == b" " else text


def lattice_of(model_file: str) -> Lattice:
    """One for all tasks of a Python worker; every stage here keeps a "lattice"."""
    return kept("lattice", model_file, lambda: Lattice(model_file))


class Chunk:
    """A chunk of an escaped text, with the characters that its last piece may reach into."""

    def __init__(self, lattice: Lattice, text: str, size: int):
        self.lattice, self.text, self.size = lattice, text, size
        starts = [m.start() for m in STARTS.finditer(text, 0, size) if m.start() >= lattice.longest]
        self.first, self.last = (starts[0], starts[-1]) if starts else (None, None)

    def _exits(self, best: list[int]) -> list[int]:
        reach = best[self.size : self.size + self.lattice.longest]
        return reach + [NEVER] * (self.lattice.longest - len(reach))

    def matrix(self) -> list[int]:
        """Best score from each entry to each exit, by row."""
        states, lattice = self.lattice.longest, self.lattice
        entries = range(min(states, len(self.text) + 1))
        if self.first is None:
            rows = [self._exits(lattice.solve(self.text, {i: 0}, self.size)[0]) for i in entries]
        else:
            head = self.text[: self.first]
            middle = lattice.words(WORDS.findall(self.text[self.first : self.last]))[1]
            tail = self._exits([NEVER] * self.last + lattice.solve(self.text[self.last :], {0: 0}, self.size - self.last)[0])
            to_first = [lattice.solve(head, {i: 0}, len(head))[0][-1] for i in entries]
            rows = [[NEVER if NEVER in (h, t) else h + middle + t for t in tail] for h in to_first]
        return [v for row in rows for v in row] + [NEVER] * states * (states - len(rows))

    def entries(self, scores: list[int]) -> list[int]:
        """The entry that each exit leads back to (-1: never), for known scores of the entries."""
        starts = {i: s for i, s in enumerate(scores) if s > NEVER}
        if self.first is None:
            best, back = self.lattice.solve(self.text, starts, self.size)
            return [
                -1 if s == NEVER else self.lattice.follow("", back, self.size + j)[1] if j + self.size <= len(self.text) else -1
                for j, s in enumerate(self._exits(best))
            ]
        head = self.text[: self.first]
        _, back = self.lattice.solve(head, starts, len(head))
        return [self.lattice.follow("", back, len(head))[1]] * self.lattice.longest

    def ids(self, scores: list[int], leaves: int) -> bytes:
        """Ids of the pieces that begin in this chunk, when it is left in the given exit."""
        starts = {i: s for i, s in enumerate(scores) if s > NEVER}
        if self.first is None:
            _, back = self.lattice.solve(self.text, starts, self.size)
            return array("I", self.lattice.follow(self.text, back, self.size + leaves)[0]).tobytes()
        head, tail = self.text[: self.first], self.text[self.last :]
        _, back = self.lattice.solve(head, starts, len(head))
        front = array("I", self.lattice.follow(head, back, len(head))[0]).tobytes()
        _, back = self.lattice.solve(tail, {0: 0}, self.size - self.last)
        end = array("I", self.lattice.follow(tail, back, self.size - self.last + leaves)[0]).tobytes()
        return front + self.lattice.words(WORDS.findall(self.text[self.first : self.last]))[0] + end


def combine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Product over (max, +); associative."""
    sums = np.where((first[:, :, None] > NEVER) & (second[None] > NEVER), np.maximum(first, NEVER // 4)[:, :, None] + np.maximum(second, NEVER // 4)[None], NEVER)
    return sums.max(axis=1)


def _crc_times(a: int, b: int) -> int:
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return product


def join_crc(first: int, second: int, n_bytes: int) -> int:
    """crc32 of two neighbours from theirs, the later one being of ``n_bytes``."""
    shift, power = 1 << 31, 1 << 23  # 1, and x^8
    while n_bytes:
        if n_bytes & 1:
            shift = _crc_times(shift, power)
        power, n_bytes = _crc_times(power, power), n_bytes >> 1
    return _crc_times(shift, first) ^ second


def _split(documents: DataFrame, longest: int, size: int) -> DataFrame:
    def make(batches):
        for batch in batches:
            for doc_id, key, copies, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "copies")), as_bytes(batch.column("text"))):
                text, crc = SPACE + data.decode().replace(" ", SPACE), zlib.crc32(data)
                chunks = -(-len(text) // size)
                for c in range(chunks):
                    part = text[c * size : (c + 1) * size + longest - 1]
                    yield doc_id, key, copies, crc, c, chunks, min(size, len(text) - c * size), part

    return map_rows(
        documents, make, "doc_id long, row_key long, copies long, source_crc long, chunk long, chunks long, size int, part string",
        weigh=lambda row: 4 * len(row[7]),
    )


def _sequences(batches, names):
    """((doc_id, row_key, copy), rows) of each document in batches sorted by document."""
    own, rows = None, []
    for batch in batches:
        for values in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "row_key", *names))):
            if values[:2] != own:
                if own is not None:
                    yield own, rows
                own, rows = values[:2], []
            rows.append(values[2:])
    if own is not None:
        yield own, rows


def _long(documents: DataFrame, model_file: str, size: int, run: RunTables) -> DataFrame:
    """Encodes documents of several chunks; rows that repeat doc_id and text are encoded once."""
    longest = Lattice(model_file).longest
    key = ["doc_id", "row_key"]
    once = documents.groupBy(*key).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    parts = run.write(_split(once, longest, size).repartition("row_key", "chunk"), "parts")

    def matrices(batches):
        lattice = lattice_of(model_file)
        for batch in batches:
            for doc_id, row_key, chunk, n, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "chunk", "size", "part"))):
                yield doc_id, row_key, chunk, Chunk(lattice, text, n).matrix()

    def scan(batches):
        for (doc_id, row_key), rows in _sequences(batches, ("chunk", "matrix")):
            # Each entry's scores: the matrices so far, from the one state before the text.
            scores = np.full((1, longest), NEVER, np.int64)
            scores[0, 0] = 0
            for chunk, matrix in rows:
                yield doc_id, row_key, chunk, scores[0].tolist()
                scores = combine(scores, np.array(matrix, np.int64).reshape(longest, longest))

    def entries(batches):
        lattice = lattice_of(model_file)
        for batch in batches:
            for doc_id, row_key, chunk, n, text, scores in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "chunk", "size", "part", "scores"))):
                yield doc_id, row_key, chunk, scores, Chunk(lattice, text, n).entries(scores)

    def exits(batches):
        for (doc_id, row_key), rows in _sequences(batches, ("chunk", "scores", "entries")):
            state = 0
            for chunk, scores, back in reversed(rows):
                yield doc_id, row_key, chunk, scores, state
                state = back[state]

    def trace(batches):
        lattice = lattice_of(model_file)
        names = ("doc_id", "row_key", "copies", "source_crc", "chunk", "chunks", "size", "part", "scores", "leaves")
        for batch in batches:
            for doc_id, row_key, copies, crc, chunk, chunks, n, text, scores, leaves in zip(*(batch.column(c).to_pylist() for c in names)):
                yield doc_id, row_key, copies, crc, chunk, chunks, Chunk(lattice, text, n).ids(scores, leaves)

    def by_document(df):
        return df.repartition(*key).sortWithinPartitions(*key, "chunk")

    def with_text(small):
        own = small.withColumnsRenamed({"doc_id": "d", "row_key": "r", "chunk": "c"})
        same = (F.col("row_key") == F.col("r")) & (F.col("chunk") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("d"))
        return parts.join(own.hint("shuffle_hash"), same).drop("d", "r", "c")

    place = "doc_id long, row_key long, chunk long"
    scores = map_rows(by_document(map_rows(parts, matrices, f"{place}, matrix array<long>")), scan, f"{place}, scores array<long>")
    backs = map_rows(with_text(run.write(scores, "scores")), entries, f"{place}, scores array<long>, entries array<int>")
    leaves = map_rows(by_document(backs), exits, f"{place}, scores array<long>, leaves int")
    return map_rows(with_text(run.write(leaves, "leaves")), trace, ENCODED, weigh=lambda row: len(row[6]))


def encode(documents: DataFrame, model_file: str, size: int = CHUNK) -> DataFrame:
    """Ids of all texts, a row per chunk: doc_id, row_key, copies, source_crc, chunk, chunks, ids (four bytes each).

    A null text counts as empty and has no ids. Rows that repeat doc_id and text are encoded once if they
    are of several chunks, and ``copies`` says how many they are; else each has a row. A null doc_id is kept. An empty table gives no rows.
    Other columns are not read.
    """
    run = RunTables(documents.sparkSession)
    keyed = id_and_text(documents).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("row_key", F.xxhash64("doc_id", "text"))
    # The space in front counts as a character.
    is_long = F.length("text") >= size

    def make(batches):
        lattice = lattice_of(model_file)
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist()
            for start, texts in text_slices(batch.column("text"), TEXT_AT_ONCE):
                encoded = lattice.encode_all([data.decode() for data in texts])
                for doc_id, key, data, found in zip(ids[start:], keys[start:], texts, encoded):
                    yield doc_id, key, 1, zlib.crc32(data), 0, 1, found

    short = map_rows(keyed.filter(~is_long), make, ENCODED, weigh=lambda row: len(row[6]))
    return short.union(_long(keyed.filter(is_long), model_file, size, run))


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """Adds the text of each chunk's ids; the chunks of a document in order are its text."""
    names = ("doc_id", "row_key", "copies", "source_crc", "chunk", "chunks", "ids")

    def make(batches):
        lattice = lattice_of(model_file)
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                yield *row, lattice.decode(np.frombuffer(row[6], "<u4"), row[4] == 0).decode()

    return map_rows(encoded, make, f"{ENCODED}, text string", weigh=lambda row: len(row[6]) + 4 * len(row[7]))


def round_trip(documents: DataFrame, model_file: str, size: int = CHUNK) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_ids, ids_crc32, text_crc32, same.

    The checksums are those of all ids, as little-endian numbers of four bytes, and of the decoded text in
    UTF-8; ``same`` says whether that is the original's. Nulls and repeated rows: see ``encode``; a
    repeated row has a row of its own here.
    """

    def digest(batches):
        lattice, names = lattice_of(model_file), ("doc_id", "row_key", "copies", "source_crc", "chunk", "chunks", "ids")
        for batch in batches:
            for doc_id, key, copies, crc, chunk, chunks, ids in zip(*(batch.column(n).to_pylist() for n in names)):
                text = lattice.decode(np.frombuffer(ids, "<u4"), chunk == 0)
                yield doc_id, key, copies, crc, chunk, chunks, len(ids) // 4, zlib.crc32(ids), len(text), zlib.crc32(text)

    def of_documents(batches):
        names = ("chunk", "copies", "source_crc", "n_ids", "ids_crc", "n_bytes", "text_crc")
        for (doc_id, _), rows in _sequences(batches, names):
            total, ids, text = 0, 0, 0
            for _, copies, source, n, ids_crc, n_bytes, text_crc in rows:
                total, ids, text = total + n, join_crc(ids, ids_crc, 4 * n), join_crc(text, text_crc, n_bytes)
            for _ in range(copies):
                yield doc_id, total, ids, text, text == source

    digests = "doc_id long, row_key long, copies long, source_crc long, chunk long, chunks long, n_ids long, ids_crc long, n_bytes long, text_crc long"
    result = "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, same boolean"
    tables = RunTables(documents.sparkSession)
    parts = tables.write(map_rows(encode(documents, model_file, size), digest, digests), "digests")
    whole = parts.filter("chunks = 1").select(
        "doc_id", "n_ids", F.col("ids_crc").alias("ids_crc32"), F.col("text_crc").alias("text_crc32"),
        (F.col("text_crc") == F.col("source_crc")).alias("same"),
    )
    cut = parts.filter("chunks > 1").repartition("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key", "chunk")
    return whole.union(map_rows(cut, of_documents, result))
