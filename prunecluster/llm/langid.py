"""Language identification by unigrams over the pieces of a public vocabulary.

A language gives each piece a probability. A word is scored by the sum over all its segmentations
into pieces (forward algorithm), a text by the product over its words. The probabilities are fitted
by expectation-maximisation, where a word counts towards the pieces of all its segmentations in
proportion to their share (forward and backward sums). Words of equal length are handled
together, position by position; each different word is scored once while it is remembered.
"""

from __future__ import annotations

import re
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunecluster.llm.batches import as_bytes, id_and_text, kept, let_go, map_rows, text_slices
from prunecluster.storage import RunTables

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Marks the start of a word in the vocabulary.
WORD_START = "▁"
#: Probability of a character that is no piece, in every language.
STRAY = 1e-9
#: Count that every piece has in every language before any text is seen.
PRIOR = 0.05
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
KEPT_WORDS, WORDS_AT_ONCE, TEXT_AT_ONCE, RESCALED = 200_000, 20_000, 2 << 20, 16


def public_pieces(name: str = "piece_bpe_32k.model") -> list[str]:
    """The pieces of a public SentencePiece vocabulary that stand for text."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of code points; column t covers the first t."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for t in range(codes.shape[1]):
        out[:, t + 1] = out[:, t] * MULTIPLIER + codes[:, t] + np.uint64(1)
    return out


class Pieces:
    """Finds pieces in many words at once."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        with np.errstate(over="ignore"):
            own = np.array([self._of(p) for p in pieces], np.uint64)
        order = np.argsort(own)
        self.known, self.number = own[order], order.astype(np.int64)
        if len(np.unique(own)) < self.n:
            raise ValueError("two pieces share a hash; choose another multiplier")
        powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                powers.append(powers[-1] * MULTIPLIER)
        self.powers = powers

    @staticmethod
    def _of(piece: str) -> np.uint64:
        codes = np.array([[ord(c) for c in piece]], np.uint64)
        return _hashes(codes)[0, -1]

    def spans(self, words: list[str]):
        """For words of one length: (end, size, rows, piece) of all pieces in them, by end."""
        length = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64)
        prefix = _hashes(codes)
        for end in range(1, length + 1):
            found = []
            for size in range(1, min(self.longest, end) + 1):
                own = prefix[:, end] - prefix[:, end - size] * self.powers[size]
                at = np.minimum(np.searchsorted(self.known, own), self.n - 1)
                rows = np.flatnonzero(self.known[at] == own)
                found.append((size, rows, self.number[at[rows]]))
            yield end, found


def by_length(words: list[str]):
    """Positions of the words of each length, in blocks."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        where = np.flatnonzero(lengths == length)
        for start in range(0, len(where), WORDS_AT_ONCE):
            yield int(length), where[start : start + WORDS_AT_ONCE]


def forward(pieces: Pieces, weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Log of the sum over all segmentations, for each word (row) and language (column)."""
    marked = [WORD_START + w for w in words]
    out = np.zeros((len(words), weights.shape[1]))
    with np.errstate(over="ignore"):
        for length, where in by_length(marked):
            window = pieces.longest + 1
            sums = np.zeros((window, len(where), weights.shape[1]))
            sums[0] = 1.0
            scale = np.zeros(len(where))
            for end, found in pieces.spans([marked[i] for i in where]):
                now = np.zeros_like(sums[0])
                single = np.ones(len(where), bool)
                for size, rows, number in found:
                    now[rows] += sums[(end - size) % window][rows] * weights[number]
                    if size == 1:
                        single[rows] = False
                now[single] += sums[(end - 1) % window][single] * STRAY
                sums[end % window] = now
                if end % RESCALED == 0:
                    most = now.max(axis=1)
                    sums /= most[:, None]
                    scale += np.log(most)
            out[where] = np.log(sums[length % window]) + scale[:, None]
    return out


def expected(pieces: Pieces, weights: np.ndarray, words: list[str], language: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (row) in each language (column), over words of known language."""
    marked = [WORD_START + w for w in words]
    out = np.zeros(weights.shape)
    with np.errstate(over="ignore"):
        for length, where in by_length(marked):
            own = language[where]
            steps = list(pieces.spans([marked[i] for i in where]))
            ahead = np.zeros((length + 1, len(where)))
            ahead[0] = 1.0
            scale = np.ones((length + 1, len(where)))
            for end, found in steps:
                # Sums ahead are relative to the one before, so that long words do not vanish.
                single = np.ones(len(where), bool)
                for size, rows, number in found:
                    gap = np.prod(scale[end - size + 1 : end, rows], axis=0)
                    ahead[end, rows] += ahead[end - size, rows] * weights[number, own[rows]] / gap
                    if size == 1:
                        single[rows] = False
                ahead[end, single] += ahead[end - 1, single] * STRAY
                scale[end] = ahead[end]
                ahead[end] = 1.0
            behind = np.zeros((length + 1, len(where)))
            behind[length] = 1.0
            for end, found in reversed(steps):
                single = np.ones(len(where), bool)
                for size, rows, number in found:
                    gap = np.prod(scale[end - size + 1 : end + 1, rows], axis=0)
                    share = weights[number, own[rows]] * behind[end, rows] / gap
                    np.add.at(out, (number, own[rows]), share * times[where][rows])
                    behind[end - size, rows] += share
                    if size == 1:
                        single[rows] = False
                behind[end - 1, single] += behind[end, single] * STRAY / scale[end, single]
    return out


def words_of(text: bytes) -> list[str]:
    return LETTERS.findall(text.decode().lower())


class Scorer:
    """Scores texts; remembers words up to a bound."""

    def __init__(self, pieces: Pieces, weights: np.ndarray):
        self.pieces, self.weights = pieces, weights
        self._forget()

    def _forget(self):
        self.row, self.scores, self.filled = {}, np.zeros((1024, self.weights.shape[1])), 0

    def _learn(self, words: list[str]) -> None:
        if self.filled + len(words) > len(self.scores):
            grown = np.zeros((2 * (self.filled + len(words)), self.weights.shape[1]))
            grown[: self.filled] = self.scores[: self.filled]
            self.scores = grown
        self.scores[self.filled : self.filled + len(words)] = forward(self.pieces, self.weights, words)
        self.row.update(zip(words, range(self.filled, self.filled + len(words))))
        self.filled += len(words)

    def totals(self, texts: list[bytes]):
        """For each text: log probability by language, or None if it has no letter."""
        split = [words_of(t) for t in texts]
        unknown = set().union(*split).difference(self.row)
        if self.filled + len(unknown) > KEPT_WORDS:
            self._forget()
            unknown = set().union(*split)
        if unknown:
            self._learn(list(unknown))
        for words in split:
            if any(c.isalpha() for w in words for c in w):
                yield self.scores[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(axis=0)
            else:
                yield None


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 4, is 2; no for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class Model:
    """Piece probabilities (pieces x languages): bounded by the vocabulary and the labels."""

    def __init__(self, languages: list[str], vocabulary: list[str], weights: np.ndarray):
        self.languages, self.vocabulary, self.weights, self.name = languages, vocabulary, weights, uuid4().hex

    def predict(self, texts: list[bytes | None]):
        """(language, score) of each text; the score is the language's share of all probabilities."""
        if not self.languages:
            yield from ((UNKNOWN, 0.0) for _ in texts)
            return
        scorer = kept("language", self.name, lambda: Scorer(Pieces(self.vocabulary), self.weights))
        for total in scorer.totals([t or b"" for t in texts]):
            if total is None:
                yield UNKNOWN, 0.0
            else:
                best = int(total.argmax())
                yield self.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def fit(documents: DataFrame, vocabulary: list[str], per_language: int = 2000, rounds: int = 3) -> Model:
    """Fits on about ``per_language`` labelled documents of each language, chosen by a hash of their ids.

    Held-out documents, null labels and null texts take no part. Words are counted and shared out among the
    pieces in Spark; the driver gets one number for each piece and language.
    """
    spark = documents.sparkSession
    run = RunTables(spark)
    labelled = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], vocabulary, np.zeros((len(vocabulary), 0)))
    share = F.create_map(*(x for l in languages for x in (F.lit(l), F.lit(min(1.0, per_language / sizes[l])))))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("fit")), 11) / F.lit(float(1 << 53))

    def count(batches):
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
                for word in words_of(text):
                    seen[lang, word] = seen.get((lang, word), 0) + 1
            yield from ((lang, word, n) for (lang, word), n in seen.items())

    words = run.write(
        map_rows(labelled.filter(draw < share[F.col("lang")]).select("lang", "text"), count, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "words",
    )
    number = {l: i for i, l in enumerate(languages)}
    weights = np.full((len(vocabulary), len(languages)), 1.0 / len(vocabulary))
    for _ in range(rounds):
        current = weights

        def share_out(batches):
            pieces, total = Pieces(vocabulary), np.zeros(current.shape)
            for batch in batches:
                own = np.array([number[l] for l in batch.column("lang").to_pylist()], np.int64)
                if len(own):
                    total += expected(pieces, current, batch.column("word").to_pylist(), own, batch.column("n").to_numpy().astype(float))
            for piece, lang in zip(*np.nonzero(total)):
                yield int(piece), int(lang), float(total[piece, lang])

        uses = (
            map_rows(words, share_out, "piece int, lang int, uses double")
            .groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        )
        counts = np.full(current.shape, PRIOR)
        counts[uses["piece"], uses["lang"]] += uses["uses"]
        weights = counts / counts.sum(axis=0)
    return Model(languages, vocabulary, weights)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A null text, and one without a letter, is ``und`` with score 0; so is everything if no labelled
    document was there to learn from. A null doc_id is not held out. Repeated rows get equal rows. An
    empty table gives no rows. Only doc_id and text are read.
    """

    def make(batches):
        for batch in batches:
            ids, held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for start, texts in text_slices(batch.column("text"), TEXT_AT_ONCE):
                for i, (language, score) in enumerate(model.predict(texts), start):
                    yield ids[i], held[i], language, score

    return map_rows(
        id_and_text(documents).withColumn("held_out", held_out()), make,
        "doc_id long, held_out boolean, lang_pred string, score double", keeps="language",
    )


def language_id(documents: DataFrame, per_language: int = 2000, rounds: int = 3) -> DataFrame:
    """Fits on the labelled documents that are not held out, then predicts all: doc_id, held_out, lang_pred, score.

    Null labels and null texts teach nothing. A null text, and one without a letter, is ``und`` with score 0, and so
    is every text of a table without labels. Texts of any length are read whole; of equally likely languages the first by
    name is taken. Rows that repeat, or without id, are answered one by one. An empty table gives no rows. Other
    columns are not read.
    """
    return identify(documents, fit(documents, public_pieces(), per_language, rounds))


def keep_languages(documents: DataFrame, least: float = 0.5, per_language: int = 2000, rounds: int = 3) -> DataFrame:
    """Rows of ``documents`` whose language is told with a score of ``least`` or more, all columns as they are.

    Null, empty and letterless texts go, and all rows if no row has a label. The score is the probability among the
    languages learned, so a long text in none of them goes to the likeliest and stays. Rows that repeat are
    judged alike and stay or go together; texts of any length are read whole; an empty table stays empty. Columns may have any
    names, as those that are not read are passed through.
    """
    model = fit(documents, public_pieces(), per_language, rounds)

    def keep(batches):
        let_go("language")
        for batch in batches:
            for start, texts in text_slices(batch.column("text"), TEXT_AT_ONCE):
                good = [l != UNKNOWN and s >= least for l, s in model.predict(texts)]
                yield batch.slice(start, len(texts)).filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
