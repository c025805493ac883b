"""License notices, found by a positional index of rare words.

A rule is a run of words with a label: a phrase, or the words of a notice whose key phrases must be there. The index
holds for each word of a rule its postings, (rule, position). How rare a word is comes from all documents: its
weight is the number of binary digits of documents / documents with the word, an IDF in whole numbers, so that every
engine adds it up alike.

Each file looks up its rarest licence words, which are the anchors of rules: of a rule's key words the one of highest
weight. A posting of an anchor that stands at word i of the file and position j of the rule lets the rule begin at
i - j; the postings of the rule's other words are intersected with the file's words at the same relative
positions. The place counts if all key words are there and what agrees has a sufficient share of the rule's
weight. No place is lost by looking up anchors alone, as each is a key word that every place must have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunecluster.llm.batches import doc_texts, id_and_text, map_rows

#: Bytes that are split into words at once.
TEXT_AT_ONCE = 1 << 20
#: Share of a notice's weight that must be in its place, in hundredths.
LEAST_SHARE = 60
#: What a word is made of: a-z, 0-9 and everything beyond ASCII; A-Z are lower-cased.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Rule:
    """``words`` of a notice, of which those in [brackets] are its key phrases; without brackets all are."""

    label: str
    notice: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.replace("[", "").replace("]", "").split()

    @property
    def required(self) -> list[bool]:
        if "[" not in self.notice:
            return [True] * len(self.words)
        flags, inside = [], False
        for word in self.notice.split():
            inside = inside or word.startswith("[")
            flags.append(inside)
            inside = inside and not word.endswith("]")
        return flags


# Phrases that name a licence.
BASE = (
    Rule("mit", "under the mit license", True),
    Rule("apache-2", "apache license version 2", True),
    Rule("cc-by-nc", "cc by nc", True),
)
# Words of public licence notices, key phrases in brackets.
NOTICES = (
    Rule("agpl-3", "[gnu affero general public license] version 3"),
    Rule("apache-2", "licensed under the [apache license version 2] 0 the license you may not use this file except in compliance with the license"),
    Rule("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    Rule("cc-by", "licensed under a [creative commons attribution 4 0] international license"),
    Rule("cc-by-nc", "licensed under a [creative commons attribution noncommercial] 4 0 international license"),
    Rule("cc-by-sa", "licensed under a [creative commons attribution sharealike] 4 0 international license"),
    Rule("cc0", "[cc0 1 0 universal]"),
    Rule("gpl-2", "licensed under the [gnu general public license version 2]"),
    Rule("gpl-2", "under the terms of the [gnu general public license] as published by the [free software foundation either version 2] of the license or at your option any later version"),
    Rule("gpl-3", "this work is licensed under the [gnu general public license version 3]"),
    Rule("gpl-3", "under the terms of the [gnu general public license] as published by the [free software foundation either version 3] of the license or at your option any later version"),
    Rule("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    Rule("lgpl", "[gnu lesser general public license]"),
    Rule("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files"),
    Rule("mpl-2", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    Rule("unlicense", "[this is free and unencumbered software] released into the public domain"),
)


def word_blocks(text: bytes):
    """The words of a text, some at a time; blocks end between words."""
    at = 0
    while at < len(text):
        part = text[at : at + TEXT_AT_ONCE].translate(_WORD_BYTES)
        end = len(part)
        if at + end < len(text):
            end = part.rfind(b" ") + 1
            while not end:  # a word longer than the block
                part += text[at + len(part) : at + len(part) + TEXT_AT_ONCE].translate(_WORD_BYTES)
                end = len(part) if at + len(part) >= len(text) else part.rfind(b" ") + 1
        yield part[:end].split()
        at += end


class Index:
    """Postings of the anchors, and what the other words of each rule weigh at their relative positions."""

    def __init__(self, rules, weights: dict[str, int], least_share: int = LEAST_SHARE):
        self.least_share = least_share
        self.rules, self.anchors = [], {}
        for rule in rules:
            words, required = rule.words, rule.required
            own = [weights[w] for w in words]
            self.rules.append(([w.encode() for w in words], own, required, sum(own)))
            anchor = max((j for j, r in enumerate(required) if r), key=lambda j: (own[j], -j))
            self.anchors.setdefault(words[anchor].encode(), []).append((len(self.rules) - 1, anchor))
        self.longest = max(len(words) for words, *_ in self.rules)

    def share(self, number: int, held: list[bytes], start: int) -> float | None:
        """What of a rule's weight stands at ``start``; None if key words lack or it is too little."""
        words, weights, required, total = self.rules[number]
        found = 0
        for j, word in enumerate(words):
            at = start + j
            if 0 <= at < len(held) and held[at] == word:
                found += weights[j]
            elif required[j]:
                return None
        return found / total if 100 * found >= self.least_share * total else None

    def places(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        """Words of the text, and (first word, rule, share) of each place in order."""
        held, base, done, found = [], 0, 0, []
        anchors, length = self.anchors, len(text)

        def look(upto):
            for i in range(done, upto):
                for number, j in anchors.get(held[i], ()):
                    share = self.share(number, held, i - j)
                    if share is not None:
                        found.append((base + i - j, number, share))

        for words in word_blocks(text):
            held += words
            # the last words wait for what follows them
            upto = max(done, len(held) - self.longest)
            look(upto)
            drop = max(0, upto - self.longest)
            held, base, done = held[drop:], base + drop, upto - drop
        look(len(held))
        return base + len(held), sorted(found)


def word_weights(documents: DataFrame, rules) -> dict[str, int]:
    """Weight of each word of the rules, from the number of documents that hold it, counted over all of them.

    One row per task and word goes through an exchange; what comes back has the size of the rules.
    """
    vocabulary = frozenset(w.encode() for rule in rules for w in rule.words)

    def count(batches):
        rows, found = 0, dict.fromkeys(vocabulary, 0)
        for _, text in doc_texts(batches):
            rows += 1
            own = set()
            for words in word_blocks(text):
                own |= vocabulary.intersection(words)
            for word in own:
                found[word] += 1
        yield "", rows
        for word, n in found.items():
            yield word.decode(), n

    counted = map_rows(id_and_text(documents), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in counted.collect()}
    rows = found.pop("", 0)
    return {w.decode(): max(1, (rows // max(1, found.get(w.decode(), 0))).bit_length()) for w in vocabulary}


def scan_licenses(documents: DataFrame, rules=BASE + NOTICES, least_share: int = LEAST_SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, places array<struct<label, base, first_word, n_words, share>>.

    A place is where a rule begins (words from 0; below 0 if the text begins within a notice) and the share of its weight
    found there; places are in order of their first word and overlap where rules do. The words before and behind
    a text agree with nothing. Null and empty texts have no words and no places. A text of any
    length is read whole, a block of words at a time. Rows that repeat are answered one by one, rows
    without id too; an empty table gives no rows. Other columns are not read.
    """
    index = Index(rules, word_weights(documents, rules), least_share)
    kinds = [(rule.label, rule.base, len(rule.words)) for rule in rules]

    def scan(batches):
        for doc_id, text in doc_texts(batches):
            n_words, places = index.places(text)
            yield doc_id, n_words, [
                {"label": kinds[r][0], "base": kinds[r][1], "first_word": at, "n_words": kinds[r][2], "share": share}
                for at, r, share in places
            ]

    place = "struct<label:string,base:boolean,first_word:long,n_words:int,share:double>"
    return map_rows(id_and_text(documents), scan, f"doc_id long, n_words long, places array<{place}>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and labels of each row of ``scan_licenses``; score is the greatest share of a place, 0 where there is none."""
    base = F.filter("places", lambda p: p["base"])

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    starts = F.transform(base, lambda p: p["first_word"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def digest_sql(rules=BASE + NOTICES, least_share: int = LEAST_SHARE) -> str:
    """The same rows in SQL, over all pairs of a document's words and the rules' words."""
    values = ", ".join(
        f"({r}, '{rule.label}', {str(rule.base).lower()}, {j}, '{word}', {str(needed).lower()})"
        for r, rule in enumerate(rules) for j, (word, needed) in enumerate(zip(rule.words, rule.required))
    )
    return rf"""
        WITH p(rule, label, base, j, word, needed) AS (VALUES {values}),
        d AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w
            FROM documents),
        u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
        f AS (SELECT p.word, count(DISTINCT u.doc_id) AS n FROM (SELECT DISTINCT word FROM p) p LEFT JOIN u ON u.word = p.word GROUP BY p.word),
        g AS (
            SELECT p.*, greatest(1, floor(log2(greatest((SELECT count(*) FROM documents) // greatest(f.n, 1), 0.5)))::BIGINT + 1) AS weight
            FROM p JOIN f ON f.word = p.word),
        t AS (SELECT rule, sum(weight) AS total, count_if(needed) AS n_needed FROM g GROUP BY rule),
        a AS (
            SELECT u.doc_id, g.rule, any_value(g.label) AS label, any_value(g.base) AS base, u.i - g.j AS start,
                   sum(g.weight) AS found, count_if(g.needed) AS has
            FROM u JOIN g ON g.word = u.word GROUP BY u.doc_id, g.rule, u.i - g.j),
        m AS (
            SELECT a.*, (a.found::BIGINT)::DOUBLE / (t.total::BIGINT)::DOUBLE AS share FROM a JOIN t ON t.rule = a.rule
            WHERE a.has = t.n_needed AND 100 * a.found >= {least_share} * t.total),
        s AS (
            SELECT doc_id, count_if(base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
            FROM m GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(s.n_base, 0)::BIGINT AS n_base, s.first_word, s.last_word,
               coalesce(s.base_labels, '') AS base_labels, coalesce(s.labels, '') AS labels, coalesce(s.score, 0.0)::DOUBLE AS score
        FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""
