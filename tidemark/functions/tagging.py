"""Parts of speech by a small Viterbi decoder, and sentiment in its context: back ends that read words in their order, for Settings.tagger and
Settings.scorer.

A word of a closed class has the class's tag. For others the ending speaks for a tag, and tags speak for those that follow: the decoder takes the
sequence of the highest sum of both over the whole text. Scores are whole numbers, so that every machine decides alike; among equal sums the
tag that comes first in `TAGS` wins. All texts of an Arrow batch go through the decoder side by side, word by word.

A word with a polarity counts double; behind an intensifier three times, behind a damper once, and with the other sign where one of the three words
before it negates.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import NEGATIVE_WORDS, POSITIVE_WORDS
from tidemark.functions.text import share

TAGS = ("noun", "verb", "adj", "adv", "other")

# Our own fixed values: results depend on these words and scores.
CLOSED = {
    "other": tuple("the a an this that these those my your his her its our their and or but nor if because as until while of at by for with about against between into through during before after above below to from up down in on off over under i me you he him she it we us they them who which what myself yourself".split()),
    "verb": tuple("is am are was were be been being have has had having do does did will would shall should can could may might must say says said get got go goes went make made know knew take took see saw come came".split()),
    "adv": tuple("not never very too quite rather so just now then here there always often also again once still already soon".split()),
}
ENDINGS = (
    ("ly$", (0, -4, -3, 6, -9)),
    ("(ing|ed|ize|ise|ify)$", (0, 5, 1, -6, -9)),
    ("(ous|ful|able|ible|ive|less|ish|al|ic)$", (0, -4, 5, -6, -9)),
    ("(tion|ment|ness|ity|ship|ance|ence|er|or|ism|ist)$", (6, -3, 0, -6, -9)),
    ("s$", (4, 2, -3, -6, -9)),
    ("", (3, 1, 1, -6, -9)),
)
#: Before a tag (row) and after it (column), in the order of TAGS; FIRST is for the first word.
FOLLOWS = ((0, 2, -2, 0, 2), (1, -2, 1, 2, 2), (4, -3, 0, -2, 0), (-1, 3, 2, 0, 0), (3, 1, 2, 0, 0))
FIRST = (1, 0, 0, 0, 1)
NEVER = -1000
NEGATORS = tuple("not no never none nothing neither nor cannot without hardly don't doesn't didn't isn't wasn't aren't weren't won't can't couldn't shouldn't wouldn't".split())
INTENSIFIERS = ("very", "really", "extremely", "so", "too", "absolutely", "totally")
DAMPERS = ("slightly", "somewhat", "barely", "fairly", "rather")
#: Words side by side, and cells of the table of choices, that are worked on at once.
CELLS = 1 << 22

_CLOSED = {w: tuple(0 if t == tag else NEVER for t in TAGS) for tag, words in CLOSED.items() for w in words}
_ENDINGS = tuple((re.compile(e), s) for e, s in ENDINGS)


def emission(word: str) -> tuple[int, ...]:
    """How much a word by itself speaks for each tag."""
    return _CLOSED.get(word) or next(s for e, s in _ENDINGS if e.search(word))


def decoded(words: np.ndarray, offsets: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The tag of each word (numbers of rows of scores) of texts from offsets to offsets."""
    follows, out = np.array(FOLLOWS, np.int64), np.zeros(len(words), np.int8)
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    at = 0
    while at < len(order) and length[order[at]]:
        longest = int(length[order[at]])
        rows = order[at : at + max(1, CELLS // (longest * len(TAGS)))]
        rows = rows[length[rows] > 0]
        at += len(rows)
        size, begin = length[rows], offsets[rows]
        choice = np.zeros((longest, len(rows), len(TAGS)), np.int8)
        best = scores[words[begin]] + np.array(FIRST)
        for k in range(1, longest):
            n = int(np.searchsorted(-size, -k, "left"))  # texts with more than k words come first
            ways = best[:n, :, None] + follows[None]
            choice[k, :n] = ways.argmax(axis=1)
            best[:n] = ways.max(axis=1) + scores[words[begin[:n] + k]]
        tag = best.argmax(axis=1)
        for k in range(longest - 1, -1, -1):
            n = int(np.searchsorted(-size, -k, "left"))
            out[begin[:n] + k] = tag[:n]
            if k:
                tag[:n] = choice[k, np.arange(n), tag[:n]]
    return out


def tag_counts(column: pa.Array) -> np.ndarray:
    """Rows by tags: how many words of each row have the tag."""
    column = pa.concat_arrays([column.chunk(i) for i in range(column.num_chunks)]) if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null([]) if column.null_count else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null("").dictionary_encode()
    offsets = offsets - offsets[0]
    scores = np.array([emission(w) for w in flat.dictionary.to_pylist()], np.int64).reshape(-1, len(TAGS))
    tag = decoded(flat.indices.to_numpy().astype(np.int64), offsets, scores)
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    return np.bincount(row * len(TAGS) + tag, minlength=len(column) * len(TAGS)).reshape(-1, len(TAGS))


def viterbi_ratios(tk: Column) -> dict[str, Column]:
    """noun_ratio, verb_ratio, adj_ratio and adv_ratio of a column of words."""

    @F.arrow_udf("array<int>")
    def counted(column: pa.Array) -> pa.Array:
        n = tag_counts(column)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n.size + 1, len(TAGS)).astype(np.int32)), pa.array(n.ravel().astype(np.int32)))

    found = counted(tk)
    return {f"{t}_ratio": share(F.get(found, F.lit(k)), F.size(tk), 4) for k, t in enumerate(TAGS[:4])}


def sentiment_in_context(tk: Column) -> tuple[Column, Column]:
    """Polarity (the balance of the polar words' values) and subjectivity (their share of all words)."""
    among = lambda w, words: F.coalesce(w.isin(*words), F.lit(False))
    places = F.when(F.size(tk) > 0, F.sequence(F.lit(0), F.size(tk) - 1)).otherwise(F.array().cast("array<int>"))
    polar = F.filter(places, lambda i: among(F.get(tk, i), POSITIVE_WORDS + NEGATIVE_WORDS))

    def value(i: Column) -> Column:
        before = F.get(tk, i - 1)
        strength = F.when(among(before, INTENSIFIERS), F.lit(3)).when(among(before, DAMPERS), F.lit(1)).otherwise(F.lit(2))
        negated = among(before, NEGATORS) | among(F.get(tk, i - 2), NEGATORS) | among(F.get(tk, i - 3), NEGATORS)
        return strength * F.when(among(F.get(tk, i), POSITIVE_WORDS), F.lit(1)).otherwise(F.lit(-1)) * F.when(negated, F.lit(-1)).otherwise(F.lit(1))

    values = F.transform(polar, value)
    total = lambda f: F.aggregate(values, F.lit(0), lambda a, x: a + f(x))
    return share(total(lambda x: x), total(F.abs), 4), share(F.size(polar), F.size(tk), 4)
