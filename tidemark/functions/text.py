"""Text features as column expressions; null text counts as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import FUNCTION_WORDS, MANIPULATION_LEXICON, NEGATIVE_WORDS, POSITIVE_WORDS, URGENCY_PHRASES
from tidemark.functions import automaton, endings


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and apostrophes of the lower-cased text."""
    # Split at the rest: a quarter less time than extracting all matches.
    return F.array_remove(F.split(F.lower(text_of(c)), "[^a-z']+"), "")


def count_of(c: Column, pattern: str) -> Column:
    """How often a pattern that matches no empty text does so, by a split: a tenth less time than counting matches."""
    return F.size(F.split(c, pattern)) - 1


def share(part: Column, whole: Column, digits: int) -> Column:
    """part / whole of two integers, rounded half away from zero by integer arithmetic, so that every engine agrees; 0 for nothing."""
    scale = 10**digits
    top = 2 * scale * F.abs(part.cast("long")) + whole
    found = F.signum(part.cast("double")) * ((top - top % (2 * whole)) / (2 * whole)) / float(scale)
    return F.when(whole > 0, found).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded half away from zero after it was scaled, as DuckDB rounds; Spark's round goes by the shortest decimal form, which differs at ties."""
    return F.round(x * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def lexical_diversity(tk: Column) -> Column:
    return share(F.size(F.array_distinct(tk)), F.size(tk), 4)


def avg_word_length(tk: Column) -> Column:
    return share(F.length(F.array_join(tk, "")), F.size(tk), 2)


def caps_ratio(c: Column) -> Column:
    t = text_of(c)
    return share(F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}", "")), F.length(t), 4)


def occurrences(c: Column, char: str) -> Column:
    t = text_of(c)
    return F.length(t) - F.length(F.replace(t, F.lit(char), F.lit("")))


def exclamation_ratio(c: Column) -> Column:
    return share(occurrences(c, "!") * 100, F.length(text_of(c)), 4)


def char_ratio(c: Column, char: str) -> Column:
    return share(occurrences(c, char), F.length(text_of(c)), 4)


def ellipsis_count(c: Column) -> Column:
    return count_of(text_of(c), "\\.\\.\\.")


def phrase_hits(c: Column, phrases: tuple[str, ...]) -> Column:
    """How many different phrases stand in the text, anywhere and in any case."""
    low, phrases = F.lower(text_of(c)), automaton.distinct_phrases(phrases)
    if len(phrases) > automaton.FEW:
        return automaton.hits(low, phrases)
    out = F.lit(0)
    for p in phrases:
        out = out + F.contains(low, F.lit(p)).cast("int")
    return out


def phrase_score(c: Column, phrases: tuple[str, ...] = URGENCY_PHRASES) -> Column:
    return F.least(share(phrase_hits(c, phrases) * 5, F.lit(len(phrases)), 4), F.lit(1.0)) if phrases else F.lit(0.0)


def phrase_scan(c: Column, phrases: tuple[str, ...]) -> Column:
    """Every (phrase, 0-based place of its last character) in the text, overlaps and nested phrases included: by place, longer ones first."""
    return automaton.scan(F.lower(text_of(c)), automaton.distinct_phrases(phrases))


def category_scores(c: Column, lexicon: dict[str, tuple[str, ...]] = MANIPULATION_LEXICON) -> dict[str, Column]:
    return {name: phrase_score(c, phrases) for name, phrases in lexicon.items()}


def category_scan(c: Column, lexicon: dict[str, tuple[str, ...]] = MANIPULATION_LEXICON) -> Column:
    """A map of each category to the matches of its phrases; one scan for all categories."""
    own = {name: automaton.distinct_phrases(phrases) for name, phrases in lexicon.items()}
    found = phrase_scan(c, tuple(p for phrases in own.values() for p in phrases))

    def of(phrases: tuple[str, ...]) -> Column:
        return F.filter(found, lambda m: m["phrase"].isin(*phrases))

    return F.create_map(*[x for name, phrases in own.items() for x in (F.lit(name), of(phrases))])


def manipulation_score(c: Column, lexicon: dict[str, tuple[str, ...]] = MANIPULATION_LEXICON) -> Column:
    scores = list(category_scores(c, lexicon).values())
    if not scores:
        return F.lit(0.0)
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return rounded(total / len(scores), 4)


def readability_flesch(c: Column, tk: Column) -> Column:
    """Flesch reading ease with vowel groups as syllables and [.!?] runs as sentence ends."""
    words = F.size(tk)
    sentences = F.greatest(count_of(text_of(c), "[.!?]+"), F.lit(1))
    # Vowel groups of all words at once, and one for each word without a vowel.
    spaced = F.array_join(tk, " ")
    syllables = count_of(spaced, "[aeiouy]+") + count_of(spaced, "(?<![a-z'])[b-df-hj-np-tv-xz']+(?![a-z'])")
    ease = F.lit(206.835) - F.lit(1.015) * (words.cast("double") / sentences) - F.lit(84.6) * (syllables.cast("double") / words)
    return F.when(words > 0, rounded(ease, 2)).otherwise(F.lit(0.0))


def _members(tk: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(tk, lambda w: w.isin(*words)))


def function_word_ratio(tk: Column, words: tuple[str, ...] = FUNCTION_WORDS) -> Column:
    return share(_members(tk, words), F.size(tk), 4)


def sentiment(tk: Column) -> tuple[Column, Column]:
    """Polarity and subjectivity by the lexicon back end: balance of, and share of, words with a polarity."""
    good, bad = _members(tk, POSITIVE_WORDS), _members(tk, NEGATIVE_WORDS)
    return share(good - bad, good + bad, 4), share(good + bad, F.size(tk), 4)


#: The default part-of-speech back end: word endings, in order of precedence.
POS_ENDINGS = {"adv": "ly$", "verb": "(ing|ed|ize|ise|ify)$", "adj": "(ous|ful|able|ible|ive|less|ish|al|ic)$", "noun": "(tion|ment|ness|ity|ship|ance|ence|er|or|ism|ist)$"}


def pos_ratios(tk: Column) -> dict[str, Column]:
    names = tuple(POS_ENDINGS)
    found = endings.counted(tk, tuple(tuple(e.removesuffix("$").strip("()").split("|")) for e in POS_ENDINGS.values()))
    return {f"{k}_ratio": share(F.get(found, F.lit(names.index(k))), F.size(tk), 4) for k in ("noun", "verb", "adj", "adv")}


def recipients(*fields: Column) -> Column:
    """Addresses of the fields in order, split at ; and , and trimmed; duplicates stay."""
    return F.filter(F.transform(F.split(F.concat_ws(";", *fields), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


Sentiment = Callable[[Column], tuple[Column, Column]]
Tagger = Callable[[Column], dict[str, Column]]


def feature_columns(c: Column, tk: Column, urgency: tuple[str, ...] = URGENCY_PHRASES, lexicon: dict[str, tuple[str, ...]] = MANIPULATION_LEXICON, scorer: Sentiment = sentiment, tagger: Tagger = pos_ratios) -> dict[str, Column]:
    """All linguistic and stylometric features of a message; tk is a column that holds tokens(c). Other back ends for sentiment and
    parts of speech take the tokens and give the same columns."""
    polarity, subjectivity = scorer(tk)
    return {
        "sentiment_polarity": polarity,
        "sentiment_subjectivity": subjectivity,
        "urgency_score": phrase_score(c, urgency),
        "social_engineering_score": manipulation_score(c, lexicon),
        "readability_flesch": readability_flesch(c, tk),
        "lexical_diversity": lexical_diversity(tk),
        "avg_word_length": avg_word_length(tk),
        "message_length": F.length(text_of(c)),
        "caps_ratio": caps_ratio(c),
        "exclamation_ratio": exclamation_ratio(c),
        "function_word_ratio": function_word_ratio(tk),
        "comma_ratio": char_ratio(c, ","),
        "period_ratio": char_ratio(c, "."),
        "question_ratio": char_ratio(c, "?"),
        "ellipsis_count": ellipsis_count(c),
        **tagger(tk),
    }
