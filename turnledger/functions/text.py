"""Text measures and prompt shortening as native column expressions.

Everything here is Column -> Column on JVM built-ins, without Python workers.
Two families of rules exist side by side and differ on purpose:

* turn features (`word_count` ... `optimized_text`): ASCII `\\w` and `\\s`, blanks
  trimmed only when they are the space character;
* prompt library (`approx_tokens` ... `shorten`): Unicode words and blanks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from turnledger import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _contains_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


# ---- turn features ---------------------------------------------------------------


def word_count(text: Column | str) -> Column:
    """Pieces between runs of blanks. Empty text is one (empty) piece."""
    return F.size(F.split(F.trim(_col(text)), K.SPACES))


def single_spaced_word_count(text: Column | str) -> Column:
    """`word_count` of a text whose only blanks are single spaces between words."""
    text = _col(text)
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def sentence_count(text: Column | str) -> Column:
    """Number of sentence ends, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(_col(text), F.lit(K.SENTENCE_END)))


def avg_word_length(chars: Column | str, words: Column | str) -> Column:
    """Characters (blanks included) per word."""
    return _col(chars) / F.greatest(_col(words), F.lit(1))


def has_code_block(text: Column | str) -> Column:
    return _col(text).contains(K.CODE_FENCE)


def optimized_text(text: Column | str) -> Column:
    """Lower case without filler phrases and punctuation, single spaces."""
    lowered = F.lower(_col(text))
    # Searching for the phrases is much cheaper than the pattern, and most texts of a
    # corpus hold none of them.
    no_filler = F.when(
        _contains_any(lowered, [f + " " for f in K.FILLERS]),
        F.regexp_replace(lowered, K.filler_pattern(), " "),
    ).otherwise(lowered)
    no_punctuation = F.regexp_replace(no_filler, K.NOT_WORD_OR_SPACE, "")
    return F.trim(F.regexp_replace(no_punctuation, K.SPACES, " "))


def savings_pct(saved: Column | str, total: Column | str) -> Column:
    total = _col(total)
    return F.when(total > 0, _col(saved) / total * 100.0).otherwise(F.lit(0.0))


# ---- prompt library --------------------------------------------------------------


def _count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(K.UNICODE_NOT_BLANK + "+"))


def unicode_trim(text: Column | str) -> Column:
    """Drop leading and trailing blanks of any kind."""
    blank = K.UNICODE_BLANK
    return F.regexp_replace(_col(text), f"^{blank}+|{blank}+$", "")


def num_words(text: Column | str) -> Column:
    """Words between Unicode blanks; 0 for null and empty text."""
    return F.coalesce(_count_words(_col(text)), F.lit(0))


def approx_tokens(text: Column | str) -> Column:
    """0 for null or empty text, else the number of words but at least 1."""
    text = _col(text)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(
        F.greatest(F.lit(1), _count_words(text))
    )


def sentence_pieces(text: Column | str) -> Column:
    """Pieces around sentence ends, the piece after the last one included."""
    return F.greatest(F.lit(1), F.size(F.split(_col(text), K.SENTENCE_END)))


def mean_word_length(text: Column | str) -> Column:
    """Mean length of the words themselves; 0 when there is none."""
    text = _col(text)
    letters = F.length(F.regexp_replace(text, K.UNICODE_BLANK + "+", ""))
    return F.coalesce(F.try_divide(letters, _count_words(text)), F.lit(0.0))


def shorten(text: Column | str, stopwords: Sequence[str] = K.BASIC_STOPWORDS,
            fillers: Sequence[str] = K.FILLERS,
            keep_words: Sequence[str] = K.KEEP_WORDS) -> Column:
    """Strong shortening: no fillers, punctuation, stopwords or repeated words.

    `array_except` drops the stopwords and later repeats in one pass and keeps the
    order of first occurrence. A text with nothing left stays as it was; null and
    empty text are returned unchanged.
    """
    text = _col(text)
    lowered = F.lower(text)
    no_filler = F.when(
        _contains_any(lowered, fillers),
        reduce(lambda t, filler: F.replace(t, F.lit(filler), F.lit("")), fillers, lowered),
    ).otherwise(lowered)
    plain = F.regexp_replace(no_filler, K.UNICODE_NOT_WORD_OR_BLANK, "")
    kept = set(keep_words)
    dropped = [""] + [w for w in stopwords if w not in kept]
    words = F.array_except(
        F.split(plain, K.UNICODE_BLANK + "+"), F.array(*[F.lit(w) for w in dropped])
    )
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), text)


def shorten_prompt(text: Column | str, stopwords: Sequence[str] = K.ENGLISH_STOPWORDS) -> Column:
    """`shorten` with the full English stopword list; null becomes empty text."""
    return F.coalesce(shorten(text, stopwords=stopwords), F.lit(""))


def question_flag(text: Column | str) -> Column:
    return _contains_any(F.lower(_col(text)), K.QUESTION_WORDS).cast("int")


def estimate_tokens(text: Column | str) -> Column:
    """Token estimate from the words alone, at least 1."""
    return F.greatest(F.lit(1), F.floor(num_words(text) * F.lit(K.TOKENS_PER_WORD)).cast("int"))


def percent_less(before: Column | str, after: Column | str) -> Column:
    """How much smaller `after` is, in percent with two digits; 0 if nothing was there."""
    before, after = _col(before), _col(after)
    share = F.try_divide(before - after, before)
    return F.coalesce(F.round(share * 100.0, 2), F.lit(0.0))


def segment(text: Column | str) -> Column:
    """code, question or general, in this order of precedence."""
    text = _col(text)
    return (
        F.when(has_code_block(text), F.lit("code"))
        .when(question_flag(text) == 1, F.lit("question"))
        .otherwise(F.lit("general"))
    )


def code_fences(text: Column | str) -> Column:
    """Number of code fences."""
    text = _col(text)
    without = F.replace(text, F.lit(K.CODE_FENCE), F.lit(""))
    return ((F.length(text) - F.length(without)) / len(K.CODE_FENCE)).cast("int")


def code_keywords(text: Column | str) -> Column:
    """Occurrences of programming keywords as whole words."""
    pattern = r"\b(?:" + "|".join(K.CODE_KEYWORDS) + r")\b"
    return F.regexp_count(_col(text), F.lit(pattern))


def bracket_density(text: Column | str) -> Column:
    """Share of characters that are brackets; 0 for empty text."""
    text = _col(text)
    brackets = F.length(F.regexp_replace(text, K.NOT_BRACKET, ""))
    return F.coalesce(F.try_divide(brackets, F.length(text)), F.lit(0.0))


# ---- term search -----------------------------------------------------------------


def has_term(text: Column | str, terms: str | Sequence[str]) -> Column:
    """True where one of the terms occurs as a whole token, whatever the case.

    One regular expression per row instead of splitting the text into an array.
    """
    wanted = [terms] if isinstance(terms, str) else list(terms)
    quoted = "|".join(re.escape(t.lower()) for t in wanted)
    edge = r"\p{L}\p{N}"
    return F.lower(_col(text)).rlike(rf"(?<![{edge}])(?:{quoted})(?![{edge}])")
