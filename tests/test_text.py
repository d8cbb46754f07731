"""Text rules against hand-derived values and plain Python on random texts."""

import random
import re


from turnledger import constants as K
from turnledger.functions import text as tx


def value(spark, column, text):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(column("t")).first()[0]


def values(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in df.select("i", column("t")).orderBy("i").collect()]


def test_word_count_keeps_pieces_around_newlines(spark):
    cases = {"hello world": 2, "hi\n": 2, "\n\nhi there": 3, "": 1, "  a  ": 1, "a\u00a0b": 1}
    assert values(spark, tx.word_count, list(cases)) == list(cases.values())


def test_sentence_counts_of_both_rules(spark):
    texts = ["no end", "One.", "Hello. World! How are you?", "Wait... what?!", ""]
    assert values(spark, tx.sentence_count, texts) == [1, 1, 3, 2, 1]
    assert values(spark, tx.sentence_pieces, texts) == [1, 2, 4, 3, 1]


def test_optimized_text_rules(spark):
    cases = {
        "Please could you explain concept 7 in detail?": "explain concept 7 in detail",
        "displease me": "dis me",
        "please, stop": "please stop",
        "café naïve": "caf nave",
        "a\u00a0b": "ab",
        "tellkindly me more": "tell me more",
        "...": "",
        "A\n\nB\t c": "a b c",
    }
    assert values(spark, tx.optimized_text, list(cases)) == list(cases.values())


def test_stripped_text_counts_as_one_token(spark):
    count = lambda t: tx.single_spaced_word_count(tx.optimized_text(t))
    assert values(spark, count, ["...", "one two  three", ""]) == [1, 3, 1]


def test_shorten_goldens(spark):
    short = value(spark, tx.shorten_prompt, "Please could you explain what recursion is?")
    assert "please" not in short and {"explain", "what"} <= set(short.split())
    assert value(spark, tx.shorten_prompt, "") == ""
    assert value(spark, tx.shorten_prompt, None) == ""
    assert value(spark, tx.shorten, None) is None
    assert value(spark, tx.shorten, "the and of") == "the and of"
    assert value(spark, tx.shorten, "Café, café NAÏVE naïve!") == "café naïve"
    assert value(spark, tx.shorten, "b a b no b") == "b no"


def test_approx_tokens_and_mean_word_length(spark):
    assert values(spark, tx.approx_tokens, ["hello world", "", None, "  ", "a\u00a0b\u2003c"]) == [2, 0, 0, 1, 3]
    assert values(spark, tx.mean_word_length, ["hi there", "", " \n", None]) == [3.5, 0.0, 0.0, 0.0]


def test_estimates_flags_and_segments(spark):
    assert values(spark, tx.estimate_tokens, ["", "a", "a b c d"]) == [1, 1, 5]
    assert values(spark, tx.question_flag, ["Somehow", "tell", "EXPLAIN"]) == [1, 0, 1]
    assert values(spark, tx.segment, ["why ```x```", "why", "hello", None]) == [
        "code", "question", "general", "general"
    ]
    assert values(spark, tx.code_fences, ["```a```", "x"]) == [2, 0]
    assert values(spark, tx.code_keywords, ["def f(): return 1", "defer"]) == [2, 0]
    assert values(spark, tx.bracket_density, ["(a)[]", ""]) == [0.8, 0.0]


def test_has_term_matches_whole_tokens(spark):
    hit = lambda t: tx.has_term(t, ["GPT", "c++"])
    assert values(spark, hit, ["model gpt-4o", "gpts", "égpt", "use C++ now", "GPT"]) == [
        True, False, False, True, True
    ]


PIECES = ["please", "Could you ", "tell me", " ", "  ", "\n", "\u00a0", "\u2003", "the", "explain", "Ünïcode",
          "word", "WORD", "!", "?", ".", "'", "_", "42", "kindly", "can you", "日本", "\t", "don't", "--"]


def random_texts(n=400):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def plain_shorten(text, stopwords):
    if not text:
        return text
    words = text.lower()
    for phrase in K.FILLERS:
        words = words.replace(phrase, "")
    words = [w for w in re.sub(r"[^\w\s]", "", words).split() if w not in set(stopwords) - set(K.KEEP_WORDS)]
    return " ".join(dict.fromkeys(words)) or text


def test_random_texts_like_plain_python(spark):
    texts = random_texts()
    assert values(spark, tx.shorten, texts) == [plain_shorten(t, K.BASIC_STOPWORDS) for t in texts]
    assert values(spark, tx.shorten_prompt, texts) == [plain_shorten(t, K.ENGLISH_STOPWORDS) for t in texts]
    assert values(spark, tx.num_words, texts) == [len(t.split()) for t in texts]
    assert values(spark, tx.unicode_trim, texts) == [t.strip() for t in texts]
    spaces = re.compile(r"\s+", re.ASCII)
    assert values(spark, tx.word_count, texts) == [len(spaces.split(t.strip(" "))) for t in texts]
    assert values(spark, tx.sentence_count, texts) == [max(1, len(re.split(r"[.!?]+", t)) - 1) for t in texts]
    filler = re.compile("|".join(f + " " for f in K.FILLERS))
    optimized = [
        spaces.sub(" ", re.sub(r"[^\w\s]", "", filler.sub(" ", t.lower()), flags=re.ASCII)).strip(" ")
        for t in texts
    ]
    assert values(spark, tx.optimized_text, texts) == optimized
    count = lambda t: tx.single_spaced_word_count(tx.optimized_text(t))
    assert values(spark, count, texts) == [len(spaces.split(t)) for t in optimized]


def test_percent_less(spark):
    df = spark.createDataFrame([(8, 5), (0, 0), (3, 2)], "a int, b int")
    assert [r[0] for r in df.select(tx.percent_less("a", "b")).collect()] == [37.5, 0.0, 33.33]


def test_word_lists_are_sound():
    assert len(K.KEEP_WORDS) == 14 and len(K.FILLERS) == 8
    assert not set(K.KEEP_WORDS) & set(K.BASIC_STOPWORDS)
    assert len(set(K.BASIC_STOPWORDS)) == len(K.BASIC_STOPWORDS)
