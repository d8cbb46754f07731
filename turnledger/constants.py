"""Fixed values of the analytics: word lists, patterns, price list, rates.

The Spark expressions and the SQL checks both read them from here, so a rule is
written down once.
"""

# ---- fixed values: filler phrases, in the order they are removed -------------
FILLERS = [
    "please",
    "could you",
    "would you mind",
    "kindly",
    "i would like you to",
    "can you",
    "tell me",
    "help me understand",
]

# ---- fixed values: words that shortening never drops --------------------------
KEEP_WORDS = "not no how what why who when where explain define compare list give examples".split()

# ---- fixed values: short stopword list of the strong shortening ----------------
BASIC_STOPWORDS = """
i me my myself we our ours ourselves you your yours he him his she her hers it
its they them their this that these those am is are was were be been being have
has had do does did a an the and but if or as at by for in of on to up with
about into through then just so than too very some same such also each
""".split()

# ---- fixed values: English stopwords without the apostrophe forms, which can
# ---- never match because apostrophes are deleted before the lookup -------------
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now d ll m o re ve y ain aren
couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn
weren won wouldn
""".split()

# ---- fixed values: substrings that mark a text as a question -------------------
QUESTION_WORDS = ["what", "why", "how", "explain", "describe"]

# ---- fixed values: code fence and programming keywords -------------------------
CODE_FENCE = "```"
CODE_KEYWORDS = "def class function return import public static void const lambda select".split()

# ---- fixed values: patterns ----------------------------------------------------
# ASCII rules of the turn features.
SPACES = r"\s+"
SENTENCE_END = r"[.!?]+"
NOT_WORD_OR_SPACE = r"[^\w\s]"
# Unicode rules of the prompt library: blanks as a Unicode-aware split sees them,
# and letters, digits and underscore as word characters.
UNICODE_BLANK = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}]"
UNICODE_NOT_BLANK = r"[^\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}]"
UNICODE_NOT_WORD_OR_BLANK = r"[^\p{L}\p{N}_\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\p{Z}]"
NOT_BRACKET = r"[^(){}\[\]]"
NOT_TERM = r"[^\p{L}\p{N}]+"

# ---- fixed values: USD per 1,000 tokens ----------------------------------------
PRICES = {
    "gpt-4o": (0.005, 0.015),
    "gpt-4-turbo": (0.010, 0.030),
    "gpt-3.5-turbo": (0.0015, 0.002),
    "claude-3-opus": (0.015, 0.075),
    "claude-3-sonnet": (0.003, 0.015),
    "claude-3-haiku": (0.00025, 0.00125),
}
DEFAULT_PRICE_MODEL = "gpt-4o"
COMPARISON_INPUT_SHARE = 0.6
COMPARISON_OUTPUT_SHARE = 0.4

# ---- fixed values: prompt requests ---------------------------------------------
REQUEST_INPUT_PRICE = 0.0015
REQUEST_OUTPUT_PRICE = 0.002
TOKENS_PER_WORD = 1.3
OUTPUT_PER_INPUT = 1.5
WORDS_PER_SENTENCE = 15

# ---- fixed values: blended output-token estimate --------------------------------
SEGMENT_BASELINE = {"code": 1200.0, "question": 350.0, "general": 500.0}
BASELINE_WEIGHT = 0.6
MODEL_WEIGHT = 0.4
LOWER_FACTOR = 0.7
UPPER_FACTOR = 1.5

# ---- fixed values: model training ------------------------------------------------
FEATURE_COLUMNS = [
    "char_count",
    "word_count",
    "sentence_count",
    "avg_word_length",
    "conversation_turn_count",
    "turn_index",
    "has_code_block_int",
]
# word_count is the same number as the label token_count; this set leaves it out.
NO_LEAK_COLUMNS = [c for c in FEATURE_COLUMNS if c != "word_count"]
REQUEST_FEATURE_COLUMNS = ["context_len", "text_len", "num_words", "avg_word_len", "question_flag"]
LABEL_COLUMN = "token_count"
OPT_LABEL_COLUMN = "optimized_token_count"
RIDGE_R2_THRESHOLD = 0.70
SPLIT_SEED = 42


def filler_pattern() -> str:
    """Any filler phrase followed by one space, whatever the case."""
    return "(?i)(" + "|".join(f + " " for f in FILLERS) + ")"
