"""Secrets in texts: known forms, and tokens that pass tests of randomness.

Besides the known forms, every long token of letters, digits and a few signs is a
candidate. Its encoding is inferred from the characters it uses, and the values of its
characters in that alphabet are tested for uniformity (chi-squared), for runs above and
below the middle, and for serial correlation. Fisher's method joins the three p-values.
A token of random characters has a uniform p-value, ordinary text one near zero. In each
class of encoding and length the share of random tokens is estimated from the p-values
above one half; the lowest threshold is taken at which at most `ALPHA` of the reported
tokens are expected to be ordinary text.

Only DataFrame expressions are used. Texts are read once and not shuffled; what is
gathered is a small table of counts per class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from turnledger.llm.common import keep, text_or_empty

ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
# Share of ordinary text that the reported tokens of a class may hold.
ALPHA = 0.1
LEVELS = [0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5]

DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Alphabets in the order of their values.
ALPHABETS = {
    "base16": DIGITS + "abcdef",
    "base32": UPPER + "234567",
    "base36": DIGITS + UPPER,
    "base62": DIGITS + UPPER + UPPER.lower(),
    "base64": UPPER + UPPER.lower() + DIGITS + "+/",
}

SPAN = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, matches: Column, pattern: str, kind: int) -> Column:
    """Start and end of all matches. `matches` are the matched strings; what lies between
    them comes from splitting at the same pattern, and lengths are summed up."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.arrays_zip(between.alias("gap"), F.transform(matches, F.length).alias("own"))
    start = F.struct(F.array().cast(SPAN).alias("found"), F.lit(0).alias("at"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.coalesce(pair["own"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(F.concat(state["found"], F.array(span)).alias("found"), end.alias("at"))

    every = F.aggregate(lengths, start, step)["found"]
    # The last gap has no match after it.
    return F.when(F.size(matches) > 0, F.slice(every, 1, F.size(matches))).otherwise(
        F.array().cast(SPAN)
    )


def upper_tail(z: Column) -> Column:
    """1 - normal distribution, by a logistic curve (within 0.0002)."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(700.0))))


def encoding(token: Column) -> Column:
    body = F.regexp_replace(token, "=+$", "")
    return (
        F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "base16")
        .when(body.rlike("^[A-Z2-7]+$"), "base32")
        .when(body.rlike("^([A-Z0-9]+|[a-z0-9]+)$"), "base36")
        .when(body.rlike("^[A-Za-z0-9]+$"), "base62")
        .otherwise("base64")
    )


def symbol_values(token: Column, kind: str) -> Column:
    """Position of each character in an alphabet, from 0."""
    body = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    body = F.lower(body) if kind == "base16" else F.upper(body) if kind == "base36" else body
    at = F.array_remove(F.split(body, ""), "")
    alphabet = F.lit(ALPHABETS[kind])
    return F.transform(at, lambda c: (F.instr(alphabet, c) - 1).cast("double"))


def randomness(values: Column, size: int) -> Column:
    """The joined p-value of a token: near 0 for ordinary text."""
    n = F.size(values).cast("double")
    mean, variance = (size - 1) / 2, (size * size - 1) / 12
    total = lambda items: F.aggregate(items, F.lit(0.0), lambda a, x: a + x)
    repeats = total(
        F.transform(
            F.array_distinct(values),
            lambda v: F.pow(F.size(F.filter(values, lambda x: x == v)).cast("double"), 2),
        )
    )
    chi = size / n * repeats - n
    uniform = upper_tail((chi - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n))
    rest = F.slice(values, F.lit(2), F.size(values) - 1)
    pairs = F.arrays_zip(F.slice(values, F.lit(1), F.size(values) - 1).alias("x"), rest.alias("y"))
    high = lambda v: v >= size / 2
    changes = total(F.transform(pairs, lambda p: (high(p["x"]) != high(p["y"])).cast("double")))
    runs = 2 * upper_tail(F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4))
    product = total(F.transform(pairs, lambda p: (p["x"] - mean) * (p["y"] - mean)))
    serial = 2 * upper_tail(F.abs(product) / (F.sqrt(n - 1) * variance))
    least = F.lit(1e-300)
    half = -reduce(
        lambda a, b: a + b, [F.log(F.greatest(p, least)) for p in (uniform, runs, serial)]
    )
    # Upper tail of chi-squared with six degrees of freedom at 2 * half.
    return F.least(F.exp(-half) * (1 + half + half * half / 2), F.lit(1.0))


def p_value(token: Column) -> Column:
    by_kind = [
        F.when(encoding(token) == kind, randomness(symbol_values(token, kind), len(alphabet)))
        for kind, alphabet in ALPHABETS.items()
    ]
    # Tokens of one or no character after the filling is cut off have no test.
    return F.coalesce(*by_kind, F.lit(0.0))


def stratum(token: Column) -> Column:
    """Encoding and length class: lengths within half an octave share a class."""
    return F.concat(encoding(token), F.lit("/"), F.floor(2 * F.log2(F.length(token).cast("double"))))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, random) for each row: known secrets and candidates with p-values."""
    text = F.col("text")
    base = docs.select(F.col("doc_id"), text_or_empty().alias("text"))
    found = base.select(
        "doc_id",
        "text",
        *[
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias(name)
            for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", CANDIDATE))
        ],
    )
    placed = found.select(
        "doc_id",
        "assign",
        "random",
        *[
            spans(text, F.col(name), pattern, kind).alias(f"{name}_at")
            for kind, (name, pattern) in enumerate(
                (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", CANDIDATE))
            )
        ],
    )
    secret = F.transform("assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)))
    long_enough = F.filter(F.arrays_zip(F.col("assign_at").alias("at"), secret.alias("size")), lambda x: x["size"] >= 6)
    known = F.concat(F.transform(long_enough, lambda x: x["at"]), F.col("access_at"), F.col("hex_at"))
    joined = placed.select("doc_id", "random", "random_at", F.array_sort(known).alias("base"))
    pairs = F.arrays_zip(F.col("random_at").alias("at"), F.col("random").alias("token"))
    alone = lambda x: ~F.exists(
        "base", lambda b: (b["start"] < x["at"]["end"]) & (x["at"]["start"] < b["end"])
    )
    return joined.select("doc_id", "base", F.filter(pairs, alone).alias("tokens")).select(
        "doc_id",
        "base",
        F.transform(
            "tokens",
            lambda x: F.struct(
                x["at"].alias("at"), stratum(x["token"]).alias("class"), p_value(x["token"]).alias("p")
            ),
        ).alias("random"),
    )


def thresholds(scanned: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(class, threshold): tokens with a p-value of at least the threshold are reported.

    Of n tokens with p >= t, (1 - t) * random are expected to be random, where random is
    estimated as twice the tokens above one half, plus one."""
    tokens = scanned.select(F.explode("random").alias("r")).select("r.class", "r.p")
    counts = tokens.groupBy("class").agg(
        F.count("*").alias("all"),
        *[F.count_if(F.col("p") >= t).alias(f"from_{i}") for i, t in enumerate(LEVELS)],
    )
    random = F.least(2.0 * (F.col(f"from_{len(LEVELS) - 1}") + 1), F.col("all"))
    fits = [
        F.when(F.col(f"from_{i}") * (1 - alpha) <= random * (1 - t), F.lit(t))
        for i, t in enumerate(LEVELS)
    ]
    return counts.select("class", F.coalesce(*fits, F.lit(LEVELS[-1])).alias("threshold"))


def secrets(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row.

    Counts and base_sha256 are of the known forms; spans has these and the random tokens
    outside them, as kind:start:end in code points, end exclusive, by start and then kind.
    Null texts are empty and have no span; repeated rows stay repeated (and count as often
    in the estimates); an empty table gives no row. Other columns are not read.
    """
    scanned = keep(scan(docs))
    # A row per class: five encodings by about two lengths per octave.
    limits = {r["class"]: r["threshold"] for r in thresholds(scanned, alpha).collect()}
    entries = [F.lit(x) for pair in limits.items() for x in pair]
    limit = F.create_map(*entries) if entries else F.create_map(F.lit(""), F.lit(2.0))
    passed = F.filter("random", lambda r: r["p"] >= F.element_at(limit, r["class"]))
    random = F.transform(passed, lambda r: F.struct(
        r["at"]["start"].alias("start"), F.lit(3).alias("kind"), r["at"]["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))

    def shown(items: Column) -> Column:
        return F.array_join(
            F.transform(items, lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat("base", random))).alias("spans"),
        F.size(random).cast("long").alias("n_random"),
    )
