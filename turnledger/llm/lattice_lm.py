"""Probabilities of texts under a language model with a subword lattice.

A word's letters can be cut into pieces of an existing vocabulary in many ways; the
scores of the pieces weigh all of them, and a forward recursion in log space sums over
all cuts. Before, the scores are revised once by how often the pieces are expected in
the words of the training documents. Pieces never cross white space, so the lattice of a text is the chain of the
lattices of its words and its marginal probability the product of theirs.

The lattice is the open-vocabulary base of a word model learnt from the training
documents, by absolute discounting: a word seen c times among N tokens has

    P(word) = max(c - D, 0) / N + D * distinct / N * lattice(word)

and the end of a text, a token of its own, its share of N. The lattice's own marginal
probability of a text, where each word has its share of N as a whole times the lattice's
probability and no count of a word is used, is returned beside it. Words of all documents are
counted, in the reading tasks first. Scores of the most frequent words go to all tasks,
a table of fixed size; the rest are joined by word, so no hot word meets in one task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from turnledger.llm.common import crc_fold, keep, map_batches, text_or_empty

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
# Probability that a word ends after a piece, before the corpus is seen.
STOP = 0.5
# Pieces that the existing scores count for against those expected in the corpus.
STRENGTH = 1000.0
# Characters up to which the probability of a word needs no scaling.
SHORT = 40
# Frequent words whose scores are sent to all tasks.
HEAD = 100_000
# Distinct words that a task holds while counting.
HELD = 300_000
BEGIN = "▁"


@dataclass
class Lattice:
    """Log probabilities of pieces, the first of a word beginning with a mark, of the
    bytes that spell other characters, and the probability that a piece is the last."""

    logs: dict[str, float]
    bytes: list[float]
    stop: float = STOP
    # By first and later pieces: their prefixes with the log probability of those that
    # are pieces, and None for the others; and the probabilities in the same way.
    steps: tuple[dict, dict] = field(default=None, repr=False)
    chances: tuple[dict, dict] = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.steps = ({}, {})
        for piece, log in self.logs.items():
            table = self.steps[not piece.startswith(BEGIN)]
            for i in range(1, len(piece)):
                table.setdefault(piece[:i], None)
            table[piece] = log
        self.chances = tuple(
            {p: None if w is None else math.exp(w) for p, w in t.items()} for t in self.steps
        )

    @classmethod
    def from_weights(cls, weights: dict[str, float], bytes_: list[float], stop: float = STOP) -> Lattice:
        """First pieces are normalised among each other, and later ones with the bytes, as
        one of them must come. A mark alone can begin any word."""
        weights = {BEGIN: min(weights.values(), default=1.0), **weights}
        first = sum(w for p, w in weights.items() if p.startswith(BEGIN))
        later = sum(w for p, w in weights.items() if not p.startswith(BEGIN)) + sum(bytes_)
        logs = {p: math.log(w / (first if p.startswith(BEGIN) else later)) for p, w in weights.items()}
        return cls(logs, [math.log(w / later) for w in bytes_], stop)

    @classmethod
    def from_scores(cls, pieces: list[tuple[str, float]], bytes_: list[float]) -> Lattice:
        """From (piece, score) and the scores of the 256 bytes.

        Scores that are whole numbers are ranks of merges, which stand for frequencies by
        Zipf's law; others are log probabilities.
        """
        ranks = all(s == int(s) for _, s in pieces)
        weigh = (lambda s: 1 / (2.7 - s)) if ranks else math.exp
        last = min((s for _, s in pieces), default=0.0)
        return cls.from_weights(
            {p: weigh(s) for p, s in pieces if p}, [weigh(last + min(s, 0)) for s in bytes_]
        )

    def _spelt(self, c: str) -> float:
        """Log probability of a character by its bytes."""
        data = c.encode("utf-8", "surrogatepass")
        return sum(self.bytes[b] for b in data) + (len(data) - 1) * math.log(1 - self.stop)

    def log_probability(self, word: str) -> float:
        """Natural log of the sum over all cuts of a word."""
        text, table = BEGIN + word, self.steps[0]
        later, exp, log, more = self.steps[1], math.exp, math.log, math.log(1 - self.stop)
        size = len(text)
        open_: list[list[float] | None] = [None] * (size + 1)
        open_[0] = [0.0]
        for i in range(size + 1):
            own = open_[i]
            if own is None:
                continue
            open_[i] = None
            here = own[0]
            if len(own) > 1:
                top = max(own)
                here = top + log(sum([exp(t - top) for t in own]))
            if i == size:
                return here + log(self.stop)
            if i:
                here += more
                table = later
                if table.get(text[i]) is None:
                    open_[i + 1] = [*(open_[i + 1] or ()), here + self._spelt(text[i])]
            for j in range(i + 1, size + 1):
                weight = table.get(text[i:j], False)
                if weight is None:
                    continue
                if weight is False:
                    break
                if open_[j] is None:
                    open_[j] = [here + weight]
                else:
                    open_[j].append(here + weight)
        raise AssertionError("every word can be spelt")

    def expected(self, word: str) -> Iterator[tuple[str, float]]:
        """(piece, how often it is expected in a word); the bytes of a character count as
        one piece each, named by their number. The sums forward and backward are scaled
        at each position, so long words stay within doubles."""
        text, go_on = BEGIN + word, 1 - self.stop
        size = len(text)
        # Arcs by their start; sums are held relative to the scale of their position.
        arcs: list[list[tuple[int, float]] | None] = [None] * size
        forward, scale = [0.0] * (size + 1), [0.0] * (size + 1)
        reached = [False] * (size + 1)
        forward[0], reached[0] = 1.0, True
        log, exp = math.log, math.exp
        short = size <= SHORT
        for i in range(size):
            if not reached[i]:
                continue
            here, base = forward[i], scale[i]
            table, own = self.chances[i > 0], []
            for j in range(i + 1, size + 1):
                chance = table.get(text[i:j], False)
                if chance is None:
                    continue
                if chance is False:
                    break
                own.append((j, chance * go_on if i else chance))
            if i and table.get(text[i]) is None:
                own.append((i + 1, exp(self._spelt(text[i])) * go_on))
            arcs[i] = own
            for j, chance in own:
                value = here * chance
                if not short:
                    if not reached[j]:
                        scale[j] = base + log(value)
                        value = 1.0
                    else:
                        value *= exp(min(base - scale[j], 600.0))
                forward[j] += value
                reached[j] = True
        after, low = [0.0] * (size + 1), [0.0] * (size + 1)
        after[size] = 1.0
        whole = forward[size]
        for i in range(size - 1, -1, -1):
            for j, chance in arcs[i] or ():
                value = chance * after[j]
                if not value:
                    continue
                if short:
                    share = forward[i] * value / whole
                else:
                    # exp(low) times after is the sum backward, as exp(scale) times forward.
                    share = forward[i] * value / whole * exp(min(scale[i] + low[j] - scale[size], 600.0))
                    if not after[i]:
                        low[i] = low[j] + log(value)
                        value = 1.0
                    else:
                        value *= exp(min(low[j] - low[i], 600.0))
                after[i] += value
                piece = text[i:j]
                if self.chances[i > 0].get(piece) is not None:
                    yield piece, share
                else:
                    for byte in piece.encode("utf-8", "surrogatepass"):
                        yield f"<{byte}>", share

    def revised(self, counts: dict[str, float], words: float, strength: float = STRENGTH) -> Lattice:
        """With the expected counts of pieces over some words added to what the own
        weights amount to at `strength` first and later pieces."""
        weights = {p: strength * math.exp(w) + counts.get(p, 0.0) for p, w in self.logs.items()}
        bytes_ = [strength * math.exp(w) + counts.get(f"<{b}>", 0.0) for b, w in enumerate(self.bytes)]
        pieces = sum(counts.values())
        stop = (strength * self.stop + words) / (strength + pieces)
        return Lattice.from_weights(weights, bytes_, min(max(stop, 0.01), 0.99))


def load_lattice(path: str = VOCABULARY) -> Lattice:
    """From a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_ = [], [0.0] * 256
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            bytes_[int(model.id_to_piece(i)[1:-1], 16)] = model.get_score(i)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), model.get_score(i)))
    return Lattice.from_scores(pieces, bytes_)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def held_out(folds: int = FOLDS, remainder: int = HELD_OUT) -> Column:
    return F.coalesce(crc_fold("doc_id", folds) == remainder, F.lit(False))


def count_words(source: DataFrame, most: int = HELD) -> DataFrame:
    """(word, c, every): how often each word occurs in training documents and in all.
    `source` has text and held_out. Tasks add up before they pass counts on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        rest: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for counter, learnt in ((train, True), (rest, False)):
                if counter:
                    n = pa.array(np.fromiter(counter.values(), np.int64, len(counter)))
                    zero = pa.array(np.zeros(len(counter), np.int64))
                    words = pa.array([w.decode("utf-8", "surrogatepass") for w in counter], pa.string())
                    out = pa.RecordBatch.from_arrays(
                        [words, n if learnt else zero, n], names=["word", "c", "every"]
                    )
                    yield from (out.slice(i, 50_000) for i in range(0, len(counter), 50_000))
                    counter.clear()

        for batch in batches:
            for text, out in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
                (rest if out else train).update(words_of(text))
                if len(train) + len(rest) > most:
                    yield from flush()
        yield from flush()

    return (
        map_batches(source.select("text", "held_out"), run, "word string, c long, every long")
        .groupBy("word")
        .agg(F.sum("c").alias("c"), F.sum("every").alias("every"))
    )


def adapt(words: DataFrame, lattice: Lattice) -> Lattice:
    """The lattice revised by the pieces expected in all distinct training words. Each
    word counts once, as the lattice stands for words not seen before. What comes to the
    driver is a row per piece of the vocabulary."""
    plain = (lattice.logs, lattice.bytes, lattice.stop)
    sent = words.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, count = Lattice(*sent.value), {}, 0
        for batch in batches:
            for word in batch.column("word").to_pylist():
                count += 1
                for piece, share in own.expected(word):
                    total[piece] = total.get(piece, 0.0) + share
        total[""] = float(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())],
            names=["piece", "n"],
        )

    seen = words.filter("c > 0").select("word").mapInArrow(run, "piece string, n double")
    sums = seen.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(sums.column("piece").to_pylist(), sums.column("n").to_pylist()))
    return lattice.revised(counts, counts.pop("", 0.0))


def score_texts(docs: DataFrame, lattice: Lattice, folds: int = FOLDS, remainder: int = HELD_OUT,
                discount: float = DISCOUNT, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    lattice_score) per row.

    Words are split at ASCII white space, A-Z in lower case, and a text ends with one end
    token. base_score is add-one unigram, score the word model's, lattice_score the sum over
    all segmentations of the text, all log10 over all tokens.
    Null texts are empty: they hold the end alone. Rows without doc_id are training rows;
    repeated rows are counted and returned each; an empty table gives no row. Without
    training documents words have the lattice's probability and the end has 1. Other
    columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(folds, remainder).alias("held_out"),
        text_or_empty().alias("text"),
    )
    counted = keep(count_words(source))
    lattice = adapt(counted, lattice)
    # Plain values: broadcasts are not pickled with the code.
    sent = spark.sparkContext.broadcast((lattice.logs, lattice.bytes, lattice.stop))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*sent.value)
        for batch in batches:
            logs = [own.log_probability(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(logs, pa.float64())], names=[*batch.schema.names, "lattice"]
            )

    words = keep(counted.mapInArrow(weigh, "word string, c long, every long, lattice double"))
    total = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("distinct")
    ).first()
    ends = source.filter(~F.col("held_out")).count()
    n, types = total.n + ends, total.distinct + (ends > 0)
    base = F.log10((F.col("c") + 1) / F.lit(float(n + types + 1)))
    ln10 = math.log(10)
    if n:
        known = F.greatest(F.col("c") - discount, F.lit(0.0)) / n
        reserved = discount * total.distinct / n
        share = math.log(reserved) if reserved else 0.0
        # Unseen words stay in log space: a long one's probability may be below all doubles.
        unseen = (F.col("lattice") + share) / ln10
        model = F.when(F.col("c") > 0, F.log10(known + F.exp(F.col("lattice") + share))).otherwise(unseen)
    else:
        model = F.col("lattice") / ln10
    end_base = math.log10((ends + 1) / (n + types + 1))
    end_model = math.log10(ends / n) if ends else 0.0
    # What is left to words when ends have their share; texts without words leave it all.
    go_on = math.log10(1 - ends / n) if 0 < n != ends else 0.0
    scored = words.select(
        "word", "every", (F.col("c") > 0).alias("known"), base.alias("base"), model.alias("model"),
        (F.col("lattice") / ln10 + go_on).alias("plain"),
    )
    # A table of `head` rows, whatever the input.
    top = scored.orderBy(F.desc("every"), "word").limit(head).drop("every").toArrow()
    frequent = spark.sparkContext.broadcast({
        w.encode("utf-8", "surrogatepass"): (int(k), *logs)
        for w, k, *logs in zip(
            *(top.column(c).to_pylist() for c in ("word", "known", "base", "model", "plain"))
        )
    })

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, row = frequent.value.get, TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column("text").to_pylist():
                tokens = words_of(text)
                known, low, high, own, rare, times = 0, end_base, end_model, end_model, [], []
                for word, n in Counter(tokens).items():
                    if found := get(word):
                        known += n * found[0]
                        low += n * found[1]
                        high += n * found[2]
                        own += n * found[3]
                    else:
                        rare.append(word.decode("utf-8", "surrogatepass"))
                        times.append(n)
                for column, value in zip(out, (row, len(tokens) + 1, known, low, high, own, rare, times)):
                    column.append(value)
                row += 1
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, out, kinds)],
                names=["doc_id", "held_out", "row", "n_tokens", "known", "low", "high", "own", "rare", "times"],
            )

    rows = keep(map_batches(
        source, split,
        "doc_id long, held_out boolean, row long, n_tokens long, known long, low double, "
        "high double, own double, rare array<string>, times array<long>",
    ))
    rest = (
        rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t"))
        .select("row", F.col("t.rare").alias("word"), F.col("t.times").alias("times"))
        .join(scored, "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("known"), F.col("times")).otherwise(F.lit(0))).alias("more_known"),
            F.sum(F.col("times") * F.col("base")).alias("more_low"),
            F.sum(F.col("times") * F.col("model")).alias("more_high"),
            F.sum(F.col("times") * F.col("plain")).alias("more_own"),
        )
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return rows.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (plus("known", "more_known") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        plus("low", "more_low").alias("base_score"),
        plus("high", "more_high").alias("score"),
        plus("own", "more_own").alias("lattice_score"),
    )
