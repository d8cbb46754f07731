"""Documents that hold benchmark items, up to a few edits.

An item of n characters may differ in k = floor(rate * n) edits. Cut into k + 1 pieces,
at least one piece of any occurrence is untouched. All pieces of all items are searched
exactly in one pass over a text (Aho-Corasick); around each hit Myers' bit-parallel
algorithm finds the smallest distance between the item and any passage there.

Texts and items are compared in lower case with runs of white space as one space.
Documents stay where they are: the items are sent to them. A benchmark above
`ITEM_CHARS` is sent in several parts, with one pass over the documents for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnledger.llm.common import bounded_batches, map_batches, text_or_empty

# Edits allowed per character of an item.
RATE = 0.06
# Characters of benchmark items that are sent to the tasks at a time.
ITEM_CHARS = 8_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): `errors` + 1 pieces of near equal length, none of them empty."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Distances of a pattern to the passages of a text that end at each position."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.every = (1 << self.size) - 1
        self.top = 1 << self.size - 1
        self.where: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def distances(self, text: str, anchored: bool = False) -> Iterator[int]:
        """Smallest distance to a passage that ends after each character; `anchored`:
        that begins at the start of the text."""
        every, top, where = self.every, self.top, self.where
        plus, minus, score, first = every, 0, self.size, int(anchored)
        for c in text:
            same = where.get(c, 0)
            down = same | minus
            across = (((same & plus) + plus) ^ plus) | same
            up = minus | ~(across | plus) & every
            low = plus & across
            if up & top:
                score += 1
            elif low & top:
                score -= 1
            up = (up << 1 | first) & every
            low = low << 1 & every
            plus = low | ~(down | up) & every
            minus = up & down
            yield score

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the nearest passage; the first of several."""
        return min(((d, i + 1) for i, d in enumerate(self.distances(text))), default=(self.size, 0))


@dataclass
class Item:
    item_id: int | None
    text: str
    errors: int


class Finder:
    """All items of one part of a benchmark, ready to be searched."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = items
        spots: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(items):
            for offset, piece in pieces(item.text, item.errors):
                spots.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in spots.items():
            self.automaton.add_word(piece, (len(piece), at))
        if spots:
            self.automaton.make_automaton()
        self.forward: dict[int, Myers] = {}
        self.backward: dict[int, Myers] = {}

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item number, distance, start, end) in the normal form of a text: the nearest
        passage for each item that has one within its errors."""
        text = normal(text)
        if not self.items:
            return
        starts: dict[int, set[int]] = {}
        for end, (size, spots) in self.automaton.iter(text):
            for n, offset in spots:
                starts.setdefault(n, set()).add(end + 1 - size - offset)
        for n, found in sorted(starts.items()):
            item, best = self.items[n], None
            exact = min((s for s in found if s >= 0 and text.startswith(item.text, s)), default=None)
            if exact is not None:
                yield n, 0, exact, exact + len(item.text)
                continue
            if not item.errors:
                continue
            search = self.forward.setdefault(n, Myers(item.text))
            for low, high in self._windows(sorted(found), item):
                low = max(0, low)
                distance, end = search.best(text[low:high])
                if distance <= item.errors and (best is None or distance < best[0]):
                    best = distance, low + end
            if best is not None:
                distance, end = best
                back = self.backward.setdefault(n, Myers(item.text[::-1]))
                low = max(0, end - len(item.text) - item.errors)
                sizes = back.distances(text[low:end][::-1], anchored=True)
                size = next(i + 1 for i, d in enumerate(sizes) if d == distance)
                yield n, distance, end - size, end

    @staticmethod
    def _windows(starts: list[int], item: Item) -> Iterator[tuple[int, int]]:
        """Passages around supposed starts; overlapping ones become one."""
        reach = len(item.text) + item.errors
        low = high = None
        for s in starts:
            if high is not None and s - item.errors <= high:
                high = s + reach
            else:
                if high is not None:
                    yield low, high
                low, high = s - item.errors, s + reach
        if high is not None:
            yield low, high


def item_parts(benchmark: DataFrame, rate: float = RATE, limit: int = ITEM_CHARS) -> Iterator[list[Item]]:
    """The items in parts of about `limit` characters; null and blank items are left out,
    rows with the same id and text are one item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    items = items.distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // limit))
    for part in range(count):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == part)
        rows = sorted(((r.item_id, normal(r.text)) for r in own.collect()), key=str)
        yield [Item(i, t, int(rate * len(t))) for i, t in rows if t]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE,
                 limit: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end): for each row of `docs` and each item that
    it holds, the nearest passage, the first of equally near ones.

    Positions count the characters of the text in lower case with single spaces, end
    exclusive. Null and empty texts hold nothing; repeated rows give repeated results;
    without documents or items there is no row. Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    spark, result = docs.sparkSession, None
    for items in item_parts(benchmark, rate, limit):
        # Plain values: broadcasts are not pickled with the code.
        sent = spark.sparkContext.broadcast([(i.item_id, i.text, i.errors) for i in items])

        def run(batches, sent=sent):
            finder = Finder([Item(*i) for i in sent.value])
            for batch in batches:
                rows = [
                    (d, finder.items[n].item_id, distance, start, end)
                    for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                    for n, distance, start, end in finder.matches(t)
                ]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=NAMES
                    )

        found = map_batches(source, run, "doc_id long, item_id long, distance int, start int, end int")
        result = found if result is None else result.unionByName(found)
    return result


NAMES = ["doc_id", "item_id", "distance", "start", "end"]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE,
                      limit: int = ITEM_CHARS) -> DataFrame:
    """The rows of `docs`, all columns, that hold no item."""
    bounded_batches(docs.sparkSession)
    names = [F.col(f"`{c}`") for c in docs.columns]
    for items in item_parts(benchmark, rate, limit):
        plain = [(i.item_id, i.text, i.errors) for i in items]
        sent = docs.sparkSession.sparkContext.broadcast(plain)

        @F.pandas_udf("boolean")
        def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            finder = Finder([Item(*i) for i in sent.value])
            for texts in batches:
                yield pd.Series([next(finder.matches(t), None) is None for t in texts], dtype=bool)

        docs = docs.withColumn("__llm_clean", clean(text_or_empty())).filter("__llm_clean").select(*names)
    return docs
