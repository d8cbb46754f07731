"""Personal data: known forms, and what a skip-chain model finds beyond them.

Known forms are found by rule. The model then reads the tokens of a document that could
be personal data, with their neighbours. Neighbouring tokens share potentials, and so do
distant ones that repeat each other: the same token, the same digits in another notation,
or the name part of an e-mail address found elsewhere. Loopy sum-product messages over
both kinds of edges settle the labels of a document together, so that a form that is
told by its surroundings once is told everywhere in the document.

The model learns from the known forms of a bounded sample of documents: token scores by
logistic regression, potentials from how often labels meet along an edge. Documents are
labelled where they are; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnledger.llm.common import map_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")
# Labels of tokens: none of the kinds, then the kinds.
LABELS = 1 + len(KINDS)
# Documents with candidate tokens that the model learns from, and their tokens, at most.
SAMPLE_DOCS = 2000
SAMPLE_TOKENS = 50_000
# Probability from which a label adds a span.
SURE = 0.9
# Messages count as settled when a round changes them by less than this.
TOLERANCE = 1e-6
# Rounds of message passing at most: so many and, for each edge of the longest path through
# a document, SPAN_ROUNDS more. A bond within three keeps at most 0.99 of what passes it,
# so beyond FAR edges less than the tolerance is left.
ROUNDS = 60
SPAN_ROUNDS = 4
FAR = 2000
CUES = 48
SEED = 29

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
CANDIDATE = re.compile(r"[0-9@]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins at the first digit of a run: further on it would only be shorter.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EDGES = "\"'`.,;:!?()[]{}<>|*$%&#"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """By the @ signs, so that a long text without one costs nothing: the part before it
    is the run of its characters since the last match."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, 0, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def known_spans(text: str) -> list[Span]:
    """Spans of all kinds by start and kind."""
    spans = list(emails(text))
    for m in IP.finditer(text):
        # A part of many digits is too large without being read.
        if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


@dataclass
class Graph:
    """Tokens of one document with their edges."""

    starts: list[int]
    ends: list[int]
    rows: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


FEATURES = 40 + CUES


def token_features(core: str, before: str, after: str) -> list[int]:
    """Columns that are 1: the token's shape, and what stands beside it."""
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    dots = core.count(".")
    out = [0]
    levels = (0, 2, 4, 7, 9, 13, 15, 19)
    out.append(1 + sum(digits > n for n in levels))  # 1 to 9
    out.append(10 + sum(letters > n for n in (0, 3, 8)))  # 10 to 13
    out.append(14 + min(dots, 4))  # 14 to 18
    if "@" in core:
        out.append(20 if "." in core.partition("@")[2] else 19)
    if core[:1] == "+":
        out.append(21)
    if "-" in core:
        out.append(22)
    if core and digits + dots == len(core):
        parts = core.split(".")
        out.append(23 if all(len(p) in (1, 2, 3) for p in parts) and dots == 3 else 24)
    if core.isdigit():
        out.append(25)
    for at, near in ((26, before), (32, after)):
        n = sum("0" <= c <= "9" for c in near)
        out.append(at + (n > 0) + (n > 3))  # none, few, many digits
        if near[:1] in ("+", "("):
            out.append(at + 3)
        if near[-1:] in (":", "="):
            out.append(at + 4)
    word = before.strip(EDGES).lower()
    if word.isalpha():
        out.append(40 + zlib.crc32(word.encode()) % CUES)
    return out


def graph_of(text: str) -> Graph | None:
    """Nodes are tokens with a digit or an @, tokens that repeat the name part of an
    address, and the tokens next to these; None for a text without any."""
    if not CANDIDATE.search(text):
        return None
    tokens = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text)]
    cores = [t.strip(EDGES) for _, _, t in tokens]
    names = {c.partition("@")[0].lower() for c in cores if "@" in c}
    names = {n for n in names if len(n) >= 4}
    main = {
        i for i, (_, _, t) in enumerate(tokens)
        if CANDIDATE.search(t) or names and cores[i].lower() in names
    }
    nodes = sorted({j for i in main for j in (i - 1, i, i + 1) if 0 <= j < len(tokens)})
    number = {token: n for n, token in enumerate(nodes)}
    starts, ends, rows = [], [], []
    for i in nodes:
        start, end, token = tokens[i]
        lead = len(token) - len(token.lstrip(EDGES)) if cores[i] else 0
        starts.append(start + lead)
        ends.append(start + lead + len(cores[i]) if cores[i] else end)
        rows.append(token_features(
            cores[i], tokens[i - 1][2] if i else "", tokens[i + 1][2] if i + 1 < len(tokens) else ""
        ))
    chain = [(n, n + 1) for n in range(len(nodes) - 1) if nodes[n] + 1 == nodes[n + 1]]
    last: dict[tuple[str, str], int] = {}
    skip = set()
    for i in sorted(main):
        core = cores[i].lower()
        digits = re.sub("[^0-9]", "", core)
        keys = [("token", core)]
        if len(digits) >= 6:
            keys.append(("digits", digits))
        if "@" in core or core in names:
            keys.append(("name", core.partition("@")[0]))
        for key in keys:
            # To the occurrence before: a token that comes n times has n - 1 edges.
            if key in last and i - last[key] > 1:
                skip.add((number[last[key]], number[i]))
            last[key] = i
    return Graph(starts, ends, rows, chain, sorted(skip))


def longest_path(graph: Graph) -> int:
    """Edges of the longest path that goes forward in the document."""
    depth = [0] * len(graph.starts)
    for a, b in sorted(graph.chain + graph.skip):
        depth[b] = max(depth[b], depth[a] + 1)
    return max(depth, default=0)


def labels_of(graph: Graph, spans: list[Span]) -> np.ndarray:
    """Label of each token: the kind of a span that holds some of it."""
    out = np.zeros(len(graph.starts), np.int64)
    at = 0
    for i, (start, end) in enumerate(zip(graph.starts, graph.ends)):
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        for s, kind, e in spans[at : at + 4]:
            if s < end and start < e:
                out[i] = 1 + kind
                break
    return out


@dataclass
class Model:
    weights: np.ndarray  # (features, labels)
    chain: np.ndarray  # (labels, labels)
    skip: np.ndarray

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.weights, self.chain, self.skip

    def beliefs(self, graphs: list[Graph]) -> np.ndarray:
        """Label probabilities of all tokens of some documents, by loopy sum-product in
        log space over all their edges at once; messages are damped by half. Rounds go on
        until all messages are settled, and pass over those that are."""
        first = np.cumsum([0, *[len(g.starts) for g in graphs]])
        own = np.zeros((first[-1], LABELS))
        at = [(n, c) for g, s in zip(graphs, first) for n, row in enumerate(g.rows, s) for c in row]
        nodes, columns = (np.array(x, np.int64) for x in zip(*at))
        np.add.at(own, nodes, self.weights[columns])
        chain = [(s + a, s + b) for g, s in zip(graphs, first) for a, b in g.chain]
        skip = [(s + a, s + b) for g, s in zip(graphs, first) for a, b in g.skip]
        if not chain and not skip:
            return _softmax(own)
        a, b = (np.array(x, np.int64) for x in zip(*chain, *skip))
        bond = np.concatenate([
            np.broadcast_to(self.chain, (len(chain), LABELS, LABELS)),
            np.broadcast_to(self.skip, (len(skip), LABELS, LABELS)),
        ])
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        bond = np.concatenate([bond, bond.transpose(0, 2, 1)])
        half = len(a)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        messages = np.zeros((2 * half, LABELS))
        total, open_edges = own.copy(), np.arange(2 * half)
        for _ in range(ROUNDS + SPAN_ROUNDS * min(FAR, max(map(longest_path, graphs)))):
            into = (total[source[open_edges]] - messages[back[open_edges]])[:, :, None] + bond[open_edges]
            top = into.max(axis=1)
            new = top + np.log(np.exp(into - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = 0.5 * (new - messages[open_edges])
            messages[open_edges] += change
            np.add.at(total, target[open_edges], change)
            moved = open_edges[np.abs(change).max(axis=1) >= TOLERANCE / 2]
            if not len(moved):
                break
            # What leaves a node that a moved message has reached is to be told anew.
            touched = np.zeros(len(own), bool)
            touched[target[moved]] = True
            again = touched[source]
            again[moved] = True
            open_edges = np.flatnonzero(again)
        total = own.copy()
        np.add.at(total, target, messages)
        return _softmax(total)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def added_spans(text: str, graph: Graph, beliefs: np.ndarray, spans: list[Span],
                sure: float = SURE) -> list[Span]:
    """Runs of neighbouring tokens that are surely of one kind and touch no known span.

    Only tokens with a digit or an @, or linked to another token by a repeat, begin or
    end a run."""
    label = beliefs.argmax(axis=1)
    label[beliefs.max(axis=1) < sure] = 0
    linked = {n for edge in graph.skip for n in edge}
    for n, (s, e) in enumerate(zip(graph.starts, graph.ends)):
        if n not in linked and not CANDIDATE.search(text, s, e):
            label[n] = 0
    next_to = {a for a, _ in graph.chain}
    out, n = [], 0
    while n < len(label):
        end = n
        while end in next_to and label[end + 1] == label[n]:
            end += 1
        if label[n]:
            start, stop = graph.starts[n], graph.ends[end]
            if not any(s < stop and start < e for s, _, e in spans):
                out.append((start, int(label[n]) - 1, stop))
        n = end + 1
    return out


def regress(x: np.ndarray, y: np.ndarray, steps: int = 800, batch: int = 512,
            rate: float = 0.05, decay: float = 1e-4, seed: int = SEED) -> np.ndarray:
    """Weights of a multinomial logistic regression, by Adam."""
    rng = np.random.default_rng(seed)
    w = np.zeros((x.shape[1], LABELS))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), batch)
        p = _softmax(x[rows] @ w)
        p[np.arange(batch), y[rows]] -= 1
        slope = x[rows].T @ p / batch + decay * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def bonds(counts: np.ndarray) -> np.ndarray:
    """Potentials from how often two labels meet: the log of what they do more often than
    by chance, kept within three."""
    both = counts + counts.T + 0.5
    share = both / both.sum()
    alone = share.sum(axis=1)
    return np.clip(np.log(share / np.outer(alone, alone)), -3, 3)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> Model:
    """Learn from at most `sample_docs` documents with candidate tokens, of these at most
    `sample_tokens` tokens. Without any the model finds nothing."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    some = source.filter(F.col("text").rlike("[0-9@]"))
    ids = (
        some.filter("doc_id IS NOT NULL").select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample_docs)
    )
    drawn = some.join(F.broadcast(ids), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                graph = graph_of(text)
                if graph is None:
                    continue
                y = labels_of(graph, known_spans(text))
                out += [(doc, "token", n, int(y[n]), 0, row, 1) for n, row in enumerate(graph.rows)]
                for name, edges in (("chain", graph.chain), ("skip", graph.skip)):
                    met = np.zeros((LABELS, LABELS), np.int64)
                    for a, b in edges:
                        met[y[a], y[b]] += 1
                    out += [(doc, name, 0, int(a), int(b), None, int(met[a, b])) for a, b in zip(*np.nonzero(met))]
            if out:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                    names=["doc_id", "what", "node", "a", "b", "row", "n"],
                )

    found = map_batches(
        drawn, run, "doc_id long, what string, node int, a int, b int, row array<int>, n long"
    ).persist()
    counts = {name: np.zeros((LABELS, LABELS)) for name in ("chain", "skip")}
    # 25 rows of each kind of edge.
    for r in found.filter("what != 'token'").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect():
        counts[r.what][r.a, r.b] = r.n
    tokens = (
        found.filter("what = 'token'")
        .orderBy(F.xxhash64("doc_id", "node", F.lit(SEED)), "doc_id", "node", "a", "row")
        .limit(sample_tokens).select("a", "row").collect()
    )
    found.unpersist()
    if not tokens:
        return Model(np.eye(FEATURES, LABELS) * 0, bonds(counts["chain"]), bonds(counts["skip"]))
    x = np.zeros((len(tokens), FEATURES), np.float32)
    for n, r in enumerate(tokens):
        x[n, r.row] = 1
    return Model(regress(x, np.array([r.a for r in tokens])), bonds(counts["chain"]), bonds(counts["skip"]))


def find(docs: DataFrame, model: Model, sure: float = SURE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) per row.

    Counts and base_sha256 are of the known forms; spans has these and the added ones, as
    kind:start:end in code points, end exclusive, by start and then kind. Null texts are
    empty and have no span; repeated rows stay repeated; an empty table gives no row.
    Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [known_spans(t) for t in texts]
            graphs = [graph_of(t) for t in texts]
            extra: list[list[Span]] = [[] for _ in texts]
            some = [i for i, g in enumerate(graphs) if g is not None]
            if some:
                beliefs, at = own.beliefs([graphs[i] for i in some]), 0
                for i in some:
                    size = len(graphs[i].starts)
                    extra[i] = added_spans(texts[i], graphs[i], beliefs[at : at + size], base[i], sure)
                    at += size
            number = lambda kind: pa.array([sum(k == kind for _, k, _ in s) for s in base], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *map(number, range(len(KINDS))),
                    pa.array([hashlib.sha256(shown(s).encode()).hexdigest() for s in base], pa.string()),
                    pa.array([shown(sorted(s + e)) for s, e in zip(base, extra)], pa.string()),
                    pa.array([len(e) for e in extra], pa.int64()),
                ],
                names=NAMES,
            )

    source = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    kinds = ["long"] * 5 + ["string"] * 2 + ["long"]
    return map_batches(source, run, ", ".join(f"{n} {k}" for n, k in zip(NAMES, kinds)))


NAMES = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
