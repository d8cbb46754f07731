import hashlib
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from turnledger.llm import pii_crf as pii


def luhn_ok(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    """By the patterns as they are stated."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn_ok(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_known_forms_match_the_patterns():
    rng = random.Random(12)
    bits = ["a", "b.c", "@", ".", "-", "_", "%", " ", "1", "25", "255", "256", "0001", "4111 1111 1111 1111", "4111-1111-1111-1111",
            "+1 (974) 555-3436", "+", "(", ")", "x@y.z", "1.2.3.4", "\n", "é", "٣", "a@b.c_d@e.f", "5500005555555559"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.known_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000, "1 " * 100_000):
        pii.known_spans(text)


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(1)
    model = pii.Model(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    graph = pii.Graph([0] * 4, [0] * 4, [[0, 3], [1], [2, 7], [5]], [(0, 1)], [(1, 2), (1, 3)])
    own = np.array([model.weights[r].sum(axis=0) for r in graph.rows])
    exact = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        score = sum(own[i, y[i]] for i in range(4)) + model.chain[y[0], y[1]] + model.skip[y[1], y[2]] + model.skip[y[1], y[3]]
        for i in range(4):
            exact[i, y[i]] += np.exp(score)
    exact /= exact.sum(axis=1, keepdims=True)
    old, pii.ROUNDS = pii.ROUNDS, 60
    try:
        assert np.allclose(model.beliefs([graph, graph])[4:], exact, atol=1e-6)
    finally:
        pii.ROUNDS = old


def corpus():
    rng = random.Random(2)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        d = number(15)
        return next(d + c for c in "0123456789" if luhn_ok(d + c))

    rows = []
    for i in range(300):
        words = [rng.choice(["over", "the", "naïve", "version", "3.", "2020", "42"]) for _ in range(30)]
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randrange(30), rng.choice([
                f"write name{i}.{number(2)}@mail.example.com now", f"+1 ({number(3)}) 555-{number(4)}", card(),
                ".".join(str(rng.randint(0, 255)) for _ in range(4))]))
        rows.append((i, " ".join(words)))
    return rows


def test_table(spark):
    rows = corpus() + [(400, None), (401, ""), (None, "a@b.cd"), (402, "x1" * 100_000), (0, "1.2.3.4"), (0, "1.2.3.4"),
                       (403, "call +1 (974) 555-3436 now and later call 1(974)555-3436 again or 19745553436 or 1-974-555-3436 now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("clash"), "row": F.lit(1)})
    model = pii.fit(docs)
    got = sorted(pii.find(docs.repartition(3), model).collect(), key=str)
    assert len(got) == len(rows)
    left = list(got)
    for d, t in rows:
        spans = plain(t or "")
        digest = hashlib.sha256(pii.shown(spans).encode()).hexdigest()
        r = next(r for r in left if r.doc_id == d and r.base_sha256 == digest)
        left.remove(r)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        every = r.spans.split(",") if r.spans else []
        assert set(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans) <= set(every)
        assert len(every) == len(spans) + r.n_added
    # What is added in texts of known forms and plain numbers is a form that a number
    # beside it hides from the patterns.
    texts = dict(corpus())
    for r in got:
        if r.doc_id in texts and r.n_added:
            for span in set(r.spans.split(",")) - {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain(texts[r.doc_id])}:
                _, s, e = span.split(":")
                found = texts[r.doc_id][int(s) : int(e)]
                assert sum(c in "0123456789" for c in found) >= 10 or "@" in found, found
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).collect() == []


def test_a_repeat_is_told_by_the_other_occurrence():
    """The same digits, once in a clear form and once in an unclear one."""
    weights = np.zeros((pii.FEATURES, pii.LABELS))
    weights[21, 4] = 8  # begins with +: a phone
    skip = np.full((5, 5), -3.0) + 6 * np.eye(5)
    graph = pii.graph_of("ask +19745553436 or, later on in the text, 19745553436 too")
    assert len(graph.skip) == 1
    far = graph.skip[0][1]
    alone = pii.Model(weights, np.zeros((5, 5)), np.zeros((5, 5))).beliefs([graph])
    linked = pii.Model(weights, np.zeros((5, 5)), skip).beliefs([graph])
    assert alone[far, 4] < 0.3 < 0.9 < linked[far, 4]


def exact_on_a_chain(own, bond):
    """Marginals by forward and backward sums."""
    ahead, behind = np.zeros_like(own), np.zeros_like(own)
    for i in range(1, len(own)):
        ahead[i] = np.log(np.exp((own[i - 1] + ahead[i - 1])[:, None] + bond).sum(axis=0))
        ahead[i] -= ahead[i].max()
    for i in range(len(own) - 2, -1, -1):
        behind[i] = np.log(np.exp((own[i + 1] + behind[i + 1])[None, :] + bond).sum(axis=1))
        behind[i] -= behind[i].max()
    return pii._softmax(own + ahead + behind)


def test_evidence_reaches_every_repeat():
    """Repeats of which only the first has evidence, in a short and a long document."""
    weights, bond = np.zeros((pii.FEATURES, pii.LABELS)), np.full((5, 5), -3.0) + 6 * np.eye(5)
    weights[21, 4] = 8
    model = pii.Model(weights, np.zeros((5, 5)), bond)
    chains = [
        pii.Graph([0] * n, [0] * n, [[21]] + [[0]] * (n - 1), [], [(i, i + 1) for i in range(n - 1)])
        for n in (20, 400)
    ]
    got, at = model.beliefs(chains), 0
    for graph in chains:
        n = len(graph.starts)
        own = np.array([weights[r].sum(axis=0) for r in graph.rows])
        assert np.allclose(got[at : at + n], exact_on_a_chain(own, bond), atol=1e-4)
        at += n
    assert got[8, 4] > 0.9 and got[19, 4] > 0.8 and pii.longest_path(chains[1]) == 399
