import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnledger.llm import lattice_lm
from turnledger.llm.lattice_lm import BEGIN, Lattice


def small():
    pieces = [(BEGIN, 0.0), (BEGIN + "a", -1.0), (BEGIN + "ab", -2.0), ("a", -3.0), ("b", -4.0), ("ab", -5.0), ("ba", -6.0), ("aba", -7.0)]
    return Lattice.from_scores(pieces, [0.0] * 256)


def every_cut(lattice, text, first=True):
    """Sum over all cuts, one by one."""
    if not text:
        return [0.0]
    out = []
    for j in range(1, len(text) + 1):
        weight = lattice.logs.get(text[:j])
        if weight is not None and first == text.startswith(BEGIN):
            out += [weight + rest for rest in every_cut(lattice, text[j:], False)]
    return out


def with_stops(lattice, text, first=True):
    if not text:
        return 1.0
    total = 0.0
    for j in range(1, len(text) + 1):
        weight = lattice.logs.get(text[:j])
        if weight is not None and first == text.startswith(BEGIN):
            after = text[j:]
            total += math.exp(weight) * (lattice.stop if not after else (1 - lattice.stop) * with_stops(lattice, after, False))
    return total


def test_forward_sums_over_all_cuts():
    lattice, rng = small(), random.Random(2)
    for _ in range(100):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        assert len(every_cut(lattice, BEGIN + word)) >= 1
        assert math.exp(lattice.log_probability(word)) == pytest.approx(with_stops(lattice, BEGIN + word))


def test_expected_pieces_are_shares_of_cuts():
    lattice, rng = small(), random.Random(3)
    more = math.log(1 - lattice.stop)

    def cuts(text, first=True):
        if not text:
            yield 0.0, []
        for j in range(1, len(text) + 1):
            weight = lattice.logs.get(text[:j])
            if weight is not None and first == text.startswith(BEGIN):
                for rest, names in cuts(text[j:], False):
                    yield weight + rest + (0 if first else more), [text[:j], *names]

    for _ in range(40):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 8)))
        every = [(math.exp(w), names) for w, names in cuts(BEGIN + word)]
        total, expected = sum(w for w, _ in every), Counter()
        for w, names in every:
            for name in names:
                expected[name] += w / total
        got = Counter()
        for piece, share in lattice.expected(word):
            got[piece] += share
        assert dict(got) == pytest.approx(dict(expected))
    better = lattice.revised({"▁ab": 90.0, "ba": 10.0}, 90)
    assert better.logs["▁ab"] > lattice.logs["▁ab"] and sum(math.exp(w) for p, w in better.logs.items() if p[0] == BEGIN) == pytest.approx(1)


def test_long_words_are_scaled(monkeypatch):
    lattice, rng = small(), random.Random(5)
    for word in ["".join(rng.choice("abé") for _ in range(n)) for n in (1, 7, 20, 39)]:
        plain = sorted(lattice.expected(word))
        monkeypatch.setattr(lattice_lm, "SHORT", 0)
        scaled = sorted(lattice.expected(word))
        monkeypatch.undo()
        assert [p for p, _ in plain] == [p for p, _ in scaled]
        assert [x for _, x in plain] == pytest.approx([x for _, x in scaled])
    total = sum(x for p, x in lattice.expected("ab" * 3000) for _ in p.removeprefix(BEGIN))
    assert total == pytest.approx(6000)


def test_words_share_at_most_probability_one():
    lattice = small()
    words = [""]
    total = 0.0
    for _ in range(9):
        words = [w + c for w in words for c in "ab"]
        total += sum(math.exp(lattice.log_probability(w)) for w in words)
    assert 0.01 < total <= 1


def test_unknown_characters_and_long_words():
    lattice = lattice_lm.load_lattice()
    assert lattice.log_probability("日本🙂") < lattice.log_probability("the") < 0
    assert lattice.log_probability("the") > lattice.log_probability("hte")
    assert -3e6 < lattice.log_probability("q" * 100_000) < -1e5
    assert math.isfinite(lattice.log_probability(BEGIN + "a" + BEGIN))


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_matches_plain_counts(spark, head):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 60])]).title() for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " \t\n"), (None, "a b"), (5, rows[5][1]), (73, "z" * 50_000 + " a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "row": F.lit(1)})
    lattice = small()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts, ends = Counter(), 0
    for d, t in rows:
        if not out(d):
            counts.update(split(t))
            ends += 1
    n, types = sum(counts.values()) + ends, len(counts) + 1
    pieces = Counter()
    for w in counts:
        for piece, share in lattice.expected(w):
            pieces[piece] += share
    revised = lattice.revised(pieces, len(counts))
    expected = []
    for d, t in rows:
        known, base, score = 1, math.log10((ends + 1) / (n + types + 1)), math.log10(ends / n)
        own = score
        for w in split(t):
            c, log = counts[w], revised.log_probability(w)
            known += c > 0
            base += math.log10((c + 1) / (n + types + 1))
            own += log / math.log(10) + math.log10(1 - ends / n)
            share = 0.75 * len(counts) / n
            score += math.log10((c - 0.75) / n + share * math.exp(log)) if c else (log + math.log(share)) / math.log(10)
        expected.append((d, out(d), len(split(t)) + 1, known, n, base, score, own))
    got = [tuple(r) for r in lattice_lm.score_texts(docs.repartition(3), lattice, head=head).collect()]
    order = lambda r: (str(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(expected)
    for g, e in zip(sorted(got, key=order), sorted(expected, key=order)):
        assert g[:5] == e[:5] and g[5:] == pytest.approx(e[5:])


def test_no_training_rows_and_empty_table(spark):
    d = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lattice_lm.score_texts(spark.createDataFrame([(d, "ab")], "doc_id long, text string"), small()).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 2, 0, 0, 0.0)
    assert r.score == pytest.approx(small().revised({}, 0).log_probability("ab") / math.log(10))
    assert r.lattice_score == pytest.approx(r.score)
    assert lattice_lm.score_texts(spark.createDataFrame([], "doc_id long, text string"), small()).collect() == []
