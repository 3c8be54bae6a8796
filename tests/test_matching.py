"""Line matching against picking the best remaining pair again and again."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import matching


def plain(predicted, gold, least):
    """The best remaining pair, as long as there is one."""
    left = {(SequenceMatcher(None, p, g).ratio(), i, j) for i, p in enumerate(predicted) for j, g in enumerate(gold)}
    left = {x for x in left if x[0] >= least}
    out = set()
    while left:
        r, i, j = max(left)
        out.add((i, j, round(r, 9)))
        left = {x for x in left if x[1] != i and x[2] != j}
    return out


def noisy(rng, line, share):
    out = []
    for c in line:
        x = rng.random()
        out.append("" if x < share / 2 else c + rng.choice("abcxyz ") if x < share else c)
    return "".join(out)


def lines_of(rng, n, alphabet="etaoinshrdlu", longest=60):
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7)))
    return [" ".join(word() for _ in range(rng.randint(1, longest // 5)))[:longest] for _ in range(n)]


def long_table(spark, docs):
    return spark.createDataFrame([(d, i, x) for d, lines in docs.items() for i, x in enumerate(lines)], "doc string, place int, line string").repartition(3)


def check(spark, predicted, gold, least, **options):
    got = {}
    for r in matching.line_matches(long_table(spark, predicted), long_table(spark, gold), least, **options).collect():
        got.setdefault(r["doc"], set()).add((r["i"], r["j"], round(r["ratio"], 9)))
    for d in predicted:
        assert got.get(d, set()) == plain(predicted[d], gold.get(d, []), least), d


def made(seed, sizes):
    rng = random.Random(seed)
    gold = {f"d{k}": lines_of(rng, n) for k, n in enumerate(sizes)}
    predicted = {}
    for d, lines in gold.items():
        p = [noisy(rng, x, rng.choice([0, 0, 0.05, 0.15, 0.3])) for x in lines if rng.random() < 0.9] + lines_of(rng, 5)
        p += [*lines[:1], *lines[:1], "", "", "a", "Section 101. The parties agree.", "Section 102. The parties agree.", "Section 110. The parties agree."]
        rng.shuffle(p)
        predicted[d] = p
        gold[d] = [*lines, "", "b", "a", "Section 103. The parties agree.", "Section 111. The parties agree."]
    return predicted, gold


def test_rows_of_the_greedy_choice(spark):
    check(spark, *made(1, [40, 70, 1, 0]), 0.85)


@pytest.mark.parametrize("least", [0.6, 0.97, 1.0])
def test_other_thresholds(spark, least):
    check(spark, *made(2, [30]), least)


def test_rounds_in_joins_give_the_same(spark):
    check(spark, *made(3, [25, 12]), 0.8, in_task=5)


def test_five_thousand_lines(spark):
    """A hundred alphabets without a common letter: blocks can be held against the plain choice one by one."""
    rng = random.Random(4)
    predicted, gold, want = [], [], set()
    for b in range(100):
        alphabet = "".join(chr(0x4E00 + b * 40 + k) for k in range(25))
        g = [x.replace(" ", alphabet[0]) for x in lines_of(rng, 50, alphabet[1:])]
        p = ["".join(alphabet[rng.randrange(25)] if rng.random() < 0.06 else c for c in x) for x in g]
        rng.shuffle(p)
        want |= {(len(predicted) + i, len(gold) + j, r) for i, j, r in plain(p, g, 0.85)}
        predicted += p
        gold += g
    assert len(gold) == 5000
    got = matching.line_matches(long_table(spark, {"x": predicted}), long_table(spark, {"x": gold})).collect()
    assert {(r["i"], r["j"], round(r["ratio"], 9)) for r in got} == want and len(want) > 2000


def test_similar_lines_share_a_rare_gram():
    """The bound behind the prefixes, on pairs of every length and any order of the grams."""
    rng = random.Random(5)
    for least in (0.6, 0.85, 0.95):
        seen = 0
        for _ in range(3000):
            a = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 60)))
            b = noisy(rng, a, (1 - least) * rng.random())
            if not b or SequenceMatcher(None, a, b).ratio() < least:
                continue
            seen += 1
            sides = []
            for x in (a, b):
                tokens = set()
                for q in matching._schemes(len(x), least):
                    numbered = sorted(matching.grams(x, q)[1].tolist())
                    tokens |= {(q, t) for t in numbered[: matching.lost_grams(len(x), q, least) + 1]}
                sides.append(tokens)
            assert sides[0] & sides[1], (a, b, least)
        assert seen > 500


def test_gram_numbers_count_common_grams():
    numbers = lambda x: set(matching.grams(x, 1)[1].tolist())
    assert len(numbers("aabc") & numbers("abcc")) == 3
    assert len(set(matching.grams("aaaaa", 3)[1].tolist())) == 3 and len(matching.grams("ab", 3)[0]) == 0


def test_dominance_in_a_block_of_ties():
    i, j = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(4), indexing="ij"))
    at = matching.dominant_pairs(i, j, np.full(24, 0.9))
    assert sorted(zip(i[at].tolist(), j[at].tolist(), strict=True)) == [(2, 0), (3, 1), (4, 2), (5, 3)]


def test_nulls_and_arrays(spark):
    df = spark.createDataFrame([("a", ["abc def", "xyz", None], ["abc deg", "xyz"]), ("b", None, ["x"]), ("c", [], []), (None, ["q"], ["q"])], "k string, predicted array<string>, gold array<string>")
    got = {r["k"]: (r["n_predicted"], r["n_gold"], r["matched"]) for r in matching.match_clauses(df, "k", 0.8).collect()}
    assert got["a"] == (3, 2, 2) and got["c"] == (0, 0, 0) and got["b"][2] == 0 and got[None][2] == 0
    assert matching.line_matches(long_table(spark, {"a": ["x"]}).where(F.lit(False)), long_table(spark, {"a": ["x"]})).count() == 0
    with pytest.raises(ValueError):
        matching.line_matches(long_table(spark, {"a": ["x"]}), long_table(spark, {"a": ["x"]}), 0)


def test_common_subsequence_bounds_the_ratio():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd\u00e9 \U00010000") for _ in range(rng.randint(1, 40))) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
            row = new
        n = matching.common_subsequence(a, matching.character_places(b), len(b))
        assert n == row[-1] and SequenceMatcher(None, a, b).ratio() <= 2 * n / (len(a) + len(b)) + 1e-12


def test_unlike_lines_of_equal_letters_are_not_left_to_difflib(monkeypatch):
    import pyarrow as pa

    calls = []
    ratio = SequenceMatcher.ratio
    monkeypatch.setattr(matching.SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))
    a = "the quick brown fox jumps over the lazy dog at noon"
    rows = {"doc": pa.array([1, 1]), "i": pa.array([0, 1], pa.int32()), "j": pa.array([0, 0], pa.int32()), "a": pa.array([a[::-1], a + "s"]), "b": pa.array([a, a])}
    (got,) = matching._ratios(0.85)(iter([pa.RecordBatch.from_pydict(rows)]))
    assert got.column("i").to_pylist() == [1] and len(calls) == 1


def test_documents_are_matched_in_their_rows(spark, monkeypatch):
    """Without ``line_matches``, and the same with it where a row would hold too many pairs."""
    predicted, gold = made(6, [30, 12, 1, 0])
    for d in ("d0", "d1"):  # lines over difflib's length, near and far from their partners
        long = lines_of(random.Random(7), 6, longest=60)
        gold[d] += [" ".join(long[k:] + long[:k]) * 3 for k in range(6)]
        predicted[d] += [(" ".join(long[k:] + long[:k]) * 3).replace("th", "h").replace("e s", "es") for k in range(6)]
    df = spark.createDataFrame([(d, predicted[d], gold[d]) for d in gold], "k string, predicted array<string>, gold array<string>")
    want = {d: len(plain(predicted[d], gold[d], 0.85)) for d in gold}
    joined = matching.match_clauses(df, "k", in_row=200)
    assert {r["k"]: r["matched"] for r in joined.collect()} == want and want["d0"] > 20
    monkeypatch.setattr(matching, "line_matches", lambda *_: pytest.fail("lines left their rows"))
    got = matching.match_clauses(df, "k").collect()
    assert {r["k"]: r["matched"] for r in got} == want
    assert all((r["n_predicted"], r["n_gold"]) == (len(predicted[r["k"]]), len(gold[r["k"]])) for r in got)


def test_ratios_are_those_of_difflib():
    rng = random.Random(8)
    for _ in range(400):
        alphabet = rng.choice(["ab", "abcdefghijklmnop \n", "etaoinshrdlu .,KQ7", " éxyz\U00010000"])
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 450)))
        b = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 450))) if rng.random() < 0.4 else noisy(rng, a, 0.1 * rng.random()) + "QZ1!" + a[:9]
        want = SequenceMatcher(None, a, b).ratio()
        assert matching.ratio(a, b, matching.rare_places(b)) == want
        assert matching.ratio(a, b, matching.rare_places(b), 0.85) == (want if want >= 0.85 else 0.0)
