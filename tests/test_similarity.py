import math
from difflib import SequenceMatcher

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nomenlink.functions import similarity as s

WORDS = st.text(alphabet="abcde ", max_size=14)


def lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


PAIRS = st.lists(st.tuples(WORDS, WORDS), max_size=8)


def ratio_by_table(a, b):
    return 2 * lcs_by_table(a, b) / (len(a) + len(b)) if a or b else 1.0


def sides(pairs):
    return [a for a, _ in pairs], [b for _, b in pairs]


@settings(max_examples=200, deadline=None)
@given(PAIRS)
def test_lcs_of_a_batch_equals_the_table(pairs):
    assert s.lcs_lengths(*sides(pairs)).tolist() == [lcs_by_table(a, b) for a, b in pairs]
    assert s.indel_ratios(*sides(pairs)).tolist() == [ratio_by_table(a, b) for a, b in pairs]


@settings(max_examples=100, deadline=None)
@given(PAIRS)
def test_partial_ratio_is_the_best_window(pairs):
    def best(short, long):
        windows = [long[max(0, k) : k + len(short)] for k in range(1 - len(short), len(long))]
        return max([ratio_by_table(short, w) for w in windows if w], default=0.0)

    def expected(a, b):
        if not a and not b:
            return 1.0
        return max(best(a, b), best(b, a)) if len(a) == len(b) else best(*sorted((a, b), key=len))

    assert s.partial_ratios(*sides(pairs)).tolist() == [expected(a, b) for a, b in pairs]


LONG = st.text(alphabet="abcdefghijklmnopqrst", min_size=150, max_size=420)


@settings(max_examples=200, deadline=None)
@given(PAIRS, st.lists(st.tuples(LONG, LONG), max_size=2))
def test_block_ratio_equals_the_standard_matcher(pairs, long_pairs):
    pairs = pairs + long_pairs + [("ab" * 150, "ba" * 150), ("abc" * 90, "x" + "abc" * 90)]
    expected = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert s.block_ratios(*sides(pairs)).tolist() == expected


def test_small_matrices_change_nothing(monkeypatch):
    pairs = [("abcde" * n, "badce" * (n % 4 + 1)) for n in range(9)]
    measures = (s.lcs_lengths, s.partial_ratios, s.block_ratios)
    whole = [measure(*sides(pairs)).tolist() for measure in measures]
    monkeypatch.setattr(s, "_CELLS", 7)
    assert [measure(*sides(pairs)).tolist() for measure in measures] == whole


@pytest.fixture(scope="module")
def twin():
    return duckdb.connect()


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_jaro_winkler_equals_the_twin(a, b):
    expected = duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
    assert math.isclose(s.jaro_winkler_to(a, *s.encode([b, "abc"]))[0], expected, abs_tol=1e-12)


def test_known_values(apply):
    jw = apply(s.jaro_winkler, ("martha", "marhta"), ("abcd", "abxyzw"), ("", ""), (None, "a"))
    assert [round(x, 4) for x in jw] == [0.9611, 0.6111, 0.0, 0.0]
    assert apply(s.levenshtein_sim, ("kitten", "sitting"), ("", "")) == [1 - 3 / 7, 1.0]
    assert apply(s.ratio, ("abcd", "bcde"), ("", ""), ("", "x")) == [0.75, 1.0, 0.0]


def test_token_measures(apply):
    assert apply(s.token_sort, ("a b", "b a"), ("A b", "a b"))[0] == 1.0
    assert apply(s.token_sort, ("A b", "a b"))[0] < 1
    pairs = [("fuzzy was a bear", "fuzzy fuzzy was a bear"), ("a b", "c d"), ("", ""), ("a x", "a y"), ("new ring", "ring")]
    got = apply(s.token_set, *pairs)
    # "a x" / "a y": shared "a" (1), with remainders 3 and 3; best of 2*2/6 and 2*1/4.
    assert [round(x, 6) for x in got] == [1.0, round(2 / 6, 6), 0.0, round(4 / 6, 6), 1.0]


def test_sequence_uses_normalised_names(apply):
    expected = SequenceMatcher(None, "acme sa", "acme").ratio()
    assert apply(s.sequence_sim, ("Rang 1  ACME  SA", "Acme"))[0] == expected


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(s.cosine(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 9) for x in got] == [1.0, 0.0, 0.0]
