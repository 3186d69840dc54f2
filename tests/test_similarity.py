import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listwright.functions import similarity
from listwright.functions.signatures import token_keys
from listwright.functions.similarity import name_scores, ratios

words = st.text(alphabet="abcde", min_size=1, max_size=12)


def plain_ratio(a: str, b: str) -> float:
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def plain_score(a: list[str], b: list[str]) -> float:
    forward = sum(max(plain_ratio(x, y) for y in b) for x in a) / len(a)
    backward = sum(max(plain_ratio(x, y) for x in a) for y in b) / len(b)
    return max(forward, backward)


def as_words(values):
    return np.array(values, dtype=object)


def test_ratio_equals_the_table_at_all_lengths():
    random.seed(1)
    pool = ["".join(random.choice("abcé") for _ in range(n)) for n in (0, 1, 3, 8, 63, 64, 65, 90) for _ in range(6)]
    left = [random.choice(pool) for _ in range(500)]
    right = [random.choice(pool) for _ in range(500)]
    wanted = [plain_ratio(a, b) for a, b in zip(left, right)]
    assert np.allclose(ratios(as_words(left), as_words(right)), wanted)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, min_size=1, max_size=5), st.lists(words, min_size=1, max_size=5))
def test_score_is_right_symmetric_and_bounded(a, b):
    score = name_scores([a, b, a], [b, a, a])
    assert abs(score[0] - plain_score(a, b)) < 1e-9
    assert abs(score[0] - score[1]) < 1e-9
    assert score[2] == 1.0
    assert 0 <= score[0] <= 1


def test_scores_do_not_depend_on_grouping(monkeypatch):
    rng = random.Random(4)
    left, right = (
        [["".join(rng.choice("abc") for _ in range(3)) for _ in range(rng.randint(0, 6))] for _ in range(50)]
        for _ in range(2)
    )
    whole = name_scores(left, right)
    monkeypatch.setattr(similarity, "_MOST_CELLS", 7)
    np.testing.assert_allclose(name_scores(left, right), whole)


def test_empty_names_have_no_score():
    assert np.isnan(name_scores([[], ["a"]], [["a"], []])).all()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdef", min_size=1, max_size=40), st.data(), st.sampled_from(["0.5", "0.6", "0.75", "0.9"]))
def test_similar_tokens_share_a_key(a, data, floor):
    """Change a token by some edits: if it stays over the floor, the keys meet."""
    b = list(a)
    for _ in range(data.draw(st.integers(0, max(1, len(a) // 3)))):
        at = data.draw(st.integers(0, len(b)))
        if data.draw(st.booleans()) and len(b) > 1:
            b.pop(min(at, len(b) - 1))
        else:
            b.insert(at, data.draw(st.sampled_from("abcdef")))
    b = "".join(b)
    bound = Fraction(floor)
    if plain_ratio(a, b) > float(bound):
        assert set(token_keys(a, bound, True)) & set(token_keys(b, bound, False))


@pytest.mark.parametrize("floor", ["0.5", "0.6", "0.75"])
def test_all_lengths_meet(floor):
    """Tokens of every two lengths built around a common part just over the floor."""
    rng, bound = random.Random(9), Fraction(floor)
    for la in range(1, 30):
        for lb in range(1, 30):
            common = int(bound * (la + lb) / 2) + 1
            if common > min(la, lb):
                continue
            core = [rng.choice("abcdefgh") for _ in range(common)]
            pair = []
            for length in (la, lb):
                token = core[:]
                while len(token) < length:
                    token.insert(rng.randint(0, len(token)), rng.choice("stuvwxyz"))
                pair.append("".join(token))
            a, b = pair
            assert plain_ratio(a, b) > bound
            assert set(token_keys(a, bound, True)) & set(token_keys(b, bound, False)), (a, b)


def test_long_tokens_get_few_keys():
    assert len(token_keys("x1" * 5000, Fraction("0.75"), True)) < 100_000
