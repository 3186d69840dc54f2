"""Token similarity: ratio of the longest common subsequence, batched over Arrow.

Numbers come from ``2 * LCS(a, b) / (len a + len b)``; a whole batch is computed at once
with the bit-parallel recurrence (Hyyro 2004), one machine word per pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.arrow import batched

_WORD = 64
_MOST_CELLS = 2_000_000


def _lcs_long(a: str, b: str) -> int:
    """LCS length for tokens longer than a machine word: same recurrence, big integers."""
    full = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, char in enumerate(a):
        where[char] = where.get(char, 0) | (1 << i)
    row = full
    for char in b:
        hit = row & where.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _letter_positions(words: list[str], symbols: dict[str, int]) -> np.ndarray:
    """Bit i of [word, symbol] is set where the word has that symbol at place i."""
    place = [(w, symbols[c], i) for w, word in enumerate(words) for i, c in enumerate(word)]
    table = np.zeros((len(words), len(symbols)), np.uint64)
    if place:
        w, c, i = np.array(place, dtype=np.int64).T
        np.bitwise_or.at(table, (w, c), np.uint64(1) << i.astype(np.uint64))
    return table


def pair_ratios(words: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ratio of each pair of words, given by their places in a list of distinct words."""
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    size = (lengths[left] + lengths[right]).astype(np.float64)
    common = np.zeros(len(left), np.int64)

    long = lengths[left] > _WORD
    for k in np.flatnonzero(long):
        common[k] = _lcs_long(words[left[k]], words[right[k]])

    # Longest right word first: step j then touches only a leading slice of the pairs.
    order = np.flatnonzero(~long)
    order = order[np.argsort(-lengths[right[order]], kind="stable")]
    if len(order):
        used, left_place = np.unique(left[order], return_inverse=True)
        symbols = {c: k for k, c in enumerate(sorted(set("".join(words))))}
        positions = _letter_positions([words[k] for k in used], symbols)
        steps = int(lengths[right[order[0]]])
        right_used, right_place = np.unique(right[order], return_inverse=True)
        letters = np.zeros((len(right_used), max(steps, 1)), np.int64)
        for k, word in enumerate(right_used):
            letters[k, : lengths[word]] = [symbols[c] for c in words[word]]
        row = np.full(len(order), np.iinfo(np.uint64).max, np.uint64)
        active = np.searchsorted(-lengths[right[order]], -np.arange(steps), side="left")
        for j in range(steps):
            n = active[j]
            hit = row[:n] & positions[left_place[:n], letters[right_place[:n], j]]
            row[:n] = (row[:n] + hit) | (row[:n] - hit)
        width = lengths[left[order]]
        mask = np.full(len(order), np.iinfo(np.uint64).max, np.uint64)
        part = width < _WORD
        mask[part] = (np.uint64(1) << width[part].astype(np.uint64)) - np.uint64(1)
        common[order] = np.bitwise_count(~row & mask)
    return np.where(size == 0, 1.0, 2.0 * common / np.where(size == 0, 1.0, size))


def ratios(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    words, codes = _number_words([left, right])
    return pair_ratios(words, codes[: len(left)], codes[len(left):])


def _number_words(parts) -> tuple[list[str], np.ndarray]:
    number: dict[str, int] = {}
    codes = [number.setdefault(w, len(number)) for part in parts for w in part]
    return list(number), np.array(codes, dtype=np.int64)


def name_scores(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Score of each pair of token lists: the better of the two mean best ratios; NaN where
    a side is empty. Pairs go through in groups of bounded token-pair counts."""
    cells = np.fromiter((len(a) * len(b) for a, b in zip(left, right)), np.int64, len(left))
    scores = np.full(len(left), np.nan)
    wide = cells > _MOST_CELLS
    for k in np.flatnonzero(wide):
        scores[k] = _wide_score(left[k], right[k])
    narrow = np.flatnonzero(~wide)
    group = np.cumsum(cells[narrow]) // _MOST_CELLS
    for rows in np.split(narrow, np.flatnonzero(np.diff(group)) + 1):
        scores[rows] = _group_scores([left[k] for k in rows], [right[k] for k in rows])
    return scores


def _wide_score(left: list[str], right: list[str]) -> float:
    """Score of two very long names, a block of left tokens at a time."""
    words, codes = _number_words([left, right])
    a, b = codes[: len(left)], codes[len(left):]
    distinct_b, back = np.unique(b, return_inverse=True)
    best_b = np.zeros(len(distinct_b))
    total = 0.0
    block = max(1, _MOST_CELLS // len(distinct_b))
    for start in range(0, len(a), block):
        part = a[start: start + block]
        grid = pair_ratios(
            words, np.repeat(part, len(distinct_b)), np.tile(distinct_b, len(part))
        ).reshape(len(part), len(distinct_b))
        total += grid.max(axis=1).sum()
        best_b = np.maximum(best_b, grid.max(axis=0))
    return max(total / len(a), best_b[back].mean())


def _group_scores(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Scores of a group of pairs; the ratio is computed once per distinct token pair."""
    n_left = np.fromiter((len(t) for t in left), np.int64, len(left))
    n_right = np.fromiter((len(t) for t in right), np.int64, len(right))
    cells = n_left * n_right
    scores = np.full(len(left), np.nan)
    rows = np.flatnonzero(cells)
    if not len(rows):
        return scores
    words, codes = _number_words([*left, *right])
    left_codes, right_codes = codes[: n_left.sum()], codes[n_left.sum():]
    left_start = np.cumsum(n_left) - n_left
    right_start = np.cumsum(n_right) - n_right

    row = np.repeat(rows, cells[rows])
    start = np.repeat(np.cumsum(cells[rows]) - cells[rows], cells[rows])
    step = np.arange(len(row)) - start
    i, j = step // n_right[row], step % n_right[row]
    pair = left_codes[left_start[row] + i] * len(words) + right_codes[right_start[row] + j]
    distinct, where = np.unique(pair, return_inverse=True)
    ratio = pair_ratios(words, distinct // len(words), distinct % len(words))[where]

    def mean_best(values, inner, outer):
        best = np.maximum.reduceat(values, np.flatnonzero(inner == 0))
        first = np.cumsum(outer) - outer
        return np.add.reduceat(best, first) / outer

    forward = mean_best(ratio, j, n_left[rows])
    other = start + (step % n_left[row]) * n_right[row] + step // n_left[row]
    backward = mean_best(ratio[other], step % n_left[row], n_right[rows])
    scores[rows] = np.maximum(forward, backward)
    return scores


def _token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.to_numpy(dtype=object), b.to_numpy(dtype=object)))


def _match_score(a: pd.Series, b: pd.Series) -> pd.Series:
    left = [[] if t is None else list(t) for t in a]
    right = [[] if t is None else list(t) for t in b]
    scores = pd.Series(name_scores(left, right).round(9))
    return scores.astype(object).where(scores.notna(), None)


def token_ratio(a: Column, b: Column) -> Column:
    """Similarity of two tokens in [0, 1]."""
    return batched(_token_ratio, "double")(a, b)


def match_score(tokens_a: Column, tokens_b: Column) -> Column:
    """Similarity of two token arrays in [0, 1]; NULL if either is empty."""
    return batched(_match_score, "double")(tokens_a, tokens_b)


def with_match_score(df: DataFrame, tokens_a: Column, tokens_b: Column, score: str) -> DataFrame:
    """Add the match score of two token arrays given as expressions.

    The arrays are set down as columns by a generator first: the optimizer fails to take a
    Python function out of a projection when its arguments are deeply nested lambdas.
    """
    words = F.struct(tokens_a.alias("_words_a"), tokens_b.alias("_words_b"))
    return (
        df.select("*", F.inline(F.array(words)))
        .withColumn(score, match_score(F.col("_words_a"), F.col("_words_b")))
        .drop("_words_a", "_words_b")
    )
