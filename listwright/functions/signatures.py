"""Join keys under which two similar tokens are sure to meet.

ratio(a, b) > floor means LCS(a, b) >= m with m = floor(floor_ratio * (la + lb) / 2) + 1.
So for every partner length a token gets keys such that any pair over the floor shares one:

* short pairs: all its subsequences of length m. A shared key *is* a common subsequence,
  so every meeting is a true pair.
* longer pairs: prefix filter. The pair shares at least C(m, q) ordered q-letter picks, so
  the first |picks| - C(m, q) + 1 picks in one fixed global order must meet (Chaudhuri et
  al. 2006; Xiao et al. 2008). Beyond the exact lengths, partner lengths go in bands of
  about a tenth.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from fractions import Fraction
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import Column

from listwright.functions.arrow import batched

_EXACT_LENGTHS = 24
_MOST_SUBSEQUENCES = 400
# Rare letters first, so that prefixes hold picks few other tokens have.
_RARITY = {c: i for i, c in enumerate("0123456789zqxjkvbpygfwmucldrhsnioate")}

_band_starts = list(range(0, _EXACT_LENGTHS + 2))


def _band(length: int) -> int:
    while _band_starts[-1] <= length:
        _band_starts.append(_band_starts[-1] + max(1, _band_starts[-1] // 10))
    return bisect_right(_band_starts, length) - 1


def _band_limits(band: int) -> tuple[int, int]:
    while len(_band_starts) <= band + 1:
        _band(_band_starts[-1])
    return _band_starts[band], _band_starts[band + 1] - 1


_known_partners: dict[tuple[int, Fraction], list[tuple[int, int]]] = {}


def _partner_bands(length: int, floor: Fraction) -> list[tuple[int, int]]:
    """(band, least LCS) for every band that can hold a partner of a token this long."""
    def least(partner: int) -> int:
        return int(floor * (length + partner) / 2) + 1

    if (length, floor) not in _known_partners:
        partners, band = [], 1
        while least(_band_limits(band)[0]) <= length:
            low, high = _band_limits(band)
            if high >= least(high):
                partners.append((band, least(low)))
            band += 1
        _known_partners[length, floor] = partners
    return _known_partners[length, floor]


def _pick_size(length: int, partner_band: int, m: int) -> int:
    if max(length, partner_band) > _EXACT_LENGTHS:
        return 1
    if max(comb(length, m), comb(partner_band, m)) <= _MOST_SUBSEQUENCES:
        return m
    return 2


def _ordered_picks(token: str, q: int) -> list[tuple[str, int]]:
    seen: Counter = Counter()
    picks = []
    for letters in combinations(token, q):
        gram = "".join(letters)
        seen[gram] += 1
        picks.append((gram, seen[gram]))
    return sorted(picks, key=lambda p: (sum(_RARITY.get(c, -1) for c in p[0]), p))


def token_keys(token: str, floor: Fraction, left: bool) -> list[str]:
    length, band = len(token), _band(len(token))
    whole: dict[int, set[str]] = {}
    picks: dict[int, list[tuple[str, int]]] = {}
    keys: set[str] = set()
    for partner, m in _partner_bands(length, floor):
        q = _pick_size(band, partner, m)
        lengths = f"{band}.{partner}." if left else f"{partner}.{band}."
        if q == m:
            if q not in whole:
                whole[q] = {"".join(letters) for letters in combinations(token, q)}
            keys.update(lengths + subsequence for subsequence in whole[q])
        else:
            if q not in picks:
                picks[q] = _ordered_picks(token, q)
            prefix = len(picks[q]) - comb(m, q) + 1
            keys.update(f"{lengths}{gram}.{n}" for gram, n in picks[q][:prefix])
    return sorted(keys)


def similarity_keys(token: Column, floor: Fraction, left: bool) -> Column:
    def batch(tokens: pd.Series) -> pd.Series:
        return pd.Series([token_keys(t, floor, left) for t in tokens])

    return batched(batch, "array<string>")(token)
