"""Measures of runs: days that add up, exact counts, estimates within their error, quantiles within a bin."""

import random
import statistics

from pyspark.sql import functions as F

from listwright.operators import measures as G

SCHEMA = (
    "list_id string, section string, needs_review boolean, score double, address string, phone string,"
    " website string, facebook string, twitter string, day int"
)


def rows(count):
    chance = random.Random(count)
    out = []
    for _ in range(count):
        phone = f"514.555.{chance.randrange(3000):04d}" if chance.random() < 0.9 else None
        score = chance.choice([None, 1.0, 0.0, chance.random(), chance.random()])
        place = "hot" if chance.random() < 0.4 else chance.choice(["a", "b", None])
        out.append((place, chance.choice([None, "x", "y"]), chance.random() < 0.2, score, None, phone, "w", None, "t", chance.randrange(3)))
    return out


def test_days_add_up(spark):
    held = rows(6000)
    df = spark.createDataFrame(held, SCHEMA)
    days = [G.sketches(df.filter(F.col("day") == day)) for day in range(3)]
    added = G.measured(G.merged(days[0].unionByName(days[1]).unionByName(days[2])), 0.1, 0.5, 0.9).collect()
    whole = G.measured(G.sketches(df), 0.1, 0.5, 0.9).collect()
    exact = lambda rows: sorted(({**r.asDict(), "distinct_phones": 0} for r in rows), key=repr)
    assert exact(added) == exact(whole)
    met = {(r["level"], r["list_id"], r["section"]): r["distinct_phones"] for r in added}
    got = {(r["level"], r["list_id"], r["section"]): r for r in whole}
    groups = {}
    for r in held:
        for key in (("section", r[0], r[1]), ("list", r[0], None), ("total", None, None)):
            groups.setdefault(key, []).append(r)
    assert set(got) == set(groups)
    for key, of in groups.items():
        row = got[key]
        assert (row["names"], row["website"], row["address"]) == (len(of), len(of), 0)
        assert (row["flagged"], row["phone"]) == (sum(r[2] for r in of), sum(r[5] is not None for r in of))
        phones = len({r[5] for r in of} - {None})
        assert abs(row["distinct_phones"] - phones) <= 0.03 * phones + 1 and abs(met[key] - phones) <= 0.03 * phones + 1
        scores = sorted(r[3] for r in of if r[3] is not None)
        assert row["scored"] == len(scores)
        assert abs(row["score_50"] - statistics.median_low(scores)) <= 0.002


def test_nothing_and_no_scores(spark):
    df = spark.createDataFrame([("a", None, False, None, None, None, None, None, None, 0)], SCHEMA)
    assert G.sketches(df.limit(0)).count() == 0 and G.merged(G.sketches(df.limit(0))).count() == 0
    out = G.measured(G.merged(G.sketches(df).unionByName(G.sketches(df))), 0.5).collect()
    assert {(r["level"], r["names"], r["distinct_phones"], r["score_50"]) for r in out} == {(level, 2, 0, None) for level in G.LEVELS}
