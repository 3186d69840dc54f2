"""Agreement between sources and page versions, against brute force; hot keys."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from listwright.operators import agreement as A
from listwright.operators import versions as V

CLAIMS = "listing string, attribute string, value string, source string"


def slow_agreement(claims, rounds):
    claims = {c for c in claims if all(c) and c[2] != ""}
    trust = {c[3]: 1.0 for c in claims}

    def shares():
        votes, whole = {}, {}
        for listing, attribute, value, source in claims:
            votes[listing, attribute, value] = votes.get((listing, attribute, value), 0) + trust[source]
            whole[listing, attribute] = whole.get((listing, attribute), 0) + trust[source]
        return {k: v / whole[k[:2]] for k, v in votes.items()}

    for _ in range(rounds):
        held = shares()
        trust = {s: [held[c[:3]] for c in claims if c[3] == s] for s in trust}
        trust = {s: sum(v) / len(v) for s, v in trust.items()}
    return trust, shares()


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_agreement(spark, rounds):
    chance = random.Random(rounds)
    claims = []
    for listing in range(40):
        for source in range(9):
            if chance.random() < 0.6:
                right = chance.random() < source / 9
                claims.append((str(listing), "phone", "right" if right else chance.choice("abc"), f"s{source}"))
    claims += claims[:5] + [("1", "phone", None, "s1"), (None, "phone", "x", "s1"), ("1", "phone", "", "s1"), ("1", "phone", "x", None)]
    df = spark.createDataFrame(claims, CLAIMS)
    trust, shares = slow_agreement(claims, rounds)
    got = {r["source"]: r["reliability"] for r in A.source_reliability(df, rounds).collect()}
    assert got == pytest.approx(trust)
    best = {r["listing"]: r for r in A.agreed_values(df, rounds).collect()}
    assert set(best) == {k[0] for k in shares}
    for listing, row in best.items():
        own = {k[2]: v for k, v in shares.items() if k[0] == listing}
        assert row["share"] == pytest.approx(max(own.values())) and own[row["value"]] == pytest.approx(row["share"])
        assert row["values"] == len(own)


def test_reliable_few_beat_unreliable_many(spark):
    """Three sources that are right elsewhere outvote four that are wrong elsewhere."""
    claims = [(str(i), "phone", f"p{i}", f"good{s}") for i in range(20) for s in range(3)]
    claims += [(str(i), "phone", f"junk{i}{s}", f"bad{s}") for i in range(20) for s in range(4)]
    claims += [("q", "phone", "right", f"good{s}") for s in range(3)] + [("q", "phone", "wrong", f"bad{s}") for s in range(4)]
    df = spark.createDataFrame(claims, CLAIMS)
    before, after = ({r["listing"]: r["value"] for r in A.agreed_values(df, n).collect()}["q"] for n in (0, 5))
    assert (before, after) == ("wrong", "right")
    assert A.agreed_values(df.limit(0)).count() == 0


def test_claims_are_shuffled_once(spark, capsys):
    """Votes and shares are counted within the buckets that the claims were written in."""
    claims = [(str(i), "phone", f"p{i % 3}", f"s{j}") for i in range(30) for j in range(4)]
    A.agreed_values(spark.createDataFrame(claims, CLAIMS), 1).explain()
    plan = capsys.readouterr().out
    assert "Bucketed: true" in plan and "hashpartitioning" not in plan


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


@pytest.mark.parametrize("span", [60, 3600, 86_400 * 365])
def test_versions(spark, span):
    """A third of all rows for one page, ties in time, spans without versions, rows without key or time."""
    chance = random.Random(span)

    def key():
        return "hot" if chance.random() < 0.35 else chance.choice(["a", "b", "c", "never"])

    asked = [(i, key(), at(chance.randrange(0, 600))) for i in range(400)] + [(900, None, at(5)), (901, "a", None), (3, "a", at(9)), (3, "a", at(9))]
    crawled = [(k, at(chance.randrange(0, 600)), i, f"text {i}") for i in range(200) if (k := key()) != "never"]
    crawled += [(None, at(1), 990, "no key"), ("a", None, 991, "no time")]
    asks = spark.createDataFrame(asked, "id long, page string, time timestamp")
    versions = spark.createDataFrame(crawled, "page string, time timestamp, version long, text string")
    got = sorted((tuple(r) for r in V.version_at(asks, versions, "page", "time", "version", span_seconds=span).collect()), key=repr)
    want = []
    for i, page, time in asked:
        fit = [(t, v, text) for p, t, v, text in crawled if page is not None and p == page and t and time and t <= time]
        want.append((i, page, time, *(max(fit) if fit else (None, None, None))))
    assert got == sorted(want, key=repr)


def test_hot_page_is_dealt_to_many_tasks(spark):
    asks = spark.range(20_000).select(F.lit("hot").alias("page"), F.timestamp_seconds(F.col("id") * 100).alias("time"), "id")
    versions = asks.filter("id % 7 = 0").select("page", "time", F.col("id").alias("version"))
    out = V.version_at(asks, versions, "page", "time", "version", span_seconds=5000)
    assert out.filter("found_version = id - id % 7").count() == 20_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in held) < 10_000
