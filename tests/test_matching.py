import random

import pytest
from test_similarity import plain_score

from listwright.operators import matching as M
from listwright.operators.report import review_agreement
from listwright.session import materialise

WORDS = ["restaurant", "cafe", "ramen", "sumo", "kazu", "union", "rico", "napoleon", "brulerie", "santropol",
         "quatre", "boutique", "green", "spot", "moishes", "steakhouse", "steak", "house", "x", "bar"]

# Name pairs with the review flag they are known to get.
FLAGS = [
    ("Fitz and Follwell Co.", "Fitz & Follwell Co.", True),
    ("Frank and Oak", "Frank & Oak", False),
    ("Moishe's Steakhouse", "Moishe’s Steak House", False),
    ("Grumman 78", "Grumman78", False),
    ("BandM Restaurant", "B & M Restaurant", True),
]


def names(count, seed):
    rng = random.Random(seed)

    def misspelt(word):
        if rng.random() < 0.4 and len(word) > 2:
            at = rng.randrange(len(word))
            return word[:at] + rng.choice("aeiz") + word[at + rng.randint(0, 1):]
        return word

    return [" ".join(misspelt(rng.choice(WORDS)) for _ in range(rng.randint(1, 6))) for _ in range(count)]


def key_of(name):
    return " ".join(sorted(name.split()))


def table(spark, values, column="n"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


@pytest.mark.parametrize("floor", [0.75, 0.6, 0.5, None])
def test_pairs_equal_brute_force(spark, floor):
    left, right = names(80, 5), names(80, 6)
    found = M.match_pairs(
        M.distinct_names(table(spark, left), "n"), M.distinct_names(table(spark, right), "n"),
        floor=floor,
    )
    got = {(r.key_a, r.key_b): r.score for r in found.collect()}
    wanted = {}
    for a in {key_of(n) for n in left}:
        for b in {key_of(n) for n in right}:
            score = round(plain_score(a.split(), b.split()), 9)
            if score > 0.75:
                wanted[a, b] = score
    assert got == pytest.approx(wanted, abs=1e-8)


@pytest.mark.parametrize("seed, rounds", [(7, (0.8,)), (9, ()), (11, (0.95, 0.9, 0.85, 0.8))])
def test_best_match_equals_brute_force(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(M, "ROUNDS", rounds)
    listed, paged = names(120, seed), names(120, seed + 1) + ["restaurant", "cafe union"]
    listings = spark.createDataFrame(
        [("l", i, n) for i, n in enumerate(listed + ["Le De", "cafe union", "UNION Café"])],
        "list_id string, line_no long, search_name string",
    )
    pages = spark.createDataFrame([(i, n) for i, n in enumerate(paged)], "page_id long, page_name string")
    got = {r.line_no: (r.page_id, r.score) for r in M.best_matches(listings, pages).collect()}
    assert len(got) == listings.count()
    assert got[120] == (None, None)
    for line, name in enumerate(listed + ["", "cafe union", "union cafe"]):
        if not name:
            continue
        scored = [
            (-round(plain_score(name.split(), p.split()), 9), key_of(p) != key_of(name), i)
            for i, p in enumerate(paged)
        ]
        best = min(scored)
        if -best[0] > 0.75:
            assert got[line][0] == best[2], name
            assert got[line][1] == pytest.approx(-best[0], abs=1e-8)
        else:
            assert got[line] == (None, None)


def test_a_third_of_all_names_alike(spark):
    """One name repeated, one word everywhere: results stay whole, one row per listing."""
    listed = ["Restaurant Sumo"] * 3000 + [f"Restaurant {i}x{i}" for i in range(600)]
    listings = spark.createDataFrame(
        [("l", i, n) for i, n in enumerate(listed)], "list_id string, line_no long, search_name string"
    )
    pages = spark.createDataFrame(
        [(i, f"Restaurant {i}x{i}") for i in range(600)] + [(600 + i, "Sumo Restaurant") for i in range(3000)],
        "page_id long, page_name string",
    )
    best = M.best_matches(listings, pages)
    assert best.count() == 3600
    assert best.filter("search_name = 'Restaurant Sumo' and page_id = 600 and score = 1").count() == 3000
    assert best.filter("search_name = page_name and score = 1").count() == 600


@pytest.mark.parametrize("count", [200, 800])
def test_a_word_in_every_name_stays_linear(spark, count):
    """No name meets the others through the word that all have: candidates grow with names, not their square."""
    rng = random.Random(count)

    def made(n):
        return ["restaurant " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=12)) for _ in range(n)]

    left, right = (M.distinct_names(table(spark, made(count)), "n") for _ in range(2))
    counts = M.both_word_counts(left, right)
    for score in (0.9, 0.8, 0.75):
        floor = M.pair_floor(score)
        pairs = M.token_pairs(*counts, floor)
        met = M.match_candidates(left, right, score, floor, counts, pairs).count()
        assert met <= 2 * pairs.filter("tok_a <> 'restaurant'").count() < count * count / 20


def test_keys_of_few_words_are_not_broadcast(spark, capsys):
    """The words' table is small, the table of their keys may be a thousand times as large."""
    words = materialise(table(spark, ["brulerie", "brulerri", "napoleon", "cafe"], "token"), "few-words")
    pairs = M.token_pairs(words, words)
    pairs.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert {(r.tok_a, r.tok_b) for r in pairs.filter("tok_a < tok_b").collect()} == {("brulerie", "brulerri")}


def test_known_review_flags(spark):
    golden = spark.createDataFrame(FLAGS, "search_name string, found_name string, flagged boolean")
    row = review_agreement(golden).first()
    assert (row.names, row.flagged, row.agreeing) == (5, 2, 5)


def test_name_without_words_needs_review(spark):
    df = spark.createDataFrame([("Le De", "Au")], "a string, b string")
    row = M.score_pairs(df, "a", "b").withColumn("flag", M.needs_review(M.F.col("score"))).first()
    assert row.score is None and row.flag
