"""Filter audit, SimHash near-dedup and periodic runs, against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
import xxhash

from listwright.llm import filter_audit, periodic_runs, simhash_bk

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, hash long, code long, bits int, n long, part string, mask int"


def frame(spark, rows):
    """Rows of (doc_id, text, lang) with columns that clash with those of the operators."""
    return spark.createDataFrame([(*row, "s", 1, 2, 3, 4, "p", 5) for row in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, copies, symbols, capitals."""
    chance = random.Random(5)
    words = ["".join(chance.choices("abcdefghij", k=4)) for _ in range(500)]
    out = [(None, "a text without an id", "en"), (None, None, None), (1, None, "en"), (2, "", None), (3, " \t\n", "de"), (3, " \t\n", "de")]
    out += [(4, "a text without an id", "en"), (5, "zzz", ""), (6, "zzz", ""), (6, "zzz", "en"), (7, "zzz", None), (0, "zzz", "fr")]
    for i in range(10, 120):
        text = " ".join(chance.choices(words, k=chance.choice([20, 99, 100, 130, 300])))
        if chance.random() < 0.3:
            text = text.upper() if chance.random() < 0.5 else text.replace("a", "A", len(text) // 10)
        if chance.random() < 0.3:
            text += chance.choice([" #", " 5%", "|", " Ä\U0001f600"])
        out.append((i, text, chance.choice(["en", "en", "de", None])))
    copied = [row for row in out if row[0] is not None and row[0] >= 10]
    out += [(200 + i, chance.choice(copied)[1], chance.choice(["en", "fr"])) for i in range(60)]
    out += [(300 + i, copied[3][1], "en") for i in range(80)]
    out.append((400, " ".join(chance.choices(words, k=60_000)), "en"))
    return out


def masks(rows):
    found = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = SPACED.findall(text)
        mask = 1 * (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words))
        mask += 4 * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows):
            mask += 16
        found.append(mask)
    return found


def test_audit(spark, rows):
    labels = [(i, int(i % 2 == 0), int(i % 3 == 0)) for i in range(10, 200)] + [(300, 0, 1), (300, 1, None), (None, 1, 1), (9999, 1, 1)]
    frame_of_labels = spark.createDataFrame([(*row, 9, "x") for row in labels], "doc_id long, quality int, toxic int, n long, part string")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(frame(spark, rows), frame_of_labels).collect()}
    good, toxic = ({i for i, *of in labels if of[at] == 1 and i is not None} for at in (0, 1))
    parts = {}
    for (doc_id, _, lang), mask in zip(rows, masks(rows)):
        parts.setdefault(lang or "", []).append((mask, doc_id in good, doc_id in toxic))
    assert len(got) == 600 * len(parts)
    bit = {letter: 1 << i for i, letter in enumerate("ABCDE")}
    for part, held in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for mask, _, _ in held:
                first = next((f for f in order if mask & bit[f]), None)
                if first:
                    shapley[first] += 1
        for order in permutations("ABCDE"):
            gone, left = 0, held
            for step, letter in enumerate(order, 1):
                here = bit[letter]
                removed = [h for h in left if h[0] & here]
                left = [h for h in left if not h[0] & here]
                row = got[part, "".join(order), step]
                assert row["removed"] == len(removed) and row["kept"] == len(left)
                assert row["redundant"] == sum(1 for h in held if h[0] & here and h[0] & gone)
                assert row["unique_fails"] == sum(h[0] == here for h in held)
                assert (row["good_lost"], row["toxic_lost"]) == (sum(h[1] for h in removed), sum(h[2] for h in removed))
                assert row["shapley"] == shapley[letter]
                gone |= here


def test_copies(spark, rows):
    got = sorted(r["doc_id"] for r in filter_audit.copies(frame(spark, rows)).collect())
    assert got == sorted(row[0] for row, mask in zip(rows, masks(rows)) if mask & 16)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), labels).count() == 0
    got = filter_audit.audit(frame(spark, [(1, None, None)]), labels).collect()
    assert len(got) == 600 and {r["part"] for r in got} == {""}
    assert all((r["kept"], r["removed"]) == ((0, 1) if r["filter_order"][r["step"] - 1] == "A" else (r["kept"], 0)) for r in got)


def slow_fingerprint(text):
    words = SPACED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def least_reached(codes, ids):
    """Brute force over all pairs of codes: each row's smallest id."""
    label = list(range(len(codes)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, doc_id in enumerate(ids):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [least.get(root(i)) for i in range(len(codes))]


def test_near_components(spark, rows):
    chance = random.Random(11)
    base = (chance.choice([r[1] for r in rows if r[0] and 10 <= r[0] < 120]) + " ") * 3
    near = []
    for i in range(60):
        words = base.split()
        for _ in range(chance.randint(0, 6)):
            words[chance.randrange(len(words))] = chance.choice(["other", "words", "here"])
        near.append((500 + i, " ".join(words).title(), "en"))
    rows = rows + near
    got = [tuple(r) for r in simhash_bk.near_components(frame(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()]
    codes = [slow_fingerprint(text) for _, text, _ in rows]
    least = least_reached(codes, [row[0] for row in rows])
    assert len(set(least)) < len(set(codes))
    assert sorted(got, key=repr) == sorted(((row[0], f"{code:016x}", first) for row, code, first in zip(rows, codes, least)), key=repr)
    assert simhash_bk.near_components(frame(spark, [])).count() == 0
    kept = simhash_bk.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {first for first in least if first is not None} | {None}


def planted_codes(chance, n, spread):
    """Codes in crowds of near ones, chains among them."""
    codes = {0, 1, (1 << 64) - 1}
    while len(codes) < n:
        code = chance.getrandbits(64)
        for _ in range(chance.randint(1, spread)):
            codes.add(code)
            for _ in range(chance.randint(1, 5)):
                code ^= 1 << chance.randrange(64)
    return sorted(codes)


@pytest.mark.parametrize("tree", [4, 32, 1 << 15])
def test_code_links(spark, monkeypatch, tree):
    """Shards in one tree and shards cut into parts give the components of all pairs."""
    monkeypatch.setattr(simhash_bk, "TREE", tree)
    codes = planted_codes(random.Random(tree), 1500, 40)
    # A hot shard: many codes that share two whole blocks.
    chance = random.Random(1)
    codes = sorted(set(codes) | {(5 << 53) | (chance.getrandbits(12) << 20) | 77 for _ in range(300)})
    signed = [code - (1 << 64) if code >> 63 else code for code in codes]
    links = simhash_bk.code_links(spark.createDataFrame([(c,) for c in [*signed, None, *signed[:5]]], "code long"))
    found = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 64 for a, b in found)
    label = {code: code for code in codes}

    def root(c):
        while label[c] != c:
            c = label[c]
        return c

    for a, b in found:
        label[root(a)] = root(b)
    want = least_reached(codes, codes)
    groups = {}
    for code, first in zip(codes, want):
        groups.setdefault(root(code), set()).add(first)
    assert all(len(firsts) == 1 for firsts in groups.values())
    assert len(groups) == len(set(want))


def test_tree_search_is_brute_force():
    chance = np.random.default_rng(3)
    codes = np.unique(chance.integers(0, 1 << 12, 900, dtype=np.uint64))
    group = np.sort(chance.integers(0, 5, len(codes)))
    trees = simhash_bk.Trees(codes, group)
    start = trees.roots[np.searchsorted(trees.roots, np.arange(len(codes)), side="right") - 1]
    found = {(int(a), int(b)) for asked, node in trees.within(codes, start) for a, b in zip(asked, node)}
    apart = np.bitwise_count(codes[:, None] ^ codes[None, :])
    want = (apart <= simhash_bk.RADIUS) & (group[:, None] == group[None, :])
    assert found == {(int(a), int(b)) for a, b in np.argwhere(want)}


def slow_runs(words):
    """Every period and every stretch that no neighbour extends; the smallest period of a stretch counts."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            stretch = words[start : start + length]
            if length >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def made_words(chance):
    letters = chance.choice(["ab", "abc", "abcdefgh"])
    words = []
    for _ in range(chance.randint(1, 5)):
        some = chance.choices(letters, k=chance.randint(1, 7))
        words += some * chance.randint(1, 7) + some[: chance.randint(0, len(some))]
    return words


def test_runs_are_brute_force():
    chance = random.Random(2)
    count = 0
    for _ in range(1500):
        words = made_words(chance)
        assert periodic_runs.runs(words) == slow_runs(words), words
        count += len(slow_runs(words))
    assert count > 500


@pytest.mark.parametrize("seed", range(4))
def test_runs_in_long_texts(seed):
    """Plain words with long and nested repetitions, sets large enough to be merged both ways."""
    chance = random.Random(seed)
    words = []
    while len(words) < 1500:
        some = made_words(chance)
        words += some * chance.choice([1, 1, 5, 20]) + [str(chance.randrange(50)) for _ in range(chance.randint(0, 30))]
    assert periodic_runs.runs(words) == slow_runs(words)


def test_very_long_runs():
    assert periodic_runs.runs(["a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic_runs.runs(["x", *"abc" * 50_000]) == [(1, 150_000, 3)]


def slow_digest(doc_id, text):
    words = SPACED.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * longest[1] // longest[2] if found else None
    return (doc_id, len(found), *longest, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_run_digests(spark, rows):
    chance = random.Random(4)
    rows = [row for row in rows if row[0] != 400] + [(600 + i, " é\n".join(made_words(chance)), "en") for i in range(200)]
    got = [tuple(r) for r in periodic_runs.run_digests(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted((slow_digest(d, t) for d, t, _ in rows), key=repr)
    assert any(row[1] > 1 for row in got)
    assert periodic_runs.run_digests(frame(spark, [])).count() == 0
    each = {}
    for r in periodic_runs.document_runs(frame(spark, rows[-50:])).collect():
        each.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["period"]))
    assert all(sorted(each.get(d, []), key=lambda r: (r[0], r[2])) == slow_runs(SPACED.findall(t)) for d, t, _ in rows[-50:])


def test_without_runs(spark):
    docs = frame(spark, [(1, "a b " * 5 + "end", "en"), (2, "no  run", None), (3, None, "en")])
    out = periodic_runs.without_runs(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a b end", 2: "no  run", 3: None}
