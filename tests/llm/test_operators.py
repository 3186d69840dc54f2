"""The ten operators on small awkward tables, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from listwright.llm import chat, decontaminate, jaccard, line_dedup, packing, pii, quality, sharding, toxicity_model, warc
from listwright.llm.chat_template import TemplateError, compile_template, fold, parse

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, shard string, n_shingles int, task int, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, copies, and columns that clash with those of operators."""
    chance = random.Random(3)
    words = ["".join(chance.choices("abcdefghij", k=5)) for _ in range(400)]
    rows = [(None, "a row without an id that says nothing new"), (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, "Tail\n")]
    for i in range(10, 90):
        rows.append((i, " ".join(chance.choices(words, k=chance.randint(1, 80)))))
    base = chance.choices(words, k=60)
    for i in range(100, 140):
        copy = list(base)
        for _ in range(chance.randint(0, 4)):
            copy[chance.randrange(60)] = chance.choice(words)
        rows.append((i, " ".join(copy[:30]).title() + "\n" + " ".join(copy[30:])))
    rows.append((200, " ".join(chance.choices(words, k=20_000))))
    rows.append((201, "A shared long line here\nshort\n  a SHARED long line here \nA shared long line here"))
    rows.append((202, "x\na shared long line here\nown line of this text"))
    return spark.createDataFrame([(*row, "s", 7, 9, "k") for row in rows], DOCS)


def held(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_components(spark, docs):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        width = min(5, len(words))
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()

    rows = [(d, shingles(t)) for d, t in held(docs)]
    reach = list(range(len(rows)))

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for i, (d, a) in enumerate(rows):
        for j, (e, b) in enumerate(rows[:i]):
            if d is not None and e is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                reach[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    want = sorted(((d, len(a), None if d is None else min(groups[root(i)])) for i, (d, a) in enumerate(rows)), key=repr)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.document_components(docs).collect()]
    assert sorted(got, key=repr) == want
    assert jaccard.document_components(docs.limit(0)).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1


def test_links(docs, monkeypatch):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        width = min(5, len(words))
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()

    copies = docs.filter("doc_id BETWEEN 100 AND 105").withColumn("doc_id", docs["doc_id"] + 1000)
    docs = docs.filter("doc_id <> 200").union(copies)
    sets = {i: shingles(t) for i, t in held(docs) if i is not None}
    want = {i: 0 for i, s in sets.items() if s}
    for i in want:
        for j in want:
            common = len(sets[i] & sets[j])
            want[i] += i != j and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common)
    for block in (1024, 8, 2):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert {r["doc_id"]: r["n_links"] for r in jaccard.link_counts(docs).collect()} == want
    of_set = {r["set_id"]: sets[r["doc_id"]] for r in jaccard.members(docs).collect()}
    found = {(r["a"], r["b"]): r["overlap"] for r in jaccard.links(docs).collect()}
    assert found and all(len(of_set[a] & of_set[b]) == overlap for (a, b), overlap in found.items())


def test_lines(docs):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))

    first = {}
    for d, t in held(docs):
        for line in t.split("\n") if d is not None else ():
            if len(key(line)) >= 10:
                first[key(line)] = min(d, first.get(key(line), d))
    want = []
    for d, t in held(docs):
        lines = t.split("\n")
        kept = [x for x in lines if d is None or first.get(key(x), d) == d]
        want.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = [tuple(r) for r in line_dedup.line_digests(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert line_dedup.without_repeated_lines(docs).columns == docs.columns
    assert line_dedup.line_digests(docs.limit(0)).count() == 0


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, window=64, all_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    full = sum(sum(n for _, n in pieces) == 64 for pieces in by_sequence.values())
    assert full >= len(by_sequence) - 1
    for d, t in held(docs):
        ids = exact.encode(t, add_special_tokens=False).ids + [0]
        pieces = sorted(set(by_doc[d, len(ids)]))
        assert b"".join(p for _, p in pieces) == np.array(ids, "<u4").tobytes()
    assert packing.pack(docs.limit(0)).count() == 0


def test_tokens_equal_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, coder, chance = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokenizer(), random.Random(5)
    pool = "aZ09 \t\n'.,éßñ中文😀́  <|endoftext|>" + "".join(map(chr, range(0x400, 0x460)))
    for _ in range(300):
        text = "".join(chance.choices(pool, k=chance.randint(0, 60))) + chance.choice(["", "<|endoftext|>", " they're"])
        assert packing.token_ids(coder, text).tolist() == exact.encode(text, add_special_tokens=False).ids + [0]


def test_sharding(docs):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == docs.count()
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted(
        (len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t in held(docs)
    )
    assert sharding.shard(docs.limit(0), 4).count() == 0


def test_sharding_of_rows_alike(spark):
    rows = [(7, "the same words")] * 3000 + [(None, "the same words")] * 3000 + [(i, f"text {i}") for i in range(50)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4).collect()
    assert len(found) == len(rows)
    sizes = [sum(r["size"] for r in found if r["shard"] == s) for s in range(4)]
    assert max(sizes) <= 1.05 * min(sizes)
    for s in range(4):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))


def test_sharding_is_even():
    chance = np.random.default_rng(1)
    items = np.column_stack([chance.lognormal(5, 1, 4000), chance.lognormal(3, 1, 4000), np.ones(4000)])
    shards = sharding.place(items, 40)
    sums = np.stack([np.bincount(shards, items[:, i], 40) for i in range(3)])
    assert (abs(sums / sums.mean(axis=1, keepdims=True) - 1) < 0.03).all()


def test_quality(docs):
    for _, t in held(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        inside = {i + k for i, run in enumerate(runs) if runs.count(run) > 1 for k in range(5)} if len(runs) < 500 else None
        m = quality.measures(t.encode())
        assert m[0] == len(words) and m[1] == sum(map(len, words)) and m[2] == sum(c in "#*$%&|<>" for c in t)
        assert inside is None or m[4] == len(inside)
    assert quality.repeated_words(b"a b c d e x a b c d e a b c d e".split()) == 15
    rows = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    assert not rows[2]["kept"] and rows[2]["base_failed"] and not rows[4]["kept"]
    assert quality.judged(docs.limit(0)).count() == 0
    assert quality.only_good(docs).columns == docs.columns


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    rows = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").collect()
    kept = {label: [r["kept"] for r in rows if r["label"] == label] for label in (0, 1)}
    assert sum(kept[1]) >= 0.97 * len(kept[1]) and sum(kept[0]) <= 0.1 * len(kept[0])


def test_personal_data():
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    chance = random.Random(11)
    fixed = ["4111 1111 1111 1111", "a@b.c@d.e", "x@y.", "1.2.3.4.5.6.7.8", "+1 (555) 010-1234", "256.1.1.1", "@a.b", "é@a.b-c.d"]
    for _ in range(3000):
        text = "".join(chance.choices("01234 4@.+()-ab,é", k=chance.randint(0, 40))) + chance.choice(fixed) + chance.choice([" ", "", "1"])
        want = [
            (kind, m.start(), m.end()) for kind, (shape, holds) in patterns.items() for m in re.finditer(shape, text) if holds(m.group())
        ]
        assert [s[:3] for s in pii.spans(text) if s[4]] == want, text
    assert [s[0] for s in pii.spans("IBAN DE89370400440532013000.")] == ["iban"]
    assert not pii.spans("IBAN DE89370400440532013001.")
    assert [s[0] for s in pii.spans("call 555-010-1234")] == ["national_phone"] and not pii.spans("so 555-010-1234")


def test_personal_data_rows(docs):
    assert pii.span_digests(docs).count() == docs.count() and pii.span_digests(docs.limit(0)).count() == 0


def test_archive(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a b/\r\n", long), (2, None, long), (3, "u", "x"), (4, "u", "x"), (5, "u", None), (6, "u", ""), (2, None, long), (None, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archived(pages, str(tmp_path / "w")).collect()
    want = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        revisit = len(payload) >= 1000 and page_id != 2
        want.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert spark.read.parquet(str(tmp_path / "w" / "payloads")).count() == 3
    assert warc.archived(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_contamination(spark, docs):
    item = "A train leaves the station at 9 with 120 people and travels 300 km to Paris in 4 hours, how fast was it on average?"
    other = item.replace("9", "7").replace("120", "55").replace("300", "480").replace("Paris", "Rome").replace("4 hours", "6 hours")
    mixed = item.replace("120", "9")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item)], "item_id long, text string")
    more = spark.createDataFrame([(500, f"Before it. {item} After it."), (501, f"Well. {other}"), (502, "A train leaves the station at 9 with people")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.contaminated(docs.select("doc_id", "text").union(more), bench).collect()}
    assert set(rows) == {500, 501} and rows[500]["item_ids"] == [1]
    assert not rows[500]["renamed"] and rows[501]["renamed"] and mixed
    assert decontaminate.without_contaminated(docs, bench).count() == docs.count()
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 == decontaminate.contaminated(docs, bench.limit(0)).count()


def test_contamination_by_occurrence(spark):
    item = "A train leaves the station at 9 with 120 people and travels 300 km to Paris in 4 hours, how fast was it on average?"
    variant = item.replace("at 9", "at 7").replace("120", "455").replace("300", "200").replace("Paris", "Rome").replace("in 4", "in 2")
    cut = item.split()
    spread = " ".join(cut[:13]) + " pause" * 900 + " " + " ".join(cut[9:])
    rows = [(1, f"{item} {variant}"), (2, f"{variant} And then. {item} {variant}"), (3, variant + " word" * 5000 + f" {item}"), (4, spread), (5, variant)]
    rows += [(6, " ".join([*cut[:12], "then", *cut[12:]])), (7, variant.replace("455", "7"))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["percent"], r["renamed"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got[1] == got[2] == got[3] == got[4] == (100.0, False) and got[5] == (100.0, True)
    assert got[6][0] >= 75 and not got[6][1] and 7 not in got


def test_contamination_with_names_at_starts(spark):
    items = [
        "Tom has 5 apples. Tom gives 2 to Ann. Tom buys 6 more. How many does Tom have?",
        "Émile pays 4 francs for each of the large maps that Émile bought from Ñata on the old market square.",
        "Anna and her cousin walk. Boris sees the tall tower. Clara draws it on paper. Whose picture is the best?",
    ]
    swaps = [{"Tom": "Eve"}, {"Émile": "Óscar", "Ñata": "Иван"}, {"Anna": "Иван", "Boris": "Étienne", "Clara": "Mary"}]
    rows = []
    for i, (item, swap) in enumerate(zip(items, swaps)):
        other = item
        for a, b in swap.items():
            other = other.replace(a, b)
        rows += [(10 * i, item), (10 * i + 1, other), (10 * i + 2, f"So then. {other} After it.")]
    rows.append((90, items[0].replace("Tom gives", "Eve gives").replace("Tom buys", "Max buys")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["renamed"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {10 * i + k: ([i], k > 0) for i in range(3) for k in range(3)}


def test_windows_of_slots_only(spark):
    chance = random.Random(9)
    numbers = " ".join(map(str, range(10, 40)))
    items = [f"The table of squares reads {numbers} and so it goes on", " ".join(map(str, range(100, 130)))]
    table = " ".join(str(chance.randrange(1000, 9999)) for _ in range(3000))
    renamed = items[0].replace(numbers, " ".join(map(str, range(50, 80))))
    rows = [(1, table), (2, f"{table} {items[0]} {table}"), (3, f"{table} {items[1]}"), (4, f"{renamed} {table}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["percent"], r["renamed"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {2: ([0], 100.0, False), 3: ([1], 100.0, False), 4: ([0], 100.0, True)}
    held = decontaminate.in_arrow(decontaminate.texts(bench.withColumnRenamed("item_id", "doc_id")), decontaminate._item_windows, decontaminate._ITEMS_SQL)
    packed = decontaminate.bitmap(held.select("window"))
    likely = decontaminate.in_arrow(decontaminate.texts(docs), decontaminate._likely(packed), decontaminate._LIKELY_SQL)
    # Rows that reach the groups: the items' own windows, not document windows times item windows.
    assert decontaminate._hits(likely.distinct(), held.distinct()).count() < 500


def test_slots_must_map_one_to_one():
    rows = [(i, ["1a", "1b"], ["1x", "1y"]) for i in range(4)]
    assert decontaminate._consistent(rows) == (4, True)
    assert decontaminate._consistent([(i, ["1a", "1b"], ["1x", "1x"]) for i in range(4)])[0] == 0


def test_templates():
    run = compile_template("{% set a = 'x' ~ 'y' %}{{ a }}{% for m in ms %}{{ m.v | up }}{% if not loop.last %},{% endif %}{% endfor %}", {"up": str.upper})
    assert "".join(t for t, _ in run(ms=[{"v": "p"}, {"v": None}, {"v": "q"}])) == "xyP,,Q"
    assert len(fold(parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}{# note #}"), {})) == 1
    assert list(compile_template("{% generation %}{{ t }}{% endgeneration %}", {})(t="z")) == [("z", True)]
    for bad in ("{% for x %}", "{{ a() }}", "{{ a | nope }}", "{% if a %}", "{{ a. }}"):
        with pytest.raises(TemplateError):
            compile_template(bad, {})
    assert list(compile_template("{{ x.__class__ }}", {})(x="s")) == [("", False)]


def test_escapes():
    chance = random.Random(2)
    for _ in range(2000):
        text = "".join(chance.choices("<\\|im_endstart>\n", k=30))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "<|im_end|>"), (None, 0, None, "t"), (2, None, "a\nb", "<\\|")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 20
    assert got[1]["loss_sha256"] == hashlib.sha256(b"<|im_end|><|im_end|>").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256("a\nb\n<\\|\n".encode()).hexdigest()
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\nt\n").hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_network_learns_and_scores_alike():
    chance = random.Random(4)
    clean = ["".join(chance.choices("abcdefgh", k=6)) for _ in range(300)]
    texts, labels = [], []
    for i in range(240):
        words = chance.choices(clean, k=chance.randint(1, 70))
        if i % 2:
            words[chance.randrange(len(words))] = "zzxy" + chance.choice(clean)[:3]
        texts.append(" ".join(words))
        labels.append(i % 2)
    model = toxicity_model.Model().train(texts[:180], labels[:180], steps=220)
    scores = toxicity_model.Scorer(model.p).scores([*texts[180:], "", "?!"])
    assert ((scores[:-2] >= 0.3) == np.array(labels[180:])).mean() >= 0.9 and list(scores[-2:]) == [0, 0]
    small = toxicity_model.Scorer(model.p)
    small.most = 100  # forgets words on the way
    assert np.allclose(small.scores(texts[180:]), scores[:-2], atol=1e-4)


def test_windows_cover_all_words():
    for n in range(1, 200):
        assert {i for s in toxicity_model.window_starts(n) for i in range(s, s + toxicity_model.WINDOW)} >= set(range(n))
