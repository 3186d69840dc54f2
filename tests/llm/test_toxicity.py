"""The toxicity network against plain loops and finite differences, and its query on awkward tables."""

import random
import zlib

import numpy as np
import pytest

from listwright.llm import toxicity
from listwright.llm import toxicity_model as net


def lived_in(seed=1):
    """A model whose parameters are all at work."""
    model = net.Model(seed)
    chance = np.random.default_rng(seed)
    model.p = {k: (v + 0.3 * chance.standard_normal(v.shape)).astype(np.float32) for k, v in model.p.items()}
    return model


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def run(p, k, side, inputs):
    n = net.HIDDEN
    h, out = np.zeros(n), []
    for x in inputs if side == "f" else inputs[::-1]:
        a, u = x @ p[f"{k}w{side}"] + p[f"{k}b{side}"], h @ p[f"{k}r{side}"]
        reset, update = sigmoid(a[:n] + u[:n]), sigmoid(a[n : 2 * n] + u[n : 2 * n])
        new = np.tanh(a[2 * n :] + reset * u[2 * n :])
        h = (1 - update) * new + update * h
        out.append(h)
    return out if side == "f" else out[::-1]


def states(p, k, inputs):
    return np.concatenate([run(p, k, "f", inputs), run(p, k, "b", inputs)], axis=1)


def attended(p, k, held):
    energy = held @ p[f"{k}at"]
    weight = np.exp(energy - energy.max())
    return weight @ held / weight.sum()


def slow_score(model, text):
    """Every window of 32 words by itself, states those of the stretch that the window's start lies in."""
    p = {k: v.astype(float) for k, v in model.p.items()}
    words = net.words_of(text)
    inputs = []
    for word in words:
        chars = attended(p, "c", states(p, "c", [p["char"][c] for c in net.char_ids(word)]))
        inputs.append(np.concatenate([chars, p["word"][net.bucket(word)]]))
    best = 0.0
    last = max(len(words) - net.WINDOW, 0)
    for begin in range(0, last + 1, net.STRETCH) if words else ():
        held = states(p, "w", inputs[begin : begin + net.STRETCH + net.WINDOW - 1])
        for start in range(begin, min(begin + net.STRETCH, last + 1)):
            window = held[start - begin : start - begin + net.WINDOW]
            best = max(best, sigmoid(attended(p, "w", window) @ p["out"] + p["bias"][0]))
    return best


def test_scores_are_those_of_all_windows():
    model, chance = lived_in(), random.Random(2)
    words = ["".join(chance.choices("abcdefghijklmnop", k=chance.randint(1, 14))) for _ in range(300)]
    texts = [" ".join(chance.choices(words, k=n)) for n in (0, 1, 2, 31, 32, 33, 34, 64, 127, 128, 129, 158, 159, 160, 161, 190, 300, 500)]
    want = [slow_score(model, text) for text in texts]
    assert np.allclose(net.Scorer(model.p).scores(texts), want, atol=2e-5)
    few = net.Scorer(model.p)
    few.most = 1024  # texts are read in parts, words forgotten on the way
    assert np.allclose(few.scores(texts), want, atol=2e-5)


def test_gradients_are_finite_differences():
    chance = random.Random(3)
    docs = [["".join(chance.choices("abcd", k=chance.randint(1, 5))) for _ in range(n)] for n in (3, 40, 70, 1)]
    labels = np.array([1, 0, 1, 0])
    model = lived_in(5)

    def loss(p):
        model.p, model.random = p, np.random.default_rng(0)  # the same words are shown each time
        return model.gradients(docs, labels)

    start = model.p
    _, g = loss(start)
    direction = np.random.default_rng(1)
    for name in start:
        way = direction.standard_normal(start[name].shape).astype(np.float32)
        way /= np.sqrt((way**2).sum())
        step = 0.02
        high, low = (loss({**start, name: (start[name] + sign * step * way).astype(np.float32)})[0] for sign in (1, -1))
        assert (high - low) / (2 * step) == pytest.approx(float((g[name] * way).sum()), abs=2e-3, rel=0.05), name


@pytest.fixture(scope="module")
def rows():
    """Toxic rows hold words of their own; nulls, empty texts, repeated rows, rows without an id."""
    chance = random.Random(9)
    clean = ["".join(chance.choices("abcdefgh", k=5)) for _ in range(200)]
    out = []
    for i in range(240):
        words = chance.choices(clean, k=chance.randint(5, 60))
        if i % 2:
            words[chance.randrange(len(words))] = "zzxy" + chance.choice(clean)[:3]
        out.append((i, " ".join(words), i % 2))
    return out


def tables(spark, rows, labels):
    docs = spark.createDataFrame(
        [(i, t, 5.0, 1, "x") for i, t in rows], "doc_id long, text string, score double, predicted int, size string"
    )
    return docs, spark.createDataFrame([(i, y, 1, "t") for i, y in labels], "doc_id long, toxic int, quality int, text string")


def test_query_on_awkward_tables(spark, monkeypatch, rows):
    train = net.Model.train
    monkeypatch.setattr(net.Model, "train", lambda self, texts, labels: train(self, texts, labels, steps=160))
    held = [(i, t) for i, t, _ in rows] + [(None, "zzxyabc here"), (900, None), (901, ""), (902, " ?! "), (7, rows[7][1]), (7, rows[7][1])]
    marks = [(i, y) for i, _, y in rows] + [(1, 1), (None, 1), (900, 1), (5000, 0), (3, None)]
    got = toxicity.toxicity(*tables(spark, held, marks)).collect()
    assert len(got) == len(held) and got[0].__fields__[:4] == ["doc_id", "held_out", "score", "predicted"]
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["score"] == 0 and by_id[i]["predicted"] == 0 for i in (900, 901, 902))
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert np.mean([by_id[i]["predicted"] == y for i, _, y in rows if by_id[i]["held_out"]]) >= 0.9
    assert by_id[None]["predicted"] == 1 and len({r["score"] for r in got if r["doc_id"] == 7}) == 1


@pytest.mark.parametrize("label", [0, 1, None])
def test_labels_without_a_class(spark, rows, label):
    marks = [(i, y) for i, _, y in rows if y == label]
    got = toxicity.toxicity(*tables(spark, [(i, t) for i, t, _ in rows[:5]], marks)).collect()
    assert [(r["score"], r["predicted"]) for r in got] == [(0.0, 0)] * 5


def test_no_documents(spark, rows):
    assert toxicity.toxicity(*tables(spark, [], [(i, y) for i, _, y in rows[:9]])).count() == 0
