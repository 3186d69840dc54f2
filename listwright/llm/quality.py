"""Quality rules as weak supervision: each rule votes good or bad or abstains, expectation-maximisation estimates from the
votes alone how accurate each rule is, and the posterior probability decides.

Votes form one of at most 3^rules patterns. Only the patterns' counts pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import Buffer, column, in_arrow, texts, words_of
from listwright.session import materialise

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
LEAST_POSTERIOR = 0.5

BAD, ABSTAIN, GOOD = 0, 1, 2


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a run of five words found twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    runs = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    ids, base, width = runs, len(numbers), 1
    # Number the runs of 2, then 4 words; two runs of 4 that overlap by three make one of 5.
    for step in (1, 2, 1):
        _, ids = np.unique(ids[:-step] * np.int64(ids.max() + 1) + ids[step:], return_inverse=True)
        width += step
    assert width == WINDOW and base
    twice = np.bincount(ids) > 1
    starts = np.nonzero(twice[ids])[0]
    if not len(starts):
        return 0
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + WINDOW, -1)
    return int((np.cumsum(covered[:n]) > 0).sum())


def measures(body: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; then n_lines, n_distinct, upper, lower, marks, ends,
    others (ASCII characters that are no letters or spaces)."""
    words, text = words_of(body), body.decode()
    lines = [line for line in body.split(b"\n") if line.strip(b" \t\n\r\v\f")]
    letters = np.frombuffer(body, np.uint8)
    upper, lower = int(((letters >= 65) & (letters <= 90)).sum()), int(((letters >= 97) & (letters <= 122)).sum())
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        upper,
        lower,
        text.count("!"),
        sum(1 for w in words if w.endswith((b".", b"!", b"?"))),
        int(((letters > 32) & (letters < 127)).sum()) - upper - lower,
    )


def _vote(value: float, bad, good) -> int:
    return BAD if bad(value) else GOOD if good(value) else ABSTAIN


#: Rules: name, and the vote from the measures. Shares are of words or of letters.
RULES = (
    ("symbols", lambda m: _vote(m[2] / max(1, m[1]), lambda x: x > 0.03, lambda x: x < 0.005)),
    ("decorated", lambda m: _vote(m[2] / max(1, m[0]), lambda x: x > 0.2, lambda x: x < 0.05)),
    ("letters", lambda m: _vote(m[11] / max(1, m[1]), lambda x: x > 0.1, lambda x: x < 0.05)),
    ("repeats", lambda m: _vote(m[4] / max(1, m[0]), lambda x: x > 0.1, lambda x: x == 0 and m[0] >= 30)),
    ("lines", lambda m: _vote(m[3] / max(1, m[5]), lambda x: x > 0.3, lambda x: x == 0 and m[5] > 2)),
    ("capitals", lambda m: _vote(m[7] / max(1, m[7] + m[8]), lambda x: x > 0.4, lambda x: x < 0.15 and m[8] > 0)),
    ("variety", lambda m: _vote(m[6] / max(1, m[0]), lambda x: x < 0.2 and m[0] < 2000, lambda x: x > 0.4)),
    ("exclamations", lambda m: _vote(m[9] / max(1, m[0]), lambda x: x > 0.2, lambda x: x < 0.01)),
    ("sentences", lambda m: _vote(m[10] / max(1, m[0]), lambda x: x < 0.01 and m[0] >= 30, lambda x: 0.02 <= x <= 0.3)),
    ("length", lambda m: _vote(m[0], lambda x: x < LEAST_WORDS, lambda x: x >= 50)),
    ("word_length", lambda m: _vote(m[1] / max(1, m[0]), lambda x: x > 15 or x < 2, lambda x: 3 <= x <= 10)),
)


def pattern(m: tuple[int, ...]) -> str:
    return "".join(str(rule(m)) for _, rule in RULES)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words


class LabelModel:
    """Share of good documents and, for each rule, how it votes on good and on bad ones."""

    def __init__(self, counts: dict[str, int], steps: int = 60, smooth: float = 1.0):
        """Fit to how often each pattern occurs. Starts where any bad vote makes a document likely bad."""
        patterns = sorted(counts)
        votes = np.array([[int(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), len(RULES))
        weight = np.array([counts[p] for p in patterns], float)
        good = np.where((votes == BAD).any(axis=1), 0.1, 0.95)
        one_hot = votes[:, :, None] == np.arange(3)
        for _ in range(steps):
            mass = [(weight * share) for share in (1 - good, good)]
            self.prior = (mass[1].sum() + smooth) / (weight.sum() + 2 * smooth)
            self.chances = np.stack([(m[:, None, None] * one_hot).sum(axis=0) + smooth for m in mass])
            self.chances /= self.chances.sum(axis=2, keepdims=True)
            good = self._posterior(votes)
        self.patterns = dict(zip(patterns, good.tolist()))

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.chances)
        bad, good = (sum(logs[c, j, votes[:, j]] for j in range(len(RULES))) for c in (0, 1))
        odds = good - bad + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """For each rule, how often it is right where it votes."""
        out = {}
        for j, (name, _) in enumerate(RULES):
            right = self.prior * self.chances[1, j, GOOD] + (1 - self.prior) * self.chances[0, j, BAD]
            wrong = self.prior * self.chances[1, j, BAD] + (1 - self.prior) * self.chances[0, j, GOOD]
            out[name] = float(right / (right + wrong))
        return out


_MEASURED = pa.schema(
    [("doc_id", pa.int64())]
    + [(name, pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("votes", pa.string())]
)
_MEASURED_SQL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, votes string"
)


def _measured(batches) -> Iterator[pa.RecordBatch]:
    out = Buffer(_MEASURED)
    for batch in batches:
        for doc_id, body in zip(column(batch, "doc_id"), column(batch, "body")):
            m = measures(body)
            yield from out.add((doc_id, *m[:5], base_failed(m[0], m[4]), pattern(m)))
    yield from out.flush()


def label_model(measured: DataFrame) -> LabelModel:
    counts = measured.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3^rules rows
    return LabelModel({row["votes"]: row["n"] for row in counts})


def judged(docs: DataFrame) -> DataFrame:
    """Measures, votes, the posterior ``quality`` and ``kept``: a row per row of ``docs``.

    Null or empty texts have no words: all measures are 0, base_failed is true. kept is false where base_failed, else whether
    the posterior is at least one half. Rows with or without ids, repeated or not, are judged alike. No rows give no rows.
    """
    measured = materialise(in_arrow(texts(docs), _measured, _MEASURED_SQL), "measured")
    model = label_model(measured)
    # At most 3^rules patterns.
    posteriors = docs.sparkSession.createDataFrame(list(model.patterns.items()), "votes string, quality double")
    kept = ~F.col("base_failed") & (F.col("quality") >= LEAST_POSTERIOR)
    return measured.join(F.broadcast(posteriors), "votes").withColumn("kept", kept)


def _keep(posteriors: dict[str, float]):
    def keep(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for text in column(batch, "text"):
                m = measures((text or "").encode())
                good.append(not base_failed(m[0], m[4]) and posteriors[pattern(m)] >= LEAST_POSTERIOR)
            yield batch.filter(pa.array(good, pa.bool_()))

    return keep


def only_good(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rejected rows."""
    model = label_model(in_arrow(texts(docs), _measured, _MEASURED_SQL))
    return in_arrow(docs, _keep(model.patterns), docs.schema)
