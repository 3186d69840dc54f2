"""A bidirectional gated recurrent network with attention pooling, over characters and words, in numpy.

A word's input is the pooled output of a recurrent network over its characters and an embedding of its hash. A window's
score is a linear function of the pooled output of a second network over its words. Both are trained together.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

WINDOW = 32  # words; a window starts at every word that has so many from it on, and at the first
STRIDE = 24  # words between the starts of the windows that are learnt from
STRETCH = 128  # window starts whose words the network reads in one go
LONGEST = 12  # characters; a longer word is several inputs
CHARS, BUCKETS = 512, 4096
CHAR_SIZE, WORD_SIZE, HIDDEN = 16, 8, 8
WORD_DROPOUT = 0.5

_WORDS = re.compile(r"\w{1,%d}" % LONGEST)
_F = np.float32


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def window_starts(n: int) -> range:
    """Starts of the windows of n words that are learnt from: every one of them lies in a window."""
    return range(0, max(n - (WINDOW - STRIDE), 1) if n else 0, STRIDE)


def char_ids(word: str) -> list[int]:
    return [c if c < 256 else 256 + c % 256 for c in map(ord, word)]


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.maximum(x, -60)))


def gates(a: np.ndarray, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: input part a and state part u of reset, update and candidate; the new state."""
    n = h.shape[-1]
    both = _sigmoid(a[..., : 2 * n] + u[..., : 2 * n])
    reset, update = both[..., :n], both[..., n:]
    new = np.tanh(a[..., 2 * n :] + reset * u[..., 2 * n :])
    return reset, update, new, new + update * (h - new)


def recurrent(a: np.ndarray, r: np.ndarray, mask: np.ndarray | None, back: bool, kept: list | None = None) -> np.ndarray:
    """States [T, B, H] from input parts a [T, B, 3H]; masked places keep the state before."""
    steps, size, width = a.shape
    out, h = np.empty((steps, size, width // 3), _F), np.zeros((size, width // 3), _F)
    for t in range(steps)[:: -1 if back else 1]:
        u = h @ r
        reset, update, new, after = gates(a[t], u, h)
        if mask is not None:
            after = np.where(mask[t], after, h)
        if kept is not None:
            kept.append((t, h, u, reset, update, new))
        out[t] = h = after
    return out


def recurrent_gradient(d_out, r, mask, kept) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input parts and of r, from those of the states."""
    steps, size, n = d_out.shape
    d_a, d_r, d_h = np.zeros((steps, size, 3 * n), _F), np.zeros_like(r), np.zeros((size, n), _F)
    for t, h, u, reset, update, new in reversed(kept):
        d_h = d_h + d_out[t]
        live = d_h * mask[t]
        d_new = live * (1 - update) * (1 - new * new)
        d_update = live * (h - new) * update * (1 - update)
        d_reset = d_new * u[:, 2 * n :] * reset * (1 - reset)
        d_a[t] = np.concatenate([d_reset, d_update, d_new], axis=1)
        d_u = np.concatenate([d_reset, d_update, d_new * reset], axis=1)
        d_r += h.T @ d_u
        d_h = d_h * (1 - mask[t]) + live * update + d_u @ r.T
    return d_a, d_r


def pooled(states: np.ndarray, attention: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention-weighted means [B, 2H] of states [T, B, 2H], and the weights."""
    energy = np.where(mask[..., 0] > 0, states @ attention, -1e9)
    weight = np.exp(energy - energy.max(axis=0))
    weight /= weight.sum(axis=0)
    return np.einsum("tb,tbh->bh", weight, states), weight


class Layer:
    """Both directions and the pooling; ``names`` are its parameters in the model."""

    def __init__(self, prefix: str, size: int, random: np.random.Generator):
        self.prefix = prefix
        self.start = {
            f"{prefix}{name}": (random.standard_normal(shape) * scale).astype(_F)
            for name, shape, scale in (
                ("wf", (size, 3 * HIDDEN), size**-0.5),
                ("wb", (size, 3 * HIDDEN), size**-0.5),
                ("rf", (HIDDEN, 3 * HIDDEN), HIDDEN**-0.5),
                ("rb", (HIDDEN, 3 * HIDDEN), HIDDEN**-0.5),
                ("bf", (3 * HIDDEN,), 0.0),
                ("bb", (3 * HIDDEN,), 0.0),
                ("at", (2 * HIDDEN,), 0.1),
            )
        }

    def forward(self, p: dict, x: np.ndarray, mask: np.ndarray):
        k = self.prefix
        sides, kept = [], []
        for side, back in (("f", False), ("b", True)):
            kept.append([])
            sides.append(recurrent(x @ p[f"{k}w{side}"] + p[f"{k}b{side}"], p[f"{k}r{side}"], mask > 0, back, kept[-1]))
        states = np.concatenate(sides, axis=2)
        out, weight = pooled(states, p[f"{k}at"], mask)
        return out, (x, mask, kept, states, out, weight)

    def backward(self, p: dict, g: dict, d_out: np.ndarray, held) -> np.ndarray:
        k = self.prefix
        x, mask, kept, states, out, weight = held
        d_weight = np.einsum("bh,tbh->tb", d_out, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g[f"{k}at"] = np.einsum("tb,tbh->h", d_energy, states)
        d_states = weight[..., None] * d_out + d_energy[..., None] * p[f"{k}at"]
        d_x = 0
        for i, side in enumerate("fb"):
            part = np.ascontiguousarray(d_states[..., i * HIDDEN : (i + 1) * HIDDEN])
            d_a, g[f"{k}r{side}"] = recurrent_gradient(part, p[f"{k}r{side}"], mask, kept[i])
            flat = d_a.reshape(-1, 3 * HIDDEN)
            g[f"{k}w{side}"] = x.reshape(-1, x.shape[2]).T @ flat
            g[f"{k}b{side}"] = flat.sum(axis=0)
            d_x = d_x + d_a @ p[f"{k}w{side}"].T
        return d_x


_CHAR_LAYER, _WORD_LAYER = "c", "w"


def char_arrays(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character ids [T, B] and mask [T, B, 1]."""
    longest = max(map(len, words))
    ids = np.zeros((longest, len(words)), np.int64)
    mask = np.zeros((longest, len(words), 1), _F)
    for i, word in enumerate(words):
        ids[: len(word), i] = char_ids(word)
        mask[: len(word), i] = 1
    return ids, mask


class Model:
    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        self.random = random
        self.chars = Layer(_CHAR_LAYER, CHAR_SIZE, random)
        self.words = Layer(_WORD_LAYER, 2 * HIDDEN + WORD_SIZE, random)
        self.p = {
            "char": (random.standard_normal((CHARS, CHAR_SIZE)) * 0.5).astype(_F),
            "word": np.zeros((BUCKETS, WORD_SIZE), _F),  # words never learnt add nothing
            **self.chars.start,
            **self.words.start,
            "out": (random.standard_normal(2 * HIDDEN) * 0.3).astype(_F),
            "bias": np.full(1, -2, _F),
        }

    def gradients(self, docs: list[list[str]], labels: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch. A document is toxic if any window is: its chance is 1 - prod(1 - p)."""
        p, g = self.p, {}
        number: dict[str, int] = {}
        windows, owner = [], []
        for d, words in enumerate(docs):
            ids = [number.setdefault(w, len(number)) for w in words]
            for start in window_starts(len(ids)):
                windows.append(ids[start : start + WINDOW])
                owner.append(d)
        distinct, owner = list(number), np.array(owner)
        grid = np.zeros((WINDOW, len(windows)), np.int64)
        mask = np.zeros((WINDOW, len(windows), 1), _F)
        for i, ids in enumerate(windows):
            grid[: len(ids), i] = ids
            mask[: len(ids), i] = 1
        chars, char_mask = char_arrays(distinct)
        char_out, char_held = self.chars.forward(p, p["char"][chars], char_mask)
        buckets = np.array([bucket(w) for w in distinct])
        # Half of the words show their characters only, lest the network learn rare words by heart.
        shown = (self.random.random((len(buckets), 1)) >= WORD_DROPOUT).astype(_F)
        inputs = np.concatenate([char_out, p["word"][buckets] * shown], axis=1)
        out, held = self.words.forward(p, inputs[grid], mask)
        logit = out @ p["out"] + p["bias"][0]
        # log(1 - p) of windows add up within a document.
        safe = np.bincount(owner, weights=-np.logaddexp(0, logit.astype(float)), minlength=len(docs))
        chance = np.clip(-np.expm1(safe), 1e-7, 1 - 1e-9)
        loss = float(-np.where(labels > 0, np.log(chance), safe).mean())
        per_doc = np.where(labels > 0, -(1 - chance) / chance, 1.0) / len(docs)
        d_logit = (per_doc[owner] * _sigmoid(logit)).astype(_F)
        g["out"], g["bias"] = out.T @ d_logit, np.array([d_logit.sum()], _F)
        d_inputs_grid = self.words.backward(p, g, d_logit[:, None] * p["out"], held)
        d_inputs = np.zeros_like(inputs)
        np.add.at(d_inputs, grid.reshape(-1), (d_inputs_grid * mask).reshape(-1, inputs.shape[1]))
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], buckets, d_inputs[:, 2 * HIDDEN :] * shown)
        d_chars = self.chars.backward(p, g, np.ascontiguousarray(d_inputs[:, : 2 * HIDDEN]), char_held)
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], chars.reshape(-1), (d_chars * char_mask).reshape(-1, CHAR_SIZE))
        return loss, g

    def train(self, texts: list[str], labels: list[int], steps: int = 800, batch: int = 16, rate: float = 0.015, seed: int = 7):
        """Adam over shuffled batches, the rate falling to a tenth. Texts without words teach nothing."""
        docs = [words_of(t) for t in texts]
        chosen = [i for i, d in enumerate(docs) if d]
        random, step = np.random.default_rng(seed), 0
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        y = np.array(labels)
        while step < steps and chosen:
            order = random.permutation(chosen)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                _, g = self.gradients([docs[i] for i in some], y[some])
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                now = rate * (1 - 0.9 * min(step, steps) / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, v in g.items():
                    v = v * min(1.0, 1.0 / max(norm, 1e-9))
                    mean[k] = 0.9 * mean[k] + 0.1 * v
                    square[k] = 0.999 * square[k] + 0.001 * v * v
                    self.p[k] -= (now * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(_F)
        return self


class Scorer(dict):
    """Scores texts with a trained model. Remembers words' inputs; forgets them all when it holds ``most``."""

    most = 150_000

    def __init__(self, p: dict):
        super().__init__()
        self.p = p
        self.inputs = np.zeros((self.most + 1, 6 * HIDDEN), _F)
        # Row 0 stands for no word: its update gate is shut, so it leaves the state as it was.
        self.inputs[0, HIDDEN : 2 * HIDDEN] = self.inputs[0, 4 * HIDDEN : 5 * HIDDEN] = 60
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self) + 1
        self.new.append(word)
        return at

    def _learn(self) -> None:
        """Work out the inputs of new words, those of like length together."""
        p, first = self.p, len(self) - len(self.new) + 1
        order = np.argsort([len(w) for w in self.new], kind="stable")
        for at in range(0, len(order), 2048):
            some = order[at : at + 2048]
            words = [self.new[i] for i in some]
            chars, mask = char_arrays(words)
            x = p["char"][chars]
            sides = [
                recurrent(x @ p[f"cw{s}"] + p[f"cb{s}"], p[f"cr{s}"], mask > 0, s == "b") for s in "fb"
            ]
            out, _ = pooled(np.concatenate(sides, axis=2), p["cat"], mask)
            both = np.concatenate([out, p["word"][[bucket(w) for w in words]]], axis=1)
            parts = np.concatenate([both @ p["wwf"] + p["wbf"], both @ p["wwb"] + p["wbb"]], axis=1)
            self.inputs[first + some] = parts
        self.new = []

    def _best(self, grid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The highest chance of any window of stretches [T, B] of word numbers (0: no word), each of ``sizes`` words.

        The states are those of the stretch. As the score is linear in what attention pools, a window's score is a
        quotient of two sums over its words; sums over all windows come from sums over 2, 4, 8 ... words.
        """
        p, out = self.p, np.empty(grid.shape[1], _F)
        for at in range(0, grid.shape[1], 512):
            ids = grid[:, at : at + 512]
            a = self.inputs[ids]
            states = np.concatenate(
                [
                    recurrent(a[..., i * 3 * HIDDEN : (i + 1) * 3 * HIDDEN], p[f"wr{s}"], None, s == "b")
                    for i, s in enumerate("fb")
                ],
                axis=2,
            )
            energy = np.where(ids > 0, states @ p["wat"], -np.inf)
            weight = np.exp(energy - energy.max(axis=0))
            told = weight * (states @ p["out"])
            width = 1
            while width < WINDOW:  # a power of two
                weight, told = weight[:-width] + weight[width:], told[:-width] + told[width:]
                width *= 2
            # Windows that end within the words; of fewer words than a window, the one that holds all.
            whole = np.arange(len(weight))[:, None] <= np.maximum(sizes[at : at + 512] - WINDOW, 0)
            logit = np.where(whole, told / np.maximum(weight, 1e-30), -np.inf).max(axis=0) + p["bias"][0]
            # Within what a float tells from 0 and 1, so that scores keep their order.
            out[at : at + 512] = _sigmoid(np.clip(logit, -15, 15))
        return out

    def _numbered(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest chance of any window of each text, whichever word it starts at; 0 without words."""
        out = np.zeros(len(texts), float)
        held, owners, sizes, size = [], [], [], 0
        longest = STRETCH + WINDOW - 1

        def settle():
            nonlocal held, owners, sizes, size
            if self.new:
                self._learn()
            if held:
                lengths = np.array(sizes)
                # Stretches of like length go together, cut to the longest.
                for low, high in zip((0, 32, 48, 64, 96, 128), (32, 48, 64, 96, 128, longest)):
                    some = np.nonzero((lengths > low) & (lengths <= high))[0]
                    if len(some):
                        grid = np.zeros((max(high, WINDOW), len(some)), np.int64)
                        for column, i in enumerate(some.tolist()):
                            grid[: sizes[i], column] = held[i]
                        np.maximum.at(out, np.array(owners)[some], self._best(grid, lengths[some]))
            held, owners, sizes, size = [], [], [], 0

        part = max(self.most // 4 // STRETCH, 1) * STRETCH  # words numbered at a time
        for i, text in enumerate(texts):
            words = words_of(text)
            for begin in range(0, max(len(words) - WINDOW + 1, min(len(words), 1)), part):
                some = words[begin : begin + part + WINDOW - 1]
                if len(self) + len(some) > self.most:
                    settle()
                    self.clear()
                ids = self._numbered(some)
                for start in range(0, max(len(ids) - WINDOW + 1, 1), STRETCH):
                    stretch = ids[start : start + longest]
                    held.append(stretch)
                    owners.append(i)
                    sizes.append(len(stretch))
                size += len(ids)
                if size > 100_000:
                    settle()
        settle()
        return out
