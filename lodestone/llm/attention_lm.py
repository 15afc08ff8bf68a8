"""A small causal self-attention language model over words given as subword ids, in numpy.

p(word | context) = p(class of the word | context) * p(word | class). A word comes in as the mean of its subword ids' vectors; one
attention head looks back over the words of the window, and what it gathers, with the last word itself, gives the class logits.
Frequent words are classes of their own; all others are classed by topic, which their subword ids tell, and by whether they are rare. The vectors
come from counts: topics are groups of frequent words that stand near each other, and a subword id's vector tells how much more often than
expected it lies in a window of each topic. Queries, keys, positions and logits are trained by gradients summed over documents, which do
not depend on how those are dealt out. Contexts are windows that overlap: each token is scored once, by the window in which it has
at least WINDOW - STRIDE tokens before it (or all there are).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Tokens of a window, tokens that each further window scores, topics, frequent words that tell topics, those of them that are classes of their own.
WINDOW, STRIDE, TOPICS, FREQUENT, OWN = 32, 24, 8, 111, 47
#: Classes: frequent words, the text's end, and two for each topic; words counted up to RARE times are in the second.
END, CLASSES, RARE = OWN, OWN + 1 + 2 * TOPICS, 3
#: Width of a word's vector: its topics, and fixed random numbers for its class.
WIDTH = 16
_BATCH = 128
_F = np.float32
_MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, _F), 1)
_BACK = np.tril(np.ones((WINDOW, WINDOW), _F))
#: Size up to which powers of e need no shift to stay inside the range of _F, also in a sum of many.
_SAFE = 60.0
Parameters = dict[str, np.ndarray]


def topics(together: np.ndarray) -> np.ndarray:
    """The topic of each frequent word, from how often each two stand in one window: spherical k-means over their positive mutual information."""
    co = together.astype(float).copy()
    np.fill_diagonal(co, 0)
    total, own = max(co.sum(), 1.0), co.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rows = np.nan_to_num(np.maximum(np.log((co + 1) * total / np.outer(own, own)), 0), posinf=0.0)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True) + 1e-12
    centres = rows[:1]
    for _ in range(min(TOPICS, len(rows)) - 1):
        centres = np.vstack([centres, rows[(rows @ centres.T).max(axis=1).argmin()]])
    group = np.zeros(len(rows), np.int64)
    for _ in range(30):
        group = (rows @ centres.T).argmax(axis=1)
        centres = np.array([rows[group == k].mean(axis=0) if (group == k).any() else c for k, c in enumerate(centres)])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-12
    return group


def profiles(counts: np.ndarray) -> np.ndarray:
    """``counts`` of each subword id in windows of each topic to its vector: logarithms of how much more often than expected, smoothed."""
    share = (counts.sum(axis=0) + 1.0) / (counts.sum() + counts.shape[1])
    return np.log((counts + 5 * share) / (counts.sum(axis=1, keepdims=True) + 5) / share).astype(_F)


@dataclass(frozen=True)
class Words:
    """How words are seen: ``profile`` of each subword id, and the vectors that classes add."""

    profile: np.ndarray

    def look(self, ids: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and vector of each word, of ``sizes`` subword ids; ``frequent`` is its rank among the frequent words or -1, ``c`` its count."""
        mean = np.zeros((len(sizes), TOPICS), _F)
        has = np.flatnonzero(sizes)
        if len(has):
            mean[has] = np.add.reduceat(self.profile[ids], (np.cumsum(sizes) - sizes)[has]) / sizes[has, None]
        classes = np.where((frequent >= 0) & (frequent < OWN), frequent, OWN + 1 + 2 * mean.argmax(axis=1) + (c <= RARE))
        return classes, np.hstack([np.clip(mean, -3, 3), _DRAWN[classes]])


_DRAWN = (np.random.default_rng(0).standard_normal((CLASSES, WIDTH - TOPICS)) * 0.5).astype(_F)
#: The vector of a text's end, which also stands before its first word.
END_VECTOR = np.concatenate([np.zeros(TOPICS, _F), _DRAWN[END]])


def initial(class_tokens: np.ndarray, seed: int = 0) -> Parameters:
    """Attention that is nearly even, and logits that are the classes' own."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(_F)
    own = np.log((class_tokens + 0.5) / (class_tokens.sum() + 0.5 * CLASSES)).astype(_F)
    return {"Q": draw(WIDTH, WIDTH, by=0.1), "K": draw(WIDTH, WIDTH, by=0.1), "P": draw(WINDOW, WIDTH, by=0.02), "U": np.zeros((2 * WIDTH, CLASSES), _F), "b": own}


def _large(x: np.ndarray) -> bool:
    """Whether powers of e need a shift by each row's largest value, which costs as much as the powers do where rows are short."""
    return x.size > 0 and not (x.max() <= _SAFE and x.min() >= -_SAFE)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the rows, as a product, which costs a fraction of sums along an axis."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones((x.shape[-1], 1), x.dtype)).reshape(*x.shape[:-1], 1)


def _attend(p: Parameters, x: np.ndarray):
    n, w, d = x.shape
    placed = (x + p["P"][:w]).reshape(-1, d)
    q, k = (placed @ (p["Q"] * _F(d**-0.5))).reshape(n, w, d), (placed @ p["K"]).reshape(n, w, d)
    a = np.matmul(q, k.transpose(0, 2, 1))
    if _large(a):
        a += _MASK[:w, :w]
        a -= a.max(axis=-1, keepdims=True)
        np.exp(a, out=a)
    else:
        np.exp(a, out=a)
        a *= _BACK[:w, :w]
    a /= _sums(a)
    seen = np.concatenate([np.matmul(a, x).reshape(-1, d), x.reshape(-1, d)], axis=1)
    return placed, q, k, a, seen


def _shares(p: Parameters, seen: np.ndarray, aim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each class's share of ``total``, that total, and log probability of the class that comes."""
    logits = seen @ p["U"]
    logits += p["b"]
    if _large(logits):
        logits -= logits.max(axis=1, keepdims=True)
    logs = logits[np.arange(len(aim)), aim]
    np.exp(logits, out=logits)
    total = _sums(logits)
    logs -= np.log(total[:, 0])
    return logits, total, logs


def windows(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many tokens: the text, first position and first counted place of each window; each token counts in one window."""
    n = np.maximum(1, -(-(lengths - (WINDOW - stride)) // stride))
    text = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, k * stride, np.where(k == 0, 0, WINDOW - stride)


def _batches(vectors: np.ndarray, lengths: np.ndarray, stride: int, batch: int):
    """Vectors before each token of some windows, and the tokens that count: their places among the windows' and in the stream.

    ``vectors`` are those of the texts' tokens, one text after another, each with its end.
    """
    offsets = np.cumsum(lengths) - lengths
    text, first, place = windows(lengths, stride)
    steps = np.arange(WINDOW)
    for lo in range(0, len(text), batch):
        t, start = text[lo : lo + batch, None], first[lo : lo + batch, None]
        inside = start + steps
        real = inside < lengths[t]
        before = np.where(real & (inside > 0), offsets[t] + inside - 1, len(vectors) - 1)  # the stream's last token is an end
        counted = np.flatnonzero((real & (steps >= place[lo : lo + batch, None])).ravel())
        yield vectors[before], counted, (offsets[t] + inside).ravel()[counted]


def score(p: Parameters, vectors: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of each token's class, given what is before it in its text."""
    out = np.zeros(len(classes))
    for x, counted, at in _batches(vectors, lengths, STRIDE, _BATCH):
        seen = _attend(p, x)[-1]
        out[at] = _shares(p, seen[counted], classes[at])[2]
    return out


def gradient(p: Parameters, vectors: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> tuple[Parameters, float]:
    """Sum over the tokens of the gradient of their negative log probability, and that sum itself; windows do not overlap here."""
    total = {k: np.zeros(v.shape) for k, v in p.items()}
    loss = 0.0
    for x, counted, at in _batches(vectors, lengths, WINDOW, _BATCH):
        n, w, d = x.shape
        placed, q, k, a, seen = _attend(p, x)
        used = seen[counted]
        off, whole, logs = _shares(p, used, classes[at])
        off /= whole
        loss -= float(logs.sum())
        off[np.arange(len(at)), classes[at]] -= 1
        total["U"] += used.T @ off
        total["b"] += off.sum(axis=0)
        back = np.zeros((n * w, d), _F)
        back[counted] = off @ p["U"][:d].T
        da = np.matmul(back.reshape(n, w, d), x.transpose(0, 2, 1))
        da -= _sums(da * a)
        da *= a
        dq, dk = np.matmul(da, k).reshape(-1, d), np.matmul(da.transpose(0, 2, 1), q).reshape(-1, d)
        scale = _F(d**-0.5)
        total["Q"] += placed.T @ dq * scale
        total["K"] += placed.T @ dk
        at_place = lambda g: g.reshape(n, w, d).sum(axis=0)
        total["P"][:w] += at_place(dq) @ (p["Q"].T * scale) + at_place(dk) @ p["K"].T
    return total, loss


class Adam:
    """Steps along mean gradients."""

    def __init__(self, rate: float) -> None:
        self.rate, self.step, self.mean, self.square = rate, 0, {}, {}

    def __call__(self, p: Parameters, g: Parameters) -> Parameters:
        self.step += 1
        out = {}
        for name, value in p.items():
            m = self.mean[name] = 0.8 * self.mean.get(name, 0.0) + 0.2 * g[name]
            s = self.square[name] = 0.95 * self.square.get(name, 0.0) + 0.05 * g[name] ** 2
            out[name] = (value - self.rate * (m / (1 - 0.8**self.step)) / (np.sqrt(s / (1 - 0.95**self.step)) + 1e-8)).astype(_F)
        return out
