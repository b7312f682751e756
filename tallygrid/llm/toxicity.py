"""Toxicity by a convolutional text classifier.

A word is embedded as the sum of hashed rows: two of the whole word, so that strangers share
them only when both hashes collide, and one of each of its beginnings, which relatives share. Filters of several widths run over the words, each
keeps its largest response in the text, and a logistic layer turns the responses into a
probability. Embeddings, filters and output weights are trained together in numpy, in tasks, on all labelled
texts: these are dealt into blocks, every block trains for an epoch from the same weights, and the next
epoch begins with the mean of what the blocks learnt. The threshold is calibrated per language, where the language
is guessed from the text by word frequencies learnt from the same texts.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallygrid.llm.common import (
    bounded_sample,
    fold,
    groups_by_size,
    held_out,
    logit,
    sigmoid,
    stretch,
    table,
    text_batches,
)
from tallygrid.session import stored

CUT = 0.3  # scores from here on are toxic
ROWS, PAD = 1 << 18, 1 << 18  # hashed rows; row PAD stands for the space between texts
BEGINNINGS = (3, 4, 5, 6, 7)  # bytes of the beginnings that a word shares with its relatives
PARTS = 2 + len(BEGINNINGS)
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
WORDS = re.compile(r"\w+")


@dataclass
class Model:
    """Weights of the network, language profiles and the threshold of each language."""

    table: np.ndarray  # (ROWS + 1) x DIM
    kernels: list[np.ndarray]  # for each width: width x DIM x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    languages: np.ndarray = field(default_factory=lambda: np.zeros((ROWS + 1, 0), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.array([0.5]))  # one a language, then for any other
    constant: float | None = None  # the score of every text where there was nothing to learn


class Hasher:
    """Hashed rows of words; numbers up to ``most`` different words and then starts anew."""

    def __init__(self, most: int = 150_000):
        self.most = most
        self.clear()

    def clear(self):
        self.seen, self.parts = {"": 0}, np.full((1, PARTS), PAD, np.int32)  # word 0 is the space between texts

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of every word of the texts, and how many words each text has."""
        return self.numbers([WORDS.findall(t.lower()) for t in texts])

    def numbers(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Number of every word of the lines, and how many words each has.

        ``parts[number]`` are the rows whose sum embeds the word: two hashes of the word and one
        of each of its beginnings.
        """
        seen, fresh, out, lengths = self.seen, array("q"), [], np.zeros(len(lines), np.int64)
        for k, words in enumerate(lines):
            lengths[k] = len(words)
            for word in set(words).difference(seen):
                seen[word] = len(seen)
                raw = word.encode("utf-8", "replace")
                fresh.extend((zlib.crc32(raw), zlib.crc32(raw, 0x5BD1E995)))
                fresh.extend([zlib.crc32(raw[:n], n) if n < len(raw) else -1 for n in BEGINNINGS])
            out.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
        new = np.frombuffer(fresh, np.int64).reshape(-1, PARTS)
        self.parts = np.concatenate([self.parts, np.where(new < 0, PAD, new % ROWS).astype(np.int32)])
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), lengths

    def trim(self):
        """Forget the words when there are too many; numbers given before are void then."""
        if len(self.seen) > self.most:
            self.clear()


def _laid_out(words, lengths):
    """Words of the texts one after the other, two pads after each, and where each begins and ends.

    A text without words counts as one pad.
    """
    size = np.maximum(lengths, 1)
    begin = np.concatenate([[0], np.cumsum(size + 2)[:-1]]).astype(np.int64)
    laid = np.zeros(int((size + 2).sum()), np.int64)
    laid[np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(words))] = words
    return laid, begin, begin + size


def _responses(x, kernel, bias):
    """Response of every filter at every start of a window; the last windows reach beyond the end."""
    width = len(kernel)
    z = x @ kernel[0] + bias
    for j in range(1, width):
        z[:-j] += x[j:] @ kernel[j]
    return z


def _vectors(model: Model, parts: np.ndarray) -> np.ndarray:
    """Embeddings of words, a part after the other to keep the arrays small."""
    return sum(model.table.take(parts[:, k], axis=0) for k in range(PARTS))


def _different(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of word numbers below ``most``, rising, and the place of each word among them."""
    there, places = np.zeros(most, bool), np.empty(most, np.int32)
    there[words] = True
    different = np.flatnonzero(there)
    places[different] = np.arange(len(different), dtype=np.int32)
    return different, places.take(words)


def pooled(model: Model, words, lengths, starts, parts) -> np.ndarray:
    """Largest response of every filter in each stretch of words, over its first ``starts`` places."""
    out = np.empty((len(lengths), sum(k.shape[2] for k in model.kernels)), np.float32)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for lo, hi in groups_by_size(lengths, 200_000):
        laid, begin, _ = _laid_out(words[ends[lo] : ends[hi]], lengths[lo:hi])
        different, laid = _different(laid, len(parts))
        x = _vectors(model, parts.take(different, axis=0)).take(laid, axis=0)
        bounds = np.stack([begin, begin + np.maximum(starts[lo:hi], 1)], 1).ravel()
        out[lo:hi] = np.concatenate([
            np.maximum(np.maximum.reduceat(_responses(x, k, c), bounds, axis=0)[::2], 0)
            for k, c in zip(model.kernels, model.biases, strict=True)
        ], 1)
    return out


def probabilities(model: Model, words, lengths, parts) -> np.ndarray:
    """Probability of each text before calibration."""
    return sigmoid(pooled(model, words, lengths, lengths, parts) @ model.out + model.bias)


def language_sums(model: Model, words, lengths, starts, parts) -> np.ndarray:
    """Log frequencies in each language, added up over the first ``starts`` words of each stretch."""
    sums, ends = np.zeros((len(lengths), model.languages.shape[1])), np.concatenate([[0], np.cumsum(lengths)])
    different, places = _different(words, len(parts))
    votes = model.languages.take(parts[different, 0], axis=0)
    for k in range(len(lengths)):
        sums[k] = votes.take(places[ends[k] : ends[k] + starts[k]], axis=0).sum(0)
    return sums


def _likeliest(model: Model, sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    known = model.languages.shape[1]
    return np.where(lengths > 0, sums.argmax(1), known) if known else np.zeros(len(lengths), np.int64)


def judged(model: Model, coded: list[np.ndarray], parts, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each text before calibration and the index of its likeliest language, the number of languages
    if there is none to tell. Long texts are read in stretches, as in :func:`scores`."""
    reach = max(WIDTHS) - 1
    cut = [(k, c[at : at + most + reach], min(most, len(c) - at)) for k, c in enumerate(coded) for at in range(0, max(len(c), 1), most)]
    rows, starts = np.array([k for k, _, _ in cut]), np.array([n for _, _, n in cut])
    words, sizes = np.concatenate([c for _, c, _ in cut]), np.array([len(c) for _, c, _ in cut])
    best = np.zeros((len(coded), len(model.out)), np.float32)
    np.maximum.at(best, rows, pooled(model, words, sizes, starts, parts))
    votes = np.zeros((len(coded), model.languages.shape[1]))
    np.add.at(votes, rows, language_sums(model, words, sizes, starts, parts))
    return sigmoid(best @ model.out + model.bias), _likeliest(model, votes, np.array([len(c) for c in coded]))


def words_of(text: str) -> Iterator[str]:
    """Words of a text in lower case; those of a long one are not held at once."""
    text = text.lower()
    return iter(WORDS.findall(text)) if len(text) <= 1_000_000 else (m[0] for m in WORDS.finditer(text))


def stretches(text: str, most: int) -> Iterator[tuple[list[str], int]]:
    """Words of a text in stretches that begin ``most`` words apart and reach into the next one as far as a filter
    does, and how many of them are the stretch's own. Their windows are those of the whole text."""
    found = words_of(text)
    words, reach = list(islice(found, most)), max(WIDTHS) - 1
    while True:
        ahead = list(islice(found, reach))
        yield words + ahead, len(words) if len(ahead) == reach else len(words) + len(ahead)
        if len(ahead) < reach:
            return
        words = ahead + list(islice(found, max(most - reach, 1)))


def scores(model: Model, texts: list[str], hasher: Hasher, most: int = 100_000) -> np.ndarray:
    """Calibrated scores: the threshold of the guessed language is moved to ``CUT``.

    Texts are read in stretches of ``most`` words, as many at once as have about as many words, and the largest
    responses of a text are those of its stretches; so the memory does not grow with a text.
    """
    if model.constant is not None:
        return np.full(len(texts), model.constant, dtype=np.float64)
    best = np.zeros((len(texts), len(model.out)), np.float32)
    votes, lengths = np.zeros((len(texts), model.languages.shape[1])), np.zeros(len(texts), np.int64)
    some: list[tuple[int, list[str], int]] = []

    def take() -> None:
        hasher.trim()
        words, sizes = hasher.numbers([w for _, w, _ in some])
        rows, starts = np.array([k for k, _, _ in some]), np.array([n for _, _, n in some])
        np.maximum.at(best, rows, pooled(model, words, sizes, starts, hasher.parts))
        np.add.at(votes, rows, language_sums(model, words, sizes, starts, hasher.parts))
        np.add.at(lengths, rows, starts)
        some.clear()

    held = 0
    for k, text in enumerate(texts):
        for words, own in stretches(text, most):
            some.append((k, words, own))
            held += len(words)
            if held >= most:
                take()
                held = 0
    if some:
        take()
    p = np.clip(sigmoid(best @ model.out + model.bias), 1e-6, 1 - 1e-6)
    return sigmoid(logit(p) - logit(model.thresholds[_likeliest(model, votes, lengths)]) + logit(CUT))


class _Adagrad:
    def __init__(self, rate: float):
        self.rate, self.sums = rate, {}

    def step(self, name, value, gradient, at=slice(None)):
        if name not in self.sums:
            self.sums[name] = np.full(value.shape, 1e-3, np.float32)
        sums = self.sums[name][at] + gradient * gradient
        self.sums[name][at] = sums
        value[at] -= self.rate * gradient / np.sqrt(sums)


def _begun(seed: int = 1) -> tuple[Model, np.random.Generator]:
    """Weights before any training, and the generator that drew them."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.05, (ROWS + 1, DIM)).astype(np.float32),
        [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    model.table[PAD] = 0
    return model, rng


def _weights(labels: np.ndarray, toxic: float) -> np.ndarray:
    """Weight of each text by its class, where the share ``toxic`` of all texts is of class 1."""
    return np.where(labels == 1, 0.5 / max(toxic, 1e-9), 0.5 / max(1 - toxic, 1e-9))


EPOCHS, RATE = 10, 0.05
EPOCHS_A_ROUND = 2  # that a block trains before what the blocks learnt is added up


def train(coded, parts, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, seed: int = 1) -> Model:
    """Fit the network to the word numbers of texts by stochastic gradients; classes weigh the same."""
    model, rng = _begun(seed)
    weight, rule = _weights(labels, labels.mean()), _Adagrad(RATE)
    for _ in range(epochs):
        _epoch(model, rule, coded, parts, labels, weight, rng.permutation(len(coded)), batch)
    return model


def _epoch(model, rule, coded, parts, labels, weight, order, batch: int = 32) -> None:
    """Every text once, in the given order."""
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        _batch(model, rule, [coded[k] for k in some], parts, labels[some], weight[some])


def _best_places(model, laid, begin, end, parts, piece: int = 400_000):
    """For each width, the place of the largest response of every filter in each text, and that response; the words
    are read ``piece`` at a time, so the memory does not grow with a text."""
    places = [np.zeros((len(begin), FILTERS), np.int64) for _ in model.kernels]
    highest = [np.full((len(begin), FILTERS), -np.inf, np.float32) for _ in model.kernels]
    for lo in range(0, len(laid), piece):
        hi = min(lo + piece, len(laid))
        here = np.flatnonzero((begin < hi) & (end > lo))
        if not len(here):
            continue
        different, some = _different(laid[lo : hi + max(WIDTHS) - 1], len(parts))
        x = _vectors(model, parts.take(different, axis=0)).take(some, axis=0)
        bounds = list(zip(np.maximum(begin[here], lo) - lo, np.minimum(end[here], hi) - lo, strict=True))
        for kernel, shift, place, high in zip(model.kernels, model.biases, places, highest, strict=True):
            z = _responses(x, kernel, shift)
            at = np.stack([s + z[s:e].argmax(0) for s, e in bounds])
            value = z[at, np.arange(FILTERS)]
            better = value > high[here]
            place[here], high[here] = np.where(better, lo + at, place[here]), np.where(better, value, high[here])
    return places, highest


def _batch(model, rule, coded, parts, y, weight):
    laid, begin, end = _laid_out(np.concatenate(coded), np.array([len(c) for c in coded]))
    places, highest = _best_places(model, laid, begin, end, parts)
    h = np.concatenate([np.maximum(v, 0) for v in highest], 1)
    bias = np.array([model.bias], np.float32)
    error = ((sigmoid(h @ model.out + bias[0]) - y) * weight / len(y)).astype(np.float32)
    back = error[:, None] * model.out * (h > 0)
    rule.step("out", model.out, h.T @ error + 1e-4 * model.out)
    rule.step("bias", bias, error.sum(keepdims=True))
    model.bias = float(bias[0])
    rows, gradients = [], []
    for k, (kernel, best) in enumerate(zip(model.kernels, places, strict=True)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        change = np.empty_like(kernel)
        for j in range(len(kernel)):
            words = laid[best + j]
            change[j] = np.einsum("bfd,bf->df", _vectors(model, parts[words.ravel()]).reshape(*words.shape, DIM), g)
            rows.append(words.ravel())
            gradients.append((g[:, :, None] * kernel[j].T[None]).reshape(-1, DIM))
        rule.step(f"kernel{k}", kernel, change + 1e-5 * kernel)
        rule.step(f"shift{k}", model.biases[k], g.sum(0))
    touched = parts[np.concatenate(rows)]
    hit, where = np.unique(touched, return_inverse=True)
    total, gradient = np.zeros((DIM, len(hit)), np.float32), np.concatenate(gradients)
    for d in range(DIM):  # numpy adds up one dimension at a time much faster
        np.add.at(total[d], where.ravel(), np.repeat(gradient[:, d], PARTS))
    total[:, hit == PAD] = 0
    rule.step("table", model.table, np.ascontiguousarray(total.T), hit)


def _counts(coded, parts, lang: list[str | None]) -> dict[str, np.ndarray]:
    """How often the words of each hashed row come in the texts of each language, as far as languages are known."""
    return {
        name: np.bincount(parts[np.concatenate([c for c, x in zip(coded, lang, strict=True) if x == name]), 0], minlength=ROWS + 1)
        for name in {x for x in lang if x}
    }


def _profiles(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Log frequencies of words in each language."""
    known = np.full((ROWS + 1, len(counts)), 0.01)
    for k, name in enumerate(sorted(counts)):
        known[:, k] += counts[name]
    return (np.log(known) - np.log(known.sum(0))).astype(np.float32)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap between two scores that gives the best F1."""
    order = np.argsort(-p, kind="stable")
    found = np.cumsum(y[order])
    f1 = 2 * found / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float(np.clip((logit_mean(p[order[k]], below)), 0.02, 0.98))


def logit_mean(a: float, b: float) -> float:
    return float(sigmoid((logit(np.clip(a, 1e-4, 1 - 1e-4)) + logit(np.clip(b, 1e-4, 1 - 1e-4))) / 2))


WORDS_A_BLOCK, LINES_AT_ONCE = 4_000_000, 100_000  # words


class Block:
    """Labelled texts, coded one after the other: the numbers of their words, and for each its length, class and
    language. One text of four is kept for the calibration."""

    def __init__(self, block: int = 0, part: int = 0):
        self.block, self.part, self.hasher = block, part, Hasher()
        self.words: list[np.ndarray] = []
        self.lines: list[list[str]] = []
        self.sizes, self.toxic, self.lang, self.held, self.total = [], [], [], 0, 0

    def add(self, text: str, lang: str | None, toxic: float) -> None:
        found, size = words_of(text), 0
        while words := list(islice(found, LINES_AT_ONCE)):
            self.lines.append(words)
            size, self.held = size + len(words), self.held + len(words)
            if self.held >= LINES_AT_ONCE:
                self.flush()
        self.sizes.append(size)
        self.toxic.append(toxic)
        self.lang.append(lang)
        self.total += size

    def flush(self) -> None:
        self.words.append(self.hasher.numbers(self.lines)[0].astype(np.int32))
        self.lines, self.held = [], 0

    def row(self) -> pd.DataFrame:
        """The block as a row of ``CODED``."""
        self.flush()
        toxic = np.array(self.toxic, np.int64)
        learn = ~checked(len(toxic))
        words, sizes = np.concatenate(self.words), np.array(self.sizes, np.int64)
        return pd.DataFrame({
            "block": [self.block], "part": [self.part], "n": [len(toxic)], "n_toxic": [toxic.sum()],
            "learn": [learn.sum()], "learn_toxic": [toxic[learn].sum()],
            "words": [words.tobytes()], "sizes": [sizes.tobytes()], "parts": [self.hasher.parts.tobytes()],
            "toxic": [toxic.astype(np.int8).tobytes()], "lang": [self.lang],
        })


CODED = (
    "block long, part int, n long, n_toxic long, learn long, learn_toxic long, "
    "words binary, sizes binary, parts binary, toxic binary, lang array<string>"
)


def checked(n: int) -> np.ndarray:
    """Which of the texts of a block are kept for the calibration."""
    return np.arange(n) % 4 == 3


def _decoded(row) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[str | None]]:
    """Word numbers of each text, hashed rows of the words, classes and languages of a block."""
    words, sizes = np.frombuffer(row.words, np.int32), np.frombuffer(row.sizes, np.int64)
    coded = np.split(words, np.cumsum(sizes)[:-1])
    return coded, np.frombuffer(row.parts, np.int32).reshape(-1, PARTS), np.frombuffer(row.toxic, np.int8).astype(np.float64), list(row.lang)


def _code(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Blocks of rows that come sorted: the labels of an id, then its texts, of which equal ones count once; texts
    without labels are passed over. A block of over ``most`` words becomes several."""
    held, at, labels, before = None, None, [], None
    for batch in batches:
        for block, key, toxic, text, lang in zip(batch.block, batch.key, batch.toxic, batch.text, batch.lang, strict=True):
            if key != at:
                at, labels, before = key, [], None
            if text is None:
                labels += [toxic] if toxic not in labels else []
                continue
            if text == before:
                continue
            before = text
            for value in labels:
                if held is None or held.block != block or held.total >= most:
                    if held is not None:
                        yield held.row()
                    held = Block(block, held.part + 1 if held is not None and held.block == block else 0)
                held.add(text, lang, int(value))
    if held is not None:
        yield held.row()


def _constant(n: int, toxic: int) -> Model:
    """The model where there are not both classes to learn from."""
    prior = (toxic + 0.2) / (n + 1)  # below the cut where nothing is known
    return Model(np.zeros((1, DIM)), [], [], np.zeros(0), 0.0, constant=float(prior))


def fit_rows(texts: list[str], lang: list[str | None], labels: np.ndarray, least: int = 5) -> Model:
    """Train on three rows of four, calibrate on the fourth."""
    block = Block()
    for row in zip(texts, lang, labels, strict=True):
        block.add(*row)
    return fit_block(next(block.row().itertuples()), least)


def fit_block(row, least: int = 5) -> Model:
    """What :func:`fit_rows` does, from a coded block that holds all rows."""
    coded, parts, labels, lang = _decoded(row)
    if not len(labels) or labels.min() == labels.max():
        return _constant(len(labels), labels.sum())
    check = checked(len(labels))
    if labels[~check].min() == labels[~check].max():
        check[:] = False
    model = train([c for c, out in zip(coded, check, strict=True) if not out], parts, labels[~check])
    model.languages = _profiles(_counts(coded, parts, lang))
    on = check if labels[check].sum() >= least else np.ones_like(check)
    y = labels[on]
    p, guessed = judged(model, [c for c, out in zip(coded, on, strict=True) if out], parts)
    everywhere = best_threshold(p, y)
    model.thresholds = np.array([
        best_threshold(p[guessed == k], y[guessed == k]) if y[guessed == k].sum() >= least else everywhere
        for k in range(model.languages.shape[1])
    ] + [everywhere])
    return model


# What blocks learn is added up as whole numbers of 2^-18, so that the sum does not depend on the order.
UNIT = 2.0**18
SLICES, TASKS, BLOCKS_A_TASK = 64, 256, 2
SUMS = "name string, slice int, at binary, size int, sums binary"


def _packed(sums: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in few bytes, and how many bytes each takes: the first byte of all, the second and so on, packed."""
    size = 4 if np.abs(sums).max(initial=0) < 2**31 else 8
    return size, zlib.compress(sums.astype(f"<i{size}").view(np.uint8).reshape(-1, size).T.tobytes(), 1)


def _unpacked(size: int, packed: bytes) -> np.ndarray:
    found = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(size, -1).T
    return np.ascontiguousarray(found).view(f"<i{size}").ravel()


def _sliced(name: str, index: np.ndarray, sums: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows of sums by index, cut into slices that different tasks add up."""
    slices = index * SLICES // (ROWS + 1)
    for k in np.unique(slices):
        some = slices == k
        size, packed = _packed(sums[some])
        yield pd.DataFrame({"name": [name], "slice": [k], "at": [index[some].astype(np.int32).tobytes()], "size": [size], "sums": [packed]})


def _unsliced(row) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(row.at, np.int32)
    return at, _unpacked(row.size, row.sums).reshape(len(at), -1)


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    """The sums of all tasks for one slice."""
    found = [_unsliced(r) for r in rows.itertuples(index=False)]
    index = np.unique(np.concatenate([at for at, _ in found]))
    total = np.zeros((len(index), found[0][1].shape[1]), np.int64)
    for at, sums in found:
        total[np.searchsorted(index, at)] += sums
    size, packed = _packed(total)
    return pd.DataFrame({"name": rows["name"].iloc[:1], "slice": rows["slice"].iloc[:1], "at": [index.tobytes()], "size": [size], "sums": [packed]})


def _sum_up(blocks: DataFrame, task) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The sums by name that ``task`` makes of blocks: index and a row of numbers for each."""
    found: dict[str, list] = {}
    for r in blocks.mapInPandas(task, SUMS).groupBy("name", "slice").applyInPandas(_added, SUMS).collect():
        found.setdefault(r.name, []).append(_unsliced(r))
    return {name: (np.concatenate([at for at, _ in x]), np.concatenate([v for _, v in x])) for name, x in found.items()}


def _flat(arrays: dict[str, np.ndarray]) -> np.ndarray:
    """All weights but the hashed rows, one after the other."""
    return np.concatenate([v.ravel() for name, v in sorted(arrays.items()) if name != "table"])


def _arrays(model: Model) -> dict[str, np.ndarray]:
    return {
        "table": model.table, "out": model.out, "bias": np.array([model.bias], np.float32),
        **{f"kernel{k}": v for k, v in enumerate(model.kernels)}, **{f"shift{k}": v for k, v in enumerate(model.biases)},
    }


def _model_of(arrays: dict[str, np.ndarray]) -> Model:
    kernels, shifts = ([arrays[f"{name}{k}"] for k in range(len(WIDTHS))] for name in ("kernel", "shift"))
    return Model(arrays["table"], kernels, shifts, arrays["out"], float(arrays["bias"][0]))


def _steps(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    return np.rint((new.astype(np.float64) - old) * UNIT).astype(np.int64)


def _learn(batches: Iterator[pd.DataFrame], shared, epochs: range, toxic: float, all_rows: bool) -> Iterator[pd.DataFrame]:
    """What the blocks of a task change in a round of epochs that each begins with the shared weights, times the weight
    of the block, which grows with its texts, and the weights of the blocks that changed a row."""
    weights, sums = shared.value
    table = np.zeros((ROWS + 1, 2 * DIM + 1), np.int64)
    before, before_sums = _flat(weights), _flat(sums)
    rest = np.zeros((len(before), 3), np.int64)
    for batch in batches:
        for row in batch.itertuples():
            coded, parts, labels, _ = _decoded(row)
            learn = np.flatnonzero(~checked(len(labels)) | all_rows)
            model, rule = _model_of({k: v.copy() for k, v in weights.items()}), _Adagrad(RATE)
            rule.sums = {k: v.copy() for k, v in sums.items()}
            for epoch in epochs:
                order = learn[np.random.default_rng([1, row.block, row.part, epoch]).permutation(len(learn))]
                _epoch(model, rule, coded, parts, labels, _weights(labels, toxic), order)
            now, n = _arrays(model), 1 + len(learn) // 512
            at = np.flatnonzero((rule.sums["table"] != sums["table"]).any(1))
            table[at, :DIM] += n * _steps(now["table"][at], weights["table"][at])
            table[at, DIM:-1] += n * _steps(rule.sums["table"][at], sums["table"][at])
            table[at, -1] += n
            rest += n * np.stack([_steps(_flat(now), before), _steps(_flat(rule.sums), before_sums), np.ones(len(rest), np.int64)], 1)
    at = np.flatnonzero(table[:, -1])
    yield from _sliced("table", at, table[at])
    if rest[0, -1]:
        yield from _sliced("rest", np.arange(len(rest)), rest)


def _moved(arrays: dict[str, np.ndarray], found, first: int, last: int, which: int) -> dict[str, np.ndarray]:
    """The arrays after the mean change; columns ``first`` to ``last`` of the sums of hashed rows, ``which`` of the others."""
    new = {name: v.copy() for name, v in arrays.items()}
    if "table" in found:
        at, sums = found["table"]
        new["table"][at] += (sums[:, first:last] / (sums[:, -1:] * UNIT)).astype(np.float32)
    at, sums = found["rest"]
    change = np.zeros(len(_flat(arrays)))
    change[at] = sums[:, which] / (sums[:, -1] * UNIT)
    begin = 0
    for name in sorted(new):
        if name != "table":
            size = new[name].size
            new[name] += change[begin : begin + size].reshape(new[name].shape).astype(np.float32)
            begin += size
    return new


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often the words of each hashed row come in each language, in the blocks of a task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for row in batch.itertuples():
            coded, parts, _, lang = _decoded(row)
            for name, counts in _counts(coded, parts, lang).items():
                total[name] = total[name] + counts if name in total else counts
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        yield from _sliced(name, at, counts[at, None])


STEP = 1000  # steps of scores in a unit of their logit
STEPS = "guessed int, step int, n long, n_toxic long, low double, high double"


def _step_counts(batches: Iterator[pd.DataFrame], shared, all_rows: bool) -> Iterator[pd.DataFrame]:
    """Texts and toxic texts by guessed language and step of the score, with the least and greatest score of a step."""
    model = Model(**shared.value)
    for batch in batches:
        for row in batch.itertuples():
            coded, parts, labels, _ = _decoded(row)
            on = np.flatnonzero(checked(len(labels)) | all_rows)
            if len(on):
                p, guessed = judged(model, [coded[k] for k in on], parts)
                step = np.floor(logit(np.clip(p, 1e-9, 1 - 1e-9)) * STEP).astype(int)
                found = pd.DataFrame({"guessed": guessed, "step": step, "p": p, "y": labels[on].astype(int)}).groupby(["guessed", "step"])
                yield found.agg(n=("y", "size"), n_toxic=("y", "sum"), low=("p", "min"), high=("p", "max")).reset_index()


def step_threshold(steps: pd.DataFrame) -> float:
    """:func:`best_threshold` of texts that are counted by steps of their scores."""
    falling = steps.groupby("step").agg({"n": "sum", "n_toxic": "sum", "low": "min", "high": "max"}).iloc[::-1]
    f1 = 2 * falling.n_toxic.cumsum() / (falling.n.cumsum() + falling.n_toxic.sum())
    k = int(f1.to_numpy().argmax())
    below = falling.high.iloc[k + 1] if k + 1 < len(falling) else 0.0
    return float(np.clip(logit_mean(falling.low.iloc[k], below), 0.02, 0.98))


def fit_blocks(blocks: DataFrame, least: int = 5, epochs: int = EPOCHS) -> Model:
    """What :func:`fit_block` does, from many coded blocks: in a round of epochs each begins with the same weights, and
    their mean change, by size, is taken; of a hashed row by the blocks that changed it."""
    context = blocks.sparkSession.sparkContext
    blocks = blocks.coalesce(min(TASKS, -(-blocks.count() // BLOCKS_A_TASK)))
    n, toxic, learn, learn_toxic = blocks.selectExpr("sum(n)", "sum(n_toxic)", "sum(learn)", "sum(learn_toxic)").first()
    if toxic in (0, n):
        return _constant(n, toxic)
    all_rows = learn_toxic in (0, learn)
    share = toxic / n if all_rows else learn_toxic / learn
    weights = _arrays(_begun()[0])
    sums = {name: np.full_like(v, 1e-3) for name, v in weights.items()}
    for first in range(0, epochs, EPOCHS_A_ROUND):
        shared = context.broadcast((weights, sums))
        some = range(first, min(first + EPOCHS_A_ROUND, epochs))
        found = _sum_up(blocks, partial(_learn, shared=shared, epochs=some, toxic=share, all_rows=all_rows))
        weights, sums = _moved(weights, found, 0, DIM, 0), _moved(sums, found, DIM, 2 * DIM, 1)
        shared.destroy()
    model = _model_of(weights)
    counts = {}
    for name, (at, some) in _sum_up(blocks, _count).items():
        counts[name] = np.zeros(ROWS + 1, np.int64)
        counts[name][at] = some[:, 0]
    model.languages = _profiles(counts)
    on_all = all_rows or toxic - learn_toxic < least
    shared = context.broadcast(vars(model))
    steps = blocks.mapInPandas(partial(_step_counts, shared=shared, all_rows=on_all), STEPS).groupBy("guessed", "step").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_toxic")], F.min("low").alias("low"), F.max("high").alias("high")
    ).toPandas()
    shared.destroy()
    everywhere = step_threshold(steps)
    some = [steps[steps.guessed == k] for k in range(model.languages.shape[1])]
    model.thresholds = np.array([step_threshold(x) if x.n_toxic.sum() >= least else everywhere for x in some] + [everywhere])
    return model


def likely(rows: DataFrame, others: DataFrame, n_others: int, most: int = 1 << 29) -> DataFrame:
    """The rows whose ``key`` is among those of the ``others`` and a few more: the keys of the others are marked in a
    bitmap of eight bits for each, at most ``most``, which is broadcast."""
    size = min(max(8 * n_others, 1 << 15), most)
    place = F.pmod(F.xxhash64("key", F.lit(43)), F.lit(size))
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    marked = others.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", bucket).join(F.broadcast(marked), "_bucket")
    return found.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def fit(
    docs: DataFrame, labels: DataFrame, per_class: int | None = None, max_chars: int | None = None, rows: int = 4096
) -> Model:
    """Model learnt from all labelled texts, each as a whole.

    ``docs`` has ``doc_id``, ``text`` and ``lang``, ``labels`` has ``doc_id`` and ``toxic``.
    Rows with a null id, text or label teach nothing; without both classes the model gives a
    constant. Rows of equal id, text and label count once. Ids are dealt by a hash into blocks of about ``rows``; a
    single block is trained in one task as by :func:`fit_rows`, more of them by :func:`fit_blocks`, each in the
    memory of one block. ``per_class`` learns from a sample of at most so many texts of each class, one for each id,
    and ``max_chars`` from a stretch of that length of a text that is longer.
    """
    text_batches(docs.sparkSession)
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    if per_class is None:
        text = F.col("text") if max_chars is None else stretch(F.col("text"), max_chars)
        given = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", text.alias("text"), "lang")
    else:
        parts = [
            bounded_sample(docs, usable.where(F.col("toxic") == value), ["text", "lang"], per_class, max_chars).withColumn("toxic", F.lit(value))
            for value in (0, 1)
        ]
        given = stored(parts[0].unionByName(parts[1]), "toxicity-sample")
        given, usable = given.select("doc_id", "text", "lang"), given.select("doc_id", "toxic")
    key, n_labels = F.col("doc_id").cast("string"), usable.count()
    n_blocks = max(1, -(-n_labels // rows))
    given = given.select(key.alias("key"), F.lit(None).cast("int").alias("toxic"), "text", "lang")
    marks = usable.select(key.alias("key"), F.col("toxic").cast("int"), *[F.lit(None).cast("string").alias(c) for c in ("text", "lang")])
    # One shuffle brings together texts and labels, and only texts that may have a label.
    both = likely(given, marks, n_labels).unionByName(marks)
    dealt = both.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"), F.crc32("key").alias("place"), "*")
    order = ["block", "place", "key", F.col("toxic").asc_nulls_last(), "text", F.col("lang").asc_nulls_last()]
    placed = (dealt.repartition(1) if n_blocks == 1 else dealt.repartition("block")).sortWithinPartitions(*order)
    coded = placed.mapInPandas(partial(_code, most=WORDS_A_BLOCK), CODED)
    # Few blocks a file and as they are: Spark reads a file's rows at once and packs files by their size.
    blocks = stored(coded, "toxicity-blocks", maxRecordsPerFile=4, compression="uncompressed")
    if blocks.count() > 1:
        return fit_blocks(blocks)
    # The network is trained in a task: texts, word lists and gradients would stay in the driver's memory.
    found = blocks.mapInPandas(_fit_block, "model binary").collect()
    return Model(**pickle.loads(found[0].model)) if found else _constant(0, 0)


def _fit_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            yield pd.DataFrame({"model": [pickle.dumps(vars(fit_block(row)))]})


def toxicity_score(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """Score of the whole text, 0 to 1; a null counts as the empty text."""
    text_batches(spark)
    shared = spark.sparkContext.broadcast(vars(model))

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, here = Hasher(), Model(**shared.value)
        for batch in batches:
            yield pd.Series(scores(here, batch.tolist(), hasher))

    return score(F.coalesce(F.col(text), F.lit("")))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` of every row.

    Null and empty texts get the score of a text without words. Repeated rows are scored each,
    null ids stay null, other columns of ``docs`` are not read and an empty table gives none.
    """
    scored = docs.select("doc_id", toxicity_score(docs.sparkSession, model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below ``CUT``, with all their columns."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, toxicity_score(docs.sparkSession, model)).where(F.col(name) < CUT).drop(name)


FOLDS, HELD_OUT = 4, 2


def fit_tables(docs: DataFrame, labels: DataFrame) -> Model:
    """Model learnt from the labels outside the held-out fold."""
    return fit(docs, labels.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_tables(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", "predicted"
    )
