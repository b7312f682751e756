"""Language of documents by a linear-chain conditional random field over their words.

Each word gets weights for every language from hashed features: its n-grams with the borders of
the word, which include its affixes, longer beginnings and endings, and the word itself as a
lexicon entry. Learnt transitions tie neighbouring words, and forward-backward gives the
probability of every language at every word of code-switched text. A document has the language
with the largest share of these probabilities.

Neighbouring words that are likeliest of one language make a run; runs, the language of the document and its
share come from the same pass.

The field is trained in numpy on a bounded sample. Training sequences are spliced from stretches
of documents in different languages, so that transitions are learnt, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallygrid.llm.common import fold, groups_by_size, held_out, one_text_each, table, text_batches
from tallygrid.session import stored

ROWS = 1 << 16
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")  # letters by their category, with the marks on them
UNKNOWN = "und"
NGRAMS, AFFIXES = (2, 3), (4, 5)


@dataclass
class Field:
    """Languages, weights of hashed features, and log weights of starts and transitions."""

    languages: list[str]
    weights: np.ndarray  # ROWS x languages
    starts: np.ndarray
    moves: np.ndarray


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of all features of the words, one word after the other, and where each begins."""
    text = "".join([f"\x02{w}\x03" for w in words])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    prime = np.uint64(0x9E3779B97F4A7C15)
    owners, rows = [], []
    owner = np.repeat(np.arange(len(words)), sizes)
    left = sizes[owner] - (np.arange(len(code)) - begin[owner])  # letters up to the end of the word
    rolling, width = code * prime, 1
    whole = np.zeros(len(words), np.uint64)
    for n in range(2, int(max(max(NGRAMS), max(AFFIXES)) + 1)):
        moved = np.zeros_like(rolling)
        moved[: -(n - 1) or None] = code[n - 1 :]
        rolling, width = (rolling ^ (moved + np.uint64(n))) * prime, n
        if n in NGRAMS:
            at = np.flatnonzero(left >= n)
        else:  # only the beginning and the ending of that length
            first, last = begin[sizes >= n], (begin + sizes - n)[sizes >= n]
            at = np.unique(np.concatenate([first, last]))
        owners.append(owner[at])
        rows.append(rolling[at])
    mixed = (code + np.uint64(7)) * prime
    mixed ^= mixed >> np.uint64(29)
    place = (np.arange(len(code)) - begin[owner]).astype(np.uint64)
    spread = mixed * (place * np.uint64(2) + np.uint64(1)) * prime
    whole = np.add.reduceat(spread, begin) if len(words) else whole
    owners.append(np.arange(len(words)))
    rows.append(whole * prime)
    who, what = np.concatenate(owners), np.concatenate(rows)
    what = ((what ^ (what >> np.uint64(31))) * prime >> np.uint64(48)).astype(np.int64) % ROWS
    order = np.argsort(who, kind="stable")
    counts = np.bincount(who, minlength=len(words))
    return what[order], np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)


def _grouped(lengths: np.ndarray, cells: int = 400_000) -> Iterator[np.ndarray]:
    """Rows by falling length, in groups that fill an array of about ``cells``."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        n = max(1, cells // int(lengths[order[at]]))
        yield order[at : at + n]
        at += n


def _laid(emission: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Emissions by place and sequence; places beyond the end are 0."""
    out = np.zeros((int(lengths[0]), len(lengths), emission.shape[1]), np.float32)
    place = np.concatenate([np.arange(n) for n in lengths])
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[place, row] = emission[np.repeat(begin, lengths) + place]
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, starts, moves, each: bool = False, places: bool = False):
    """Sums over all places of the probabilities of each language, and of each transition.

    ``scores`` (place x sequence x language) are log weights, sequences fall in length. With
    ``places`` the probabilities at every place come too, with ``each`` also the transitions.
    """
    e = np.exp(scores - scores.max(2, keepdims=True))
    step, first = np.exp(moves).astype(np.float32), np.exp(starts).astype(np.float32)
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, len(e) + 1))
    alpha = np.empty_like(e)
    alpha[0] = e[0] * first
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, len(e)):
        n = alive[t]
        a = (alpha[t - 1, :n] @ step) * e[t, :n]
        a /= a.sum(1, keepdims=True)
        alpha[t, :n] = a
    total = np.zeros(e.shape[1:], np.float64)
    pairs = np.zeros_like(step, np.float64)
    every = np.zeros_like(e) if each or places else None
    beta = np.ones(e.shape[1:], np.float32)
    for t in range(len(e) - 1, -1, -1):
        n = alive[t]
        g = alpha[t, :n] * beta[:n]
        g /= g.sum(1, keepdims=True)
        total[:n] += g
        if every is not None:
            every[t, :n] = g
        if t:
            onward = e[t, :n] * beta[:n]
            if each:
                x = alpha[t - 1, :n, :, None] * step * onward[:, None, :]
                pairs += (x / x.sum((1, 2), keepdims=True)).sum(0)
            b = onward @ step.T
            beta[:n] = b / b.sum(1, keepdims=True)
    return total, pairs, every


def _words_of(texts: list[str]) -> list[list[str]]:
    return [[w.lower() for w in WORDS.findall(t)] for t in texts]


def _numbered(words: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """Different words, and the number of every word of all texts."""
    seen: dict[str, int] = {}
    for w in words:
        for x in set(w).difference(seen):
            seen[x] = len(seen)
    count = sum(map(len, words))
    return list(seen), np.fromiter((n for w in words for n in map(seen.__getitem__, w)), np.int64, count)


def emissions(field: Field, words: list[str], most: int = 100_000) -> np.ndarray:
    """Log weight of each language for each different word."""
    out = np.zeros((len(words), len(field.languages)), np.float32)
    for at in range(0, len(words), most):
        rows, begin = features(words[at : at + most])
        out[at : at + most] = np.add.reduceat(field.weights[rows], begin)
    return out


def shares(field: Field, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Share of each language in each text, and the number of its words."""
    return labelled(field, _words_of(texts))[:2]


def labelled(field: Field, words: list[list[str]], places: bool = False):
    """Share of each language in each list of words, the number of words and, with ``places``, of each word the
    likeliest language and its probability, one list after the other."""
    lengths = np.array([len(w) for w in words], np.int64)
    out, count = np.zeros((len(words), len(field.languages))), int(lengths.sum())
    best, sure = np.zeros(count if places else 0, np.int64), np.zeros(count if places else 0, np.float32)
    if count and field.languages:
        different, numbers = _numbered(words)
        emission = emissions(field, different)
        ends = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for rows in _grouped(lengths):
            n = lengths[rows]
            place = np.concatenate([ends[r] + np.arange(lengths[r]) for r in rows])
            laid = _laid(emission[numbers[place]], np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            total, _, every = forward_backward(laid, n, field.starts, field.moves, places=places)
            out[rows] = total / n[:, None]
            if places:
                at = np.concatenate([np.arange(x) for x in n]), np.repeat(np.arange(len(n)), n)
                best[place], sure[place] = every[at].argmax(1), every[at].max(1)
    return out, lengths, best, sure


def runs_of(field: Field, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """``shares`` and, for each text, its runs of words of one language: ``start`` and ``end`` (code points,
    the end not included), ``language`` and ``probability`` (mean over its words)."""
    found = [[(m.start(), m.end(), m[0].lower()) for m in WORDS.finditer(t)] for t in texts]
    share, lengths, best, sure = labelled(field, [[w for _, _, w in line] for line in found], places=True)
    out, ends = [], np.concatenate([[0], np.cumsum(lengths)])
    for line, a, b in zip(found, ends[:-1], ends[1:], strict=True):
        label, p = best[a:b], sure[a:b]
        begin = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if b > a and field.languages else []
        out.append([
            {"start": line[i][0], "end": line[j - 1][1], "language": field.languages[label[i]], "probability": float(p[i:j].mean())}
            for i, j in zip(begin, [*begin[1:], b - a], strict=True)
        ] if len(begin) else [])
    return share, lengths, out


def train(texts: list[str], langs: list[str], per_language: int = 375, epochs: int = 4, seed: int = 3) -> Field:
    """Fit by stochastic gradients of the conditional likelihood of spliced sequences, ``per_language`` for each language."""
    names = sorted(set(langs))
    field = Field(names, np.zeros((ROWS, len(names)), np.float32), np.zeros(len(names), np.float32),
                  np.zeros((len(names), len(names)), np.float32))
    words = _words_of(texts)
    by_language = [[w for w, x in zip(words, langs, strict=True) if x == name and w] for name in names]
    usable = [k for k, group in enumerate(by_language) if group]
    if len(usable) < 2:
        return field
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(per_language * len(names)):
        line, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            k = usable[rng.integers(len(usable))]
            doc = by_language[k][rng.integers(len(by_language[k]))]
            at = int(rng.integers(max(1, len(doc) - 10)))
            part = doc[at : at + int(rng.integers(5, 40))]
            line += part
            labels += [k] * len(part)
        made.append((line, np.array(labels)))
    sums = [np.full(field.weights.shape, 1e-2, np.float32), np.full(field.starts.shape, 1e-2), np.full(field.moves.shape, 1e-2)]
    for _ in range(epochs):
        order = rng.permutation(len(made))
        for at in range(0, len(order), 50):
            _step(field, [made[k] for k in order[at : at + 50]], sums)
    return field


def _step(field: Field, batch, sums, rate: float = 0.1) -> None:
    batch = sorted(batch, key=lambda x: -len(x[0]))
    lengths = np.array([len(x[0]) for x in batch])
    different, numbers = _numbered([x[0] for x in batch])
    rows, begin = features(different)
    emission = np.add.reduceat(field.weights[rows], begin)
    ends = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    laid = _laid(emission[numbers], ends, lengths)
    _, pairs, every = forward_backward(laid, lengths, field.starts, field.moves, each=True)
    size = len(field.languages)
    change, first, moves = np.zeros((len(different), size)), np.zeros(size), pairs
    for k, (line, labels) in enumerate(batch):
        g = every[: len(line), k].astype(np.float64)
        first += g[0]
        first[labels[0]] -= 1
        np.subtract.at(moves, (labels[:-1], labels[1:]), 1)
        g[np.arange(len(line)), labels] -= 1
        np.add.at(change, numbers[ends[k] : ends[k] + len(line)], g)
    counts = np.diff(np.concatenate([begin, [len(rows)]]))
    hit, where = np.unique(rows, return_inverse=True)
    total = np.zeros((len(hit), size), np.float32)
    np.add.at(total, where, np.repeat(change, counts, axis=0).astype(np.float32))
    for value, gradient, square, at in (
        (field.weights, total / len(batch), sums[0], hit),
        (field.starts, first / len(batch), sums[1], slice(None)),
        (field.moves, moves / len(batch), sums[2], slice(None)),
    ):
        square[at] += gradient**2
        value[at] -= rate * gradient / np.sqrt(square[at])


def fit(docs: DataFrame, per_language: int = 300, max_chars: int = 20_000) -> Field:
    """Field learnt from at most ``per_language`` documents of each language.

    Rows with a null id, text or language teach nothing. The ids of a language are drawn in the order of a hash,
    one row for each, whatever the length of the texts; of a text over ``max_chars`` a stretch of that length is
    taken. So the driver gets ``per_language * max_chars`` characters for each language at most, and a model of a
    column for each; a table of very many languages is not meant.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id")
    ids = rows.select("lang", "doc_id").distinct().withColumn("_rank", F.row_number().over(order))
    chosen = stored(ids.where(f"_rank <= {per_language}").select("lang", "doc_id"), "language-sample")
    sample = one_text_each(rows, chosen, ["lang", "doc_id"], ["text"], max_chars).collect()
    if not sample:
        return Field([], np.zeros((ROWS, 0), np.float32), np.zeros(0, np.float32), np.zeros((0, 0), np.float32))
    sample.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return train([r.text for r in sample], [r.lang for r in sample])


def language(spark: SparkSession, field: Field, text: str = "text", with_runs: bool = False) -> Column:
    """Struct of ``lang_pred`` and ``score`` of the whole text: ``und`` and 0 without letters,
    else the language with the largest share and that share; equal shares go by the alphabet.

    With ``with_runs`` also ``runs``, see :func:`runs_of`.
    """
    text_batches(spark)
    shared = spark.sparkContext.broadcast(vars(field))
    kinds = "lang_pred string, score double"
    runs_kind = ", runs array<struct<start int, end int, language string, probability double>>"

    @pandas_udf(kinds + runs_kind * with_runs)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        here = Field(**shared.value)
        names = np.array([*here.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = batch.tolist()
            for lo, hi in groups_by_size(np.array([len(t) for t in texts]), 4_000_000):
                if with_runs:
                    share, words, runs = runs_of(here, texts[lo:hi])
                else:
                    (share, words), runs = shares(here, texts[lo:hi]), None
                known = (words > 0) & bool(here.languages)
                best = share.argmax(1) if here.languages else np.zeros(hi - lo, np.int64)
                score = np.where(known, np.clip(share.max(1), 0, 1), 0.0) if here.languages else np.zeros(hi - lo)
                found = pd.DataFrame({"lang_pred": names[np.where(known, best, len(names) - 1)], "score": score})
                yield found.assign(runs=runs) if with_runs else found

    return predict(F.coalesce(F.col(text), F.lit("")))


def label_runs(docs: DataFrame, field: Field) -> DataFrame:
    """A row for each run of words of one language: ``doc_id``, ``start``, ``end``, ``language`` and ``probability``.

    A text without letters has none. Repeated rows come out each, null ids stay null.
    """
    found = docs.select("doc_id", language(docs.sparkSession, field, with_runs=True).alias("_x"))
    return found.select("doc_id", F.inline("_x.runs"))


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row; only id and text are read.

    Repeated rows come out each, null ids stay null and an empty table gives none.
    """
    return docs.select("doc_id", language(docs.sparkSession, field).alias("_x")).select("doc_id", "_x.*")


FOLDS, HELD_OUT = 3, 1


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = fit(docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    return identify(docs, field).withColumn("held_out", held_out(F.col("doc_id"), FOLDS, HELD_OUT))
