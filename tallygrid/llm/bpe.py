"""Byte-pair encoding and decoding with a given vocabulary.

Within a word the ranks of adjacent pairs are the leaves of a segment tree whose nodes keep the
least rank of their two children, ties going to the left. The root names the leftmost pair of
lowest rank; it is merged, the pairs next to it are updated on their way to the root, and this
goes on until no pair can be merged. Words of similar length share arrays of trees, so a merge
step works on all of them at once; a word is encoded once and then looked up.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallygrid.llm.common import groups_by_size, table, text_batches

NONE = np.int64(1) << 60  # the rank of a pair that cannot be merged
END = "</w>"
SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [], 256
    for byte in range(256):
        out.append(chr(byte) if byte in plain else chr(extra))
        extra += byte not in plain
    return out


class Merger:
    """Merges the letters of words by the ranks of pairs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab, letters = vocab, byte_letters()
        self.inside = np.array([vocab[x] for x in letters], np.int64)
        self.ending = np.array([vocab[x + END] for x in letters], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; a letter below 0 stands for the end of the word."""
        key = a << 32 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.ranks[at], NONE)

    def encode(self, words: list[bytes], most: int = 1 << 18) -> list[bytes]:
        """Token ids of every word; groups of one width hold about ``most`` letters at once."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        widths = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            step = max(1, most // int(width))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for k, ids in zip(part, self._group([words[k] for k in part], int(width)), strict=True):
                    out[k] = ids
        return out

    def _group(self, words: list[bytes], width: int) -> list[bytes]:
        count = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(count, width)
        sizes = np.array([len(w) for w in words])
        token = np.where(np.arange(width) < sizes[:, None], self.inside[raw], -1)
        lines = np.arange(count)
        some = sizes > 0
        token[lines[some], sizes[some] - 1] = self.ending[raw[lines[some], sizes[some] - 1]]
        # Neighbours are kept as a linked list: after[k] is the next letter that is left, width at the end.
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (count, 1))
        ahead = np.tile(np.arange(-1, width - 1, dtype=np.int32), (count, 1))
        # Nodes hold the rank and, in the low bits, the place of the pair: the least is the leftmost lowest.
        bits = width.bit_length()
        tree = np.empty((count, 2 * width), np.int64)
        following = np.concatenate([token[:, 1:], np.full((count, 1), -1)], 1)
        tree[:, width:] = self._leaf(token, following, np.arange(width), bits)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        tree[:, 0] = NONE
        lines = np.flatnonzero(tree[:, 1] != NONE)
        while len(lines):
            root = tree[lines, 1]
            at, rank = (root & ((1 << bits) - 1)).astype(np.int64), root >> bits
            gone = after[lines, at].astype(np.int64)
            token[lines, at] = self.made[rank]
            token[lines, gone] = -1
            then = after[lines, gone].astype(np.int64)
            after[lines, at] = then
            inner = then < width
            ahead[lines[inner], then[inner]] = at[inner]
            next_token = np.full(len(lines), -1, np.int64)
            next_token[inner] = token[lines[inner], then[inner]]
            self._put(tree, lines, gone, np.full(len(lines), NONE), width)
            self._put(tree, lines, at, self._leaf(token[lines, at], next_token, at, bits), width)
            left = ahead[lines, at].astype(np.int64)
            has = left >= 0
            self._put(tree, lines[has], left[has], self._leaf(token[lines[has], left[has]], token[lines[has], at[has]], left[has], bits), width)
            lines = lines[tree[lines, 1] != NONE]
        keep = token >= 0
        flat, ends = token[keep].astype("<u4").tobytes(), (4 * np.cumsum(keep.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _leaf(self, a, b, place, bits):
        rank = self.rank(a, b)
        return np.where(rank == NONE, NONE, rank << bits | place)

    @staticmethod
    def _put(tree, lines, place, value, width):
        """Set leaves and renew their ancestors, one level after the other."""
        node = width + place
        tree[lines, node] = value
        while width > 1:
            node, width = node >> 1, width >> 1
            tree[lines, node] = np.minimum(tree[lines, 2 * node], tree[lines, 2 * node + 1])


class Tokenizer:
    """Encoder and decoder of one vocabulary file.

    The words of a text never reach across white space, so ids and decoded text are remembered
    for up to ``most`` different stretches without white space.
    """

    def __init__(self, spec: dict, most: int = 300_000):
        model = spec["model"]
        vocab = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merger, self.most = Merger(vocab, merges), most
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**vocab, **self.special}.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)))
        self._forget()

    def _forget(self) -> None:
        # A special token is kept under a name with a leading blank, which no stretch has.
        self.ids = {" " + t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        self.texts = {" " + t: t for t in self.special}

    def _remember(self, stretches: set[str]) -> None:
        fresh = list(stretches.difference(self.ids))
        cut = [self.words.findall(x) for x in fresh]
        words = list(set().union(*cut))
        known = dict(zip(words, self.merger.encode([w.encode("utf-8") for w in words]), strict=True))
        names = self.names
        for stretch, parts in zip(fresh, cut, strict=True):
            ids = known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts])
            self.ids[stretch] = ids
            self.texts[stretch] = " ".join([names[i] for i in memoryview(ids).cast("I")])

    def _cut(self, text: str) -> list[str]:
        """Stretches of the text, special tokens by themselves."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*self._plain(text[at : m.start()]), " " + m[0]]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # Every letter is lowered by itself, without the rule for a sigma at the end of a word.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if SEPARATORS.search(text):  # split() would take these for white space
            return self.words.findall(text.lower())
        return text.lower().split()

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For every text its ids as little-endian unsigned 32-bit integers and the decoded text:
        the tokens with one blank between them, as the file names no decoder."""
        if len(self.ids) > self.most:
            self._forget()
        cut = [self._cut(t) for t in texts]
        self._remember(set().union(*cut))
        ids, names = self.ids.__getitem__, self.texts.__getitem__
        return [(b"".join(map(ids, c)), " ".join(map(names, c))) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The text of any ids, token by token."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_spec(path: str) -> str:
    """Content of a vocabulary file on the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoded(
    spark: SparkSession, spec: str, text: str = "text", with_ids: bool = False, with_decoded: bool = False
) -> Column:
    """A struct of the whole text's ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked
    for, ``ids`` (little-endian unsigned 32-bit integers) and the ``decoded`` text.

    A null counts as the empty text, which has no tokens.
    """
    text_batches(spark)
    shared = spark.sparkContext.broadcast(spec)
    more = [x for x, wanted in (("ids binary", with_ids), ("decoded string", with_decoded)) if wanted]
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *[x.split()[0] for x in more]]

    @pandas_udf(", ".join(["n_tokens long, ids_sha256 string, decoded_sha256 string", *more]))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = Tokenizer(json.loads(shared.value))
        for batch in batches:
            for lo, hi in groups_by_size(batch.str.len().to_numpy(), 1_000_000):
                rows = []
                for ids, text in tokenizer.encode(batch.iloc[lo:hi].tolist()):
                    hashes = hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()
                    rows.append((len(ids) // 4, *hashes, *([ids] if with_ids else []), *([text] if with_decoded else [])))
                yield pd.DataFrame(rows, columns=names)

    return encode(F.coalesce(F.col(text), F.lit("")))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and the digests of ``encoded`` for every row; other columns are not read.

    Repeated rows come out each, null ids stay null and an empty table gives none.
    """
    spec = read_spec(path or tokenizer_file())
    return docs.select("doc_id", encoded(docs.sparkSession, spec).alias("_x")).select("doc_id", "_x.*")


def with_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``n_tokens``, ``ids`` and both digests of every row."""
    spec = read_spec(path or tokenizer_file())
    x = encoded(docs.sparkSession, spec, with_ids=True).alias("_x")
    return docs.select("doc_id", "text", x).select("doc_id", "text", "_x.*")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
