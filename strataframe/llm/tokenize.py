"""Encoding of texts with a byte-level BPE vocabulary, by batched merge rounds in numpy.

Each task keeps the words it has met. The new words of a batch lie in one flat array of symbols; a round looks up every
neighbouring pair by binary search over the sorted pair keys of the vocabulary, finds each word's lowest rank, merges all
pairs of that rank, left to right, and drops the words that are done. Ids are gathered from the words' stored symbols by
index arithmetic, and leave as Arrow lists, so no Python object is made per token.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the pattern that splits text before the merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: words a task remembers before it starts anew, and the longest it remembers, in characters
MAX_WORDS, MAX_WORD = 1_000_000, 200
#: symbols held before all words are forgotten, as long ones leave theirs behind
MAX_SYMBOLS = 16_000_000
_NONE = np.int64(2**62)


class ByteBpe:
    """A rank file: every token in base64 and its rank, which is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = 1 + max(ranks.values())
        keys, ids = [], []
        for token, rank in ranks.items():
            # a token's last merge joins the pieces that the lower ranks leave of it
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank) if parts[i] + parts[i + 1] != token else rank)
                if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2:
                keys.append(ranks[parts[0]] * self.size + ranks[parts[1]])
                ids.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ids = np.array(keys, np.int64)[order], np.array(ids, np.int64)[order]
        self.split = regex.compile(PATTERN)
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.lengths, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ids[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in one array, number of ids of each word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        position = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            ranks = np.full(len(symbols), _NONE)
            same = owner[:-1] == owner[1:]
            ranks[:-1][same] = self._ranks(symbols[:-1][same], symbols[1:][same])
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(ranks, first)
            lengths = np.diff(np.append(first, len(symbols)))
            active = np.repeat(lowest < _NONE, lengths)
            if not active.all():
                done.append((position[~active], symbols[~active]))
            hit = active & (ranks == np.repeat(lowest, lengths))
            # of pairs that overlap, as in `aaa`, every second one, from the left
            run_start = hit & ~np.concatenate([[False], hit[:-1]])
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run_start, np.arange(len(hit)), 0))
            take = hit & (nth % 2 == 0)
            symbols = np.where(take, ranks, symbols)
            keep = active & ~np.concatenate([[False], take[:-1]])
            symbols, owner, position = symbols[keep], owner[keep], position[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        at = np.concatenate([p for p, _ in done])
        order = np.argsort(at, kind="stable")
        ids = np.concatenate([s for _, s in done])[order].astype(np.int32)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(np.searchsorted(at[order], edges))

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        n = len(self.index)
        while n + len(words) > len(self.starts):
            self.starts, self.lengths = np.append(self.starts, np.zeros_like(self.starts)), np.append(self.lengths, np.zeros_like(self.lengths))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.starts[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.lengths[n : n + len(words)] = counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        for i, w in enumerate(words):
            self.index[w] = n + i

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                before = len(words)
                words += self.split.findall(t)
                counts[i] = len(words) - before
        if len(self.index) > MAX_WORDS or self.used > MAX_SYMBOLS:
            self._reset()
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self._learn(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)), counts, [w for w in new if len(w) > MAX_WORD]

    def _forget(self, long: list[str]) -> None:
        for w in long:  # their symbols stay until the next reset
            at = self.index.pop(w)
            self.index[f"\0{at}\0"] = at  # keeps the numbering; no word looks like this

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, offsets of each text); none for null and empty texts."""
        at, counts, long = self._words(texts)
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        self._forget(long)
        return ids, edges

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        at, counts, long = self._words(texts)
        ends = np.concatenate([[0], np.cumsum(self.lengths[at])])
        self._forget(long)
        return np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def vocabulary_path(spark) -> str:
    """Where executors find the rank file: `spark.strataframe.vocabulary`, else the environment, else the installed ones."""
    path = spark.conf.get("spark.strataframe.vocabulary", os.environ.get("STRATAFRAME_VOCABULARY"))
    if path is None and not os.path.exists(DEFAULT_VOCABULARY):
        try:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        except ImportError:
            pass
    return path or DEFAULT_VOCABULARY


#: characters handled at once by a task
SLICE = 4_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE and i > a:
            yield a, i
            a, size = i, len(t or "")
    yield a, len(texts)


def encode(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row; an empty list for null and empty texts. Repeated rows stay.

    Texts are encoded whole, however long; ordinary text that looks like a special token is ordinary text. Extra columns
    are dropped. One narrow stage without a shuffle.
    """
    schema = docs.select(F.col(f"`{key}`")).schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in _slices(texts):
                ids, edges = bpe.encode(texts[i:j])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], names=[key, "ids"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def token_counts(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, size INT) of every row: the number of its tokens, 0 for null and empty texts."""
    schema = docs.select(F.col(f"`{key}`")).schema.add("size", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = np.concatenate([bpe.count(texts[i:j]) for i, j in _slices(texts)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32())], names=[key, "size"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)
