"""Encoding with a public byte-level BPE vocabulary through a pair occurrence index.

All words of a batch that were not seen before are laid out in one array of symbols. An index maps each pair to all its
positions; the active ranks are taken in ascending order, each applied at all its positions at once, and the lists of the
pairs to the left and right of every merge are updated.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabularies lie, unless a caller says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that splits a text into words before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encoding a task remembers; beyond that it starts anew.
REMEMBERED = 200_000


def _byte_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable bytes as themselves, the others from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PairIndexBpe:
    """A vocabulary file (its merges give the ranks) and the batch encoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        letters = _byte_letters()
        self.first = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.words = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.flat = np.zeros(0, dtype=np.int32)
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        tok = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        n = len(tok)
        own = np.repeat(np.arange(len(words)), lens)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(lens) - 1
        nxt[last], prv[last - lens + 1] = -1, -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(pos: np.ndarray) -> None:
            if not len(pos):
                return
            rank = self._rank(tok[pos], tok[nxt[pos]])
            pos, rank = pos[rank >= 0], rank[rank >= 0]
            if not len(pos):
                return
            by = np.argsort(rank, kind="stable")
            pos, rank = pos[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, p in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(pos, cuts)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        note(np.flatnonzero(nxt >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            pos = pos[alive[pos] & (tok[pos] == a)]
            pos = pos[nxt[pos] >= 0]
            pos = pos[tok[nxt[pos]] == b]
            if not len(pos):
                continue
            if a == b and len(pos) > 1:  # in a run of one symbol every second pair, from the left
                pos = np.sort(pos)
                chained = np.concatenate(([False], nxt[pos[:-1]] == pos[1:]))
                at = np.arange(len(pos))
                head = np.maximum.accumulate(np.where(chained, 0, at))
                pos = pos[(at - head) % 2 == 0]
            gone = nxt[pos]
            tok[pos], alive[gone] = self.made[r], False
            after = nxt[gone]
            nxt[pos] = after
            prv[after[after >= 0]] = pos[after >= 0]
            before = prv[pos]
            note(np.unique(np.concatenate((before[before >= 0], pos[after >= 0]))))
        return tok[alive].astype(np.int32), np.bincount(own[alive], minlength=len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts among them; null and empty texts have none."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self._reset()
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.known))
        if new:
            ids, size = self._merge(new)
            base = len(self.known)
            self.known.update((w, base + i) for i, w in enumerate(new))
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, ids))
        known = self.known
        seq = np.fromiter((known[w] for ws in split for w in ws), dtype=np.int64, count=sum(map(len, split)))
        size = self.size[seq]
        ends = np.cumsum(size)
        at = np.repeat(self.start[seq] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        per_text = np.concatenate(([0], ends))[np.cumsum([0, *map(len, split)])]
        return self.flat[at], per_text


@lru_cache(2)
def encoder(path: str) -> PairIndexBpe:
    """One encoder per worker and vocabulary."""
    return PairIndexBpe(path)


#: Characters of a batch that are encoded at once.
BATCH_CHARS = 2_000_000


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of a batch of about BATCH_CHARS characters."""
    a = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total > BATCH_CHARS:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode_corpus(df: DataFrame, *, id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``id``, ids): the token ids of every row's text, without special tokens; their strings in a text are ordinary text.

    Null and empty texts have the empty list. Every row gives one row: repeated ids are not folded. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _parts(texts):
                ids, ends = bpe.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], [id, "ids"])

    rows = df.select(id, text)
    return rows.mapInArrow(run, f"`{id}` {dict(rows.dtypes)[id]}, ids array<int>")


def count_tokens(df: DataFrame, *, id: str, text: str, keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``id``, *``keep``, n_tokens): as ``encode_corpus``, but only the number of tokens."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in _parts(texts):
                _, ends = bpe.encode(texts[a:b])
                cols = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(ends), pa.int64())], [id, *keep, "n_tokens"])

    rows = df.select(id, *keep, text)
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in [id, *keep]) + ", n_tokens long")
