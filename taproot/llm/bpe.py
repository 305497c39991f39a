"""Byte-level BPE of whole corpora with a public vocabulary, in two tiers.

Tier one resolves every pre-token that is itself in the vocabulary through a minimal perfect hash.  Tier two merges the
bytes of the others with a heap of adjacent pairs over a linked list.  Both work on the distinct pre-tokens of a batch;
the ids of a text are then gathered by position.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Fixed by the vocabularies: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Folder of the vocabulary files; a parameter of every function that reads one.
FOLDER = os.environ.get("TAPROOT_TOKENIZERS", "/opt/tokenizers")
#: Characters split at once; bounds a worker's memory.
CHUNK = 2_000_000
#: Merged pre-tokens that a worker remembers.
REMEMBERED = 200_000

_MASK = (1 << 40) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace.

    Keys fall into buckets; from the largest bucket on, each gets the first displacement (a multiplier and an offset)
    that puts all its keys into free slots.  A bucket of one key stores its slot itself.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        self.shift = [0] * self.buckets
        held: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            bucket, a, b = self._parts(key)
            held.setdefault(bucket, []).append((i, a, b))
        slots, free = np.full(n, -1, np.int64), np.ones(n, bool)
        for bucket, members in sorted(held.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) > 1:
                times, offset = self._displacement(members, free)
                spots = [(a + times * b + offset) % n for _, a, b in members]
                self.shift[bucket] = times * n + offset
            else:
                spots = [int(free.argmax())]
                self.shift[bucket] = -1 - spots[0]
            free[spots] = False
            slots[spots] = [i for i, _, _ in members]
        self.slots = slots.tolist()

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h >> 80) % self.buckets, ((h >> 40) & _MASK) % self.n, (h & _MASK) % self.n

    def _displacement(self, members: list[tuple[int, int, int]], free: np.ndarray) -> tuple[int, int]:
        n = self.n
        for times in range(n):
            spots = [(a + times * b) % n for _, a, b in members]
            if len(set(spots)) < len(spots):
                continue
            for low in range(0, n, 1024):
                offsets = np.arange(low, min(n, low + 1024))
                fits = np.ones(len(offsets), bool)
                for x in spots:
                    fits &= free[(offsets + x) % n]
                if fits.any():
                    return times, low + int(fits.argmax())
        raise ValueError("two keys have the same hash")

    def __call__(self, key: bytes) -> int:
        """Position of ``key`` if it is a key; some position or -1 if it isn't."""
        bucket, a, b = self._parts(key)
        d = self.shift[bucket]
        return self.slots[-1 - d if d < 0 else (a + (d // self.n) * b + d) % self.n]


class Vocabulary:
    """Ranks of a rank file behind a perfect hash."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, lines)]
        self.tokens = [token for token, _ in pairs]
        self.ids = [rank for _, rank in pairs]
        self.hash = PerfectHash(self.tokens)

    def rank(self, token: bytes) -> int:
        """Id of a token, -1 if it is none."""
        at = self.hash(token)
        return self.ids[at] if at >= 0 and self.tokens[at] == token else -1

    def merge(self, word: bytes) -> list[int]:
        """Ids of bytes that are no token as a whole: lowest rank first, leftmost first among equals."""
        n = len(word)
        start, end = list(range(n)), list(range(1, n + 1))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := self.rank(word[i : i + 2])) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j] = False
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
                stop = end[after[i]]
                if (rank := self.rank(word[start[i] : stop])) >= 0:
                    heapq.heappush(heap, (rank, i, stop))
            if (h := before[i]) >= 0 and (rank := self.rank(word[start[h] : end[i]])) >= 0:
                heapq.heappush(heap, (rank, h, end[i]))
        return [self.rank(word[start[i] : end[i]]) for i in range(n) if alive[i]]


@functools.lru_cache(maxsize=4)
def vocabulary(name: str, folder: str | None = None) -> Vocabulary:
    return Vocabulary(os.path.join(folder or FOLDER, f"{name}.tiktoken"))


class Encoder:
    """Encodes lists of texts; remembers the merges of earlier batches up to a bound."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.split = regex.compile(PATTERN).findall
        self.merged: dict[str, list[int]] = {}

    def _of(self, piece: str) -> list[int]:
        word = piece.encode()
        if (rank := self.vocab.rank(word)) >= 0:
            return [rank]
        ids = self.merged.get(piece)
        if ids is None:
            ids = self.vocab.merge(word)
            if len(self.merged) >= REMEMBERED:
                self.merged.clear()
            if len(piece) < 100:
                self.merged[piece] = ids
        return ids

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        seen: dict[str, int] = {}
        codes: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = self.split(text)
            counts[i] = len(pieces)
            codes += [seen.setdefault(p, len(seen)) for p in pieces]
        ids = [self._of(p) for p in seen]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.fromiter((x for part in ids for x in part), np.int32, int(length.sum()))
        first = np.cumsum(length) - length
        code = np.asarray(codes, np.int64)
        sizes = length[code]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = pool[np.repeat(first[code] - (ends - sizes), sizes) + np.arange(total)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(edges)


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        if part and held + len(text or "") > CHUNK:
            yield part
            part, held = [], 0
        part.append(text or "")
        held += len(text or "")
    yield part


def encode(df: DataFrame, key: str, text: str, *, name: str = "byte_bpe_50k", folder: str | None = None, ids: str | None = "ids", count: str | None = None) -> DataFrame:
    """``key`` with the token ids of ``text`` and, or only, their number.

    No special tokens are added, and strings that look like them are ordinary text.  An empty text has the ids ``[]``
    and the count 0, a null text has nulls.  Rows are taken one by one: repeated rows stay repeated, other columns are
    dropped, an empty table gives an empty table.  The vocabulary (its size is fixed by its file) is broadcast.
    """
    # A worker gets the vocabulary from the driver, so only the driver needs the file.
    vocab = df.sparkSession.sparkContext.broadcast(vocabulary(name, folder))
    kept = [c for c in (ids, count) if c]
    if key in kept or len(set(kept)) != len(kept):
        raise ValueError("result columns clash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value)
        for batch in batches:
            texts = batch.column(1)
            missing = np.asarray(texts.is_null().to_numpy(zero_copy_only=False))
            parts = [encoder(chunk) for chunk in _chunks(texts.to_pylist())]
            sizes = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
            out = [batch.column(0)]
            if ids:
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.append(missing, False))
                out.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([flat for flat, _ in parts]))))
            if count:
                out.append(pa.array(sizes.astype(np.int32), mask=missing))
            yield pa.RecordBatch.from_arrays(out, names=[key, *kept])

    kind = dict(df.dtypes)[key]
    schema = ", ".join([f"`{key}` {kind}", *([f"`{ids}` array<int>"] if ids else []), *([f"`{count}` int"] if count else [])])
    return df.select(key, df[text].cast("string").alias("_text")).mapInArrow(run, schema)
