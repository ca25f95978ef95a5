"""Byte-level BPE encoding and decoding.

Each match of the split pattern is encoded by itself. A segment tree over its byte positions holds,
at every leaf, the rank of the pair that starts there (and the position, so that the minimum is the
leftmost one); each merge updates the leaves of the merged token, of its dead right half and of its
live left neighbour, and the nodes above them. Matches of up to ``WIDE`` bytes are merged many at a
time, a row of one array each; longer ones one at a time, in the same kind of tree.

Results for odd input: null text is empty text, which has no ids; a text of any length is encoded
whole; equal texts get equal ids; null and repeated keys are rows like others; an empty table gives no rows; other
columns of the input are not looked at. Ranks may be any below 2 ** 25.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_slices

#: Longest match, in bytes, that is merged together with others.
WIDE = 64
#: Matches whose ids a worker remembers; beyond it, it forgets them all.
REMEMBERED = 120_000
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of byte strings, and what a merge needs to know about pairs of them."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        # A pair's key holds both ranks: in 32 bits for vocabularies of up to 65,536 ranks, else in 64.
        self.half, self.wide = (16, np.uint32) if len(self.token) <= 1 << 16 else (32, np.uint64)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        get = self.ranks.get
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << self.half | b] = rank
        keys = np.fromiter(self.pairs, self.wide, len(self.pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.fromiter(self.pairs.values(), np.int32, len(self.pairs))[order]
        self.known: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens; NONE where there is no such token or one is dead (-1)."""
        key = left.astype(self.wide) << self.wide(self.half) | (right.astype(self.wide) & self.wide((1 << self.half) - 1))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def merge_many(self, words: list[bytes], leaves: int) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of words of at most ``leaves`` (a power of two) bytes."""
        n, shift = len(words), leaves.bit_length() - 1
        raw = np.frombuffer(b"".join(w.ljust(leaves, b"\0") for w in words), np.uint8).reshape(n, leaves)
        length = np.fromiter(map(len, words), np.int32, n)
        width = leaves + 1  # the last column stands for the end
        tokens = np.full((n, width), -1, np.int32)
        column = np.arange(leaves, dtype=np.int32)
        tokens[:, :leaves] = np.where(column < length[:, None], self.byte[raw], -1)
        after = np.broadcast_to(np.minimum(np.arange(1, width + 1, dtype=np.int32), leaves), (n, width)).copy()
        ahead = np.broadcast_to(np.arange(-1, leaves, dtype=np.int32), (n, width)).copy()
        tree = np.full((n, 2 * leaves), NONE, np.int32)
        rank = self.pair_ranks(tokens[:, :leaves].ravel(), tokens[:, 1:].ravel()).reshape(n, leaves)
        tree[:, leaves:] = np.where(rank == NONE, NONE, (rank << shift) | column)
        level = leaves
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        flat, flat_tokens, flat_after, flat_ahead = tree.ravel(), tokens.ravel(), after.ravel(), ahead.ravel()

        def put(base: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
            node = position + leaves
            flat[base + node] = value
            for _ in range(shift):
                node >>= 1
                flat[base + node] = np.minimum(flat[base + 2 * node], flat[base + 2 * node + 1])

        rows = np.arange(n)
        while True:
            low = flat[rows * (2 * leaves) + 1]
            live = low != NONE
            rows, low = rows[live], low[live]
            if not len(rows):
                break
            base, cell = rows * (2 * leaves), rows * width
            at = low & (leaves - 1)
            dead = flat_after[cell + at]
            flat_tokens[cell + at] = low >> shift
            flat_tokens[cell + dead] = -1
            follow = flat_after[cell + dead]
            flat_after[cell + at] = follow
            flat_ahead[cell + follow] = at
            put(base, dead, NONE)
            rank = self.pair_ranks(low >> shift, flat_tokens[cell + follow])
            put(base, at, np.where(rank == NONE, NONE, (rank << shift) | at))
            has = at > 0
            if has.any():
                base, cell, at, low = base[has], cell[has], at[has], low[has]
                left = flat_ahead[cell + at]
                rank = self.pair_ranks(flat_tokens[cell + left], low >> shift)
                put(base, left, np.where(rank == NONE, NONE, (rank << shift) | left))
        kept = tokens[:, :leaves] >= 0
        ids = tokens[:, :leaves][kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_long(self, word: bytes) -> bytes:
        """The same for one word of any length, with Python integers."""
        n = len(word)
        leaves = 1 << max(1, (n - 1).bit_length())
        none, get = 1 << 62, self.pairs.get
        tokens = [int(x) for x in self.byte[np.frombuffer(word, np.uint8)]] + [-1]
        after, ahead = list(range(1, n + 1)) + [n], list(range(-1, n))
        tree = [none] * (2 * leaves)

        def leaf(i: int) -> int:
            rank = get(tokens[i] << self.half | tokens[after[i]]) if after[i] < n else None
            return none if rank is None else rank * leaves + i

        for i in range(n):
            tree[leaves + i] = leaf(i)
        for node in range(leaves - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = leaves + i
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                a = a if a < b else b
                if tree[node] == a:
                    break
                tree[node] = a
                node >>= 1

        while tree[1] != none:
            rank, at = divmod(tree[1], leaves)
            dead = after[at]
            tokens[at], tokens[dead] = rank, -1
            after[at] = after[dead]
            if after[at] < n:
                ahead[after[at]] = at
            put(dead, none)
            put(at, leaf(at))
            if ahead[at] >= 0:
                put(ahead[at], leaf(ahead[at]))
        return np.array([x for x in tokens[:n] if x >= 0], "<u4").tobytes()

    def learn(self, matches: set[str]) -> None:
        """Remember the ids of matches."""
        if len(self.known) + len(matches) > REMEMBERED:
            self.known.clear()
        groups: dict[int, tuple[list[str], list[bytes]]] = {}
        for match in matches:
            word = match.encode()
            whole = self.ranks.get(word)
            if whole is not None:
                self.known[match] = whole.to_bytes(4, "little")
            elif len(word) > WIDE:
                self.known[match] = self.merge_long(word)
            else:
                names, words = groups.setdefault(1 << max(1, (len(word) - 1).bit_length()), ([], []))
                names.append(match)
                words.append(word)
        for leaves, (names, words) in groups.items():
            self.known.update(zip(names, self.merge_many(words, leaves), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        new = set().union(*split)
        new.difference_update(self.known)
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.known.clear()
            new = set().union(*split)
        self.learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, s)) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_made: dict[str, Vocabulary] = {}


def vocabulary(data: bytes, pattern: str) -> Vocabulary:
    """One a worker process."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Vocabulary(data, pattern)
    return _made[key]


def bpe(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids binary, ids_sha256, decoded_sha256) of every row of ``docs``.

    ``rank_file`` (base64 and rank a line) is read once, on the driver, and broadcast: its size does
    not depend on the data. ``ids`` holds little-endian unsigned 32-bit integers, and is left out
    unless ``keep_ids``. No shuffle.
    """
    with open(rank_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(data.value, pattern)
        for batch in batches:
            for part in text_slices(batch, "_text"):
                ids = v.encode(part.column("_text").to_pylist())
                columns = {
                    "_key": part.column("_key"),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(v.decode(x)).hexdigest() for x in ids]),
                }
                if not keep_ids:
                    del columns["ids"]
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"_key {kind.simpleString()}, n_tokens long, " + "ids binary, " * keep_ids + "ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)
