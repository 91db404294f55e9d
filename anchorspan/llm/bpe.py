"""Encoding of a whole corpus by a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern. Each distinct piece of a batch is encoded once: a segment tree over its
byte positions holds the rank of the pair that begins at each live position and, in its inner nodes, the least rank of
a range; the root gives the rank to merge, a descent to the left gives its leftmost place, and a merge is three point
updates (the merged position, its live neighbour before it, the one that vanished). Pieces of up to WIDE bytes are done
many at a time as arrays, longer ones one by one, in O(n log n) either way.

Defined results: a null or empty text gives an empty list; strings that look like special tokens are ordinary text;
other columns pass by unread; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from anchorspan.session import ship

#: Fixed value: the pattern that parts a text into the pieces within which pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII characters alone, where it is quicker to find.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: Bytes up to which pieces are encoded as arrays; longer ones have a tree of their own.
WIDE = 64
#: Distinct pieces that a worker remembers between batches, and characters of text that it works on at once.
REMEMBERED, SLICE = 300_000, 4_000_000
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of byte strings, and the merges that they imply as sorted arrays. Its size is fixed by the vocabulary file."""

    def __init__(self, ranks: dict[bytes, int]):
        if sorted(len(k) for k in ranks)[:256] != [1] * 256:
            raise ValueError("a byte-level vocabulary needs all 256 single bytes")
        self.ranks = ranks
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int32)
        self.pairs = pairs

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """From a rank file: a line is a base64 byte string, a blank and its rank."""
        with open(path, "rb") as f:
            return cls.from_bytes(f.read())

    @classmethod
    def from_bytes(cls, data: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of ids, NONE where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)


def encode_piece(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one piece, by a segment tree of its own."""
    n = len(piece)
    ids = vocabulary.bytes_to_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
    if n < 2:
        return ids
    get, none = vocabulary.pairs.get, int(NONE)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [none] * (2 * size)
    tree[size : size + n - 1] = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := tree[1]) != none:
        node = 1
        while node < size:
            node *= 2
            node += tree[node] != least
        at = node - size
        gone = after[at]
        beyond = after[gone]
        ids[at], ids[gone] = least, -1
        after[at] = beyond
        if beyond < n:
            before[beyond] = at
        changes = [(gone, none), (at, get(least << 32 | ids[beyond], none) if beyond < n else none)]
        if before[at] >= 0:
            changes.append((before[at], get(ids[before[at]] << 32 | least, none)))
        for place, rank in changes:
            if place >= size:
                continue
            node = size + place
            tree[node] = rank
            while node > 1:
                node //= 2
                new = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == new:
                    break
                tree[node] = new
    return [x for x in ids if x >= 0]


def encode_block(pieces: list[bytes], width: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after the other, count of each piece) of pieces of 2..width bytes, all trees side by side. width: a power of two."""
    n, levels = len(pieces), width.bit_length() - 1
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
    ids = np.full((n, width + 1), -1, dtype=np.int32)  # one more column: the neighbour of the last position
    live = np.arange(width) < lengths[:, None]
    ids[:, :width][live] = vocabulary.bytes_to_id[padded[live]]
    tree = np.full((n, 2 * width), NONE, dtype=np.int32)
    paired = live[:, 1:]
    tree[:, width : 2 * width - 1][paired] = vocabulary.rank_of(ids[:, : width - 1][paired], ids[:, 1:width][paired])
    for level in range(levels):
        low = width >> level
        tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
    after = np.tile(np.arange(1, width + 2), (n, 1))
    before = np.tile(np.arange(-1, width), (n, 1))
    after[np.arange(n), lengths - 1] = width  # the end of a piece
    flat_tree, flat_ids, flat_after, flat_before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        base, place_base = rows * (2 * width), rows * (width + 1)
        least = flat_tree[base + 1]
        node = np.ones(len(rows), dtype=np.int64)
        for _ in range(levels):
            node *= 2
            node += flat_tree[base + node] != least
        at = node - width
        gone = flat_after[place_base + at]
        beyond = flat_after[place_base + gone]
        prior = flat_before[place_base + at]
        flat_ids[place_base + at] = least
        flat_ids[place_base + gone] = -1
        flat_after[place_base + at] = beyond
        flat_before[place_base + beyond] = at
        right = flat_ids[place_base + beyond]
        with_right = np.where(right >= 0, vocabulary.rank_of(least, right), NONE)
        has_prior = prior >= 0
        safe_prior = np.where(has_prior, prior, at)
        with_left = np.where(has_prior, vocabulary.rank_of(flat_ids[place_base + safe_prior], least), with_right)
        nodes = (base + width + at, base + width + gone, base + width + safe_prior)
        flat_tree[nodes[0]] = with_right
        flat_tree[nodes[1]] = NONE
        flat_tree[nodes[2]] = with_left
        for spot in (at, gone, safe_prior):
            node = spot + width
            for _ in range(levels):
                node = node >> 1
                below = base + 2 * node
                flat_tree[base + node] = np.minimum(flat_tree[below], flat_tree[below + 1])
        rows = rows[flat_tree[base + 1] != NONE]
    kept = ids[:, :width] >= 0
    return ids[:, :width][kept], kept.sum(axis=1)


class Encoder:
    """Encodes batches of texts; remembers a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.find_ascii = re.compile(ASCII_PATTERN).findall if pattern == PATTERN else self.find
        self._forget()

    def _forget(self) -> None:
        self.code: defaultdict[str, int] = defaultdict()
        self.code.default_factory = self.code.__len__
        self.flat, self.begins, self.counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _learn(self, known: int) -> None:
        """Encodes the pieces whose codes are ``known`` and up."""
        new = [p.encode("utf-8", "surrogatepass") for p in list(self.code)[known:]]
        ids: list[np.ndarray | None] = [None] * len(new)
        by_width: dict[int, list[int]] = defaultdict(list)
        whole = self.vocabulary.ranks
        for k, piece in enumerate(new):
            if piece in whole:
                ids[k] = np.array([whole[piece]], dtype=np.int32)
            elif len(piece) > WIDE:
                ids[k] = np.array(encode_piece(piece, self.vocabulary), dtype=np.int32)
            else:
                by_width[max(4, 1 << (len(piece) - 1).bit_length())].append(k)
        for width, places in by_width.items():
            flat, counts = encode_block([new[k] for k in places], width, self.vocabulary)
            for k, part in zip(places, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                ids[k] = part
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.flat = np.concatenate((self.flat, *ids)).astype(np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, count of each text)."""
        if len(self.code) > REMEMBERED:
            self._forget()
        known = len(self.code)
        codes, sizes = [], []
        lookup = self.code.__getitem__
        for text in texts:
            pieces = (self.find_ascii if text.isascii() else self.find)(text) if text else ()
            codes.append(list(map(lookup, pieces)))
            sizes.append(len(pieces))
        if len(self.code) > known:
            self._learn(known)
        code = np.fromiter(chain.from_iterable(codes), dtype=np.int64, count=sum(sizes))
        counts = self.counts[code]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(self.begins[code] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        text_ends = np.concatenate(([0], ends))[np.cumsum(sizes)] if sizes else np.zeros(0, dtype=np.int64)
        return ids, np.diff(text_ends, prepend=0)


_encoders: dict[tuple[int, str], Encoder] = {}


def encode_corpus(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(id_column, ids array<int>) of every row of docs. path: the rank file, read by the driver and sent to the workers whole.

    Row by row, without a shuffle; the scan reads the two columns alone.
    """
    ship(docs.sparkSession)
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sent.value
        key = (hash(data), pattern)
        if key not in _encoders:
            _encoders[key] = Encoder(Vocabulary.from_bytes(data), pattern)
        encoder = _encoders[key]
        for batch in batches:
            begin = 0
            sizes = np.cumsum(pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
            while begin < batch.num_rows:  # slices of bounded text
                end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE, side="right"))
                part = batch.slice(begin, max(1, end - begin))
                ids, counts = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_column, "ids"])
                begin += part.num_rows

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
