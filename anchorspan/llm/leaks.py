"""Held-out evaluation texts within a corpus.

A passage of ``window`` consecutive words of an item counts as leaked with at most ``errors`` word edits. By the
pigeonhole principle the item is cut into pieces so short that every window holds errors + 1 whole pieces, one of which
an errors-fold edit must leave as it was: exact hits of pieces in a document give the places, and Myers' bit-parallel
distance of each window that holds the piece verifies them. Words are maximal runs of letters and digits, without case.

A piece may stand in many items and at many places. Places with the same words around them are one context, verified once for
all; contexts meet the items of their piece in blocks of bounded size, and only windows of which no more words are missing
around their place than edits are allowed go to the distance. So memory is bounded whatever items and texts share.

Items are a stated query set: they go against all documents in blocks of bounded count and bytes, each sent to the workers
whole, where a worker makes its tables once. Documents are read row by row, without a shuffle.

Defined results: a null or empty text or item leaks nothing; an item shorter than the window leaks nothing; copies of a
document under other ids are reported each; equal (document, item) rows come out once per document row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorspan.session import ship

#: Items sent to the workers at once, and their characters; more are done in several passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32_000_000
#: Characters of text that a worker works on at once, and pairs of a context and an item's piece.
SLICE, BLOCK_HITS = 4_000_000, 200_000
#: Word ids beside those of words: of one that no item has, of what lies between texts, and between items.
_UNKNOWN, _NO_TEXT, _NO_ITEM = 0, -1, -2
_WORD = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    """The words of a text, folded to one case."""
    if not text:
        return []
    return _WORD(text.lower()) if text.isascii() else [w.casefold() for w in _WORD(text)]


def piece_length(window: int, errors: int) -> int:
    """The longest piece of which every window, wherever it begins, holds errors + 1 whole ones."""
    length = (window + 1) // (errors + 2)
    if length < 1:
        raise ValueError(f"{errors} errors are too many for a window of {window} words")
    return length


def distance_within(pattern: Sequence[int], text: Sequence[int]) -> int:
    """The least edit distance of pattern to any part of text (Myers' bit-vector algorithm; a bit is a word of the pattern)."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = masks.get(w, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up = minus | ~(d | plus) & full
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(d | up) & full, up & d
        if score < best:
            best = score
    return best


def distances_within(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """distance_within() of many pairs at once: a row of patterns (at most 63 words) against the row of texts beside it."""
    n, m = patterns.shape
    one = np.uint64(1)
    full, top = np.uint64((1 << m) - 1), np.uint64(1 << (m - 1))
    bits = one << np.arange(m, dtype=np.uint64)
    plus, minus = np.full(n, full), np.zeros(n, dtype=np.uint64)
    score = np.full(n, m, dtype=np.int64)
    best = score.copy()
    for k in range(texts.shape[1]):
        eq = ((patterns == texts[:, k, None]) * bits).sum(axis=1, dtype=np.uint64)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = minus | (~(d | plus) & full), plus & d
        score += (up & top != 0).astype(np.int64) - (down & top != 0)
        up, down = up << one & full, down << one & full
        plus, minus = down | (~(d | up) & full), up & d
        np.minimum(best, score, out=best)
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str | None]], window: int, errors: int):
        self.window, self.errors, self.piece = window, errors, piece_length(window, errors)
        self.vocabulary: dict[str, int] = {}
        self.item_ids: list[int] = []
        words: list[np.ndarray] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if len(ids) >= window:
                self.item_ids.append(item_id)
                words.append(np.array(ids, dtype=np.int64))
        pad = np.full(window + errors, _NO_ITEM)
        self.item_sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.item_words = np.concatenate([pad, *[x for w in words for x in (w, pad)]])
        self.item_begins = np.cumsum(self.item_sizes + len(pad)) - self.item_sizes
        counts = self.item_sizes // self.piece
        item, number = _spread(counts)
        offset = number * self.piece
        keys = self._keys(self.item_words[(self.item_begins[item] + offset)[:, None] + np.arange(self.piece)]) if len(item) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.place_item, self.place_offset = item[order], offset[order]
        self.keys, self.place_begins, self.place_counts = np.unique(keys[order], return_index=True, return_counts=True)

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        """A hash of each row of word ids. Equal hashes of unlike pieces only cost a verification."""
        key = np.zeros(len(rows), dtype=np.uint64)
        for k in range(rows.shape[1]):
            key = (key ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        return key

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item id, least distance, word at which its first best window's piece stands) of each text and item."""
        if not len(self.keys):
            return
        get = self.vocabulary.get
        words = [list(map(get, words_of(t), repeat(_UNKNOWN))) for t in texts]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        margin = self.window + self.errors
        pad = [_NO_TEXT] * margin
        ids = np.fromiter(chain.from_iterable(chain((pad,), chain.from_iterable((w, pad) for w in words))), dtype=np.int64, count=int(sizes.sum()) + margin * (len(words) + 1))
        begins = np.cumsum(sizes + margin) - sizes
        place, at = self._hits(ids)
        if not len(place):
            return
        doc = np.searchsorted(begins, place, side="right") - 1  # an empty text begins where the margin of the next one does, and holds no place
        context, rep = self._contexts(ids, place)
        # Of the places of a text with one context the first stands for all.
        order = np.lexsort((place, context, doc))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (doc[order][1:] != doc[order][:-1]) | (context[order][1:] != context[order][:-1])
        seen_doc, seen_context, seen_place = doc[order][first], context[order][first], place[order][first]
        number, item, distance, _ = self._verified(ids, place[rep], at[rep])
        if not len(number):
            return
        # Back to the texts: every text with a context has the items of that context, in blocks again.
        low, high = np.searchsorted(number, seen_context, side="left"), np.searchsorted(number, seen_context, side="right")
        found = []
        for row, k in _blocks(high - low, BLOCK_HITS):
            x = low[row] + k
            found.append(_least(np.stack((seen_doc[row], item[x], distance[x], seen_place[row] - begins[seen_doc[row]]))))
        for d, i, least, word in _least(np.concatenate(found, axis=1)).T.tolist():
            yield d, self.item_ids[i], least, word

    def _hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the key) of every piece of an item in the words."""
        known = np.cumsum(np.concatenate(([0], ids > 0)))
        full = np.flatnonzero(known[self.piece :] - known[: -self.piece] == self.piece)  # only words that items have
        key = self._keys(ids[full[:, None] + np.arange(self.piece)])
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return full[hit], at[hit]

    def _contexts(self, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context of each place, a place's number for each context): places are of one context if the words around them that any window can touch are equal."""
        reach = self.window - self.piece + self.errors
        spans = np.arange(-reach, self.piece + reach)
        parts = [self._keys(ids[place[lo : lo + BLOCK_HITS, None] + spans]) for lo in range(0, len(place), BLOCK_HITS)]
        _, rep, context = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        unlike = np.concatenate([(ids[place[lo : lo + BLOCK_HITS, None] + spans] != ids[place[rep[context[lo : lo + BLOCK_HITS]], None] + spans]).any(axis=1) for lo in range(0, len(place), BLOCK_HITS)])
        alone = np.flatnonzero(unlike)  # equal hashes of unlike contexts: each stands for itself
        context[alone] = len(rep) + np.arange(len(alone))
        return context, np.append(rep, alone)

    def _verified(self, ids: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(context, item, least distance, 0) of the contexts at these places, in order of the context."""
        out = []
        for row, k in _blocks(self.place_counts[at], BLOCK_HITS):
            x = self.place_begins[at[row]] + k
            context, item, offset, spot = row, self.place_item[x], self.place_offset[x], place[row]
            near = self._alive(ids, spot, self.item_begins[item] + offset)
            context, item, offset, spot = (v[near] for v in (context, item, offset, spot))
            lowest, highest = np.maximum(0, offset + self.piece - self.window), np.minimum(offset, self.item_sizes[item] - self.window)
            for part, j in _blocks(np.maximum(0, highest - lowest + 1), BLOCK_HITS):
                first = lowest[part] + j
                begin = spot[part] - (offset[part] - first)
                begun = self.item_begins[item[part]] + first
                kept = self._enough(ids, begin, begun)
                patterns = self.item_words[begun[kept, None] + np.arange(self.window)]
                distance = self._distances(patterns, ids[begin[kept, None] + np.arange(-self.errors, self.window + self.errors)])
                good = distance <= self.errors
                part = part[kept][good]
                if len(part):
                    out.append(_least(np.stack((context[part], item[part], distance[good], np.zeros(len(part), dtype=np.int64)))))
        return tuple(_least(np.concatenate(out, axis=1))) if out else (np.zeros(0, dtype=np.int64),) * 4

    def _alive(self, ids: np.ndarray, spot: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether a window around the piece may be near: on one side of it not all of the next errors + 1 words are missing.

        A window with more words than that on a side has them all, and one with fewer on the left has them on the right if it is long enough.
        """
        e = self.errors
        if self.window - self.piece < 2 * e + 1:
            return np.ones(len(spot), dtype=bool)
        near = np.zeros(len(spot), dtype=bool)
        todo = np.arange(len(spot))
        for k in (*range(self.piece, self.piece + e + 1), *range(-1, -e - 2, -1)):
            there, of = spot[todo] + k, self.item_words[word[todo] + k]
            hit = np.logical_or.reduce([of == ids[there + shift] for shift in range(-e, e + 1)])
            near[todo[hit]] = True
            todo = todo[~hit]
        return near

    def _enough(self, ids: np.ndarray, begin: np.ndarray, begun: np.ndarray) -> np.ndarray:
        """The numbers of the windows of which no more words are missing around their place than edits are allowed.

        Words are tried from both ends of the window, and windows that miss too many are left out at once.
        """
        kept, missing = np.arange(len(begin)), np.zeros(len(begin), dtype=np.int64)
        for w in sorted(range(self.window), key=lambda w: min(w, self.window - 1 - w)):
            word, there = self.item_words[begun + w], begin + w
            missing += ~np.logical_or.reduce([word == ids[there + shift] for shift in range(-self.errors, self.errors + 1)])
            near = missing <= self.errors
            if not near.all():
                kept, missing, begin, begun = kept[near], missing[near], begin[near], begun[near]
        return kept

    def _distances(self, patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
        if self.window < 64:
            return np.concatenate([distances_within(patterns[lo : lo + 50_000], texts[lo : lo + 50_000]) for lo in range(0, len(patterns), 50_000)] or [np.zeros(0, dtype=np.int64)])
        return np.array([distance_within(p, t) for p, t in zip(patterns.tolist(), texts.tolist(), strict=True)], dtype=np.int64)


def _least(rows: np.ndarray) -> np.ndarray:
    """Of columns (a, b, distance, place) the one with the least distance, then place, for each a and b, in order."""
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    new = np.ones(rows.shape[1], dtype=bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    return rows[:, new]


def _blocks(counts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, number within the row) of counts[row] entries for each row, at most ``size`` entries at once."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, size):
        x = np.arange(lo, min(lo + size, total))
        row = np.searchsorted(ends, x, side="right")
        yield row, x - (ends[row] - counts[row])


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number within the row) of counts[row] entries for each row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def find_leaks(
    docs: DataFrame, items: DataFrame, *, window: int = 13, errors: int = 1, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "item_text", block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """(id_column, item_id, distance, word_no): documents with a passage of ``window`` words of an item within ``errors`` edits.

    distance is the least of all windows, word_no the place (from 0) of a matching piece of that window in the document.
    """
    ship(docs.sparkSession)
    items = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("passage")).dropna().distinct()
    count, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("passage")), F.lit(0))).head()
    blocks = max(1, -(-count // block_items), -(-chars // BLOCK_CHARS))
    kind = docs.schema[id_column].dataType.simpleString()
    out = None
    for block in range(blocks):
        stated = items.where(F.pmod(F.xxhash64("item", "passage"), F.lit(blocks)) == block).orderBy("item", "passage").toArrow()
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, list(zip(stated.column(0).to_pylist(), stated.column(1).to_pylist(), strict=True))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = None
            for batch in batches:
                matcher = matcher or _made(*sent.value, window, errors)
                sizes = np.cumsum(pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
                begin = 0
                while begin < batch.num_rows:
                    end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE, side="right"))
                    part = batch.slice(begin, max(1, end - begin))
                    rows = list(matcher.find(part.column(1).to_pylist()))
                    taken = pa.array([r[0] for r in rows], type=pa.int64())
                    rest = [pa.array([r[k] for r in rows], type=pa.int64()) for k in (1, 2, 3)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(taken), *rest], names=[id_column, "item_id", "distance", "word_no"])
                    begin += part.num_rows

        part = docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, item_id bigint, distance bigint, word_no bigint")
        out = part if out is None else out.unionByName(part)
    return out


_MATCHER: dict[str, Matcher] = {}


def _made(token: str, items: list[tuple[int, str | None]], window: int, errors: int) -> Matcher:
    """The matcher of a block of items, made once in a worker and kept until another block comes."""
    if token not in _MATCHER:
        _MATCHER.clear()
        _MATCHER[token] = Matcher(items, window, errors)
    return _MATCHER[token]
