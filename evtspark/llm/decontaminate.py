"""Benchmark passages in documents, by CGK embedding, bit-sampling LSH and exact edit verification.

The CGK embedding walks over a word sequence with shared random steps and writes
one symbol per step: a coin that depends on the step and the symbol says whether
the walk goes on to the next word. Sequences a few edits apart fall into step
again, so their walks agree in most places. Of each walk some pairs of places are
sampled, and every two pairs make the key of a bucket. A document's window and an
item are a candidate pair if they share a bucket in one repetition.

An item is cut into pieces of about ``PIECE`` words; of an item edited by a share
of its words at least one piece is edited by no larger share, so it is enough that
one piece's window collides. Windows begin at every word of every document. What
the buckets find is held to two exact tests: the words that item and region have
in common, of which d edits leave all but d, and the edit distance itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtspark.llm.common import ODD, chunks, hash_texts, mix, words

#: Edits allowed as a share of an item's words, and words of a piece.
EDITS, PIECE = 0.2, 20
#: Walks, pairs of places sampled of each, and steps a word that they are sampled from. Every two pairs of a walk are
#: a repetition: 40 in all, with which simulated items at the limit of edits are found in 99 of 100 cases or more.
WALKS, PAIRS, STRETCH = 4, 5, 1.25
#: Benchmark words that are held against the documents in one pass.
PASS_WORDS = 4_000_000
#: Windows that are embedded at a time, and words of the documents they are taken from.
BLOCK, CHUNK_WORDS = 8192, 400_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain(text: str | None) -> bytes:
    """The text without case (A-Z) and ASCII punctuation; its words are what items and documents are compared by."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER, PUNCTUATION) if text else b""


def tokens(text: str | None) -> list[bytes]:
    return plain(text).split()


def places(text: str) -> np.ndarray:
    """The place of each token among all words of the text."""
    return np.array([k for k, w in enumerate(words(text)) if w.translate(None, PUNCTUATION)], np.int64)


def symbols_of(h: np.ndarray) -> np.ndarray:
    """Words as 32-bit symbols, all that the walks and buckets look at."""
    return (h >> np.uint64(32)).astype(np.uint32)


def coins(h: np.ndarray) -> list[np.ndarray]:
    """For each walk, 32 coins per word: bit j says whether the walk leaves the word at step j. The word 0 is never left."""
    return [symbols_of(mix(h * ODD[w])) for w in range(WALKS)]


def walk(symbols: np.ndarray, coin: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
    """Symbols (step, window) of the walks that begin at the places ``at``; ``symbols`` ends with 0."""
    out, at, leave = np.empty((steps, len(at)), np.uint32), at.copy(), np.empty(len(at), np.uint32)
    for j in range(steps):
        symbols.take(at, out=out[j], mode="clip")
        coin.take(at, out=leave, mode="clip")
        leave >>= np.uint32(j % 32)
        leave &= np.uint32(1)
        at += leave
    return out


class Sampler:
    """Bucket keys of windows whose length is in the class [size, 2 * size)."""

    def __init__(self, size: int) -> None:
        self.steps = max(1, int(STRETCH * size))
        rng = np.random.default_rng(size)
        # a pair has a place in each half of the walk; no place is taken twice while there are enough
        halves = np.arange(self.steps // 2 + self.steps % 2), np.arange(self.steps // 2, self.steps)
        self.places = np.stack([[np.resize(rng.permutation(half), PAIRS) for half in halves] for _ in range(WALKS)]).transpose(0, 2, 1)
        self.factors = rng.integers(1, 1 << 32, (WALKS, PAIRS, 4), np.uint32) | np.uint32(1)

    def keys(self, symbols: list[np.ndarray]) -> Iterator[np.ndarray]:
        """A key per window for each repetition, from each walk's symbols."""
        for w in range(WALKS):
            one, two = [], []
            for (a, b), f in zip(self.places[w], self.factors[w], strict=True):
                one.append(symbols[w][a] * f[0] + symbols[w][b] * f[1])
                two.append(symbols[w][a] * f[2] + symbols[w][b] * f[3])
            for p, q in combinations(range(PAIRS), 2):
                yield one[p] + two[q]


def occurrences(item: np.ndarray, region: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(edits, start, stop) of the parts of ``region`` within ``most`` edits of ``item``, by start; of overlapping ones the nearest, then the first."""
    n = len(region)
    row, begin, index = np.zeros(n + 1, np.int64), np.arange(n + 1), np.arange(n + 1)
    for k, symbol in enumerate(item):
        swap = row[:-1] + (region != symbol)
        drop = row[1:] + 1
        new = np.r_[k + 1, np.minimum(swap, drop)]
        start = np.r_[0, np.where(swap <= drop, begin[:-1], begin[1:])]
        lead = np.minimum.accumulate(new - index) + index  # insertions from the left
        source = np.maximum.accumulate(np.where(new == lead, index, 0))
        row, begin = lead, start[source]
    ends = np.flatnonzero((row <= most) & (begin < index))
    taken, used = [], np.zeros(n, bool)
    for stop in ends[np.lexsort((ends, row[ends]))].tolist():
        start = int(begin[stop])
        if not used[start:stop].any():
            used[start:stop] = True
            taken.append((int(row[stop]), start, stop))
    return sorted(taken, key=lambda x: x[1])


class Index:
    """Buckets of the pieces of benchmark items, and what the exact tests need."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        hashed, n = hash_texts([plain(text) for _, text in items])
        stop = np.cumsum(n)
        self.items = [(item, hashed[z - k : z]) for (item, _), z, k in zip(items, stop.tolist(), n.tolist(), strict=True) if k]
        self.texts = [plain(text) for (_, text), k in zip(items, n.tolist(), strict=True) if k]
        self.size = np.array([len(h) for _, h in self.items], np.int64)
        self.most = np.array([int(EDITS * len(h)) for _, h in self.items], np.int64)
        owned = [mix(h ^ mix(np.full(1, k + 1, np.uint64))) for k, (_, h) in enumerate(self.items)]
        self.owned = np.unique(np.concatenate(owned)) if owned else np.empty(0, np.uint64)
        pieces: dict[int, list[tuple[int, int]]] = {}
        for k, (_, h) in enumerate(self.items):
            parts = max(1, round(len(h) / PIECE))
            edge = [round(i * len(h) / parts) for i in range(parts + 1)]
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                pieces.setdefault(1 << (z - a).bit_length() - 1, []).append((k, a))
        text = np.concatenate([np.append(h, np.uint64(0)) for _, h in self.items]) if self.items else np.zeros(1, np.uint64)
        first = np.cumsum([0, *(len(h) + 1 for _, h in self.items)])
        coin = coins(text)
        keys, owner, offset = [], [], []
        self.samplers = {size: Sampler(size) for size in sorted(pieces)}
        for size, found in pieces.items():
            k, a = np.array(found, np.int64).T
            sampler = self.samplers[size]
            for bucket in sampler.keys([walk(symbols_of(text), c, first[k] + a, sampler.steps) for c in coin]):
                keys.append(bucket)
                owner.append(k)
                offset.append(a)
        key = np.concatenate(keys) if keys else np.empty(0, np.uint32)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.offset = (x[order] for x in (key, np.concatenate(owner), np.concatenate(offset))) if keys else (key, key, key)
        bits = min(28, max(20, (64 * len(key)).bit_length()))
        self.shift = np.uint32(32 - bits)
        self.some = np.zeros(1 << bits, bool)  # first bits of all keys: what nearly all windows fail
        self.some[self.key >> self.shift] = True

    def collisions(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item number, where the item would begin) of the windows of ``h`` at ``at`` that share a bucket with an item's piece; ``h`` has a 0 after each document."""
        own, coin, steps = symbols_of(h), coins(h), max((s.steps for s in self.samplers.values()), default=0)
        windows, items, begins = np.empty(0, np.int64), [], []
        for low in range(0, len(at), BLOCK):
            windows = at[low : low + BLOCK]
            symbols = [walk(own, c, windows, steps) for c in coin]
            for sampler in self.samplers.values():
                for key in sampler.keys(symbols):
                    hit = np.flatnonzero(self.some.take(key >> self.shift, mode="clip"))
                    if not len(hit):
                        continue
                    first = np.searchsorted(self.key, key[hit], "left")
                    same = self.key[np.minimum(first, len(self.key) - 1)] == key[hit]
                    hit, first = hit[same], first[same]
                    count = np.searchsorted(self.key, key[hit], "right") - first
                    row = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                    items.append(self.owner[row])
                    begins.append(np.repeat(windows[hit], count) - self.offset[row])
        if not items:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        item, begin = np.unique(np.stack([np.concatenate(items), np.concatenate(begins)]), axis=1)
        return item, begin

    def share_words(self, h: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether somewhere in each region ``h[low:high]`` a window of an item's words and its edits holds enough words of the item."""
        most, size = self.most[item], self.size[item]
        length = high - low
        begin = np.cumsum(length) - length
        row = np.repeat(np.arange(len(item)), length)
        at = np.arange(len(row))
        mine = mix(h[low[row] + at - begin[row]] ^ mix(item.astype(np.uint64) + np.uint64(1))[row])
        near = np.minimum(np.searchsorted(self.owned, mine), len(self.owned) - 1)
        up = np.r_[0, np.cumsum(self.owned[near] == mine)]
        stop = np.minimum(at + (size + most)[row], (begin + length)[row])
        enough = up[stop] - up[at] >= (size - most)[row]
        return np.bincount(row, weights=enough, minlength=len(item)) > 0

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, first word, word after the last, edits) of every occurrence of every item."""
        own, n = hash_texts([plain(t) for t in texts])
        first = np.cumsum(n) - n + np.arange(len(n))  # a 0 after each text
        h = np.zeros(len(own) + len(n) + 1, np.uint64)
        at = np.arange(len(own)) + np.repeat(np.arange(len(n)), n)
        h[at] = own
        item, begin = self.collisions(h, at)
        out = []
        if not len(item):
            return out
        # a colliding piece may stand d words off its place, and its window d off the piece
        most, size = self.most[item], self.size[item]
        doc = np.clip(np.searchsorted(first, begin + 2 * most, "right") - 1, 0, None)  # of windows that begin before their text
        low, high = np.maximum(begin - 2 * most, first[doc]), np.minimum(begin + size + 3 * most, first[doc] + n[doc])
        order = np.lexsort((low, item, doc))
        doc, item, low, high = (x[order] for x in (doc, item, low, high))
        near = np.maximum.accumulate(np.where(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])], np.arange(len(doc)), 0))
        reach = high.copy()
        for k in np.flatnonzero(near < np.arange(len(doc))).tolist():  # regions of one item and text that touch become one
            reach[k] = max(reach[k], reach[k - 1])
        new = np.r_[True, (near[1:] != near[:-1]) | (low[1:] > reach[:-1])]
        starts = np.flatnonzero(new)
        ends = reach[np.r_[starts[1:] - 1, len(doc) - 1]]
        doc, item, low, high = doc[starts], item[starts], low[starts], ends
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        told: dict[int, list[bytes]] = {}
        for r in np.flatnonzero(self.share_words(h, item, low, high)).tolist():
            d, k, a, z = int(doc[r]), int(item[r]), int(low[r]), int(high[r])
            if d not in told:
                told[d] = tokens(texts[d])
            number: dict[bytes, int] = {}  # words, not their hashes, decide
            symbols = np.array([number.setdefault(w, len(number)) for w in self.texts[k].split()])
            region = np.array([number.get(w, -1) for w in told[d][a - first[d] : z - first[d]]])
            for edits, start, stop in occurrences(symbols, region, int(self.most[k])):
                found.setdefault(d, []).append((self.items[k][0], a - first[d] + start, a - first[d] + stop, edits))
        for d, own_ in sorted(found.items()):
            place = places(texts[d])
            out += [(d, name, int(place[a]), int(place[z - 1]) + 1, edits) for name, a, z, edits in own_]
        return out


def _search(batches: Iterator[pa.RecordBatch], index: object) -> Iterator[pa.RecordBatch]:
    known: Index = index.value
    for batch in batches:
        for part in chunks([batch], 256):
            texts, low, size = [t.as_py() for t in part.column(2)], 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size >= 6 * CHUNK_WORDS or k == len(texts) - 1:
                    rows = known.matches(texts[low : k + 1])
                    at = pa.array([low + r[0] for r in rows], pa.int64())
                    cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *cols], names=["id", "tag", "item", "start", "stop", "edits"])
                    low, size = k + 1, 0


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(id, tag, item, start, stop, edits)``: every occurrence of each benchmark item in each row of ``docs``.

    start and stop number the text's words (stop exclusive); tag is the XXH64 of
    the text; edits is at most a fifth of the item's words. Occurrences of one item
    do not overlap. Up to ``PASS_WORDS`` words of benchmark are held against all
    rows in one reading; a larger benchmark takes several. Items and rows without
    words match nothing; null ids stay null; repeated rows give repeated results;
    empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[item_text_col].cast("string").alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    passes = max(1, -(-total // PASS_WORDS))
    out = None
    for b in range(passes):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == b).orderBy("item", "text")
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in part.collect()]))  # about PASS_WORDS words
        found = rows.mapInArrow(partial(_search, index=index), "id long, tag long, item long, start long, stop long, edits long")
        out = found if out is None else out.union(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item, all columns as they are."""
    found = leaks(docs, benchmark, id_col, text_col).select(F.col("id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_tag"))
    return docs.join(found, same, "left_anti")
