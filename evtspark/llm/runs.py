"""Stretches of words that repeat with a period, by Lyndon roots and longest common extensions.

A run is a stretch with smallest period q, at least twice q long, that no neighbour
extends. Every run holds the longest Lyndon word at some place, for one of two
orders of the words, as its root: [i, j), where j begins the next suffix that is
smaller than the one at i. So there are two candidates per place. A candidate is
extended to the right by the common prefix of the suffixes at i and j, to the left
by that of the reversal, both read off a suffix tree (Ukkonen's) as the depth of a
lowest common ancestor: the least depth between two leaves of its Euler tour.

Only words that can be in a run reach the trees: one of ``least`` words or more has a
repeated gram of ``least / 2`` words over each of its words, within the stretch that
such grams cover without a gap. Grams are told by hash there, so that a collision
costs a look and loses nothing; the trees compare the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evtspark.llm.common import BASE, chunks, hash_texts, mix, powers, words

#: Depths of the tour that are scanned for a minimum as one.
SPAN = 16
#: Rows and bytes of text looked at together.
CHUNK_ROWS, CHUNK_BYTES = 512, 8 << 20


class SuffixTree:
    """Suffix tree of numbers from 1, ended by a 0; answers longest common prefixes of suffixes."""

    def __init__(self, text: list[int]):
        self.text = [*text, 0]
        self._build()
        self._children()
        self._tour()

    def _build(self) -> None:
        """Ukkonen's algorithm: one word after the other, edges as (first, end) in the text; a leaf's end is the text's."""
        text, n = self.text, len(self.text)
        wide = max(text) + 1
        first, end, link, edges = [0], [0], [0], {}
        node, edge, length, left = 0, 0, 0, 0
        for i, c in enumerate(text):
            before, left = 0, left + 1
            while left:
                if not length:
                    edge = i
                key = node * wide + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(first)
                    first.append(i)
                    end.append(n)
                    link.append(0)
                    if before:
                        link[before] = node
                    before = node
                else:
                    start = first[child]
                    size = min(end[child], i + 1) - start
                    if length >= size:
                        edge, length, node = edge + size, length - size, child
                        continue
                    if text[start + length] == c:
                        length += 1
                        if before:
                            link[before] = node
                        break
                    split = len(first)
                    first += (start, i)
                    end += (start + length, n)
                    link += (0, 0)
                    edges[key] = split
                    edges[split * wide + c] = split + 1
                    edges[split * wide + text[start + length]] = child
                    first[child] = start + length
                    if before:
                        link[before] = split
                    before = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - left + 1
        self.first, self.end = np.array(first), np.array(end)
        self.keys, self.targets, self.wide = np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)), wide

    def _children(self) -> None:
        """Children of each node by their first word, as pieces of one array."""
        order = np.argsort(self.keys)
        self.child = self.targets[order]
        self.at = np.searchsorted(self.keys[order] // self.wide, np.arange(len(self.first) + 1))

    def _tour(self) -> None:
        """Depths along the Euler tour, the place of each suffix's leaf in it, and its rank among the suffixes."""
        size = (self.end - self.first).tolist()
        at, child, n = self.at.tolist(), self.child.tolist(), len(self.text)
        depth, tour, rank, place = [0] * len(size), [], [0] * n, [0] * n
        todo, met = [0], 0
        while todo:
            node = todo.pop()
            if node < 0:  # back at a parent
                tour.append(depth[~node])
                continue
            deep = depth[node]
            tour.append(deep)
            a, z = at[node], at[node + 1]
            if a == z:
                rank[n - deep], place[n - deep], met = met, len(tour) - 1, met + 1
            for c in reversed(child[a:z]):
                depth[c] = deep + size[c]
                todo += (~node, c)
        self.rank, self.place = rank, np.array(place)
        tour += [n] * (-len(tour) % SPAN)
        self.tour = np.array(tour, np.int32).reshape(-1, SPAN)
        self.upto, self.onward = np.minimum.accumulate(self.tour, 1), np.minimum.accumulate(self.tour[:, ::-1], 1)[:, ::-1]
        self.tables = [self.tour.min(1)]
        while (step := 1 << len(self.tables)) <= len(self.tour):
            low = self.tables[-1]
            self.tables.append(np.minimum(low[: len(self.tour) - step + 1], low[step // 2 : len(self.tour) - step // 2 + 1]))

    def turned_ranks(self) -> list[int]:
        """Ranks of the suffixes if words were ordered the other way round, the end still before all words."""
        at, child, n = self.at.tolist(), self.child.tolist(), len(self.text)
        size, first = (self.end - self.first).tolist(), self.first.tolist()
        rank, todo, met = [0] * n, [(0, 0)], 0
        while todo:
            node, deep = todo.pop()
            own = child[at[node] : at[node + 1]]
            if not own:
                rank[n - deep], met = met, met + 1
                continue
            ends = self.text[first[own[0]]] == 0
            todo += [(c, deep + size[c]) for c in own[ends:]]  # taken from the back: the largest first
            if ends:
                todo.append((own[0], deep + size[own[0]]))
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, for i other than j."""
        a, z = self.place[i], self.place[j]
        a, z = np.minimum(a, z), np.maximum(a, z)
        block, other = a // SPAN, z // SPAN
        out = np.minimum(self.onward[block, a % SPAN], self.upto[other, z % SPAN])
        inner = other - block - 1
        level = np.frexp(np.maximum(inner, 1))[1] - 1
        for k in np.unique(level[inner > 0]).tolist():
            rows = np.flatnonzero((inner > 0) & (level == k))
            out[rows] = np.minimum(out[rows], np.minimum(self.tables[k][block[rows] + 1], self.tables[k][other[rows] - (1 << k)]))
        one = np.flatnonzero(block == other)
        if len(one):
            column = np.arange(SPAN)
            inside = (column >= (a[one] % SPAN)[:, None]) & (column <= (z[one] % SPAN)[:, None])
            out[one] = np.where(inside, self.tour[block[one]], np.iinfo(np.int32).max).min(1)
        return out.astype(np.int64)


def next_smaller(rank: list[int], n: int) -> np.ndarray:
    """For each place the next one whose suffix ranks lower: there the longest Lyndon word ends."""
    after = [n] * n
    for i in range(n - 2, -1, -1):
        j = i + 1
        while j < n and rank[j] > rank[i]:
            j = after[j]
        after[i] = j
    return np.array(after, np.int64)


def all_runs(text: list[int]) -> np.ndarray:
    """Rows (start, length, period) of every run of a text of numbers from 1, by start, then period."""
    n = len(text)
    if n < 2:
        return np.empty((0, 3), np.int64)
    tree, turned = SuffixTree(text), SuffixTree(text[::-1])
    i = np.tile(np.arange(n), 2)
    j = np.concatenate([next_smaller(tree.rank, n), next_smaller(tree.turned_ranks(), n)])
    half = 2 * (j - i) <= n
    i, j = i[half], j[half]
    right, left = j + tree.common(i, j), i - turned.common(n - i, n - j)
    run = right - left >= 2 * (j - i)
    found = np.unique(np.c_[left, j - i, right - left][run], axis=0)
    return found[:, [0, 2, 1]]


def stretches(h: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Of word hashes of documents in a row: for each word the number of its stretch, -1 for words that are in no run.

    Grams are looked for within a document first and then, as often as that leaves
    words out, within the stretches of the round before.
    """
    gram = (least + 1) // 2
    part = doc.astype(np.int64)
    at = np.arange(len(h))  # words still looked at
    out = np.full(len(h), -1)
    while len(at) >= least:
        n = len(at) - gram + 1
        whole = (part[at[:n]] == part[at[gram - 1 :]]) & (at[gram - 1 :] - at[:n] == gram - 1)
        start = np.flatnonzero(whole)
        base = powers(BASE, gram)
        key = np.zeros(n, np.uint64)
        for k in range(gram):
            key += h[at[k : k + n]] * base[k]
        key = mix(key[start] + mix(part[at[start]].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(start), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, start[twice], 1)
        np.add.at(edge, start[twice] + gram, -1)
        kept = at[np.cumsum(edge[:-1]) > 0]
        if not len(kept):
            break
        new = np.r_[True, (np.diff(kept) != 1) | (part[kept][1:] != part[kept][:-1])]
        number = np.cumsum(new) - 1
        long = np.bincount(number)[number] >= least
        if len(kept) == len(at) and long.all():
            out[at] = number
            break
        fresh = np.full(len(h), -1)
        fresh[kept] = number
        part, at = fresh, kept[long]
    return out


def document_runs(own: list[bytes], stretch: np.ndarray, least: int) -> np.ndarray:
    """Runs of ``least`` words or more of a document, given its words' stretches."""
    at = np.flatnonzero(stretch >= 0)
    number: dict[bytes, int] = {}
    text: list[int] = []
    place: list[int] = []
    last = -1
    for p in at.tolist():
        if place and stretch[p] != last:  # a mark of its own between stretches: no run crosses it
            text.append(number.setdefault(b" %d" % p, len(number) + 1))
            place.append(-1)
        text.append(number.setdefault(own[p], len(number) + 1))
        place.append(p)
        last = stretch[p]
    found = all_runs(text)
    found = found[found[:, 1] >= least]
    found[:, 0] = np.array(place, np.int64)[found[:, 0]]
    return found


def _find(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in chunks(batches, CHUNK_ROWS):
        texts = batch.column(1).to_pylist()
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        done, sizes = 0, np.cumsum([len(r) for r in raw])
        while done < len(raw):
            stop = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + CHUNK_BYTES)))
            part = raw[done:stop]
            h, count = hash_texts(part)
            stretch = stretches(h, np.repeat(np.arange(len(part)), count), least)
            first = np.cumsum(count) - count
            busy = set(np.repeat(np.arange(len(part)), count)[stretch >= 0].tolist())
            runs, n_words, collapsed = [], [], []
            for k, r in enumerate(part):
                own = r.split()
                n_words.append(len(own))
                found = document_runs(own, stretch[first[k] : first[k] + count[k]], least) if k in busy else ()
                if len(found):
                    edge = np.zeros(len(own) + 1, np.int64)
                    np.add.at(edge, found[:, 0] + found[:, 2], 1)
                    np.add.at(edge, found[:, 0] + found[:, 1], -1)
                    own = [own[p] for p in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in (found.tolist() if len(found) else ())])
                collapsed.append(b" ".join(own).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(done, len(part)), pa.array(n_words, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())], names=["id", "n_words", "runs", "collapsed"]
            )
            done = stop


def find_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, runs, collapsed)`` per row; words are parted by space, tab and line marks.

    ``runs``: structs (start, length, period) of all runs with at least ``least``
    words and two periods, by start, then period. ``collapsed``: the words, joined by
    one space, without those that some run holds after its first period. Null and
    empty texts have no words and no runs; rows are taken one by one, so repeated
    ids and rows change nothing; an empty table gives no rows; other columns are
    ignored. A document is one task's work: its trees take some 500 bytes a word of
    those that are in repetitive stretches.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(partial(_find, least=least), "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
