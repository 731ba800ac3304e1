"""Removal of long passages that stand earlier in the corpus, with an FM-index per shard.

A window is ``window`` consecutive words. Its minimiser, the run of MINI words
with the least hash, is the same wherever the window stands, so windows are dealt
out to shards by it: neighbouring windows with one minimiser form a segment.
Segments whose minimiser occurs once hold no repeat. Segments with the same words
(known by XXH3 of 128 bits over their bytes, whatever the words' own hashes are, and
by the minimiser) are pre-aggregated before they meet: all but the first are repeats as a whole, so that a passage with
millions of copies costs its shard one segment. The distinct segments with a common
minimiser stream through their shard, where an FM-index over them is searched
backwards: the matching statistic of every window's end tells how many of its last
words occur elsewhere, and windows that reach the threshold are reported.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtspark.llm.common import ODD, hash_texts, mix, stage, words

MINI = 4
#: Rows whose equal segments are settled in the mapper, before the exchange.
CHUNK_DOCS, CHUNK_BYTES = 8192, 24 << 20
#: Words of an index, and segments of one minimiser beyond which its windows are dealt out singly.
SHARD_WORDS, HOT_SEGMENTS = 500_000, 20_000
#: Hot windows whose copies are settled in the mapper, before the exchange.
CHUNK_WINDOWS = 1_000_000
#: Hot minimisers, each with over HOT_SEGMENTS rows of its own, that are sent to every task; with more, they are joined by key.
BROADCAST_ROWS = 100_000
LOW = -(1 << 63)
SEGMENT = "key long, seg long, sub long, doc long, tag int, start int, n int"


def _docs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of (doc, tag, text)."""
    held, n = [], 0
    for batch in batches:
        for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            held.append((doc, tag, (text.as_py() or "").encode("utf-8", "surrogatepass")))
            n += len(held[-1][2])
            if len(held) >= CHUNK_DOCS or n >= CHUNK_BYTES:
                yield held
                held, n = [], 0
    if held:
        yield held


def _split(docs: list[tuple[int, int, bytes]], window: int) -> dict[str, np.ndarray]:
    """Segments of whole documents: minimiser, 128 bits of hash of the words' bytes, place and number of windows."""
    import xxhash

    h, length = hash_texts([d[2] for d in docs])
    long = length >= window
    h, length, docs = h[np.repeat(long, length)], length[long], [d for d, keep in zip(docs, long.tolist(), strict=True) if keep]
    n = len(h)
    if not n:
        return {}
    gram = np.zeros(n, np.uint64)
    for k in range(MINI):
        gram[: n - k] += h[k:] * ODD[k]
    gram = mix(gram)
    # least gram of each window by doubling, the leftmost of equals
    at, span, wide = np.arange(n), 1, window - MINI + 1
    while span < wide:
        step = min(span, wide - span)
        other = np.append(at[step:], at[-1:].repeat(step))
        at = np.where(gram[other] < gram[at], other, at)
        span += step
    first = np.cumsum(length) - length
    doc = np.repeat(np.arange(len(docs)), length)
    place = np.arange(n) - first[doc]
    valid = place + window <= length[doc]
    rows = np.flatnonzero(valid)
    new = np.r_[True, (at[rows][1:] != at[rows][:-1]) | (doc[rows][1:] != doc[rows][:-1])]
    begin = rows[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(rows)])
    digests, cut = [], np.searchsorted(doc[begin], np.arange(len(docs) + 1)).tolist()
    at_start, at_stop = place[begin], place[begin] + count + window - 1
    for k, (_, _, text) in enumerate(docs):  # a document's words at a time
        own = text.split()
        joined = memoryview(b" ".join(own))
        edge = np.zeros(len(own) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1, out=edge[1:])
        part = slice(cut[k], cut[k + 1])
        digests += [xxhash.xxh3_128_digest(joined[a:z]) for a, z in zip(edge[at_start[part]].tolist(), (edge[at_stop[part]] - 1).tolist(), strict=True)]
    content = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    d = doc[begin]
    return {
        "key": gram[at[begin]].view(np.int64), "seg": content[:, 0], "sub": content[:, 1], "doc": np.array([x[0] for x in docs], np.int64)[d],
        "tag": np.array([x[1] for x in docs], np.int32)[d], "start": place[begin].astype(np.int32), "n": count.astype(np.int32),
    }


def _settle(s: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Sorted segments; which are later copies of an equal one; which begin a new (key, seg, sub)."""
    names = [k for k in ("key", "seg", "sub") if k in s]
    order = np.lexsort((s["start"], s["doc"], *(s[k] for k in reversed(names))))
    s = {k: v[order] for k, v in s.items()}
    new = np.r_[True, np.any([s[k][1:] != s[k][:-1] for k in names], axis=0)]
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    return s, (s["doc"] != s["doc"][lead]) | (s["start"] != s["start"][lead]), new


def _batch(s: dict[str, np.ndarray], **more: np.ndarray) -> pa.RecordBatch:
    cols = s | more
    return pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))


def _runs(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Segments that follow on one another in a document, as one."""
    order = np.lexsort((s["start"], s["tag"], s["doc"]))
    doc, tag, start, n = (s[c][order] for c in ("doc", "tag", "start", "n"))
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + n[:-1])]
    at = np.flatnonzero(new)
    none = np.zeros(len(at), np.int64)
    return {"key": mix((doc[at] + start[at]).view(np.uint64)).view(np.int64), "seg": none, "sub": none, "doc": doc[at], "tag": tag[at], "start": start[at], "n": np.add.reduceat(n, at).astype(np.int32)}


def _segments(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Segments of the input; copies within a chunk are marked, joined to runs and need no meeting: any key does for them."""
    for docs in _docs(batches):
        s = _split(docs, window)
        if s:
            s, later, _ = _settle(s)
            if later.any():
                runs = _runs({k: v[later] for k, v in s.items()})
                yield _batch(runs, later=np.ones(len(runs["doc"]), bool))
            yield _batch({k: v[~later] for k, v in s.items()}, later=np.zeros((~later).sum(), bool))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads segments sorted by (key, seg, sub, doc, start); marks copies, keeps first segments whose key has others.

    ``later`` rows come out as they are; of the rest, rows of a key go on only if
    the key has two different segments. State across batches: the last key's
    leader and, if it is the key's only segment so far, its row.
    """
    key = seg = sub = lead = None
    waiting: pa.RecordBatch | None = None
    several = False
    for batch in batches:
        if not batch.num_rows:
            continue
        s = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(("key", "seg", "sub", "doc", "tag", "start", "n"))}
        late = batch.column(7).to_numpy(zero_copy_only=False).astype(bool)
        if late.any():
            yield _batch({k: v[late] for k, v in s.items()}, later=np.ones(late.sum(), bool))
        s = {k: v[~late] for k, v in s.items()}
        if not len(s["key"]):
            continue
        new_key = np.r_[s["key"][0] != key, s["key"][1:] != s["key"][:-1]]
        new = new_key | np.r_[s["seg"][0] != seg, s["seg"][1:] != s["seg"][:-1]] | np.r_[s["sub"][0] != sub, s["sub"][1:] != s["sub"][:-1]]
        at = np.flatnonzero(new)
        of = np.cumsum(new) - 1  # -1: the segment that the last batch ended with
        lead_doc = np.where(of < 0, 0 if lead is None else lead[0], s["doc"][at[of]] if len(at) else 0)
        lead_start = np.where(of < 0, 0 if lead is None else lead[1], s["start"][at[of]] if len(at) else 0)
        later = (s["doc"] != lead_doc) | (s["start"] != lead_start)
        # keys with two segments or more, here or going on from before
        group = np.cumsum(new_key)  # 0: the key going on
        segs = np.bincount(group, weights=new, minlength=group[-1] + 1)
        if not new_key[0]:
            segs[0] += 2 if several else 1
        many = segs[group] >= 2
        if waiting is not None and (new_key[0] or segs[0] >= 2):
            if not new_key[0]:
                yield waiting
            waiting = None
        firsts = ~later & many
        out = later | firsts
        if out.any():
            yield _batch({k: v[out] for k, v in s.items()}, later=later[out])
        if not many[-1]:  # the last key has one segment so far; its rows that are no copies wait
            own = (group == group[-1]) & ~later
            if own.any():
                waiting = _batch({k: v[own] for k, v in s.items()}, later=np.zeros(own.sum(), bool))
        several = bool(segs[group[-1]] >= 2)
        key, seg, sub, lead = s["key"][-1], s["seg"][-1], s["sub"][-1], (lead_doc[-1], lead_start[-1])


PARTS = "hot boolean, later boolean, deal long, key long, seg long, doc long, tag int, start int, n int, words binary"
KINDS = (pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
NAMES = [x.split()[0] for x in PARTS.split(", ")]


def _windows(digests: list[bytes], place: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Windows of hot segments as segments of their own, named by 128 bits of their words; copies within the chunk are marked."""
    name = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    doc, tag, start = (np.array(c, t) for c, t in zip(zip(*place, strict=True), (np.int64, np.int32, np.int32), strict=True))
    s = {"key": name[:, 0], "seg": name[:, 1], "doc": doc, "tag": tag, "start": start, "n": np.ones(len(doc), np.int32)}
    s, later, _ = _settle(s)
    deal = np.where(later, mix((s["doc"] + s["start"]).view(np.uint64)).view(np.int64), s["key"])
    none = pa.nulls(len(doc), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(doc), bool)), pa.array(later), pa.array(deal), *map(pa.array, s.values()), none], names=NAMES)


def _extract(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of asked-for segments; of hot ones the windows, by hash alone."""
    import xxhash

    digests: list[bytes] = []
    place: list[tuple[int, int, int]] = []
    for batch in batches:
        rows: list[tuple] = []
        for doc, tag, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = words(text)
            for s in wanted:
                if s["hot"]:
                    for k in range(s["start"], s["start"] + s["n"]):
                        digests.append(xxhash.xxh3_128_digest(b" ".join(own[k : k + window])))
                        place.append((doc, tag, k))
                        if len(digests) >= CHUNK_WINDOWS:
                            yield _windows(digests, place)
                            digests, place = [], []
                else:
                    rows.append((False, False, s["key"], s["key"], 0, doc, tag, s["start"], s["n"], b" ".join(own[s["start"] : s["start"] + s["n"] + window - 1])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)
    if digests:
        yield _windows(digests, place)


def repeats_in_shard(segments: list[tuple[int, int, int, list[bytes]]], window: int) -> list[np.ndarray]:
    """For segments (doc, start, n windows, words): which of each one's windows stand earlier in the shard."""
    from evtspark.llm.fmindex import FMIndex

    order = sorted(range(len(segments)), key=lambda i: segments[i][:2])
    number: dict[bytes, int] = {}
    text, starts, rank, owner = [], [], [], []
    at, places = 0, {}  # places in order; rows with one id share them
    for i in order:
        doc, start, n, own = segments[i]
        text += [number.setdefault(w, len(number) + 1) for w in own]
        text.append(0)
        for k in range(n):
            starts.append(at + k)
            rank.append(places.setdefault((doc, start + k), len(places)))
            owner.append((i, k))
        at += len(own) + 1
    index = FMIndex(np.array(text, np.int64))
    starts_, rank_ = np.array(starts, np.int64), np.array(rank, np.int64)
    order_of = np.full(len(text), len(rank_), np.int64)
    order_of[starts_] = rank_
    length, low, high = index.statistics(starts_, window)
    rows = np.flatnonzero(length >= window)
    earlier = rows[index.least(order_of, low[rows], high[rows]) < rank_[rows]]
    found = [np.zeros(s[2], bool) for s in segments]
    for r in earlier.tolist():
        i, k = owner[r]
        found[i][k] = True
    return found


def _copies(batch: pa.RecordBatch, lead: tuple | None) -> tuple[pa.RecordBatch, tuple | None]:
    """Of hot windows sorted by (later, key, seg, doc, start), those that are not the first of their words.

    ``lead``: key, seg, doc and start of the first window of the words that the last batch ended with.
    """
    later, key, seg, doc, tag, start, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4, 5, 6, 7, 8))
    out = later.astype(bool)
    at = np.flatnonzero(~out)
    if len(at):
        k, s, d, b = key[at], seg[at], doc[at], start[at]
        old = lead is not None and lead[:2] == (k[0], s[0])
        new = np.r_[not old, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]
        of = np.cumsum(new) - 1 + old
        first_doc, first_start = (np.r_[np.array([lead[i]] if old else [], np.int64), x[new]][of] for i, x in ((2, d), (3, b)))
        out[at] = (d != first_doc) | (b != first_start)
        lead = (k[-1], s[-1], first_doc[-1], first_start[-1])
    return _batch({"doc": doc[out], "tag": tag[out], "start": start[out], "n": n[out]}), lead


def _search(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Reads segments sorted by (hot, key); streams hot windows, indexes and searches a few keys' worth of words of the rest at a time."""
    held: list[tuple] = []
    size, last = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        found = repeats_in_shard([(doc, start, n, own) for doc, _, start, n, own in held], window)
        out = []
        for (doc, tag, start, _, _), hit in zip(held, found, strict=True):
            edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
            out += [(doc, tag, start + int(a), int(z - a)) for a, z in zip(edge[::2], edge[1::2], strict=True)]
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc", "tag", "start", "n"])

    lead = None
    for batch in batches:
        hot = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        if hot.any():
            copies, lead = _copies(batch.filter(pa.array(hot)), lead)
            yield copies
            batch = batch.filter(pa.array(~hot))
        for key, doc, tag, start, n, part in zip(*(batch.column(i).to_pylist() for i in (3, 5, 6, 7, 8, 9)), strict=True):
            if size >= SHARD_WORDS and key != last:
                yield from flush()
                held, size = [], 0
            own = part.split()
            held.append((doc, tag, start, n, own))
            size, last = size + len(own), key
    if held:
        yield from flush()


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            n_words, n_removed, kept = [], [], []
            for text, marks in zip(part.column(2), part.column(3).to_pylist(), strict=True):
                own = words(text.as_py())
                edge = np.zeros(len(own) + 1, np.int64)
                for m in marks or []:
                    edge[m["start"]] += 1
                    edge[min(m["start"] + m["n"] + window - 1, len(own))] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                n_words.append(len(own))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(itertools.compress(own, ~gone)).decode("utf-8", "surrogatepass"))
            cols = [part.column(0), part.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "tag", "n_words", "n_removed", "kept"])


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, tag, text)``: the id, null as the least number, and 31 bits of the text's hash, which tell rows with one id apart; null ids have a negative tag."""
    text, ident = docs[text_col].cast("string"), docs[id_col].cast("long")
    tag = F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    return docs.select(F.coalesce(ident, F.lit(LOW)).alias("doc"), F.when(ident.isNull(), -1 - tag).otherwise(tag).alias("tag"), text.alias("text"))


def repeats(rows: DataFrame, window: int) -> DataFrame:
    """``(doc, tag, start, n)``: runs of windows of ``rows(doc, tag, text)`` whose words start earlier."""
    met = rows.mapInArrow(partial(_segments, window=window), SEGMENT + ", later boolean").repartition("key").sortWithinPartitions("key", "seg", "sub", "doc", "start")
    met = stage(met.mapInArrow(_meet, SEGMENT + ", later boolean"))
    copies, open_ = met.where("later").select("doc", "tag", "start", "n"), met.where("not later")
    hot = stage(open_.groupBy("key").count().where(F.col("count") > HOT_SEGMENTS).select("key", F.lit(True).alias("hot")))
    n_hot = hot.count()
    if n_hot:
        open_ = open_.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "key", "left")
    else:
        open_ = open_.withColumn("hot", F.lit(False))
    wanted = open_.select("doc", "tag", F.struct("start", "n", "key", F.coalesce("hot", F.lit(False)).alias("hot")).alias("s"))
    wanted = wanted.groupBy("doc", "tag").agg(F.collect_list("s").alias("wanted"))
    asked = rows.join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "wanted")
    parts = asked.mapInArrow(partial(_extract, window=window), PARTS)
    shards = parts.repartition("deal").sortWithinPartitions("hot", "later", "key", "seg", "doc", "start")
    found = shards.mapInArrow(partial(_search, window=window), "doc long, tag int, start int, n int")
    return copies.union(found)


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)`` per row; kept: the words left, joined by one space.

    A word goes if a window that covers it has the words of a window with a
    smaller id, or the same id and an earlier start, in the input. Null and empty
    texts have no words. A null id counts as the smallest; rows with equal ids
    count as one document, so repeated rows do not remove one another. An empty
    table gives no rows; other columns are ignored.
    """
    rows = _numbered(docs, id_col, text_col)  # both joins take the same columns, so that the texts are exchanged once
    marks = repeats(rows, window).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    joined = rows.join(marks, ["doc", "tag"], "left").select("doc", "tag", "text", "marks")
    cut = joined.mapInArrow(partial(_cut, window=window), "doc long, tag int, n_words long, n_removed long, kept string")
    return cut.select(F.when(F.col("tag") >= 0, F.col("doc")).alias("id"), "n_words", "n_removed", "kept")
