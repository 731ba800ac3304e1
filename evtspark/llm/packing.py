"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised once and written with their length and their rank among
the task's documents of that length. Packing works on the histogram of lengths,
a table of at most ``seq_len`` counts at any corpus size: a sequence is filled
greedily with the longest documents that fit, then its smallest document is
replaced by the two unpacked ones that fill its expanded gap best, and the
finished pattern is used as often as the counts allow. Ranks then tell each
document its place.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evtspark.llm.common import chunks, stage

#: Words whose ids a worker keeps, from task to task; beyond it the memory starts anew.
CACHE_WORDS = 500_000
#: A word with an id of its own that parts the words of one call; words that hold it are encoded alone.
PART = "~"
#: Rows (length, task, number before) that are sent to every task; with more, the pieces are joined with them by an exchange.
BROADCAST_ROWS = 2_000_000
PIECES = "id long, piece int, start long, length int, ids binary, part int, nth long"


class Encoder:
    """Token ids of whole texts, word by word, for byte-level tokenizers that drop case and white space and keep runs of letters whole.

    Pieces of such a tokenizer never span white space, so a text's ids are those
    of its words in order. Each new word is encoded once, many to a call; a comma
    or full stop after a letter is a piece of its own.
    """

    def __init__(self, path: str) -> None:
        import os

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        # for words of letters alone the search for pieces is left out, for ASCII ones the normal form and byte letters too
        self.letters, self.ascii = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii.normalizer = normalizers.Sequence([])
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.part = self.ids(PART)
        self.known: dict[str, bytes] = {"": b""}
        self.ends = {c: self.ids(c) for c in (",", ".")}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Words of letters alone are one piece each, so their ids can be told apart in a call; others are parted by PART."""
        tailed, letters, others = [], [], []
        for w in new:
            core, end = w[:-1], self.ends.get(w[-1])
            if end and core.isalpha() and (core.isascii() or core.lower().isalpha()):
                tailed.append((w, core, end))
                if core not in self.known:
                    letters.append(core)
            elif w.isalpha() and (w.isascii() or w.lower().isalpha()):
                letters.append(w)
            elif PART in w or "<|" in w:
                self.known[w] = self.ids(w)
            else:
                others.append(w)
        letters = list(dict.fromkeys(letters))
        plain, wide = [w for w in letters if w.isascii()], [w for w in letters if not w.isascii()]
        for words, parted, tokenizer in ((plain, False, self.ascii), (wide, False, self.letters), (others, True, self.tokenizer)):
            calls = [words[k : k + 500] for k in range(0, len(words), 500)]
            coded = tokenizer.encode_batch_fast([(f" {PART} " if parted else " ").join(c) for c in calls], add_special_tokens=False)
            for call, code in zip(calls, coded, strict=True):
                self.store(call, np.array(code.ids, "<u4"), parted)
        for w, core, end in tailed:
            self.known[w] = self.known[core] + end

    def store(self, words: list[str], ids: np.ndarray, parted: bool) -> None:
        if parted:
            cut = np.flatnonzero(ids == np.frombuffer(self.part, "<u4")[0])
            first, last = [0, *((cut + 1) * 4).tolist()], [*(cut * 4).tolist(), 4 * len(ids)]
        else:
            last = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            first = [0, *last[:-1]]
        if len(first) != len(words):
            self.known.update((w, self.ids(w)) for w in words)
            return
        raw = ids.tobytes()
        self.known.update((w, raw[a:z]) for w, a, z in zip(words, first, last, strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned 32-bit ids of all texts in a row, and where each text's begin (one more than texts).

        ASCII case, which the tokenizer drops anyway, goes first. Arrow numbers the
        words, so all that follows is done once for each different word.
        """
        own = [(t.as_py() or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        words = pa.array(list(itertools.chain.from_iterable(own)), pa.binary()).dictionary_encode()
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        distinct, codes = [w.decode("utf-8", "surrogatepass") for w in words.dictionary.to_pylist()], words.indices.to_numpy(zero_copy_only=False)
        self.learn([w for w in distinct if w not in self.known])
        coded = [self.known[w] for w in distinct]
        pool, size = np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        begin, n = (np.cumsum(size) - size)[codes], size[codes]
        after = np.cumsum(n)
        ids = pool[np.repeat(begin - after + n, n) + np.arange(n.sum())]
        return ids, np.r_[0, after][np.r_[0, np.cumsum([len(o) for o in own])].astype(np.int64)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path)


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, seq_len: int, end_id: int) -> Iterator[pa.RecordBatch]:
    seen, part, end = np.zeros(seq_len + 1, np.int64), TaskContext.get().partitionId(), np.uint32(end_id).astype("<u4").tobytes()
    for batch in chunks(batches, 2048):
        out: list[tuple] = []
        flat, begins = encoder(path).encode(batch.column(1))
        for k_doc, doc in enumerate(batch.column(0).to_pylist()):
            ids = flat[begins[k_doc] : begins[k_doc + 1]].tobytes() + end
            for k, start in enumerate(range(0, len(ids) // 4, seq_len)):
                piece = ids[4 * start : 4 * (start + seq_len)]
                n = len(piece) // 4
                out.append((doc, k, start, n, piece, part, int(seen[n])))
                seen[n] += 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
        names = ["id", "piece", "start", "length", "ids", "part", "nth"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def patterns(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Packs ``counts[length]`` items into bins of ``len(counts) - 1``: (lengths of a bin, number of such bins)."""
    left, size, out = counts.astype(np.int64).copy(), len(counts) - 1, []
    left[0] = 0
    lengths = np.arange(size + 1)
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            return out
        take, gap = np.zeros(size + 1, np.int64), size
        while len(some) and gap:
            k = np.searchsorted(some, gap, "right")
            some = some[:k]
            if not k:
                break
            big = int(some[-1])
            n = min(gap // big, int(left[big]))
            take[big] += n
            gap -= n * big
            some = some[:-1]
        if gap:  # swap the smallest for two others that fill more
            small = int(np.flatnonzero(take)[0])
            free = left - take
            room = gap + small
            fits = np.maximum.accumulate(np.where(free > 0, lengths, 0))  # longest free length up to an index
            first = np.flatnonzero(free[: room + 1] > 0)
            second = fits[np.maximum(room - first, 0)]
            same = (second == first) & (free[first] < 2)
            second = np.where(same, fits[np.maximum(second - 1, 0)], second)
            both = np.where(second > 0, first + second, 0)
            if len(both) and both.max() > small and np.count_nonzero(take) + take.max() > 1:
                best = int(both.argmax())
                take[small] -= 1
                take[first[best]] += 1
                take[second[best]] += 1
        used = np.flatnonzero(take)
        times = int((left[used] // take[used]).min())
        left[used] -= take[used] * times
        out.append((np.repeat(used, take[used]).tolist(), times))


def layout(found: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks of each length: rank r of a run goes to sequence ``seq + r - rank`` at ``offset``."""
    rows, first, ranks = [], 0, {}
    for lengths, times in found:
        offset = 0
        for n in lengths:
            at = ranks.get(n, 0)
            rows.append((n, at, first, offset))
            ranks[n] = at + times
            offset += n
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "seq": table[:, 2], "offset": table[:, 3]}


def _place(batches: Iterator[pa.RecordBatch], runs: object) -> Iterator[pa.RecordBatch]:
    r = runs.value
    for batch in batches:
        length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
        # runs are sorted by (length, rank)
        start, stop = np.searchsorted(r["length"], length, "left"), np.searchsorted(r["length"], length, "right")
        at = np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(own):
                a, z = start[own[0]], stop[own[0]]
                at[own] = a + np.searchsorted(r["rank"][a:z], rank[own], "right") - 1
        seq = r["seq"][at] + rank - r["rank"][at]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(seq), pa.array(r["offset"][at])], names=["id", "piece", "start", "length", "ids", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids, sequence_id, offset)`` per piece of a document.

    ids: the piece's token ids, little-endian unsigned 32-bit, the document's last
    one being ``end_id``. Null and empty texts give the end id alone. Documents
    over ``seq_len`` tokens are cut into full pieces and a rest; repeated rows and
    null ids are packed like any other row. An empty table gives no rows; other
    columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    pieces = stage(rows.mapInArrow(partial(_tokenise, path=tokenizer_path, seq_len=seq_len, end_id=end_id), PIECES))
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = stage(per_part.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    counts = np.zeros(seq_len + 1, np.int64)
    for length, n in per_part.groupBy("length").agg(F.sum("n")).collect():  # at most seq_len rows
        counts[length] = n
    runs = docs.sparkSession.sparkContext.broadcast(layout(patterns(counts)))
    begins = per_part.select("length", "part", "before")
    begins = F.broadcast(begins) if per_part.count() <= BROADCAST_ROWS else begins
    ranked = pieces.join(begins, ["length", "part"]).select("id", "piece", "start", "length", "ids", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(partial(_place, runs=runs), "id long, piece int, start long, length int, ids binary, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences themselves."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
