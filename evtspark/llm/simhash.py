"""SimHash near-duplicate classes by the generalised pigeonhole principle.

Two 64-bit fingerprints at Hamming distance d or less must, for bit groups with
thresholds t_1..t_m where sum(t_i + 1) = d + 1, be within t_i in some group i.
Correlated bits share a group, the thresholds come from a dynamic program over
candidate counts estimated from whole-corpus histograms, groups are probed
within their threshold and every candidate is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtspark.llm.common import chunks, mix, stage, words
from evtspark.llm.components import components, local_roots

BITS = 64
#: Bit groups and their width: histograms of a group have 2**16 cells at any corpus size.
GROUPS, WIDTH = 4, 16
#: Largest probe radius of a group, which bounds the distance at GROUPS * (MAX_RADIUS + 1) - 1.
MAX_RADIUS = 6
#: Bits beyond the sure distance up to which pairs that meet are held against the texts: texts of similarity 0.8 differ in
#: 9.7 of 64 bits on average, with a deviation of 2.9.
MARGIN = 4
#: Bits of their sketches in which pairs that are held against the texts may differ; four deviations over the average at similarity 0.8.
SKETCH_BITS = 16
#: Texts that are looked up by a table sent to every task; with more, by an exchange.
BROADCAST_ROWS = 2_000_000
#: Fingerprints of one side of a comparison cell; larger buckets are cut into such cells.
CELL = 2048
#: Texts of one side of a cell whose texts are all held against each other; larger knots are cut into such cells.
KNOT_BLOCK = 1024
#: Shingles of a cell that are multiplied at a time.
COLUMNS = 1024
#: The id that null ids are read as where a text's row is sought.
LOW = -(1 << 63)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, A-Z lower-cased; all words if fewer."""
    import xxhash

    w = [x.lower() for x in words(text)]
    if not w:
        return np.empty(0, np.uint64)
    joined = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in joined), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes; 0 without hashes. Signed 64-bit."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def sketch(hashes: np.ndarray) -> int:
    """One bit of the least shingle of each of 64 bins (0 for an empty bin). Signed 64-bit.

    A bin differs between two texts if their least shingles do, and its bit then every
    second time: of texts of similarity 0.8, 6.4 bits on average, with a deviation of 2.4.
    """
    least = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (hashes & np.uint64(63)).astype(np.int64), mix(hashes))
    bits = ((least >> np.uint64(5)) & np.uint64(1)).astype(bool) & (least != np.iinfo(np.uint64).max)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int, sketched: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        *own, texts = batch.columns
        hashes = [shingle_hashes(x.as_py(), width) for x in texts]
        cols, names = [pa.array([fingerprint(h) for h in hashes], pa.int64())], ["fp"]
        if sketched:
            cols, names = [*cols, pa.array([sketch(h) for h in hashes], pa.int64())], [*names, "sk"]
        yield pa.RecordBatch.from_arrays([*own, *cols], names=[*batch.schema.names[:-1], *names])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` per row; null and empty texts have fingerprint 0. Other columns are not read."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprint_batches, width=width), "id long, fp long")


# -- statistics of all fingerprints: tables of fixed size --------------------------------------


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _cooccurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for batch in chunks(batches, 65536):
        x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        total += (x.T @ x).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["cell", "n"])


def group_bits(both: np.ndarray, n: int) -> list[list[int]]:
    """GROUPS groups of WIDTH bits; the next bit of a group is the one most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for _ in range(GROUPS):
        rest = sorted(free)
        group = [max(rest, key=lambda b: (corr[b, rest].max(), -b))]
        free.remove(group[0])
        while len(group) < WIDTH:
            nxt = max(sorted(free), key=lambda b: (corr[b, group].mean(), -b))
            group.append(nxt)
            free.remove(nxt)
        out.append(sorted(group))
    return out


def group_values(fps: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    bits = _bits(fps)
    weights = 1 << np.arange(WIDTH, dtype=np.int64)
    return np.stack([bits[:, g].astype(np.int64) @ weights for g in groups], axis=1)


def _histogram(batches: Iterator[pa.RecordBatch], groups: list[list[int]]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((GROUPS, 1 << WIDTH), np.int64)
    for batch in chunks(batches, 65536):
        values = group_values(batch.column(0).to_numpy(zero_copy_only=False), groups)
        for g in range(GROUPS):
            total[g] += np.bincount(values[:, g], minlength=1 << WIDTH)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "n"])


def ball(radius: int) -> np.ndarray:
    """Masks of WIDTH bits with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(WIDTH), r)], np.int64)


def around(counts: np.ndarray, radius: int) -> np.ndarray:
    """For each group and value, the fingerprints with a value in the ball around it."""
    values = np.arange(1 << WIDTH)
    return sum(counts[:, values ^ m] for m in ball(radius))


def allocate(hist: np.ndarray, distance: int) -> list[int]:
    """Probe radius of each group (-1: not probed), with sum(radius + 1) = distance + 1.

    Dynamic program over groups; a group's cost at a radius is its estimated
    number of candidates plus the rows that are dealt out for it.
    """
    n = hist[0].sum()
    cost = np.full((GROUPS, distance + 2), np.inf)
    cost[:, 0] = 0
    for radius in range(min(distance, MAX_RADIUS) + 1):
        index, probe = radius // 2, radius - radius // 2
        pairs = (around(hist, index).astype(float) * around(hist, probe)).sum(axis=1)
        rows = len(ball(index)) + (len(ball(probe)) if radius % 2 else 0)
        cost[:, radius + 1] = pairs / 100 + n * rows
    best = {0: (0.0, [])}
    for g in range(GROUPS):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, radii) in best.items():
            for a in range(distance + 2 - used):
                found = (c + cost[g, a], [*radii, a - 1])
                if used + a not in step or found[0] < step[used + a][0]:
                    step[used + a] = found
        best = step
    return best[distance + 1][1]


# -- probing and verification ---------------------------------------------------------------------


def _deal(batches: Iterator[pa.RecordBatch], groups: list[list[int]], radii: list[int], tables: object) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, side, fp, further columns): the comparison cells that a fingerprint takes part in.

    Two values within radius r meet where the ball of r // 2 around one meets the
    ball of r - r // 2 around the other. For even r both are the same rows, whose
    blocks meet pairwise (side 3: both sides of one block); for odd r, side 1 is
    the index and side 2 the probe. Blocks are dealt by the last column, which
    tells the rows apart.
    """
    index, probe = tables.value
    for batch in chunks(batches, 4096):
        own_cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        names = ["key", "cell", "side", *batch.schema.names]
        fps = own_cols[0]
        values = group_values(fps, groups)
        mixed = (own_cols[-1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        for g, radius in enumerate(radii):
            if radius < 0:
                continue
            sides = [(1, ball(radius // 2))] + [(2, ball(radius - radius // 2))] * (radius % 2)
            for side, masks in sides:
                for mask in masks:
                    v = values[:, g] ^ mask
                    own, other = -(-index[g][v] // CELL), -(-probe[g][v] // CELL)
                    some = np.flatnonzero((own > 0) & (other > 0))
                    v, own, other = v[some], own[some], other[some]
                    blocks, copies = (own, other) if side == 1 else (other, own)
                    block = (mixed[some] % blocks.astype(np.uint64)).astype(np.int64)
                    row = np.repeat(np.arange(len(some)), copies)
                    to = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                    b, o, c = block[row], own[row], other[row]
                    if radius % 2:
                        cell, s = (b * c + to, 1) if side == 1 else (to * c + b, 2)
                        s = np.full(len(row), s)
                    else:  # block b meets every block; cell (low, high)
                        cell = np.minimum(b, to) * o + np.maximum(b, to)
                        s = np.where(b == to, 3, np.where(b < to, 1, 2))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((g << WIDTH) | v[row]), pa.array(cell.astype(np.int32)), pa.array(s.astype(np.int8)), *(pa.array(x[some][row]) for x in own_cols)], names=names
                    )


def _nearest_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a minimum spanning forest: every part takes its lightest link out, until none is left."""
    order = np.argsort(weight, kind="stable")
    a, b, root, taken = a[order], b[order], np.arange(n), []
    left = np.arange(len(a))
    while len(left):
        left = left[root[a[left]] != root[b[left]]]
        ends = np.concatenate([root[a[left]], root[b[left]]])
        least = np.full(n, len(a))
        np.minimum.at(least, ends, np.concatenate([left, left]))
        chosen = np.unique(least[least < len(a)])
        taken.append(chosen)
        root = local_roots(n, np.concatenate([a[chosen], np.arange(n)]), np.concatenate([b[chosen], root]))
    took = np.concatenate(taken) if taken else np.empty(0, np.int64)
    return a[took], b[took]


def _forest(rows: np.ndarray, distance: int, mode: str, sketched: bool) -> pa.RecordBatch:
    """Links that join what the verified pairs of whole cells join, rows (key, side, fp, further columns) sorted by cell.

    ``first``: each fingerprint is linked with the first one that pairs lead to.
    ``nearest``: links are such pairs of nodes (the last column) themselves, the
    nearest ones. ``parts``: as ``first``, for pairs whose ``part`` (the column before) differs.
    ``sketched``: the column after fp is a sketch, and pairs must be near by it too.
    """
    key, side, fp, node = rows[0], rows[1], rows[2], rows[-1]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    end = np.repeat(starts + size, size)
    at, left, right = np.arange(len(key)), [], []
    for shift in range(1, int(size.max(initial=1))):
        at = at[at + shift < end[at]]
        a, b = at, at + shift
        near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= distance
        a, b = a[near], b[near]
        if sketched:
            near = np.bitwise_count((rows[3][a] ^ rows[3][b]).view(np.uint64)) <= SKETCH_BITS
            a, b = a[near], b[near]
        cross = ((side[a] != side[b]) | (side[a] == 3)) & (node[a] != node[b])
        if mode == "parts":
            cross &= rows[-2][a] != rows[-2][b]
        left.append(a[cross])
        right.append(b[cross])
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    if mode == "nearest":
        a, b = _nearest_forest(len(fp), a, b, np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)))
    else:
        root = local_roots(len(fp), a, b)
        a = np.flatnonzero(root != np.arange(len(fp)))
        b = root[a]
    return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["u", "v"])


def _verify(batches: Iterator[pa.RecordBatch], distance: int, mode: str, sketched: bool) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by cell; a cell that goes on in the next batch waits for it."""
    kept: list[np.ndarray] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = np.stack([cols[0] << 24 | cols[1], cols[2].astype(np.int64), *cols[3:]])
        kept.append(rows)
        last = rows[0, -1]
        whole = int(np.searchsorted(rows[0], last)) if rows[0, 0] != last else 0
        if whole:
            ready = np.concatenate([*kept[:-1], rows[:, :whole]], axis=1)
            kept = [rows[:, whole:]]
            yield _forest(ready, distance, mode, sketched)
        elif kept[0][0, 0] != last:  # the batch is one cell and an older one waits
            yield _forest(np.concatenate(kept[:-1], axis=1), distance, mode, sketched)
            kept = [rows]
    if kept:
        yield _forest(np.concatenate(kept, axis=1), distance, mode, sketched)


def _table(df: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sums the tasks' counts in Spark; at most shape[0] * shape[1] rows reach the driver."""
    got = df.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(shape[0] * shape[1], np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(shape)


def links(prints: DataFrame, distance: int, nearest: bool = False, accept: int | None = None) -> DataFrame:
    """``(u, v)``: links between rows of ``prints`` whose fingerprints are within ``distance``.

    With ``accept``, a larger distance, pairs that the probes bring together are links up
    to that distance: all pairs within ``distance``, and most of those a little beyond.

    ``prints(fp)``, distinct: links connect the fingerprints just as all such pairs
    would; with ``nearest`` they are such pairs themselves. ``prints(fp, node)``: the
    same between nodes. ``prints(fp, part, node)``: links connect nodes just as all such
    pairs of nodes of different parts would. With ``sk`` after ``fp``, pairs must be near by
    their sketches too.
    """
    mode = "parts" if "part" in prints.columns else "nearest" if nearest else "first"
    further = "".join(f", {c} long" for c in prints.columns[1:])
    spark = prints.sparkSession
    only = prints.select("fp")
    both = _table(only.mapInArrow(_cooccurrence, "cell long, n long"), (BITS, BITS))
    if distance >= GROUPS * (MAX_RADIUS + 1):
        raise ValueError(f"distances over {GROUPS * (MAX_RADIUS + 1) - 1} need probes of more than {MAX_RADIUS} bits a group")
    n = prints.count()
    groups = group_bits(both, n)
    hist = _table(only.mapInArrow(partial(_histogram, groups=groups), "cell long, n long"), (GROUPS, 1 << WIDTH))
    radii = allocate(hist, distance)
    index = np.stack([around(hist[g : g + 1], max(r, 0) // 2)[0] for g, r in enumerate(radii)])
    probe = np.stack([around(hist[g : g + 1], max(r, 0) - max(r, 0) // 2)[0] for g, r in enumerate(radii)])
    tables = spark.sparkContext.broadcast((index, probe))  # 2 x 4 x 65536 counts, whatever the corpus
    dealt = prints.mapInArrow(partial(_deal, groups=groups, radii=radii, tables=tables), "key long, cell int, side byte, fp long" + further)
    cells = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return cells.mapInArrow(partial(_verify, distance=accept or distance, mode=mode, sketched="sk" in prints.columns), "u long, v long")


def _shingle_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, 128):
        sets = [np.unique(shingle_hashes(x.as_py(), width)).view(np.int64) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _key(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(LOW))


def shingle_sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(node, set)`` for ``nodes(node, key)``: the shingles of the text with hash ``node``, read from the row with id ``key``."""
    text = docs[text_col].cast("string")
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    rows = docs.select(_hash(text).alias("node"), _key(docs[id_col]).alias("key"), text.alias("text")).join(nodes, ["node", "key"])
    rows = rows.dropDuplicates(["node", "key"]).select("node", "text")  # rows repeated in the input
    return stage(rows.mapInArrow(partial(_shingle_sets, width=width), "node long, set array<long>"))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs(u, v)`` whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    both = pairs.join(sets.withColumnsRenamed({"node": "u", "set": "a"}), "u").join(sets.withColumnsRenamed({"node": "v", "set": "b"}), "v")
    common = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - common
    return both.where((common >= similarity * union) | (union == 0)).select("u", "v")


def _similar_in_cell(rows: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the texts of a cell as all its similar pairs of different parts would; shared shingles are counted by matrix products."""
    side, part, node = (rows.column(c).to_numpy() for c in ("side", "part", "node"))
    sets = rows.column("set").combine_chunks()
    size = np.diff(sets.offsets.to_numpy())
    _, column, count = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(node)), size), count > 1
    owner, column = owner[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, z = np.searchsorted(column, (low, low + COLUMNS))
        held = np.zeros((len(node), column[z - 1] + 1 - low), np.float32)
        held[owner[a:z], column[a:z] - low] = 1
        common += held[left] @ held[right].T
    union = size[left][:, None] + size[right] - common.astype(np.float64)
    a, b = np.nonzero((common >= similarity * union) & (part[left][:, None] != part[right]))
    root = local_roots(len(node), left[a], right[b])
    joined = np.flatnonzero(root != np.arange(len(node)))
    return node[joined], node[root[joined]]


def _similar_in_cells(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Reads rows (knot, cell, side, part, node, set) sorted by knot and cell; a cell that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    last = None

    def linked(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        knot, cell = (batch.column(k).to_numpy() for k in (0, 1))
        cut = (np.flatnonzero((knot[1:] != knot[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist()
        found = []
        for a, z in zip([0, *cut], [*cut, len(knot)], strict=True):
            if a == z:
                continue
            if held and last != (knot[a], cell[a]):
                found.append(_similar_in_cell(pa.Table.from_batches(held), similarity))
                held = []
            held.append(batch.slice(a, z - a))
            last = (knot[a], cell[a])
        yield linked(found)
    if held:
        yield linked([_similar_in_cell(pa.Table.from_batches(held), similarity)])


def similar_in_knots(parts: DataFrame, met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(u, v)``: links that join the texts ``parts(part, node)`` of a knot, texts that links ``met`` join, as all its similar pairs of different parts would.

    All texts of a knot are held against each other, in cells of two blocks of about
    KNOT_BLOCK texts; no pair is a row, and a text is sent as often as its knot has blocks.
    """
    knots = stage(components(met))
    large = knots.groupBy("root").agg(F.ceil(F.count("*") / KNOT_BLOCK).alias("blocks")).where("blocks > 1")
    rows = knots.join(large, "root", "left").join(parts.select("part", "node"), "node").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("to"), 3).when(F.col("own") < F.col("to"), 1).otherwise(2)
    cell = F.least("own", "to") * F.col("blocks") + F.greatest("own", "to")
    dealt = rows.select(F.col("root").alias("knot"), cell.alias("cell"), side.alias("side"), "part", "node").join(sets, "node")
    dealt = dealt.select("knot", "cell", "side", "part", "node", "set").repartition("knot", "cell").sortWithinPartitions("knot", "cell")
    return dealt.mapInArrow(partial(_similar_in_cells, similarity=similarity), "u long, v long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar_links(texts: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, distance: int, similarity: float) -> DataFrame:
    """``(u, v)``: links that join the texts ``texts(fp, node, key)``, with or without sketches ``sk``, just as all similar pairs within ``distance`` would.

    First the nearest links that join a group are held against the texts. What they
    leave apart is met again, and all texts that candidate pairs between two parts join
    are held against each other, so that no pair is passed over for a lighter one that fails.
    Pairs up to MARGIN bits beyond are tried where the probes bring them together.
    """
    accept, prints = distance + MARGIN, ["fp", *(c for c in texts.columns if c == "sk")]
    first = stage(_ordered(links(texts.select(*prints, "node"), distance, nearest=True, accept=accept)))
    met = first.select(F.col("u").alias("node")).union(first.select("v")).distinct()
    known = stage(texts.join(met, "node"))
    sets = shingle_sets(known.select("node", "key"), docs, id_col, text_col, width)
    good = stage(similar(first, sets, similarity))
    parts = stage(known.join(components(good), "node", "left").select(*prints, F.coalesce("root", F.xxhash64("node")).alias("part"), "node"))
    met = stage(_ordered(links(parts, distance, accept=accept)))
    return stage(good.union(similar_in_knots(parts, met, sets, similarity)))


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(id, hash, fp)`` per row, and ``(hash, part, id)`` per different text: the name of its class and its smallest id."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), _hash(docs[text_col]).alias("hash"), docs[text_col].cast("string").alias("text"))
    prints = stage(rows.mapInArrow(partial(_fingerprint_batches, width=width, sketched=True), "id long, hash long, fp long, sk long"))
    texts = stage(prints.groupBy(F.col("hash").alias("node"), "fp", "sk").agg(F.min(_key(F.col("id"))).alias("key"), F.min("id").alias("id")))
    roots = components(similar_links(texts.select("fp", "sk", "node", "key"), docs, id_col, text_col, width, distance, similarity))
    # the root of a linked text is the hash of a linked node, as that of a text alone is its own
    named = texts.join(roots, "node", "left").select(F.col("node").alias("hash"), F.coalesce("root", F.xxhash64("node")).alias("part"), "id")
    return prints, stage(named)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, similarity: float | None = None) -> DataFrame:
    """``(id, fp, component)`` for each row of ``docs``.

    Rows are linked if their fingerprints differ in at most ``distance`` bits;
    ``component`` is the smallest id that links reach. With ``similarity``, rows are
    linked if besides their texts have that Jaccard similarity of shingle sets,
    those of equal fingerprints too, and some MARGIN bits beyond ``distance``. Null and empty texts have fingerprint 0 and are
    linked like any other; repeated rows come back as often as they went in; null
    ids are kept and never name a component unless it has no other id. An empty
    table gives no rows; other columns are ignored.
    """
    if similarity is not None:
        prints, texts = _classes(docs, id_col, text_col, width, distance, similarity)
        named = texts.join(texts.groupBy("part").agg(F.min("id").alias("component")), "part").select("hash", "component")
        return prints.join(named, "hash").select("id", "fp", "component")
    prints = stage(fingerprints(docs, id_col, text_col, width))
    distinct = stage(prints.groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(links(distinct.select("fp"), distance))
    linked = stage(distinct.join(roots.withColumnRenamed("node", "fp"), "fp"))
    least = linked.groupBy("root").agg(F.min("id").alias("component"))
    named = linked.join(least, "root").select("fp", "component")
    known = distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "id").alias("component"))
    return prints.join(known, "fp").select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, distance: int = 11, similarity: float = 0.8) -> DataFrame:
    """One row of each near-duplicate class, that of the smallest id; of rows of the class with that id, the first text. All columns stay.

    Rows with one id and texts of different classes are told apart. Rows with a
    null id are kept: they cannot be told apart.
    """
    _, texts = _classes(docs, id_col, text_col, width, distance, similarity)  # copies are one row here, however many they are
    first = texts.where("id IS NOT NULL").groupBy("part").agg(F.min(F.struct("id", "hash")).alias("x")).select(F.col("x.id").alias("_id"), F.col("x.hash").alias("_hash"))
    named = docs.where(F.col(id_col).isNotNull()).withColumn("_text", _hash(docs[text_col]))
    kept = named.join(first, (F.col(id_col).cast("long") == F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates([id_col, "_text"]).drop("_text").unionByName(docs.where(F.col(id_col).isNull()))
