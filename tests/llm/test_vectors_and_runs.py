"""Nearest neighbours, clustering and periodic runs held against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evtspark.llm import ann, centroids, queries, runs
from tests.conftest import DATA
from tests.llm.conftest import CLASHING, ODD
from tests.oracle import connection, difference

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, x string, cluster string, rank string, score string, h string, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *[None] * 9) for i, v in rows], VECTORS)


def odd_vectors(dim):
    """Nulls, zeros, other lengths, equal vectors, repeated rows and ids."""
    rng = random.Random(4)
    some = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(40)]
    rows = list(enumerate(some)) + [(100 + k, some[0]) for k in range(60)] + [(200, None), (201, [0.0] * dim), (202, [1.0] * (dim - 1)), (203, []), (204, [None] + [1.0] * (dim - 1))]
    return rows + [(205, [float("nan")] * dim), (206, [float("inf")] * dim), (None, some[3]), (20, some[20]), (20, some[20]), (40, [5 * x for x in some[1]])]


def plain_nearest(rows, k, is_query, dim):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v):
            own.setdefault(i, np.array(v, np.float32).astype(np.float64))
    ids = np.array(sorted(own))
    x = np.array([own[i] for i in ids])
    out = {}
    for q in (i for i in own if is_query(i)):
        score = (x * own[q]).sum(1)
        order = [p for p in np.lexsort((ids, -score)).tolist() if ids[p] != q][:k]
        out[q] = [(int(ids[p]), float(score[p])) for p in order]
    return out


def found_nearest(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_neighbours_recall(spark, sf):
    """The registered query: whole lists, exact scores, and nine in ten of the true neighbours at least."""
    data = DATA.replace("0.01", sf)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    df = queries.QUERIES["op11_nearest_neighbours"](spark, data)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in df.schema] == ["query_id bigint", "rank int", "vec_id bigint", "score double"]
    got, want = found_nearest(df), plain_nearest(rows, 20, lambda i: i % 20 == 0, 64)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 and q not in dict(got[q]) for q in want)
    x = {i: np.array(v, np.float64) for i, v in rows}
    assert all(s == pytest.approx(float(x[q] @ x[i]), abs=1e-12) for q, own in got.items() for i, s in own)
    assert all(own == sorted(own, key=lambda p: (-p[1], p[0])) for own in got.values())
    assert sum(len(dict(got[q]).keys() & dict(want[q]).keys()) for q in want) >= 0.95 * 20 * len(want)


def test_neighbours_in_blocks_of_a_crowd(spark, monkeypatch):
    """A third of the rows are near copies of one vector; many blocks; lengths differ: still nine in ten, and nearly all in the crowd."""
    monkeypatch.setattr(ann, "LEAST_ROWS", 400)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64)) * rng.uniform(0.5, 1.5, (3000, 1))
    x[:1000] = x[0] + 0.02 * rng.normal(size=(1000, 64))
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(3000), x, strict=True)]
    crowd = {i for i, _ in rows[:1000]}
    got, want = found_nearest(ann.nearest(frame(spark, rows), F.col("id") % 20 == 0)), plain_nearest(rows, 20, lambda i: i % 20 == 0, 64)
    hits = {q: len(dict(got[q]).keys() & dict(want[q]).keys()) / 20 for q in want}
    assert np.mean(list(hits.values())) >= 0.9 and np.mean([h for q, h in hits.items() if q in crowd]) >= 0.9


def test_neighbours_of_odd_rows(spark):
    """Fewer rows than the candidates asked for: exact, with ties to the smaller id."""
    rows = odd_vectors(64)
    got, want = found_nearest(ann.nearest(frame(spark, rows), F.col("id") % 20 == 0, k=20)), plain_nearest(rows, 20, lambda i: i % 20 == 0, 64)
    # id 40 stands once only, ids 20 three times with one vector
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = ann.nearest(frame(spark, rows[:3]), F.lit(True), k=20)
    assert {q: len(v) for q, v in found_nearest(few).items()} == {0: 2, 1: 2, 2: 2}
    assert ann.nearest(frame(spark, rows).limit(0), F.lit(True)).count() == 0 and ann.nearest(frame(spark, rows[:1]), F.lit(True)).count() == 0


def plain_clusters(rows, k, rounds, dim):
    own = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    now = [v for _, v in sorted(own, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now)) for _, v in own]
        if r < rounds:
            for n in range(len(now)):
                part = [v for (_, v), d in zip(own, near, strict=True) if d[1] == n]
                now[n] = [sum(c) // len(part) for c in zip(*part, strict=True)] if part else now[n]
    each = [sum(d for d, m in near if m == n) for n in range(len(now))]
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted((-1 if i is None else i, n, d, each[n], sum(each), told[n]) for (i, _), (d, n) in zip(own, near, strict=True))


def test_clusters_of_odd_rows(spark, tmp_path):
    """Repeated rows, ties between equal centroids, empty clusters, null ids and vectors; also the SQL."""
    rows = odd_vectors(64) + [(300 + k, [1.0] * 64) for k in range(30)]
    frame(spark, rows).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    df = queries.QUERIES["op12_centroid_clustering"](spark, f"file://{tmp_path}")
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())
    assert got == plain_clusters(rows, 8, 10, 64)
    assert centroids.cluster(frame(spark, rows).limit(0)).count() == 0
    assert len({r.cluster for r in centroids.cluster(frame(spark, rows[:3])).collect()}) == 3


def test_tree_finds_the_nearest_of_equals():
    rng = np.random.default_rng(6)
    for k in (1, 2, 7, 60):
        points = rng.integers(-2, 3, (k, 3)).tolist()
        x = rng.integers(-3, 4, (500, 3))
        number, square = centroids.VPTree(points).nearest(x)
        want = ((x[:, None] - np.array(points)[None]) ** 2).sum(2)
        assert (number == want.argmin(1)).all() and (square == want.min(1)).all()
    large = np.full((1, 64), 1 << 27)
    assert centroids.VPTree([(-large[0]).tolist()]).nearest(large)[1].tolist() == [64 << 56]


def plain_runs(text, least):
    """All maximal repetitions by their smallest period, from the equal places of every lag."""
    out = set()
    for q in range(1, len(text) // 2 + 1):
        i = 0
        while i + q < len(text):
            s = i
            while i + q < len(text) and text[i] == text[i + q]:
                i += 1
            n = i - s + q
            if i > s and n >= max(least, 2 * q) and not any(a <= s and s + n <= a + m and q % p == 0 for a, m, p in out):
                out.add((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_all_runs_hold_against_every_lag():
    rng = random.Random(7)
    for _ in range(1500):
        text = [rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 60))]
        assert list(map(tuple, runs.all_runs(text).tolist())) == plain_runs(text, 1)
    word = [1]
    for _ in range(14):  # a Fibonacci word has as many runs as words can
        word = [y for x in word for y in ((1, 2) if x == 1 else (1,))]
    assert list(map(tuple, runs.all_runs(word).tolist())) == plain_runs(word, 1)


def plain_row(i, text, least=12):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = plain_runs(w, least)
    gone = {p for s, n, q in found for p in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tail = (sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for p, x in enumerate(w) if p not in gone)))
    return (-1 if i is None else i, len(found), *(best[:1] + best[1:] + (1000 * best[1] // best[2],) if best else (None,) * 4), *tail)


def planted(i, text):
    w, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))


def row_of(r):
    return (-1 if r.doc_id is None else r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_runs_query_holds_against_every_lag(spark, tmp_path, doc_rows):
    rng = random.Random(8)
    rows = [(i, t) for i, t in doc_rows if len((t or "").split()) < 400][:300] + [(i, t) for i, t in ODD if i != 9]
    rows += [(2000 + k, " ".join((rng.choices("abcdefgh", k=rng.randint(1, 30)) * 20)[: rng.randint(1, 150)] + rng.choices("abc", k=40))) for k in range(150)]
    rows += [(5000 + k, "dup tail words " + "one two three four five six " * 8) for k in range(20)]
    data = [(i, t, *[1] * 10) for i, t in rows]
    spark.createDataFrame([(i, t, None, *"abcdefghi") for i, t, *_ in data], CLASHING).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = [row_of(r) for r in queries.QUERIES["op13_periodic_runs"](spark, f"file://{tmp_path}").collect()]
    want = [plain_row(i, planted(i, t)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] > 0 for r in want) > 100


def test_runs_of_long_and_empty_texts(spark, none):
    half = [f"w{k}" for k in range(30_000)]
    rows = [(1, "word " * 20_000), (2, " ".join(half * 2)), (3, " ".join(half)), (4, ("x" * 100_000 + " ") * 30)]
    got = {r.id: (r.n_words, [tuple(x) for x in r.runs], len(r.collapsed.split())) for r in runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (20_000, [(0, 20_000, 1)], 1), 2: (60_000, [(0, 60_000, 30_000)], 30_000), 3: (30_000, [], 30_000), 4: (30, [(0, 30, 1)], 1)}
    assert runs.find_runs(none).count() == 0
