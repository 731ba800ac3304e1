"""Operators held against plain Python on the small tables and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evtspark.llm import chat, decontaminate, html_text, packing, pii, quality, queries, sharding, simhash, substring, toxicity
from tests.conftest import DATA
from tests.llm.conftest import ODD
from tests.oracle import connection, difference


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert (found := difference(queries.QUERIES[name](spark, DATA), connection(DATA), queries.ORACLE_SQL[name])) is None, found


# -- 1 SimHash -------------------------------------------------------------------------------------


def plain_print(text, width=3):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints, distance):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted(root)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in items}


@pytest.mark.parametrize("distance", [3, 6, 11])
def test_simhash_classes(spark, doc_rows, distance):
    rows = doc_rows[:250] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df, distance=distance).collect()
    prints = {(i, t): plain_print(t) for i, t in rows}
    classes = plain_classes(set(prints.values()), distance)
    least = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[classes[f]] = min(least.get(classes[f], i), i)
    want = sorted((i or -1, prints[i, t], least.get(classes[prints[i, t]])or -1) for i, t in rows)
    assert sorted((r.id or -1, r.fp & (1 << 64) - 1, r.component or -1) for r in got) == want


def test_simhash_large_bucket_is_cut(spark, monkeypatch):
    """Fingerprints that crowd one bucket meet in many cells and lose no link."""
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from evtspark.llm.components import components

    for nearest in (False, True):
        got = {r.node & (1 << 64) - 1: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, nearest)).collect()}
        want = plain_classes(set(fps), 3)
        groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))  # noqa: B023, E731
        assert [g for g in groups(want) if len(g) > 1] == groups(got)


def test_similarity_keeps_near_copies_only(spark, doc_rows):
    rng = random.Random(5)
    rows = []
    for k, (_, t) in enumerate([x for x in doc_rows if len((x[1] or "").split()) > 150][:60]):
        w = t.split()
        rows.append((10 * k, t))
        w[rng.randrange(len(w))] = "changed"
        rows.append((10 * k + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert sum(10 * k + 1 in kept for k in range(60)) <= 2
    shingles = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    for i, _ in rows:
        if i not in kept:
            assert any(j in kept and len(shingles[i] & shingles[j]) >= 0.75 * len(shingles[i] | shingles[j]) for j, _ in rows if j != i)


def test_similarity_tests_every_candidate(spark):
    """A-B and B-C are the nearest pairs and not similar, A-C is; D has A's fingerprint and nothing of its text, E has both nearly."""
    common, own = [f"w{k}" for k in range(85)], lambda name: [f"{name}{k}" for k in range(10)]
    texts = {
        "A": [*common, *own("ac")[:5], *own("a")], "C": [*common, *own("ac")[:5], *own("c")], "B": [*common, *own("b"), *own("bb")[:5]],
        "D": [f"d{k}" for k in range(100)], "E": [*common, *own("ac")[:5], *own("a")[:9], "e"],
    }
    prints = {"A": 0, "B": 0b11111, "C": 0b1111 << 5 | 0b111, "D": 0, "E": 0}
    df = spark.createDataFrame([(k, " ".join(texts[n]), n) for k, n in enumerate("ABCDE")], "doc_id long, text string, name string")
    nodes = {r.name: r.node for r in df.select("name", F.xxhash64("text").alias("node")).collect()}
    table = spark.createDataFrame([(prints[n], nodes[n], k) for k, n in enumerate("ABCDE")], "fp long, node long, key long")
    from evtspark.llm.components import components

    root = {r.node: r.root for r in components(simhash.similar_links(table, df, "doc_id", "text", 1, 11, 0.8)).collect()}
    assert root[nodes["A"]] == root[nodes["C"]] == root[nodes["E"]]
    assert nodes["B"] not in root and nodes["D"] not in root


def test_similar_pairs_are_not_left_standing(spark, docs, doc_rows):
    """Brute force over all pairs of the small table, at the distance that the pipeline runs."""
    rows = [(i, t) for i, t in doc_rows if t]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, width=5, distance=11, similarity=0.8).select("doc_id").collect()}
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    holders = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    met = {(a, b) for own in holders.values() if len(own) <= 200 for k, a in enumerate(own) for b in own[k + 1 :]}
    pairs = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 50 and sum(a in kept and b in kept for a, b in pairs) <= 0.02 * len(pairs)
    for i in sets.keys() - kept:  # nothing goes without a similar text
        assert any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets if j != i)


def test_near_copies_go_by_id_and_text(spark):
    one, two = (" ".join(f"{p}{k}" for k in range(60)) for p in "xy")
    df = spark.createDataFrame([(7, one), (7, two), (8, two), (9, one), (9, one), (None, one)], "doc_id long, text string")
    got = simhash.drop_near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(7, one), (7, two), (0, one)])


# -- 2 Decontamination -----------------------------------------------------------------------------


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_leaks_with_edits(spark, doc_rows):
    rng = random.Random(1)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    vocabulary = " ".join(t or "" for _, t in doc_rows[:50]).split()
    rows, planted = [], {}
    for k in range(300):  # every item at the limit of its edits
        item = rng.choice(sorted(items))
        w = items[item].split()
        for _ in range(len(decontaminate.tokens(items[item])) // 5):
            p, kind = rng.randrange(len(w)), rng.random()
            w[p : p + (kind < 0.66)] = [] if kind < 0.33 else [rng.choice(vocabulary)]
        body = rng.choices(vocabulary, k=rng.randint(0, 300))
        p = rng.randrange(len(body) + 1)
        rows.append((k, " ".join(body[:p] + w + body[p:])))
        planted[k] = item
    clean = [(1000 + k, " ".join(rng.choices(vocabulary, k=200))) for k in range(100)]
    got = decontaminate.leaks(spark.createDataFrame(rows + clean, "doc_id long, text string"), bench).collect()
    found = {(r.id, r.item): r for r in got}
    assert sum((k, i) in found for k, i in planted.items()) >= 0.98 * len(planted)
    texts = dict(rows)
    for (k, i), r in found.items():
        assert k < 1000
        part = decontaminate.tokens(" ".join(texts[k].split()[r.start : r.stop]))
        assert edit(decontaminate.tokens(items[i]), part) == r.edits <= len(items[i].split()) // 5


def test_leaks_come_from_shared_buckets(doc_rows):
    """An index whose buckets hold nothing finds nothing; every occurrence is reported; texts do not run into one another."""
    rng = random.Random(2)
    vocabulary = " ".join(t or "" for _, t in doc_rows[:50]).split()
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate((1, 3, 7, 15, 40, 100, 400))]
    long = [t for _, t in items[3:]]
    texts = [" ".join([long[k % 4], *rng.choices(vocabulary, k=30), long[(k + 1) % 4], long[k % 4]]) for k in range(8)]
    half = long[1].split()
    texts += [" ".join(half[:20]), None, " ".join(half[20:]), ""]
    index = decontaminate.Index(items)
    found = [m for m in index.matches(texts) if m[1] > 2]
    assert sorted(m[:2] for m in found) == sorted((k, 3 + j % 4) for k in range(8) for j in (k, k + 1, k)) and all(m[4] == 0 for m in found)
    assert {m[1] for m in index.matches([items[0][1], items[1][1], items[2][1]])} >= {0, 1, 2}
    index.some[:] = False
    assert index.matches(texts) == []


def test_occurrences_hold_against_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        item, region = (np.array(rng.choices(range(4), k=n), np.uint64) for n in (rng.randint(3, 8), rng.randint(0, 20)))
        most, got = 2, decontaminate.occurrences(item, region, 2)
        best = {(a, z): edit(item.tolist(), region[a:z].tolist()) for a in range(len(region)) for z in range(a + 1, len(region) + 1)}
        assert all(best[a, z] == e <= most for e, a, z in got)
        assert all(x[2] <= y[1] for x, y in zip(got, got[1:]))
        exact = {k for k, e in best.items() if e == 0}
        assert all(any(a < z2 and a2 < z for _, a2, z2 in got) for a, z in exact)
        assert min(best.values(), default=9) > most or min(e for e, _, _ in got) == min(best.values())


def test_leaks_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (4, "no id at all")], "item_id long, text string")
    got = decontaminate.leaks(odd, bench).collect()
    assert {(r.id, r.item) for r in got} == {(5, 1), (None, 4)}
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, bench).count() == len(ODD) - 3


# -- 3 Substring dedup ------------------------------------------------------------------------------


def plain_repeats(rows, window):
    seen, out = {}, []
    ordered = sorted(range(len(rows)), key=lambda k: rows[k][0] if rows[k][0] is not None else -(1 << 63))
    texts = {k: re.findall(rb"[^\x20\x09-\x0D]+", (rows[k][1] or "").encode()) for k in ordered}
    for k in ordered:
        place = rows[k][0] if rows[k][0] is not None else -(1 << 63)
        for s in range(len(texts[k]) - window + 1):
            g = tuple(texts[k][s : s + window])
            seen[g] = min(seen.get(g, (place, s)), (place, s))
    for k in ordered:
        w, place = texts[k], rows[k][0] if rows[k][0] is not None else -(1 << 63)
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] < (place, s):
                gone[s : s + window] = True
        out.append((rows[k][0], len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def planted_passages(seed=7, n=300):
    """Documents from a small vocabulary with shared passages, near copies and copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    passages = [rng.choices(vocabulary, k=rng.randint(15, 90)) for _ in range(6)]
    rows = []
    for k in range(n):
        w = rng.choices(vocabulary, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            a = rng.randrange(len(w) + 1)
            w[a:a] = p
        rows.append((k if rng.random() < 0.98 else rng.randrange(k + 1), " ".join(w)))
        if rng.random() < 0.1:
            rows.append((n + k, rows[-1][1]))
    return rows


@pytest.mark.parametrize("hot", [20_000, 5])
def test_substring_planted(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_SEGMENTS", hot)
    rows = planted_passages() + ODD
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    key = lambda r: (str(r[0]), r[3], r[2])
    assert sorted([tuple(r) for r in got], key=key) == sorted(plain_repeats(rows, 20), key=key)


def test_substring_hot_windows_are_not_held(spark, monkeypatch):
    """Copies of a passage in ever new surroundings: a search that may hold no word of them still marks all but the first."""
    monkeypatch.setattr(substring, "HOT_SEGMENTS", 5)
    monkeypatch.setattr(substring, "CHUNK_WINDOWS", 64)
    passage = [f"p{k}" for k in range(40)]
    rows = [(d, " ".join([f"a{d}x{k}" for k in range(25)] + passage + [f"b{d}x{k}" for k in range(25)])) for d in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = []
    search = substring.repeats_in_shard
    monkeypatch.setattr(substring, "repeats_in_shard", lambda segments, window: sizes.append(len(segments)) or search(segments, window))
    asked = df.select(F.col("doc_id").alias("doc"), F.lit(0).alias("tag"), "text", F.array(F.struct(F.lit(6).alias("start"), F.lit(59).alias("n"), F.lit(1).cast("long").alias("key"), F.lit(True).alias("hot"))).alias("wanted"))
    parts = [b for p in range(4) for b in substring._extract(iter(asked.where(F.col("doc") % 4 == p).toArrow().to_batches()), 20)]
    table = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in ("hot", "later", "key", "seg", "doc", "start")])
    assert sum(not x for x in table.column("later").to_pylist()) < table.num_rows
    found = []
    for size in (7, 1000):
        found.append(sorted(x for b in substring._search(iter(table.combine_chunks().to_batches(size)), 20) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)))
    assert found[0] == found[1] == sorted((d, 0, 25 + k, 1) for d in range(1, 400) for k in range(21))
    assert not sizes
    key = lambda r: (str(r[0]), r[3], r[2])
    assert sorted([tuple(r) for r in substring.remove_repeats(df).collect()], key=key) == sorted(plain_repeats(rows, 20), key=key)


def test_meet_across_batches():
    """The streaming pass over sorted segments gives the same rows however they are cut into batches."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    s = {"key": rng.integers(0, 8, 200), "seg": rng.integers(0, 2, 200), "sub": rng.integers(0, 2, 200), "doc": rng.integers(0, 30, 200), "tag": np.zeros(200, np.int32), "start": rng.integers(0, 4, 200).astype(np.int32), "n": np.ones(200, np.int32)}
    s, _, _ = substring._settle(s)
    whole = substring._batch(s, later=np.zeros(200, bool))
    results = []
    for size in (200, 1, 3, 17):
        parts = [whole.slice(k, size) for k in range(0, 200, size)]
        out = [x for b in substring._meet(iter(parts)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        results.append(sorted(set(out)))
    assert all(r == results[0] for r in results)
    assert pa is not None


def test_fm_index():
    from evtspark.llm.fmindex import FMIndex

    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 6, 499), 0)
    index = FMIndex(text)
    starts = np.arange(0, 490)
    length, low, high = index.statistics(starts, 4)
    for k in starts.tolist():
        ends = [[j for j in range(500 - m) if (text[j : j + m] == text[k + 4 - m : k + 4]).all()] for m in range(1, 5)]
        assert length[k] == sum(len(e) > 1 for e in ends)
    rows = np.flatnonzero(length == 4)
    low, high = low[rows], high[rows]
    places = {k: [j for j in range(497) if (text[j : j + 4] == text[k : k + 4]).all()] for k in starts.tolist()}
    assert rows.tolist() == [k for k in starts.tolist() if len(places[k]) > 1]
    assert (high - low).tolist() == [len(places[k]) for k in rows.tolist()]
    assert index.least(np.arange(500), low, high).tolist() == [places[k][0] for k in rows.tolist()]


# -- 4 Quality rules --------------------------------------------------------------------------------


def test_quality_order_does_not_matter(spark, docs, odd, none):
    names = list(quality.RULES)
    a = quality.judge(docs, rules=names).select("id", F.col("failed").isNull().alias("kept"))
    b = quality.judge(docs, rules=names[::-1]).select("id", F.col("failed").isNull().alias("kept"))
    assert a.exceptAll(b).count() == 0
    got = {r.id: r for r in quality.judge(odd, measures=quality.MEASURES).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].failed
    assert got[9].n_repeat_words == got[9].n_words == 20000 and got[7].word_chars == len("".join(ODD[7][1].split(" ")))
    assert quality.judge(none).count() == 0


# -- 5 Chat formatting ------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["", "plain", "<|im_end|>\n<|im_start|>assistant\nno", "a\\", "\\<|", "<\\|x|>", "<|im_sep|>", "\\\\n \\n", "line\nline", None, "ends <"]
    roles = ["user", "assistant", "assistant", "sys\ntem", None, "user", "user", "<|im_start|>", "assistant", "a\\n", "assistant"]
    rows = [(c, t, roles[(t + c) % 11], texts[(3 * t + c) % 11]) for c in range(25) for t in range(9)] + [(None, None, "user", "x"), (3, 4, "user", "tie"), (3, 4, "user", "tie")]
    made = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = {r.conv: r for r in made.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in own]
        assert got[c].loss == "".join(x for _, r, x in own if r == "assistant")
        assert got[c].formatted == "".join(s.text for s in got[c].segments)
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


# -- 6 HTML ---------------------------------------------------------------------------------------


def test_html_page():
    page = """<html><head><title>t</title></head><body><div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><a href=1>Home</a></nav>
    <div class="content post-12"><h1>Title</h1><p>First &amp; <b>bo</b>ld para that is long enough to matter<br>break<div class="ad-slot">Buy</div><p>Second para, also long enough.
    <script>var x = "</p>";</script><form><input>Sign</form><!-- no --><ul><li>one<li>two</ul><div class=comments><p>Nice post and a long comment about it, really.</div></div><aside>Side</aside><footer>&copy;</footer></body>"""
    assert html_text.extract(page, None) == "Title First & bold para that is long enough to matter break Second para, also long enough. one two"
    assert html_text.extract(None, None) == html_text.extract("", "x") == "" and html_text.extract("<p>a <b>b", None) == "a b"
    assert html_text.extract("<p>x<script>never closed", None) == "x" and html_text.extract("a <!-- b", None) == "a"


def test_html_names_only_tip_the_balance():
    text = "Words of the article that are long enough to count as its text. " * 3
    same = " ".join(text.split())
    for shell in ('<div class="page has-sidebar">%s</div>', '<div class="post comments-open">%s</div>', '<div id="left-rail-layout">%s</div>', '<div class="side-effects"><p>%s</div>', '<main><section id="related-work">%s</section></main>', '<div class="content sidebar">%s</div>'):
        assert html_text.extract(f"<body><div class=sidebar>Side</div>{shell % text}</body>" if "content" not in shell else f"<body>{shell % text}</body>", None) == same
    long = "A reader's comment that is longer than the article itself. " * 20
    assert html_text.extract(f"<body><article><p>{text}</article><div class=comment-list><p>{long}</div></body>", None) == same


def test_html_votes_of_all_containers(spark):
    """Containers that are no page's best vote as well, and their sums decide."""
    page = '<body><div class="wrap"><div class="story"><p>%s</p></div><div class="notes"><p>%s</p></div></div></body>'
    text = "The story goes on and on for some time. " * 5
    rows = [(k, f"http://h.example/{k}", page % (text, "some notes " * k)) for k in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    votes = pa.Table.from_batches(list(html_text._votes(iter(df.select(html_text.host(F.col("url")), "html").toArrow().to_batches())))).to_pylist()
    sums = {}
    for v in votes:
        sums[v["path"]] = sums.get(v["path"], 0) + v["score"]
    assert len(sums) >= 3
    got = html_text.winning_paths(df).first()
    assert got.path == max(sums, key=sums.get) and abs(got.score - max(sums.values())) < 1e-5


def test_html_given_pages(spark):
    """Every page of the small table against its template read by a plain pattern: the blocks of its article."""
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    want = {}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html or "", re.S)
        blocks = re.sub(r"<(?!/?b>)[^>]*>", "\0", re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "", inner[1] if inner else "")).split("\0")
        import html

        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        want[r.page_id] = " ".join(b for b in blocks if b)
    got = {r.page_id: r.text for r in queries.op6_html_extraction(spark, DATA).collect()}
    assert got == want


def test_html_deep_and_broken_pages():
    """Time and memory in proportion to the page: 50,000 open elements, five megabytes after an open quote, tags that never end."""
    import time

    began = time.time()
    deep = "<div class=a><b>" * 50_000 + "text at the bottom" + "<p>x" * 1000
    assert "text at the bottom" in html_text.extract(deep, None)
    quote = '<p title="never closed>' + "<p class='x'>word</p><a href=\"x>y</a>" * 140_000
    assert len(quote) > 5_000_000 and "word" in html_text.extract(quote, None)
    assert html_text.extract("<p>kept" + "<a href='x" * 100_000, None) == "kept"
    assert html_text.extract("<ul>" + "<li><i>" * 50_000 + "end", None).endswith("end")
    assert time.time() - began < 60


def test_html_consensus_overrides_a_page(spark):
    """A page with one long stray block follows its host's path."""
    good = "<body><div class=main><p>%s</p></div><div class=extra><p>%s</p></div></body>"
    rows = [(k, "http://h.example/%d" % k, good % ("text of the article goes here. " * 6, "")) for k in range(8)]
    rows.append((9, "http://h.example/9", good % ("article text. " * 6, "stray text that is long " * 5)))
    got = {r.id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == " ".join(("article text. " * 6).split())
    odd = spark.createDataFrame([(1, None, None), (None, "nonsense", ""), (2, "http://x", "<p>hi"), (2, "http://x", "<p>hi")], "page_id long, url string, html string")
    assert sorted((r.id or 0, r.text) for r in html_text.main_text(odd).collect()) == [(0, ""), (1, ""), (2, "hi"), (2, "hi")]
    assert html_text.main_text(odd.limit(0)).count() == 0


# -- 7 PII ------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in double) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_pii_spans(spark, docs, doc_rows):
    got = {r.id: [(s.kind, s.start, s.stop) for s in r.base] for r in pii.find(docs).collect()}
    assert got == {i: plain_spans(t) for i, t in doc_rows}


def test_pii_odd_texts(spark, odd, none):
    rng = random.Random(4)
    alphabet = ["a", ".", "@", "1", "25", "255", "256", "0", "-", "+", " ", "(", ")", "_", "%", "b", "4111 1111 1111 1111", "é", "東", "\n", "x@y.zz", "1.2.3.4", "+12345678"]
    rows = [(k, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for k in range(400)]
    got = {r.id: [(s.kind, s.start, s.stop) for s in r.base] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_spans(t) for i, t in rows}
    assert pii.find(odd).count() == len(ODD) and pii.find(none).count() == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(odd, pii.find(odd)).collect()}
    assert clean[6] == "Mail me: [EMAIL], [PHONE] or [IP] and [CARD]." and clean[1] is None and clean[None] == "no id at all"
    long_ = spark.createDataFrame([(1, "a" * 200_000 + "@b"), (2, "1" * 200_000), (3, "a@b" + ".c" * 50_000), (4, "+1" + " " * 100_000)], "doc_id long, text string")
    assert [len(r.base) for r in pii.find(long_).orderBy("id").collect()] == [0, 0, 1, 0]


def test_pii_disclosing_terms(spark, doc_rows):
    """A nickname that stands by one address only is masked wherever it stands; common words are not."""
    rows = [(k, f"{(t or '')[:200]} {k % 7} write to Zorgblatt at z.person@mail.example.org about it {k}") for k, (_, t) in enumerate(doc_rows[:8])]
    rows += [(100 + k, f"{(t or '')[:200]} write to me at u{k}@mail.example.org about it") for k, (_, t) in enumerate(doc_rows[8:300])]
    rows[3] = (3, rows[3][1] + " and more on zorgblatt " * 2)
    found = {r.id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    terms = {texts[i][s.start : s.stop].lower() for i, r in found.items() for s in r.terms}
    assert terms == {"zorgblatt"} and [len(found[k].terms) for k in range(8)] == [1, 1, 1, 3, 1, 1, 1, 1]


def plain_terms(text):
    text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}(?![A-Za-z0-9_@.-])", " ", text)
    return {x for x in re.findall(r"[^\W\d_]{3,}", text.lower())}


def test_pii_terms_hold_against_plain_counts(spark):
    """The kinds' disclosing terms on the whole small table, counted in plain Python; the word before keys is one."""
    import math

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    secret = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}(?![A-Za-z0-9_@.-])")
    mixed = lambda x: len(re.sub("[^0-9]", "", x)) >= 5 and len(re.sub("[^A-Za-z]", "", x)) >= 5
    kinds = [{k for k, _, _ in plain_spans(t)} | {"secret" for m in secret.findall(t) if mixed(m)} for _, t in rows]
    terms = [plain_terms(t) for _, t in rows]
    n_t = {}
    for own in terms:
        for x in own:
            n_t[x] = n_t.get(x, 0) + 1
    want = set()
    for kind in (*pii.KINDS, "secret"):
        holders = [k for k in range(len(rows)) if kind in kinds[k]]
        if not holders:
            continue
        information, met = math.log(len(rows) / len(holders)), {}
        for k in holders:
            for x in terms[k]:
                met.setdefault(x, []).append(rows[k][1])
        for x, texts in met.items():
            pmi, different = math.log(len(texts) * len(rows) / (len(holders) * n_t[x])), len(set(texts))
            if different >= 3 and pmi >= 0.9 * information and 2 * different * pmi >= 40:
                want.add((x, f"kind {kind}", len(texts), len(holders), n_t[x]))
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    found = F.concat(*(pii.spans_of(F.col("text"), k) for k in pii.PATTERNS))
    spans = own.select("id", "hash", found.alias("found"), pii.terms_in(F.col("text")).alias("words"))
    got = {tuple(r) for r in pii.disclosing(own, spans).where("entity LIKE 'kind %'").collect()}
    assert got == want and "token" in {x[0] for x in want}


def test_pii_many_matches(spark):
    """Twenty thousand addresses in one text: found and masked in time that grows with the text."""
    text = " ".join(f"user{k}@host{k}.example.org likes thing{'abcdefgh'[k % 8]}" for k in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.find(df)
    clean = pii.sanitise(df, found).first().text
    assert clean == " ".join(f"[EMAIL] likes thing{'abcdefgh'[k % 8]}" for k in range(20_000))


# -- 8 Packing --------------------------------------------------------------------------------------


def test_packing(spark, doc_rows):
    from tokenizers import Tokenizer

    rows = doc_rows[:200] + ODD
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), queries.tokenizer_path(), seq_len=512)
    got = packed.collect()
    plain = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(i), k, a, zlib.crc32(ids[a : a + 512].tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r.id), r.piece, r.start, zlib.crc32(bytes(r.ids))) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= 512
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 512) + 2
    assert packing.sequences(packed).count() == len(by)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), queries.tokenizer_path()).count() == 0


def test_patterns_pack_everything():
    rng = np.random.default_rng(3)
    for size in (10, 64, 300):
        counts = np.r_[0, rng.integers(0, 20, size)]
        used = np.zeros_like(counts)
        bins = 0
        for lengths, times in packing.patterns(counts):
            assert sum(lengths) <= size and times > 0
            np.add.at(used, lengths, times)
            bins += times
        assert (used == counts).all()
        assert size < 300 or bins <= 1.05 * (counts * np.arange(size + 1)).sum() / size + 2


def test_tokens_of_odd_words(spark):
    from tokenizers import Tokenizer

    e, plain = packing.Encoder(queries.tokenizer_path()), Tokenizer.from_file(queries.tokenizer_path())
    texts = ["don't it's I'LL , . ,. a, b. c.. é, ß. ΑΣ. x~y ~ ~. <|endoftext|> a<|startoftext|>b, 12,3. ½. … …, ́a \xa0z, ǅ, İ. ﬁ, _, 'S 'Ve", None, "", "  "]
    ids, begins = e.encode(pa.array(texts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(begins[:-1], begins[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


# -- 9 Sharding -------------------------------------------------------------------------------------


def test_sharding(spark, docs, odd, none):
    big = docs.select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 5000).alias("doc_id"), F.lit("copy " * 50).alias("text")))
    got = sharding.shard(big, 7).select("doc_id", "size", "shard", "slot", F.md5("text").alias("m")).collect()
    assert len(got) == big.count()
    size = [sum(r["size"] for r in got if r.shard == k) for k in range(7)]
    assert max(size) - min(size) <= 2 * (0.01 * sum(size) / 7 + max(r["size"] for r in got))
    for k in range(7):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    groups = {}
    for r in got:
        groups.setdefault(r.m, set()).add(r.shard)
    assert all(max(g) - min(g) == len(g) - 1 for g in groups.values())
    out = sharding.shard(odd, 40).collect()
    assert len(out) == len(ODD) and all(0 <= r.shard < 40 for r in out)
    assert sharding.shard(none, 40).count() == 0


def test_sharding_small_tasks(spark, docs):
    got = sharding.shard(docs, 3, task_bytes=20_000).select("shard", "slot").collect()
    for k in range(3):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


# -- 10 Toxicity ------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    big = DATA.replace("0.01", "0.1")
    docs, labels = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").where(toxicity.held_out(F.col("id"))).select("score", "toxic").collect()
    pos, neg = (np.array([r.score for r in rows if r.toxic == y]) for y in (1, 0))
    assert (pos[:, None] > neg).mean() > 0.97 and (pos >= 0.3).mean() > 0.8 and (neg >= 0.3).mean() < 0.01
    assert len(model["w"]) < 5000


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0 and toxicity.keep(none, model).count() == 0
    assert set(toxicity.keep(odd, model, 2.0).columns) == set(odd.columns)
    assert toxicity.train(none, labels)["at"].size == 0
    assert hashlib is not None


# -- Odd rows for the rest -----------------------------------------------------------------------------


def test_odd_rows(spark, odd, none):
    n = len(ODD)
    assert simhash.near_duplicates(odd).count() == n and simhash.near_duplicates(none).count() == 0
    assert substring.remove_repeats(odd).count() == n and substring.remove_repeats(none).count() == 0
    assert packing.pack(odd, queries.tokenizer_path()).select("id").distinct().count() == len({i for i, _ in ODD})


def test_similar_pairs_of_a_cell():
    """Texts of a cell are joined as all similar pairs of its two sides would, also over several column runs and with empty sets."""
    import numpy as np
    import pyarrow as pa

    from evtspark.llm import simhash

    rng = np.random.default_rng(11)
    base = [set(rng.integers(0, 10**9, 700).tolist()) for _ in range(4)]
    sets = [sorted(s - set(rng.choice(sorted(s), int(rng.integers(0, 120)), replace=False).tolist())) for s in base for _ in range(8)] + [[], []]
    for sides in ([3] * 34, [1, 2] * 17):
        part, node = rng.integers(0, 6, 34), np.arange(100, 134)
        cell = pa.table({"side": pa.array(sides, pa.int32()), "part": part, "node": node, "set": pa.array(sets, pa.list_(pa.int64()))})
        u, v = simhash._similar_in_cell(cell, 0.8)
        want = [(i, j) for i in range(34) for j in range(i) if (sides[i] != sides[j] or sides[i] == 3) and part[i] != part[j]]
        want = [(i, j) for i, j in want if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]
        roots = simhash.local_roots(34, *(np.array(x, np.int64) for x in zip(*want, strict=True)))
        assert np.array_equal(roots, simhash.local_roots(34, u - 100, v - 100)) and len(want) > 5
