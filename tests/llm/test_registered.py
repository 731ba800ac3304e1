"""Registered queries whole against plain Python, and words whose hashes collide."""

import hashlib
import re
import zlib

import pytest

from evtspark.llm import common, decontaminate, queries, substring
from tests.conftest import DATA
from tests.llm.test_operators import plain_classes, plain_print, plain_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n=10):
    """Two words of 2**n letters whose polynomial hashes modulo 2**64 are equal under every odd base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_colliding_words_are_told_apart(spark):
    one, two = thue_morse()
    h, _ = common.hash_texts([one.encode(), two.encode()])
    assert one != two and h[0] == h[1]
    base = [f"w{k}" for k in range(60)]
    with_word = lambda x, n: " ".join([*base[:n], x, *base[n : 2 * n]])
    rows = [(1, with_word(one, 10)[: -len(base[19]) - 1]), (2, with_word(two, 10)[: -len(base[19]) - 1]), (3, with_word(one, 30)), (4, with_word(two, 30)), (5, with_word(two, 30)), (6, " ".join("a" * k for k in range(1, 80)))]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (r[0], r[3])
    assert sorted(map(tuple, got), key=key) == sorted(plain_repeats(rows, 20), key=key)
    assert next(r.n_removed for r in got if r.id == 2) == 0
    item = spark.createDataFrame([(7, rows[0][1])], "item_id long, text string")
    found = {r.id: r.edits for r in decontaminate.leaks(spark.createDataFrame(rows[:2], "doc_id long, text string"), item).collect()}
    assert found == {1: 0, 2: 1}


@pytest.fixture(scope="module")
def texts(doc_rows):
    return sorted(doc_rows)


def test_op1_query(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op1_simhash_near_dedup"](spark, DATA).collect()}
    prints = {i: plain_print("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for i, t in texts}
    classes, least = plain_classes(set(prints.values()), 3), {}
    for i, f in prints.items():
        least[classes[f]] = min(least.get(classes[f], i), i)
    assert got == {i: (f"{f:016x}", least[classes[f]]) for i, f in prints.items()}


def test_op3_query(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op3_substring_dedup"](spark, DATA).collect()}
    assert got == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain_repeats(texts, 20)}


def test_op9_query(spark, texts):
    rows = queries.QUERIES["op9_sharding"](spark, DATA).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts}
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert shards.keys() == set(range(40)) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards.values())
    total = [sum(r.size for r in own) for own in shards.values()]
    assert max(total) <= 1.25 * sum(total) / 40 and min(total) >= 0.75 * sum(total) / 40


def test_op10_query(spark, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op10_toxicity"](spark, DATA).collect()}
    assert rows.keys() == {i for i, _ in texts}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    held = [(rows[i].score, t) for i, t in labels.items() if i in rows and rows[i].held_out and t is not None]
    one, nought = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum((a > b) + 0.5 * (a == b) for a in one for b in nought) >= 0.9 * len(one) * len(nought)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_op7_query(spark, texts):
    rows = {r.doc_id: r for r in queries.QUERIES["op7_pii"](spark, DATA).collect()}
    for i, t in texts:
        spans, r = plain_spans(t or ""), rows[i]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in spans) for k in ("email", "ip", "card", "phone"))
        assert set(spans) <= set(filter(None, r.spans.split(",")))
