"""Quality rules as a short-circuit cascade.

A text is kept if no rule rejects it, so the order of the rules changes only the
cost. On a sample, drawn by hash over the whole table, the executors note which
rules reject a text and how long each measure takes; rules are then ordered one
after the other by rejections per time, both summed over the texts that the rules
before them leave, and without the measures that they have already paid for. A text
leaves the cascade at its first rejection.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtspark.llm.common import chunks

SPACE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
BULLETS, ELLIPSES = (b"- ", b"* ", "\u2022".encode()), (b"...", "\u2026".encode())
#: Rows, on average, that cost and selectivity are estimated on.
SAMPLE_ROWS = 1000


class Text:
    """A text whose measures are computed when a rule asks for them."""

    def __init__(self, text: str | None) -> None:
        self.raw = (text or "").encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        packed = self.raw.translate(None, SPACE)
        return len(packed) - sum(np.bincount(np.frombuffer(packed, np.uint8) >> 6, minlength=4)[2:3].tolist())

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        at = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        v = len(number)
        pair = at[:-1] * v + at[1:]
        if v >= 1 << 21:  # else three word numbers fit in 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * v + at[2:]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        return int(covered.sum())

    @cached_property
    def n_bullets(self) -> int:
        return sum(x.lstrip(SPACE).startswith(BULLETS) for x in self.lines)

    @cached_property
    def n_ellipses(self) -> int:
        return sum(x.rstrip(SPACE).endswith(ELLIPSES) for x in self.lines)

    @cached_property
    def n_top_word(self) -> int:
        """Occurrences of the most frequent word."""
        return max(Counter(self.words).values(), default=0)

    @cached_property
    def letters(self) -> int:
        text = self.raw.decode("utf-8", "surrogatepass")
        return sum(map(str.isalpha, text)) if len(text) < 200 else len(text) - len(text.translate(_LETTERS))


class _Letters(dict):
    """str.translate table that removes letters; filled as characters turn up."""

    def __missing__(self, point: int) -> int | None:
        self[point] = None if chr(point).isalpha() else point
        return self[point]


_LETTERS = _Letters()

#: Name -> (whether the rule rejects a text, the measures it needs).
CHECKS: dict[str, tuple[Callable[[Text], bool], tuple[str, ...]]] = {
    "few_words": (lambda t: t.n_words < 50, ("words",)),
    "repeats": (lambda t: 100 * t.n_repeat_words > 50 * t.n_words, ("words", "n_repeat_words")),
    "symbols": (lambda t: 10 * t.n_symbols > t.n_words, ("words", "n_symbols")),
    "repeated_lines": (lambda t: 10 * t.n_dup_lines > 6 * len(t.lines), ("lines", "n_dup_lines")),
    "word_length": (lambda t: not 2 * t.n_words <= t.word_chars <= 14 * t.n_words, ("words", "word_chars")),
    "letters": (lambda t: 100 * t.letters < 60 * t.word_chars, ("word_chars", "letters")),
    "bullets": (lambda t: 10 * t.n_bullets > 9 * len(t.lines), ("lines", "n_bullets")),
    "ellipses": (lambda t: 10 * t.n_ellipses > 3 * len(t.lines), ("lines", "n_ellipses")),
    "top_word": (lambda t: 10 * t.n_top_word > 3 * t.n_words, ("words", "n_top_word")),
}
RULES = {name: check for name, (check, _) in CHECKS.items()}
#: The measures, each after those that it is made from.
WORK = ("words", "lines", "n_words", "word_chars", "n_symbols", "letters", "n_dup_lines", "n_bullets", "n_ellipses", "n_top_word", "n_repeat_words")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (draw, text): which rules reject the text, and the nanoseconds that each measure took once what it is made from was there."""
    for batch in chunks(batches):
        hits, work = [], []
        for x in batch.column(1):
            t, clock = Text(x.as_py()), [time.perf_counter_ns()]
            for m in WORK:
                getattr(t, m)
                clock.append(time.perf_counter_ns())
            work.append(np.diff(clock).astype(float).tolist())
            hits.append([bool(check(t)) for check in RULES.values()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.bool_())), pa.array(work, pa.list_(pa.float64()))], names=["draw", "hits", "work"])


def greedy_order(hits: np.ndarray, work: np.ndarray) -> list[str]:
    """Rule names, each the best by rejections per work among the texts that those before it leave; ``hits`` (text, rule), ``work`` (text, measure)."""
    rules, measures, out, paid, left = list(CHECKS), list(WORK), [], set(), np.ones(len(hits), bool)
    while len(out) < len(rules):
        def rate(name: str) -> float:
            need = [measures.index(m) for m in CHECKS[name][1] if m not in paid]  # noqa: B023
            return hits[left, rules.index(name)].sum() / (work[left][:, need].sum() + 1.0)  # noqa: B023
        best = min((n for n in rules if n not in out), key=lambda n: (-rate(n), rules.index(n)))
        out.append(best)
        paid |= set(CHECKS[best][1])
        left &= ~hits[:, rules.index(best)]
    return out


def order_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by falling rejections per time on about ``sample_rows`` rows, twice as many at most, drawn by hash of id and text from the whole table.

    Times are of the executors' clocks, so that two runs may order rules of like worth
    differently; a run asks for the order once and keeps to it.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    draw = F.xxhash64("id", "text", F.lit(1))
    every = max(1, rows.count() // sample_rows)
    drawn = rows.select(draw.alias("draw"), "text").where(F.pmod("draw", F.lit(every)) == 0)
    measured = drawn.mapInArrow(_measure, "draw long, hits array<boolean>, work array<double>")
    got = measured.orderBy("draw").limit(2 * sample_rows).toArrow()  # some numbers a row; copies of one row are drawn together
    hits = np.array(got.column("hits").to_pylist(), bool).reshape(-1, len(CHECKS))
    return greedy_order(hits, np.array(got.column("work").to_pylist(), float).reshape(-1, len(WORK)))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _cascade(batches: Iterator[pa.RecordBatch], rules: list[str], measures: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        failed, got = [], {m: [] for m in measures}
        for x in batch.column(1):
            t = Text(x.as_py())
            failed.append(next((name for name in rules if RULES[name](t)), None))
            for m in measures:
                got[m].append(getattr(t, m))
        cols = [pa.array(got[m], pa.int64()) for m in measures]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(failed, pa.string()), *cols], names=["id", "failed", *measures])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", measures: list[str] | None = None, rules: list[str] | None = None) -> DataFrame:
    """``(id, failed)`` per row and the asked-for measures; failed names the rule that rejected the text, else null.

    Null and empty texts have no words and fail. Repeated rows and null ids come
    back as they are; an empty table gives no rows; other columns are ignored.
    Which of several rejecting rules is named depends on the estimated order.
    """
    measures = measures or []
    rules = rules or order_rules(docs, id_col, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    schema = ", ".join(["id long", "failed string", *(f"{m} long" for m in measures)])
    return rows.mapInArrow(partial(_cascade, rules=rules, measures=measures), schema)
