"""Personal data: patterns, and terms that disclose what the patterns found. Spark expressions only.

Information-theoretic sanitisation: the corpus tells how much of a protected
entity's information a term gives away,

    PMI(term; entity) / IC(entity) = log(n_et N / (n_e n_t)) / log(N / n_e),

with n counting documents. Protected are the kinds (a document that holds any
address, number or secret of the kind), e-mail domains and single values. A kind
meets every term of its documents; a domain or value, which may stand in a document
thousands of times, meets the terms around its mentions. Terms at or over the
disclosure threshold, with enough different texts and enough evidence that the
meeting is no chance, are masked wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtspark.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
#: The patterns' languages and leftmost matches are the plain ones'; possessive
#: loops and the look-behind only keep the search linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+(?![@.])",
}
#: A cheap test that every text with a valid match passes.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.rlike(r"\+[0-9][\x20().0-9-]"),
    "secret": lambda t: t.rlike(r"[0-9](?:[A-Za-z_-]|(?<=[A-Za-z_-][0-9]))") & t.rlike(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24}"),
}
#: Words of context on either side of a mention, and the characters they are sought in.
NEAR_WORDS, NEAR_CHARS = 8, 160
TERM = r"\p{L}{3,}+"
#: Addresses and secrets, whose letters are no terms.
NO_TERM = rf"{PATTERNS['email']}|{PATTERNS['secret']}"
#: Different texts in which a term meets an entity, share of the entity's information it must give away, and
#: twice the log-likelihood in favour of the meeting (40: a chance of 1 in some 10**9 a term).
MIN_TEXTS, DISCLOSURE, EVIDENCE = 3, 0.9, 40.0
#: Elements that a scan appends to one array before it begins another, which keeps it linear.
BLOCK = 256
SPAN = "struct<kind:string,start:bigint,stop:bigint,value:string,left:string,right:string>"
PLACE = "struct<start:bigint,stop:bigint>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def scan(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(state, item) -> (state, array of kind)`` gives for one item after the other, in one array."""
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def inner(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def run(all_items: Column) -> Column:
        last = F.greatest(F.floor((F.size(all_items) - 1) / BLOCK).cast("int"), F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_items, b * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.aggregate(blocks, F.struct(state.alias("state"), nones.alias("out")), outer)["out"])

    return let(items, run)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of 16 to 19 digits passes Luhn's test."""
    at = F.sequence(F.lit(1), F.length(digits))

    def term(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(at, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":  # a part of up to 255 has at most three digits after its leading zeros
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(x, r"\."), lambda p: part(p).rlike("^[0-9]{1,3}$") & (F.lpad(part(p), 3, "0") <= "255"))
    if kind == "card":
        n = F.length(_digits(x))
        return F.when((n >= 16) & (n <= 19), _luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    if kind == "secret":  # letters and figures well mixed, as in keys and hashes
        return (F.length(_digits(x)) >= 5) & (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 5)
    return F.lit(True)


def _zipped(text: Column, pattern: str) -> Column:
    """Array of (gap, hit, after): what stands before a match, the match, what stands after it; the last hit is null."""

    def zipped(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after"))

    return let(F.split(text, pattern, -1), zipped)


def spans_of(text: Column, kind: str) -> Column:
    """Valid matches in order, an array of ``SPAN``; start and stop count code points, stop is exclusive."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        gap, hit, after = x["gap"], x["hit"], F.coalesce(x["after"], F.lit(""))
        start = at + F.length(gap)
        stop = start + F.coalesce(F.length(hit), F.lit(0))
        # a cut through a word leaves no part of it
        left = F.when(F.length(gap) > NEAR_CHARS, F.regexp_replace(F.right(gap, F.lit(NEAR_CHARS)), r"^\p{L}+", "")).otherwise(gap)
        right = F.when(F.length(after) > NEAR_CHARS, F.regexp_replace(F.left(after, F.lit(NEAR_CHARS)), r"\p{L}+$", "")).otherwise(after)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), hit.alias("value"), left.alias("left"), right.alias("right"))
        return stop, F.when(hit.isNotNull() & _valid(kind, F.coalesce(hit, F.lit("0"))), F.array(span)).otherwise(none)

    found = scan(_zipped(text, PATTERNS[kind]), F.lit(0).cast("bigint"), SPAN, step)
    return F.when(HINTS[kind](text), found).otherwise(none)


def terms_in(text: Column) -> Column:
    """Different terms of a text, lower-cased, without those inside addresses and secrets."""
    bare = F.when(HINTS["email"](text) | HINTS["secret"](text), F.regexp_replace(text, NO_TERM, " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0)))


def terms_near(span: Column) -> Column:
    """Terms around a mention, up to NEAR_WORDS on either side."""

    def words(side: Column) -> Column:
        return F.regexp_extract_all(F.lower(F.regexp_replace(side, NO_TERM, " ")), F.lit(TERM), F.lit(0))

    before = let(words(span["left"]), lambda w: F.slice(w, F.greatest(F.size(w) - NEAR_WORDS + 1, F.lit(1)), F.lit(NEAR_WORDS)))
    return F.array_distinct(F.concat(before, F.slice(words(span["right"]), 1, NEAR_WORDS)))


def places_of(text: Column, wanted: Column) -> Column:
    """Array of ``PLACE``: where the terms in the array ``wanted`` stand, in order."""
    none = F.array().cast(f"array<{PLACE}>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        some = F.coalesce(F.array_contains(wanted, F.lower(x["hit"])), F.lit(False))
        return stop, F.when(some, F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(none)

    return scan(_zipped(text, f"{NO_TERM}|{TERM}"), F.lit(0).cast("bigint"), PLACE, step)


def _named(span: Column) -> Column:
    """The entities that a mention names: its value and, of an address, the domain."""
    value = F.concat(span["kind"], F.lit(" "), F.lower(span["value"]))
    domain = F.concat(F.lit("domain "), F.lower(F.substring_index(span["value"], "@", -1)))
    return F.when(span["kind"] == "email", F.array(value, domain)).otherwise(F.array(value))


def disclosing(rows: DataFrame, spans: DataFrame, min_texts: int = MIN_TEXTS, disclosure: float = DISCLOSURE, evidence: float = EVIDENCE) -> DataFrame:
    """``(term, entity, n_et, n_e, n_t)``: terms that disclose an entity, for ``rows(text)`` and their ``spans(hash, found, words)``.

    All counts are of documents, repeated rows included; evidence and ``min_texts``
    take different texts, so copies of one text prove nothing.
    """
    n_docs = float(max(spans.count(), 1))
    own = spans.where(F.size("found") > 0).groupBy("hash").agg(F.count("*").alias("m"), F.first(F.struct("found", "words")).alias("x"))
    own = stage(own.select("hash", "m", F.col("x.found").alias("found"), F.col("x.words").alias("words")))
    kinds = own.select("m", F.explode(F.array_distinct(F.transform("found", lambda s: F.concat(F.lit("kind "), s["kind"])))).alias("entity"), "words")
    mentions = own.select("hash", "m", F.explode("found").alias("s")).select("hash", "m", F.explode(_named(F.col("s"))).alias("entity"), terms_near(F.col("s")).alias("near"))

    sums = (F.sum("m").alias("n_et"), F.count("*").alias("texts"))
    pairs = kinds.select("m", "entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(*sums)
    near = mentions.select("hash", "m", "entity", F.explode("near").alias("term")).distinct()
    pairs = pairs.unionByName(near.groupBy("entity", "term").agg(*sums))
    entities = kinds.select("m", "entity").unionByName(mentions.select("hash", "m", "entity").distinct().drop("hash"))
    entities = stage(entities.groupBy("entity").agg(F.sum("m").alias("n_e")))  # of known size: few entities go to every task
    information = F.log(F.lit(n_docs) / F.col("n_e"))
    # no term gives away more than all of an entity's information
    hopeful = pairs.where(F.col("texts") >= min_texts).join(entities, "entity").where((information > 0) & (2 * F.col("texts") * information >= evidence))
    candidates = stage(hopeful)
    every = rows.select(F.explode(terms_in(F.col("text"))).alias("term")).join(candidates.select("term").distinct(), "term", "left_semi")
    counts = every.groupBy("term").agg(F.count("*").alias("n_t"))
    pmi = F.log(F.col("n_et") * F.lit(n_docs) / (F.col("n_e") * F.col("n_t")))
    told = candidates.join(counts, "term").where((pmi >= disclosure * information) & (2 * F.col("texts") * pmi >= evidence))
    return told.select("term", "entity", "n_et", "n_e", "n_t")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_texts: int = MIN_TEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """``(id, hash, base, secrets, terms)`` per row of ``docs``; (id, hash) tells the row's content.

    base: pattern spans by kind as listed, then start; secrets: long mixed words
    such as keys; terms: where disclosing terms stand, by start, in any document.
    Null and empty texts have none. Repeated rows come back repeated; null ids
    stay null; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    found = let(F.concat(*(spans_of(F.col("text"), k) for k in PATTERNS)), lambda f: F.struct(f.alias("found"), F.when(F.size(f) > 0, terms_in(F.col("text"))).alias("words")))
    spans = stage(rows.select("id", "hash", found.alias("x")).select("id", "hash", "x.found", "x.words"))
    told = stage(disclosing(rows, spans, min_texts, disclosure).select("term").distinct())

    holders = rows.select("id", "hash", F.explode(terms_in(F.col("text"))).alias("term")).join(told, "term")
    holders = stage(holders.groupBy("id", "hash").agg(F.collect_set("term").alias("wanted")))
    named = holders.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "wanted")
    marked = rows.join(named, rows["id"].eqNullSafe(F.col("_id")) & (rows["hash"] == F.col("_hash")))
    marked = marked.select("_id", "_hash", places_of(F.col("text"), F.col("wanted")).alias("terms")).dropDuplicates(["_id", "_hash"])

    bare = lambda keep: F.transform(F.filter("found", keep), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    own = spans.select("id", "hash", bare(lambda s: s["kind"] != "secret").alias("base"), bare(lambda s: s["kind"] == "secret").alias("secrets"))
    out = own.join(marked, own["id"].eqNullSafe(F.col("_id")) & (own["hash"] == F.col("_hash")), "left")
    return out.select("id", "hash", "base", "secrets", F.coalesce("terms", F.array().cast(f"array<{PLACE}>")).alias("terms"))


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets, e.g. ``[EMAIL]``; terms by ``[TERM]``.

    Overlapping spans are replaced together under the kind of the first. A null
    text stays null; all other columns stay as they are.
    """
    every = F.concat("base", "secrets", F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))))
    by_start = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    spans = found.where((F.size("base") > 0) | (F.size("secrets") > 0) | (F.size("terms") > 0)).dropDuplicates(["id", "hash"])
    spans = spans.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), by_start.alias("_spans"))
    text = F.col(text_col).cast("string")
    rows = docs.join(spans, docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_hash")), "left")

    def clean(points: Column) -> Column:
        """``points``: the text's code points, of which each is copied once however many spans there are."""

        def step(at: Column, s: Column) -> tuple[Column, Column]:
            before = F.array_join(F.slice(points, (at + 1).cast("int"), F.greatest(s["start"] - at, F.lit(0)).cast("int")), "")
            piece = F.array(F.concat(before, F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.greatest(at, s["stop"]), F.when(s["start"] >= at, piece).otherwise(F.array().cast("array<string>"))

        done = scan(F.col("_spans"), F.lit(0).cast("bigint"), "string", step)
        tail = F.array_max(F.transform("_spans", lambda s: s["stop"]))
        return F.concat(F.array_join(done, ""), F.array_join(F.slice(points, (tail + 1).cast("int"), F.size(points)), ""))

    cleaned = let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), clean)
    return rows.withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(cleaned)).select(*docs.columns)
