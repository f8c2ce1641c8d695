"""Personal data: fixed patterns, and information-theoretic sanitisation.

The patterns find e-mail and IP addresses, card and phone numbers. Each found
value is a protected entity. Terms (words of three or more letters) that
appear on its lines may reveal it: over the distinct lines of the corpus, so
that copies of a text change nothing,

    disclosure(entity, term) = PMI(entity; term) / IC(entity),
    PMI = log2(n_et * N / (n_e * n_t)),   IC = log2(N / n_e),

is 1 for a term that occurs nowhere else and 0 for one independent of the
entity. Every entity is scored, whatever its number of lines. Terms of at
least ``DISCLOSURE`` are reported with kind ``term`` on every line of every document
that holds the entity, unless their meeting may be chance: a pair on fewer than ``SUPPORT`` distinct lines needs a
probability of ``CHANCE`` at most, by the Chernoff bound
2 ^ -(n_et * (PMI - log2 e)) of that many common lines of independent ones.
``sanitise`` generalises entities to their kind and removes the terms.

Everything is a DataFrame expression. The patterns have possessive
quantifiers and look-behinds that keep their matches and make their cost
linear in long runs of one character class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

# The patterns, each equal in its matches to that of the result contract.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"\p{L}{3,}+"
KINDS = ("email", "ip", "card", "phone", "term")

#: Pairs on so many distinct lines need no test against chance.
SUPPORT = 3
CHANCE = 0.001
DISCLOSURE = 0.9
#: Term lists up to this many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(text: Column, matches: Column) -> Column:
    """(m, s, e) of non-overlapping matches in order: each is the first occurrence after the one before."""
    start = F.struct(
        F.lit(1).alias("at"), F.array().cast("array<struct<m:string,s:int,e:int>>").alias("out")
    )

    def step(acc: Column, m: Column) -> Column:
        found = F.position(m, text, acc["at"])
        end = found + F.length(m)
        span = F.struct(m.alias("m"), (found - 1).cast("int").alias("s"), (end - 1).cast("int").alias("e"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    return F.aggregate(matches, start, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _small_parts(m: Column) -> Column:
    """Every dotted part is at most 255."""
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(m, r"\."), small)


def _luhn(m: Column) -> Column:
    digits = F.reverse(_digits(m))
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _spans(text: Column, kind: str) -> Column:
    """(k, s, e, m) of the matches of a kind that pass its test."""
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
    test = {
        "email": lambda m: F.lit(True),
        "ip": _small_parts,
        "card": _luhn,
        "phone": lambda m: F.length(_digits(m)).between(9, 15),
    }[kind]
    needed = {"email": text.contains("@"), "ip": text.contains("."), "card": F.lit(True), "phone": text.contains("+")}[kind]
    placed = F.filter(_placed(text, F.when(needed, _matches(text, pattern)).otherwise(F.array().cast("array<string>"))), lambda x: test(x["m"]))
    return F.transform(
        placed, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), x["m"].alias("m"))
    )


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    named = F.transform(
        spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"], x["e"])
    )
    return F.concat_ws(",", named)


def base_spans(docs: DataFrame) -> DataFrame:
    """``id, text_hash, spans, contexts, text`` of each row, written once.

    spans: (s, k, e, m) by start and kind. contexts: for each span, the value
    as an entity and its line. text: null where there is no span.
    """
    text = F.col("text")
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", *[_spans(text, kind).alias(kind) for kind in KINDS[:4]]
    )
    joined = read.select("doc_id", "text", F.array_sort(F.concat(*KINDS[:4])).alias("spans"))

    def context(x: Column) -> Column:
        before = F.substring_index(F.substring(text, F.lit(1), x["e"]), "\n", -1)
        after = F.substring_index(F.substring(text, x["e"] + 1, F.length(text)), "\n", 1)
        value = F.when(x["k"] < 2, F.lower(x["m"])).otherwise(_digits(x["m"]))
        return F.struct(
            F.concat_ws(":", x["k"], value).alias("entity"),
            F.concat(before, after).alias("line"),
        )

    return keep(
        joined.select(
            F.col("doc_id").alias("id"),
            F.xxhash64("text").alias("text_hash"),
            "spans",
            F.transform("spans", context).alias("contexts"),
            F.when(F.size("spans") > 0, text).alias("text"),
        ),
        "pii-base",
    )


def _sized(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(table) if table.count() <= limit else table


def disclosing_terms(docs: DataFrame, base: DataFrame, support: int = SUPPORT, least: float = DISCLOSURE) -> DataFrame:
    """``entity, term, disclosure`` of the terms that reveal an entity, over the whole corpus."""
    contexts = base.select(F.explode("contexts").alias("c")).select("c.entity", "c.line").distinct()
    entities = contexts.groupBy("entity").agg(F.count("*").alias("n_e"))
    words = F.array_distinct(F.transform(_matches(F.col("line"), WORD), F.lower))
    pairs = keep(
        contexts.join(entities, "entity").select("entity", "n_e", F.explode(words).alias("term"))
        .groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")),
        "pii-pairs",
    )
    terms = pairs.select("term").distinct()
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).distinct()
    # Every line also counts for the empty term: its count is the number of lines.
    seen = lines.select(F.explode(F.array_append(words, F.lit(""))).alias("term"))
    every = keep(seen.groupBy("term").agg(F.count("*").alias("n_t")), "pii-counts")
    total = F.broadcast(every.where("term = ''").select(F.col("n_t").alias("lines")))
    counts = every.join(terms, "term", "left_semi")
    pmi = F.log2(F.col("n_et") * F.col("lines") / (F.col("n_e") * F.col("n_t")))
    rated = pairs.join(_sized(counts), "term").join(total).where("lines > n_e").withColumn(
        "disclosure", pmi / F.log2(F.col("lines") / F.col("n_e"))
    )
    sure = (F.col("n_et") >= support) | (F.col("n_et") * (pmi - math.log2(math.e)) >= -math.log2(CHANCE))
    return keep(rated.where((F.col("disclosure") >= least) & sure).select("entity", "term", "disclosure"), "pii-terms")


#: Runs of letters and of other characters that are searched at once; the cost grows with the square of it only.
BLOCK_RUNS = 256


def _pieces(texts: DataFrame) -> DataFrame:
    """``texts`` with ``part, offset`` in place of text: it is cut between runs of letters, so no word is cut.

    Offsets add up the lengths of the parts before, of which even a very long text has few.
    """
    runs = texts.withColumn("_runs", F.regexp_extract_all("text", F.lit(r"\p{L}++|[^\p{L}]++"), F.lit(0))).where(F.size("_runs") > 0)
    starts = F.sequence(F.lit(1), F.size("_runs"), F.lit(BLOCK_RUNS))
    parts = runs.withColumn("_parts", F.transform(starts, lambda i: F.array_join(F.slice("_runs", i, BLOCK_RUNS), ""))).drop("_runs", "text")
    sized = parts.withColumn("_sizes", F.transform("_parts", F.length))
    before = F.transform(F.sequence(F.lit(0), F.size("_sizes") - 1), lambda i: F.aggregate(F.slice("_sizes", F.lit(1), i), F.lit(0), lambda s, n: s + n))
    placed = sized.withColumn("_p", F.explode(F.arrays_zip(F.col("_parts").alias("part"), before.alias("offset"))))
    return placed.select(*[c for c in texts.columns if c != "text"], F.col("_p.part").alias("part"), F.col("_p.offset").alias("offset"))


def _term_spans(base: DataFrame, terms: DataFrame) -> DataFrame:
    """``key, text_hash, found``: occurrences of the terms that reveal an entity of the row, on all its lines."""
    key = F.coalesce("id", F.lit(-(1 << 63))).alias("key")
    held = base.select(key, "text_hash", F.explode("contexts.entity").alias("entity")).distinct()
    held = held.join(terms.select("entity").distinct(), "entity", "left_semi")
    texts = base.where("text is not null").select(key, "text_hash", "text").join(held, ["key", "text_hash"], "left_semi")
    placed = _pieces(texts).select("key", "text_hash", "offset", F.explode(_placed(F.col("part"), _matches(F.col("part"), WORD))).alias("w"))
    span = F.struct(
        (F.col("w.s") + F.col("offset")).alias("s"), F.lit(KINDS.index("term")).alias("k"),
        (F.col("w.e") + F.col("offset")).alias("e"), F.col("w.m").alias("m"),
    )
    words = placed.select("key", "text_hash", F.lower("w.m").alias("term"), span.alias("span"))
    # By term first: an entity of many documents never meets all its terms in each of them.
    found = words.join(_sized(terms.select("entity", "term")), "term").join(held, ["key", "text_hash", "entity"], "left_semi")
    return found.groupBy("key", "text_hash").agg(F.collect_set("span").alias("found"))


def all_spans(docs: DataFrame, support: int = SUPPORT, least: float = DISCLOSURE) -> DataFrame:
    """``id, text_hash, spans, found``: pattern spans, and term spans outside them, of each row."""
    base = base_spans(docs)
    found = _term_spans(base, disclosing_terms(docs, base, support, least))
    key = F.coalesce("id", F.lit(-(1 << 63)))
    free = F.filter("found", lambda w: ~F.exists("spans", lambda x: (x["s"] < w["e"]) & (w["s"] < x["e"])))
    return base.withColumn("key", key).join(found, ["key", "text_hash"], "left").select(
        "id", "text_hash", "spans", F.coalesce(free, F.slice("spans", 1, 0)).alias("found")
    )


def find_pii(docs: DataFrame, support: int = SUPPORT, least: float = DISCLOSURE) -> DataFrame:
    """Personal data of every row of ``docs`` (doc_id, text), whole texts.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256,
    spans``: base_sha256 hashes the pattern spans, spans lists all. Null text
    counts as empty and has none. Rows with a null doc_id are told apart by
    their text; repeated rows repeat; an empty table gives no rows.
    """
    found = all_spans(docs, support, least)

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *map(n, KINDS[:4]),
        F.size("found").cast("long").alias("n_term"),
        F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("spans", "found"))).alias("spans"),
    )


def sanitise(docs: DataFrame, support: int = SUPPORT, least: float = DISCLOSURE) -> DataFrame:
    """``doc_id, text`` with entities generalised to ``[KIND]`` and disclosing terms removed.

    Of overlapping spans the first stands for both. A null text stays null.
    """
    key = F.coalesce("id", F.lit(-(1 << 63)))
    spans = all_spans(docs, support, least).select(
        key.alias("key"), "text_hash", F.array_sort(F.concat("spans", "found")).alias("spans")
    ).where(F.size("spans") > 0).dropDuplicates(["key", "text_hash"])
    rows = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(spans, ["key", "text_hash"], "left")
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]], F.lit(""))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        part = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.element_at(labels, x["k"] + 1))
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), part.alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.select("doc_id", F.coalesce(folded, text).alias("text"))
