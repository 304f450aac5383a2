"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone
numbers. These seeds induce lexical patterns: the two words before them, the word
before and the word behind. In the graph of patterns and instances (seeds, and
other tokens and runs of digit groups that have a kind's form) scores go back and
forth: a pattern's score for a kind is the sum of its known instances' scores over
the number of its instances, an instance's is 1 for a seed and else 1 minus the
product of (1 - score) over its confident patterns. Patterns with enough known
instances and score give their other instances, where these have the kind's form;
those then count as known too, so that in the next round they induce patterns that
no seed has. The rounds end when one changes nothing; `rounds` can end them before. Of
discovered spans that overlap the longest stays, of equally long ones the first.
Base spans always stay.

Defined cases: null and empty texts have no spans; equal texts have equal spans;
repeated rows stay repeated; spans are in code points, end exclusive; words of any
length are contexts; other columns pass through, and columns named base or spans
are replaced.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, fresh
from tidemark.plans.lineage import join_groups, small, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. The look-behinds and possessive quantifiers change no match: no part after a
#: run can use what the run gives back, and a match cannot begin inside a run whose start fails.
#: They keep the search linear on very long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain at least, as a cheap test.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
TOKEN = r"(?<!\S)(?=\S*[0-9@])\S{5,}"
#: Two or more groups of digits, joined by a space or punctuation, as long as they go on.
RUN = r"(?<![0-9A-Za-z])[(+]?[0-9]++(?![A-Za-z@_])(?:(?:\)[ -]?|[ ./-]\(?)[0-9]++(?![A-Za-z@_]))++"
#: The forms that instances found by context must have.
FORMS = {"email": r"^[^\s@]+@[^\s@]+$", "ip": r"^[0-9A-Fa-f]+([.:][0-9A-Fa-f]+){3,}$", "card": r"^([0-9][^0-9A-Za-z]?){12,19}$", "phone": r"^[^A-Za-z]?([0-9][^0-9A-Za-z]{0,2}){7,15}$"}


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.coalesce(F.call_function("luhn_check", F.when(F.length(digits).between(16, 19), digits)), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str, needs: str | None, kind: str) -> Column:
    """Matches of a pattern, leftmost and non-overlapping: array of (kind, start, end, value).

    The pieces between matches give the offsets: both functions walk the same matches.
    """
    empty = F.array().cast(SPANS)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs:
        found = F.when(text.contains(needs), found)
    pieces = F.split(text, pattern, -1)

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    pairs = F.arrays_zip(found.alias("value"), F.slice(pieces, 1, F.size(found)).alias("gap"))
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0, walked).otherwise(empty)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add base: the valid base spans by kind as listed, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = fresh(docs, *KINDS)
    out = docs.withColumns({name: _spans(text, BASE[kind], NEEDS[kind], kind) for kind, name in zip(KINDS, found)})

    def valid(kind: str, name: str) -> Column:
        return F.filter(name, lambda s: _valid(kind, s["value"]))

    return out.withColumn("base", F.concat(*map(valid, KINDS, found))).drop(*found)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _form(kind: str, value: Column) -> Column:
    return value.rlike(FORMS[kind])


def _window(text: Column, start: Column, end: Column, size: int | None, ahead: bool) -> Column:
    """The `size` characters (null: all) behind the end, or before the start."""
    if ahead:
        return F.substring(text, end + 1, F.lit(size or 2**31 - 1))
    return F.substring(text, F.greatest(start - size + 1, F.lit(1)), F.least(start, F.lit(size))) if size else F.substring(text, F.lit(1), start)


def _around(text: Column, start: Column, end: Column, ahead: bool) -> Column:
    """Text before or behind a span that holds two whole words before it, or one behind: a short piece if that does, else a longer one, else all of it."""
    whole = r"\S\s" if ahead else r"\s\S+\s+\S+\s*$"
    edge = (lambda n: end + n >= F.length(text)) if ahead else (lambda n: start <= n)
    small, large = (_window(text, start, end, n, ahead) for n in (64, 2048))
    return F.when(edge(64) | small.rlike(whole), small).when(edge(2048) | large.rlike(whole), large).otherwise(_window(text, start, end, None, ahead))


def occurrences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, kind, start, end, raw, value, context): base spans and, with a null kind, tokens and runs of digit groups apart from them that have some kind's form.

    A row for each context, or one with a null context: the last two words and the last
    one before, and the first one behind, in lower case, without the punctuation that
    stands at the instance. value is the instance in lower case without it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.where(text.rlike("[0-9@]")).select(text.alias("text"), F.md5(text.cast("binary")).alias("key"))
    some = base_spans(some).withColumn("token", F.array_distinct(F.concat(_spans(F.col("text"), TOKEN, None, "token"), _spans(F.col("text"), RUN, None, "token"))))
    free = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    free = F.transform(free, lambda t: F.struct(F.lit(None).cast("string").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value")))
    some = some.withColumn("span", F.explode(F.concat("base", free)))
    some = some.withColumn("value", F.regexp_replace(ascii_lower(F.col("span.value")), r"^[(\[{<\"']+|[.,;:!?)\]}>\"']+$", ""))
    value = F.col("value")
    some = some.where(F.col("span.kind").isNotNull() | _form("email", value) | _form("ip", value) | _form("card", value) | _form("phone", value))
    start, end = F.col("span.start"), F.col("span.end")
    before = F.regexp_replace(_around(F.col("text"), start, end, False), r"(?<![(\[{<\"'])[(\[{<\"']++$", "")
    behind = F.regexp_replace(_around(F.col("text"), start, end, True), r"^[.,;:!?)\]}>\"']+", "")
    some = some.withColumns({"before": F.filter(F.split(ascii_lower(before), r"\s+"), lambda w: w != ""), "behind": F.filter(F.split(ascii_lower(behind), r"\s+"), lambda w: w != "")})
    two = F.when(F.size("before") >= 2, F.concat(F.lit("2< "), F.array_join(F.slice("before", -2, 2), " ")))
    one = F.when(F.size("before") >= 1, F.concat(F.lit("1< "), F.element_at("before", -1)))
    right = F.when(F.size("behind") >= 1, F.concat(F.lit("1> "), F.element_at("behind", 1)))
    return some.select("key", "span.kind", "span.start", "span.end", F.col("span.value").alias("raw"), "value", F.explode_outer(F.array_compact(F.array(two, one, right))).alias("context"))


def _apart(spans: Column) -> Column:
    """Of overlapping spans the longest, of equally long ones the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("size"), s.alias("span"))))
    keep = lambda acc, x: F.when(F.exists(acc, lambda o: (o["start"] < x["span"]["end"]) & (x["span"]["start"] < o["end"])), acc).otherwise(F.array_append(acc, x["span"]))
    return F.aggregate(ordered, F.array().cast(SPANS), keep)


def _known_form() -> Column:
    return F.coalesce(*(F.when(F.col("kind") == k, _form(k, F.col("value"))) for k in KINDS), F.lit(False))


def bootstrap(seen: DataFrame, *, rounds: int | None, min_score: float, min_known: int) -> tuple[DataFrame, DataFrame] | None:
    """The confident patterns (context, kind) and the discovered instances (value, kind), or None.

    Of a pattern only counts and sums over its distinct instances are kept. A pattern of
    fewer than `min_known` instances can never be confident and leaves first. Scores only
    grow from round to round, as known instances are only added. Seeds are told from
    discovered instances by a flag: many confident patterns round a score to 1 as well.
    """
    edges = written(seen.where("context is not null").select("context", "value", "kind").distinct(), "edges")
    pairs = edges.select("context", "value").distinct()
    sizes = pairs.groupBy("context").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_known)
    links = written(join_groups(pairs, sizes, ["context"], "n", max(1000, edges.count() // 1000)), "links")
    seeds = written(edges.where("kind is not null").select("value", "kind").distinct(), "seeds")
    known, last, patterns, found = seeds.withColumn("score", F.lit(1.0)), None, None, None
    for _ in itertools.count() if rounds is None else range(rounds):
        patterns = links.join(known, "value").groupBy("context", "kind").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("known"), F.max("n").alias("n"))
        patterns = written(patterns.withColumn("score", F.col("total") / F.col("n")).where((F.col("score") >= min_score) & (F.col("known") >= min_known)).select("context", "kind", "score"), "patterns")
        found = links.join(patterns, "context").where(_known_form()).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("score"))
        found = written(found.where(F.col("score") >= min_score).join(seeds, ["value", "kind"], "left_anti"), "found")
        now = found.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 9).alias("score")).first()
        if not now.n:
            return None
        if now == last:
            break
        last, known = now, seeds.withColumn("score", F.lit(1.0)).unionByName(found)
    # A value that is a seed of some kind is discovered in none.
    best = found.join(seeds.select("value"), "value", "left_anti").groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return patterns.select("context", "kind"), best


def spans_by_text(docs: DataFrame, *, text_col: str = "text", rounds: int | None = None, min_score: float = 0.6, min_known: int = 3) -> DataFrame:
    """(key, base, spans) of the texts that have spans, by the MD5 of the text; both by kind as listed, then start."""
    seen = written(occurrences(docs, text_col), "occurrences")
    one = F.struct("kind", "start", "end", F.col("raw").alias("value"))
    found = seen.where("kind is not null").groupBy("key").agg(F.collect_set(one).alias("base")).withColumn("more", F.array().cast(SPANS))
    if learnt := bootstrap(seen, rounds=rounds, min_score=min_score, min_known=min_known):
        patterns, best = learnt
        more = seen.where("kind is null").drop("kind").join(best, "value").join(patterns, ["context", "kind"], "left_semi")
        more = more.groupBy("key").agg(_apart(F.collect_set(F.struct("kind", "start", "end", "value"))).alias("more"))
        both = found.drop("more").join(more, "key", "full")
        found = both.select("key", *(F.coalesce(c, F.array().cast(SPANS)).alias(c) for c in ("base", "more")))
    place = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))

    def in_order(spans: Column) -> Column:
        keyed = F.transform(spans, lambda s: F.struct(place[s["kind"]].alias("place"), s["start"].alias("start"), s.alias("span")))
        return F.transform(F.array_sort(keyed), lambda s: s["span"])

    return written(found.select("key", in_order(F.col("base")).alias("base"), in_order(F.concat("base", "more")).alias("spans")), "spans")


def find_personal_data(docs: DataFrame, *, text_col: str = "text", rounds: int | None = None, min_score: float = 0.6, min_known: int = 3, broadcast_rows: int = 500_000) -> DataFrame:
    """Add base (the base spans) and spans (these and the discovered ones), by kind as listed, then start.

    Patterns are matched once a text; the spans then meet the rows by the text's MD5. Up to
    `broadcast_rows` texts with spans, and 64 MB of them, are broadcast; beyond that
    rows are shuffled by the MD5, without the text where it is not asked for.
    """
    found = spans_by_text(docs, text_col=text_col, rounds=rounds, min_score=min_score, min_known=min_known)
    key, base, spans = fresh(docs, *found.columns)
    out = docs.join(small(found, broadcast_rows).toDF(key, base, spans), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) == F.col(key), "left")
    return out.withColumns({"base": F.coalesce(base, F.array().cast(SPANS)), "spans": F.coalesce(spans, F.array().cast(SPANS))}).drop(key, base, spans)
