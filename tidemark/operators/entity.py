"""Parents as entities: profiles, matches across services and within a file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.components import LOCAL, block_components
from tidemark.plans.lineage import written

PHONES, EMAILS = ("Contact_Mobile", "Contact_Home", "Work_Phone"), ("Email", "Work_Email")
PERSON = ["first", "last", "dob"]


def profiles(df: DataFrame, row_col: str = "row_num", service_col: str = "ServiceID", file_col: str | None = None) -> DataFrame:
    """A row for each parent with a name: order, names, birth, legacy id, CRN, sets of phones and addresses.

    first, last, dob and legacy are in lower case, as they are compared; legacy_id, crn,
    name, birth, child and service_name are as the row has them. `file_col` adds source_file.
    """
    slots = []
    for i, p in enumerate(("Parent1", "Parent2")):
        has = lambda c, p=p: text.strip(f"{p}_{c}") if f"{p}_{c}" in df.columns else F.lit("")
        contacts = [text.contact_key(f"{p}_{c}") for c in PHONES if f"{p}_{c}" in df.columns]
        emails = [text.norm(f"{p}_{c}") for c in EMAILS if f"{p}_{c}" in df.columns]
        keep = lambda cs: F.array_distinct(F.array_remove(F.array(*cs), "")) if cs else F.array().cast("array<string>")
        shown = F.trim(F.concat_ws(" ", has("First_Name"), has("Last_Name")))
        slots.append(F.struct(F.lit(p).alias("slot"), (F.col(row_col) * 2 + i).alias("ord"), F.lower(has("First_Name")).alias("first"), F.lower(has("Last_Name")).alias("last"), F.lower(has("DOB")).alias("dob"), F.lower(has("Legacy_Account_ID")).alias("legacy"), has("CRN").alias("crn"), keep(contacts).alias("contacts"), keep(emails).alias("emails"), has("Legacy_Account_ID").alias("legacy_id"), has("DOB").alias("birth"), shown.alias("name")))
    of = lambda c: text.strip(c) if c in df.columns else F.lit("")
    child = F.trim(F.concat_ws(" ", of("Child_First_Name"), of("Child_Last_Name")))
    more = [text.strip(service_col).alias("service"), of("Service_Name").alias("service_name"), child.alias("child"), *([F.col(file_col).alias("source_file")] if file_col else [])]
    return df.select(row_col, *more, F.explode(F.array(*slots)).alias("p")).select(row_col, "service", "p.*", "service_name", "child", *(["source_file"] if file_col else [])).where("first <> '' or last <> ''")


def cross_service_matches(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Per new profile the first existing one with its names and a common birth date, phone or address.

    Equal legacy ids are no match, as the target system links these itself. Profiles
    meet on their names and one common value, never on the names alone. details names
    the values, of several common ones the least; source_file is the existing one's.
    """
    files = ["source_file"] if "source_file" in existing.columns else []

    def valued(p: DataFrame, *keep: str | Column) -> DataFrame:
        one = F.when(F.col("dob") != "", F.struct(F.lit("dob").alias("on"), F.col("dob").alias("value")))
        of = lambda c, kind: F.transform(c, lambda v: F.struct(F.lit(kind).alias("on"), v.alias("value")))
        every = F.concat(F.array_compact(F.array(one)), of("contacts", "contact"), of("emails", "email"))
        out = p.select("first", "last", *keep, F.explode(every).alias("by"))
        return out.select(*out.columns[:-1], "by.*")

    left = valued(new, "row_num", "slot", "legacy", "birth")
    right = valued(existing, *(F.col(c).alias(f"{c}2") for c in ("ord", "legacy", "service", *files)))
    pairs = left.join(right, ["first", "last", "on", "value"]).where(~((F.col("legacy") != "") & (F.col("legacy") == F.col("legacy2"))))
    value = F.struct(F.element_at(F.create_map(F.lit("dob"), F.lit(0), F.lit("contact"), F.lit(1), F.lit("email"), F.lit(2)), F.col("on")).alias("place"), "on", F.when(F.col("on") == "dob", F.col("birth")).otherwise(F.col("value")).alias("value"))
    nearest = pairs.groupBy("row_num", "slot", *(["source_file2"] if files else []), "ord2").agg(F.min_by(F.struct("service2", "legacy2"), "ord2").alias("e"), F.collect_set(value).alias("values"))
    first = nearest.groupBy("row_num", "slot").agg(F.min_by(F.struct("values", "e", F.col("ord2").alias("ord"), *(["source_file2"] if files else [])), F.struct(*(["source_file2"] if files else []), "ord2")).alias("m"))
    least = F.array_sort(F.col("m.values"))
    kinds = F.array_distinct(F.transform(least, lambda v: F.struct(v["place"].alias("place"), v["on"].alias("on"))))
    label = F.create_map(F.lit("dob"), F.lit("DOB"), F.lit("contact"), F.lit("Contact"), F.lit("email"), F.lit("Email"))
    shown = F.transform(kinds, lambda k: F.concat(label[k["on"]], F.lit(": "), F.array_min(F.transform(F.filter(least, lambda v: v["on"] == k["on"]), lambda v: v["value"]))))
    return first.select("row_num", "slot", F.array_join(F.transform(kinds, lambda k: k["on"]), ", ").alias("matched_on"), F.col("m.e.service2").alias("existing_service"), F.col("m.e.legacy2").alias("existing_legacy_id"), F.col("m.ord").alias("existing_ord"), F.array_join(shown, ", ").alias("details"), *([F.col("m.source_file2").alias("source_file")] if files else []))


def _by_phone(p: DataFrame, *keep: str) -> DataFrame:
    """(first, last, dob, contact, ord, base, keep): a row for each phone of the profiles with a birth date."""
    return p.where("dob <> ''").select(*PERSON, "ord", text.base_id("legacy").alias("base"), *keep, F.explode("contacts").alias("contact"))


def parent_pairs(p: DataFrame) -> DataFrame:
    """(first, last, dob, a, b, contact): profiles of one name and birth date with a common phone but other base ids.

    This is the report's list of pairs, as many as there are; links and clusters do without it.
    """
    left = _by_phone(p).withColumnsRenamed({"ord": "a", "base": "base_a"})
    right = _by_phone(p).withColumnsRenamed({"ord": "b", "base": "base_b"})
    pairs = left.join(right, [*PERSON, "contact"]).where("a < b and (base_a <> base_b or base_a = '')")
    return pairs.groupBy(*PERSON, "a", "b").agg(F.min("contact").alias("contact"))


def _earlier(phones: DataFrame, has: str) -> DataFrame:
    """(ord, parent): for each profile the latest earlier one that is linked to it and for which `has` is true.

    A profile's earlier ones of the same name, birth date and phone are linked to it unless they have
    its base id. The latest of these is the latest of all, or, if that has its base id, the latest
    of another base before that one; both run along in order, so no pairs are formed.
    """
    group = [*PERSON, "contact"]
    order = Window.partitionBy(*group).orderBy("ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    given = F.when(F.col(has), F.struct("ord", "base"))
    rows = phones.withColumn("prior", F.last(given, ignorenulls=True).over(before))
    # At a profile that has it and another base than the one before that has it, that one is the latest of another base.
    rows = rows.withColumn("turn", F.when(F.col(has) & F.col("prior").isNotNull() & (F.col("prior.base") != F.col("base")), F.col("prior.ord")))
    rows = rows.withColumn("other", F.last("turn", ignorenulls=True).over(before))
    linked = F.when((F.col("prior.base") != F.col("base")) | (F.col("base") == ""), F.col("prior.ord")).otherwise(F.col("other"))
    return rows.groupBy("ord").agg(F.max(linked).alias("parent")).where("parent is not null")


def _taken_over(p: DataFrame, field: str) -> DataFrame:
    """(ord, source): the profile whose own `field` each profile of `p` ends up with."""
    phones = written(_by_phone(p, field).withColumn("has", F.col(field) != ""), "phones")
    while True:
        # A blank profile that has an earlier one with the field has it too, and hands it on.
        parents = written(_earlier(phones, "has"), "parents")
        more = phones.where("not has").select("ord").distinct().join(parents.select("ord"), "ord", "left_semi")
        if more.isEmpty():
            break
        phones = written(phones.join(more.withColumn("more", F.lit(True)), "ord", "left").withColumn("has", F.col("has") | F.coalesce("more", F.lit(False))).drop("more"), "phones")
    ptr = parents
    while True:
        # Pointers double their reach until every one ends at a profile that takes over from none.
        over = ptr.select(F.col("ord").alias("parent"), F.col("parent").alias("next"))
        longer = written(ptr.join(over, "parent", "left").select("ord", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")), "pointers")
        ptr = longer.select("ord", "parent")
        if longer.where("moved").isEmpty():
            return phones.select("ord").distinct().join(ptr, "ord", "left").select("ord", F.coalesce("parent", "ord").alias("source"))


class _Phone:
    """Of one phone, the latest profile so far that has a field, and the latest of another base id than that one's."""

    __slots__ = ("latest", "other")

    def __init__(self):
        self.latest = self.other = None

    def linked(self, base: str):
        if self.latest is None or self.latest[1] != base or base == "":
            return self.latest
        return self.other

    def add(self, profile: tuple) -> None:
        if self.latest is not None and self.latest[1] != profile[1]:
            self.other = self.latest
        self.latest = profile


def _linked_in_order(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """(ord, fields) of rows (first, last, dob, ord, base, contacts, fields) sorted by person and order.

    One pass over a person's profiles: what each takes over depends on earlier ones alone.
    """
    now, phones = None, {}
    for b in batches:
        persons = zip(*(b.column(c).to_pylist() for c in PERSON))
        out = [[] for _ in fields]
        values = zip(*(b.column(f).to_pylist() for f in fields))
        for person, ord_, base, contacts, own in zip(persons, b.column("ord").to_pylist(), b.column("base").to_pylist(), b.column("contacts").to_pylist(), values):
            if person != now:
                now, phones = person, {}
            for i, value in enumerate(own):
                mine = [phones.setdefault((i, c), _Phone()) for c in contacts]
                best = max((x for x in (m.linked(base) for m in mine) if x is not None), default=None)
                value = best[2] if best is not None else value
                if value != "":
                    for m in mine:
                        m.add((ord_, base, value))
                out[i].append(value)
        yield pa.RecordBatch.from_arrays([b.column("ord"), *(pa.array(x, pa.string()) for x in out)], names=["ord", *fields])


def auto_link(p: DataFrame, local: int = LOCAL) -> DataFrame:
    """(ord, legacy, crn) after linking: of each pair in order the later takes over what the earlier then has, blanks apart.

    What a profile ends up with is thus what its latest linked predecessor with a value
    ends up with. Matches go by the ids as they were; ids and CRNs are taken over as written.
    Profiles of one person (name and birth date) are followed in order in one pass, whatever
    the chains among them; persons of more than `local` profiles go through rounds instead.
    """
    own = written(p.where("dob <> '' and size(contacts) > 0").select(*PERSON, "ord", "legacy", "contacts", "legacy_id", "crn"), "profiles")
    # There are at most as many such persons as the profiles over `local`.
    large = written(own.groupBy(*PERSON).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local).select(*PERSON), "large")
    none = large.isEmpty()
    few = own if none else own.join(F.broadcast(large), PERSON, "left_anti")
    placed = few.select(*PERSON, "ord", text.base_id("legacy").alias("base"), "contacts", "legacy_id", "crn").repartition(*PERSON).sortWithinPartitions(*PERSON, "ord")
    kind = own.schema["ord"].dataType.simpleString()
    out = placed.mapInArrow(lambda b: _linked_in_order(b, ["legacy_id", "crn"]), f"ord {kind}, legacy_id string, crn string").withColumnRenamed("legacy_id", "legacy")
    if none:
        return out
    many = written(own.join(F.broadcast(large), PERSON, "left_semi"), "many")
    rest = many.select("ord")
    for field, name in (("legacy_id", "legacy"), ("crn", "crn")):
        source = _taken_over(many, field).join(many.select(F.col("ord").alias("source"), F.col(field).alias(name)), "source").drop("source")
        rest = rest.join(source, "ord")
    return out.unionByName(rest)


def linked_rows(df: DataFrame, linked: DataFrame, row_col: str = "row_num") -> DataFrame:
    """The rows with the legacy ids and CRNs that linking gives their parents."""
    for i, slot in enumerate(("Parent1", "Parent2")):
        named = {f: f"{slot}_{c}" for f, c in (("legacy", "Legacy_Account_ID"), ("crn", "CRN")) if f"{slot}_{c}" in df.columns}
        mine = linked.where(F.col("ord") % 2 == i).select(F.floor(F.col("ord") / 2).cast("long").alias("_row"), *(F.col(f).alias(f"_{f}") for f in named))
        df = df.join(mine, F.col(row_col) == F.col("_row"), "left").withColumns({c: F.coalesce(f"_{f}", c) for f, c in named.items()}).drop("_row", *(f"_{f}" for f in named))
    return df


def link_issues(p: DataFrame, linked: DataFrame) -> DataFrame:
    """The two FIXED issues of each linked pair: row_num, field, severity, tag, action, related_row and matched_on.

    The earlier profile has its last id and CRN by then, as pairs go by their earlier profile.
    """
    side = lambda n: p.select(F.col("ord").alias(n), F.col("row_num").alias(f"row_{n}"), F.col("slot").alias(f"slot_{n}"), F.col("birth").alias(f"birth_{n}"))
    pairs = parent_pairs(p).select("a", "b", "contact").join(side("a"), "a").join(side("b"), "b").join(linked.withColumnRenamed("ord", "a"), "a")
    taken = F.concat(F.lit("Linked to first-created profile at row "), "row_a", F.lit(" (legacy '"), "legacy", F.lit("', CRN '"), "crn", F.lit("')"))
    kept = F.concat(F.lit("Kept as first-created profile; row "), "row_b", F.lit(" linked to it"))
    issue = lambda mine, other, action: F.struct(F.col(f"row_{mine}").alias("row_num"), F.concat(f"slot_{mine}", F.lit("_Legacy_Account_ID")).alias("field"), action.alias("action"), F.col(f"row_{other}").alias("related_row"))
    matched = F.concat(F.lit("DOB: "), "birth_a", F.lit(", Contact: "), "contact").alias("matched_on")
    return pairs.select(matched, F.explode(F.array(issue("a", "b", kept), issue("b", "a", taken))).alias("i")).select("i.row_num", "i.field", F.lit("FIXED").alias("severity"), F.lit("intra_file_duplicate_parent").alias("tag"), "i.action", "i.related_row", "matched_on")


def parent_clusters(p: DataFrame) -> DataFrame:
    """(ord, cluster, n_ids): clusters of linked profiles with at least two base ids.

    Profiles of one name, birth date and phone hang together as soon as two of them have
    different base ids, or one has none; so each such group gives a star, not its pairs.
    """
    phones = written(_by_phone(p), "phones")
    group = [*PERSON, "contact"]
    hubs = phones.groupBy(*group).agg(F.min("ord").alias("a"), F.count(F.lit(1)).alias("n"), (F.min("base") != F.max("base")).alias("differ"), (F.min("base") == "").alias("blank")).where("n > 1 and (differ or blank)")
    stars = written(phones.join(hubs, group).select(*PERSON, "a", F.col("ord").alias("b")).distinct(), "stars")
    nodes = stars.select(*PERSON, F.col("b").alias("ord")).distinct()
    found = block_components(nodes, stars, PERSON, "ord").join(phones.select("ord", "base").distinct(), "ord")
    many = found.groupBy("component").agg(F.count_distinct(text.or_null(F.col("base"))).alias("n_ids")).where("n_ids >= 2")
    return found.join(many, "component").select("ord", F.col("component").alias("cluster"), "n_ids")
