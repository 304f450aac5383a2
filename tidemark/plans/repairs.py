"""Repairs: each takes a DataFrame and returns it with columns replaced.

`changes` compares a frame's columns before and after, for the FIXED issues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans.numbering import numbered
from tidemark.plans.rules import CONTACT_FLAGS, CONTACTS, NAME_SLOTS, PARENTS, PHONES, STATE_COLUMNS


def _resolved(df: DataFrame, service_map: DataFrame, id_col: str) -> DataFrame:
    """Add _v (the id, trimmed) and _hit (source, target, name) or null. One keyed lookup table serves all three ways."""
    m = service_map.where(~text.is_blank("target_service_id"))
    target, name = text.strip("target_service_id"), text.strip("service_name")
    ways = [(1, "target", target), (2, "source", text.strip("source_service_id")), (2, "source", text.strip("source_full_id")), (3, "name", text.norm("service_name"))]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("way"), F.lit(s).alias("source"), k.alias("key")) for i, s, k in ways))).alias("k")
    known = m.select(keys, target.alias("target"), name.alias("name"), "map_ord").where("k.key <> ''")
    known = known.groupBy("k.way", "k.source", "k.key").agg(F.max_by(F.struct("target", "name"), "map_ord").alias("found"))
    best = known.select("way", "source", "key", "found.target", "found.name")
    # A value can hit at most one row a way; of the ways the first counts.
    exact = best.where("way < 3").groupBy("key").agg(F.min_by(F.struct("source", "target", "name"), "way").alias("_a")).withColumnRenamed("key", "_ak")
    named = best.where("way = 3").select(F.col("key").alias("_nk"), F.struct("source", "target", "name").alias("_n"))
    out = df.withColumn("_v", text.strip(id_col)).join(exact, F.col("_v") == F.col("_ak"), "left").join(named, F.lower("_v") == F.col("_nk"), "left")
    return out.withColumn("_hit", F.coalesce("_a", "_n")).drop("_a", "_ak", "_n", "_nk")


def _wrong_name(name_col: str) -> Column:
    return F.col("_hit").isNotNull() & ~text.is_blank(name_col) & (F.col("_hit.name") != "") & (text.strip(name_col) != F.col("_hit.name"))


def map_services(df: DataFrame, service_map: DataFrame, id_col: str = "ServiceID", name_col: str = "Service_Name") -> DataFrame:
    """Resolve ids to target ids: a target id stands, else the source id (short or full), else the name.

    `service_map`: service_name, source_full_id, source_service_id, target_service_id, map_ord; the last row of a key
    wins. Adds id_source: target, source, name, blank or unknown.
    """
    out = _resolved(df, service_map, id_col)
    fixed_name = F.when(_wrong_name(name_col), F.col("_hit.name")).otherwise(text.text(name_col))
    out = out.withColumn("id_source", F.when(F.col("_v") == "", F.lit("blank")).otherwise(F.coalesce("_hit.source", F.lit("unknown"))))
    return out.withColumns({name_col: fixed_name, id_col: F.coalesce("_hit.target", text.text(id_col))}).drop("_v", "_hit")


def service_issues(df: DataFrame, service_map: DataFrame, keep: list[str], id_col: str = "ServiceID", name_col: str = "Service_Name") -> DataFrame:
    """The issues of that mapping: `keep`, field, severity, description and action.

    FIXED for ids that were mapped and names that were corrected, WARNING for ids that
    the map does not know in any way.
    """
    v, target, name, way = F.col("_v"), F.col("_hit.target"), F.col("_hit.name"), F.col("_hit.source")
    given = text.strip(name_col) if name_col in df.columns else F.lit("")
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))

    def issue(when, field, severity, description, action):
        return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(severity).alias("severity"), description.alias("description"), action.alias("action")))

    found = [
        issue(way == "source", id_col, "FIXED", say("Source service ID '", v, "' mapped to target service ID '", target, "' (", name, ")."), say("Service ID updated: ", v, " → ", target, " (", name, ")")),
        issue(way == "name", id_col, "FIXED", say("Service name '", v, "' resolved to target service ID '", target, "' (", name, ")."), say("Service ID updated from name: '", v, "' → '", target, "' (", name, ")")),
        issue((v != "") & F.col("_hit").isNull(), id_col, "WARNING", say("Service ID '", v, "' was not found in the service map (checked as target ID, source ID and name)."), F.lit("")),
    ]
    if name_col in df.columns:
        found.append(issue(_wrong_name(name_col), name_col, "FIXED", say(f"{name_col} '", given, "' does not match the canonical name '", name, "' for service ID '", target, "'."), say(f"{name_col} corrected: '", given, "' → '", name, "'")))
    each = _resolved(df, service_map, id_col).select(*keep, F.explode(F.array_compact(F.array(*found))).alias("issue"))
    return each.select(*keep, "issue.*")


def modal_states(df: DataFrame, service_col: str = "ServiceID", state_col: str = "State", order_col: str = "row_num") -> DataFrame:
    """(service, modal_state): the most frequent valid code as given, of equal ones that seen first."""
    seen = df.select(text.strip(service_col).alias("service"), F.upper(text.strip(state_col)).alias("state"), F.col(order_col).alias("o"))
    seen = seen.where((F.col("service") != "") & F.col("state").isin(*text.STATES)).groupBy("service", "state").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    return seen.groupBy("service").agg(F.max_by("state", F.struct("n", -F.col("o"))).alias("modal_state"))


def normalise_states(df: DataFrame, modal: DataFrame, service_col: str = "ServiceID") -> DataFrame:
    out = df.join(modal.withColumnRenamed("service", "_s"), text.strip(service_col) == F.col("_s"), "left")
    return out.withColumns({c: text.state_code(c, F.col("modal_state")) for c in STATE_COLUMNS if c in df.columns}).drop("_s", "modal_state")


def dedup_emails(df: DataFrame) -> DataFrame:
    """Clear a second parent's address that is the first's, and a contact's that an earlier contact has."""
    new = {}
    if {"Parent1_Email", "Parent2_Email"} <= set(df.columns):
        same = (text.norm("Parent2_Email") != "") & (text.norm("Parent2_Email") == text.norm("Parent1_Email"))
        new["Parent2_Email"] = F.when(same, "").otherwise(F.col("Parent2_Email"))
    fields = [f"{c}_Email" for c in CONTACTS if f"{c}_Email" in df.columns]
    for i, f in enumerate(fields[1:], 1):
        before = F.array(*(text.norm(x) for x in fields[:i]))
        new[f] = F.when((text.norm(f) != "") & F.array_contains(before, text.norm(f)), "").otherwise(F.col(f))
    return df.withColumns(new) if new else df


def clear_redundant_contacts(df: DataFrame) -> DataFrame:
    """Clear a contact's address that a parent has."""
    parents = [text.norm(f) for f in ("Parent1_Email", "Parent2_Email") if f in df.columns]
    fields = [f"{c}_Email" for c in CONTACTS if f"{c}_Email" in df.columns]
    if not parents or not fields:
        return df
    return df.withColumns({f: F.when((text.norm(f) != "") & text.norm(f).isin(*parents), "").otherwise(F.col(f)) for f in fields})


def clear_shared_crn(df: DataFrame) -> DataFrame:
    """Clear a child's CRN that is a parent's."""
    parents = [text.strip(f) for f in ("Parent1_CRN", "Parent2_CRN") if f in df.columns]
    if "Child_CRN" not in df.columns or not parents:
        return df
    child = text.strip("Child_CRN")
    return df.withColumn("Child_CRN", F.when((child != "") & child.isin(*parents), "").otherwise(F.col("Child_CRN")))


def fill_first_names(df: DataFrame) -> DataFrame:
    slots = [s for s in NAME_SLOTS if {f"{s}_First_Name", f"{s}_Last_Name"} <= set(df.columns)]
    return df.withColumns({f"{s}_First_Name": F.when(text.is_blank(f"{s}_First_Name") & ~text.is_blank(f"{s}_Last_Name"), text.strip(f"{s}_Last_Name")).otherwise(F.col(f"{s}_First_Name")) for s in slots})


def prefix_legacy_ids(df: DataFrame, service_col: str = "ServiceID") -> DataFrame:
    """Prefix children's ids by the service id; mark by _1 the id of a second parent who is the first one (name, birth and id)."""
    new = {}
    child, service = text.strip("Child_Legacy_Id"), text.strip(service_col)
    new["Child_Legacy_Id"] = F.when((child == "") | (child == "0") | (service == ""), F.col("Child_Legacy_Id")).otherwise(F.concat_ws("_", service, child))
    parts = ["First_Name", "Last_Name", "DOB", "Legacy_Account_ID"]
    if {f"{p}_{x}" for p in PARENTS for x in parts} <= set(df.columns):
        two = "Parent2_Legacy_Account_ID"
        key = lambda p: F.struct(text.norm(f"{p}_First_Name"), text.norm(f"{p}_Last_Name"), text.strip(f"{p}_DOB"), text.strip(f"{p}_Legacy_Account_ID"))
        given = ~text.is_blank("Parent1_First_Name") & ~text.is_blank("Parent1_DOB") & ~text.is_blank("Parent1_Legacy_Account_ID") & (service != "")
        new[two] = F.when(given & (key("Parent1") == key("Parent2")), F.concat(text.strip(two), F.lit("_1"))).otherwise(F.col(two))
    return df.withColumns(new)


def fix_phones(df: DataFrame) -> DataFrame:
    """A leading zero for numbers of digits only that lack one; what begins with + stays."""
    plain = lambda f: F.regexp_replace(text.strip(f), r"[\s\-()]", "")
    return df.withColumns({f: F.when(plain(f).rlike(r"^[1-9]\d*$"), F.concat(F.lit("0"), text.strip(f))).otherwise(F.col(f)) for f in PHONES if f in df.columns})


def default_consent(df: DataFrame, fields: tuple[str, ...] = ("Consents_Photos", "Consents_Photos_Videos")) -> DataFrame:
    return df.withColumns({f: F.when(text.is_blank(f), "N").otherwise(F.col(f)) for f in fields if f in df.columns})


def booleans_to_bits(df: DataFrame) -> DataFrame:
    return df.withColumns({f: F.when(text.norm(f) == "true", "1").when(text.norm(f) == "false", "0").otherwise(F.col(f)) for f in CONTACT_FLAGS if f in df.columns})


def in_scope(df: DataFrame, service_map: DataFrame, *, drop_waitlist: bool = False) -> DataFrame:
    """The rows to import, with target ids: those of known services and, if asked, not of the waitlist."""
    if drop_waitlist and "Status" in df.columns:
        df = df.where(text.norm("Status") != "waitlist")
    return map_services(df, service_map).where("id_source in ('target', 'source', 'name')").drop("id_source")


#: The tags of issues that go to clients.
DUPLICATE_EMAIL, REDUNDANT_CONTACT = "duplicate_parent_email", "redundant_ec"


def _emails(*people: str) -> list[str]:
    return [f"{p}_Email" for p in people]


#: The repairs after the mapping of services, in their order: step, fields, what it does, and a tag by field.
STEPS = [
    (dedup_emails, _emails("Parent2", *CONTACTS), "cleared repeated address", {"Parent2_Email": DUPLICATE_EMAIL}),
    (clear_shared_crn, ["Child_CRN"], "cleared a parent's CRN", {}),
    (fill_first_names, [f"{s}_First_Name" for s in NAME_SLOTS], "took the last name", {}),
    (prefix_legacy_ids, ["Child_Legacy_Id", "Parent2_Legacy_Account_ID"], "marked the id", {}),
    (fix_phones, PHONES, "added the leading zero", {}),
    (default_consent, ["Consents_Photos", "Consents_Photos_Videos"], "set to N", {}),
    (booleans_to_bits, CONTACT_FLAGS, "written as 0 or 1", {}),
    (clear_redundant_contacts, _emails(*CONTACTS), "cleared a parent's address", dict.fromkeys(_emails(*CONTACTS), REDUNDANT_CONTACT)),
]


def logged_repairs(df: DataFrame, steps: list[tuple] | None = None) -> DataFrame:
    """Apply the steps and add fixes, an array of (field, before, after, action, tag), all in one narrow pass."""
    fix = "array<struct<field:string,before:string,after:string,action:string,tag:string>>"
    df = df.withColumn("fixes", F.array().cast(fix))
    for step, fields, action, tags in STEPS if steps is None else steps:
        fields = [f for f in fields if f in df.columns]
        before = {f"_before_{i}": F.col(f) for i, f in enumerate(fields)}
        if not fields:
            continue
        df = step(df.withColumns(before))
        pairs = [(f, F.col(b), F.col(f)) for f, b in zip(fields, before)]
        found = F.array(*(F.when(~old.eqNullSafe(new), F.struct(F.lit(f).alias("field"), old.alias("before"), new.alias("after"), F.lit(action).alias("action"), F.lit(tags.get(f)).cast("string").alias("tag"))) for f, old, new in pairs))
        df = df.withColumn("fixes", F.concat("fixes", F.array_compact(found))).drop(*before)
    return df


def fixed_issues(logged: DataFrame, keep: list[str]) -> DataFrame:
    """The fixes as issues: `keep` columns, field, before, after, action, tag and the severity FIXED."""
    # An inner explode would infer a filter on `fixes`, which the optimizer then copies through all repairs.
    each = logged.select(*keep, F.explode_outer("fixes").alias("fix")).where("fix is not null")
    return each.select(*keep, "fix.*", F.lit("FIXED").alias("severity"))


def repair(df: DataFrame, service_map: DataFrame, *, drop_waitlist: bool = False) -> DataFrame:
    """All repairs in their order, up to the row rules. Rows of unknown services leave, as the map then lists others."""
    df = in_scope(df, service_map, drop_waitlist=drop_waitlist)
    df = normalise_states(df, modal_states(df))
    for step in (dedup_emails, clear_shared_crn, fill_first_names, prefix_legacy_ids, fix_phones, default_consent, booleans_to_bits):
        df = step(df)
    return df


def changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) of changed values: FIXED issues."""
    b = before.select(key, F.struct(*fields).alias("_b"))
    pairs = after.join(b, key).select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_b.{f}").alias("before"), F.col(f).alias("after")) for f in fields))).alias("c"))
    return pairs.select(key, "c.*").where("not (before <=> after)")


def split_rows(df: DataFrame, service_col: str = "ServiceID", order_col: str = "row_num") -> DataFrame:
    """Add service (Unknown if blank) and split_row, the row's number from 2 in its service's file."""
    service = F.coalesce(text.or_null(text.strip(service_col)), F.lit("Unknown"))
    return numbered(df.withColumn("service", service), ["service"], order_col, "split_row", first=2)
