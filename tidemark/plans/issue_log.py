"""One log of all issues of a families run, in order.

Every pass says what it finds in one form (LOG): the pass and its place, the row,
the child's name, field, severity, value, a text that names the values, what was
done, a tag, and further values by name. Entries are sorted by ranges and numbered on
from 1: by pass, row, the rule's place in its pass and field, so a log of any size is
in order without a window over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import crossrow, entity
from tidemark.plans import repairs
from tidemark.plans.lineage import written
from tidemark.plans.numbering import in_sequence
from tidemark.plans.rules import Rule, row_rules
from tidemark.plans.rules import issues as rule_issues

#: The passes, in their order; the place of each is its number from 1.
PASSES = ("services", "states", "repairs", "row rules", "repeated children", "shared addresses", "shared CRNs", "enrolment CRNs", "linked parents")
LOG = "pass int, pass_name string, row_num long, place int, field string, severity string, value string, text string, action string, tag string, meta map<string,string>"


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _entries(found: DataFrame, name: str, *, field: Column, severity: Column, value: Column, said: Column, place: Column | None = None, action: Column | None = None, tag: Column | None = None, meta: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    cells = {
        "pass": F.lit(PASSES.index(name) + 1), "pass_name": F.lit(name), "row_num": F.col("row_num").cast("long"), "place": (F.lit(0) if place is None else place).cast("int"), "field": field, "severity": severity, "value": value, "text": said,
        "action": F.lit("") if action is None else action, "tag": none if tag is None else tag, "meta": F.create_map().cast("map<string,string>") if meta is None else meta,
    }
    return found.select(*(c.alias(n) for n, c in cells.items()))


def _services(raw: DataFrame, service_map: DataFrame) -> DataFrame:
    found = repairs.service_issues(raw, service_map, ["row_num"])
    return _entries(found, "services", field=F.col("field"), severity=F.col("severity"), value=F.lit(None).cast("string"), said=F.col("description"), action=F.col("action"), place=F.when(F.col("field") == "ServiceID", 0).otherwise(1))


def _fixes(logged: DataFrame, name: str, steps: list[tuple]) -> DataFrame:
    """Fixes of some steps, a step's place being its number among them."""
    found = repairs.fixed_issues(logged, ["row_num"])
    place = F.coalesce(*(F.when(F.col("action") == step[2], i) for i, step in enumerate(steps)), F.lit(len(steps)))
    said = _say(F.col("field"), " '", F.col("before"), "' became '", F.col("after"), "': ", F.col("action"))
    return _entries(found, name, field=F.col("field"), severity=F.col("severity"), value=F.col("before"), said=said, place=place, action=F.col("action"), tag=F.col("tag"), meta=F.create_map(F.lit("after"), F.coalesce("after", F.lit(""))))


def _rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    found = rule_issues(rows, rules, ["row_num"])
    names = {r.name: i for i, r in reversed(list(enumerate(rules)))}
    place = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("rule")) if names else F.lit(0)
    said = F.when(text.is_blank("value"), _say(F.col("field"), ": ", F.col("description"))).otherwise(_say(F.col("field"), " '", F.col("value"), "': ", F.col("description")))
    return _entries(found, "row rules", field=F.col("field"), severity=F.col("severity"), value=F.col("value"), said=said, place=place, tag=F.col("rule"))


def _cross(rows: DataFrame) -> list[DataFrame]:
    out, error, has = [], F.lit("ERROR"), set(rows.columns)
    for i, f in enumerate(x for x in ("Child_Legacy_Id", "Child_CRN") if x in has):
        found = crossrow.duplicate_members(rows, f)
        said = _say(f"{f} '", F.col("key"), "' is that of ", F.col("n"), " rows, the first of which is row ", F.col("first_row"))
        out.append(_entries(found, "repeated children", field=F.lit(f), severity=error, value=F.col("key"), said=said, place=F.lit(i), meta=F.create_map(F.lit("first_row"), F.col("first_row").cast("string"), F.lit("rows"), F.col("n").cast("string"))))
    for i, p in enumerate(x for x in ("Parent1", "Parent2") if f"{x}_Email" in has):
        found = crossrow.email_conflicts(rows, p, p == "Parent1")
        said = _say(F.col("field"), " '", F.col("key"), "' is that of ", F.col("n"), " rows")
        out.append(_entries(found, "shared addresses", field=F.col("field"), severity=F.col("severity"), value=F.col("key"), said=said, place=F.lit(i)))
    for i, p in enumerate(x for x in ("Parent1", "Parent2") if {f"{x}_CRN", f"{x}_Email"} <= has):
        found = crossrow.crn_registry(rows, p)
        said = _say(f"{p}_CRN '", F.col("key"), "' goes with the addresses ", F.col("emails"))
        out.append(_entries(found, "shared CRNs", field=F.col("field"), severity=error, value=F.col("key"), said=said, place=F.lit(i)))
    if "Enrolment_Parent_CRN" in has:
        found = crossrow.enrolment_crn_unknown(rows)
        out.append(_entries(found, "enrolment CRNs", field=F.lit("Enrolment_Parent_CRN"), severity=error, value=F.col("value"), said=_say("Enrolment_Parent_CRN '", F.col("value"), "' is neither parent's CRN")))
    return out


def families_log(raw: DataFrame, service_map: DataFrame, as_of: str, more_rules: list[Rule] | None = None) -> DataFrame:
    """(ordinal, LOG, child_name) of a whole families run: rows as read (with row_num), the service map, and the day that counts as today."""
    # A compact file has few ranges, and each of its rows is tested by all rules: rows are dealt to all tasks first.
    raw = written(raw.repartition("row_num"), "raw")
    scope = written(repairs.in_scope(raw, service_map), "scope")
    modal = repairs.modal_states(scope)
    state_step = (lambda df: repairs.normalise_states(df, modal), repairs.STATE_COLUMNS, "set to a state's code", {})
    stated = written(repairs.logged_repairs(scope, [state_step]), "stated")
    repaired = written(repairs.logged_repairs(stated.drop("fixes")), "repaired")
    rows = repaired.drop("fixes")
    people = written(entity.profiles(rows), "people")
    linked = entity.link_issues(people, entity.auto_link(people))
    said = _say(F.col("field"), " is that of the parent in row ", F.col("related_row"), " (", F.col("matched_on"), ")")
    parts = [
        _services(raw, service_map), _fixes(stated, "states", [state_step]), _fixes(repaired, "repairs", repairs.STEPS), _rules(rows, row_rules(rows.columns, as_of) + (more_rules or [])), *_cross(rows),
        _entries(linked, "linked parents", field=F.col("field"), severity=F.col("severity"), value=F.lit(None).cast("string"), said=said, action=F.col("action"), tag=F.col("tag"), meta=F.create_map(F.lit("related_row"), F.col("related_row").cast("string"), F.lit("matched_on"), F.col("matched_on"))),
    ]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    children = raw.select(F.col("row_num").cast("long").alias("row_num"), text.child_name().alias("child_name"))
    return in_sequence(log.join(children, "row_num", "left"), ["pass", "row_num", "place", "field", "text"], "ordinal")
