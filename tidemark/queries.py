"""Registered queries of the data-quality library, over the views of fixtures.py, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixtures import view, with_views
from tidemark.functions import dates, text
from tidemark.operators import balances, bookings, crossrow, entity, names, payments, reports
from tidemark.plans import issue_log, lineage, repairs, rules
from tidemark.plans.lineage import written
from tidemark.plans.numbering import in_sequence
from tidemark.sources import readers, sinks, split_csv

AS_OF = "2025-01-01"
QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (view reader) -> DataFrame as a query, with its SQL over the views."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register


# SQL fragments of the oracles.
_DATE = lambda c: f"CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime({c}, '%Y-%m-%d') WHEN regexp_matches({c}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN try_strptime({c}, '%d/%m/%Y') END"
_T = lambda c: f"trim(coalesce({c}, ''))"
_MAIL = r"'^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$'"
_PHONE = r"'^(\+?61[\s\-]?|0)([2378]\d[\s\-]?\d{4}[\s\-]?\d{4}|4\d{2}[\s\-]?\d{3}[\s\-]?\d{3})$'"
_PLAIN = lambda c: rf"regexp_replace({_T(c)}, '[\s\-()]', '', 'g')"


def _bad(field: str, severity: str, test: str, blank_too: bool = False, src: str = "fx_families") -> str:
    given = "" if blank_too else f"{_T(field)} <> '' AND "
    return f"SELECT row_num, '{field}' AS field, '{severity}' AS severity FROM {src} WHERE {given}({test})"


_FORMS = (
    [_bad(f, "ERROR", f"({_DATE(_T(f))}) IS NULL") for f in ("DOB", "Enrolment_Start_Date", "Parent1_DOB", "Parent2_DOB")]
    + [_bad(f, "ERROR", rf"NOT regexp_matches({_T(f)}, '^\d{{9}}[A-Za-z]$')") for f in ("Child_CRN", "Parent1_CRN")]
    + [_bad(f, "ERROR", f"NOT regexp_matches({_T(f)}, {_MAIL})") for f in ("Parent1_Email", "Parent2_Email", "EmergencyContact1_Email", "EmergencyContact2_Email")]
    + [_bad(f, "WARNING", rf"NOT (regexp_matches({_PLAIN(f)}, '^4\d{{8}}$') OR regexp_matches({_PLAIN(f)}, {_PHONE}))") for f in ("Parent1_Contact_Mobile", "Parent2_Contact_Mobile")]
    + [_bad("PostCode", "WARNING", rf"NOT regexp_matches({_T('PostCode')}, '^\d{{4}}$')")]
)
_ISSUES = " UNION ALL ".join(_FORMS)
_FORM_RULES = ("date", "crn", "email", "phone", "postcode")


def _form_issues(families: DataFrame) -> DataFrame:
    return rules.issues(families, [r for r in rules.row_rules(families.columns, AS_OF) if r.name in _FORM_RULES], ["row_num", "ServiceID"])


@query(f"WITH i AS ({_ISSUES}) SELECT field, severity, count(*) AS n FROM i GROUP BY ALL")
def issue_counts_by_rule(v):
    return _form_issues(v("fx_families")).groupBy("field", "severity").agg(F.count(F.lit(1)).alias("n"))


_KEYS = """WITH keys AS (
 SELECT 1 AS way, 'target' AS src, target_service_id AS k, target_service_id AS t, service_name AS n FROM fx_service_map
 UNION ALL SELECT 2, 'source', source_service_id, target_service_id, service_name FROM fx_service_map
 UNION ALL SELECT 2, 'source', source_full_id, target_service_id, service_name FROM fx_service_map
 UNION ALL SELECT 3, 'name', lower(service_name), target_service_id, service_name FROM fx_service_map),
m AS (SELECT f.*, src, t, n FROM fx_families f LEFT JOIN keys ON k = CASE WHEN way = 3 THEN lower(ServiceID) ELSE ServiceID END)"""


@query(_KEYS + " SELECT row_num, coalesce(t, ServiceID) AS ServiceID, coalesce(n, Service_Name) AS Service_Name, coalesce(src, 'unknown') AS id_source FROM m")
def map_service_ids(v):
    return repairs.map_services(v("fx_families"), v("fx_service_map")).select("row_num", "ServiceID", "Service_Name", "id_source")


_MODAL = "s AS (SELECT ServiceID AS service, upper(trim(State)) AS st, count(*) AS n, min(row_num) AS o FROM fx_families WHERE upper(trim(State)) IN ('NSW','VIC','QLD','SA','WA','TAS','ACT','NT') GROUP BY ALL), modal AS (SELECT service, arg_max(st, n * 1000000000 - o) AS modal_state FROM s GROUP BY service)"


@query(f"WITH {_MODAL} SELECT * FROM modal")
def modal_state(v):
    return repairs.modal_states(v("fx_families"))


_SPELL = "WHEN lower(trim(State)) IN ('victoria', 'vic') THEN 'VIC' WHEN lower(trim(State)) = 'n.s.w.' THEN 'NSW' WHEN lower(trim(State)) = 'qld' THEN 'QLD' WHEN lower(trim(State)) = 'tassie' THEN 'TAS'"


@query(f"WITH {_MODAL} SELECT row_num, CASE WHEN trim(State) = '' THEN '' WHEN upper(trim(State)) IN ('NSW','VIC','QLD','SA','WA','TAS','ACT','NT') THEN upper(trim(State)) {_SPELL} ELSE coalesce(modal_state, trim(State)) END AS State FROM fx_families LEFT JOIN modal ON service = ServiceID")
def normalise_states(v):
    f = v("fx_families")
    return repairs.normalise_states(f, repairs.modal_states(f)).select("row_num", "State")


@query("SELECT row_num, CASE WHEN Child_CRN = Parent1_CRN THEN '' ELSE Child_CRN END AS Child_CRN FROM fx_families")
def clear_shared_crn(v):
    return repairs.clear_shared_crn(v("fx_families")).select("row_num", "Child_CRN")


@query("SELECT row_num, CASE WHEN Child_First_Name = '' THEN Child_Last_Name ELSE Child_First_Name END AS Child_First_Name FROM fx_families")
def fill_first_names(v):
    return repairs.fill_first_names(v("fx_families")).select("row_num", "Child_First_Name")


@query("SELECT row_num, CASE WHEN Child_Legacy_Id = '0' THEN '0' ELSE ServiceID || '_' || Child_Legacy_Id END AS Child_Legacy_Id, Parent2_Legacy_Account_ID FROM fx_families")
def prefix_legacy_ids(v):
    return repairs.prefix_legacy_ids(v("fx_families")).select("row_num", "Child_Legacy_Id", "Parent2_Legacy_Account_ID")


@query(rf"SELECT row_num, CASE WHEN regexp_matches({_PLAIN('Parent1_Contact_Mobile')}, '^[1-9]\d*$') THEN '0' || Parent1_Contact_Mobile ELSE Parent1_Contact_Mobile END AS Parent1_Contact_Mobile FROM fx_families")
def fix_phones(v):
    return repairs.fix_phones(v("fx_families")).select("row_num", "Parent1_Contact_Mobile")


@query("SELECT row_num, CASE lower(EmergencyContact1_Emergency_Contact) WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE EmergencyContact1_Emergency_Contact END AS EmergencyContact1_Emergency_Contact, CASE WHEN Consents_Photos_Videos = '' THEN 'N' ELSE Consents_Photos_Videos END AS Consents_Photos_Videos FROM fx_families")
def bool_to_bit(v):
    return repairs.default_consent(repairs.booleans_to_bits(v("fx_families"))).select("row_num", "EmergencyContact1_Emergency_Contact", "Consents_Photos_Videos")


@query("SELECT row_num, CASE WHEN lower(Parent2_Email) = lower(Parent1_Email) THEN '' ELSE Parent2_Email END AS Parent2_Email, CASE WHEN lower(EmergencyContact2_Email) = lower(EmergencyContact1_Email) THEN '' ELSE EmergencyContact2_Email END AS EmergencyContact2_Email FROM fx_families")
def dedup_emails(v):
    return repairs.dedup_emails(v("fx_families")).select("row_num", "Parent2_Email", "EmergencyContact2_Email")


@query("SELECT row_num, EmergencyContact1_Email AS value FROM fx_families WHERE lower(EmergencyContact1_Email) IN (lower(Parent1_Email), lower(Parent2_Email))")
def redundant_contacts(v):
    f = v("fx_families")
    changed = repairs.changes(f, repairs.clear_redundant_contacts(f), "row_num", ["EmergencyContact1_Email"])
    return changed.select("row_num", F.col("before").alias("value"))


_ROW_ISSUES = " UNION ALL ".join(f"SELECT row_num, '{rule}' AS rule, '{f}' AS field, '{sev}' AS severity FROM fx_families WHERE {test}" for rule, f, sev, test in (
    [("mandatory", f, "ERROR", f"{_T(f)} = ''") for f in ("ServiceID", "Child_Legacy_Id", "Child_First_Name", "Child_Last_Name", "DOB", "Status", "Child_CRN", "Room_Name")] + [("mandatory", "Enrolment_Start_Date", "ERROR", "Enrolment_Start_Date = '' AND lower(Status) <> 'waitlist'")]
    + [("mandatory_parent", "Parent2_DOB", "ERROR", "(Parent2_First_Name <> '' OR Parent2_Last_Name <> '' OR Parent2_Email <> '') AND Parent2_DOB = ''"), ("mandatory_parent", "Parent2_Legacy_Account_ID", "ERROR", "(Parent2_First_Name <> '' OR Parent2_Last_Name <> '' OR Parent2_Email <> '') AND Parent2_Legacy_Account_ID = ''")]
    + [("status", "Status", "ERROR", "lower(Status) NOT IN ('active', 'inactive', 'waitlist')"), ("boolean", "EmergencyContact1_Emergency_Contact", "ERROR", "lower(EmergencyContact1_Emergency_Contact) NOT IN ('0', '1', 'yes', 'no', 'true', 'false')")]
    + [("state", "State", "ERROR", "trim(State) <> '' AND upper(trim(State)) NOT IN ('NSW','VIC','QLD','SA','WA','TAS','ACT','NT')"), ("service_id", "ServiceID", "ERROR", "coalesce(try_cast(ServiceID AS BIGINT) > 0, FALSE) = FALSE")]
    + [("waitlist_past", "Status / Enrolment_Start_Date", "ERROR", f"lower(Status) = 'waitlist' AND ({_DATE('Enrolment_Start_Date')}) < DATE '{AS_OF}'"), ("start_before_birth", "Enrolment_Start_Date", "ERROR", f"({_DATE('Enrolment_Start_Date')}) < ({_DATE('DOB')})")]
    + [("shared_crn", "Child_CRN", "ERROR", "Child_CRN = Parent1_CRN"), ("photo_consent", "Consents_Photos_Videos", "WARNING", "Consents_Photos_Videos = ''")]
))


@query(f"WITH i AS ({_ROW_ISSUES}) SELECT rule, field, severity, count(*) AS n, min(row_num) AS first_row FROM i GROUP BY ALL")
def row_issues(v):
    f = v("fx_families")
    some = [r for r in rules.row_rules(f.columns, AS_OF) if r.name not in _FORM_RULES]
    return rules.issues(f, some, ["row_num"]).groupBy("rule", "field", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("row_num").alias("first_row"))


@query("WITH k AS (SELECT Child_Legacy_Id AS key, count(*) AS n, string_agg(CAST(row_num AS VARCHAR), ', ' ORDER BY row_num) AS related FROM fx_families GROUP BY 1 HAVING count(*) > 1) SELECT row_num, key, n, related FROM fx_families JOIN k ON key = Child_Legacy_Id")
def duplicate_child_ids(v):
    found = crossrow.duplicate_values(v("fx_families"), "Child_Legacy_Id")
    return found.select("row_num", "key", "n", F.array_join(F.transform("related_rows", lambda r: r.cast("string")), ", ").alias("related"))


@query("""WITH p AS (SELECT row_num, lower(Parent1_Email) AS e, lower(Parent1_CRN) AS i FROM fx_families),
q AS (SELECT e FROM p GROUP BY e HAVING count(*) > 1 AND count(DISTINCT i) > 1),
r AS (SELECT lower(Parent2_Email) AS e FROM fx_families GROUP BY 1 HAVING count(*) > 1)
SELECT row_num, e AS key, 'ERROR' AS severity FROM p JOIN q USING (e) UNION ALL SELECT row_num, e, 'WARNING' FROM fx_families JOIN r ON lower(Parent2_Email) = e""")
def email_identity_conflicts(v):
    f = v("fx_families")
    return crossrow.email_conflicts(f, "Parent1", True).unionByName(crossrow.email_conflicts(f, "Parent2", False)).select("row_num", "key", "severity")


@query("""WITH k AS (SELECT lower(Parent1_CRN) AS key, string_agg(DISTINCT lower(Parent1_Email), ', ' ORDER BY lower(Parent1_Email)) AS emails, count(*) AS n FROM fx_families GROUP BY 1 HAVING count(DISTINCT lower(Parent1_Email)) > 1)
SELECT row_num, key, n, emails FROM fx_families JOIN k ON key = lower(Parent1_CRN)""")
def crn_email_registry(v):
    return crossrow.crn_registry(v("fx_families"), "Parent1").select("row_num", "key", "n", "emails")


@query("SELECT row_num, trim(Enrolment_Parent_CRN) AS value FROM fx_second_parents WHERE trim(Enrolment_Parent_CRN) <> '' AND trim(Enrolment_Parent_CRN) NOT IN (Parent1_CRN, Parent2_CRN)")
def enrolment_crn_unknown(v):
    return crossrow.enrolment_crn_unknown(v("fx_second_parents"))


@query("""SELECT row_num, 'own_even_room' AS rule, 'Room_Name' AS field, 'WARNING' AS severity, Room_Name AS value FROM fx_families WHERE trim(Room_Name) = 'BUILDING' AND Status = 'Active'
UNION ALL SELECT row_num, 'postcode', 'PostCode', 'WARNING', PostCode FROM fx_families WHERE PostCode = '30x0'""")
def issues_of_own_rules(v):
    """A rule of the user's own beside those of the library, and one on a column that the table lacks."""
    f = v("fx_families")
    own = [rules.Rule("own_even_room", "Room_Name", "WARNING", (text.strip("Room_Name") == "BUILDING") & (F.col("Status") == "Active"), "not for active children", ("Room_Name", "Status"))]
    known = [r for r in rules.row_rules(f.columns, AS_OF) if r.name == "postcode"]
    return rules.issues(f, known + own, ["row_num"]).select("row_num", "rule", "field", "severity", "value")


_WITH_SERVICE = f"i AS ({_ISSUES}), x AS (SELECT i.*, ServiceID AS service FROM i JOIN fx_families USING (row_num))"


@query(f"WITH {_WITH_SERVICE} SELECT coalesce(service, 'TOTAL') AS service, count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings, count(*) FILTER (severity = 'FIXED') AS fixed, count(*) AS total FROM x GROUP BY ROLLUP (service)")
def audit_summary_rollup(v):
    return reports.audit_summary(_form_issues(v("fx_families")).withColumnRenamed("ServiceID", "service"))


@query(f"WITH i AS ({_ISSUES}) SELECT field, severity, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, field, severity) AS place FROM i GROUP BY field, severity")
def issue_breakdown(v):
    return reports.issue_breakdown(_form_issues(v("fx_families")))


@query(f"WITH {_WITH_SERVICE}, s AS (SELECT row_num, row_number() OVER (PARTITION BY ServiceID ORDER BY row_num) + 1 AS split_row FROM fx_families) SELECT service, field, severity, split_row FROM x JOIN s USING (row_num)")
def renumbered_issues(v):
    f = v("fx_families")
    return reports.renumbered(_form_issues(f).drop("ServiceID"), repairs.split_rows(f)).select("service", "field", "severity", "split_row")


_TEMPLATE = """b AS (SELECT src_row, coalesce(target_service_id, '') AS service_id, CASE WHEN target_service_id IS NOT NULL THEN target_service_id || '_' || child_legacy_id ELSE child_legacy_id END AS child_id,
 strftime(strptime(substr(start_date, 1, 10), '%d/%m/%Y'), '%d/%m/%Y') AS start_date, CASE WHEN end_date = '' OR try_strptime(end_date, '%d/%m/%Y') IS NULL THEN '31/12/' || substr(start_date, 7, 4) ELSE end_date END AS end_date, fee_name AS fee, room_name AS room,
 CASE WHEN frequency = 'Single' THEN 'CASUAL' ELSE frequency END AS week_type,
 CAST((mon1 = '1')::INT + 2 * (tue1 = '1.0')::INT + 4 * (wed1 = '1')::INT + 16 * (fri1 = '1')::INT + 128 * (mon2 = '1')::INT AS INTEGER) AS days
 FROM fx_bookings LEFT JOIN fx_service_map ON source_service_id = service_legacy_id),
t AS (SELECT *, strptime(start_date, '%d/%m/%Y') AS s, try_strptime(end_date, '%d/%m/%Y') AS e, trim(regexp_replace(regexp_replace(lower(room), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS rk FROM b),
rec AS (SELECT * FROM t WHERE week_type <> 'CASUAL'), cas AS (SELECT * FROM t WHERE week_type = 'CASUAL')"""
_PAIRS = "p AS (SELECT a.service_id, a.child_id, a.src_row AS a, z.src_row AS b FROM rec a JOIN rec z ON a.service_id = z.service_id AND a.child_id = z.child_id AND a.rk = z.rk AND a.fee = z.fee AND a.src_row < z.src_row AND a.s <= z.e AND z.s <= a.e AND (a.days & z.days) <> 0)"


def _template(v):
    return bookings.booking_template(v("fx_bookings"), v("fx_service_map"))


def _kinds(v):
    """Casual and recurring bookings of one written template, so that its dates are read once."""
    t = written(_template(v), "template")
    return t.where("upper(week_type) = 'CASUAL'"), t.where("upper(week_type) <> 'CASUAL'")


@query(f"WITH {_TEMPLATE} SELECT * FROM b")
def booking_template(v):
    return _template(v)


@query("SELECT DISTINCT service_legacy_id AS id FROM fx_bookings WHERE service_legacy_id NOT IN (SELECT source_service_id FROM fx_service_map)")
def unmapped_services(v):
    return bookings.unmapped_services(v("fx_bookings"), v("fx_service_map"))


@query("""WITH k AS (SELECT src_row, min(src_row) OVER w AS f, count(*) OVER w AS n FROM fx_bookings_dup WINDOW w AS (PARTITION BY service_legacy_id, child_legacy_id, start_date, end_date, fee_name, room_name, frequency, mon1, tue1 = '1.0', wed1 = '1', fri1, mon2))
SELECT src_row, dense_rank() OVER (ORDER BY f) AS group_no, row_number() OVER (PARTITION BY f ORDER BY src_row) - 1 AS rank, CASE WHEN src_row = f THEN 'KEEP' ELSE 'REMOVE' END AS status FROM k WHERE n > 1""")
def exact_duplicate_bookings(v):
    return bookings.exact_duplicates(v("fx_bookings_dup"))


@query(f"WITH {_TEMPLATE}, {_PAIRS} SELECT * FROM p")
def recurring_conflict_pairs(v):
    return bookings.recurring_conflicts(_kinds(v)[1])


_COMPONENTS = f"""WITH RECURSIVE {_TEMPLATE}, {_PAIRS}, e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p),
r(n, m) AS (SELECT x, x FROM e UNION SELECT r.n, e.y FROM r JOIN e ON r.m = e.x),
c AS (SELECT n AS src_row, min(m) AS component FROM r GROUP BY n),
k AS (SELECT src_row, component, row_number() OVER (PARTITION BY component ORDER BY e DESC, src_row) = 1 AS kept FROM c JOIN t USING (src_row))"""


@query(_COMPONENTS + " SELECT src_row, component, kept FROM k")
def recurring_conflicts_kept(v):
    return bookings.resolve_conflicts(_kinds(v)[1]).select("src_row", "component", "kept")


_CASUAL = _COMPONENTS + """, live AS (SELECT * FROM rec WHERE src_row NOT IN (SELECT src_row FROM k WHERE NOT kept)),
o AS (SELECT c.src_row, l.src_row AS recurring_row, c.fee = l.fee AS same_fee, row_number() OVER (PARTITION BY c.src_row ORDER BY l.src_row) AS i FROM cas c JOIN live l ON c.service_id = l.service_id AND c.child_id = l.child_id AND c.rk = l.rk AND c.s BETWEEN l.s AND l.e
 AND (l.days & (1 << CAST(isodow(c.s) - 1 + 7 * CASE WHEN lower(l.week_type) = 'fortnightly' THEN (datediff('day', l.s, c.s) // 7) % 2 ELSE 0 END AS INTEGER))) <> 0)"""


def _casual(v):
    casual, recurring = _kinds(v)
    return casual, bookings.casual_overlaps(casual, bookings.surviving(recurring, bookings.resolve_conflicts(recurring)))


@query(_CASUAL + " SELECT src_row, recurring_row, same_fee FROM o WHERE i = 1")
def casual_overlaps_removed(v):
    return _casual(v)[1]


@query(_CASUAL + " SELECT src_row, service_id, child_id, start_date FROM cas WHERE src_row NOT IN (SELECT src_row FROM o)")
def casual_kept(v):
    casual, removed = _casual(v)
    return casual.join(removed.select("src_row"), "src_row", "left_anti").select("src_row", "service_id", "child_id", "start_date")


@query(f"WITH {_TEMPLATE} SELECT week_type, count(*) AS n, count(DISTINCT service_id) AS services, count(*) FILTER (service_id = '') AS unmapped FROM b GROUP BY week_type")
def booking_metrics(v):
    return reports.booking_metrics(_template(v))


_PLAN = r"""WITH d AS (SELECT *, trim(parent_fn) AS fn, trim(parent_ln) AS ln, CASE o WHEN 2 THEN try_strptime(start_date, '%Y-%m-%d') WHEN 3 THEN coalesce(try_strptime(start_date, '%d/%m/%Y %I:%M %p'), try_strptime(start_date, '%m/%d/%Y %I:%M %p'))
 WHEN 4 THEN try_strptime(start_date, '%d/%m/%y') WHEN 5 THEN try_strptime(start_date, '%d/%m/%Y') END AS pd,
 CASE lower(weekday) WHEN 'monday' THEN 'Mon' WHEN 'sat' THEN 'Sat' WHEN 'fri' THEN 'Fri' END AS wd FROM (SELECT *, (row_num - 2) % 6 AS o FROM fx_payment_plans)),
e AS (SELECT row_num, child_id, 'weekend' AS kind, wd AS value FROM d WHERE wd IN ('Sat', 'Sun')
 UNION ALL SELECT row_num, child_id, 'missing_date', coalesce(wd, weekday) FROM d WHERE start_date = '' UNION ALL SELECT row_num, child_id, 'missing_weekday', start_date FROM d WHERE weekday = ''
 UNION ALL SELECT row_num, child_id, 'missing_parent', parent_id FROM d WHERE fn = '' OR ln = '' UNION ALL SELECT row_num, child_id, 'invalid_cycle', cycle FROM d WHERE cycle NOT IN ('', 'Weekly')
 UNION ALL SELECT row_num, child_id, 'manual_not_monday', strftime(pd, '%d/%m/%Y') FROM d WHERE lower(manual) IN ('yes', '1', 'true') AND isodow(pd) <> 1
 UNION ALL SELECT row_num, child_id, 'negative_limit', dd_limit FROM d WHERE try_cast(dd_limit AS DOUBLE) < 0 UNION ALL SELECT row_num, child_id, 'negative_fixed', fixed_amount FROM d WHERE try_cast(fixed_amount AS DOUBLE) < 0
 UNION ALL SELECT row_num, child_id, 'both_amounts', dd_limit FROM d WHERE try_cast(dd_limit AS DOUBLE) > 0 AND try_cast(fixed_amount AS DOUBLE) > 0
 UNION ALL SELECT row_num, child_id, 'unparseable_date', start_date FROM d WHERE start_date <> '' AND pd IS NULL UNION ALL SELECT row_num, child_id, 'unknown_weekday', weekday FROM d WHERE weekday <> '' AND wd IS NULL)"""


@query(_PLAN + " SELECT row_num, coalesce(strftime(pd, '%d/%m/%Y'), start_date) AS start_date, coalesce(wd, weekday) AS weekday, fn AS parent_fn FROM d")
def payment_repaired(v):
    return payments.repair_plans(v("fx_payment_plans")).select("row_num", "start_date", "weekday", "parent_fn")


@query(_PLAN + " SELECT * FROM e")
def payment_errors(v):
    return payments.plan_errors(payments.repair_plans(v("fx_payment_plans")))


_KINDS = "(1, 'weekend'), (2, 'missing_date'), (3, 'missing_weekday'), (4, 'missing_parent'), (5, 'missing_service_id'), (6, 'invalid_cycle'), (7, 'manual_not_monday'), (8, 'negative_limit'), (9, 'negative_fixed'), (10, 'both_amounts'), (11, 'unparseable_date'), (12, 'unknown_weekday')"


@query(_PLAN + f", k(seq, kind) AS (VALUES {_KINDS}) SELECT CAST(seq AS BIGINT) AS seq, kind, count(e.row_num) AS n FROM k LEFT JOIN e USING (kind) GROUP BY ALL UNION ALL SELECT 13, 'TOTAL', count(*) FROM e")
def payment_error_summary(v):
    return payments.error_summary(payments.plan_errors(payments.repair_plans(v("fx_payment_plans"))))


@query(_PLAN + " SELECT count(*) AS total, count(*) FILTER (strftime(pd, '%d/%m/%Y') <> start_date) AS date_fixed, count(*) FILTER (wd <> weekday) AS weekday_fixed, CAST(sum((fn <> parent_fn)::INT + (ln <> parent_ln)::INT) AS BIGINT) AS spaces_fixed FROM d")
def payment_stats(v):
    return payments.plan_stats(payments.repair_plans(v("fx_payment_plans")))


_SPLIT = _PLAN + """, g AS (SELECT d.*, CASE WHEN d.service_id <> '' THEN m.target_service_id ELSE w.target_service_id END AS target FROM d LEFT JOIN fx_service_map m ON m.source_service_id = d.service_id
 LEFT JOIN fx_source_services s ON lower(s.name) = lower(d.service_name) LEFT JOIN fx_service_map w ON w.source_service_id = s.service_id),
f AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY row_num) + 1 AS file_row FROM g WHERE target IS NOT NULL)"""


def _split(v):
    repaired = payments.repair_plans(v("fx_payment_plans"))
    return repaired, payments.split_plans(repaired, v("fx_service_map"), v("fx_source_services"))


@query(_SPLIT + " SELECT target, file_row, target || '_' || child_id AS child_id FROM f")
def payment_split(v):
    return _split(v)[1].select("target", "file_row", "child_id")


@query(_SPLIT + " SELECT e.row_num, kind, coalesce(file_row, e.row_num) AS file_row FROM e LEFT JOIN f USING (row_num)")
def payment_errors_renumbered(v):
    repaired, split = _split(v)
    return payments.renumber(payments.plan_errors(repaired), split).select("row_num", "kind", "file_row")


def _missing_sql(usage: str, name: str, catalog: str, key: str, map_key: str) -> str:
    return f"""WITH u AS (SELECT DISTINCT {map_key} AS key, service_name, {name} FROM {usage} JOIN fx_service_map ON source_service_id = service_legacy_id),
miss AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM {catalog} c WHERE c.{key} = u.key AND c.{name} = u.{name})),
w AS (SELECT DISTINCT key, {name}, unnest(regexp_split_to_array(lower({name}), '[^a-z0-9_]+')) AS word FROM miss),
n AS (SELECT w.key, w.{name}, string_agg(DISTINCT c.{name}, '; ' ORDER BY c.{name}) AS s FROM w JOIN {catalog} c ON c.{key} = w.key AND length(word) > 2 AND word <> 'the' AND contains(lower(c.{name}), word) GROUP BY ALL)
SELECT service_name, miss.{name}, coalesce(s, '(no match found)') AS suggestions FROM miss LEFT JOIN n ON n.key = miss.key AND n.{name} = miss.{name}"""


@query(_missing_sql("fx_name_usage", "fee_name", "fx_fee_catalog", "service_id", "target_service_id"))
def fee_mismatches_with_suggestions(v):
    return names.undefined_names(v("fx_name_usage"), v("fx_fee_catalog").select("service_id", "fee_name"), v("fx_service_map"), "fee_name", "target_service_id")


@query(_missing_sql("fx_room_usage", "room_name", "fx_room_catalog", "centre_name", "service_name"))
def room_mismatches_with_suggestions(v):
    return names.undefined_names(v("fx_room_usage"), v("fx_room_catalog").select("centre_name", "room_name"), v("fx_service_map"), "room_name", "service_name")


_BALANCES = r"""WITH a AS (SELECT src_row, trim(centre_name) AS centre, trim(account_name) AS acc, nullif(try_cast(regexp_replace(amount_due, '[,$]', '', 'g') AS DOUBLE), 0) AS due FROM fx_balances WHERE NOT contains(lower(account_name), 'demo parent') AND trim(centre_name) IN (SELECT service_name FROM fx_service_map)),
r AS (SELECT src_row, centre, CASE WHEN contains(acc, ',') THEN trim(substr(acc, instr(acc, ',') + 1)) ELSE acc END AS first, CASE WHEN contains(acc, ',') THEN trim(substr(acc, 1, instr(acc, ',') - 1)) ELSE '' END AS last, CASE WHEN due < 0 THEN -due END AS credit, CASE WHEN due > 0 THEN due END AS owing FROM a)"""


@query(_BALANCES + " SELECT * FROM r")
def balances_resolved(v):
    return balances.resolve_balances(v("fx_balances"), v("fx_service_map"))


@query("SELECT DISTINCT trim(centre_name) AS centre FROM fx_balances WHERE trim(centre_name) NOT IN (SELECT service_name FROM fx_service_map)")
def skipped_centres(v):
    return balances.skipped_centres(v("fx_balances"), v("fx_service_map"))


@query(_BALANCES + ", k AS (SELECT *, count(*) OVER (PARTITION BY lower(centre), lower(first), lower(last)) AS n FROM r) SELECT src_row, centre, first, last, n FROM k WHERE n > 1")
def duplicate_accounts(v):
    return balances.duplicate_accounts(balances.resolve_balances(v("fx_balances"), v("fx_service_map"))).select("src_row", "centre", "first", "last", "n")


@query(_BALANCES + " SELECT centre, count(*) AS n, count(credit) AS credits, count(owing) AS debts FROM r GROUP BY centre")
def balance_metrics(v):
    return balances.resolve_balances(v("fx_balances"), v("fx_service_map")).groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.count("credit").alias("credits"), F.count("owing").alias("debts"))


_PROFILES = r"""prof AS (SELECT row_num, ServiceID AS service, 'Parent1' AS slot, row_num * 2 AS ord, lower(Parent1_First_Name) AS fn, lower(Parent1_Last_Name) AS ln, Parent1_DOB AS dob, lower(Parent1_Legacy_Account_ID) AS legacy, regexp_replace(Parent1_Contact_Mobile, '[\s\-()]', '', 'g') AS tel, lower(Parent1_Email) AS mail FROM fx_families
 UNION ALL SELECT row_num, ServiceID, 'Parent2', row_num * 2 + 1, lower(Parent2_First_Name), lower(Parent2_Last_Name), Parent2_DOB, lower(Parent2_Legacy_Account_ID), regexp_replace(Parent2_Contact_Mobile, '[\s\-()]', '', 'g'), lower(Parent2_Email) FROM fx_families WHERE Parent2_First_Name <> '')"""
_PARENT_PAIRS = f"WITH RECURSIVE {_PROFILES}, p AS (SELECT a.ord AS a, b.ord AS b, a.tel AS contact FROM prof a JOIN prof b ON a.fn = b.fn AND a.ln = b.ln AND a.dob = b.dob AND a.dob <> '' AND a.tel = b.tel AND a.tel <> '' AND a.ord < b.ord AND (a.legacy <> b.legacy OR a.legacy = ''))"


@query(_PARENT_PAIRS + " SELECT a, b, contact FROM p")
def parent_pairs(v):
    return entity.parent_pairs(entity.profiles(v("fx_families"))).select("a", "b", "contact")


@query(f"""WITH {_PROFILES}, m AS (SELECT n.row_num, n.slot, e.ord AS existing_ord, e.service AS existing_service, e.legacy AS existing_legacy_id,
 concat_ws(', ', CASE WHEN n.dob = e.dob AND n.dob <> '' THEN 'dob' END, CASE WHEN n.tel = e.tel AND n.tel <> '' THEN 'contact' END, CASE WHEN n.mail = e.mail AND n.mail <> '' THEN 'email' END) AS matched_on
 FROM prof n JOIN prof e ON n.fn = e.fn AND n.ln = e.ln AND n.row_num % 2 = 0 AND e.row_num % 2 = 1 AND NOT (n.legacy <> '' AND n.legacy = e.legacy)),
k AS (SELECT *, row_number() OVER (PARTITION BY row_num, slot ORDER BY existing_ord) AS i FROM m WHERE matched_on <> '')
SELECT row_num, slot, matched_on, existing_service, existing_legacy_id, existing_ord FROM k WHERE i = 1""")
def cross_service_first_match(v):
    f = v("fx_families")
    found = entity.cross_service_matches(entity.profiles(f.where("row_num % 2 = 0")), entity.profiles(f.where("row_num % 2 = 1")))
    return found.select("row_num", "slot", "matched_on", "existing_service", "existing_legacy_id", "existing_ord")


@query(_PARENT_PAIRS + """, e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), r(n, m) AS (SELECT x, x FROM e UNION SELECT r.n, e.y FROM r JOIN e ON r.m = e.x),
c AS (SELECT n AS ord, min(m) AS cluster FROM r GROUP BY n), k AS (SELECT cluster, count(DISTINCT nullif(legacy, '')) AS n_ids FROM c JOIN prof USING (ord) GROUP BY cluster HAVING count(DISTINCT nullif(legacy, '')) >= 2)
SELECT ord, cluster, n_ids FROM c JOIN k USING (cluster)""")
def parent_clusters(v):
    return entity.parent_clusters(entity.profiles(v("fx_families")))


def _taken(field: str) -> str:
    """CTEs: the profile from which each one takes a field over, by its latest linked predecessor that has the field or takes it over itself."""
    return f"""has_{field} AS (SELECT DISTINCT anc.ord FROM anc JOIN raw ON raw.ord = x WHERE {field} <> ''),
par_{field} AS (SELECT b, max(a) AS a FROM p WHERE a IN (SELECT ord FROM has_{field}) GROUP BY b),
climb_{field}(ord, src) AS (SELECT ord, ord FROM prof WHERE dob <> '' AND tel <> '' UNION ALL SELECT ord, a FROM climb_{field} JOIN par_{field} ON b = src),
of_{field} AS (SELECT c.ord, {field} FROM climb_{field} c JOIN raw ON raw.ord = c.src WHERE c.src NOT IN (SELECT b FROM par_{field}))"""


_LINKED = f"""{_PARENT_PAIRS}, raw AS (SELECT row_num, row_num * 2 AS ord, 'Parent1' AS slot, Parent1_Legacy_Account_ID AS legacy, Parent1_CRN AS crn, Parent1_DOB AS birth, Parent1_First_Name || ' ' || Parent1_Last_Name AS name FROM fx_families
 UNION ALL SELECT row_num, row_num * 2 + 1, 'Parent2', Parent2_Legacy_Account_ID, '', Parent2_DOB, Parent2_First_Name || ' ' || Parent2_Last_Name FROM fx_families WHERE Parent2_First_Name <> ''),
anc(ord, x) AS (SELECT ord, ord FROM raw UNION SELECT anc.ord, p.a FROM anc JOIN p ON p.b = anc.x),
{_taken("legacy")}, {_taken("crn")}, linked AS (SELECT ord, legacy, crn FROM of_legacy JOIN of_crn USING (ord))"""


@query(_LINKED + " SELECT ord, legacy, crn FROM linked")
def auto_linked_profiles(v):
    return entity.auto_link(entity.profiles(v("fx_families")))


@query(_LINKED + """ SELECT f.row_num, coalesce(a.legacy, Parent1_Legacy_Account_ID) AS Parent1_Legacy_Account_ID, coalesce(a.crn, Parent1_CRN) AS Parent1_CRN, coalesce(b.legacy, Parent2_Legacy_Account_ID) AS Parent2_Legacy_Account_ID
 FROM fx_families f LEFT JOIN linked a ON a.ord = f.row_num * 2 LEFT JOIN linked b ON b.ord = f.row_num * 2 + 1""")
def linked_families(v):
    f = v("fx_families")
    return entity.linked_rows(f, entity.auto_link(entity.profiles(f))).select("row_num", "Parent1_Legacy_Account_ID", "Parent1_CRN", "Parent2_Legacy_Account_ID")


@query(_LINKED + """, i AS (SELECT p.*, x.row_num AS ra, y.row_num AS rb, x.slot AS sa, y.slot AS sb, 'DOB: ' || x.birth || ', Contact: ' || contact AS matched_on, linked.legacy AS l, linked.crn AS c FROM p JOIN raw x ON x.ord = a JOIN raw y ON y.ord = b JOIN linked ON linked.ord = a)
SELECT ra AS row_num, sa || '_Legacy_Account_ID' AS field, 'FIXED' AS severity, 'intra_file_duplicate_parent' AS tag, 'Kept as first-created profile; row ' || rb || ' linked to it' AS action, rb AS related_row, matched_on FROM i
UNION ALL SELECT rb, sb || '_Legacy_Account_ID', 'FIXED', 'intra_file_duplicate_parent', 'Linked to first-created profile at row ' || ra || ' (legacy ''' || l || ''', CRN ''' || c || ''')', ra, matched_on FROM i""")
def link_issues(v):
    p = entity.profiles(v("fx_families"))
    return entity.link_issues(p, entity.auto_link(p))


@query(_PARENT_PAIRS + """, m AS (SELECT a AS ord, contact FROM p UNION SELECT b, contact FROM p) SELECT ord, contact AS matched_on, fn || ' ' || ln AS parent_name, service FROM m JOIN prof USING (ord)""")
def duplicate_parent_detail(v):
    return reports.duplicate_parents(entity.profiles(v("fx_families")))


@query(_KEYS + " SELECT row_num, t AS ServiceID FROM m WHERE t IS NOT NULL AND lower(Status) <> 'waitlist'")
def import_scope(v):
    return repairs.in_scope(v("fx_families"), v("fx_service_map"), drop_waitlist=True).select("row_num", "ServiceID")


@query(f"WITH i AS ({_ISSUES}) SELECT severity, count(*) AS n FROM i GROUP BY severity")
def severity_counts(v):
    return reports.severity_counts(_form_issues(v("fx_families")))


_EMAIL_FIXES = """x AS (SELECT row_num, ServiceID, Parent1_Email AS p1, Parent2_Email AS p2, EmergencyContact1_Email AS e1, EmergencyContact2_Email AS e2 FROM fx_families),
i AS (SELECT row_num, ServiceID AS service, 'Parent2_Email' AS field, p2 AS before, 'duplicate_parent_email' AS tag FROM x WHERE p2 <> '' AND lower(p2) = lower(p1)
 UNION ALL SELECT row_num, ServiceID, 'EmergencyContact1_Email', e1, 'redundant_ec' FROM x WHERE e1 <> '' AND lower(e1) IN (lower(p1), lower(p2))
 UNION ALL SELECT row_num, ServiceID, 'EmergencyContact2_Email', e2, 'redundant_ec' FROM x WHERE e2 <> '' AND lower(e2) <> lower(e1) AND lower(e2) IN (lower(p1), lower(p2)))"""


def _fixed(v):
    return repairs.fixed_issues(repairs.logged_repairs(v("fx_families")), ["row_num", "ServiceID"]).withColumnRenamed("ServiceID", "service")


@query(f"WITH {_EMAIL_FIXES}, s AS (SELECT row_num, row_number() OVER (PARTITION BY ServiceID ORDER BY row_num) + 1 AS split_row FROM fx_families) SELECT service, split_row, field, before, tag FROM i JOIN s USING (row_num)")
def client_report(v):
    f = v("fx_families")
    return reports.client_issues(_fixed(v).drop("service"), repairs.split_rows(f)).select("service", "split_row", "field", "before", "tag")


@query(f"WITH {_EMAIL_FIXES} SELECT coalesce(service, 'TOTAL') AS service, count(*) FILTER (tag = 'duplicate_parent_email') AS duplicate_parent_email, count(*) FILTER (tag = 'redundant_ec') AS redundant_ec FROM i GROUP BY ROLLUP (service)")
def client_summary(v):
    return reports.tagged_summary(_fixed(v))


@query(rf"""WITH c AS (SELECT *, lower(EmergencyContact1_Emergency_Contact) AS flag FROM fx_families)
SELECT 'cleared repeated address' AS action, count(*) FILTER (Parent2_Email <> '' AND lower(Parent2_Email) = lower(Parent1_Email)) + count(*) FILTER (lower(EmergencyContact2_Email) = lower(EmergencyContact1_Email)) AS n FROM c
UNION ALL SELECT 'cleared a parent''s CRN', count(*) FROM c WHERE Child_CRN = Parent1_CRN
UNION ALL SELECT 'took the last name', count(*) FROM c WHERE Child_First_Name = ''
UNION ALL SELECT 'marked the id', count(*) FROM c WHERE Child_Legacy_Id <> '0'
UNION ALL SELECT 'added the leading zero', count(*) FROM c WHERE regexp_matches({_PLAIN('Parent1_Contact_Mobile')}, '^[1-9]\d*$')
UNION ALL SELECT 'set to N', count(*) FROM c WHERE Consents_Photos_Videos = ''
UNION ALL SELECT 'written as 0 or 1', count(*) FROM c WHERE flag IN ('true', 'false')
UNION ALL SELECT 'cleared a parent''s address', count(*) FROM c WHERE lower(EmergencyContact1_Email) IN (lower(Parent1_Email), lower(Parent2_Email))""")
def repair_counts(v):
    return _fixed(v).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_num, arg_min(Service_Name, row_num) OVER (PARTITION BY ServiceID) AS service_label, row_number() OVER (PARTITION BY ServiceID ORDER BY row_num) + 1 AS split_row FROM fx_families")
def family_split(v):
    return sinks.family_splits(v("fx_families")).select("row_num", "service_label", "split_row")


@query(f"WITH {_TEMPLATE} SELECT src_row, CASE week_type WHEN 'CASUAL' THEN 'Casual' ELSE 'Recurring' END AS booking_kind, CASE service_id WHEN '' THEN 'UNMAPPED' ELSE service_id END AS service_label FROM b")
def booking_split(v):
    return sinks.booking_splits(_template(v)).select("src_row", "booking_kind", "service_label")


@query("SELECT DISTINCT service_legacy_id, fee_name FROM fx_bookings")
def fee_names_used(v):
    return names.names_used(v("fx_bookings"), "fee_name")


@query(_SPLIT + """ SELECT file_row, target AS Service_ID, m.service_name AS Service_Name, parent_id AS Parent_Legacy_Id, fn AS Parent_First_Name, ln AS Parent_Last_Name, target || '_' || child_id AS Child_Legacy_Id, '' AS Child_First_Name, '' AS Child_Last_Name,
 coalesce(strftime(pd, '%d/%m/%Y'), start_date) AS Direct_Debit_Start_Date, coalesce(wd, weekday) AS Direct_Debit_Day, manual AS Manual, cycle AS Billing_Cycle, dd_limit AS Direct_Debit_Limit, fixed_amount AS Fixed_Amount, '' AS Gateway_Reference
 FROM f JOIN fx_service_map m ON m.target_service_id = target""")
def payment_template(v):
    return payments.import_template(_split(v)[1], v("fx_service_map"))


@query(_PLAN + " SELECT row_num, child_id, value FROM e WHERE kind = 'weekend'")
def payment_weekend(v):
    return payments.plan_errors(payments.repair_plans(v("fx_payment_plans"))).where("kind = 'weekend'").select("row_num", "child_id", "value")


_SHOWN = """(0, 'weekend', 'WEEKEND — Sat / Sun', 'ERROR_INVALID_PAYMENT_DAY'), (1, 'missing_date', 'Missing Start Date', 'ERROR_MISSING_BOOKING_START_DATE'), (2, 'missing_weekday', 'Missing Weekday', 'ERROR_MISSING_PAYMENT_DAY'),
 (3, 'missing_parent', 'Missing Parent Name', 'ERROR_MISSING_GUARDIAN'), (5, 'invalid_cycle', 'Invalid Billing Cycle', 'ERROR_INVALID_FREQUENCY'), (6, 'manual_not_monday', 'Manual Plan — Not Monday', 'MANUAL_PLAN_NOT_MONDAY'),
 (7, 'negative_limit', 'Negative Direct Debit Limit', 'ERROR_NEGATIVE_DIRECT_DEBIT_LIMIT'), (8, 'negative_fixed', 'Negative Fixed Amount', 'ERROR_NEGATIVE_FIXED_LIMIT'), (9, 'both_amounts', 'Both Limit + Fixed Amount Set', 'ERROR_ONLY_ONE_AMOUNT_ALLOWED'), (10, 'unparseable_date', 'Unparseable Date Value', 'UNPARSEABLE_DATE'), (11, 'unknown_weekday', 'Unknown Weekday Value', 'UNKNOWN_WEEKDAY')"""


@query(_PLAN + f""", k(place, kind, label, key) AS (VALUES {_SHOWN}), s AS (SELECT *, coalesce(strftime(pd, '%d/%m/%Y'), start_date) AS shown FROM d),
n AS (SELECT place, label, key, e.row_num, parent_id, e.child_id, trim(fn || ' ' || ln) AS parent_name, service_name, CASE kind
 WHEN 'weekend' THEN 'Falls on a ' || CASE wd WHEN 'Sun' THEN 'Sunday' ELSE 'Saturday' END || ' (' || shown || ') — please verify before importing'
 WHEN 'missing_date' THEN 'Start Date is empty — cannot import' WHEN 'missing_weekday' THEN 'Weekday is empty — cannot import'
 WHEN 'missing_parent' THEN 'First: "' || coalesce(nullif(fn, ''), '(empty)') || '"  Last: "' || coalesce(nullif(ln, ''), '(empty)') || '"'
 WHEN 'invalid_cycle' THEN 'Value: "' || cycle || '" — must be Weekly / Fortnightly / Monthly'
 WHEN 'manual_not_monday' THEN 'Starts on ' || dayname(pd) || ' (' || shown || ') — Manual plans must start on Monday'
 WHEN 'negative_limit' THEN 'Value = ' || dd_limit || '  (must be >= 0)' WHEN 'negative_fixed' THEN 'Value = ' || fixed_amount || '  (must be >= 0)'
 WHEN 'both_amounts' THEN 'Limit=' || dd_limit || '  AND  Fixed=' || fixed_amount || '  (only one allowed)'
 WHEN 'unparseable_date' THEN 'Cannot parse: "' || start_date || '"' ELSE 'Unrecognised value: "' || weekday || '"' END AS note
 FROM e JOIN s USING (row_num) JOIN k USING (kind))
SELECT row_number() OVER (ORDER BY place, row_num) AS seq, * EXCLUDE (place) FROM n""")
def payment_error_detail(v):
    return payments.error_detail(payments.repair_plans(v("fx_payment_plans")))


_SERVICE_ISSUES = _KEYS + """, x AS (SELECT row_num, trim(ServiceID) AS given, src, t, n, trim(coalesce(Service_Name, '')) AS old FROM m)
SELECT row_num, 'ServiceID' AS field, 'FIXED' AS severity, 'Source service ID ''' || given || ''' mapped to target service ID ''' || t || ''' (' || n || ').' AS description, 'Service ID updated: ' || given || ' → ' || t || ' (' || n || ')' AS action FROM x WHERE src = 'source'
UNION ALL SELECT row_num, 'ServiceID', 'FIXED', 'Service name ''' || given || ''' resolved to target service ID ''' || t || ''' (' || n || ').', 'Service ID updated from name: ''' || given || ''' → ''' || t || ''' (' || n || ')' FROM x WHERE src = 'name'
UNION ALL SELECT row_num, 'ServiceID', 'WARNING', 'Service ID ''' || given || ''' was not found in the service map (checked as target ID, source ID and name).', '' FROM x WHERE src IS NULL
UNION ALL SELECT row_num, 'Service_Name', 'FIXED', 'Service_Name ''' || old || ''' does not match the canonical name ''' || n || ''' for service ID ''' || t || '''.', 'Service_Name corrected: ''' || old || ''' → ''' || n || '''' FROM x WHERE t IS NOT NULL AND old <> '' AND old <> n"""


@query(_SERVICE_ISSUES)
def service_issues(v):
    return repairs.service_issues(v("fx_families"), v("fx_service_map"), ["row_num"])


_FURTHER = " UNION ALL ".join(f"SELECT row_num, '{rule}' AS rule, '{f}' AS field, '{sev}' AS severity FROM fx_families_more WHERE {test}" for rule, f, sev, test in (
    ("contact_id", "EmergencyContact1_LegacyID", "ERROR", "EmergencyContact1_First_Name <> '' AND trim(EmergencyContact1_LegacyID) = ''"),
    ("paired_name", "EmergencyContact1_Last_Name", "ERROR", "EmergencyContact1_First_Name <> '' AND EmergencyContact1_Last_Name = ''"),
    ("paired_name", "EmergencyContact1_First_Name", "ERROR", "EmergencyContact1_First_Name = '' AND EmergencyContact1_Last_Name <> ''"),
    ("gender", "Gender", "WARNING", "Gender NOT IN ('', 'Male', 'Female')"),
    ("gender", "Gender_Identity", "WARNING", "Gender_Identity NOT IN ('', 'Male', 'Female', 'Non-Binary', 'Trans Female', 'Trans Male')"),
    ("future_birth", "DOB", "ERROR", f"({_DATE('DOB')}) > DATE '{AS_OF}'"),
    ("medicare", "Medicare_Number", "WARNING", "Medicare_Number <> '' AND NOT regexp_matches(Medicare_Number, '^[0-9]+$')"),
    ("length", "School", "ERROR", "length(School) > 200"),
    ("length", "Parent1_Gender", "ERROR", "length(Parent1_Gender) > 50"),
))


@query(f"WITH i AS ({_FURTHER}) SELECT rule, field, severity, count(*) AS n, min(row_num) AS first_row FROM i GROUP BY ALL")
def further_row_issues(v):
    f = v("fx_families_more")
    some = [r for r in rules.row_rules(f.columns, AS_OF) if r.name in ("contact_id", "paired_name", "gender", "future_birth", "medicare", "length")]
    return rules.issues(f, some, ["row_num"]).groupBy("rule", "field", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("row_num").alias("first_row"))


@query("""SELECT row_num, 'WARNING' AS severity FROM fx_second_parents WHERE lower(trim(Status)) = 'waitlist' AND trim(Parent1_Email) = '' AND Parent1_CRN = '' AND Parent1_Legacy_Account_ID = ''
UNION ALL SELECT row_num + 10000000, 'WARNING' FROM fx_second_parents WHERE lower(trim(Status)) = 'waitlist'""")
def waitlist_without_guardian(v):
    """The rule on waitlisted rows with and without a guardian, and on a table that has none of the columns that name one."""
    f = v("fx_second_parents")
    found = lambda df: rules.issues(df, [r for r in rules.row_rules(df.columns, AS_OF) if r.name == "waitlist_guardian"], ["row_num"]).select("row_num", "severity")
    return found(f).unionByName(found(f.select((F.col("row_num") + 10_000_000).alias("row_num"), "Status")))


_NAMES = ["MON1", "TUE1", "WED1", "THU1", "FRI1", "SAT1", "SUN1", "MON2", "TUE2", "WED2", "THU2", "FRI2", "SAT2", "SUN2"]
_DAYS_OF = lambda m: "concat_ws(', ', " + ", ".join(f"CASE WHEN ({m} & {1 << i}) <> 0 THEN '{d}' END" for i, d in enumerate(_NAMES)) + ")"
_SHOW = lambda d: f"strftime({d}, '%d/%m/%Y')"


@query(_COMPONENTS + f""", other AS (SELECT n, min(m) AS m FROM (SELECT a AS n, b AS m FROM p UNION ALL SELECT b, a FROM p) GROUP BY n), best AS (SELECT k.component, e AS kept_end FROM k JOIN t USING (src_row) WHERE kept)
SELECT x.src_row, x.service_id, x.child_id, 'Overlapping recurring schedules: date overlap ' || {_SHOW('greatest(x.s, z.s)')} || '–' || {_SHOW('least(x.e, z.e)')} || ', shared booked days: ' || {_DAYS_OF('(x.days & z.days)')} || ' Removed in favour of the row with the furthest EndDate (' || {_SHOW('kept_end')} || '), which was kept in the bookings import.' AS conflict_reason
FROM k JOIN t x ON x.src_row = k.src_row AND NOT kept JOIN other ON n = k.src_row JOIN t z ON z.src_row = m JOIN best ON best.component = k.component""")
def recurring_conflict_report(v):
    recurring = _kinds(v)[1]
    return bookings.conflict_report(recurring, bookings.resolve_conflicts(recurring)).select("src_row", "service_id", "child_id", "conflict_reason")


@query(_CASUAL + f""", y AS (SELECT c.*, l.start_date AS s2, l.end_date AS e2, l.days AS days2, l.fee AS fee2, l.week_type AS kind2, same_fee, CASE WHEN lower(l.week_type) = 'fortnightly' THEN (datediff('day', l.s, c.s) // 7) % 2 + 1 ELSE 1 END AS wk FROM o JOIN cas c USING (src_row) JOIN rec l ON l.src_row = recurring_row WHERE i = 1)
SELECT src_row, service_id, child_id, 'Casual date ' || start_date || ' (' || upper(substr(dayname(s), 1, 3)) || ', Week ' || wk || ' of ' || kind2 || ') falls within recurring period ' || s2 || ' – ' || e2 || ' (Days: ' || {_DAYS_OF('days2')} || ', Room: ' || trim(room) ||
 CASE WHEN same_fee THEN ', Fee: ' || trim(fee) || ')' ELSE ') — same room, different fee: casual fee ''' || trim(fee) || ''' vs recurring fee ''' || trim(fee2) || '''' END AS overlap_reason FROM y""")
def casual_overlap_report(v):
    casual, recurring = _kinds(v)
    live = written(bookings.surviving(recurring, bookings.resolve_conflicts(recurring)), "live")
    return bookings.overlap_report(casual, live, bookings.casual_overlaps(casual, live)).select("src_row", "service_id", "child_id", "overlap_reason")


_SAME = "service_legacy_id, child_legacy_id, start_date, end_date, fee_name, room_name, frequency, mon1, tue1 = '1.0', wed1 = '1', fri1, mon2"
_RAW = f"raw AS (SELECT *, row_number() OVER (PARTITION BY {_SAME} ORDER BY src_row) AS rn, count(*) OVER (PARTITION BY {_SAME}) AS cn FROM fx_bookings_dup)"
_RUN = _CASUAL.replace("WITH RECURSIVE ", f"WITH RECURSIVE {_RAW}, ", 1).replace("FROM fx_bookings LEFT JOIN", "FROM (SELECT * FROM raw WHERE rn = 1) LEFT JOIN", 1)


@query(_RUN + """, gone AS (SELECT k.src_row, service_id, child_id FROM k JOIN rec USING (src_row) WHERE NOT kept), cut AS (SELECT DISTINCT src_row FROM o), stay AS (SELECT * FROM cas WHERE src_row NOT IN (SELECT src_row FROM cut))
SELECT 'input_files' AS metric, 1 AS n UNION ALL SELECT 'raw_rows', count(*) FROM raw UNION ALL SELECT 'duplicate_rows', count(*) FROM raw WHERE cn > 1 UNION ALL SELECT 'duplicate_groups', count(*) FROM raw WHERE cn > 1 AND rn = 1
UNION ALL SELECT 'duplicates_removed', count(*) FROM raw WHERE rn > 1 UNION ALL SELECT 'unmapped_services', count(DISTINCT service_legacy_id) FROM raw WHERE service_legacy_id NOT IN (SELECT source_service_id FROM fx_service_map)
UNION ALL SELECT 'conflict_rows', count(*) FROM gone UNION ALL SELECT 'conflict_groups', count(*) FROM (SELECT DISTINCT service_id, child_id FROM gone)
UNION ALL SELECT 'recurring_kept', count(*) FROM live UNION ALL SELECT 'recurring_files', count(DISTINCT service_id) FROM live UNION ALL SELECT 'casual_kept', count(*) FROM stay
UNION ALL SELECT 'casual_files', count(DISTINCT service_id) FROM stay UNION ALL SELECT 'casual_removed', count(*) FROM cut""")
def bookings_run(v):
    raw, services = v("fx_bookings_dup"), v("fx_service_map")
    rows, services_of = F.count(F.lit(1)), F.size(F.collect_set("service_id"))  # a file a service: as many as files are written
    duplicates, found = lineage.measured(bookings.exact_duplicates(raw), "duplicates", duplicate_rows=rows, duplicate_groups=F.count_if(F.col("status") == "KEEP"), duplicates_removed=F.count_if(F.col("status") == "REMOVE"))
    once = raw.join(duplicates.where("status = 'REMOVE'").select("src_row"), "src_row", "left_anti")
    template, read = lineage.measured(bookings.booking_template(once, services), "template", template_rows=rows)
    casual, recurring = template.where("upper(week_type) = 'CASUAL'"), template.where("upper(week_type) <> 'CASUAL'")
    resolved = bookings.resolve_conflicts(recurring)
    live, stay = lineage.measured(bookings.surviving(recurring, resolved), "live", recurring_kept=rows, recurring_files=services_of)
    removed, gone = lineage.measured(bookings.casual_overlaps(casual, live), "overlaps", casual_removed=rows)
    _, kept = lineage.measured(casual.join(removed.select("src_row"), "src_row", "left_anti"), "casual", casual_kept=rows, casual_files=services_of)
    return reports.bookings_run(found | read | stay | gone | kept, bookings.unmapped_services(once, services), resolved.where("not kept"))


@query(f"WITH {_TEMPLATE} SELECT row_number() OVER (ORDER BY service_id, child_id, src_row) AS place, src_row FROM b")
def bookings_in_import_order(v):
    return in_sequence(_template(v).select("service_id", "child_id", "src_row"), ["service_id", "child_id", "src_row"], "place").select("place", "src_row")


@query(f"WITH {_TEMPLATE} SELECT src_row, CASE week_type WHEN 'CASUAL' THEN 'Casual' ELSE 'Recurring' END AS booking_kind, coalesce(regexp_replace(service_name, ' +', '_', 'g'), 'UNMAPPED') AS service_label FROM b LEFT JOIN fx_service_map ON target_service_id = service_id")
def booking_split_by_name(v):
    return sinks.booking_splits(_template(v), v("fx_service_map")).select("src_row", "booking_kind", "service_label")


@query("""WITH f AS (SELECT row_num, CASE WHEN row_num % 2 = 0 THEN ServiceID ELSE '' END AS sid FROM fx_families)
SELECT row_num, coalesce(service_name, nullif(sid, ''), 'Unknown') AS service_label, row_number() OVER (PARTITION BY sid ORDER BY row_num) + 1 AS split_row FROM f LEFT JOIN fx_service_map ON target_service_id = sid""")
def family_split_by_map(v):
    """Rows without service names: the map's name labels a split, else the id."""
    f = v("fx_families").withColumns({"Service_Name": F.lit(""), "ServiceID": F.when(F.col("row_num") % 2 == 0, F.col("ServiceID")).otherwise("")})
    return sinks.family_splits(f, v("fx_service_map")).select("row_num", "service_label", "split_row")


@query(r"""SELECT name, trim(regexp_replace(name, '[\\/:*?"<>|]', '_', 'g')) AS label, regexp_replace(name, '[\\/:*?"<>|]', '_', 'g') AS part,
 trim(regexp_replace(trim(regexp_replace(name, '[^a-zA-Z0-9_\s''-]', '', 'g')), '[\s''_]+', '_', 'g'), '_') AS word FROM fx_odd_names""")
def file_names(v):
    return v("fx_odd_names").select("name", text.file_label("name").alias("label"), text.file_part("name").alias("part"), text.file_word("name").alias("word"))


@query("SELECT src_row, CASE WHEN src_row % 8 = 6 THEN NULL ELSE strftime(meant, '%d/%m/%Y') END AS shown FROM fx_dates")
def booking_dates(v):
    return v("fx_dates").select("src_row", dates.shown(dates.booking_date("written")).alias("shown"))


@query("SELECT src_row, concat_ws(', ', CASE WHEN mon1 = '1' THEN 'Mon1' END, CASE WHEN tue1 = '1.0' THEN 'Tue1' END, CASE WHEN wed1 = '1' THEN 'Wed1' END, 'Fri1', CASE WHEN mon2 = '1' THEN 'Mon2' END) AS days FROM fx_bookings")
def day_summaries(v):
    b = v("fx_bookings")
    return b.select("src_row", text.day_summary([c for c in bookings.DAY_COLUMNS if c in b.columns]).alias("days"))


@query("SELECT row_num, child_id, cycle, dd_limit FROM fx_payment_plans")
def mapped_payment_columns(v):
    """A file with headers of its own, under the logical names."""
    file = v("fx_payment_plans").select("row_num", F.col("child_id").alias("Child Legacy ID"), F.col("cycle").alias("Cycle"), F.col("dd_limit").alias("Limit"))
    return payments.map_columns(file, {"child_id": "Child Legacy ID", "cycle": "Cycle", "dd_limit": "Limit"})


@query(f"WITH i AS ({_ISSUES}) SELECT DISTINCT 'severity' AS option, severity AS value FROM i UNION ALL SELECT DISTINCT 'field', field FROM i")
def issue_filter_options(v):
    return reports.filter_options(_form_issues(v("fx_families")))


@query(f"WITH i AS ({_ISSUES}) SELECT row_num, field FROM i WHERE severity = 'ERROR' AND field = 'DOB'")
def filtered_issues(v):
    return reports.filtered(_form_issues(v("fx_families")), severity="ERROR", field="DOB").select("row_num", "field")


@query(f"""WITH {_WITH_SERVICE}, r AS (SELECT service, count(*) FILTER (severity = 'ERROR') AS errors FROM (SELECT CASE WHEN row_num % 5 = 0 THEN 'Unknown' ELSE service END AS service, severity FROM x) GROUP BY service)
SELECT service, errors, row_number() OVER (ORDER BY service = 'Unknown', lower(service), service) AS place FROM r
UNION ALL SELECT 'TOTAL', CAST(sum(errors) AS BIGINT), count(*) + 1 FROM r""")
def audit_in_report_order(v):
    i = _form_issues(v("fx_families")).withColumn("service", F.when(F.col("row_num") % 5 == 0, "Unknown").otherwise(F.col("ServiceID")))
    return reports.in_report_order(reports.audit_summary(i)).select("service", "errors", "place")


@query("""WITH s AS (SELECT row_num, row_number() OVER (PARTITION BY ServiceID ORDER BY row_num) + 1 AS split_row FROM fx_families),
k AS (SELECT Child_Legacy_Id AS key, string_agg(CAST(split_row AS VARCHAR), ', ' ORDER BY row_num) AS related FROM fx_families JOIN s USING (row_num) GROUP BY 1 HAVING count(*) > 1)
SELECT row_num, 'rows ' || related AS related_text FROM fx_families JOIN k ON key = Child_Legacy_Id""")
def related_rows_in_files(v):
    f = v("fx_families")
    return reports.with_split_rows(crossrow.duplicate_values(f, "Child_Legacy_Id"), repairs.split_rows(f)).select("row_num", "related_text")


@query("SELECT row_num, lower(Child_CRN) AS key, count(*) OVER (PARTITION BY lower(Child_CRN)) AS n FROM fx_families QUALIFY n > 1")
def duplicate_child_crns(v):
    return crossrow.duplicate_values(v("fx_families"), "Child_CRN").select("row_num", "key", "n")


@query("""WITH k AS (SELECT lower(Parent2_CRN) AS key, string_agg(DISTINCT lower(Parent2_Email), ', ' ORDER BY lower(Parent2_Email)) FILTER (Parent2_Email <> '') AS emails FROM fx_second_parents WHERE Parent2_CRN <> '' GROUP BY 1
 HAVING count(DISTINCT lower(Parent2_Email)) FILTER (Parent2_Email <> '') > 1) SELECT row_num, key, emails FROM fx_second_parents JOIN k ON key = lower(Parent2_CRN)""")
def crn_email_registry_of_second_parents(v):
    return crossrow.crn_registry(v("fx_second_parents"), "Parent2").select("row_num", "key", "emails")


@query(_BALANCES + " SELECT count(DISTINCT centre) AS outputs, count(*) AS rows, (SELECT count(DISTINCT trim(centre_name)) FROM fx_balances WHERE trim(centre_name) NOT IN (SELECT service_name FROM fx_service_map)) AS skipped FROM r")
def balances_run(v):
    b, known = v("fx_balances"), v("fx_service_map")
    return reports.balances_run(balances.resolve_balances(b, known), balances.skipped_centres(b, known))


_CLUSTERS = """e AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), r(n, m) AS (SELECT x, x FROM e UNION SELECT r.n, e.y FROM r JOIN e ON r.m = e.x),
c AS (SELECT n AS ord, min(m) AS cluster FROM r GROUP BY n), many AS (SELECT cluster FROM c JOIN prof USING (ord) GROUP BY cluster HAVING count(DISTINCT nullif(legacy, '')) >= 2)"""
_OCCURRENCES = """raw AS (SELECT row_num * 2 AS ord, 'Parent1' AS slot, Parent1_Legacy_Account_ID AS id, Parent1_CRN AS crn, Parent1_DOB AS birth, trim(Parent1_First_Name || ' ' || Parent1_Last_Name) AS name, Service_Name AS service, trim(Child_First_Name || ' ' || Child_Last_Name) AS child FROM fx_families
 UNION ALL SELECT row_num * 2 + 1, 'Parent2', Parent2_Legacy_Account_ID, '', Parent2_DOB, trim(Parent2_First_Name || ' ' || Parent2_Last_Name), Service_Name, trim(Child_First_Name || ' ' || Child_Last_Name) FROM fx_families WHERE Parent2_First_Name <> '')"""


@query(_PARENT_PAIRS + f""", {_CLUSTERS}, {_OCCURRENCES},
mine AS (SELECT c.ord, cluster, tel, birth FROM c JOIN many USING (cluster) JOIN prof USING (ord) JOIN raw USING (ord)),
tel2 AS (SELECT cluster, min(tel) AS tel FROM (SELECT cluster, tel FROM mine WHERE tel <> '' GROUP BY ALL HAVING count(*) >= 2) GROUP BY cluster),
born AS (SELECT cluster, arg_min(birth, ord) AS birth FROM mine GROUP BY cluster),
one AS (SELECT 0 AS part, cluster, ord, 'DOB: ' || born.birth || coalesce(', Contact: ' || tel2.tel, '') AS matched FROM mine JOIN born USING (cluster) LEFT JOIN tel2 USING (cluster)),
x AS (SELECT n.ord, e.ord AS other, concat_ws(', ', CASE WHEN n.dob = e.dob AND n.dob <> '' THEN 'DOB: ' || n.dob END, CASE WHEN n.tel = e.tel AND n.tel <> '' THEN 'Contact: ' || n.tel END, CASE WHEN n.mail = e.mail AND n.mail <> '' THEN 'Email: ' || n.mail END) AS matched
 FROM prof n JOIN prof e ON n.fn = e.fn AND n.ln = e.ln AND n.row_num % 2 = 0 AND e.row_num % 2 = 1 AND NOT (n.legacy <> '' AND n.legacy = e.legacy)),
two AS (SELECT 1 AS part, 0 AS cluster, ord, arg_min(matched, other) AS matched FROM x WHERE matched <> '' GROUP BY ord),
every AS (SELECT * FROM one UNION ALL SELECT * FROM two)
SELECT row_number() OVER (ORDER BY name, service, part, cluster, CASE WHEN part = 0 THEN child ELSE '' END, ord) AS seq, service AS Service_Name, id AS Parent_Legacy_ID, name AS Parent_Name, matched AS Matched_On, crn AS Parent_CRN, slot AS Parent_Slot, child AS Linked_Child FROM every JOIN raw USING (ord)""")
def duplicate_parent_report(v):
    f = v("fx_families")
    cross = entity.cross_service_matches(entity.profiles(f.where("row_num % 2 = 0")), entity.profiles(f.where("row_num % 2 = 1")))
    return reports.duplicate_parent_report(entity.profiles(f), cross)


def _files(df: DataFrame, label: str, by: str, n: int = 6) -> list[str]:
    """`df` as CSV files in the shared folder, in order of a column."""
    path = lineage.new_folder(df.sparkSession, label)
    df.repartitionByRange(n, by).sortWithinPartitions(by).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return [r.path for r in readers.input_files(df.sparkSession, path).select("path").toLocalIterator()]


@query("""SELECT row_number() OVER (ORDER BY row_num) + 1 AS row_num, CASE WHEN row_num % 3 = 0 THEN ServiceID ELSE CAST(row_num AS VARCHAR) END AS ServiceID, trim(Child_First_Name || ' ' || Child_Last_Name) AS child_name, trim(Room_Name) || chr(10) || '"x"' AS Room_Name FROM fx_families""")
def families_from_files(v):
    """Several files with blanks around headers, whole numbers written with ".0", quotes and line ends in cells; numbered on over all files."""
    f = v("fx_families")
    cell = F.when(F.col("row_num") % 3 == 0, F.col("ServiceID")).otherwise(F.concat(F.col("row_num").cast("string"), F.lit(".0")))
    room = F.concat(F.trim("Room_Name"), F.lit('\n"x"')).alias("Room_Name")
    paths = _files(f.select(cell.alias(" ServiceID"), F.col("Child_First_Name").alias("Child_First_Name "), "Child_Last_Name", room, "row_num"), "families", "row_num")
    return readers.read_numbered(f.sparkSession, paths).select("row_num", "ServiceID", "child_name", "Room_Name")


@query("SELECT row_number() OVER (ORDER BY src_row) - 1 AS src_row, service_legacy_id, CASE WHEN src_row % 3 = 0 THEN '' ELSE fee_name END AS fee_name, '' AS room_name FROM fx_bookings")
def bookings_from_files(v):
    """Files in the columns of bookings: one is absent, and texts for missing values count as blank."""
    b = v("fx_bookings")
    paths = _files(b.select("src_row", "service_legacy_id", F.when(F.col("src_row") % 3 == 0, "N/A").otherwise(F.col("fee_name")).alias("fee_name")), "bookings", "src_row")
    return readers.read_bookings(b.sparkSession, paths, ["service_legacy_id", "fee_name", "room_name"])


@query("SELECT trim(centre_name) AS centre, count(*) AS n, count(*) FILTER (src_row % 2 = 0) AS from_html FROM fx_balances WHERE trim(centre_name) <> '' GROUP BY 1")
def balances_from_files(v):
    """Folders of CSV files and of pages with a table; the headers of both become columns."""
    b = v("fx_balances").select("src_row", F.col("centre_name").alias("Centre Name"), F.col("account_name").alias("Account Name"))
    spark, path, html = b.sparkSession, lineage.new_folder(b.sparkSession, "balances"), lineage.new_folder(b.sparkSession, "balance-pages")
    b.where("src_row % 2 = 1").drop("src_row").repartition(3).write.option("header", True).csv(path)
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(c, F.lit("")), F.lit("</td>"))
    rows = b.where("src_row % 2 = 0").select(F.floor(F.col("src_row") / 1000).alias("page"), F.concat(F.lit("<tr>"), cell("Centre Name"), cell("Account Name"), F.lit("</tr>")).alias("row"))
    pages = rows.groupBy("page").agg(F.concat(F.lit("<table><tr><th> Centre Name</th><th>Account Name</th></tr>"), F.array_join(F.collect_list("row"), ""), F.lit("</table>")).alias("value"))
    pages.write.partitionBy("page").text(html)
    csv, tables = (readers.read_balances(spark, p).withColumn("html", F.lit(i)) for i, p in enumerate((path, html + "/*")))
    read = csv.unionByName(tables, allowMissingColumns=True)
    return read.select(text.strip(balances.centre_column(read.columns)).alias("centre"), "html").where("centre <> ''").groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("html") == 1).alias("from_html"))


@query("""WITH b AS (SELECT src_row // 500 AS page, (src_row // 500) % 4 AS kind, trim(account_name) AS name FROM fx_balances)
SELECT page, CASE kind WHEN 0 THEN 'not HTML' WHEN 1 THEN 'no table' ELSE '' END AS reason, CASE WHEN kind > 1 THEN count(*) ELSE 0 END AS n, CASE WHEN kind > 1 THEN min(name) END AS least FROM b GROUP BY page, kind""")
def pages_and_rejected_files(v):
    """Pages with a table, some of them cut off behind its last row, pages without one, and files that are no pages."""
    b = v("fx_balances").select(F.expr("src_row div 500").alias("page"), F.coalesce(F.trim("account_name"), F.lit("")).alias("name"))
    spark, path = b.sparkSession, lineage.new_folder(b.sparkSession, "pages")
    kind = F.col("page") % 4
    line = F.when(kind == 0, F.col("name")).when(kind == 1, F.concat(F.lit("<p>"), "name", F.lit("</p>"))).otherwise(F.concat(F.lit("<tr><td>"), "name", F.lit("</td></tr>")))
    head = F.when(kind == 0, "").when(kind == 1, "<html>").otherwise("<html><!-- <table><tr><td>no</td></tr></table> --><table><tr><th>Account Name</th></tr>")
    end = F.when(kind == 2, "</table><table><tr><td>no</td></tr></table>").otherwise("")
    b.groupBy("page").agg(F.array_join(F.collect_list(line), "\n").alias("body")).select("page", F.concat(head, "body", end).alias("value")).write.partitionBy("page").text(path)
    read = readers.html_and_rejected(spark, path + "/*").withColumn("page", F.regexp_extract("file", "page=([0-9]+)", 1).cast("long"))
    body = F.col("line") > 0
    return read.groupBy("page").agg(F.coalesce(F.max("reason"), F.lit("")).alias("reason"), F.count_if(body).alias("n"), F.min(F.when(body, F.get("cells", F.lit(0)))).alias("least"))


@query(f"WITH {_PROFILES} SELECT fn AS first, ln AS last, dob, legacy, count(*) AS n FROM prof WHERE row_num % 2 = 1 GROUP BY ALL")
def existing_profiles_from_files(v):
    """Profiles of the files of existing services; a file that has no parents is left out."""
    f = v("fx_families").where("row_num % 2 = 1")
    path = lineage.new_folder(f.sparkSession, "existing")
    f.repartitionByRange(4, "row_num").write.option("header", True).csv(path)
    v("fx_service_map").repartition(1).write.mode("append").option("header", True).csv(path)
    found = entity.profiles(readers.read_existing(f.sparkSession, path), file_col="source_file")
    return found.where("source_file <> ''").groupBy("first", "last", "dob", "legacy").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT service_name, source_full_id, source_service_id, target_service_id FROM fx_service_map")
def service_map_from_file(v):
    m = v("fx_service_map").select(F.col("service_name").alias("Service_Name"), F.col("source_full_id").alias("Source Full ID"), F.col("source_service_id").alias("Source_Service_ID"), F.col("target_service_id").alias(" Target Service ID "), "map_ord")
    (path,) = _files(m, "map", "map_ord", 1)
    return readers.read_service_map(m.sparkSession, path).drop("map_ord")


@query("SELECT row_num, Child_Legacy_Id AS key, count(*) OVER w AS n, min(row_num) OVER w AS first_row FROM fx_families WINDOW w AS (PARTITION BY Child_Legacy_Id) QUALIFY n > 1")
def duplicate_child_id_members(v):
    return crossrow.duplicate_members(v("fx_families"), "Child_Legacy_Id")


def _back(df: DataFrame, write) -> DataFrame:
    """What a sink has written, read as texts."""
    path = lineage.new_folder(df.sparkSession, "sink")
    write(path)
    return df.sparkSession.read.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def _lines(df: DataFrame, write, columns: list[str], part: str = "") -> DataFrame:
    """What a sink has written as splits: keys, line (counted in the files as they lie there) and the cells of each row."""
    path = lineage.new_folder(df.sparkSession, "sink")
    write(path)
    read = sinks.read_splits(df.sparkSession, path + part).where("line > 0")
    cells = F.from_csv("text", ", ".join(f"`{c}` string" for c in columns), split_csv.OPTIONS)
    return read.withColumn("c", cells).select("keys", "line", *(F.coalesce(f"c.{c}", F.lit("")).alias(c) for c in columns))


@query(_BALANCES + " SELECT CAST(src_row AS VARCHAR) AS src_row, centre AS centre_label, row_number() OVER (PARTITION BY centre ORDER BY src_row) AS line, coalesce(first, '') AS first, CAST(owing IS NOT NULL AS INTEGER) AS owes FROM r")
def balances_written(v):
    """Balances by centre, as the files say: line n of a centre is its row n."""
    resolved = balances.resolve_balances(v("fx_balances"), v("fx_service_map"))
    read = _lines(resolved, lambda path: sinks.write_balances(resolved, path), resolved.columns, "/by_centre")
    return read.select("src_row", F.col("keys.centre_label").alias("centre_label"), "line", "first", (F.col("owing") != "").cast("int").alias("owes"))


@query(_BALANCES + " SELECT row_number() OVER (ORDER BY src_row) AS line, CAST(src_row AS VARCHAR) AS src_row, centre FROM r")
def balances_written_together(v):
    """All centres in one sequence of lines."""
    resolved = balances.resolve_balances(v("fx_balances"), v("fx_service_map"))
    return _lines(resolved, lambda path: sinks.write_balances(resolved, path), resolved.columns, "/all").select("line", "src_row", "centre")


@query(f"WITH i AS ({_ISSUES}) SELECT CAST(row_num AS VARCHAR) AS row_num, field, severity FROM i")
def issues_written(v):
    issues = _form_issues(v("fx_families")).select("row_num", "field", "severity")
    return _back(issues, lambda path: sinks.write_issues(issues, path))


@query(_PLAN + " SELECT fn AS parent_fn, coalesce(wd, weekday) AS weekday FROM d")
def repaired_payments_written(v):
    repaired = payments.repair_plans(v("fx_payment_plans"))
    return _back(repaired, lambda path: sinks.write_repaired_payments(repaired, ["parent_fn", "weekday"], path)).select(F.coalesce("parent_fn", F.lit("")).alias("parent_fn"), F.coalesce("weekday", F.lit("")).alias("weekday"))


@query("""WITH s AS (SELECT row_num, ServiceID, Child_Legacy_Id, row_number() OVER (PARTITION BY ServiceID ORDER BY row_num) + 1 AS split_row, arg_min(Service_Name, row_num) OVER (PARTITION BY ServiceID) AS service_label FROM fx_families)
SELECT service_label, row_number() OVER (PARTITION BY service_label ORDER BY ServiceID, row_num) AS line, CAST(split_row AS VARCHAR) AS split_row, Child_Legacy_Id FROM s""")
def family_files_written(v):
    """Services that share a label follow each other in its lines."""
    f = v("fx_families")
    read = _lines(f, lambda path: sinks.write_family_splits(f, ["Child_Legacy_Id"], path), ["split_row", "Child_Legacy_Id"])
    return read.select(F.col("keys.service_label").alias("service_label"), "line", "split_row", "Child_Legacy_Id")


@query(f"""WITH {_TEMPLATE}, l AS (SELECT b.*, CASE week_type WHEN 'CASUAL' THEN 'Casual' ELSE 'Recurring' END AS booking_kind, coalesce(regexp_replace(service_name, ' +', '_', 'g'), 'UNMAPPED') AS service_label FROM b LEFT JOIN fx_service_map ON target_service_id = service_id)
SELECT CAST(src_row AS VARCHAR) AS src_row, child_id, room, booking_kind, service_label, row_number() OVER (PARTITION BY booking_kind, service_label ORDER BY child_id, src_row) AS line FROM l""")
def booking_files_written(v):
    t = written(_template(v), "template")
    read = _lines(t, lambda path: sinks.write_booking_splits(t, path, service_map=v("fx_service_map")), t.columns)
    return read.select("src_row", "child_id", "room", "keys.booking_kind", "keys.service_label", "line")


@query(_SPLIT + """ SELECT m.service_name AS service_label, row_number() OVER (PARTITION BY m.service_name ORDER BY target, file_row) AS line, CAST(file_row AS VARCHAR) AS file_row, target || '_' || child_id AS Child_Legacy_Id
 FROM f JOIN fx_service_map m ON m.target_service_id = target""")
def payment_files_written(v):
    t = payments.import_template(_split(v)[1], v("fx_service_map"))
    read = _lines(t, lambda path: sinks.write_payment_splits(t, path), t.columns)
    return read.select("keys.service_label", "line", "file_row", "Child_Legacy_Id")


@query("SELECT service_name, source_full_id, source_service_id, target_service_id FROM fx_service_map WHERE map_ord % 3 <> 0")
def service_map_of_entries(v):
    """A map of literal entries, at most a few hundred services; those without a target id are left out."""
    entries = [(r.service_name, r.source_full_id, r.source_service_id, r.target_service_id if r.map_ord % 3 else " ") for r in v("fx_service_map").toLocalIterator()]
    return readers.service_map_of(v("fx_service_map").sparkSession, entries).drop("map_ord")


@query("""SELECT 'part-' || lpad(CAST(row_num % 7 AS VARCHAR), 3, '0') || '.csv' AS name, count(*) AS lines FROM fx_families GROUP BY row_num % 7""")
def input_files_listed(v):
    """A folder's files in order of name and their lines, the service map that lies among them apart."""
    f = v("fx_families")
    spark, path = f.sparkSession, lineage.new_folder(f.sparkSession, "listed")
    name = F.concat(F.lit("part-"), F.lpad((F.col("row_num") % 7).cast("string"), 3, "0"), F.lit(".csv"))
    _named_texts(f.select(name.alias("name"), F.col("Child_Legacy_Id").alias("value")), path)
    _named_texts(v("fx_service_map").select(F.lit("ServiceIDs.csv").alias("name"), F.col("service_name").alias("value")), path)
    listed = readers.input_files(spark, path).select("path", "name")
    lines = spark.read.text([r.path for r in listed.toLocalIterator()]).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("lines"))
    return listed.select("name").join(lines, "name", "left")


def _named_texts(df: DataFrame, path: str, *order: str) -> None:
    """Files of given names in a folder, with the lines (name, value), in order of further columns if any are given; for fixtures."""
    spark, made = df.sparkSession, lineage.new_folder(df.sparkSession, "named")
    # Sorted behind the last shuffle, which keeps no order; names are never null, as the writer would sort anew by those that may be.
    placed = df.withColumn("name", F.coalesce("name", F.lit(""))).repartition("name").sortWithinPartitions("name", *order)
    placed.select("name", "value").write.partitionBy("name").text(made)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(conf)
    store.mkdirs(top)
    for r in spark.read.format("binaryFile").load(made).select("path").toLocalIterator():
        name = r.path.split("/name=", 1)[1].split("/", 1)[0]
        store.rename(jvm.org.apache.hadoop.fs.Path(r.path), jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))


@query("""SELECT source_file, reason, CAST(0 AS BIGINT) AS n FROM (VALUES ('damaged.csv', 'NUL bytes'), ('other.csv', 'header not usable')) x(source_file, reason)
UNION ALL SELECT 'old' || (row_num % 3) || '.csv', '', count(*) FROM fx_families WHERE Parent1_First_Name <> '' GROUP BY row_num % 3""")
def existing_files_and_rejected(v):
    """Files of existing services with their rows; a damaged file and one without parents are named, and the others read."""
    f = v("fx_families")
    spark, path = f.sparkSession, lineage.new_folder(f.sparkSession, "existing")
    cells = F.concat_ws(",", F.lit("1"), "Parent1_First_Name", "Parent1_Last_Name")
    every = f.select(F.concat(F.lit("old"), F.col("row_num") % 3, F.lit(".csv")).alias("name"), cells.alias("value"))
    lead = lambda names, head: spark.createDataFrame([(n, head) for n in names], "name string, value string")
    rows = lead(["old0.csv", "old1.csv", "old2.csv"], "ServiceID,Parent1_First_Name,Parent1_Last_Name").withColumn("o", F.lit(0)).unionByName(every.withColumn("o", F.lit(1)))
    _named_texts(rows, path, "o")
    _named_texts(v("fx_service_map").select(F.lit("other.csv").alias("name"), F.concat_ws(",", "service_name", "target_service_id").alias("value")), path)
    _named_texts(v("fx_service_map").select(F.lit("damaged.csv").alias("name"), F.concat(F.lit("Parent1_First_Name,"), F.char(F.lit(0)), "service_name").alias("value")), path)
    read, rejected = readers.existing_and_rejected(spark, path)
    counts = read.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).select("source_file", F.lit("").alias("reason"), "n")
    return counts.unionByName(rejected.withColumn("n", F.lit(0).cast("long")))


@query("""SELECT CAST(row_num AS VARCHAR) AS row_num, Child_First_Name || chr(10) || '"' || Child_Last_Name || '",' || chr(10) AS name, CASE WHEN row_num % 5 = 0 THEN repeat(State || chr(10), 60) ELSE State END AS note, trim(Room_Name) AS Room_Name FROM fx_families""")
def quoted_csv_by_ranges(v):
    """Cells that hold line ends, quotes and separators, some of them longer than a range: each file is read by many tasks, in ranges of 16,000 bytes."""
    f = v("fx_families")
    name = F.concat("Child_First_Name", F.lit('\n"'), "Child_Last_Name", F.lit('",\n'))
    note = F.when(F.col("row_num") % 5 == 0, F.repeat(F.concat("State", F.lit("\n")), F.lit(60))).otherwise(F.col("State"))
    paths = _files(f.select("row_num", name.alias("name"), note.alias("note"), F.trim("Room_Name").alias("Room_Name")), "quoted", "row_num")
    table = split_csv.csv_table(f.sparkSession, paths, range_bytes=16_000)
    return table.rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("row_num", "name", "note", "Room_Name")))


#: Row rules of the log: rank, rule, field, severity, the column that is shown, its test on the repaired rows, and what is wrong.
_LOGGED_RULES = (
    [(1, "mandatory", f, "ERROR", f, f"{_T(f)} = ''", "mandatory value is missing") for f in ("ServiceID", "Child_Legacy_Id", "Child_First_Name", "Child_Last_Name", "DOB", "Status", "Child_CRN", "Room_Name")]
    + [(2, "mandatory_parent", f, "ERROR", f, f"(Parent2_First_Name <> '' OR Parent2_Last_Name <> '' OR Parent2_Email <> '') AND {f} = ''", "value is missing though the parent is given") for f in ("Parent2_DOB", "Parent2_Legacy_Account_ID", "Parent2_Email")]
    + [(3, "date", f, "ERROR", f, f"{_T(f)} <> '' AND ({_DATE(_T(f))}) IS NULL", "no date") for f in ("DOB", "Enrolment_Start_Date", "Parent1_DOB", "Parent2_DOB")]
    + [(4, "crn", f, "ERROR", f, rf"{_T(f)} <> '' AND NOT regexp_matches({_T(f)}, '^\d{{9}}[A-Za-z]$')", "no CRN") for f in ("Child_CRN", "Parent1_CRN")]
    + [(5, "phone", f, "WARNING", f, rf"{_T(f)} <> '' AND NOT (regexp_matches({_PLAIN(f)}, '^4\d{{8}}$') OR regexp_matches({_PLAIN(f)}, {_PHONE}))", "no phone number") for f in ("Parent1_Contact_Mobile", "Parent2_Contact_Mobile")]
    + [(6, "email", f, "ERROR", f, f"{_T(f)} <> '' AND NOT regexp_matches({_T(f)}, {_MAIL})", "no e-mail address") for f in ("Parent1_Email", "Parent2_Email", "EmergencyContact1_Email", "EmergencyContact2_Email")]
    + [(7, "status", "Status", "ERROR", "Status", "lower(Status) NOT IN ('active', 'inactive', 'waitlist')", "unknown status"), (8, "boolean", "EmergencyContact1_Emergency_Contact", "ERROR", "EmergencyContact1_Emergency_Contact", "lower(EmergencyContact1_Emergency_Contact) NOT IN ('0', '1', 'yes', 'no', 'true', 'false')", "no yes/no value"), (8, "boolean", "Consents_Photos_Videos", "ERROR", "Consents_Photos_Videos", "Consents_Photos_Videos NOT IN ('', '0', '1', 'yes', 'no', 'true', 'false')", "no yes/no value")]
    + [(9, "state", "State", "ERROR", "State", "trim(State) <> '' AND upper(trim(State)) NOT IN ('NSW','VIC','QLD','SA','WA','TAS','ACT','NT')", "unknown state"), (10, "postcode", "PostCode", "WARNING", "PostCode", rf"{_T('PostCode')} <> '' AND NOT regexp_matches({_T('PostCode')}, '^\d{{4}}$')", "no postcode")]
    + [(11, "waitlist_past", "Status / Enrolment_Start_Date", "ERROR", "Status", f"lower(Status) = 'waitlist' AND ({_DATE('Enrolment_Start_Date')}) < DATE '{AS_OF}'", "waitlisted past the start"), (12, "start_before_birth", "Enrolment_Start_Date", "ERROR", "Enrolment_Start_Date", f"({_DATE('Enrolment_Start_Date')}) < ({_DATE('DOB')})", "starts before birth")]
)
_LOGGED = " UNION ALL ".join(f"SELECT 4 AS pass, row_num, {rank} AS place, '{field}' AS field, '{severity}' AS severity, '{field}' || CASE WHEN {_T(shown)} = '' THEN ': ' ELSE ' ''' || {shown} || ''': ' END || '{message}' AS text, '' AS action, '{rule}' AS tag FROM rep WHERE {test}" for rank, rule, field, severity, shown, test, message in _LOGGED_RULES)
_FIX = lambda pass_, place, field, before, after, action, tag="NULL": f"SELECT {pass_} AS pass, row_num, {place} AS place, '{field}' AS field, 'FIXED' AS severity, '{field} ''' || {before} || ''' became ''' || {after} || ''': {action.replace(chr(39), chr(39) * 2)}' AS text, '{action.replace(chr(39), chr(39) * 2)}' AS action, {tag} AS tag FROM fixed WHERE {before} <> {after}"
_FAMILIES_LOG = (
    "WITH RECURSIVE " + _KEYS.removeprefix("WITH ") + f""",
scope AS (SELECT * EXCLUDE (src, t, n, ServiceID, Service_Name), t AS ServiceID, CASE WHEN trim(Service_Name) <> '' THEN n ELSE Service_Name END AS Service_Name FROM m WHERE t IS NOT NULL),
{_MODAL.replace('fx_families', 'scope')},
stated AS (SELECT scope.* EXCLUDE (State), State AS old_state, CASE WHEN trim(State) = '' THEN '' WHEN upper(trim(State)) IN ('NSW','VIC','QLD','SA','WA','TAS','ACT','NT') THEN upper(trim(State)) {_SPELL} ELSE coalesce(modal_state, trim(State)) END AS State FROM scope LEFT JOIN modal ON service = ServiceID),
a AS (SELECT *, CASE WHEN lower(Parent2_Email) = lower(Parent1_Email) THEN '' ELSE Parent2_Email END AS p2, CASE WHEN lower(EmergencyContact2_Email) = lower(EmergencyContact1_Email) THEN '' ELSE EmergencyContact2_Email END AS e2 FROM stated),
fixed AS (SELECT *, CASE WHEN Child_CRN = Parent1_CRN THEN '' ELSE Child_CRN END AS crn2, CASE WHEN Child_First_Name = '' THEN Child_Last_Name ELSE Child_First_Name END AS first2, CASE WHEN Child_Legacy_Id = '0' THEN '0' ELSE ServiceID || '_' || Child_Legacy_Id END AS id2,
 CASE WHEN regexp_matches({_PLAIN('Parent1_Contact_Mobile')}, '^[1-9]\\d*$') THEN '0' || Parent1_Contact_Mobile ELSE Parent1_Contact_Mobile END AS tel2, CASE WHEN Consents_Photos_Videos = '' THEN 'N' ELSE Consents_Photos_Videos END AS consent2,
 CASE lower(EmergencyContact1_Emergency_Contact) WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE EmergencyContact1_Emergency_Contact END AS flag2,
 CASE WHEN lower(EmergencyContact1_Email) IN (lower(Parent1_Email), lower(p2)) THEN '' ELSE EmergencyContact1_Email END AS e1, CASE WHEN lower(e2) IN (lower(Parent1_Email), lower(p2)) THEN '' ELSE e2 END AS e2b FROM a),
rep AS (SELECT * EXCLUDE (p2, e1, e2, e2b, crn2, first2, id2, tel2, consent2, flag2, old_state) REPLACE (p2 AS Parent2_Email, e1 AS EmergencyContact1_Email, e2b AS EmergencyContact2_Email, crn2 AS Child_CRN, first2 AS Child_First_Name, id2 AS Child_Legacy_Id, tel2 AS Parent1_Contact_Mobile, consent2 AS Consents_Photos_Videos, flag2 AS EmergencyContact1_Emergency_Contact) FROM fixed),
""" + _LINKED.removeprefix("WITH RECURSIVE ").replace("fx_families", "rep") + """,
x AS (SELECT row_num, trim(ServiceID) AS given, src, t, n, trim(coalesce(Service_Name, '')) AS old FROM m),
i AS (SELECT p.*, x.row_num AS ra, y.row_num AS rb, x.slot AS sa, y.slot AS sb, 'DOB: ' || x.birth || ', Contact: ' || contact AS matched_on, linked.legacy AS l, linked.crn AS c FROM p JOIN raw x ON x.ord = a JOIN raw y ON y.ord = b JOIN linked ON linked.ord = a),
ids AS (SELECT lower(Child_Legacy_Id) AS k, count(*) AS n, min(row_num) AS f FROM rep GROUP BY 1 HAVING count(*) > 1), crns AS (SELECT lower(Child_CRN) AS k, count(*) AS n, min(row_num) AS f FROM rep WHERE trim(Child_CRN) <> '' GROUP BY 1 HAVING count(*) > 1),
m1 AS (SELECT lower(Parent1_Email) AS k, count(*) AS n FROM rep GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT lower(Parent1_CRN)) > 1), m2 AS (SELECT lower(Parent2_Email) AS k, count(*) AS n FROM rep WHERE Parent2_Email <> '' GROUP BY 1 HAVING count(*) > 1),
many AS (SELECT lower(Parent1_CRN) AS k, string_agg(DISTINCT lower(Parent1_Email), ', ' ORDER BY lower(Parent1_Email)) AS mails FROM rep GROUP BY 1 HAVING count(DISTINCT lower(Parent1_Email)) > 1),
log AS (SELECT 1 AS pass, row_num, 0 AS place, 'ServiceID' AS field, 'FIXED' AS severity, 'Source service ID ''' || given || ''' mapped to target service ID ''' || t || ''' (' || n || ').' AS text, 'Service ID updated: ' || given || ' → ' || t || ' (' || n || ')' AS action, NULL AS tag FROM x WHERE src = 'source'
UNION ALL SELECT 1, row_num, 0, 'ServiceID', 'FIXED', 'Service name ''' || given || ''' resolved to target service ID ''' || t || ''' (' || n || ').', 'Service ID updated from name: ''' || given || ''' → ''' || t || ''' (' || n || ')', NULL FROM x WHERE src = 'name'
UNION ALL SELECT 1, row_num, 0, 'ServiceID', 'WARNING', 'Service ID ''' || given || ''' was not found in the service map (checked as target ID, source ID and name).', '', NULL FROM x WHERE src IS NULL
UNION ALL SELECT 1, row_num, 1, 'Service_Name', 'FIXED', 'Service_Name ''' || old || ''' does not match the canonical name ''' || n || ''' for service ID ''' || t || '''.', 'Service_Name corrected: ''' || old || ''' → ''' || n || '''', NULL FROM x WHERE t IS NOT NULL AND old <> '' AND old <> n
UNION ALL """ + " UNION ALL ".join([
    _FIX(2, 0, "State", "old_state", "State", "set to a state's code"),
    _FIX(3, 0, "Parent2_Email", "Parent2_Email", "p2", "cleared repeated address", "'duplicate_parent_email'"), _FIX(3, 0, "EmergencyContact2_Email", "EmergencyContact2_Email", "e2", "cleared repeated address"),
    _FIX(3, 1, "Child_CRN", "Child_CRN", "crn2", "cleared a parent's CRN"), _FIX(3, 2, "Child_First_Name", "Child_First_Name", "first2", "took the last name"), _FIX(3, 3, "Child_Legacy_Id", "Child_Legacy_Id", "id2", "marked the id"),
    _FIX(3, 4, "Parent1_Contact_Mobile", "Parent1_Contact_Mobile", "tel2", "added the leading zero"), _FIX(3, 5, "Consents_Photos_Videos", "Consents_Photos_Videos", "consent2", "set to N"), _FIX(3, 6, "EmergencyContact1_Emergency_Contact", "EmergencyContact1_Emergency_Contact", "flag2", "written as 0 or 1"),
    _FIX(3, 7, "EmergencyContact1_Email", "EmergencyContact1_Email", "e1", "cleared a parent's address", "'redundant_ec'"), _FIX(3, 7, "EmergencyContact2_Email", "e2", "e2b", "cleared a parent's address", "'redundant_ec'"), _LOGGED,
]) + """ UNION ALL SELECT 5, row_num, 0, 'Child_Legacy_Id', 'ERROR', 'Child_Legacy_Id ''' || k || ''' is that of ' || n || ' rows, the first of which is row ' || f, '', NULL FROM rep JOIN ids ON k = lower(Child_Legacy_Id)
UNION ALL SELECT 5, row_num, 1, 'Child_CRN', 'ERROR', 'Child_CRN ''' || k || ''' is that of ' || n || ' rows, the first of which is row ' || f, '', NULL FROM rep JOIN crns ON k = lower(Child_CRN)
UNION ALL SELECT 6, row_num, 0, 'Parent1_Email', 'ERROR', 'Parent1_Email ''' || k || ''' is that of ' || n || ' rows', '', NULL FROM rep JOIN m1 ON k = lower(Parent1_Email)
UNION ALL SELECT 6, row_num, 1, 'Parent2_Email', 'WARNING', 'Parent2_Email ''' || k || ''' is that of ' || n || ' rows', '', NULL FROM rep JOIN m2 ON k = lower(Parent2_Email)
UNION ALL SELECT 7, row_num, 0, 'Parent1_CRN / Parent1_Email', 'ERROR', 'Parent1_CRN ''' || k || ''' goes with the addresses ' || mails, '', NULL FROM rep JOIN many ON k = lower(Parent1_CRN)
UNION ALL SELECT 9, ra, 0, sa || '_Legacy_Account_ID', 'FIXED', sa || '_Legacy_Account_ID is that of the parent in row ' || rb || ' (' || matched_on || ')', 'Kept as first-created profile; row ' || rb || ' linked to it', 'intra_file_duplicate_parent' FROM i
UNION ALL SELECT 9, rb, 0, sb || '_Legacy_Account_ID', 'FIXED', sb || '_Legacy_Account_ID is that of the parent in row ' || ra || ' (' || matched_on || ')', 'Linked to first-created profile at row ' || ra || ' (legacy ''' || l || ''', CRN ''' || c || ''')', 'intra_file_duplicate_parent' FROM i)
SELECT row_number() OVER (ORDER BY pass, log.row_num, place, field, text) AS ordinal, pass, log.row_num, trim(f.Child_First_Name || ' ' || f.Child_Last_Name) AS child_name, field, severity, text, action, coalesce(tag, '') AS tag
FROM log JOIN fx_families f ON f.row_num = log.row_num"""
)


@query(_FAMILIES_LOG)
def families_log(v):
    """All passes of a whole families run in one log, in order."""
    log = issue_log.families_log(v("fx_families"), v("fx_service_map"), AS_OF)
    return log.select("ordinal", "pass", "row_num", "child_name", "field", "severity", "text", "action", F.coalesce("tag", F.lit("")).alias("tag"))
