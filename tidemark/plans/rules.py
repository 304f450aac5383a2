"""Rules as data: which columns must have which form, and what an issue is.

A rule is a Column that is true where the value is wrong. Users extend a list of
rules with Columns of their own; no Python function runs on rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import dates, text

# Names of columns and accepted values.
CONTACTS = [f"EmergencyContact{i}" for i in range(1, 6)]
PARENTS = ["Parent1", "Parent2"]
MANDATORY = ["ServiceID", "Child_Legacy_Id", "Child_First_Name", "Child_Last_Name", "DOB", "Status", "Child_CRN", "Room_Name", "Enrolment_Start_Date"]
MANDATORY_PARENT = ["CRN", "Legacy_Account_ID", "DOB", "Email"]
DATES = ["DOB", "Enrolment_Start_Date", "Medicare_Expiry_Date", "Parent1_DOB", "Parent2_DOB"]
EMAILS = [f"{p}_{e}" for p in PARENTS for e in ("Email", "Work_Email")] + [f"{c}_Email" for c in CONTACTS]
PARENT_PHONES = ["Contact_Mobile", "Contact_Home", "Work_Phone"]
PHONES = [f"{p}_{x}" for p in PARENTS for x in PARENT_PHONES] + ["Medical_Practitioner_Phone"] + [f"{c}_Contact_Number" for c in CONTACTS]
CRNS = ["Child_CRN", "Parent1_CRN", "Parent2_CRN", "Enrolment_Parent_CRN"]
CONTACT_FLAGS = [f"{c}_{x}" for c in CONTACTS for x in ("Emergency_Contact", "Medical_Nominee", "Collection_Nominee", "Excursion_Nominee")]
FLAGS = ["Consents_Photos_Videos", "Epipen/Anipen", *CONTACT_FLAGS]
STATE_COLUMNS = ["State"] + [f"{p}_{x}" for p in PARENTS for x in ("State", "Work_State")] + [f"{c}_State" for c in CONTACTS]
POSTCODES = ["PostCode"] + [f"{p}_{x}" for p in PARENTS for x in ("Post_Code", "Work_Postcode")] + [f"{c}_Postcode" for c in CONTACTS]
NAME_SLOTS = ["Child", *PARENTS, *CONTACTS]
STATUSES, GENDERS = ("active", "inactive", "waitlist"), ("Male", "Female")
IDENTITIES = ("Male", "Female", "Non-Binary", "Trans Female", "Trans Male")
BOOLEANS = ("0", "1", "yes", "no", "true", "false")
LENGTHS = {
    "PostCode": 30, "Child_First_Name": 100, "Child_Middle_Name": 100, "Child_Last_Name": 100, "Gender": 100, "Gender_Identity": 100,
    "Religion": 100, "School": 200, "Class": 255, "Address": 255, "Suburb": 255, "Country": 255, "State": 255, "Language": 255,
    "Cultural_Background": 255, "Cultural_Requirements": 255, "Indigenous_Status": 255, "Medicare_Number": 255, "Medicare_Expiry_Date": 255,
    "Ambulance_Cover_Number": 255, "Health_Care_Centre": 255, "Medical_Practitioner_Name": 255, "Medical_Practitioner_Phone": 255,
    "Medical_Practitioner_Address": 255, "Child_CRN": 255, "Child_Legacy_Id": 255, "Parent1_Contact_Home": 20, "Parent1_Gender": 50,
    "Parent1_Legacy_Account_ID": 100, "Parent1_Title": 100, "Parent1_First_Name": 100, "Parent1_Middle_Name": 100, "Parent1_Last_Name": 100,
    "Parent1_Address_2": 100, "Parent1_Email": 200, "Parent1_CRN": 255, "Parent1_Suburb": 255, "Parent1_State": 255, "Parent1_Post_Code": 255,
    "Parent1_Indigenous_Status": 255, "Parent1_Language": 255, "Parent1_Cultural_Background": 255, "Parent1_Work_Email": 255,
    "Parent1_Work_Phone": 255, "Parent1_Work_Address": 255, "Parent1_Work_Suburb": 255, "Parent1_Work_Postcode": 255, "Parent1_Work_Country": 255,
    "Parent1_Work_State": 255, "Parent1_Country": 255, "Parent2_Legacy_Account_ID": 100, "Parent2_Email": 200, "Parent2_CRN": 255,
    "Parent2_Work_Email": 255,
}
#: The same for each emergency contact.
CONTACT_LENGTHS = {"Postcode": 20, "Contact_Number": 30, "Email": 60, "First_Name": 100, "Last_Name": 100}

ISSUE = T.StructType([T.StructField(n, t) for n, t in (("rule", T.StringType()), ("field", T.StringType()), ("severity", T.StringType()), ("value", T.StringType()), ("description", T.StringType()))])


@dataclass
class Rule:
    """One check: the columns that it needs, and what is wrong with their rows."""

    name: str
    field: str
    severity: str
    wrong: Column
    message: str
    needs: tuple[str, ...] = field(default=())

    def issue(self) -> Column:
        shown = F.col(f"`{self.needs[0]}`") if self.needs else F.lit(None).cast("string")
        parts = [F.lit(x) for x in (self.name, self.field, self.severity)] + [shown.cast("string"), F.lit(self.message)]
        return F.when(F.coalesce(self.wrong, F.lit(False)), F.struct(*(p.alias(f.name) for p, f in zip(parts, ISSUE))))


def _filled(name: str, fields: list[str], severity: str, bad, message: str) -> list[Rule]:
    return [Rule(name, f, severity, ~text.is_blank(f) & bad(f), message, (f,)) for f in fields]


def row_rules(columns: list[str], as_of: str) -> list[Rule]:
    """All row rules whose columns exist. `as_of` is the day that counts as today (yyyy-MM-dd)."""
    today, waiting = F.to_date(F.lit(as_of)), text.norm("Status") == "waitlist" if "Status" in columns else F.lit(False)
    r: list[Rule] = []
    for f in MANDATORY:
        missing = text.is_blank(f) & ~waiting if f == "Enrolment_Start_Date" else text.is_blank(f)
        r.append(Rule("mandatory", f, "ERROR", missing, "mandatory value is missing", (f,)))
    for p in PARENTS:
        block = [f"{p}_{x}" for x in MANDATORY_PARENT]
        there = [~text.is_blank(f) for x in ("First_Name", "Last_Name", "Email", "CRN") if (f := f"{p}_{x}") in columns]
        active = there[0] if there else F.lit(False)
        for x in there[1:]:
            active = active | x
        r += [Rule("mandatory_parent", f, "ERROR", active & text.is_blank(f), "value is missing though the parent is given", (f,)) for f in block]
    r += [Rule("contact_id", f"{c}_LegacyID", "ERROR", ~text.is_blank(f"{c}_First_Name") & text.is_blank(f"{c}_LegacyID"), "contact has no legacy id", (f"{c}_LegacyID", f"{c}_First_Name")) for c in CONTACTS]
    r += _filled("date", DATES, "ERROR", lambda f: dates.strict_date(f).isNull(), "no date")
    r += _filled("crn", CRNS, "ERROR", lambda f: ~text.matches(f, text.CRN), "no CRN")
    r += _filled("phone", PHONES, "WARNING", lambda f: ~text.is_phone(f), "no phone number")
    r += _filled("email", EMAILS, "ERROR", lambda f: ~text.matches(f, text.EMAIL), "no e-mail address")
    r += _filled("status", ["Status"], "ERROR", lambda f: ~text.norm(f).isin(*STATUSES), "unknown status")
    r += _filled("gender", ["Gender"], "WARNING", lambda f: ~text.strip(f).isin(*GENDERS), "unknown gender")
    r += _filled("gender", ["Gender_Identity"], "WARNING", lambda f: ~text.strip(f).isin(*IDENTITIES), "unknown gender identity")
    r += _filled("boolean", FLAGS, "ERROR", lambda f: ~text.norm(f).isin(*BOOLEANS), "no yes/no value")
    r += _filled("state", STATE_COLUMNS, "ERROR", lambda f: ~F.upper(text.strip(f)).isin(*text.STATES), "unknown state")
    r += _filled("postcode", POSTCODES, "WARNING", lambda f: ~text.matches(f, text.POSTCODE), "no postcode")
    r += [Rule("length", f, "ERROR", F.length(text.text(f)) > n, f"longer than {n}", (f,)) for f, n in (LENGTHS | {f"{c}_{x}": n for c in CONTACTS for x, n in CONTACT_LENGTHS.items()}).items()]
    r += _filled("service_id", ["ServiceID"], "ERROR", lambda f: ~F.coalesce(text.strip(f).try_cast("long") > 0, F.lit(False)), "no positive whole number")
    for slot in NAME_SLOTS[1:]:
        a, b = f"{slot}_First_Name", f"{slot}_Last_Name"
        r += [Rule("paired_name", y, "ERROR", ~text.is_blank(x) & text.is_blank(y), f"blank though {x} is given", (y, x)) for x, y in ((a, b), (b, a))]
    guardian = [f for f in ("Parent1_Email", "Parent1_CRN", "Parent1_Legacy_Account_ID") if f in columns]
    none = F.lit(True)
    for f in guardian:
        none = none & text.is_blank(f)
    r.append(Rule("waitlist_guardian", "Status / Parent1_Email", "WARNING", waiting & none, "no guardian on the waitlist", ("Status",)))
    start, born = dates.strict_date("Enrolment_Start_Date") if "Enrolment_Start_Date" in columns else None, dates.strict_date("DOB") if "DOB" in columns else None
    if start is not None:
        r.append(Rule("waitlist_past", "Status / Enrolment_Start_Date", "ERROR", waiting & (start < today), "waitlisted past the start", ("Status", "Enrolment_Start_Date")))
    if born is not None:
        r.append(Rule("future_birth", "DOB", "ERROR", born > today, "born in the future", ("DOB",)))
        if start is not None:
            r.append(Rule("start_before_birth", "Enrolment_Start_Date", "ERROR", start < born, "starts before birth", ("Enrolment_Start_Date", "DOB")))
    for p in PARENTS:
        f = f"{p}_CRN"
        r.append(Rule("shared_crn", "Child_CRN", "ERROR", ~text.is_blank("Child_CRN") & (text.strip("Child_CRN") == text.strip(f)), f"equals {f}", ("Child_CRN", f)))
    r += _filled("medicare", ["Medicare_Number"], "WARNING", lambda f: ~text.matches(f, r"^\d+$"), "not all digits")
    r.append(Rule("photo_consent", "Consents_Photos_Videos", "WARNING", text.is_blank("Consents_Photos_Videos"), "no consent value", ("Consents_Photos_Videos",)))
    return [x for x in r if all(n in columns for n in x.needs)]


def issues(df: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """The issues of all rules, in one narrow pass: `keep` columns, then rule, field, severity, value, description."""
    found = F.array_compact(F.array(*(r.issue() for r in rules)))
    return df.select(*keep, F.explode(found).alias("issue")).select(*keep, "issue.*")
