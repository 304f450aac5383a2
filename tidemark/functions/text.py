"""Scalar text functions: Columns in, Columns out. Null counts as blank throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms and word lists.
CRN = r"^\d{9}[A-Za-z]$"
PHONE = r"^(\+?61[\s\-]?|0)([2378]\d[\s\-]?\d{4}[\s\-]?\d{4}|4\d{2}[\s\-]?\d{3}[\s\-]?\d{3})$"
BARE_MOBILE = r"^4\d{8}$"
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
POSTCODE = r"^\d{4}$"
STATES = ("NSW", "VIC", "QLD", "SA", "WA", "TAS", "ACT", "NT")
STATE_SPELLINGS = {
    "new south wales": "NSW", "new south wale": "NSW", "nsw": "NSW", "n.s.w": "NSW", "n.s.w.": "NSW",
    "victoria": "VIC", "vic": "VIC", "v": "VIC",
    "queensland": "QLD", "qld": "QLD", "queesland": "QLD", "queenslnd": "QLD",
    "south australia": "SA", "sa": "SA", "sth australia": "SA", "south aust": "SA", "s.a": "SA", "s.a.": "SA",
    "western australia": "WA", "wa": "WA", "west australia": "WA", "w.a": "WA", "w.a.": "WA",
    "tasmania": "TAS", "tas": "TAS", "tassie": "TAS",
    "australian capital territory": "ACT", "act": "ACT", "a.c.t": "ACT", "a.c.t.": "ACT", "canberra": "ACT",
    "northern territory": "NT", "nt": "NT", "n.t": "NT", "n.t.": "NT",
}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DAYS = [f"{d[:3].upper()}{w}" for w in (1, 2) for d in WEEKDAYS]


def col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


#: All characters that Unicode calls white space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Without any white space at both ends; Spark's trim alone takes spaces only, and a pattern would scan the whole text."""
    return F.btrim(text(c), F.lit(WHITE))


def norm(c: Column | str) -> Column:
    return F.lower(strip(c))


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def matches(c: Column | str, pattern: str) -> Column:
    return strip(c).rlike(pattern)


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """Null where the key is not listed."""
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[key]


def child_name(first: str = "Child_First_Name", last: str = "Child_Last_Name") -> Column:
    return F.coalesce(or_null(strip(F.concat_ws(" ", strip(first), strip(last)))), F.lit("Unknown"))


def contact_key(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(strip(c), r"[\s\-()]", ""))


def is_phone(c: Column | str) -> Column:
    plain = F.regexp_replace(strip(c), r"[\s\-()]", "")
    return plain.rlike(BARE_MOBILE) | plain.rlike(PHONE)


def state_code(c: Column | str, fallback: Column | None = None) -> Column:
    """A code in upper case, the code of a known spelling, the fallback, or the text itself."""
    value = strip(c)
    known = lookup(STATE_SPELLINGS, F.lower(value))
    other = or_null(text(fallback)) if fallback is not None else F.lit(None).cast("string")
    return F.when(value == "", value).when(F.upper(value).isin(*STATES), F.upper(value)).otherwise(F.coalesce(known, other, value))


def base_id(c: Column | str) -> Column:
    """A legacy id without its numeric suffix."""
    return F.regexp_replace(strip(c), r"_\d+$", "")


def identity_key(prefix: str, columns: list[str]) -> Column:
    """What tells one parent from another: CRN, else legacy id, else first|last, else blank; lower case."""
    has = lambda name: norm(f"{prefix}_{name}") if f"{prefix}_{name}" in columns else F.lit("")
    first, last = has("First_Name"), has("Last_Name")
    both = F.when((first != "") | (last != ""), F.concat(first, F.lit("|"), last))
    return F.coalesce(or_null(has("CRN")), or_null(has("Legacy_Account_ID")), both, F.lit(""))


def number(c: Column | str) -> Column:
    """A double, null for what is no plain number; type suffixes that the SQL cast takes are refused."""
    value = strip(c)
    return F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value.try_cast("double"))


def day_flag(c: Column | str) -> Column:
    """Booked if the number, truncated, is 1."""
    return F.coalesce(F.floor(number(c)) == 1, F.lit(False))


def room_key(c: Column | str) -> Column:
    plain = F.regexp_replace(text(c), r"[^a-zA-Z0-9 ]", " ")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def day_summary(columns: list[str]) -> Column:
    flags = F.array(*(F.when(day_flag(c), F.lit(c[:3].capitalize() + c[-1])) for c in columns))
    return F.coalesce(or_null(F.array_join(F.array_compact(flags), ", ")), F.lit("None"))


def days_of(mask: Column) -> Column:
    """The booked days of a mask in order, as "MON1, WED2"; a dash for none."""
    names = F.array(*map(F.lit, DAYS))
    flags = F.filter(names, lambda d, i: mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    return F.coalesce(or_null(F.array_join(flags, ", ")), F.lit("—"))


def whole_number(c: Column | str) -> Column:
    """"248992.0" becomes "248992"."""
    return F.regexp_replace(col(c), r"^(-*\d+)\.0$", "$1")


def amount(c: Column | str) -> Column:
    """A currency text as a double; zero, blank and unreadable texts are null."""
    return F.nullif(number(F.regexp_replace(strip(c), "[,$]", "")), F.lit(0.0))


def first_name(account: Column | str) -> Column:
    """Of "Last, First"; without a comma all of it."""
    value = strip(account)
    return F.when(value.contains(","), strip(F.substring(value, F.instr(value, ",") + 1, F.length(value)))).otherwise(value)


def last_name(account: Column | str) -> Column:
    value = strip(account)
    return F.when(value.contains(","), strip(F.substring_index(value, ",", 1))).otherwise(F.lit(""))


def weekday_name(c: Column | str) -> Column:
    """Mon to Sun of a full or short name, else null."""
    return lookup({k: d[:3] for d in WEEKDAYS for k in (d.lower(), d[:3].lower())}, norm(c))


def search_words(name: Column | str) -> Column:
    """The words of a name that suggestions go by: over two letters, without the articles."""
    words = F.split(F.lower(text(name)), r"(?U)\W+")
    return F.filter(words, lambda w: (F.length(w) > 2) & (w != "the"))


def file_label(c: Column | str) -> Column:
    """A file name of any text: reserved characters become "_", ends are trimmed."""
    return strip(F.regexp_replace(text(c), r'[\\/:*?"<>|]', "_"))


def file_word(c: Column | str) -> Column:
    """A file name of words: other characters go, spaces and apostrophes become one "_", none at the ends."""
    words = F.regexp_replace(strip(F.regexp_replace(text(c), r"(?U)[^\w\s'-]", "")), r"(?U)[\s'_]+", "_")
    return F.regexp_replace(words, "^_+|_+$", "")


def file_part(c: Column | str) -> Column:
    """A part of a file name: reserved characters become "_", spaces stay."""
    return F.regexp_replace(text(c), r'[\\/:*?"<>|]', "_")
