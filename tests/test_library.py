"""End-to-end smoke cases and quirks."""

import csv
import datetime
import io
import random
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import bookings, components, entity, intervals, names, payments
from tidemark.operators.components import block_components
from tidemark.plans import issue_log, lineage, numbering, repairs, rules
from tidemark.sources import readers, sinks, split_csv
from tidemark.streaming.rules import stream_issues

HEADER = ["ServiceID", "Service_Name", "Child_Legacy_Id", "Child_First_Name", "Child_Last_Name", "DOB", "Status", "Child_CRN", "Room_Name", "Enrolment_Start_Date", "State", "Parent1_CRN", "Parent1_Legacy_Account_ID", "Parent1_DOB", "Parent1_Email", "Parent1_First_Name", "Parent1_Last_Name", "Parent1_Contact_Mobile"]


def child(**changes):
    row = dict(zip(HEADER, ["122956", "Sunny", "1", "Ann", "Lee", "2020-01-02", "Active", "123456789A", "Blue", "2024-01-15", "VIC", "987654321B", "P1", "1985-04-04", "a@example.com", "Pat", "Lee", "0412345678"]))
    return tuple((row | changes).values())


@pytest.fixture(scope="module")
def families(spark):
    rows = [child(), child(Room_Name=" ", Child_Legacy_Id="2"), child(Child_CRN="12345", DOB="2020-13-40", Parent1_Email="not-an-email", Child_Legacy_Id="3"), child(State="victoria", Child_Legacy_Id="4"), child(ServiceID="182", Child_Legacy_Id="5", Parent1_Legacy_Account_ID="P9")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 2)], ["row_num", *HEADER])
    return df, readers.service_map_of(spark, [("Sunny", "9999-182", "182", "122956"), ("None", "1", "1", " ")])


def test_smoke_case(families):
    df, service_map = families
    fixed = repairs.repair(df, service_map)
    got = {(r.row_num, r.field, r.severity) for r in rules.issues(fixed, rules.row_rules(fixed.columns, "2025-01-01"), ["row_num"]).collect()}
    assert {(3, "Room_Name", "ERROR"), (4, "Child_CRN", "ERROR"), (4, "DOB", "ERROR"), (4, "Parent1_Email", "ERROR")} <= got
    values = {r.row_num: r for r in fixed.collect()}
    assert values[5].State == "VIC" and values[6].ServiceID == "122956" and values[6].Child_Legacy_Id == "122956_5"
    linked = {r.ord: r.legacy for r in entity.auto_link(entity.profiles(fixed)).collect()}
    assert linked[12] == "P1"  # row 6 took over the id of the first profile, as that row writes it


def test_auto_link_reads_what_was_overwritten(spark):
    # A-C and B-C share a phone, A-B do not: C ends with B's id.
    rows = [(1, "s", "Parent1", 2, "pat", "lee", "1985", "a", "", ["1"], [], "A"), (2, "s", "Parent1", 4, "pat", "lee", "1985", "b", "", ["2"], [], "B"), (3, "s", "Parent1", 6, "pat", "lee", "1985", "c", "", ["1", "2"], [], "C")]
    p = spark.createDataFrame(rows, "row_num long, service string, slot string, ord long, first string, last string, dob string, legacy string, crn string, contacts array<string>, emails array<string>, legacy_id string")
    assert {r.ord: r.legacy for r in entity.auto_link(p).collect()} == {2: "A", 4: "B", 6: "B"}


PROFILE = "row_num long, service string, slot string, ord long, first string, last string, dob string, legacy string, crn string, contacts array<string>, emails array<string>, legacy_id string, birth string"


def replay(profiles):
    """Pairs in order: the later takes over what the earlier then has, where that is not blank."""
    base = lambda x: re.sub(r"_\d+$", "", x)
    ids, crns = {p[3]: p[11] for p in profiles}, {p[3]: p[8] for p in profiles}
    pairs = []
    for i, a in enumerate(profiles):
        for b in profiles[i + 1 :]:
            if a[4:7] == b[4:7] and a[6] and set(a[9]) & set(b[9]) and not (a[7] and b[7] and base(a[7]) == base(b[7])):
                ids[b[3]], crns[b[3]] = ids[a[3]] or ids[b[3]], crns[a[3]] or crns[b[3]]
                pairs.append((a[3], b[3]))
    return ids, crns, pairs


def test_auto_link_against_a_replay(spark):
    """Blank and repeated ids, ids with suffixes, blank CRNs and several phones, in few identities."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        legacy = rng.choice(["", "A1", "A1_1", "B2", "C3", "D4_2", f"E{i}"])
        phones = rng.sample("1234567", rng.choice([1, 1, 2, 3]))
        rows.append((i, "s", "Parent1", 2 * i, rng.choice("pq"), "lee", rng.choice(["1985", "1985", ""]), legacy.lower(), rng.choice(["", "", f"X{i}"]), phones, [], legacy, "1985"))
    p = spark.createDataFrame(rows, PROFILE)
    ids, crns, pairs = replay(rows)
    linked = entity.auto_link(p)
    for found in (linked, entity.auto_link(p, local=90), entity.auto_link(p, local=0)):
        # In one pass a person, by rounds, and some persons each way.
        assert {r.ord: (r.legacy, r.crn) for r in found.collect()} == {r[3]: (ids[r[3]], crns[r[3]]) for r in rows if r[6]}
    assert sorted((r.a, r.b) for r in entity.parent_pairs(p).collect()) == sorted(pairs)
    issues = entity.link_issues(p, linked).collect()
    assert len(issues) == 2 * len(pairs) and {r.severity for r in issues} == {"FIXED"}
    # Clusters from stars are those of the pairs.
    root = {r[3]: r[3] for r in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    members = {}
    for r in rows:
        members.setdefault(find(r[3]), []).append(r)
    many = {k for k, m in members.items() if len(m) > 1 and len({re.sub(r"_\d+$", "", r[7]) for r in m if r[7]}) >= 2}
    assert {r.ord: r.cluster for r in entity.parent_clusters(p).collect()} == {r[3]: k for k in many for r in members[k]}


def test_linking_along_a_chain_of_blank_profiles(spark):
    """1000 profiles, each linked by a phone to the next, and only the first has an id; no table is written a link."""
    rows = [(i, "s", "Parent1", 2 * i, "p", "lee", "1985", "a1" if i == 0 else "", "", [f"t{i}", f"t{i + 1}"], [], "A1" if i == 0 else "", "1985") for i in range(1000)]
    before = lineage.place()
    got = entity.auto_link(spark.createDataFrame(rows, PROFILE).repartition(5)).collect()
    assert len(got) == 1000 and {(r.legacy, r.crn) for r in got} == {("A1", "")} and lineage.place() - before == 2


def test_linking_of_one_identity_is_not_quadratic(spark):
    """One name, birth date and phone for all of 20,000 profiles."""
    p = spark.range(20_000).selectExpr("id row_num", "'s' service", "'Parent1' slot", "id ord", "'test' first", "'test' last", "'1900' dob", "concat('i', id % 5000) legacy", "'' crn", "array('0') contacts", "array('') emails", "concat('I', id % 5000) legacy_id", "'1900' birth")
    assert {r.legacy for r in entity.auto_link(p).select("legacy").distinct().collect()} == {"I0"}
    assert entity.parent_clusters(p).select("cluster").distinct().count() == 1


def test_conflict_components_against_all_pairs(spark):
    """Sweeps by day give the components of all pairs, with bookings that end before they start."""
    rng = random.Random(12)
    day = lambda n: (datetime.date(2024, 1, 1) + datetime.timedelta(days=n)).strftime("%d/%m/%Y")
    rows = []
    for i in range(300):
        a = rng.randrange(200)
        b = a + rng.choice([0, 3, 10, 30, -5])
        rows.append((i, "1", rng.choice("ab"), day(a), day(b), rng.choice(["f", "F "]), rng.choice(["r", "R.", "s"]), "Weekly", rng.choice([1, 2, 4, 3, 64, 0])))
    df = spark.createDataFrame(rows, "src_row long, service_id string, child_id string, start_date string, end_date string, fee string, room string, week_type string, days int")
    root = list(range(300))
    find = lambda x: x if root[x] == x else find(root[x])
    for r in bookings.recurring_conflicts(df).collect():
        x, y = sorted((find(r.a), find(r.b)))
        root[y] = x
    want = {}
    for i in range(300):
        want.setdefault(find(i), []).append(i)
    want = {k: m for k, m in want.items() if len(m) > 1}
    got = bookings.resolve_conflicts(df).collect()
    assert {r.src_row: r.component for r in got} == {i: k for k, m in want.items() for i in m}
    end = lambda i: datetime.datetime.strptime(rows[i][4], "%d/%m/%Y")
    assert {r.src_row for r in got if r.kept} == {max(m, key=lambda i: (end(i), -i)) for m in want.values()}


BOOKING = "src_row long, service_id string, child_id string, start_date string, end_date string, fee string, room string, week_type string, days int"
SHOWN = lambda n: (datetime.date(1999, 12, 20) + datetime.timedelta(days=n)).strftime("%d/%m/%Y")


def some_bookings(rng, n, first=0, kinds=("Weekly", "Fortnightly")):
    rows = []
    for i in range(n):
        a = rng.randrange(120)
        rows.append((first + i, "1", rng.choice("ab"), SHOWN(a), SHOWN(a + rng.choice([0, 1, 3, 10, 30, 77, -5])), rng.choice(["f", "F ", "g"]), rng.choice(["r", "R.", "s"]), rng.choice(kinds), rng.choice([1, 2, 4, 3, 64, 0, 128, 8192, 127, 16383])))
    return rows


def test_first_partners_and_overlaps_against_all_pairs(spark):
    rng = random.Random(21)
    rows = some_bookings(rng, 250) + [(900, "1", "a", "soon", "", "f", "r", "Weekly", 1)]
    df = spark.createDataFrame(rows, BOOKING)
    pairs = [(r.a, r.b) for r in bookings.recurring_conflicts(df).collect()]
    want = {}
    for x, y in pairs + [(b, a) for a, b in pairs]:
        want[x] = min(y, want.get(x, y))
    assert {r.src_row: r.other for r in bookings.first_partners(df.select("src_row"), df).collect()} == want and len(want) > 100
    casual = some_bookings(rng, 200, 5000, ("CASUAL",))
    date = lambda t: datetime.datetime.strptime(t, "%d/%m/%Y").date()
    room = lambda t: re.sub("[^a-z]", "", t.lower())
    found = {}
    for c in casual:
        for r in rows[:250]:
            if (c[2], room(c[6])) == (r[2], room(r[6])) and date(r[3]) <= date(c[3]) <= date(r[4]):
                week = (date(c[3]) - date(r[3])).days // 7 % 2 if r[7] == "Fortnightly" else 0
                if r[8] >> (date(c[3]).weekday() + 7 * week) & 1:
                    found.setdefault(c[0], (r[0], c[5].strip() == r[5].strip()))
    got = bookings.casual_overlaps(spark.createDataFrame(casual, BOOKING), df)
    assert {r.src_row: (r.recurring_row, r.same_fee) for r in got.collect()} == found and len(found) > 50
    assert bookings.casual_overlaps(df.limit(0), df).count() == bookings.casual_overlaps(df, df.limit(0)).count() == 0


def test_overlaps_of_one_child_with_many_bookings(spark):
    """100,000 recurring and as many casual bookings of one child: an index, not their pairs."""
    day = "date_format(date_add(date'2020-01-01', cast({} as int)), 'dd/MM/yyyy')"
    r = spark.range(100_000).selectExpr("id src_row", "'1' service_id", "'c' child_id", f"{day.format('id % 900')} start_date", f"{day.format('id % 900 + 40 + id % 7')} end_date", "'f' fee", "'r' room", "'Weekly' week_type", "cast(1 << cast(id % 7 as int) as int) days")
    c = spark.range(100_000).selectExpr("id + 1000000 src_row", "'1' service_id", "'c' child_id", f"{day.format('id % 1500')} start_date", "'' end_date", "'f' fee", "'r' room", "'CASUAL' week_type", "0 days")
    got = bookings.casual_overlaps(c, r).cache()
    # Each day up to the last end but for the first few has a booking that covers it.
    assert got.select("src_row").distinct().count() == got.count() > 60_000 and got.agg(F.max("recurring_row")).first()[0] < 7 * 900


def test_spans_make_up_their_interval(spark):
    rng = random.Random(4)
    rows = [(a, a + rng.randrange(-2, 60)) for a in rng.sample(range(500), 80)] + [(0, 0), (0, 511), (730_000, 733_000)]
    df = spark.createDataFrame(rows, "a int, b int")
    levels = intervals.levels_for(df, "a", "b")
    for r in df.select("a", "b", intervals.spans_of(F.col("a"), F.col("b"), levels).alias("s")).collect():
        days = [d for x in r.s for d in range(x.span << x.level, (x.span + 1) << x.level)]
        assert sorted(days) == list(range(r.a, r.b + 1)) and len(r.s) <= 2 * levels


def test_numbers_by_spans(spark):
    rng = random.Random(13)
    rows = [(rng.choice("abc"), n) for n in rng.sample(range(-50, 1000), 300)]
    df = spark.createDataFrame(rows, "k string, n long")
    want = {k: sorted(n for x, n in rows if x == k) for k in "abc"}
    assert {(r.k, r.n): r.i for r in numbering.numbered(df, ["k"], "n", "i", first=2, span=7).collect()} == {(k, n): i + 2 for k, ns in want.items() for i, n in enumerate(ns)}
    got = numbering.in_sequence(df, ["k", "n"], "i").collect()
    assert [(r.k, r.n) for r in sorted(got, key=lambda r: r.i)] == sorted(rows) and sorted(r.i for r in got) == list(range(1, 301))
    assert numbering.numbered(df.limit(0), [], "n", "i").count() == numbering.in_sequence(df.limit(0), ["n"], "i").count() == 0


def test_hot_groups_are_joined_apart(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 700, 0, id) as k")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for over in (1, 100, 10_000):
        assert {(r.id, r.n) for r in lineage.join_groups(rows, groups, ["k"], "n", over).collect()} == {(i, 700 if i < 700 else 1) for i in range(1000)}


def test_written_tables_are_discarded_and_swept(spark):
    at = lineage.place()
    tables = [lineage.written(spark.range(3), "one") for _ in range(3)]
    lineage.discard(spark, at)
    assert tables[2].count() == 3 and lineage.place() == at + 1
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|not exist"):
        tables[0].count()
    assert lineage.sweep(spark, hours=24) == 0 and tables[2].count() == 3


@pytest.mark.parametrize("local", [0, 100_000])
def test_components_of_long_chains(spark, monkeypatch, local):
    """Chains of 1000: in adverse order, the least at one end and the others descending towards it, and at random."""
    monkeypatch.setattr(components, "LOCAL", local)
    n = 1000
    rng = random.Random(6)
    chains = {"adverse": [0, *range(n - 1, 0, -1)], "random": rng.sample(range(n), n)}
    edges = [(block, chain[i], chain[i + 1]) for block, chain in chains.items() for i in range(n - 1)]
    nodes = [(block, i) for block in chains for i in range(n)] + [("random", n)]
    got = block_components(spark.createDataFrame(nodes, "block string, node long"), spark.createDataFrame(edges, "block string, a long, b long"), ["block"], "node")
    assert sorted(map(tuple, got.select("block", "node", "component").collect())) == sorted((block, i, i if i == n else 0) for block, i in nodes)


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [("3/4/70", "1970-04-03"), ("12/25/2024 01:30 PM", "2024-12-25"), ("2024-1-5", "2024-01-05"), ("29/02/2023", None), ("", None), ("03/04/2024 23:59:59", "2024-04-03"), ("5/6/68", "2068-06-05")])
def test_payment_dates(spark, raw, want):
    got = value(spark, dates.payment_date("x"), x=raw)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize("raw, want", [("2026/03/05", "2026-03-05"), ("5 Mar 2026", "2026-03-05"), ("05.03.2026", "2026-03-05"), ("5-mar-2026 1:30 PM", "2026-03-05"), ("5 March 2026", "2026-03-05"), ("March 5, 2026", "2026-03-05"), ("5/3/26", "2026-03-05"), ("31/02/2026", None), ("5 Foo 2026", None)])
def test_booking_dates(spark, raw, want):
    got = value(spark, dates.booking_date("x"), x=raw)
    assert (str(got) if got else None) == want


def test_texts(spark):
    assert value(spark, text.file_word("x"), x=" St. Mary's  é_Kids!- ") == "St_Mary_s_é_Kids-"
    assert value(spark, text.strip("x"), x="\t a  ") == "a"
    assert value(spark, text.day_flag("x"), x="1.9") and not value(spark, text.day_flag("x"), x="1.0d")
    assert value(spark, text.room_key("x"), x="Koalaâs  (Room)") == "koala s room"
    assert value(spark, text.amount("x"), x="-$1,234.56") == -1234.56 and value(spark, text.amount("x"), x="(5)") is None
    assert value(spark, text.state_code("x"), x=" n.s.w. ") == "NSW" and value(spark, text.state_code("x", F.lit("QLD")), x="zz") == "QLD"
    assert value(spark, text.is_phone("x"), x="061412345678") is False


def test_fixes_are_logged_in_order(families):
    df, service_map = families
    scope = repairs.in_scope(df, service_map)
    logged = repairs.logged_repairs(repairs.normalise_states(scope, repairs.modal_states(scope)))
    fixed = repairs.fixed_issues(logged, ["row_num"])
    assert {r.severity for r in fixed.collect()} == {"FIXED"} and fixed.where("field = 'Child_Legacy_Id'").count() == 5
    # The logged run differs from the plain one by its last step only, which here changes nothing.
    assert logged.select(HEADER).exceptAll(repairs.repair(df, service_map).select(HEADER)).count() == 0


def test_payment_files(spark, tmp_path):
    plan = {"row_num": 2, "service_id": "182", "service_name": "", "parent_id": "P", "parent_fn": "Pat ", "parent_ln": "Lee", "child_id": "9", "start_date": "2024-1-5", "weekday": "friday", "manual": "No", "cycle": "", "dd_limit": "", "fixed_amount": ""}
    rows = spark.createDataFrame([tuple(plan.values()), tuple((plan | {"row_num": 3, "service_id": "7"}).values())], list(plan))
    services = readers.service_map_of(spark, [("Sunny", "9999-182", "182", "122956")])
    repaired = payments.repair_plans(rows)
    split = payments.split_plans(repaired, services, spark.createDataFrame([], "dbid long, service_id string, name string"))
    sinks.write_payment_splits(payments.import_template(split, services), str(tmp_path / "out"))
    (got,) = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert (got.Service_Name, got.Child_Legacy_Id, got.Direct_Debit_Start_Date, got.Direct_Debit_Day, got.service_label) == ("Sunny", "122956_9", "05/01/2024", "Fri", "Sunny")
    sinks.write_repaired_payments(repaired, ["parent_fn", "weekday"], str(tmp_path / "all"))
    assert [r.parent_fn for r in spark.read.option("header", True).csv(str(tmp_path / "all")).collect()] == ["Pat", "Pat"]


def test_payment_error_detail(spark):
    names = ["row_num", "service_id", "service_name", "parent_id", "parent_fn", "parent_ln", "child_id", "start_date", "weekday", "manual", "cycle", "dd_limit", "fixed_amount"]
    rows = [(2, "1", "S", "P", None, "Lee", "9", "2024-1-6", "sun", "yes", "Daily", "5", "7"), (70_000, "1", "S", "P", "Pat", "Lee", "9", "soon", "sat", "", "", "-1", "")]
    repaired = payments.repair_plans(spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'row_num' else 'string'}" for n in names)))
    got = payments.error_detail(repaired).orderBy("seq").collect()
    assert [(r.seq, r.row_num, r.note) for r in got] == [
        (1, 2, "Falls on a Sunday (06/01/2024) — please verify before importing"), (2, 70_000, "Falls on a Saturday (soon) — please verify before importing"),
        (3, 2, 'First: "(empty)"  Last: "Lee"'), (4, 2, 'Value: "Daily" — must be Weekly / Fortnightly / Monthly'),
        (5, 2, "Starts on Saturday (06/01/2024) — Manual plans must start on Monday"), (6, 70_000, "Value = -1  (must be >= 0)"),
        (7, 2, "Limit=5  AND  Fixed=7  (only one allowed)"), (8, 70_000, 'Cannot parse: "soon"'),
    ]
    assert (got[0].parent_name, got[0].label, got[0].key) == ("Lee", "WEEKEND — Sat / Sun", "ERROR_INVALID_PAYMENT_DAY")
    assert payments.error_detail(repaired.limit(0)).count() == 0


def test_empty_tables(spark, families):
    df, service_map = families
    fixed = repairs.repair(df.limit(0), service_map)
    assert fixed.count() == 0 and entity.parent_clusters(entity.profiles(fixed)).count() == 0


def test_files_round_trip(spark, tmp_path, families):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('﻿ ServiceID ,Child_First_Name,Child_Last_Name\n182.0,"Ann\nMay",Lee\n,Bo,\n')
    (tmp_path / "in/b.csv").write_text("ServiceID,Child_First_Name,Other\n7,Cy,x\n")
    df = readers.read_numbered(spark, [str(tmp_path / "in/a.csv"), str(tmp_path / "in/b.csv")])
    got = sorted((r.row_num, r.ServiceID, r.child_name) for r in df.collect())
    assert got == [(2, "182", "Ann\nMay Lee"), (3, "", "Bo"), (4, "7", "Cy")]
    (tmp_path / "in/c.xls").write_text("<html><table><tr><th>Centre Name</th></tr><tr><td>Sunny</td></tr></table><table><tr><td>no</td></tr></table>")
    assert [r.cells for r in readers.read_html_tables(spark, str(tmp_path / "in/c.xls")).orderBy("line").collect()] == [["Centre Name"], ["Sunny"]]
    long = "é" * 5000
    pages = {"long.xls": "<html>" + "<!-- > -->" * 200 + "<table>" + "".join(f"<tr><td>{i}</td><td a='>'>{long if i == 7 else '&lt;b&gt;'}</td></tr><tr></tr>" for i in range(25_000)) + "</table><table><tr><td>no</td></tr></table>",
             "cut.xls": "<table><tr><td>a</td></tr><tr><td>b</td><td", "none.xls": "<p>no</p>", "text.xls": "a < b", "empty.xls": "", "mark.xls": "\ufeff<table><tr><td>x</td></tr></table>"}
    for name, page in pages.items():
        (tmp_path / name).write_text(page)
    got = {}
    for r in readers.html_and_rejected(spark, str(tmp_path / "*.xls")).collect():
        got.setdefault(r.file.rpartition("/")[2], []).append((r.line, r.cells, r.reason))
    assert sorted(got.pop("long.xls")) == [(i, [str(i), long if i == 7 else "<b>"], None) for i in range(25_000)]
    assert got == {"cut.xls": [(0, ["a"], None), (1, ["b"], None)], "none.xls": [(None, None, "no table")], "text.xls": [(None, None, "not HTML")], "empty.xls": [(None, None, "empty")], "mark.xls": [(0, ["x"], None)]}
    (tmp_path / "more").mkdir()
    (tmp_path / "more/a.csv").write_text("Centre Name,Amount Due\nMoon,$5\n")
    (tmp_path / "more/b.xls").write_text("<p>x</p><table><tr><td> Centre Name </td><td>Credit</td></tr><tr><td>Sunny</td></tr></table>")
    (tmp_path / "more/c.bin").write_bytes(bytes(range(200, 250)))
    (tmp_path / "more/serviceIDs.csv").write_text("Centre Name\nNo\n")
    read = readers.read_balances(spark, str(tmp_path / "more"))
    assert sorted((r["Centre Name"], r["Amount Due"], r["Credit"], r.source_file) for r in read.collect()) == [("Moon", "$5", "", "a.csv"), ("Sunny", "", "", "b.xls")]
    (tmp_path / "old").mkdir()
    for name, cells in (("a.csv", "Parent1_First_Name,ServiceID\nPat,1\nBo,1\n"), ("b.csv", "ServiceID,Parent2_First_Name,Extra\n2,Cy,x\n"), ("c.csv", "no,parents\n1,2\n")):
        (tmp_path / "old" / name).write_text(cells)
    assert sorted((r.source_file, r.row_num, r.Parent1_First_Name, r.Parent2_First_Name) for r in readers.read_existing(spark, str(tmp_path / "old")).collect()) == [("a.csv", 2, "Pat", ""), ("a.csv", 3, "Bo", ""), ("b.csv", 2, "", "Cy")]
    rows, _ = families
    sinks.write_family_splits(rows, HEADER, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 5 and back.where("service_label = 'Sunny'").count() == 5


def test_stream_of_rows(spark, tmp_path, families):
    df, _ = families
    df.write.parquet(str(tmp_path / "rows"))
    stream_issues(spark.readStream.schema(df.schema).parquet(str(tmp_path / "rows")), "2025-01-01", str(tmp_path / "issues"), str(tmp_path / "marks")).awaitTermination()
    batch = rules.issues(df, rules.row_rules(df.columns, "2025-01-01"), ["row_num"])
    assert spark.read.parquet(str(tmp_path / "issues")).count() == batch.count() > 0


def test_entry_works_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert "row_issues" in __spark_entry__.queries()


def test_days_mask(spark):
    df = spark.createDataFrame([("1", "x", "1.0")], "mon1 string, tue1 string, mon2 string")
    assert df.select(bookings.day_mask(df.columns).alias("m")).first().m == 1 + 128


def _cell_texts(rng, odd):
    good = ["x", "", '"q""q"', '"l\nm"', '"\n\n"', '""', "y z", '"a,b"', '"\r\n"', "é"]
    return rng.choice(good + ['a"b', '"a"b', '"', '""a'] if odd else good)


@pytest.mark.parametrize("seed", range(4))
def test_quoted_csv_by_ranges_equals_the_whole_reader(spark, tmp_path, seed):
    """Range borders fall inside quotes, doubled quotes, line ends and characters."""
    rng = random.Random(seed)
    lines = [",".join(_cell_texts(rng, seed % 2) for _ in range(rng.choice([3, 3, 3, 1, 4]))) for _ in range(40)]
    path = tmp_path / "a b.csv"
    path.write_bytes(("h1,h2,h3\n" + "\n".join(lines) + '\n"end",,x').encode())
    want = [tuple(r) for r in spark.read.csv(str(path), header=True, multiLine=True, escape='"').collect()]
    for size in (13, 61, 10_000):
        table = split_csv.csv_table(spark, [str(path)], range_bytes=size)
        got = [tuple(r)[:3] for r in table.rows.orderBy("_record").collect()]
        assert got == want and table.counts == {0: len(want)}


def test_csv_files_of_many_kinds(spark, tmp_path):
    """Headers of several lines, equal and blank names, files without records, damaged files, line ends of both kinds."""
    for name, content in {"a.csv": b"\xef\xbb\xbf\"two\nlines\",B,b,\r\n1,\"x\r\ny\",3,4\r\n\r\n5\r\n", "b.csv": b"", "c.csv": b"\n\n", "d.csv": b"B\n\x00\n", "e.csv": b"B\n\xff\n", "f.csv": b'extra,"two\nlines"\nz,"never\nends\n'}.items():
        (tmp_path / name).write_bytes(content)
    table = split_csv.csv_table(spark, [str(tmp_path)], range_bytes=7, tolerant=True)
    assert [(f.rpartition("/")[2], why) for f, why in table.rejected] == [("b.csv", "no record"), ("c.csv", "no record"), ("d.csv", "NUL bytes"), ("e.csv", "not UTF-8")]
    assert table.columns == ["two\nlines", "B1", "b2", "_c3", "extra"]
    assert [tuple(r) for r in table.rows.orderBy("_file", "_record").collect()] == [("1", "x\r\ny", "3", "4", None, 0, 1), ("5", None, None, None, None, 0, 2), ("never\nends", None, None, None, "z", 5, 1)]
    assert split_csv.csv_table(spark, [str(tmp_path / "b.csv")]).rows.count() == 0
    with pytest.raises(FileNotFoundError):
        split_csv.csv_table(spark, [str(tmp_path / "none*.csv")])


def test_lines_of_splits_are_their_rows(spark, tmp_path):
    """Splits of one and of several files: the files one after the other are the header and the rows in order."""
    rows = [(k, ["big", "small", None, "a/b: c"][0 if k % 3 else k // 3 % 4], f'cell {k}\n"q", ') for k in range(1, 400)]
    df = spark.createDataFrame(rows, "n long, label string, cell string").repartition(7)
    placed = sinks._in_split(df, ["label"], "n")
    sinks.write_splits(placed, ["label"], "_place", ["n", "cell"], str(tmp_path / "out"), span=50)
    files = {}
    for f in sorted((tmp_path / "out").glob("label=*/part=*/*.csv"), key=lambda f: int(f.parent.name[5:])):
        files.setdefault(f.parent.parent.name, []).append(f)
    assert len(files["label=big"]) == 6 and all(len(v) == 1 for k, v in files.items() if k != "label=big")
    for label in ("big", "small", "Unknown", "a/b: c"):
        mine = [(str(n), c) for n, x, c in rows if (x or "Unknown") == label]
        folder = next(k for k in files if unquote(k) == f"label={label}")
        assert list(csv.reader(io.StringIO("".join(f.read_text() for f in files[folder]), newline=""))) == [["n", "cell"], *map(list, mine)]
    read = sinks.read_splits(spark, str(tmp_path / "out"), span=50)
    assert read.where("line = 0").count() == 4 and read.count() == 403
    sinks.write_splits(placed, ["label"], "_place", ["n"], str(tmp_path / "typed"), "parquet", span=50)
    assert spark.read.parquet(str(tmp_path / "typed")).agg(F.sum("n"), F.max("part")).first()[:] == (sum(range(400)), 5)
    sinks.write_splits(sinks._in_split(df, [], "n"), [], "_place", ["n"], str(tmp_path / "all"), span=1000)
    (one,) = (tmp_path / "all").glob("part=0/*.csv")
    assert one.read_text().split() == ["n", *(str(k) for k in range(1, 400))]


def test_names_that_contain_a_word(spark):
    rng = random.Random(8)
    defined = list({(rng.choice("kl"), "".join(rng.choices("abAB ", k=rng.randrange(1, 9)))) for _ in range(150)})
    words = list({(rng.choice("klm"), "".join(rng.choices("ab", k=rng.randrange(1, 6)))) for _ in range(60)})
    got = names.containing(spark.createDataFrame(words, "key string, word string"), spark.createDataFrame(defined, "key string, defined string"))
    want = {(k, w, d) for k, w in words for key, d in defined if key == k and w in d.lower()}
    assert {(r.key, r.word, r.defined) for r in got.collect()} == want and got.count() == len(want) > 300


def test_log_of_a_families_run(families):
    """All passes in order, numbered on; a user's own rule is one of the row rules."""
    df, service_map = families
    own = rules.Rule("no_blue", "Room_Name", "WARNING", F.col("Room_Name") == "Blue", "blue is closed", ("Room_Name",))
    log = issue_log.families_log(df, service_map, "2025-01-01", [own]).orderBy("ordinal").collect()
    assert [r.ordinal for r in log] == list(range(1, len(log) + 1)) and [r["pass"] for r in log] == sorted(r["pass"] for r in log)
    got = {(r.pass_name, r.row_num, r.field, r.severity) for r in log}
    assert {("services", 6, "ServiceID", "FIXED"), ("states", 5, "State", "FIXED"), ("repairs", 2, "Child_Legacy_Id", "FIXED"), ("row rules", 3, "Room_Name", "ERROR"), ("row rules", 4, "DOB", "ERROR"), ("row rules", 2, "Room_Name", "WARNING"), ("linked parents", 6, "Parent1_Legacy_Account_ID", "FIXED")} <= got
    texts = {(r.row_num, r.field, r.tag): (r.text, r.child_name) for r in log}
    assert texts[4, "DOB", "date"] == ("DOB '2020-13-40': no date", "Ann Lee") and texts[2, "Room_Name", "no_blue"][0] == "Room_Name 'Blue': blue is closed"
    assert next(r.meta for r in log if r.field == "State") == {"after": "VIC"}
    assert issue_log.families_log(df.limit(0), service_map, "2025-01-01").count() == 0


def test_metrics_on_the_way(spark):
    """A written table's metrics come from the job that writes it; an empty table has them too."""
    rows = spark.range(10_000).withColumn("g", F.col("id") % 7)
    aggregates = {"n": F.count(F.lit(1)), "odd": F.count_if(F.col("id") % 2 == 1), "groups": F.size(F.collect_set("g"))}
    for df, want in ((rows, (10_000, 5000, 7)), (rows.where("id < 0"), (0, 0, 0)), (rows.limit(0), (0, 0, 0)), (rows.repartition(5, "g"), (10_000, 5000, 7))):
        table, seen = lineage.measured(df, "seen", **aggregates)
        assert (seen["n"], seen["odd"], seen["groups"]) == want and table.count() == want[0]


@pytest.mark.parametrize("block", [0, 9, 64])
def test_blocks_by_pairs_and_by_spans_agree(spark, monkeypatch, block):
    """Small blocks go by their pairs, large ones by sweeps and spans, with one result."""
    rng = random.Random(33)
    rows = some_bookings(rng, 260)
    df, casual = spark.createDataFrame(rows, BOOKING), spark.createDataFrame(some_bookings(rng, 200, 5000, ("CASUAL",)), BOOKING)

    def results():
        resolved = bookings.resolve_conflicts(df)
        frames = resolved.select("src_row", "component", "kept"), bookings.first_partners(resolved, df), bookings.casual_overlaps(casual, df), bookings.conflict_report(df, resolved).select("src_row", "conflict_reason")
        return [sorted(map(tuple, f.collect())) for f in frames]

    monkeypatch.setattr(bookings, "BLOCK", 100_000)
    want = results()
    monkeypatch.setattr(bookings, "BLOCK", block)
    assert results() == want and all(want)


def test_dates_in_the_usual_form_and_white_space(spark):
    """All that Unicode calls white space is stripped, and first forms with times, blanks and days that don't exist are dates or null as before."""
    white = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    texts = [f"{white}1/2/2024\n", "01/02/2024 12:00:00 AM", "31/02/2024", "1/2/2024 13:00 PM", " ", "2024-02-01", "1.2.2024 9:05", "x" + white + "y", "​1/2/2024"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", dates.booking_date("t"), text.strip("t")).orderBy("i").collect()
    day = datetime.date(2024, 2, 1)
    assert [r[1] for r in rows] == [day, day, None, None, None, day, day, None, None]
    assert [r[2] for r in rows] == ["1/2/2024", *texts[1:4], "", *texts[5:]]


def test_named_texts_keep_their_order(spark):
    """A file's lines are in order whatever the order in which tasks hand them on."""
    from tidemark import queries

    path = lineage.new_folder(spark, "ordered")
    rows = spark.range(3000, numPartitions=7).selectExpr("concat('n', id % 3) name", "cast(2999 - id as string) value", "2999 - id o").orderBy(F.rand(5))
    queries._named_texts(rows, path, "o")
    for i in range(3):
        lines = [int(r.value) for r in spark.read.text(f"{path}/n{i}").collect()]
        assert len(lines) == 1000 and lines == sorted(lines)


def test_rows_are_put_in_sequence_after_one_evaluation(spark):
    """What leads to the rows runs once, not again to find the ranges by which they are sorted."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return -x

    df = spark.range(3000, numPartitions=3).withColumn("x", counted("id"))
    rows = numbering.in_sequence(df, ["x"], "n").collect()
    assert sorted((r.n, r.id) for r in rows) == [(i + 1, 2999 - i) for i in range(3000)] and seen.value == 3000


def test_a_log_is_dealt_to_many_tasks(families, monkeypatch):
    """The rules run over rows dealt by their numbers, however few ranges the input has."""
    plans, real = {}, issue_log.written

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().analyzed().toString()
        return real(df, label)

    monkeypatch.setattr(issue_log, "written", noted)
    issue_log.families_log(families[0].coalesce(1), families[1], "2025-01-01")
    assert "RepartitionByExpression" in plans["raw"]


def test_files_of_some_ten_megabytes_have_several_ranges(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    with open(path, "w") as f:
        f.write("a,b\n")
        f.writelines(f'{i},"{"x" * 1000}"\n' for i in range(40_000))
    found = split_csv.csv_records(spark, [path])
    assert len(found.rows.inputFiles()) > 1 and found.counts == [40_001]
