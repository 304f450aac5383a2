"""Views over the driver's tables with the shapes and defects of the migration files.

The texts run in Spark and in DuckDB alike; see FIXTURES.md.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nation", "customer", "orders", "part")

VIEWS: dict[str, str] = {
    "fx_service_map": """
SELECT n_name AS service_name, CASE WHEN n_regionkey % 2 = 0 THEN 'Long Day Care' ELSE 'OSHC' END AS service_type,
 '4258-' || CAST(n_nationkey + 100 AS STRING) AS source_full_id, CAST(n_nationkey + 100 AS STRING) AS source_service_id,
 CAST(500000 + n_nationkey AS STRING) AS target_service_id, n_nationkey AS map_ord
FROM nation WHERE n_nationkey % 8 <> 7
""",
    "fx_families": """
SELECT CAST(c_custkey + 2 AS BIGINT) AS row_num,
 CASE c_custkey % 4 WHEN 0 THEN CAST(500000 + c_nationkey AS STRING) WHEN 1 THEN CAST(c_nationkey + 100 AS STRING)
   WHEN 2 THEN '4258-' || CAST(c_nationkey + 100 AS STRING) ELSE lower(n_name) END AS ServiceID,
 CASE WHEN c_custkey % 6 = 0 THEN 'Old ' || n_name ELSE n_name END AS Service_Name,
 CAST(CASE WHEN c_custkey % 40 = 5 THEN c_custkey - 1 ELSE c_custkey END AS STRING) AS Child_Legacy_Id,
 CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'Kid' || CAST(c_custkey AS STRING) END AS Child_First_Name,
 'Fam' || CAST(c_custkey % 97 AS STRING) AS Child_Last_Name,
 CASE c_custkey % 5 WHEN 0 THEN '2020-13-40' WHEN 1 THEN '29/02/2023' WHEN 2 THEN '1/3/2021' WHEN 3 THEN '2020-05-10' ELSE '10/05/2019' END AS DOB,
 CASE c_custkey % 10 WHEN 0 THEN 'Waitlist' WHEN 1 THEN 'inactive' WHEN 2 THEN 'Pending' ELSE 'Active' END AS Status,
 CASE WHEN c_custkey % 7 = 0 THEN lpad(CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING), 9, '9') || 'B' WHEN c_custkey % 11 = 0 THEN '12345'
   ELSE lpad(CAST(c_custkey AS STRING), 9, '1') || 'A' END AS Child_CRN,
 CASE WHEN c_custkey % 17 = 0 THEN '  ' ELSE c_mktsegment END AS Room_Name,
 CASE WHEN c_custkey % 3 = 0 THEN '15/01/2018' ELSE '2024-01-15' END AS Enrolment_Start_Date,
 CASE c_custkey % 9 WHEN 0 THEN 'victoria' WHEN 1 THEN 'N.S.W.' WHEN 2 THEN 'qld' WHEN 3 THEN 'QLD' WHEN 4 THEN ' Vic ' WHEN 5 THEN 'zzz'
   WHEN 6 THEN '' WHEN 7 THEN 'SA' ELSE 'tassie' END AS State,
 CASE WHEN c_custkey % 8 = 0 THEN '30x0' ELSE '3000' END AS PostCode,
 'Par' || CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING) AS Parent1_First_Name, 'Fam' || CAST(c_custkey % 97 - c_custkey % 2 AS STRING) AS Parent1_Last_Name,
 '1985-04-04' AS Parent1_DOB,
 lpad(CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING), 9, '9') || 'B' AS Parent1_CRN,
 CASE WHEN c_custkey % 10 = 1 THEN 'P' || CAST(c_custkey AS STRING) ELSE 'P' || CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING) END AS Parent1_Legacy_Account_ID,
 CASE WHEN c_custkey % 19 = 0 THEN 'not-an-email' ELSE 'p' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING) || '@example.com' END AS Parent1_Email,
 CASE c_custkey % 3 WHEN 0 THEN '0412 345 678' WHEN 1 THEN '412345678' ELSE '12-34' END AS Parent1_Contact_Mobile,
 CASE WHEN c_custkey % 5 = 0 THEN 'p' || CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS STRING) || '@example.com' ELSE 'q' || CAST(c_custkey AS STRING) || '@example.com' END AS Parent2_Email,
 CASE WHEN c_custkey % 4 = 0 THEN 'q' || CAST(c_custkey AS STRING) || '@example.com' ELSE 'e' || CAST(c_custkey AS STRING) || '@example.com' END AS EmergencyContact1_Email,
 CASE WHEN c_custkey % 4 = 0 THEN 'Par' || CAST(CAST(floor((c_custkey + 2) / 2) AS BIGINT) AS STRING) ELSE '' END AS Parent2_First_Name,
 CASE WHEN c_custkey % 4 = 0 THEN 'Fam' || CAST((c_custkey + 2) % 97 - c_custkey % 2 AS STRING) ELSE '' END AS Parent2_Last_Name,
 CASE WHEN c_custkey % 4 = 0 THEN '1985-04-04' ELSE '' END AS Parent2_DOB,
 CASE WHEN c_custkey % 4 = 0 THEN 'Q' || CAST(c_custkey AS STRING) ELSE '' END AS Parent2_Legacy_Account_ID,
 CASE WHEN c_custkey % 4 = 0 THEN '(04)12345678' ELSE '' END AS Parent2_Contact_Mobile,
 'E' || CAST(c_custkey AS STRING) || '@example.com' AS EmergencyContact2_Email,
 CASE c_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'FALSE' WHEN 2 THEN 'maybe' ELSE '1' END AS EmergencyContact1_Emergency_Contact,
 CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'yes' END AS Consents_Photos_Videos
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
    "fx_bookings": """
SELECT CAST(o_orderkey AS BIGINT) AS src_row, CAST(c_nationkey + 100 AS STRING) AS service_legacy_id, CAST(o_custkey AS STRING) AS child_legacy_id,
 lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)
   || CASE WHEN o_orderkey % 3 = 0 THEN ' 12:00:00 AM' ELSE '' END AS start_date,
 CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) + 1 + o_orderkey % 3 AS STRING) END AS end_date,
 o_orderpriority AS fee_name, CASE WHEN o_orderkey % 2 = 0 THEN 'Koala''s Room' ELSE 'koala?s  room' END AS room_name,
 CASE o_orderkey % 5 WHEN 0 THEN 'Single' WHEN 1 THEN 'Fortnightly' ELSE 'Weekly' END AS frequency,
 CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS mon1, CASE WHEN o_orderkey % 3 = 0 THEN '1.0' ELSE '' END AS tue1,
 CASE WHEN o_orderkey % 5 > 1 THEN '1' ELSE 'x' END AS wed1, '1' AS fri1, CASE WHEN o_orderkey % 7 = 0 THEN '1' ELSE '' END AS mon2
FROM orders JOIN customer ON o_custkey = c_custkey
""",
    "fx_bookings_dup": """
SELECT * FROM fx_bookings
UNION ALL
SELECT src_row + 10000000 AS src_row, service_legacy_id, child_legacy_id, start_date, end_date, fee_name, room_name, frequency, mon1, tue1, wed1, fri1, mon2
FROM fx_bookings WHERE src_row % 50 = 0
""",
    "fx_payment_plans": """
SELECT CAST(o_orderkey + 2 AS BIGINT) AS row_num, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(c_nationkey + 100 AS STRING) END AS service_id,
 'src ' || lower(n_name) AS service_name, 'P' || CAST(o_custkey AS STRING) AS parent_id, CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE 'Par' END AS parent_fn, 'Fam ' AS parent_ln,
 CAST(o_orderkey AS STRING) AS child_id,
 CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'soon' WHEN 2 THEN CAST(year(o_orderdate) AS STRING) || '-' || CAST(month(o_orderdate) AS STRING) || '-' || CAST(day(o_orderdate) AS STRING)
   WHEN 3 THEN '12/25/' || CAST(year(o_orderdate) AS STRING) || ' 01:30 PM' WHEN 4 THEN '3/4/70' ELSE '03/04/' || CAST(year(o_orderdate) AS STRING) END AS start_date,
 CASE o_orderkey % 5 WHEN 0 THEN 'Monday' WHEN 1 THEN 'SAT' WHEN 2 THEN '' WHEN 3 THEN 'someday' ELSE 'Fri' END AS weekday,
 CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'TRUE' ELSE 'No' END AS manual,
 CASE o_orderkey % 7 WHEN 0 THEN 'Daily' WHEN 1 THEN '' ELSE 'Weekly' END AS cycle,
 CASE o_orderkey % 8 WHEN 0 THEN '-5' WHEN 1 THEN 'abc' WHEN 2 THEN '' ELSE '100.50' END AS dd_limit,
 CASE o_orderkey % 9 WHEN 0 THEN '-1' WHEN 1 THEN '20' ELSE '' END AS fixed_amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""",
    "fx_balances": """
SELECT CAST(c_custkey AS BIGINT) AS src_row, n_name || CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE '' END AS centre_name,
 CASE c_custkey % 12 WHEN 0 THEN 'Demo Parent, X' WHEN 1 THEN 'Solo' WHEN 2 THEN '' ELSE 'Fam' || CAST(c_custkey % 30 AS STRING) || ', Par' || CAST(c_custkey % 4 AS STRING) END AS account_name,
 CASE c_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN '$0.00' WHEN 2 THEN 'n/a' WHEN 3 THEN '-$1,234.56' ELSE '$' || CAST(c_custkey AS STRING) || '.25' END AS amount_due
FROM customer JOIN nation ON c_nationkey = n_nationkey
""",
    "fx_fee_catalog": """
SELECT DISTINCT CAST(500000 + p_size % 25 AS STRING) AS service_id, p_type || ' ' || p_brand AS fee_name FROM part WHERE p_partkey % 3 <> 0
""",
    "fx_name_usage": """
SELECT DISTINCT CAST(p_size % 25 + 100 AS STRING) AS service_legacy_id, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) || ' ' || p_brand ELSE p_type || ' ' || p_brand END AS fee_name FROM part
""",
    "fx_room_catalog": """
SELECT DISTINCT n_name AS centre_name, p_brand AS room_name FROM part JOIN nation ON p_size % 25 = n_nationkey WHERE p_partkey % 3 <> 0
""",
    "fx_room_usage": """
SELECT DISTINCT CAST(p_size % 25 + 100 AS STRING) AS service_legacy_id, CASE WHEN p_partkey % 5 = 0 THEN 'The ' || p_brand || ' Room' ELSE p_brand END AS room_name FROM part
""",
    "fx_families_more": """
SELECT CAST(c_custkey + 2 AS BIGINT) AS row_num, 'Kid' || CAST(c_custkey AS STRING) AS Child_First_Name,
 CASE WHEN c_custkey % 3 = 0 THEN 'Con' ELSE '' END AS EmergencyContact1_First_Name, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Tact' END AS EmergencyContact1_Last_Name,
 CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'E1' END AS EmergencyContact1_LegacyID,
 CASE c_custkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' WHEN 2 THEN '' ELSE 'Female' END AS Gender,
 CASE c_custkey % 5 WHEN 0 THEN 'Non-Binary' WHEN 1 THEN 'non-binary' WHEN 2 THEN 'Trans Male' ELSE '' END AS Gender_Identity,
 CASE c_custkey % 7 WHEN 0 THEN '2031-01-01' WHEN 1 THEN '31/12/2030' ELSE '2020-02-29' END AS DOB,
 CASE c_custkey % 8 WHEN 0 THEN '1234 567' WHEN 1 THEN '' ELSE CAST(c_custkey AS STRING) END AS Medicare_Number,
 CASE WHEN c_custkey % 10 = 0 THEN repeat('s', 201) ELSE repeat('s', 200) END AS School,
 CASE WHEN c_custkey % 11 = 0 THEN repeat(' ', 51) ELSE '' END AS Parent1_Gender
FROM customer
""",
    "fx_second_parents": """
SELECT row_num, Status, CASE WHEN c % 4 = 0 THEN '' ELSE one END AS Parent1_CRN, CASE WHEN c % 3 = 0 THEN ' ' ELSE 'p' || CAST(c AS STRING) || '@example.com' END AS Parent1_Email,
 CASE WHEN c % 5 = 0 THEN '' ELSE 'P' || CAST(c AS STRING) END AS Parent1_Legacy_Account_ID, two AS Parent2_CRN,
 CASE WHEN c % 7 = 0 THEN '' ELSE 'q' || CAST(CAST(floor(c / 3) AS BIGINT) AS STRING) || '@Example.com' END AS Parent2_Email,
 CASE c % 6 WHEN 0 THEN '' WHEN 1 THEN one WHEN 2 THEN two WHEN 3 THEN lower(two) WHEN 4 THEN '  ' ELSE '123456789Z' END AS Enrolment_Parent_CRN
FROM (SELECT CAST(c_custkey + 2 AS BIGINT) AS row_num, c_custkey AS c, CASE c_custkey % 10 WHEN 0 THEN 'Waitlist' WHEN 1 THEN 'waitlist ' ELSE 'Active' END AS Status,
 lpad(CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING), 9, '9') || 'B' AS one, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE lpad(CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING), 9, '8') || 'C' END AS two FROM customer)
""",
    "fx_dates": """
SELECT CAST(o_orderkey AS BIGINT) AS src_row, CASE o_orderkey % 8
 WHEN 0 THEN CAST(y AS STRING) || '/' || CAST(m AS STRING) || '/' || CAST(d AS STRING)
 WHEN 1 THEN CAST(d AS STRING) || ' ' || substr('JanFebMarAprMayJunJulAugSepOctNovDec', m * 3 - 2, 3) || ' ' || CAST(y AS STRING)
 WHEN 2 THEN CAST(d AS STRING) || '.' || CAST(m AS STRING) || '.' || CAST(y AS STRING) || ' 13:05'
 WHEN 3 THEN CAST(d AS STRING) || '-' || upper(substr('JanFebMarAprMayJunJulAugSepOctNovDec', m * 3 - 2, 3)) || '-' || CAST(y AS STRING)
 WHEN 4 THEN CAST(d AS STRING) || '-' || CAST(m AS STRING) || '-' || CAST(y AS STRING)
 WHEN 5 THEN CAST(y AS STRING) || '-' || lpad(CAST(m AS STRING), 2, '0') || '-' || lpad(CAST(d AS STRING), 2, '0') || ' 00:00:00'
 WHEN 6 THEN 'week ' || CAST(d AS STRING) ELSE CAST(d AS STRING) || '/' || CAST(m AS STRING) || '/' || CAST(y AS STRING) || ' 1:05:09 PM' END AS written, o_orderdate AS meant
FROM (SELECT o_orderkey, o_orderdate, CAST(day(o_orderdate) AS INT) AS d, CAST(month(o_orderdate) AS INT) AS m, CAST(year(o_orderdate) AS INT) AS y FROM orders)
""",
    "fx_odd_names": """
SELECT DISTINCT '  ' || p_brand || '/:' || p_type || CASE WHEN p_partkey % 3 = 0 THEN ' o''x  Cafe_ ' ELSE '?* ' END AS name FROM part
""",
    "fx_source_services": """
SELECT n_nationkey AS dbid, CAST(n_nationkey + 100 AS STRING) AS service_id, 'SRC ' || n_name AS name FROM nation
""",
}


def needed(sql: str) -> list[str]:
    """The views that a text names, directly or through views, in an order that defines each before its use."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found += [x for x in needed(VIEWS[name]) if x not in found]
            if name not in found:
                found.append(name)
    return found


def with_views(sql: str) -> str:
    """`sql`, a list of CTEs and a SELECT, with the views that it needs as first CTEs."""
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needed(sql))
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH"):
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
        return f"WITH {recursive}{ctes},\n{rest}"
    return f"WITH {ctes}\n{body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its tables are read from `sf_dir`."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for v in needed(VIEWS[name]):
        spark.sql(VIEWS[v]).createOrReplaceTempView(v)
    return spark.sql(VIEWS[name])
