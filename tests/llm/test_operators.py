"""Operators of the subpackage: brute force, round trips, held-out accuracy, and hard cases on small tables."""

import gzip
import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, flac, langid, linededup, mixing, neardup, pii, queries, urlfilter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows):
    return sorted(tuple("" if x is None else f"{x:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(expected)


def hard(spark):
    """Nulls in every column, empty and repeated rows, and columns with clashing names."""
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "x " * 40, None, None, None), (4, "a b c d e f g h i j k l " * 3000, "en", "b", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("hits", "items", "n_words", "size", "target", "taken", "score", "cost", "media", "blocks", "base", "spans", "n_lines", "n_dropped", "key", "node", "order", "bucket")})


def test_hard_tables(spark):
    docs = hard(spark)
    items = spark.createDataFrame([(7, "One, two!"), (7, "One, two!"), (None, "a b c d e f g h i j"), (8, None), (9, "...")], "item_id long, text string")
    got = {(r.doc_id, r.n_words, len(r.hits), tuple(r["items"])) for r in decontaminate.mark_overlaps(docs, items).collect()}
    assert got == {(1, 0, 0, ()), (2, 0, 0, ()), (3, 2, 1, ("7",)), (None, 40, 0, ()), (4, 36000, 3000, ())}
    assert {r.doc_id for r in linededup.drop_boilerplate(docs).where("n_dropped = 0").collect()} == {1, 2, 3, 4, None}
    comps = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()]
    assert sorted(comps, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 1, None), (4, 12, 4)], key=str)
    mixed = mixing.mix_sources(docs).collect()
    assert len(mixed) == 6 and all(0 <= r.taken <= 2 * r["size"] for r in mixed)
    told = langid.identify_language(docs, train=F.lit(True)).collect()
    assert {(r.doc_id, r.lang_pred) for r in told if r.doc_id in (1, 2)} == {(1, "und"), (2, "und")}
    assert all(r.spans == [] for r in pii.find_personal_data(docs).collect())


def test_names_of_temporary_columns(spark):
    """Input columns with any name that an operator makes for itself or returns pass through or are replaced."""
    names = [f"_{n}" for n in ("site", "digests", "lines", "own", "hits", "kept", "key", "base", "spans", "email", "ip", "card", "phone", "best", "row", "id", "text", "source", "idx", "at")]
    docs = spark.createDataFrame([(1, "Mail a@b.cd now\nx", "en", "a", 3), (2, "x", None, None, 1)], DOCS).withColumns({n: F.lit(f"own {n}") for n in names})
    pages = docs.withColumn("url", F.lit("http://a.net/x"))
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    for out in (linededup.drop_boilerplate(docs), pii.find_personal_data(docs), mixing.mix_sources(docs), urlfilter.judge_urls(pages, rules)):
        assert all(r[n] == f"own {n}" for r in out.collect() for n in names)
    assert [len(r.spans) for r in pii.find_personal_data(docs).orderBy("doc_id").collect()] == [1, 0]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert decontaminate.mark_overlaps(docs, items).count() == linededup.drop_boilerplate(docs).count() == neardup.near_duplicates(docs).count() == mixing.mix_sources(docs).count() == 0
    assert langid.identify_language(docs, train=F.lit(True)).count() == pii.find_personal_data(docs).count() == 0
    assert warc.resolve_revisits(warc.read_archives(warc.write_archives(warc.mark_revisits(pages)))).count() == urlfilter.judge_urls(pages, rules).count() == 0
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(rows, vocabulary=queries.VOCABULARY).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/x", None)], "page_id long, url string, html string")
    assert urlfilter.judge_urls(one, rules).first().verdict == "allow"


def test_wu_manber_against_brute_force(spark):
    rng = random.Random(5)
    words = [b"w%d" % i for i in range(4)]
    patterns = {b" ".join(rng.choices(words, k=k)): [k] for k in (1, 2, 3, 5, 9) for _ in range(6)}
    find = decontaminate.WuManber(patterns).search
    for _ in range(50):
        text = rng.choices(words + [b"z"], k=60)
        want = {(i, i + len(p), p) for t in patterns for p in [tuple(t.split())] for i in range(61 - len(p)) if tuple(text[i : i + len(p)]) == p}
        assert {(a, b, tuple(text[a:b])) for a, b, _ in find(text)} == want


def test_pattern_blocks_give_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = (decontaminate.mark_overlaps(docs, items, block=b).select("doc_id", "n_words", "hits", "items") for b in (100_000, 400))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def base_by_hand(text):
    luhn = lambda d: sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = ["a@b.c_d@e.f.g x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.4 99999999999999999999.1.1.1", "é 4111 1111-1111 1111 4111111111111112", "+1 (988) 555-2485 +12 +123456789012345678 ++49 30 1234567", "\U0001f600 a.b+c@d-e.example.org, 10.0.0.255.", "x" * 30000, "1" * 30000, "1 " * 20000, "@.@.", "a" * 20000 + "@"]


def test_base_spans_against_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate([*TRICKY, *texts.values(), None])]
    got = pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.span_text(F.col("base")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: base_by_hand(t or "") for i, t in rows}


def spans_by_hand(texts, min_score=0.6, min_known=3):
    """Base and discovered spans of each text, by plain loops over all contexts."""
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    find = lambda p, t: re.finditer(p, t, re.A)
    seen, base = [], {}
    for i, t in texts.items():
        base[i] = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base_by_hand(t).split(",") if s)]
        free = {(m.start(), m.end()) for p in (pii.TOKEN, pii.RUN) for m in find(p, t)}
        free = {(a, b) for a, b in free if all(b <= x or y <= a for _, x, y in base[i])}
        for kind, a, b in base[i] + [(None, a, b) for a, b in free]:
            value = re.sub(r"""^[(\[{<"']+|[.,;:!?)\]}>"']+$""", "", lower(t[a:b]))
            if not kind and not any(re.search(f, value, re.A) for f in pii.FORMS.values()):
                continue
            before = re.split(r"\s+", re.sub(r"""[(\[{<"']+$""", "", lower(t[:a])), flags=re.A)
            behind = re.split(r"\s+", re.sub(r"""^[.,;:!?)\]}>"']+""", "", lower(t[b:])), flags=re.A)
            before, behind = [w for w in before if w], [w for w in behind if w]
            contexts = [("2", *before[-2:])] if len(before) > 1 else []
            contexts += [("1", w) for w in before[-1:]] + [(">", w) for w in behind[:1]]
            seen += [(i, kind, a, b, value, c) for c in contexts]
    members, seeds = defaultdict(set), {(v, k) for _, k, _, _, v, _ in seen if k}
    for *_, v, c in seen:
        members[c].add(v)
    known, strong, found, last = {x: 1.0 for x in seeds}, set(), {}, None
    while True:
        score = {}
        for c, vs in members.items():
            for k in pii.KINDS:
                have = [known[v, k] for v in vs if (v, k) in known]
                if len(have) >= min_known and sum(have) / len(vs) >= min_score:
                    score[c, k] = sum(have) / len(vs)
        rest = defaultdict(lambda: 1.0)
        for (c, k), s in score.items():
            for v in members[c]:
                if (v, k) not in seeds and re.search(pii.FORMS[k], v, re.A):
                    rest[v, k] *= 1 - min(s, 0.999)
        strong, found = set(score), {x: 1 - r for x, r in rest.items() if 1 - r >= min_score}
        now = (len(found), round(sum(found.values()), 9))
        if now == last or not found:
            break
        last, known = now, {x: 1.0 for x in seeds} | found
    best = {}
    for (v, k), s in found.items():
        best[v] = max(best.get(v, (0.0, "")), (s, k))
    out = {i: set(b) for i, b in base.items()}
    more = defaultdict(set)
    for i, kind, a, b, v, c in seen:
        if not kind and v in best and (c, best[v][1]) in strong:
            more[i].add((a - b, best[v][1], a, b))
    for i, spans in more.items():
        kept = []
        for _, k, a, b in sorted(spans):
            if all(b <= x or y <= a for _, x, y in kept):
                kept.append((k, a, b))
        out[i] |= set(kept)
    return out


def test_all_spans_against_brute_force(spark, texts):
    """The given documents, and made ones in which labels, seeds and other numbers mix."""
    rng = random.Random(21)
    words = ["call", "the", "(see", "id", "to", "on"]
    seeds = {"Desk:": lambda: f"+1 (555) 55{rng.randrange(10)}-01{rng.randrange(100):02d}", "mail": lambda: f"u{rng.randrange(40)}@x{rng.randrange(2)}.org", "Card": lambda: "4111 1111 1111 1111", "host": lambda: f"10.0.{rng.randrange(9)}.{rng.randrange(250)}"}
    others = {"Desk:": lambda: rng.choice([f"555-0{rng.randrange(5)}99-23", f"555 0{rng.randrange(5)} 22 33"]), "mail": lambda: f"who{rng.randrange(3)}@home", "Card": lambda: f"4111-1111-1111-111{rng.randrange(3)}", "host": lambda: f"fe80:0:0:{rng.randrange(4)}"}
    made = {}
    for i in range(1500):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            label = rng.choice([*seeds])
            kind = rng.random()
            parts += rng.choices(words, k=rng.randrange(0, 3))
            # A label before seeds and others, a second label before others only, or no label at all.
            parts += [label, seeds[label]()] if kind < 0.6 else [label, others[label]()] if kind < 0.7 else ["second", label[0] + "x", others[label]()] if kind < 0.8 else [f"{rng.randrange(10**6)}{rng.choice(['', '.', ')', '@'])}"]
        made[10_000 + i] = " ".join(parts)
    for rows in (made, texts):
        got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans} for r in pii.find_personal_data(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
        want = spans_by_hand(rows)
        assert got == want
        if rows is made:
            assert sum(map(len, want.values())) > sum(base_by_hand(t).count(":") // 2 for t in rows.values())


def test_bootstrapping_finds_what_the_patterns_miss(spark):
    seeds = [(i, f"Please call me at +1 (555) 555-01{i:02d} today.") for i in range(6)]
    rows = [*seeds, (10, "Please call me at 555-0199-23 now."), (11, "It cost 555-0199-23 then."), (12, "the year 12345 call me")]
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(k == "phone" for i, _ in seeds for k, _ in got[i]) and all(got[i] for i, _ in seeds)
    assert [k for k, _ in got[10]] == ["phone"] and got[12] == []
    assert got[11] == []  # the same digits in a context that no seed has


def test_a_value_in_many_confident_contexts_is_no_seed(spark):
    """Twenty patterns of score 50/51 round the score of the number that all of them have to 1."""
    seeds = [(100 * c + i, f"dial line{c} desk{c} +1 (555) 5{c:02d}-01{i:02d} today") for c in range(20) for i in range(50)]
    rows = seeds + [(9000 + c, f"dial line{c} desk{c} 555-0199-23 today") for c in range(20)]
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[9000 + c] == [("phone", "555-0199-23")] for c in range(20)) and all(len(got[i]) == 1 for i, _ in seeds)


def test_instances_that_were_found_induce_new_patterns(spark):
    """Values found in the seeds' context make a context without seeds confident, in which a new value is found."""
    seeds = [(i, f"Please ring Desk: +1 (555) 555-01{i:02d} today.") for i in range(12)]
    both = [f"555-0{i}99-23" for i in range(5)]
    rows = seeds + [(100 + i, f"Please ring Desk: {v} now.") for i, v in enumerate(both)]
    rows += [(200 + i, f"Extension kept here {v} for you.") for i, v in enumerate(both)] + [(300, "Extension kept here 555-0777-41 for you."), (301, "They sold 555-0888-42 of them.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda rounds: {r.doc_id for r in pii.find_personal_data(docs, rounds=rounds).collect() if r.spans and r.doc_id >= 100}
    assert found(1) == {100 + i for i in range(5)}
    assert found(6) == found(None) == {100 + i for i in range(5)} | {200 + i for i in range(5)} | {300}


def test_chains_of_contexts_are_followed_to_their_end(spark):
    """Eleven contexts, each confident by the values of the one before, as its own two new values are few."""
    rows = [(i, f"Please ring Desk: +1 (555) 555-01{i:02d} today.") for i in range(12)]
    values = [[f"555-{k:02d}{i:02d}-77" for i in range(5)] for k in range(12)]
    rows += [(100 + i, f"Please ring Desk: {v} now.") for i, v in enumerate(values[0])]
    for k in range(11):
        rows += [(1000 * (k + 1) + i, f"Alpha{k} beta{k} {v} gone.") for i, v in enumerate(values[k] + values[k + 1][:2])]
        rows += [(1000 * (k + 1) + 500 + i, f"Delta{k} gamma{k} {v} gone.") for i, v in enumerate(values[k + 1][:2] * 2 + values[k][:3] + values[k + 1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in pii.find_personal_data(docs).collect() if r.spans} == {i for i, s in spans_by_hand(dict(rows)).items() if s} and len(rows) > 150


def test_contexts_of_very_long_words(spark):
    for n in (70, 3000):
        label = "w" * n
        rows = [(i, f"the {label} +1 (555) 555-01{i:02d} here") for i in range(5)] + [(9, f"the {label} 555-0199-23 there"), (10, f"the v{label} 555-0188-23 there")]
        got = {r.doc_id: len(r.spans) for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {**{i: 1 for i in range(5)}, 9: 1, 10: 0}


def test_identifiers_with_spaces_and_one_word_contexts(spark):
    """Numbers in spaced groups, a label after changing words or at the start of the text, and a word behind."""
    seeds = [(i, f"{w} Phone: +1 (555) 555-01{i:02d} applies") for i, w in enumerate(["new", "old", "our", "his", "her", "my"])]
    seeds += [(20 + i, f"{w} card 4111 1111 1111 1111 charged") for i, w in enumerate("abc")]
    seeds += [(30 + i, f"{w} card {d} charged") for i, (w, d) in enumerate(zip("def", ["5500 0000 0000 0004", "4012 8888 8888 1881", "6011 0000 0000 0004"]))]
    rows = [(100, "their Phone: (555) 555 0199 rings"), (101, "Phone: 555 0188 22 rings"), (102, "555 0177 33 applies"), (103, "a card 4111 1111 1111 1112 was"), (104, "it grew (555) 555 0166 then"), (105, "Phone: (555) and more")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_personal_data(spark.createDataFrame(seeds + rows, "doc_id long, text string")).collect()}
    assert all(len(got[i]) == 1 for i, _ in seeds)
    assert [got[i] for i in range(100, 106)] == [[("phone", 13, 27)], [("phone", 7, 18)], [("phone", 0, 11)], [("card", 7, 26)], [], []]


def test_an_archive_inside_a_payload_is_not_entered():
    """A payload that gzip stores uncompressed holds a whole archive; ranges may begin inside it."""
    rng = random.Random(7)

    def member(record, level):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        return z.compress(record) + z.flush()

    inner = b"".join(member(warc.build_record(1000 + i, "http://inner", rng.randbytes(rng.randrange(50, 900)), "d", None), 6) for i in range(12))
    for tail in (b"", rng.randbytes(500)):
        payloads = [rng.randbytes(200), inner + tail, b"x" * 5000, inner, b""]
        data = io.BytesIO(b"".join(member(warc.build_record(i, "http://x", p, "d", None), 0) for i, p in enumerate(payloads)))
        size = len(data.getvalue())
        inside = size  # one range to the end, then ranges whose borders fall anywhere
        for step in (inside, size // 2 + 1, size // 3 + 1):
            got = [warc.parse_record(d)[0] for a in range(0, size, step) for d in warc.records_from(data, a, min(a + step, size))]
            assert got == [0, 1, 2, 3, 4]


def test_archives_inside_payloads_at_any_range(spark):
    """An archive knows its own records by its id, however gzip stored a payload and wherever ranges begin."""
    rng = random.Random(11)

    def archive(info, payloads, level):
        out = b""
        for record in [warc.build_info(info)] + [warc.build_record(i, "http://x/" + "u" * (i % 3 * 700), p, "d", None, info) for i, p in enumerate(payloads)]:
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            out += z.compress(record) + z.flush()
        return out

    inner = archive("<urn:uuid:inner>", [rng.randbytes(rng.randrange(50, 900)) for _ in range(12)], 6)
    payloads = [rng.randbytes(200), inner, b"x" * 5000, inner + rng.randbytes(500), b"", archive("<urn:uuid:nested>", [inner], 0)]
    for level in (0, 6):
        data = archive("<urn:uuid:outer>", payloads, level)
        for step in (37, 500, 1500, 4000, 9000, len(data)):
            got = [warc.parse_record(d) for a in range(0, len(data), step) for d in warc.records_from(io.BytesIO(data), a, min(a + step, len(data)), "<urn:uuid:outer>")]
            assert [r[0] for r in got if r[2] == "response"] == list(range(6)) and [r[6] for r in got[1:]] == payloads and got[0][2] == "warcinfo"
    # Through Spark: pages that are the text of archives, stored as they are.
    pages = spark.createDataFrame([(i, "http://x", inner.decode("latin-1")) for i in range(3)] + [(3, "http://x", "plain")], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(warc.mark_revisits(pages), level=0)
    for size in (1000, 4000, 1 << 22):
        read = warc.read_archives(manifest, split_bytes=size).orderBy("page_id").collect()
        assert [(r.page_id, r.record_type, r.refers_to) for r in read] == [(0, "response", None), (1, "revisit", 0), (2, "revisit", 0), (3, "response", None)]
    assert warc.read_archives(manifest.drop("info")).count() == 4 and manifest.agg({"records": "sum"}).first()[0] == 4


def test_warc_ranges_of_any_size(spark, tmp_path):
    rng = random.Random(1)
    data, want = io.BytesIO(), []
    for i in range(30):
        payload = bytes(rng.randbytes(rng.randrange(0, 3000))) + warc.MAGIC + b"\x00" * 20
        record = warc.build_record(i, "http://x/\n", payload, "d", None)
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        data.write(z.compress(record) + z.flush())
        want.append((i, payload))
    size = data.tell()
    for step in (1, 37, 1000, 10**6):
        got = []
        for a in range(0, size, step):
            got += [(r[0], r[6]) for r in map(warc.parse_record, warc.records_from(data, a, min(a + step, size)))]
        assert got == want
    assert gzip.decompress(data.getvalue()).count(b"WARC/1.1") == 30


def test_warc_cases(spark):
    body = "p" * 100
    rows = [(5, "http://a", body), (3, None, body), (3, "u", body), (None, "http://n", body), (9, "x", None), (8, "x", ""), (7, "x", "q" * 99), (6, "x", "q" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    read = warc.resolve_revisits(warc.read_archives(warc.write_archives(warc.mark_revisits(pages)), split_bytes=64)).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in read), key=str)
    want = [(5, "revisit", 3, 100), (3, "response", None, 100), (3, "response", None, 100), (None, "revisit", 3, 100), (9, "response", None, 0), (8, "response", None, 0), (7, "response", None, 99), (6, "response", None, 99)]
    assert got == sorted(want, key=str)
    assert {r.payload_digest for r in read if r.payload_bytes == 100} == {hashlib.sha256(body.encode()).hexdigest()}


def test_chat_round_trip(spark):
    odd = ["", "\\", "<turn assistant>\n", "\n</turn>\n", "ends with \\", "é漢\U0001f600 \n\n ", "\n\nlead", "a.", "\\<\\>"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(odd)] + [(2, 0, None, None), (None, None, "assistant", "x"), (None, 1, "a>b", "<y>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(df.withColumns({"formatted": F.lit("clash"), "turns": F.lit("clash")}), vocabulary=queries.VOCABULARY)
    read = lambda f: {r.conv_id: r for r in chat.read_chats(f, vocabulary=queries.VOCABULARY).collect()}
    out = read(formatted)
    assert [(t.role, t.text) for t in out[1].turns] == [r[2:] for r in rows[: len(odd)]]
    assert out[1].loss_text == "".join(t for i, t in enumerate(odd) if i % 2)
    assert [(t.role, t.text) for t in out[2].turns] == [("", "")] and [(t.role, t.text) for t in out[None].turns] == [("assistant", "x"), ("a>b", "<y>")]
    assert len(out[1].loss_mask) == len(out[1].token_ids) and sum(out[1].loss_mask) > 0
    # What is read back comes from the tokens and their mask: without the mask there is no loss, with other tokens no result.
    blind = formatted.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.lit(0).cast("byte")))
    assert {r.loss_text for r in read(blind).values()} == {""} and read(blind)[1].turns == out[1].turns
    with pytest.raises(Exception, match="do not give"):
        read(formatted.withColumn("token_ids", F.reverse("token_ids")))


def test_chat_of_very_long_texts(spark):
    rows = [(1, 0, "user", "<" * 300_000), (1, 1, "assistant", "a é\\ " * 100_000)]
    (r,) = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), vocabulary=queries.VOCABULARY), vocabulary=queries.VOCABULARY).collect()
    assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in rows] and r.loss_text == rows[1][3]


def test_flac_round_trip_and_damage(texts):
    rng = random.Random(2)
    payloads = [t.encode() for t in texts.values()][:60] + [b"", b"\0" * 64, rng.randbytes(5000), bytes(range(256)) * 40, b"\xff\xf8\x70\x02" * 3000, b"ab" * 1024]
    streams = flac.encode(payloads)
    blocks = flac.decode(streams)
    assert [b"".join(pcm for _, _, pcm in b) for b in blocks] == payloads
    assert all(a == i * flac.FRAME and n == len(pcm) for b in blocks for i, (a, n, pcm) in enumerate(b))
    assert {len(s) < len(p) for s, p in zip(streams, payloads) if len(p) > 4000} >= {True}
    hurt = bytearray(streams[-4])
    hurt[60] ^= 4
    assert [pcm is None for _, _, pcm in flac.decode([bytes(hurt)])[0]][:2] == [True, False]
    assert flac.decode([None, b"", b"RIFF", os.urandom(100)]) == [[], [], [], []]


def _plain_flac(stream: bytes) -> bytes:
    """A decoder of its own, bit by bit from the published format: the samples as unsigned bytes; all checks are made."""
    bits, at = format(int.from_bytes(stream, "big"), f"0{8 * len(stream)}b"), 0

    def take(n, signed=False):
        nonlocal at
        assert at + n <= len(bits)
        value, at = int("0" + bits[at : at + n], 2), at + n
        return value - (1 << n) if signed and n and value >> (n - 1) else value

    def crc(data, poly, width):
        c = 0
        for byte in data:
            c ^= byte << (width - 8)
            for _ in range(8):
                c = (c << 1 ^ (poly if c >> (width - 1) else 0)) & ((1 << width) - 1)
        return c

    def residuals(block, order):
        nonlocal at
        method, parts = take(2), 1 << take(4)
        out = []
        for p in range(parts):
            width, n = (4, 5)[method], block // parts - (order if p == 0 else 0)
            if (rice := take(width)) == (1 << width) - 1:
                raw = take(5)
                out += [take(raw, True) for _ in range(n)]
                continue
            for _ in range(n):
                one = bits.index("1", at)
                high, at = one - at, one + 1
                folded = high << rice | take(rice)
                out.append(folded >> 1 ^ -(folded & 1))
        return out

    assert take(32) == int.from_bytes(b"fLaC", "big")
    last = 0
    while not last:
        last, kind, length = take(1), take(7), take(24)
        if kind == 0:
            at += 80
            _, channels, size, total, md5 = take(20), take(3) + 1, take(5) + 1, take(36), take(128)
        else:
            at += 8 * length
    assert (channels, size) == (1, 8)
    samples = []
    while at < len(bits):
        start = at // 8
        assert take(14) == 0x3FFE and take(1) == 0
        take(1)
        block, rate = take(4), take(4)
        assert take(4) == 0 and take(3) in (0, 1) and take(1) == 0
        number = take(8)
        for _ in range(max(0, format(number, "08b").index("0") - 1)):
            assert take(2) == 2
            take(6)
        block = {1: 192, 6: None, 7: None}.get(block, 576 << (block - 2) if block < 6 else 256 << (block - 8 if block > 7 else 0)) or take({6: 8, 7: 16}[block]) + 1
        assert rate < 12 and take(8) == crc(stream[start : at // 8 - 1], 0x07, 8)
        assert take(1) == 0
        kind, wasted = take(6), take(1)
        assert wasted == 0
        if kind == 0:
            frame = [take(8, True)] * block
        elif kind == 1:
            frame = [take(8, True) for _ in range(block)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            frame = [take(8, True) for _ in range(order)]
            if kind < 32:
                shift, factors = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
            else:
                precision, shift = take(4) + 1, take(5, True)
                factors = [take(precision, True) for _ in range(order)]
            for r in residuals(block, order):
                frame.append(r + (sum(f * frame[-1 - i] for i, f in enumerate(factors)) >> shift))
        at += -at % 8
        assert take(16) == crc(stream[start : at // 8 - 2], 0x8005, 16)
        samples += frame
    assert len(samples) == total
    out = bytes(s & 0xFF for s in samples)
    assert int.from_bytes(hashlib.md5(out).digest(), "big") == md5
    return bytes(s + 128 for s in samples)


def test_flac_streams_by_a_plain_decoder(texts):
    """What is stored is a stream of the published format: a decoder that shares no code with the writer gives the payload."""
    rng = random.Random(5)
    ramp, wave = bytes(i // 8 % 256 for i in range(3000)), bytes(int(128 + 100 * math.sin(i / 9)) for i in range(5000))
    payloads = [b"", b"a", b"\0" * 64, b"\xff" * 2048, rng.randbytes(2500), ramp, wave, bytes(rng.choice(b"ab ") for _ in range(1500)), b"x y" * 50_000]
    payloads += [(t or "").encode() for t in list(texts.values())[:40]]
    for payload, stream in zip(payloads, flac.encode(payloads)):
        assert _plain_flac(stream) == payload


def test_flac_goes_on_after_damaged_headers():
    rng = random.Random(8)
    for payload in (rng.randbytes(5000), bytes(int(60 * math.sin(i / 9)) + 128 for i in range(5000)), b"a" * 5000):
        stream = flac.encode([payload])[0]
        starts = [a for _, _, a, _, _ in flac.find_frames(stream)]
        assert len(starts) == 5
        for n, a in enumerate(starts):
            for byte in (0, 4, 7):  # sync code, number, checksum
                hurt = bytearray(stream)
                hurt[a + byte] ^= 1
                got = flac.decode([bytes(hurt)])[0]
                assert [b[:2] for b in got] == [(i * 1024, min(1024, 5000 - i * 1024)) for i in range(5)]
                assert [b[2] for b in got] == [None if i == n else payload[i * 1024 : (i + 1) * 1024] for i in range(5)]
        assert [b[2] is None for b in flac.decode([stream[: starts[3]]])[0]] == [False, False, False, True]


def test_flac_tells_streams_that_are_not_whole(spark):
    rng = random.Random(9)
    payload = rng.randbytes(5000)
    stream = flac.encode([payload])[0]
    starts = [a for _, _, a, _, _ in flac.find_frames(stream)]
    other = bytearray(stream)
    other[30] ^= 1  # the MD5
    streams = [stream, stream[: starts[4]], stream[: starts[2]] + stream[starts[3] :], stream[: starts[0]] + stream[starts[1] :], bytes(other), None, flac.encode([b""])[0], flac.encode([b"long" * 500_000])[0]]
    read = flac.decode_media(spark.createDataFrame(list(enumerate(streams)), "i long, media binary").withColumns({"blocks": F.lit(1), "whole": F.lit("clash")})).orderBy("i").collect()
    assert [r.whole for r in read] == [True, False, False, False, False, False, True, True]
    assert [sum(b.n_samples for b in r.blocks if b.ok) for r in read[:4]] == [5000, 4096, 3976, 3976]
    assert b"".join(b.pcm for b in read[7].blocks) == b"long" * 500_000


def test_flac_marks_frames_of_other_layouts():
    """Two frames of 4096 samples, two channels, 16 bits; and an own frame that says it has two partitions."""
    info = (4096 << 128 | 4096 << 112 | 44100 << 44 | 1 << 41 | 15 << 36 | 8192).to_bytes(18, "big") + bytes(16)
    heads = [h + bytes([flac.crc8(h)]) for h in (b"\xff\xf8\xc9\x18" + bytes([n]) for n in range(2))]
    assert flac.decode([b"fLaC\x80\0\0\x22" + info + b"".join(h + bytes(20) for h in heads)]) == [[(0, 4096, None), (4096, 4096, None)]]
    stream = bytearray(flac.encode([bytes(i % 7 + 100 for i in range(1024))])[0])
    (_, _, a, end, head) = flac.find_frames(bytes(stream))[0]
    body = a + head
    at = (body + 1 + (2 if stream[body] >> 1 == 33 else (stream[body] >> 1) - 8)) * 8 + 25 * (stream[body] >> 1 == 33) + 5
    stream[at // 8] ^= 0x80 >> at % 8
    frame = flac.np.frombuffer(bytes(stream[a : end - 2]), flac.np.uint8)
    stream[end - 2 : end] = int(flac.crc16(frame, flac.np.array([0]), flac.np.array([len(frame)]))[0]).to_bytes(2, "big")
    assert flac.decode([bytes(stream)]) == [[(0, 1024, None)]]


def test_flac_query(spark, texts):
    for r in queries.op5_flac(spark, SF).collect():
        raw = texts[r.doc_id].encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_url_rules(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, ("net", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://A.Example.NET/en/x", "http://example.net/e", "http://net/", "http://net", "https://x.org/fr/?q", "http://example.com/de/a", "nonsense", None, "http://evilnet/", "http://a.net:80/", "x://u.net?/"]
    got = [r[1:] for r in urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]
    assert [g[2:] for g in got] == [("example.net/en/", "allow"), ("net/", "block"), ("net/", "block"), (None, "allow"), ("org/fr/", "allow"), ("example.com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert got[0][:2] == ("a.example.net", "/en/x") and got[7][:2] == ("", "")


def near_by_hand(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_of_a_large_family(spark):
    """A family beyond the limits of short lists and blocks, a common passage, and short texts."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    docs = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = word()
        docs.append(" ".join(t))
    docs += [" ".join(passage + [word() for _ in range(rng.randrange(20, 80))]) for _ in range(80)]
    docs += ["a b c", "A b C", "a b", "", " \t", "a b c d e", docs[3], docs[3].upper(), "\x1c x"]
    rows = list(enumerate(docs)) + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"hot": 8, "block": 16}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, **options).collect()}
        assert got == near_by_hand(rows)


def test_sets_of_one_name_are_told_apart(spark):
    rows = [(1, 7, 1), (2, 7, 1), (3, 7, 2), (4, 8, 1), (5, None, None)]
    df = spark.createDataFrame([(*r, r[0], 3, [1, 2]) for r in rows], "doc_id long, node long, check long, key long, n_shingles long, sketch array<long>")
    found, classes = neardup.told_apart(df)
    got = {r.doc_id: r.node for r in found.collect()}
    assert got[1] == got[2] != got[3] and got[4] == 8 and got[5] is None
    assert {r.node: r.copies for r in classes.collect()} == {got[1]: 2, got[3]: 1, 8: 1}


def test_union_sketch_estimates():
    rng = flac.np.random.default_rng(3)
    for n, m in ((30, 30), (400, 380), (50, 40), (2000, 2000)):
        pool = rng.choice(2**62, 3000, replace=False).astype("uint64")
        a, b = (flac.np.unique(rng.choice(pool, k, replace=False)) for k in (n, m))
        union = flac.np.union1d(a, b)[:48]
        want = len(flac.np.intersect1d(flac.np.intersect1d(union, a), b)) / len(union)
        other = flac.np.full((1, 48), flac.np.iinfo("uint64").max, "uint64")
        other[0, : min(48, m)] = b[:48]
        assert neardup.estimates(a[:48], other, n, flac.np.array([m]))[0] == pytest.approx(want)
        assert neardup.common_counts(a, [b, a])[0] == len(flac.np.intersect1d(a, b))


def test_the_mix_is_a_sequence_of_pieces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    pieces = mixing.mix_pieces(docs).collect()
    size = {r.doc_id: r["size"] for r in mixing.mix_sources(docs).collect()}
    taken, slots = defaultdict(int), defaultdict(list)
    for p in pieces:
        taken[p.id] += p.words
        slots[p.slot].append(p)
        assert 0 < p.words <= 64 and 0 <= p.start and p.start + p.words <= size[p.id]
    assert {r.doc_id: r.taken for r in mixing.mix_sources(docs).where("taken > 0").collect()} == taken
    assert all(len({p.source for p in s}) == 1 and sum(p.words for p in s) <= 64 for s in slots.values())
    assert len({(p.id, p.epoch, p.start) for p in pieces}) == len(pieces)


def test_mix_nears_its_targets(spark):
    rows = queries.op9_mixing(spark, SF).collect()
    by = defaultdict(lambda: [0.0, 0])
    for r in rows:
        by[r.target, r.source_size][1] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    assert all(abs(taken - target) <= 3 * 64 for (target, _), (_, taken) in by.items())
    assert plain(rows) == plain(queries.op9_mixing(spark, SF).collect())


def test_cross_parsing_by_hand():
    text = b"the cat sat on the mat and the dog ran to the cat "
    parser = langid.CrossParser(text)
    rng = random.Random(4)
    for _ in range(30):
        s = bytes(rng.choices(b"the catsdo z", k=rng.randrange(1, 200)))
        phrases, i = 0, 0
        while i < len(s):
            n = 1
            while i + n < len(s) and s[i : i + n + 1] in text and s[i : i + 1] in text:
                n += 1
            phrases, i = phrases + 1, i + n
        assert round(langid.costs([s], [parser])[0, 0] * len(s) / parser.bits) == phrases


def test_phrases_cross_the_borders_of_cells(monkeypatch):
    """Phrases longer than cells, texts that start anywhere in one, and many texts in one call."""
    rng = random.Random(9)
    text = bytes(rng.choices(b"abc", k=400)) + b" "
    parser = langid.CrossParser(text)
    texts = [text[40:300] * 3, text[:1], text[3:390], b"ab" * 300, b"z" * 40] + [bytes(rng.choices(b"abcz", k=rng.randrange(1, 150))) for _ in range(40)]
    want = []
    for s in texts:
        phrases, i = 0, 0
        while i < len(s):
            n = 1
            while i + n < len(s) and s[i : i + n + 1] in text:
                n += 1
            phrases, i = phrases + 1, i + n
        want.append(phrases)
    for cell in (1, 2, 7, 64, 512):
        monkeypatch.setattr(langid, "CELL", cell)
        normal = [t.replace(b"z", b"q") for t in texts]
        got = langid.costs(normal, [parser])[:, 0] * [len(t) for t in texts] / parser.bits
        assert got.round().astype(int).tolist() == want


def test_scores_by_hand(spark):
    """One minus the best cost over the second best; ties go to the first language, and long texts are read whole."""
    train = {"aa": "the cat sat on the mat and ran", "bb": "der hund lief zum haus und zum see", "cc": "the cat sat on the mat and ran"}

    def cost(text, lang):
        bits, phrases, i = math.log2(len(lang) + 2), 0, 0
        while i < len(text):
            n = 1
            while i + n < len(text) and text[i : i + n + 1] in lang + " " and text[i] in lang + " ":
                n += 1
            phrases, i = phrases + 1, i + n
        return phrases * bits / len(text)

    texts = {1: "the cat ran", 2: "haus zum see", 3: "zzz the", 4: "and sat on der see " * 2000, 5: "cat"}
    docs = spark.createDataFrame([(i, t, None) for i, t in texts.items()] + [(100 + k, t, lang) for k, (lang, t) in enumerate(train.items())], "doc_id long, text string, lang string")
    for r in langid.identify_language(docs, train=F.col("doc_id") >= 100).where("doc_id < 100").collect():
        ranked = sorted((cost(texts[r.doc_id], t), lang) for lang, t in train.items())
        assert r.lang_pred == ranked[0][1] and r.score == pytest.approx(1 - ranked[0][0] / ranked[1][0], abs=1e-9)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = queries.op10_language(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = told.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 100 and right >= 0.97 * n


def test_names_that_differ_in_case_are_replaced(spark):
    docs = spark.createDataFrame([(1, "one two three", "en", "a")], "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in ("Hits", "LANG_PRED", "Size", "MEDIA", "Score")})
    items = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    assert decontaminate.mark_overlaps(docs, items).select("hits").first().hits and langid.identify_language(docs, train=F.lit(True)).select("lang_pred", "score").first().lang_pred == "en"
    mixed = mixing.mix_sources(docs)
    assert mixed.select("size").first()["size"] == 3 and len({c.lower() for c in mixed.columns}) == len(mixed.columns)


def test_letters(spark):
    rows = [(1, "123 ½ ²"), (2, "é"), (3, "漢字"), (4, "x")]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows] + [(9, "hello world", "en"), (10, "hallo welt", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred == "und" for r in langid.identify_language(docs, train=F.lit(True)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 9: False, 10: False}
