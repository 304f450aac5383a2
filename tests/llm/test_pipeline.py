"""Each stage of the pipeline on its own input, against brute force."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_operators import near_by_hand
from tidemark.plans import lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "12 34", "en", "src0", 5), (-3, "", None, None, 0)], docs.schema)
    docs, out = docs.unionByName(junk), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((name, before.collect(), docs.collect(), docs.columns))
    return out


def test_columns(stages):
    assert all(columns == corpus_pipeline.COLUMNS for *_, columns in stages[:-1])


def lettered(rows):
    return {i for i, (_, text) in rows.items() if any(c.isalpha() for c in text or "")}


def without_boilerplate(rows):
    """rows: {id: (source, text)}; the texts that stay."""
    pages, seen = Counter(source for source, _ in rows.values()), defaultdict(set)
    for i, (source, text) in rows.items():
        for line in text.split("\n"):
            seen[source, line].add(i)
    bad = {k for k, v in seen.items() if k[1] and len(v) >= 3 and len(v) > 0.05 * pages[k[0]]}
    want = {i: (source, "\n".join(x for x in text.split("\n") if (source, x) not in bad)) for i, (source, text) in rows.items()}
    return {i: x for i, x in want.items() if x[1].strip(" ")}


def representatives(rows):
    groups = near_by_hand([(i, text) for i, (_, text) in rows.items()])
    return {i for i, (n, root) in groups.items() if i == root or not n}


def clean(spark, rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(max(1, len(w) - 9)) if w}
    lengths = {len(w) for w in windows}
    return {d for d, (_, text) in rows.items() for w in [words(text)] if not any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))}


def of(rows):
    return {r.doc_id: (r.source, r.text) for r in rows}


def test_language_drops_letterless_only(stages):
    _, before, after, _ = stages[0]
    assert {r.doc_id for r in after} == lettered(of(before))


def test_lines(stages):
    _, before, after, _ = stages[1]
    assert of(after) == without_boilerplate(of(before))


def test_near_duplicates(stages):
    _, before, after, _ = stages[2]
    assert sorted(r.doc_id for r in after) == sorted(representatives(of(before)))


def test_decontamination(spark, stages):
    _, before, after, _ = stages[3]
    want = clean(spark, of(before))
    assert len(want) < len(before) and {r.doc_id for r in after} == want


def test_run_from_end_to_end(spark):
    """All stages at once, against the brute-force versions one after another; the intermediate tables are gone."""
    rows = of(spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = {i: rows[i] for i in lettered(rows)}
    rows = without_boilerplate(rows)
    rows = {i: rows[i] for i in representatives(rows)}
    want = {i: (rows[i][0], len(rows[i][1].split())) for i in clean(spark, rows)}
    at = lineage.place()
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.source, r["size"]) for r in got} == want and len(got) == len(want)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 3 * 64 for s, t in target.items())
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in lineage._made[at:]]
    assert [x for x in left if x.startswith("stage")] == ["stage3"] and "sketches" not in left


def test_mix(stages):
    _, before, after, _ = stages[4]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    taken, target = Counter(), {}
    for r in after:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"] == 2 * len(next(b.text for b in before if b.doc_id == r.doc_id).split())
    assert all(abs(taken[s] - t) <= 3 * 64 for s, t in target.items())
