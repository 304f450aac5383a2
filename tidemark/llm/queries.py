"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, flac, langid, linededup, mixing, neardup, pii, ranked, simhash, urlfilter, warc, whitening
from tidemark.llm.common import bounded_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_overlaps(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    manifest = warc.write_archives(warc.mark_revisits(table(spark, sf_dir, "pages")))
    read = warc.resolve_revisits(warc.read_archives(manifest))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")], "conv_id long, turn long, role string, text string")
    read = chat.read_chats(chat.format_chats(rows.unionByName(tricky), vocabulary=VOCABULARY), vocabulary=VOCABULARY)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    pad = F.when(F.length(text) == 0, 64).otherwise(F.pmod(-F.length(text), F.lit(64)))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("n_bytes"), F.concat(text, F.unhex(F.repeat(F.lit("00"), pad))).alias("payload"))
    media = flac.encode_media(docs).drop("payload")
    read = flac.decode_media(media)
    # Blocks are joined as characters of one byte each; Spark joins strings in linear time.
    # Of a stream that is not whole nothing is returned.
    stored = F.array_join(F.transform("blocks", lambda b: F.decode(b["pcm"], "ISO-8859-1")), "")
    read = read.withColumn("stored", F.when(F.col("whole"), F.encode(stored, "ISO-8859-1")))
    tail = F.substring("stored", -64, 64)
    return read.select("doc_id", "n_bytes", F.length("stored").cast("long").alias("payload_bytes"), F.sha2("stored", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return kept.select("doc_id", "source", "text", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(str(r) for r in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    found = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = langid.identify_language(docs, train=~held_out(F.col("doc_id")))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_warc, op4_chat, op5_flac, op6_line_dedup, op7_url_filter, op8_near_duplicates, op9_mixing, op10_language, op11_ranked_search, op12_simhash, op13_whitening)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_BLACK = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS ws FROM benchmark),
p AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(1, len(ws) - 9) + 1), lambda i: array_to_string(ws[i:i+9], ' '))) AS pat,
  least(10, len(ws)) AS n FROM iw WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS ws FROM documents),
lens AS (SELECT DISTINCT n FROM p),
dw AS (SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i+n-1], ' '))) AS pat FROM d, lens WHERE len(ws) >= n),
h AS (SELECT r, i, p.n AS n, item FROM dw JOIN p ON dw.pat = p.pat AND dw.n = p.n),
hw AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS w FROM h) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM f THEN f END AS refers_to FROM m""",
    "op4_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
  sum(17 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))) AS chars FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars FROM g""",
    "op6_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
c AS (SELECT source, line, count(*) AS n FROM (SELECT DISTINCT r, source, unnest(ls) AS line FROM d) WHERE line <> '' GROUP BY ALL),
b AS (SELECT c.source, line FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND n > 0.05 * pages),
x AS (SELECT r, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM x.source AND b.line = x.line) GROUP BY r)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(ls), 0) - coalesce(n, 0) AS BIGINT) AS n_dropped FROM d LEFT JOIN k USING (r)""",
    "op7_url_filter": r"""
WITH r(rule_host, rule_path, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT row_number() OVER () AS k, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(v, length(rule_host || rule_path)) AS v
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (k)""",
    "op8_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_BLACK} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, u.y FROM reach r JOIN u ON r.c = u.x)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op11_ranked_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
n AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, c),
q AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM benchmark),
qt AS (SELECT i, t, count(*) AS times FROM (SELECT i, unnest(ts) AS t FROM q) GROUP BY ALL),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * n * big_n) // big_l) AS m FROM n, c),
s AS (SELECT i, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM qt JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY i, r),
k AS (SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN q USING (i) WHERE rank <= 10""",
    "op9_mixing": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, md5(concat_ws(':', '20', doc_id, md5(text))) AS o,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
s1 AS (SELECT *, CASE idx % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s0),
s2 AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER q, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS rest, row_number() OVER (ORDER BY source_size / weight, idx) AS k
  FROM s1 WINDOW q AS (ORDER BY source_size / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT lft, rest FROM s2 WHERE weight * lft <= 2 * source_size * rest ORDER BY k LIMIT 1),
t AS (SELECT source, idx, CAST(source_size AS BIGINT) AS source_size, least(CAST(2 * source_size AS DOUBLE), weight * CAST((SELECT lft FROM lv) AS DOUBLE) / (SELECT rest FROM lv)) AS target FROM s2),
c AS (SELECT *, floor(sum(target) OVER (ORDER BY idx) / sum(target) OVER () * 4294967296) AS high FROM t),
b AS (SELECT *, coalesce(lag(high) OVER (ORDER BY idx), 0) AS low FROM c),
slots AS (SELECT (i::HUGEINT * 2654435769) % 4294967296 AS pt FROM range((SELECT CAST(ceil(sum(target) / 64) AS BIGINT) FROM t)) x(i)),
q AS (SELECT idx, count(*) * 64 AS words FROM slots JOIN b ON pt >= low AND pt < high GROUP BY idx),
st AS (SELECT d.*, b.source_size, b.target, coalesce(q.words, 0) AS words, coalesce(sum(size) OVER (PARTITION BY b.idx ORDER BY o, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN q ON q.idx = b.idx)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, words - place)) + greatest(0, least(size, words - source_size - place)) AS BIGINT) AS taken FROM st""",
}
