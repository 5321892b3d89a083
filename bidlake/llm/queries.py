"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm import ann, chat, crosstok, exactdedup, filteraudit, linedup, mixing, packing, quality, secrets, simhash, urls, vectors
from bidlake.llm.common import n_words, read, staged

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Words that list a host when a label of it, cut at hyphens, is one of them; a host is listed as well if it has at least so
#: many pages and at least half of their titles have runs of marks, as generated pages do.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam")
LISTED = r"(^|[.-])(" + "|".join(LISTED_WORDS) + r")([.-]|$)"
MARKED_TITLE, MARKED_PAGES = r"<title>[^<]*([*#%]{3}|(&amp;){3})", 20
OWN_CONVERSATION = [(-7, 0, "user"), (-7, 1, "assistant")]
#: The audited filters' letters and columns.
AUDITED = (("A", "few_words"), ("B", "few_distinct"), ("C", "capitals"), ("D", "marks"), ("E", "repeated"))
OWN_TEXT = r"\### Assistant: </turn> ok"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(staged(docs, "sizes"), size="size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), path))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels"))).drop("text")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    marked = F.avg(F.coalesce(F.col("html").rlike(MARKED_TITLE), F.lit(False)).cast("int"))
    hosts = pages.groupBy(urls.host_of(F.col("url")).alias("key")).agg(F.count("*").alias("n"), marked.alias("marked"))
    listed = hosts.where(F.col("key").rlike(LISTED) | ((F.col("n") >= MARKED_PAGES) & (F.col("marked") >= 0.5)))
    return urls.judge(pages.select("page_id", "url"), URL_RULES, listed).drop("url")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("source", "text")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_chat_format(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(*r, OWN_TEXT) for r in OWN_CONVERSATION], turns.schema)
    return chat.digests(chat.format_chats(turns.unionByName(own), tokenizer or public_tokenizers.path("byte_bpe_50k.json")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.drop_frequent(docs, 10).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return crosstok.compare(crosstok.align(read(spark, sf_dir, "documents"), *paths))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filteraudit.text_failures(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return filteraudit.audit(failed, AUDITED)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_best_fit_packing, op3_simhash, op4_quality, op5_url_filter, op6_secret_scan, op7_embedding_dedup, op8_chat_format, op9_line_dedup, op10_cross_polytope, op11_exact_dedup, op12_cross_tokenizer, op13_filter_audit, pipeline)}

_WORDS = r"[^\x20\x09-\x0D]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 2 * source_size AS cap, (sum(source_size) OVER () * 150)::HUGEINT AS budget,
         (coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100)::HUGEINT AS used,
         (sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS weight_left
  FROM s),
g AS (
  SELECT *, cap * weight_left * 100 <= w * (budget - used) AS is_full FROM f),
o AS (SELECT used, weight_left FROM g WHERE NOT is_full ORDER BY used, weight_left DESC LIMIT 1),
t AS (
  SELECT g.source, g.source_size, g.cap,
         CASE WHEN g.is_full THEN g.cap::DOUBLE ELSE (g.w * (g.budget - o.used))::DOUBLE / (100 * o.weight_left)::DOUBLE END AS target
  FROM g LEFT JOIN o ON true),
b AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size::DOUBLE)::BIGINT END AS whole FROM t),
r AS (
  SELECT d.*, b.source_size, b.target, b.whole, floor(b.target)::BIGINT - b.whole * b.source_size AS part,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (size * least(2, whole + CASE WHEN part > 0 AND upto <= part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
URL_SQL = rf"""
WITH p AS (
  SELECT page_id, {_LOW.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html
  FROM pages),
rules(verdict, host, path) AS (VALUES {_RULES}),
n AS (SELECT row_number() OVER () AS row, * FROM p),
listed AS (SELECT host AS own FROM p GROUP BY host HAVING regexp_matches(host, '{LISTED}')
           OR (count(*) >= {MARKED_PAGES} AND avg(coalesce(regexp_matches(html, '{MARKED_TITLE}'), false)::INT) >= 0.5)),
fit AS (
  SELECT row, max_by(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
         max_by(verdict, length(rules.host || rules.path)) AS verdict
  FROM n JOIN rules ON (n.host = rules.host OR ends_with(n.host, '.' || rules.host)) AND starts_with(n.path, rules.path)
  GROUP BY row)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN own IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM n LEFT JOIN fit USING (row) LEFT JOIN listed ON host = own"""

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '</turn>'))
            + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS escaped,
         length(role) + len(regexp_extract_all(role, '[\\:]')) AS named
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(escaped + named + 4 + 2 + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

_KEY = _LOW.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")
LINES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, {_KEY} AS key FROM l),
often AS (SELECT key AS common FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
m AS (SELECT k.*, CASE WHEN common IS NULL THEN 0 ELSE 1 END AS dropped FROM k LEFT JOIN often ON key = common)
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, sum(dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE dropped = 0), '')) AS kept_sha256
FROM m GROUP BY row"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

AUDIT_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words
  FROM documents),
f AS (
  SELECT doc_id, part, (len(words) < 200)::INT AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
         (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e
  FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT [p.letter, q.letter, r.letter, s.letter, u.letter] AS names, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
  FROM x p, x q, x r, x s, x u
  WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND p.bit | q.bit | r.bit | s.bit | u.bit = 31),
st AS (
  SELECT array_to_string(names, '') AS filter_order, k::INT AS step, names[k] AS letter, bits[k] AS bit,
         coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
y AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM cells, st GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM y"""

#: Fingerprints, learned scores, token ids, span positions and approximate searches have no SQL: tests hold them
#: against brute force.
SQL = {"op1_mix_sources": MIX_SQL, "op5_url_filter": URL_SQL, "op8_chat_format": CHAT_SQL, "op9_line_dedup": LINES_SQL, "op11_exact_dedup": EXACT_SQL, "op13_filter_audit": AUDIT_SQL}
