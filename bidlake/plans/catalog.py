"""Queries on matching, search, deduplication, changes and threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.functions import text as ft
from bidlake.operators import browse, changes, matching
from bidlake.plans import adapters as a
from bidlake.plans.sql import BASE, with_

ORG = "organization_id"


def supplier_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as senders: their key spells a supplier's name, alias or mail domain."""
    c, k = a.table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("supplier "), F.lpad(k.cast("string"), 9, "0"))).when(k % 4 == 1, F.concat(F.lit("s-"), k, F.lit(" LTD"))).otherwise("nobody")
    senders = c.select(F.lit(a.TENANT).alias(ORG), k.alias("cust"), name.alias("name"), F.concat(F.lit("Sales@S"), k % 600, F.lit(".example.com")).alias("email"))
    return matching.match_suppliers(senders, a.suppliers(spark, sf_dir), "cust").select(F.col("left_id").alias("cust"), F.col("right_id").alias("supplier_id"), "method", "candidates")


def sender_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = a.table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("S"), k, F.lit(" Inc."))).otherwise(F.concat(F.lit("Supplier#"), F.lpad((k % 50).cast("string"), 9, "0"), F.lit(" LLC")))
    email = F.when(k % 5 == 0, F.concat(F.lit(" Bid@c"), k % 120, F.lit(".example.org"))).when(k % 5 == 1, F.concat(F.lit("x@s"), k, F.lit(".example.com"))).otherwise("me@gmail.com")
    senders = c.select(F.lit(a.TENANT).alias(ORG), k.alias("cust"), name.alias("name"), email.alias("email"))
    s = a.suppliers(spark, sf_dir)
    contacts = s.select(ORG, "supplier_id", F.concat(F.lit("bid@c"), F.col("supplier_id") % 90, F.lit(".example.org")).alias("email"))
    return matching.match_senders(senders, s, contacts, "cust").select(F.col("left_id").alias("cust"), F.col("right_id").alias("supplier_id"), "method", "score", "candidates")


def item_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = a.base(spark, sf_dir)
    n, i = F.col("line_no"), F.col("item_id")
    sku = F.when(n == 1, F.concat(F.lit("p "), i)).when(n == 3, F.concat(F.lit("M-"), i)).when(n == 4, F.concat(F.lit("ALT"), i)).otherwise(F.concat(F.lit("?"), i))
    lines = b.select(ORG, "purchase_id", "supplier_id", sku.alias("sku"), F.when(n == 2, F.concat(F.lit("brand"), i % 25 + 1, F.lit("-"), i)).alias("mpn"))
    items = a.items(spark, sf_dir)
    mappings = b.where("line_no = 3 AND supplier_id % 2 = 0").select(ORG, "supplier_id", F.concat(F.lit("M-"), i).alias("supplier_sku"), "item_id").distinct()
    aliases = items.select(ORG, "item_id", F.concat(F.lit("Alt-"), F.floor(F.col("item_id") / 2) * 2 + F.when(F.col("item_id") % 10 == 1, 0).otherwise(F.col("item_id") % 2)).alias("alias"))
    m = matching.match_items(lines, items, aliases, mappings, "purchase_id")
    return m.select(F.col("left_id").alias("purchase_id"), F.col("right_id").alias("item_id"), "method")


def rfq_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = a.emails(spark, sf_dir), F.col("thread_id")
    subject = F.when(k % 4 == 0, F.concat(F.lit("Re: RFQ #"), k % 500 + 1000)).when(k % 4 == 1, F.concat(F.lit("request for quote "), k + 90000)).otherwise("hello")
    texts = e.groupBy(ORG, "thread_id").agg(F.min_by("body", "turn").alias("body")).withColumn("subject", subject)
    texts = texts.withColumn("body", F.when(k % 8 == 0, F.concat("body", F.lit(" see rfq-77777"))).otherwise(F.col("body"))).withColumn("rfq_id", F.when(k % 4 == 3, k % 3000))
    m = matching.match_rfqs(texts, a.rfqs(spark, sf_dir).withColumnRenamed("rfq_id", "request_id"), "thread_id", "subject", "body")
    return m.select(F.col("left_id").alias("thread_id"), F.col("right_id").alias("rfq_id"), "method")


def _suggestions(spark: SparkSession, sf_dir: str, score=None) -> DataFrame:
    items = a.items(spark, sf_dir)
    names = a.table(spark, sf_dir, "part").select(F.lit(a.TENANT).alias(ORG), F.col("p_partkey").alias("left_id"), F.concat_ws(" ", "p_type", F.reverse("p_name")).alias("text"))
    right = items.select(ORG, F.col("item_id").alias("right_id"), F.col("description").alias("text"))
    return matching.similar(names, right, score=score).select(F.col("left_id").alias("part"), F.col("right_id").alias("item_id"), "score", "rank")


def item_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggestions(spark, sf_dir)


def item_suggestions_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native variant by edit distance."""
    return _suggestions(spark, sf_dir, lambda x, y: -F.levenshtein(x, y))


def sender_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = a.table(spark, sf_dir, "customer"), F.col("c_custkey")
    mails = c.select(F.lit(a.TENANT).alias(ORG), k.alias("cust"), F.when(k % 7 != 0, F.concat(F.lit("U"), k, F.lit("@Own.example "))).alias("sender_email"))
    users = c.where(k % 3 == 0).select(F.lit(a.TENANT).alias(ORG), F.concat(F.lit("u"), k, F.lit("@own.example")).alias("email"))
    return matching.sender_role(mails, users).select("cust", "sender_role")


def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.search(a.items(spark, sf_dir), ["sku", "description", "manufacturer_part_number"], "Widget").select("item_id", "description")


def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = a.history(spark, sf_dir).select("purchase_id", "supplier_id", "item_id")
    found = browse.search_related(h, ["purchase_id"], "77-", [(a.suppliers(spark, sf_dir), ["name"], "supplier_id"), (a.items(spark, sf_dir), ["sku", "description"], "item_id")])
    return found.select("purchase_id")


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.page(a.items(spark, sf_dir), "description", ["sku", "description"], "item_id", 3, 40).select("item_id", "description")


def newest_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = browse.newest(a.history(spark, sf_dir), ["supplier_id"], [F.col("date").desc(), F.col("purchase_id").desc()], 30)
    return h.select("supplier_id", "purchase_id", "date")


def doc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = a.table(spark, sf_dir, "documents").withColumn(ORG, F.lit(a.TENANT))
    return changes.documents_once(docs).select("doc_id", "sha256", "duplicate_of")


def email_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    mails = e.select(
        F.lit(a.TENANT).alias(ORG), F.col("event_id").alias("email_id"), F.when(F.col("event_id") % 3 == 0, F.concat_ws("-", "user_id", "event_type")).alias("message_id"),
        F.when(F.col("event_id") % 11 != 1, F.col("user_id").cast("string")).alias("sender_email"), F.to_date("ts").alias("sent_at"), F.col("event_type").alias("content_hash"), F.col("ts").alias("received_at"),
    )
    return changes.emails_once(mails).select("email_id", "duplicate_of")


def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = a.base(spark, sf_dir)
    return changes.nth_copy(b, [F.col("supplier_id"), F.col("item_id"), F.col("quantity"), F.col("uom")], ["date", "purchase_id"]).where("occurrence > 1").select("purchase_id", "occurrence")


def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last purchase of each item by each supplier, as an old and a new record."""
    b = a.base(spark, sf_dir)
    rows = b.groupBy("supplier_id", "item_id").agg(*(F.max_by(F.col(c), F.struct("date", "purchase_id")).alias(f"new_{c}") for c in ("currency", "lead_time_days", "l_returnflag")), *(F.min_by(F.col(c), F.struct("date", "purchase_id")).alias(f"old_{c}") for c in ("currency", "lead_time_days", "l_returnflag")))
    fields = ["currency", "lead_time_days", "l_returnflag"]
    side = lambda s: rows.select("supplier_id", "item_id", *(F.col(f"{s}_{f}").alias(f) for f in fields))
    return changes.field_changes(side("old"), side("new"), ["supplier_id", "item_id"], fields)


def set_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of F lines against orders of O lines: missing, unexpected and repeated lines."""
    b = a.base(spark, sf_dir)
    return changes.not_exactly_once(b.where("l_linestatus = 'F'"), b.where("l_linestatus = 'O'"), ["po_number", "line_no"]).select("po_number", "line_no", "problem")


def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = a.table(spark, sf_dir, "lineitem")
    few = a.table(spark, sf_dir, "supplier").where("s_nationkey % 5 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return changes.orphans(lines, few, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def stale_recs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = a.rfqs(spark, sf_dir).select(ORG, "rfq_id", F.lit("Current").alias("status"))
    changed = a.quotes(spark, sf_dir).where("quote_date >= date'2001-07-01'")
    return changes.stale_recommendations(r, changed).select("rfq_id", "status")


def quote_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = a.base(spark, sf_dir)
    return changes.revisions(b, ["supplier_id", "item_id"], ["date", "purchase_id"], "purchase_id").select("purchase_id", "revision_number", "supersedes", "effective")


def thread_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.timeline(a.emails(spark, sf_dir), ["turn", "body"]).select("thread_id", "turn", "sender_role", "position", "previous_role")


def purchase_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = a.history(spark, sf_dir).select("supplier_id", "date").distinct()
    return changes.gap_sessions(h, ["supplier_id"], "date").groupBy("supplier_id", "session").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("days"))


def thread_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as messages that cite the customer's order before, unless its key is divisible by 7."""
    o = a.table(spark, sf_dir, "orders").select(F.lit(a.TENANT).alias(ORG), F.col("o_orderkey").alias("message_id"), "o_custkey")
    from pyspark.sql import Window

    before = F.lag("message_id").over(Window.partitionBy("o_custkey").orderBy("message_id"))
    refs = F.when((F.col("message_id") % 7 != 0) & before.isNotNull(), F.array(before)).otherwise(F.array().cast("array<bigint>"))
    return changes.thread_roots(o.withColumn("refs", refs)).select("message_id", "root")


def table_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.fingerprint(a.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name"), ("n_secret",))


def norm_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, ("GmbH", "L.L.C.", "Corp Inc", "(Ltd)", "co"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return p.select(
        "p_partkey", ft.norm_key(F.col("p_brand")).alias("brand_key"), ft.norm_supplier(name).alias("supplier_key"), ft.norm_label(F.concat("p_type", F.lit(" / Size: "), "p_size")).alias("label"),
        ft.norm_uom(F.element_at(F.array(*map(F.lit, ("Each", " pcs", "Boxes", "Kilogram", "m"))), (F.col("p_size") % 5 + 1).cast("int"))).alias("uom"),
        ft.norm_subject(F.concat(F.lit("RE: Fwd:  re : "), "p_name")).alias("subject"), ft.clean_sku(F.concat("p_brand", F.lit(" - "), F.col("p_partkey"))).alias("sku"), ft.rfq_token(F.concat(F.lit("about rfq# "), F.col("p_partkey") + 100)).alias("rfq"),
    )


QUERIES = [supplier_match, sender_match, item_match, rfq_match, item_suggestions, item_suggestions_edit, sender_roles, search_items, search_history, page_items, newest_purchases, doc_dedup, email_dedup, duplicate_lines, field_diff, set_check, orphan_lines, stale_recs, quote_revisions, thread_timeline, purchase_sessions, thread_components, table_fingerprint, norm_keys]

_KEY = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]', '', 'g')"


def _match(left: str, stages: list[tuple[str, str, bool]], extra: str = "") -> str:
    """Cascade over candidate queries (left_id, right_id), in plain SQL."""
    found = " UNION ALL ".join(f"SELECT DISTINCT left_id, right_id, {i} AS stage, {str(stops).lower()} AS stops FROM ({q})" for i, (_, q, stops) in enumerate(stages))
    name = "CASE stage " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _, _) in enumerate(stages)) + " END"
    return f"""{left},
found AS ({found}),
per AS (SELECT left_id, stage, count(*) AS n, min(right_id) AS right_id FROM found GROUP BY left_id, stage, stops HAVING count(*) = 1 OR stops),
first AS (SELECT *, {name} AS named FROM per QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY stage) = 1),
m AS (SELECT l.left_id, CASE WHEN n = 1 THEN right_id END AS right_id, CASE WHEN n IS NULL THEN 'NO_MATCH' WHEN n = 1 THEN named ELSE 'AMBIGUOUS_' || named END AS method,
      coalesce(n, 0) AS candidates{extra} FROM l LEFT JOIN first USING (left_id))"""


_SUP = "s AS (SELECT s_suppkey AS id, s_name AS name, 'S' || s_suppkey || ' Ltd' AS alias, 's' || s_suppkey % 400 || '.example.com' AS dom FROM supplier)"
_SUPNAME = "regexp_replace(regexp_replace(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), '(^| )l l [cp]$', ''), '(( |^)(llc|llp|lp|inc|incorporated|ltd|limited|corp|corporation|plc|gmbh))+$', '')"
_SIM = """p AS (SELECT p_partkey AS id, regexp_replace(lower(p_type || ' ' || reverse(p_name)), '[^a-z0-9]', '', 'g') AS ka, regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]', '', 'g') AS kb FROM part),
g AS (SELECT DISTINCT k, unnest(list_transform(range(1, greatest(length(k) - 2, 1) + 1), lambda i: substring(k, i, 3))) AS g, side FROM (SELECT ka AS k, 'a' AS side FROM p UNION SELECT kb, 'b' FROM p)),
met AS (SELECT DISTINCT x.k AS ka, y.k AS kb FROM g x JOIN g y ON x.g = y.g AND x.side = 'a' AND y.side = 'b'),
few AS (SELECT kb, id FROM p QUALIFY row_number() OVER (PARTITION BY kb ORDER BY id) <= 3),
best AS (SELECT ka, id AS item_id, -levenshtein(ka, kb) AS score, row_number() OVER (PARTITION BY ka ORDER BY -levenshtein(ka, kb) DESC, id) AS rank FROM met JOIN few USING (kb) QUALIFY rank <= 3)"""

SQL = {
    "supplier_match": with_(
        _match(
            _SUP + """, l AS (SELECT c_custkey AS left_id, CASE c_custkey % 4 WHEN 0 THEN 'supplier ' || lpad(c_custkey::VARCHAR, 9, '0') WHEN 1 THEN 's-' || c_custkey || ' LTD' ELSE 'nobody' END AS name,
              's' || c_custkey % 600 || '.example.com' AS dom FROM customer)""",
            [
                ("NAME", f"SELECT left_id, id AS right_id FROM l JOIN s ON {_KEY.format('l.name')} = {_KEY.format('s.name')}", True),
                ("ALIAS", f"SELECT left_id, id AS right_id FROM l JOIN s ON {_KEY.format('l.name')} = {_KEY.format('s.alias')}", True),
                ("DOMAIN", "SELECT left_id, id AS right_id FROM l JOIN s ON l.dom = s.dom", True),
            ],
        ),
        "SELECT left_id AS cust, right_id AS supplier_id, method, candidates FROM m",
    ),
    "sender_match": with_(
        _match(
            _SUP + """, l AS (SELECT c_custkey AS left_id, CASE WHEN c_custkey % 3 = 0 THEN 'S' || c_custkey || ' Inc.' ELSE 'Supplier#' || lpad((c_custkey % 50)::VARCHAR, 9, '0') || ' LLC' END AS name,
              CASE c_custkey % 5 WHEN 0 THEN 'bid@c' || c_custkey % 120 || '.example.org' WHEN 1 THEN 'x@s' || c_custkey || '.example.com' ELSE 'me@gmail.com' END AS email FROM customer)""",
            [
                ("EXACT_CONTACT_EMAIL", "SELECT left_id, id AS right_id FROM l JOIN s ON email = 'bid@c' || id % 90 || '.example.org'", True),
                ("EXACT_VERIFIED_DOMAIN", "SELECT left_id, id AS right_id FROM l JOIN s ON split_part(email, '@', 2) = s.dom", True),
                ("KNOWN_ALIAS", f"SELECT left_id, id AS right_id FROM l JOIN s ON replace({_SUPNAME.format('l.name')}, ' ', '') = replace({_SUPNAME.format('s.alias')}, ' ', '')", False),
                ("NORMALIZED_NAME", f"SELECT left_id, id AS right_id FROM l JOIN s ON replace({_SUPNAME.format('l.name')}, ' ', '') = replace({_SUPNAME.format('s.name')}, ' ', '')", False),
            ],
            ", CASE WHEN n = 1 THEN CASE stage WHEN 0 THEN 1.0 WHEN 1 THEN 0.99 WHEN 2 THEN 0.98 ELSE 0.97 END ELSE 0 END::DOUBLE AS score",
        ),
        "SELECT left_id AS cust, right_id AS supplier_id, method, score, candidates FROM m",
    ),
    "item_match": with_(
        BASE
        + ",\n"
        + _match(
            """i AS (SELECT p_partkey AS id, 'P-' || p_partkey AS sku, replace(p_brand, '#', '') || '/' || p_partkey AS mpn,
              'Alt-' || (p_partkey // 2 * 2 + CASE WHEN p_partkey % 10 = 1 THEN 0 ELSE p_partkey % 2 END) AS alias FROM part),
l AS (SELECT purchase_id AS left_id, supplier_id, CASE line_no WHEN 1 THEN 'p ' || item_id WHEN 3 THEN 'M-' || item_id WHEN 4 THEN 'ALT' || item_id ELSE '?' || item_id END AS sku,
        CASE WHEN line_no = 2 THEN 'brand' || (item_id % 25 + 1) || '-' || item_id END AS mpn FROM v_base),
mapped AS (SELECT DISTINCT supplier_id, 'M-' || item_id AS sku, item_id FROM v_base WHERE line_no = 3 AND supplier_id % 2 = 0)""",
            [
                ("SKU", f"SELECT left_id, id AS right_id FROM l JOIN i ON {_KEY.format('l.sku')} = {_KEY.format('i.sku')} AND {_KEY.format('l.sku')} <> ''", False),
                ("MAKER", f"SELECT left_id, id AS right_id FROM l JOIN i ON {_KEY.format('l.mpn')} = {_KEY.format('i.mpn')} AND {_KEY.format('l.mpn')} <> ''", False),
                ("MAPPING", "SELECT left_id, item_id AS right_id FROM l JOIN mapped USING (supplier_id, sku)", False),
                ("KNOWN_ALIAS", f"SELECT left_id, id AS right_id FROM l JOIN i ON {_KEY.format('l.sku')} = {_KEY.format('i.alias')}", False),
            ],
        ),
        "SELECT left_id AS purchase_id, right_id AS item_id, method FROM m",
    ),
    "rfq_match": with_(
        """e AS (SELECT conv_id AS k, arg_min(coalesce(text, ''), turn) AS body FROM conversations WHERE role <> 'system' GROUP BY conv_id),
x AS (SELECT k, CASE k % 4 WHEN 0 THEN 'RFQ-' || (k % 500 + 1000) WHEN 1 THEN 'RFQ-' || (k + 90000) END AS t1,
        CASE WHEN regexp_extract(body, '(?i)\\bRFQ\\s*[-#:]?\\s*(\\d{3,12})\\b', 1) <> '' THEN 'RFQ-' || regexp_extract(body, '(?i)\\bRFQ\\s*[-#:]?\\s*(\\d{3,12})\\b', 1) WHEN k % 8 = 0 THEN 'RFQ-77777' END AS t2, CASE WHEN k % 4 = 3 THEN k % 3000 END AS explicit FROM e),
y AS (SELECT *, CASE WHEN t1 IS NULL THEN t2 WHEN t2 IS NULL OR t1 = t2 THEN t1 END AS token, t1 IS NOT NULL AND t2 IS NOT NULL AND t1 <> t2 AS several FROM x)""",
        """SELECT k AS thread_id, CASE WHEN explicit IS NOT NULL THEN a.p_partkey WHEN NOT several THEN b.p_partkey END AS rfq_id,
       CASE WHEN explicit IS NOT NULL THEN CASE WHEN a.p_partkey IS NULL THEN 'NO_MATCH' ELSE 'EXPLICIT' END WHEN several THEN 'AMBIGUOUS_NUMBER' WHEN b.p_partkey IS NULL THEN 'NO_MATCH' ELSE 'NUMBER' END AS method
FROM y LEFT JOIN part a ON a.p_partkey = explicit LEFT JOIN part b ON 'RFQ-' || (b.p_partkey + 1000) = token""",
    ),
    "item_suggestions_edit": with_(_SIM, "SELECT p.id AS part, item_id, score::INT AS score, rank::INT AS rank FROM p JOIN best USING (ka)"),
    "sender_roles": "SELECT c_custkey AS cust, CASE WHEN c_custkey % 7 = 0 THEN 'UNKNOWN' WHEN c_custkey % 3 = 0 THEN 'BUYER' ELSE 'SUPPLIER' END AS sender_role FROM customer",
    "search_items": "SELECT p_partkey AS item_id, p_name || ' ' || p_type AS description FROM part WHERE p_name || ' ' || p_type ILIKE '%widget%'",
    "search_history": with_(BASE, "SELECT purchase_id FROM v_history JOIN part ON item_id = p_partkey WHERE purchase_id ILIKE '%77-%' OR supplier_name ILIKE '%77-%' OR 'P-' || p_partkey ILIKE '%77-%' OR p_name || ' ' || p_type ILIKE '%77-%'"),
    "page_items": "SELECT p_partkey AS item_id, p_name || ' ' || p_type AS description FROM part ORDER BY description, item_id LIMIT 40 OFFSET 80",
    "newest_purchases": with_(BASE, "SELECT supplier_id, purchase_id, date FROM v_history QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY date DESC, purchase_id DESC) <= 30"),
    "doc_dedup": "SELECT doc_id, sha256(text) AS sha256, CASE WHEN row_number() OVER w > 1 THEN first_value(doc_id) OVER w END AS duplicate_of FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)",
    "email_dedup": """WITH m AS (SELECT event_id AS email_id, ts, CASE WHEN event_id % 3 = 0 THEN 'id:' || user_id || '-' || event_type WHEN event_id % 11 <> 1 THEN 'c:' || event_type || '|' || user_id || '|' || CAST(ts AS DATE) END AS k FROM events)
SELECT email_id, CASE WHEN k IS NOT NULL AND row_number() OVER w > 1 THEN first_value(email_id) OVER w END AS duplicate_of FROM m WINDOW w AS (PARTITION BY k ORDER BY ts, email_id)""",
    "duplicate_lines": with_(BASE, "SELECT purchase_id, row_number() OVER (PARTITION BY supplier_id, item_id, quantity, uom ORDER BY date, purchase_id) AS occurrence FROM v_base QUALIFY occurrence > 1"),
    "field_diff": with_(
        BASE
        + """,
r AS (SELECT supplier_id, item_id, arg_max(currency, (date, purchase_id)) AS a1, arg_min(currency, (date, purchase_id)) AS b1, arg_max(lead_time_days, (date, purchase_id)) AS a2, arg_min(lead_time_days, (date, purchase_id)) AS b2,
             arg_max(l_returnflag, (date, purchase_id)) AS a3, arg_min(l_returnflag, (date, purchase_id)) AS b3 FROM v_base GROUP BY ALL)""",
        """SELECT supplier_id, item_id, 'currency' AS field, b1 AS old_value, a1 AS new_value FROM r WHERE a1 <> b1
UNION ALL SELECT supplier_id, item_id, 'lead_time_days', b2::VARCHAR, a2::VARCHAR FROM r WHERE a2 <> b2 UNION ALL SELECT supplier_id, item_id, 'l_returnflag', b3, a3 FROM r WHERE a3 <> b3""",
    ),
    "set_check": with_(
        BASE + ", a AS (SELECT DISTINCT po_number, line_no FROM v_base WHERE l_linestatus = 'F'), b AS (SELECT po_number, line_no, count(*) AS n FROM v_base WHERE l_linestatus = 'O' GROUP BY ALL)",
        """SELECT coalesce(a.po_number, b.po_number) AS po_number, coalesce(a.line_no, b.line_no) AS line_no, CASE WHEN n IS NULL THEN 'MISSING' WHEN a.po_number IS NULL THEN 'UNEXPECTED' ELSE 'REPEATED' END AS problem
FROM a FULL JOIN b ON a.po_number = b.po_number AND a.line_no = b.line_no WHERE n IS NULL OR a.po_number IS NULL OR n > 1""",
    ),
    "orphan_lines": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 <> 0)",
    "stale_recs": with_(BASE, "SELECT p_partkey AS rfq_id, CASE WHEN p_partkey IN (SELECT rfq_id FROM v_quote WHERE quote_date >= DATE '2001-07-01') THEN 'Stale' ELSE 'Current' END AS status FROM part"),
    "quote_revisions": with_(BASE, "SELECT purchase_id, row_number() OVER w AS revision_number, lag(purchase_id) OVER w AS supersedes, lead(purchase_id) OVER w IS NULL AS effective FROM v_base WINDOW w AS (PARTITION BY supplier_id, item_id ORDER BY date, purchase_id)"),
    "thread_timeline": """WITH e AS (SELECT conv_id AS thread_id, turn, coalesce(text, '') AS body, CASE role WHEN 'user' THEN 'BUYER' ELSE 'SUPPLIER' END AS sender_role FROM conversations WHERE role <> 'system')
SELECT thread_id, turn, sender_role, row_number() OVER w AS position, lag(sender_role) OVER w AS previous_role FROM e WINDOW w AS (PARTITION BY thread_id ORDER BY turn, body)""",
    "purchase_sessions": with_(
        BASE
        + """,
d AS (SELECT DISTINCT supplier_id, date FROM v_history),
n AS (SELECT *, CASE WHEN coalesce(date > lag(date) OVER (PARTITION BY supplier_id ORDER BY date) + 30, true) THEN 1 ELSE 0 END AS new FROM d),
s AS (SELECT *, sum(new) OVER (PARTITION BY supplier_id ORDER BY date)::BIGINT AS session FROM n)""",
        "SELECT supplier_id, session, min(date) AS first_date, max(date) AS last_date, count(*) AS days FROM s GROUP BY ALL",
    ),
    "thread_components": """WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, CASE WHEN o_orderkey % 7 = 0 OR lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NULL THEN 1 ELSE 0 END AS starts FROM orders),
g AS (SELECT *, sum(starts) OVER (PARTITION BY c ORDER BY id) AS part FROM o)
SELECT id AS message_id, min(id) OVER (PARTITION BY c, part) AS root FROM g""",
    "table_fingerprint": """SELECT count(*) AS rows, sum(('0x' || substr(sha256('{"n_name":"' || n_name || '","n_nationkey":"' || n_nationkey || '"}'), 1, 15))::HUGEINT)::HUGEINT::VARCHAR AS content FROM nation""",
    "norm_keys": f"""WITH p AS (SELECT *, p_name || ' ' || ['GmbH', 'L.L.C.', 'Corp Inc', '(Ltd)', 'co'][(p_partkey % 5 + 1)::INT] AS n FROM part)
SELECT p_partkey, {_KEY.format('p_brand')} AS brand_key, replace({_SUPNAME.format('n')}, ' ', '') AS supplier_key, trim(regexp_replace(lower(p_type || ' / Size: ' || p_size), '[^a-z0-9]+', ' ', 'g')) AS label,
       ['EA', 'EA', 'BOX', 'KG', 'M'][(p_size % 5 + 1)::INT] AS uom, p_name AS subject, p_brand || '-' || p_partkey AS sku, 'RFQ-' || (p_partkey + 100) AS rfq FROM p""",
}
