"""The scalar library as temporary SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from bidlake.functions.text import LEGAL_SUFFIXES, UOM_ALIASES

# Fixed expressions, as in functions.text and functions.numbers.
FUNCTIONS = {
    "norm_key(s STRING) RETURNS STRING": "regexp_replace(lower(coalesce(s, '')), '[^a-z0-9]', '')",
    "norm_email(s STRING) RETURNS STRING": "lower(trim(coalesce(s, '')))",
    "email_domain(s STRING) RETURNS STRING": "CASE WHEN contains(coalesce(s, ''), '@') THEN substring_index(lower(trim(s)), '@', -1) ELSE '' END",
    "norm_supplier(s STRING) RETURNS STRING": r"replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce(s, '')), '[^a-z0-9]+', ' ')), '(^| )l l [cp]$', ''), '(( |^)(SUFFIXES))+$', ''), ' ', '')".replace("SUFFIXES", "|".join(LEGAL_SUFFIXES)),
    "norm_subject(s STRING) RETURNS STRING": r"trim(regexp_replace(trim(regexp_replace(coalesce(s, ''), '\\s+', ' ')), '(?i)^((re|fw|fwd)\\s*:\\s*)+', ''))",
    "clean_sku(s STRING) RETURNS STRING": r"CASE WHEN s RLIKE '[:|]' OR trim(s) = '' THEN NULL ELSE regexp_replace(trim(s), '\\s*([-/.])\\s*', '$1') END",
    "norm_uom(s STRING) RETURNS STRING": "coalesce(try_element_at(map(UNITS), lower(trim(s))), upper(trim(s)))".replace("UNITS", ", ".join(f"'{k}', '{v}'" for k, v in UOM_ALIASES.items())),
    "rfq_token(s STRING) RETURNS STRING": r"'RFQ-' || nullif(coalesce(nullif(regexp_extract(s, '(?i)\\bRFQ\\s*[-#:]?\\s*(\\d{3,12})\\b', 1), ''), regexp_extract(s, '(?i)\\bRequest\\s+for\\s+Quote\\s*#?\\s*(\\d{3,12})\\b', 1)), '')",
    "lead_days(s STRING) RETURNS INT": r"cast(array_max(transform(regexp_extract_all(s, '(\\d+)', 1), x -> cast(x AS INT))) * CASE WHEN lower(s) RLIKE 'week|wk' THEN 7 ELSE 1 END AS INT)",
    "parse_number(s STRING) RETURNS DECIMAL(28,6)": r"try_cast(nullif(regexp_replace(replace(s, ',', ''), '[^0-9.\\-]', ''), '') AS DECIMAL(28,6))",
    "money(x DECIMAL(38,10)) RETURNS DECIMAL(18,2)": "cast(round(x, 2) AS DECIMAL(18,2))",
    "pct_change(cur DECIMAL(18,6), base DECIMAL(18,6)) RETURNS DECIMAL(38,16)": "cast(try_divide(cur - base, base) AS DECIMAL(38,16))",
}
#: Lines from 1 and their cells from 0.
TABLE_FUNCTIONS = {
    "explode_cells(body STRING, mark STRING) RETURNS TABLE (row INT, col INT, value STRING)": "SELECT c.row, c.col, c.value FROM LATERAL inline(flatten(transform(split(body, '\\\\n'), (l, i) -> transform(split(l, mark), (v, j) -> struct(i + 1 AS row, j AS col, v AS value))))) AS c(row, col, value)",
}


def register(spark: SparkSession) -> None:
    for head, body in (FUNCTIONS | TABLE_FUNCTIONS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
