"""Queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.registry import query
from loomtext.llm.url_rules import filter_urls, rule_table
from loomtext.llm.warc import read_warc, write_warc
from loomtext.scratch import scratch_path
from loomtext.suite import Tables

#: Host and path rules; each fits its host with all subdomains, from the start of the path.
SITE_RULES = [
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]
#: Patterns for what no site rule decides.
PATTERN_RULES = [
    ("||ads.", "block"),
    ("||adserver.", "block"),
    ("/wp-login.php", "block"),
    ("/cgi-bin/", "block"),
    ("/trackback/", "block"),
    ("*casino*", "block"),
    ("*/casino/*/review", "allow"),
]

_FITS = " UNION ALL ".join(
    f"SELECT page_id, '{rule}' AS rule, '{action}' AS action, 1 AS priority FROM parsed "
    f"WHERE (host = '{rule.split('/')[0]}' OR ends_with(host, '.{rule.split('/')[0]}')) "
    f"AND starts_with(path, '{rule[len(rule.split('/')[0]):]}')"
    for rule, action in SITE_RULES
)
_PATTERNS = """
SELECT page_id, pattern AS rule, action, 0 AS priority FROM parsed, (VALUES
  ('||ads.', '^([^/?#]*\\.)?ads\\.', 'block'), ('||adserver.', '^([^/?#]*\\.)?adserver\\.', 'block'),
  ('/wp-login.php', '/wp-login\\.php', 'block'), ('/cgi-bin/', '/cgi-bin/', 'block'),
  ('/trackback/', '/trackback/', 'block'), ('*casino*', 'casino', 'block'),
  ('*/casino/*/review', '/casino/.*/review', 'allow')) AS t(pattern, expression, action)
WHERE target <> '' AND regexp_matches(target, expression, 's')
"""


@query(
    "op9_url_filters",
    f"""
    WITH rest AS (
      SELECT page_id, CASE WHEN strpos(url, '://') > 0
                           THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    parsed AS (
      SELECT page_id,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz')
             || substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS target
      FROM rest),
    fits AS ({_FITS} UNION ALL {_PATTERNS}),
    best AS (
      SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY priority DESC,
        length(rule) DESC, action, rule DESC) = 1)
    SELECT p.page_id, p.host, p.path,
           CASE WHEN b.priority = 1 THEN b.rule END AS rule,
           coalesce(b.action, 'allow') AS verdict
    FROM parsed p LEFT JOIN best b USING (page_id)
    """,
)
def op9_url_filters(tables: Tables) -> DataFrame:
    rules = [("||" + rule, action, 1) for rule, action in SITE_RULES]
    rules += [(pattern, action, 0) for pattern, action in PATTERN_RULES]
    judged = filter_urls(tables.pages, rule_table(tables.spark, rules), keep=["page_id"])
    site = F.when(F.col("priority") == 1, F.expr("substring(rule, 3)"))
    return judged.select("page_id", "host", "path", site.alias("rule"), "verdict")


@query(
    "op7_warc",
    """
    WITH body AS (
      SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
             sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages),
    first AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS target FROM body)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN 'revisit'
                ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN target END AS refers_to
    FROM first
    """,
)
def op7_warc(tables: Tables) -> DataFrame:
    archive = scratch_path(tables.spark, "warc")
    write_warc(tables.pages, archive)
    records = read_warc(tables.spark, archive)
    whole = F.col("record_type") == "response"
    return records.select(
        F.expr("try_cast(record_id AS bigint)").alias("page_id"),
        F.when(whole, F.length("payload")).otherwise(F.col("payload_length")).cast("long")
        .alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )
