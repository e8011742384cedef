"""URL filters: pattern rules found through their rarest literal token.

A pattern is literal text with ``*`` for anything; ``||`` in front stands for the start of a host or
of one of its parent domains, ``|`` at either end for the end of the URL. Every rule is indexed under
that complete token of its literal text which is rarest among all URLs; the tokens of a URL fetch the
rules filed under them, and only those run their regular expression. A rule without a complete token
(``*x*``) is filed under the empty token, which every URL has.

Defined cases: a NULL URL, or one without ``://``, has an empty host and path, fits no rule and takes
the default. Of the rules that fit, the highest priority wins, then the longest pattern, then allow,
then the pattern last in order. Repeated URLs are judged once and joined back. An empty rule table
gives every URL the default. Columns not in ``keep`` are ignored;
a kept column with the name of a result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = ["host", "path", "rule", "priority", "verdict"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "pattern string, action string, priority int"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def parse_urls(urls: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``, and ``_target``: the URL from its lower-cased host on."""
    rest = F.coalesce(_after(F.col("url")), F.lit(""))
    host = _lower(F.regexp_extract("_rest", r"^[^/?#]*", 0))
    return (
        urls.withColumn("_rest", rest)
        .withColumn("host", host)
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .withColumn("_target", F.concat("host", F.expr("substring(_rest, length(host) + 1)")))
        .drop("_rest")
    )


def _compiled(rules: DataFrame) -> DataFrame:
    """Rules with their regular expression and the complete tokens of their literal text."""
    body = F.regexp_replace("pattern", r"^\|\|?|\|$", "")
    literal = F.regexp_replace("_body", r"([^a-zA-Z0-9*])", r"\\$1")
    start = (
        F.when(F.col("pattern").startswith("||"), F.lit(r"^(?:[^/?#]*\.)?"))
        .when(F.col("pattern").startswith("|"), F.lit("^"))
        .otherwise(F.lit(""))
    )
    end = F.when(F.col("pattern").endswith("|"), F.lit("$")).otherwise(F.lit(""))
    # An unanchored end may continue a token, as a star may: '*' marks both.
    marked = F.concat(
        F.when(F.col("pattern").startswith("|"), F.lit(" ")).otherwise(F.lit("*")),
        "_body",
        F.when(F.col("pattern").endswith("|"), F.lit(" ")).otherwise(F.lit("*")),
    )
    return (
        rules.where("pattern is not null and action is not null")
        .dropDuplicates(["pattern", "action", "priority"])
        .withColumn("_body", body)
        .withColumn(
            "_regex",
            F.concat(F.lit("(?s)"), start, F.regexp_replace(literal, r"\*", ".*"), end),
        )
        .withColumn(
            "_tokens",
            F.array_distinct(
                F.regexp_extract_all(
                    _lower(marked), F.lit(r"(?<![a-z0-9*])([a-z0-9]+)(?![a-z0-9*])"), F.lit(1)
                )
            ),
        )
        .drop("_body")
    )


def index_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row per rule, under its rarest token. ``tokens``: one ``_token`` per URL and token."""
    each = _compiled(rules).withColumn("_token", F.explode_outer("_tokens"))
    wanted = each.where("_token is not null").select("_token").distinct()
    counts = tokens.join(wanted, "_token").groupBy("_token").agg(F.count("*").alias("_urls"))
    chosen = F.min_by("_token", F.struct(F.coalesce("_urls", F.lit(0)), -F.length("_token"), "_token"))
    return (
        each.join(counts, "_token", "left")
        .groupBy("pattern", "action", "priority", "_regex")
        .agg(F.coalesce(chosen, F.lit("")).alias("_token"))
    )


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    url: str = "url",
    keep: list[str],
    default: str = "allow",
) -> DataFrame:
    """The ``keep`` columns of every row, with host, path, winning rule, its priority and verdict."""
    keep = [c for c in keep if c not in RESULTS]
    kept = F.struct(*keep).alias("_kept")
    rows = pages.select(kept, F.col(url).alias("_url"))
    once = rows.select(F.col("_url").alias("url")).where("url is not null").distinct()
    tokens = parse_urls(once).select(
        "url",
        "_target",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.regexp_extract_all(_lower(F.col("_target")), F.lit("[a-z0-9]+"), F.lit(0)),
                    F.array(F.lit("")),
                )
            )
        ).alias("_token"),
    )
    index = index_rules(rules, tokens.select("_token"))
    fitting = tokens.where("_target <> ''").join(index, "_token").where("_target rlike _regex")
    order = F.struct("priority", F.length("pattern"), F.col("action") == "allow", "pattern")
    verdicts = fitting.groupBy("url").agg(
        F.max_by(F.struct("pattern", "action", "priority"), order).alias("_best")
    )
    judged = rows.join(verdicts, F.col("_url") == F.col("url"), "left")
    parsed = parse_urls(judged.select("_kept", "_best", F.col("_url").alias("url")))
    return parsed.select(
        "_kept.*",
        "host",
        "path",
        F.col("_best.pattern").alias("rule"),
        F.col("_best.priority").alias("priority"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )
