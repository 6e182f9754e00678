"""URL filters: rules indexed by their rarest literal token.

A rule names a host, which covers its subdomains, and the start of a path. Its literal tokens are
the host labels and the complete path segments. The token that occurs in the fewest URLs of the
table becomes the rule's index entry, so a URL fetches few candidates by joining its own tokens
with the index; a regular expression runs only on those candidates, and the longest fit wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import LOWER, UPPER, named, quoted

DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _tokens(host: Column, segments: Column) -> Column:
    """Labels and segments, told apart by a first letter."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h"), x))
    parts = F.transform(segments, lambda x: F.concat(F.lit("p"), x))
    return F.array_distinct(F.filter(F.concat(labels, parts), lambda x: F.length(x) > 1))


def parse_rules(rules: DataFrame) -> DataFrame:
    """``verdict, rule`` with the rule's tokens and its pattern over host and path put together.

    A rule without a slash fits all paths of its host; one that starts with a slash fits all hosts.
    Null and repeated rules are dropped; where a rule has two verdicts, block is taken.
    """
    slash = F.instr("rule", "/")
    host = F.translate(F.when(slash > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")), UPPER, LOWER)
    path = F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise(F.lit(""))
    segments = F.split(path, "/")
    literal = F.concat(F.lit(r"\Q"), F.replace(F.concat(host, path), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    start = F.when(host == "", F.lit(r"^[^/]*")).otherwise(F.lit(r"^(?:[^/]*\.)?"))
    end = F.when(path == "", F.lit(r"(?:/|$)")).otherwise(F.lit(""))
    return (
        rules.where(F.col("rule").isNotNull() & F.col("verdict").isNotNull())
        .groupBy("rule")
        .agg(F.max("verdict").alias("verdict"))  # "block" is the larger word
        .select(
            "rule", "verdict",
            _tokens(host, F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))).alias("tokens"),
            F.concat(start, literal, end).alias("pattern"),
        )
    )


def index_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule under its rarest token over all ``urls`` (ties: the smaller token).

    A rule without a complete token is filed under the empty token, which every URL looks up.
    """
    named = rules.select("rule", F.explode("tokens").alias("token"))
    counts = (
        urls.select(F.explode("tokens").alias("token"))
        .join(named.select("token").distinct(), "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = (
        named.join(counts, "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
    )
    return rules.join(rarest, "rule", "left").select(
        F.coalesce("best.token", F.lit("")).alias("token"), "rule", "verdict", "pattern"
    )


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge every row's URL by the longest rule that fits (ties: the smaller rule).

    Adds the columns ``host, path, rule, verdict``, which replace columns of the same names in
    ``df``. Null and malformed URLs have empty host and path; rows that no rule fits have a null
    rule and the default verdict. Repeated rows stay; an empty table gives an empty result. Rules are matched
    once for each distinct host and path, and that verdict is joined back, so a URL that fills a
    third of the table is judged once. Spark broadcasts the index when it is small enough and
    shuffles by token when it is not.
    """
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    target = named(df, url)
    rows = df.select(*[named(df, c) for c in kept], url_host(target).alias("host"), url_path(target).alias("path"))
    urls = rows.select("host", "path").distinct()
    looked_up = urls.withColumn("tokens", _tokens(F.col("host"), F.split("path", "/")))
    index = index_rules(looked_up, parse_rules(rules))
    fits = (
        looked_up.select("host", "path", F.explode(F.array_append("tokens", F.lit(""))).alias("token"))
        .join(index, "token")
        .where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("order"), "rule", "verdict")).alias("best"))
    )
    return rows.join(fits, ["host", "path"], "left").select(
        *[quoted(c) for c in kept], "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
