"""Robots rules as tables: which URLs may be fetched, and how far apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitescope.functions.urls import (
    fragment_of,
    query_of,
    raw_path_of,
    strip_ws,
)
from sitescope.operators.skew import rank_within

# The agent sent with each request, and the fixed pause where no rule gives one.
USER_AGENT = "sitescope/0.1"
DEFAULT_DELAY_SECONDS = 1.0

# Where ``str.splitlines`` breaks a text.
_LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"
_BEFORE_PATH = "^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?)"
_RULES = ("allow", "disallow", "crawl-delay", "request-rate")


def _unquote(text: Column) -> Column:
    """Percent-decoding, escape by escape: ``+`` and a bad escape stay as they are."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(kept), text)


def _canonical(url: Column) -> Column:
    """Path, parameters, query and fragment, without the signs of those that are empty."""
    query, fragment = query_of(url), fragment_of(url)
    return F.concat(
        F.regexp_replace(raw_path_of(url), r"(?s)^((?:.*/)?[^/;]*);$", "$1"),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _cleaned(url: Column) -> Column:
    """Without leading control characters and blanks, and without tabs and line breaks."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def _rule_path(value: Column) -> Column:
    """The path of a rule in the form that paths of URLs are compared in."""
    url = _cleaned(value)
    return F.concat(F.regexp_extract(url, _BEFORE_PATH, 1), _canonical(url))


def robots_policies(robots: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """The group of each robots file that applies to ``user_agent``.

    Input: host, txt (one file per host). Output: host, crawl_delay, rules - an
    array of (path, allowed) in file order, no longer than the file it came from.
    A group is a run of user-agent lines and the rules below it; an empty line ends
    it. A group naming ``*`` is only a default, and the first default counts.
    """
    agent = user_agent.split("/")[0].lower()
    lines = robots.select(
        "host",
        F.posexplode(F.split("txt", _LINE_BREAK)).alias("line", "raw"),
    )
    text = strip_ws(F.regexp_replace("raw", "#.*$", ""))
    parsed = lines.select(
        "host",
        "line",
        (F.col("raw") == "").alias("blank"),
        F.when(text.contains(":"), F.lower(strip_ws(F.substring_index(text, ":", 1)))).alias("field"),
        _unquote(strip_ws(F.regexp_replace(text, "^[^:]*:", ""))).alias("value"),
    ).withColumn("is_agent", F.coalesce(F.col("field") == "user-agent", F.lit(False)))
    signs = parsed.filter("blank or is_agent or field in ('allow','disallow','crawl-delay','request-rate')")

    # One robots file per host, so these windows are as small as a file.
    ordered = W.partitionBy("host").orderBy("line")
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    last_agent = F.max(F.when(F.col("is_agent"), F.col("line"))).over(so_far)
    last_blank = F.max(F.when(F.col("blank"), F.col("line"))).over(so_far)
    grouped = (
        signs.withColumn("starts", F.col("is_agent") & ~F.lag("is_agent", 1, False).over(ordered))
        .withColumn("open", last_agent > F.coalesce(last_blank, F.lit(-1)))
        .withColumn("group", F.sum(F.col("starts").cast("int")).over(so_far))
        .filter("open")
    )
    is_rule = F.col("field").isin(*_RULES)
    path_rule = F.col("field").isin("allow", "disallow")
    allowed = (F.col("field") == "allow") | (F.col("value") == "")
    delay = F.when(
        (F.col("field") == "crawl-delay") & F.col("value").rlike("^[0-9]+$"),
        F.col("value").cast("double"),
    )
    groups = (
        grouped.groupBy("host", "group")
        .agg(
            F.bool_or(is_rule).alias("closed"),
            F.bool_or(F.col("is_agent") & (F.col("value") == "*")).alias("is_default"),
            F.bool_or(
                F.col("is_agent") & F.lit(agent).contains(F.lower("value"))
            ).alias("names_agent"),
            F.max_by(delay, F.when(delay.isNotNull(), F.col("line"))).alias("crawl_delay"),
            F.sort_array(
                F.collect_list(
                    F.when(
                        path_rule,
                        F.struct("line", _rule_path(F.col("value")).alias("path"), allowed.alias("allowed")),
                    )
                )
            ).alias("rules"),
        )
        .filter("closed and (is_default or names_agent)")
    )
    # Groups naming the agent come before the default group, each in file order.
    return (
        groups.groupBy("host")
        .agg(
            F.min(F.struct("is_default", "group", "crawl_delay", "rules")).alias("g")
        )
        .select(
            "host",
            "g.crawl_delay",
            F.transform(
                "g.rules", lambda r: F.struct(r["path"].alias("path"), r["allowed"].alias("allowed"))
            ).alias("rules"),
        )
    )


def _matched_path(url: Column) -> Column:
    whole = _canonical(_cleaned(url))
    return F.when(whole == "", "/").otherwise(whole)


def robots_gate(urls: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds ``allowed`` to rows with host and url; the first rule whose path is a
    prefix decides, and a host without robots file allows everything."""
    placed = urls.join(policies.select("host", "rules"), "host", "left")
    path = _matched_path(_unquote(F.col("url")))
    first = F.get(F.filter("rules", lambda r: path.startswith(r["path"])), F.lit(0))
    return placed.select(*urls.columns, F.coalesce(first["allowed"], F.lit(True)).alias("allowed"))


def polite_schedule(
    queue: DataFrame,
    policies: DataFrame,
    position: str = "page_id",
    default_delay: float = DEFAULT_DELAY_SECONDS,
) -> DataFrame:
    """Earliest start in seconds of each fetch, spaced by the host's crawl delay.

    A delay of zero counts as no delay given. ``position`` is the unique queue
    position that orders the fetches of a host.
    """
    ranked = rank_within(queue, ["host"], position, "turn")
    placed = ranked.join(policies.select("host", "crawl_delay"), "host", "left")
    delay = F.coalesce(F.nullif("crawl_delay", F.lit(0.0)), F.lit(default_delay))
    return placed.select(
        *queue.columns,
        delay.alias("delay_seconds"),
        ((F.col("turn") - 1) * delay).alias("start_seconds"),
    )
