"""URL filters: rules on hosts and paths, and trust spread over the link graph for the rest [native].

A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's; the longest
fitting rule decides. Where none fits, the host decides: trust starts at hosts with allowed pages and follows links
(personalised PageRank), distrust starts at hosts with blocked pages and follows links backwards, because who links
to a bad host is suspect. Both start in proportion to pages, so they compare; a host whose distrust makes up
``threshold`` of both (and a little goodwill) is blocked. Steps go on until no verdict can change any more. Links are summed to one edge per pair of hosts before any join.

Defined results: a null url, or one without ``://``, has empty host and path and is allowed unless a rule fits;
null html has no links; repeated pages count as often as they occur; without links only the seeds count; an empty
table gives no rows. Links without a host (relative ones) stay on their host and make no edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtflow.llm.common import column_of, fenced
from stmtflow.session import cut_lineage

#: (verdict, host, path): the rules that the query applies (fixed values).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING, STEPS, THRESHOLD = 0.85, 8, 0.8
#: Trust, in pages, that every host starts the comparison with: one or two blocked pages block no host.
GOODWILL = 2.0
#: What may still walk, in pages, when it can move no share by more than its rounding.
TOLERANCE = 1e-10
#: Steps of the walk that one plan holds before its result is written.
STEPS_A_PLAN = 4


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    found = [
        F.when(
            ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(start)),
            F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, of, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ]
    none = F.lit(None).cast("struct<rule: string, verdict: string>")
    return F.coalesce(*found, none)


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(source, target, links): one row per pair of different hosts."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    target = host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    return (
        pages.select(F.col(host).alias("source"), F.explode(found).alias("link"))
        .select("source", target.alias("target"))
        .where("source <> '' and target <> '' and source <> target")
        .groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))
    )


def spread(
    edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int | None = STEPS, threshold: float = THRESHOLD
) -> DataFrame:
    """Trust and distrust per host: (kind, host, rank); seeds have the same columns.

    ``kind`` is "trust" (along links) or "distrust" (against them). A walk ends at a host without such links. With ``steps``
    None steps go on until what still walks can change no host's verdict under ``threshold``.
    """
    ways = [
        edges.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "links"),
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "links"),
    ]
    both = ways[0].unionByName(ways[1])
    total = both.groupBy("kind", "host").agg(F.sum("links").alias("all"))
    moves = cut_lineage(both.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("all")).alias("part")))
    # rank has come to rest, walking goes on; a share of 1 - damping of it rests in each step
    state = seeds.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("walking"))
    step = 0
    while steps is None or step < steps:
        moved = state.where("walking > 0").join(moves, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), F.lit(0.0).alias("rank"), (F.col("walking") * F.col("part") * damping).alias("walking")
        )
        rested = state.select("kind", "host", (F.col("rank") + F.col("walking") * (1 - damping)).alias("rank"), F.lit(0.0).alias("walking"))
        state = rested.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("walking").alias("walking"))
        step += 1
        if step % STEPS_A_PLAN == 0 or step == steps:
            state = cut_lineage(state)
            if steps is None and _settled(state, threshold):
                return state.select("kind", "host", "rank")
    return state.select("kind", "host", (F.col("rank") + F.col("walking")).alias("rank"))


def _of(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))


def _share(trust: Column, distrust: Column) -> Column:
    # rounded, so that the order of additions cannot tip a host that lies on the threshold
    return F.round(distrust / (trust + distrust + GOODWILL), 9)


def _settled(state: DataFrame, threshold: float) -> bool:
    """Whether no verdict can change: a host gets at most all that still walks, which each step shrinks by the damping."""
    left = {r.kind: r.w for r in state.groupBy("kind").agg(F.sum("walking").alias("w")).collect()}  # two rows
    trust, distrust = left.get("trust", 0.0), left.get("distrust", 0.0)
    if max(trust, distrust) <= TOLERANCE:
        return True
    if distrust / (distrust + GOODWILL) >= threshold:  # hosts that no walk has reached
        return False
    least, most = _share(F.col("t") + trust, F.col("d")), _share(F.col("t"), F.col("d") + distrust)
    known = state.groupBy("host").agg(_of("trust").alias("t"), _of("distrust").alias("d"))
    return known.where((least < threshold) & (most >= threshold)).isEmpty()


def blocked_hosts(rank: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host) of the hosts that distrust outweighs."""
    return rank.groupBy("host").agg(_share(_of("trust"), _of("distrust")).alias("share")).where(F.col("share") >= threshold).select("host")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, url: str = "url", html: str = "html",
    damping: float = DAMPING, steps: int | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """``pages`` with host, path, rule (null: none fits) and verdict."""
    inner, back = fenced(pages)
    link, body = F.col(column_of(pages, url)), column_of(pages, html)
    seen = inner.withColumns({"_host": host_of(link), "_path": path_of(link)})
    seen = seen.withColumn("_rule", matched_rule(F.col("_host"), F.col("_path"), rules))
    edges = host_links(seen, "_host", body)
    kind = F.when(F.col("_rule.verdict") == "allow", "trust").otherwise("distrust")
    seeds = cut_lineage(
        seen.where("_rule is not null").groupBy(kind.alias("kind"), F.col("_host").alias("host"))
        .agg(F.count(F.lit(1)).cast("double").alias("rank"))
    )
    bad = blocked_hosts(spread(edges, seeds, damping, steps, threshold), threshold).select(F.col("host").alias("_host"), F.lit("block").alias("_by_host"))
    done = seen.join(bad, "_host", "left").withColumns(
        {
            "_verdict": F.coalesce(F.col("_rule.verdict"), F.col("_by_host"), F.lit("allow")),
            "_matched": F.col("_rule.rule"),
        }
    )
    return back(done, {"host": "_host", "path": "_path", "rule": "_matched", "verdict": "_verdict"})
