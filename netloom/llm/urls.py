"""URL filters: rules by host and path, and propagation over the link graph of hosts.

Pages that no rule fits get their host's verdict. Trust spreads by personalised PageRank from hosts whose pages rules
allow, along links; distrust spreads from hosts whose pages rules block, against the links, to those that link to them.
A seed's weight is the share of its pages that rules allow or block; scores are scaled so that a full seed without
further inflow has 1. A host is blocked if its distrust exceeds its trust by ``THRESHOLD``.

Edges are counted for each pair of hosts before they are shuffled, so a host with a third of all links is a few rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.plans.durable import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
THRESHOLD = 0.3
#: Propagation ends when no host's score moves by this share of a full seed any more. All that moves in a round is at most
#: the damping times what moved in the round before, so it ends on any graph.
TOLERANCE = 1e-4


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def _after(url: Column) -> Column:
    """What follows the first ://; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From the first :// up to a slash, question mark, number sign or the end, A to Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, number sign or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule (name, verdict) that fits; null if none. For lists of some hundred rules, as an expression."""
    found = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_edges(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, read from absolute addresses."""
    hosts = F.transform(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER))
    links = pages.select(F.col(host_col).alias("src"), F.explode(hosts).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int | None = None) -> DataFrame:
    """(host, score) from edges (src, dst, n) and seeds (host, weight): weight + damping * inflow, iterated until it settles, or for so many ``rounds``.

    What a host passes on is divided by its links. Lineage is cut each round by a checkpoint.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total")).withColumnRenamed("src", "s")
    shares = durable(edges.join(out, F.col("src") == F.col("s")).select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    score = durable(seeds.where("weight > 0").select("host", F.col("weight").alias("score")))
    if not shares.limit(1).count() or not score.limit(1).count():
        return score
    for _ in count() if rounds is None else range(rounds):
        inflow = shares.join(score, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("share") * F.col("score") * damping).alias("score"))
        new = durable(inflow.unionByName(seeds.where("weight > 0").select("host", F.col("weight").alias("score"))).groupBy("host").agg(F.sum("score").alias("score")))
        old = score.select(F.col("host").alias("h"), F.col("score").alias("was"))
        moved = new.join(old, F.col("host") == F.col("h"), "full_outer").agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
        score = new
        if moved is None or moved < tolerance:
            break
    return score


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row.

    A null url or one without :// has an empty host and path. The empty host takes no part in the graph and is allowed
    where no rule fits, as are hosts that nothing is known of. A null page has no links. Repeated rows are judged each.
    """
    parsed = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    slim = durable(parsed.select(id_col, "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r")))
    edges = durable(host_edges(parsed))
    shares = slim.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("r.verdict") == "allow").alias("good"), F.count_if(F.col("r.verdict") == "block").alias("bad"))
    seeds = durable(shares.select("host", (F.col("good") / F.col("n")).alias("good"), (F.col("bad") / F.col("n")).alias("bad")))
    trust = personalised_rank(edges, seeds.select("host", F.col("good").alias("weight")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_rank(back, seeds.select("host", F.col("bad").alias("weight")))
    scores = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    hosts = durable(scores.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
    joined = slim.join(hosts.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left")
    trusted, distrusted = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("r.verdict", F.when(distrusted - trusted > THRESHOLD, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select(id_col, "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"), trusted.alias("trust"), distrusted.alias("distrust"))
