"""URL filters by link-graph propagation, with DataFrame functions only.

Rules decide the urls they fit.  Hosts get trust by personalised PageRank from the hosts whose urls the rules allow, over
host edges as they point, and distrust by the same over the reversed edges from the hosts whose urls they block: who links
to a bad host is suspect.  A url without a rule is blocked if its host's distrust is ``FLOOR`` or more (a hundredth of a fully
blocked seed) and ``RATIO`` times its trust or more.

An edge is a link from a page to another host: an address in href, src, action or content (canonical and alternate links
among them), or one that a redirect carries in its query, written plainly or percent-encoded.  A relative link is resolved to
its page's host and makes no edge.  A host also points to its parent domain, once for each of its pages, down to the last two
labels: that is where what a page says without a link, its name, leads.  Weights are shares of a host's outgoing edges.

Rounds go on until what changes in one is below ``CLOSE`` of the seeds' sum; ``ROUNDS`` of them without that are an error.  A
walk ends at a host without edges.  Host tables are joined and summed, never collected; each round is a written table.

Rows: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; a null html has no links;
repeated rows are judged alike, and each counts in its host's seed; null page_ids are carried; an empty table gives no row.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_skewed, materialize

# (verdict, host, path): fixed by the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, ROUNDS, CLOSE = 0.85, 200, 1e-5
RATIO, FLOOR = 4.0, 0.01
SALTS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z in lower case, path); both empty for null and where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judged_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, ruled, html)."""
    host, path = split_url(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), "html")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "html")


def host_edges(judged: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts and from a host to its parent; a host's weights sum to 1."""
    html = F.coalesce("html", F.lit(""))
    plain = F.regexp_extract_all(html, F.lit(r"(?i)(?:href|src|action|content)\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>:]+)"), F.lit(1))
    carried = F.regexp_extract_all(html, F.lit(r"(?i)[?&;](?:url|u|to|goto|next|redirect|target|dest)=(?:https?)?(?::|%3A)(?:/|%2F){2}([^/?#\"'\s>&%:]+)"), F.lit(1))
    links = F.array_distinct(F.transform(F.concat(plain, carried), lambda h: F.translate(h, UPPER, LOWER)))
    per = judged.where("host <> ''").select(F.col("host").alias("src"), links.alias("links"))
    labels = F.split("src", r"\.")
    parent = F.when((F.size(labels) > 2) & ~F.col("src").rlike(r"^[0-9.]+$"), F.array_join(F.slice(labels, F.lit(2), F.size(labels)), "."))
    found = per.select("src", F.explode(F.concat("links", F.when(parent.isNotNull(), F.array(parent)).otherwise(F.array().cast("array<string>")))).alias("dst")).where("src <> dst and dst <> ''")
    counted = found.groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = counted.groupBy("src").agg(F.sum("n").alias("all"))
    return join_skewed(counted, total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """Personalised PageRank of (host, seed) to convergence: each round sends the damped score along the edges and adds the seeds anew."""
    base = materialize(seeds.where("seed > 0"), "seeds")
    now = base.select("host", F.col("seed").alias("score"))
    whole = base.agg(F.sum("seed")).first()[0] or 0.0
    if not whole or edges.isEmpty():
        return now
    written = None
    for _ in range(rounds):
        # A source's score is summed up to one row before it meets its edges, in as many tasks as ``SALTS`` says.
        dealt = now.select(F.col("host").alias("src"), "score", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
        sent = edges.withColumn("s", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")).join(dealt, ["src", "s"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("weight")).alias("got"))
        nought = F.lit(0.0)
        both = base.select("host", "seed", nought.alias("got"), nought.alias("old")).union(sent.select("dst", nought, "got", nought)).union(now.select("host", nought, nought, "score"))
        then = materialize(both.groupBy("host").agg((F.max("seed") * (1 - damping) + damping * F.max("got")).alias("score"), F.max("old").alias("old")), "ranks")
        change = then.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        if written is not None:
            discard(written)
        now = written = then
        if change <= close * whole:
            return now.select("host", "score")
        now = now.select("host", "score")
    raise RuntimeError(f"ranks still change by {change} of {whole} after {rounds} rounds")


def judge(pages: DataFrame, rules=RULES, ratio: float = RATIO, floor: float = FLOOR) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    judged = judged_pages(pages, rules)
    per = materialize(judged.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"), F.count("*").alias("n")), "hosts")
    edges = materialize(host_edges(judged), "host-edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight"))
    total = back.groupBy("src").agg(F.sum("weight").alias("all"))
    back = join_skewed(back, total, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("weight"))
    trust = propagate(edges, per.select("host", (F.col("good") / F.col("n")).alias("seed")))
    distrust = propagate(back, per.select("host", (F.col("bad") / F.col("n")).alias("seed")))
    scored = per.select("host").join(trust.select("host", F.col("score").alias("trust")), "host", "left").join(distrust.select("host", F.col("score").alias("distrust")), "host", "left")
    hosts = scored.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    left = join_skewed(judged.select("page_id", "host", "path", "rule", "ruled"), materialize(hosts, "host-scores"), "host", "left")
    bad = (F.col("distrust") >= floor) & (F.col("distrust") >= ratio * F.col("trust"))
    return left.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
