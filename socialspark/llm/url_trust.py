"""URL filter: host and path rules, else link-graph propagation of trust and distrust over hosts.

A rule (action, host, path) fits a URL whose host is the rule's or a subdomain of it and whose path
starts with the rule's; the longest fitting rule decides. Other URLs take their host's verdict: hosts
are seeds with the share of their pages that rules allow (trust) or block (distrust); personalised
PageRank carries trust along links and distrust against them, from a host to those that link to it.
A surfer who starts at a host stops with the share of its pages that rules block or allow, else goes on by one of that
host's links (damped); the host's distrust is the chance to stop at blocked pages. It is the reversed propagation from
blocked seeds with each step weighed by the linker's own out-links, so it depends neither on how many others link to a
blocked host nor on one link among many. Trust likewise, backwards along the links to a host. A host is blocked where
distrust exceeds trust by ``threshold`` or more.

Links are the absolute and protocol-relative hrefs in the pages. Pages are reduced to hosts before any
join, host edges are summed before they are shuffled, and each round's scores are written.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and takes
the verdict of the empty host; null html has no links; repeated pages count as often as they occur; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from socialspark.sources.scratch import cut, discard

#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.lit(1 << 30))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    return spark.createDataFrame([(a, h, p, h + p) for a, h, p in rules], "action string, rule_host string, rule_path string, rule string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): each host's fitting rules, longest first; an equi-join on the host's suffixes."""
    parts = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("rule_host"))
    fit = suffixes.join(rules, "rule_host").select("host", F.struct((-F.char_length("rule")).alias("length"), "rule", "rule_path", "action").alias("r"))
    return fit.groupBy("host").agg(F.array_sort(F.collect_set("r")).alias("rules"))


def judged_by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, action (null where none fits)."""
    p = pages.select("page_id", url_host(F.col("url").cast("string")).alias("host"), url_path(F.col("url").cast("string")).alias("path"))
    p = cut(p, "page-hosts")
    known = cut(host_rules(p.select("host").distinct(), rules), "host-rules")
    best = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    return p.join(known, "host", "left").withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = pages.select(url_host(F.col("url").cast("string")).alias("src"), F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    return found.where("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust, trusted, distrusted) from seeds (host, trust, distrust) and links (src, dst, n).

    trust and distrust are personalised PageRank: (1 - damping) * seed + damping * the neighbours' scores by link share,
    divided by (1 - damping) at the end. trusted and distrusted are the chances of the surfer described above: seed +
    (1 - both seeds) * damping * the neighbours' chances by the host's own links. All are iterated until none moves by
    more than the tolerance, which damping reaches after log(tolerance) / log(damping) rounds at the latest. Hosts that
    only occur in links start at 0.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("sent"))
    into = links.groupBy("dst").agg(F.sum("n").alias("got"))
    both = links.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("sent")).alias("of_sent"), (F.col("n") / F.col("got")).alias("of_got"))
    forward = both.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("trust").alias("kind"), F.col("of_sent").alias("share"), F.col("of_got").alias("own"))
    backward = both.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit("distrust").alias("kind"), F.col("of_got").alias("share"), F.col("of_sent").alias("own"))
    edges = cut(forward.unionByName(backward), "host-edges")
    open_ = (1 - F.col("trust") - F.col("distrust")).alias("open")
    long = seeds.select("host", open_, F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("seed")))).alias("s")).select("host", "open", "s.*")
    ends = edges.select(F.col("b").alias("host")).union(edges.select("a"))
    others = ends.select("host", F.lit(1.0).alias("open"), F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind")).withColumn("seed", F.lit(0.0))
    base = cut(long.unionByName(others).groupBy("host", "kind").agg(F.sum("seed").alias("seed"), F.min("open").alias("open")), "host-seeds")
    rest = 1 - damping
    scores = cut(base.select("host", "kind", (F.col("seed") * rest).alias("score"), F.col("seed").alias("chance")), "host-scores")
    while True:
        gained = edges.join(scores, (edges["a"] == scores["host"]) & (edges["kind"] == scores["kind"])).groupBy(F.col("b").alias("host"), edges["kind"]).agg(F.sum(F.col("share") * F.col("score")).alias("gain"), F.sum(F.col("own") * F.col("chance")).alias("ahead"))
        come = lambda c: damping * F.coalesce(c, F.lit(0.0))
        now = base.join(gained, ["host", "kind"], "left").select("host", "kind", (F.col("seed") * rest + come("gain")).alias("score"), (F.col("seed") + F.col("open") * come("ahead")).alias("chance"))
        now = cut(now, "host-scores")
        old = scores.select("host", "kind", F.col("score").alias("was"), F.col("chance").alias("was_chance"))
        moved = now.join(old, ["host", "kind"]).agg(F.max(F.greatest(F.abs(F.col("score") - F.col("was")), F.abs(F.col("chance") - F.col("was_chance"))))).first()[0] or 0.0
        discard(scores)
        scores = now
        if moved <= tolerance * rest:
            break
    pick = lambda k, c: F.coalesce(F.max(F.when(F.col("kind") == k, c)), F.lit(0.0))
    scored = scores.groupBy("host").agg((pick("trust", F.col("score")) / rest).alias("trust"), (pick("distrust", F.col("score")) / rest).alias("distrust"), pick("trust", F.col("chance")).alias("trusted"), pick("distrust", F.col("chance")).alias("distrusted"))
    scored = cut(scored, "host-trust")
    for done in (edges, base, scores):
        discard(done)
    return scored


def verdicts(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, damping: float = 0.85, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust (chances, as the threshold takes them)."""
    judged = cut(judged_by_rules(pages, rule_table(pages.sparkSession, rules)), "judged")
    share = lambda action: F.avg(F.when(F.col("action") == action, 1.0).otherwise(0.0))
    seeds = judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    links = cut(host_links(pages), "host-links")
    scored = propagate(seeds, links, damping).select("host", F.col("trusted").alias("trust"), F.col("distrusted").alias("distrust"))
    j = judged.join(scored, "host", "left")
    verdict = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) >= threshold, "block").otherwise("allow")
    return j.select("page_id", "host", "path", "rule", F.coalesce("action", verdict).alias("verdict"), "trust", "distrust")


def allowed(pages: DataFrame, **params) -> DataFrame:
    """The pages that are not blocked, with all their columns."""
    bad = verdicts(pages, **params).where("verdict = 'block'").select("page_id").distinct()
    return pages.alias("p").join(bad.alias("b"), F.col("p.page_id").eqNullSafe(F.col("b.page_id")), "left_anti")
