"""URL filters: rules first, then trust and distrust propagated over host links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.line_dedup import ascii_lower
from gaugeworks.sources.scratch import Scratch

# The rules of the production query.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Steps of the propagation in one job.
HOPS = 4
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty where there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null where none fits. A rule
    fits its host and all subdomains, if the path starts with the rule's."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, action = F.when(fits, rule).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links from pages of one host to another host."""
    link = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    dst = ascii_lower(F.regexp_extract("to", r"//([^/?#]*)", 1))
    return link.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float, scratch: Scratch) -> DataFrame:
    """``(host, score)``: personalised PageRank with ``seeds (host, seed)`` over
    ``edges (a, b, share)``, the shares out of a node summing to one; what comes
    to a node without any goes no further. Scores are scaled so that a node that
    nothing comes to has its seed as score.

    A step passes on only what the one before added. That shrinks by ``damping``
    at least, so once the sum added times ``damping / (1 - damping)`` is within
    ``tolerance``, no score is further from the fixed point than that; this is
    looked at, and the scores written, every ``HOPS`` steps. A node of very many
    edges meets them in a sort-merge join, whose large partitions Spark splits,
    and the sum per node is combined before its shuffle.
    """
    given = (F.col("new") * F.col("share") * damping).alias("new")
    now, path = scratch.keep_at(seeds.select("host", F.col("seed").alias("score"), F.col("seed").alias("new")), "rank")
    while (now.agg(F.sum("new").alias("new")).first().new or 0.0) * damping / (1 - damping) > tolerance:
        new, all_new = now.where("new > 0").select("host", "new"), now.select("host", "score", F.lit(0.0).alias("new"))
        for hop in range(HOPS):
            new = new.join(edges, F.col("host") == F.col("a")).select(F.col("b").alias("host"), given).groupBy("host").agg(F.sum("new").alias("new"))
            all_new = all_new.union(new.select("host", F.col("new").alias("score"), F.col("new") if hop == HOPS - 1 else F.lit(0.0)))
        last = path
        now, path = scratch.keep_at(all_new.groupBy("host").agg(F.sum("score").alias("score"), F.sum("new").alias("new")), "rank")
        scratch.drop(last)
    return now.select("host", "score")


def blocked_hosts(ruled: DataFrame, links: DataFrame, damping: float, threshold: float, tolerance: float) -> DataFrame:
    """Hosts whose distrust exceeds their trust by more than ``threshold``. A
    host's seeds are the shares of its pages that the rules allow and block;
    trust follows links, distrust goes against them."""
    scratch = Scratch(ruled.sparkSession, "hosts")
    hosts = scratch.keep(
        ruled.where("host <> ''").groupBy("host").agg(
            F.avg((F.coalesce("action", F.lit("")) == "allow").cast("double")).alias("good"),
            F.avg((F.coalesce("action", F.lit("")) == "block").cast("double")).alias("bad"),
        ).where("good > 0 or bad > 0"),
        "seeds",
    )
    links = scratch.keep(links, "links")
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    into = links.groupBy("dst").agg(F.sum("n").alias("total"))
    forward = scratch.keep(links.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("total")).alias("share")), "forward")
    backward = scratch.keep(links.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("total")).alias("share")), "backward")
    trust = spread(hosts.where("good > 0").select("host", F.col("good").alias("seed")), forward, damping, tolerance, scratch)
    distrust = spread(hosts.where("bad > 0").select("host", F.col("bad").alias("seed")), backward, damping, tolerance, scratch)
    both = distrust.withColumnRenamed("score", "bad").join(trust.withColumnRenamed("score", "good"), "host", "left")
    excess = F.col("bad") - F.coalesce("good", F.lit(0.0))
    return both.where(excess > threshold + tolerance).select("host")


def judge(pages: DataFrame, rules=RULES, damping: float = 0.85, threshold: float = 0.5, tolerance: float = 0.01) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of each row of ``pages``.

    verdict is the action of the longest rule that fits; else ``block`` for a
    page of a host that :func:`blocked_hosts` finds and ``allow`` for any other,
    an empty host included. A host's excess of distrust counts as over the
    ``threshold`` if it is so by more than ``tolerance``. A null url, or one without ``://``, has an empty
    host and path; null html has no links; repeated rows are judged one by one;
    other columns are ignored.

    Rules are conditions of one projection (meant for up to some hundreds).
    Links are counted per pair of hosts before their shuffle; what iterates is
    of the size of the host graph.
    """
    url = F.col("url")
    cut = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    ruled = cut.withColumns({"rule": name, "action": action})
    bad = blocked_hosts(ruled, host_links(pages.select("url", "html")), damping, threshold, tolerance).withColumn("bad", F.lit(True))
    verdict = F.coalesce("action", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict")
    return ruled.join(bad, "host", "left").select("page_id", "host", "path", "rule", verdict)
