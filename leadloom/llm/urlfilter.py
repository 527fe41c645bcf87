"""URL verdicts from rules and, where no rule fits, from the link graph.

Rules name a host (with its subdomains) and a path prefix; the longest that fits decides.
Other pages get the verdict of their host: trust flows from hosts with allowed pages along
host edges, distrust from hosts with blocked pages against them (a host that leads to
bad ones is suspect), both as personalised PageRank; a host is blocked where its distrust
is at least ``threshold`` of the two. Rounds go on until the changes of a round sum up to
less than ``TOLERANCE`` and no host was reached for the first time, however far it is. Edges are host names found in a page's markup
(links and plain mentions) that are hosts of pages themselves, weighted by pages.

Defined results: a NULL url or one without ``://`` has an empty host and path, fits no rule
and is allowed; hosts that neither flow reaches are allowed; NULL markup has no links; a
host's links to itself are not edges; repeated rows each get their verdict and count as
pages; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import freeze

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAMES = r"(?<![A-Za-z0-9.\-])[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
TOLERANCE = 1e-6  # of the two flows' mass of 1 each; what is still unsent is below 6 times that
DAMPING = 0.85


def url_parts(url: str) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` in lower case, path up to ``?`` or ``#``."""
    pattern = "(?s)://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(action, ``host/path``) pairs as rows; the host ends at the first slash."""
    rows = [F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"),
                     F.lit(rule.partition("/")[0].translate(str.maketrans(_UPPER, _LOWER))).alias("rule_host"),
                     F.lit("/" + rule.partition("/")[2]).alias("rule_path")) for action, rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits): for each host the rules of itself and of the domains above it."""
    tails = F.expr("transform(sequence(1, size(split(host, '[.]'))), "
                   "i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]')) - i + 1), '.'))")
    return (hosts.select("host", F.explode(tails).alias("rule_host")).join(rules, "rule_host")
            .groupBy("host").agg(F.collect_list(F.struct(
                F.length("rule").alias("size"), "rule", "action", F.col("rule_path").alias("path"))).alias("fits")))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): hosts named in the markup of a host's pages, by number of pages."""
    named = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all(
        F.coalesce("html", F.lit("")), F.lit(_NAMES), F.lit(0)))).alias("name"))
    named = named.select(F.col("host").alias("src"), F.translate("name", _UPPER, _LOWER).alias("dst"))
    counted = named.where("src <> dst AND src <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return counted.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")


def flow(hosts: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from (host, seed_trust, seed_distrust) and (src, dst, weight).

    Shares along edges are worked out once. Each round sends both flows in one pass and is
    written, so a lost executor never repeats earlier rounds. What reaches a host without
    further links stays there. Ends as the module says, by one aggregate a round.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("_out"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("_in"))
    shares = freeze(edges.join(out, "src").join(into, "dst").select(
        "src", "dst", (F.col("weight") / F.col("_out")).alias("down"),
        (F.col("weight") / F.col("_in")).alias("up")), "url-shares")
    state = freeze(hosts.select("host", "seed_trust", "seed_distrust", F.col("seed_trust").alias("trust"),
                                F.col("seed_distrust").alias("distrust")), "url-flow")
    while True:
        forward = shares.join(state.where("trust > 0"), F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("down")).alias("t"), F.lit(0.0).alias("d"))
        backward = shares.join(state.where("distrust > 0"), F.col("dst") == F.col("host")).select(
            F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("up")).alias("d"))
        got = forward.union(backward).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        sent = state.join(got, "host", "left").select(
            "host", "seed_trust", "seed_distrust", F.col("trust").alias("_t"), F.col("distrust").alias("_d"),
            ((1 - damping) * F.col("seed_trust") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            ((1 - damping) * F.col("seed_distrust") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"))
        state = freeze(sent.select(
            "host", "seed_trust", "seed_distrust", "trust", "distrust",
            (F.abs(F.col("trust") - F.col("_t")) + F.abs(F.col("distrust") - F.col("_d"))).alias("change"),
            (((F.col("_t") == 0) & (F.col("trust") > 0)) | ((F.col("_d") == 0) & (F.col("distrust") > 0)))
            .alias("reached")), "url-flow")
        moved = state.agg(F.sum("change").alias("change"), F.count_if("reached").alias("reached")).first()
        if (moved["change"] or 0.0) < tolerance and not moved["reached"]:
            break
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5,
          tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: one row per row of ``pages``."""
    host, path = url_parts("url")
    whole = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    narrow = freeze(whole.drop("html"), "url-pages")
    hosts = freeze(narrow.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages")), "url-hosts")
    fits = freeze(host_rules(hosts, rule_table(pages.sparkSession, rules)), "url-rules")
    best = F.array_max(F.filter("fits", lambda r: F.startswith(F.col("path"), r["path"])))
    judged = freeze(narrow.join(fits, "host", "left").withColumn("_best", best).select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"), F.col("_best.action").alias("action")),
        "url-judged")
    counts = judged.where("action IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("action") == "allow").alias("allowed"),
        F.count_if(F.col("action") == "block").alias("blocked"))
    sums = counts.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    seeds = hosts.join(counts, "host", "left").select(
        "host", (F.coalesce("allowed", F.lit(0)) / F.lit(float(sums["a"] or 1))).alias("seed_trust"),
        (F.coalesce("blocked", F.lit(0)) / F.lit(float(sums["b"] or 1))).alias("seed_distrust"))
    edges = freeze(host_edges(whole, hosts), "url-edges")
    scores = flow(seeds, edges, tolerance, damping)
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    own = F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("action", own).alias("verdict"), "trust", "distrust")
