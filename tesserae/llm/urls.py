"""URL filters: rules by host and path, and for all other pages trust and distrust propagated over the link graph.

Host edges are the links of pages to other hosts, and those between a host and the domain it belongs to, both ways: links
are resolved against the page, and one within its own host tells nothing of another. Trust is a personalised PageRank along them from seeds, the share of
a host's pages that rules allow; distrust runs against them from the share that rules block, so who links to blocked
hosts is distrusted. A host whose distrust passes its trust by THRESHOLD of their sum is blocked where no rule applies: both
scores shrink as more hosts share them, so only their relation tells the same at every size of the crawl.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, save

#: Rules of the query: (verdict, rule), a rule being a host, then the start of the path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Restart probability, bounds of the iterations (CLOSE as a share of a score), margin of distrust (as a share of both scores), and rules up to which they are one expression.
RESTART, ROUNDS, CLOSE, THRESHOLD, MOST_RULES = 0.15, 100, 1e-4, 0.05, 1000
#: Rounds of a table that is written.
AT_ONCE = 5
LINK = r"""(?i)<(?:a|area)\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""
BASE = r"""(?i)<base\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""
ABSOLUTE = r"(?i)^(?:https?:)?//([^/?#]+)"
#: Domains under which anyone can register: hosts below them are not of one owner (fixed values, the commonest of two parts).
SHARED = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.tr", "com.mx", "com.ar", "co.in", "co.za", "co.kr", "com.tw", "com.ua")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); both empty without ``://``."""
    after = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    raw_host = F.regexp_extract("_after", r"(?s)^[^/?#]*", 0)
    rest = F.expr("substring(_after, length(_raw) + 1)")
    return pages.withColumn("_after", after).withColumn("_raw", raw_host).withColumn("host", lower_ascii(F.col("_raw"))).withColumn("path", F.regexp_extract(rest, r"(?s)^[^?#]*", 0)).drop("_after", "_raw")


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits host and path (null: none); equally long: the first given.

    Up to MOST_RULES are one expression; more are a table (``ruled_by_table``), with the same result.
    """
    if len(rules) > MOST_RULES:
        table = pages.sparkSession.createDataFrame([(i, k, r) for i, (k, r) in enumerate(rules)], "no int, verdict string, rule string")
        return ruled_by_table(pages, table)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, r in sorted(reversed(rules), key=lambda x: len(x[1])):
        host, slash, path = r.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def ruled_by_table(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``ruled`` by any number of rules (no, verdict, rule), by joins on equal keys.

    A rule is keyed by its host and its whole path; a page of a distinct (host, path) by each suffix of its host with each
    beginning of its path that has the length of some rule's path. So a host with many rules makes no pairs with its pages.
    """
    keyed = rules.select("no", "verdict", "rule", F.substring_index("rule", "/", 1).alias("_host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("_path"))
    keyed = keyed.withColumn("_path", F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path")))
    lengths = sorted(r[0] for r in keyed.select(F.length("_path")).distinct().collect())  # at most the length of the longest rule
    first = keyed.groupBy("_host", "_path").agg(F.min_by(F.struct("rule", "verdict"), "no").alias("found"), F.min("no").alias("no"))
    urls = pages.select("host", "path").where("host is not null and path is not null").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    starts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = urls.select("host", "path", suffixes.alias("_host")).withColumn("_n", F.explode(starts)).withColumn("_path", F.expr("substring(path, 1, _n)"))
    longest = F.max_by("found", F.struct(F.length("found.rule"), -F.col("no")))
    best = keys.join(first, ["_host", "_path"]).groupBy("host", "path").agg(longest.alias("_found"))
    return pages.join(best, ["host", "path"], "left").select(*pages.columns, F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("rule_verdict"))


def node(host: Column) -> Column:
    """A host without user and port."""
    return lower_ascii(F.regexp_replace(host, r"^[^@]*@|:\d*$", ""))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst): the hosts of each link's page and target, a relative one resolved by the page's base or its own host."""
    absolute = lambda x: node(F.regexp_extract(x, ABSOLUTE, 1))
    base = absolute(F.coalesce(F.regexp_extract(html, BASE, 1), F.lit("")))
    found = pages.select(node(F.col("host")).alias("src"), base.alias("base"), F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("to"))
    own = F.when(F.col("base") != "", F.col("base")).otherwise(F.col("src"))
    other = F.col("to").rlike(r"(?i)^(?!https?:)[a-z][a-z0-9+.-]*:")  # mailto: and the like lead to no host
    return found.where("src <> ''").select("src", F.when(other, "").when(F.col("to").rlike(ABSOLUTE), absolute(F.col("to"))).otherwise(own).alias("dst"))


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): hosts that a host's pages link to, with the number of links; and one each way between a host and its parent domain."""
    linked = links(pages, html).where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select(node(F.col("host")).alias("host")).unionByName(linked.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    steps = hosts.where(~F.col("host").rlike(r"^[\d.]+$|[:\[]") & (F.size(labels) > 2)).select(F.explode(F.sequence(F.lit(1), F.size(labels) - 2)).alias("i"), labels.alias("l"))
    owned = steps.select(F.array_join(F.expr("slice(l, i, size(l))"), ".").alias("host"), F.array_join(F.expr("slice(l, i + 1, size(l))"), ".").alias("parent")).where(~F.col("parent").isin(*SHARED)).distinct()
    both = owned.select(F.col("host").alias("src"), F.col("parent").alias("dst")).unionByName(owned.select(F.col("parent").alias("src"), F.col("host").alias("dst")))
    return linked.unionByName(both.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, allow, block).

    A score is RESTART * seed + (1 - RESTART) * the sum of what hosts pass on by links: trust along them, distrust against
    them. Both go through one plan. Rows of a round are hosts with a score; sums combine before the shuffle. Ends once
    AT_ONCE rounds change no score by CLOSE of itself, so small scores of hosts far from seeds, or one of many, settle
    too; and after ``rounds``, when all that is still under way is (1 - RESTART)**rounds of the seeds.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n")
    both = both.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n"))
    out = both.groupBy("kind", "from").agg(F.sum("n").alias("all"))
    flow = save(both.join(out, ["kind", "from"]).select("kind", F.col("from").alias("host"), "to", (F.col("n") / F.col("all")).alias("w")), "flow")
    each = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("seed")))).alias("s")
    base = save(seeds.select("host", each).where("s.seed > 0").select("s.kind", "host", (F.col("s.seed") * RESTART).alias("score")), "seeds")
    score, table = base, None
    for _ in range(0, 0 if flow.isEmpty() or base.isEmpty() else rounds, AT_ONCE):
        new = score
        for _ in range(AT_ONCE):
            passed = new.join(flow.hint("merge"), ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("w") * (1 - RESTART)).alias("score"))
            new = base.unionByName(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        new = save(new.join(score.withColumnRenamed("score", "old"), ["kind", "host"], "left").select("kind", "host", "score", F.coalesce("old", F.lit(0.0)).alias("old")), "scores")
        if table is not None:
            discard(table)
        table, score = new, new.select("kind", "host", "score")
        if new.where(F.abs(F.col("score") - F.col("old")) > F.col("score") * CLOSE).isEmpty():
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return score.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of each page.

    Null or malformed urls have an empty host and path, no rule and are allowed: nothing is known of them. Null html has
    no links. Repeated rows weigh as often as they occur. Hosts without trust or distrust are allowed, and so are those
    whose margin is just THRESHOLD. A subdomain is one with its domain only by the edges between them, up to the domains
    of SHARED, which belong to nobody.
    """
    named = ruled(with_host(pages.select("page_id", "url", "html")), rules)
    hosts = named.select(node(F.col("host")).alias("host"), "rule_verdict").where("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("rule_verdict") == "allow", 1.0).otherwise(0.0)).alias("allow"), F.avg(F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0)).alias("block"))
    hosts = save(hosts, "hosts")
    edges = save(host_edges(with_host(pages.select("url", "html"))), "edges")
    scores = propagate(edges, hosts)
    scores = scores.withColumnRenamed("host", "_node")
    found = named.select("page_id", "host", "path", "rule", "rule_verdict", node(F.col("host")).alias("_node")).join(scores, "_node", "left").fillna(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") - F.col("trust") > (F.col("distrust") + F.col("trust")) * threshold, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "trust", "distrust")


def op3_link_graph(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
