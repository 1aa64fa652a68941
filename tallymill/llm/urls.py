"""URL filter: allow and block rules, and for hosts without a rule trust and distrust over the link graph.

Trust is personalised PageRank from hosts whose pages a rule allows, along links; distrust starts at
hosts whose pages a rule blocks and runs against the links, to those who link to them.  Host edges are
links between hosts and, weaker, the step between a host and the site above it.  Pages are reduced to
host pairs by partial aggregation before anything is shuffled, so a hub or a hot host is a few rows.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.session import remove, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host with path prefix, verdict). The longest rule that fits wins.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
SCORES = "host string, kind string, score double"
#: Rounds after which the change is measured.
CHECK_EVERY = 10
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as (rule, verdict); else null. Rules are a short list and part of the plan."""
    cases = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        cases.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*cases, F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_edges(pages: DataFrame, *, html: str = "html", site_weight: float = 0.1) -> DataFrame:
    """(src, dst, weight): pages of src that link to dst, and each host with the host above it, both ways."""
    targets = F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(targets)).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    above = F.regexp_extract(F.col("host"), r"^[^.]+\.([^.]+\..+)$", 1)
    hosts = pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    site = hosts.select("host", above.alias("up"), (F.lit(site_weight) * F.col("n")).alias("weight")).where("up <> ''")
    down = site.select(F.col("up").alias("src"), F.col("host").alias("dst"), "weight")
    both = site.select(F.col("host").alias("src"), F.col("up").alias("dst"), "weight").union(down)
    return links.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _bucketed(df: DataFrame, keys: list[str], rows_a_bucket: int) -> tuple[DataFrame, int, str, str]:
    """The table written once, dealt and sorted by ``keys`` so that joins on them need not shuffle it; with its number of buckets, name and path."""
    spark = df.sparkSession
    path = scratch_path(spark, "moves")
    df.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // rows_a_bucket)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    dealt = rows.repartition(n, *keys) if n > 1 else rows.coalesce(1)
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", f"{path}/buckets").saveAsTable(name)
    return spark.table(name), n, name, path


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-10, rows_a_bucket: int = 1_000_000) -> DataFrame:
    """(host, kind, score) from seeds (host, kind, score); kind ``trust`` follows edges, ``distrust`` runs against them.

    A host hands on ``damping`` of its score in proportion to the weights of its edges and takes back
    the rest from its seed.  Both kinds go in one join and one aggregation a round, which reads the table of
    the round before and writes its own, so no plan grows; edges lie bucketed by where they start, so only
    scores and what is handed on are shuffled, and a round has as many tasks as the edges need.  Without ``rounds`` it goes on until the scores of all hosts
    together change by less than ``tolerance`` in a round; each round leaves ``damping`` of the change, so the
    number of rounds is bounded.  Without seeds the result is empty; hosts without edges keep what their seed gives.
    """
    spark = edges.sparkSession
    turned = edges.select(F.col("dst").alias("host"), F.col("src").alias("to"), "weight", F.lit("distrust").alias("kind"))
    moves = edges.select(F.col("src").alias("host"), F.col("dst").alias("to"), "weight", F.lit("trust").alias("kind")).union(turned)
    total = moves.groupBy("host", "kind").agg(F.sum("weight").alias("total"))
    shares = moves.join(total, ["host", "kind"]).select("host", "kind", "to", (F.col("weight") / F.col("total")).alias("share"))
    moves, parts, name, path = _bucketed(shares, ["host", "kind"], rows_a_bucket)

    def written(df: DataFrame, k: int) -> DataFrame:
        df.coalesce(parts).write.parquet(f"{path}/round-{k}")
        return spark.read.schema(SCORES).parquet(f"{path}/round-{k}")

    start = scores = written(seeds.select(F.col("host").cast("string"), F.col("kind").cast("string"), F.col("score").cast("double")), 0)
    mass = start.agg(F.sum("score")).first()[0] or 0.0
    most = rounds if rounds is not None else max(0, ceil(log(tolerance / max(2 * mass, tolerance)) / log(damping)))
    change = 2 * mass
    for k in range(1, most + 1):
        handed = moves.join(scores, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("share") * damping).alias("score"))
        before, scores = scores, written(handed.union(start.select("host", "kind", (F.col("score") * (1 - damping)).alias("score"))).groupBy("host", "kind").agg(F.sum("score").alias("score")), k)
        if rounds is None and (k % CHECK_EVERY == 0 or k == most):
            both = scores.union(before.select("host", "kind", -F.col("score")))
            change = both.groupBy("host", "kind").agg(F.abs(F.sum("score")).alias("d")).agg(F.sum("d")).first()[0] or 0.0
        if k > 1:
            remove(spark, f"{path}/round-{k - 1}")
        if rounds is None and change < tolerance:
            break
    spark.sql(f"DROP TABLE {name}")
    remove(spark, f"{path}/rows")
    remove(spark, f"{path}/buckets")
    return scores


def judge(pages: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, ratio: float = 1.0, default: str = "allow", url: str = "url", html: str = "html", key: str = "page_id", **how) -> DataFrame:
    """Per page: key, host, path, rule, verdict, by_method.

    Without a rule the verdict is the host's: ``block`` where distrust exceeds ``ratio`` times trust, else
    ``allow``; hosts that nothing reaches get ``default``.  A null url, or one without ``://``, has empty
    host and path and gets the default.  Null html has no links.  Every row is answered, repeated rows each.
    """
    rows = pages.select(F.col(key), F.col(url).alias("_url"), F.col(html).alias("_html")).withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    ruled = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("_rule.verdict") == verdict, 1.0).otherwise(0.0))
    by_host = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = by_host.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("trust", "distrust"))).alias("kind", "score")).where("score > 0")
    scores = propagate(host_edges(rows.select("host", F.col("_html").alias(html)), html=html), seeds, **how)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    blocked = of("distrust") > of("trust") * ratio + 1e-9
    hosts = scores.groupBy(F.col("host").alias("_host")).agg(F.when(blocked, "block").otherwise("allow").alias("_verdict"))
    judged = ruled.drop("_html", "_url").join(hosts, F.col("host") == F.col("_host"), "left")
    return judged.select(
        key,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.col("_verdict"), F.lit(default)).alias("verdict"),
        F.col("_rule").isNull().alias("by_method"),
    )
