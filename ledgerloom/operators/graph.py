"""The transaction graph as two tables: pair aggregates, node metrics, ranks, indicators, cycles, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.plans.catalog import query
from ledgerloom.plans.exact import quantiles
from ledgerloom.plans.stored import bucketed, discard
from ledgerloom.plans.stored import stored as kept
from ledgerloom.sources.adapters import TX, transactions

DAMPING, ROUNDS = 0.85, 20
FAN, FLOW, HIGH = 95, 95, 99
BUDGETS = (10, 50, 100)
#: Names of the patterns.
PATTERNS = ("high_fanout", "high_fanin", "net_flow_anomaly")


def pairs(rows: DataFrame) -> DataFrame:
    """One row per (src, dst): count, amounts, frauds, sorted distinct types."""
    return rows.groupBy(F.col("nameOrig").alias("src"), F.col("nameDest").alias("dst")).agg(
        F.count("*").alias("weight"), F.sum("amount").alias("total"), F.max("amount").alias("largest"), F.sum("isFraud").cast("long").alias("frauds"), F.array_sort(F.collect_set("type")).alias("types")
    )


PAIRS = f"{TX}, pairs AS (SELECT nameOrig AS src, nameDest AS dst, count(*) AS weight, sum(amount) AS total, max(amount) AS largest, CAST(sum(isFraud) AS BIGINT) AS frauds, list_sort(list(DISTINCT type)) AS types FROM tx GROUP BY 1, 2)"


@query("agg12_gr01_pairs", f"WITH {PAIRS} SELECT src, dst, weight, round(total, 2) AS total, round(total / weight, 9) AS mean, largest, frauds, array_to_string(types, ',') AS types FROM pairs")
def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(transactions(spark, sf_dir))
    return rows.select("src", "dst", "weight", F.round("total", 2).alias("total"), F.round(F.col("total") / F.col("weight"), 9).alias("mean"), "largest", "frauds", F.array_join("types", ",").alias("types"))


def nodes(edges: DataFrame) -> DataFrame:
    """Per account: degrees, neighbours, amounts, net flow; one pass over both ends of the pairs."""
    names = ("account", "out", "in", "w_out", "w_in", "sent", "received", "f_out", "f_in")
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    as_source = (F.col("src"), one, none, F.col("weight"), none, F.col("total"), F.lit(0.0), F.col("frauds"), none)
    as_target = (F.col("dst"), none, one, none, F.col("weight"), F.lit(0.0), F.col("total"), none, F.col("frauds"))
    ends = edges.select(F.inline(F.array(*[F.struct(*[c.alias(n) for c, n in zip(side, names, strict=True)]) for side in (as_source, as_target)])))
    sums = ends.groupBy("account").agg(*[F.sum(c).alias(c) for c in ("out", "in", "w_out", "w_in", "sent", "received", "f_out", "f_in")])
    return sums.withColumn("net_flow", F.round(F.col("received") - F.col("sent"), 2))


NODES = f"""{PAIRS}, ends AS (SELECT src AS account, 1 AS o, 0 AS i, weight AS w_out, 0 AS w_in, total AS sent, 0::DOUBLE AS received, frauds AS f_out, 0 AS f_in FROM pairs UNION ALL SELECT dst, 0, 1, 0, weight, 0::DOUBLE, total, 0, frauds FROM pairs),
nodes AS (SELECT account, CAST(sum(o) AS BIGINT) AS "out", CAST(sum(i) AS BIGINT) AS "in", CAST(sum(w_out) AS BIGINT) AS w_out, CAST(sum(w_in) AS BIGINT) AS w_in, sum(sent) AS sent, sum(received) AS received, CAST(sum(f_out) AS BIGINT) AS f_out, CAST(sum(f_in) AS BIGINT) AS f_in, round(sum(received) - sum(sent), 2) AS net_flow FROM ends GROUP BY account)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(transactions(spark, sf_dir))


@query("gr02_prj21_node_metrics", f"""WITH {NODES} SELECT account, CASE WHEN account LIKE 'M%' THEN 'merchant' ELSE 'client' END AS kind, "out" AS unique_destinations, "in" AS unique_sources, w_out, w_in, round("out" / nullif((SELECT count(*) FROM nodes) - 1, 0), 9) AS out_centrality, round("in" / nullif((SELECT count(*) FROM nodes) - 1, 0), 9) AS in_centrality, round(sent, 2) AS sent, round(received, 2) AS received, net_flow FROM nodes""")
def node_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes(graph(spark, sf_dir))
    n = F.broadcast(found.agg(F.count("*").alias("n")))
    each = found.crossJoin(n)
    return each.select("account", C.fan_type(F.col("account")).alias("kind"), F.col("out").alias("unique_destinations"), F.col("in").alias("unique_sources"), "w_out", "w_in", *[F.round(C.ratio(F.col(c), F.col("n") - 1), 9).alias(f"{c}_centrality") for c in ("out", "in")], F.round("sent", 2).alias("sent"), F.round("received", 2).alias("received"), "net_flow")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and their counts only: what ranks go by."""
    return transactions(spark, sf_dir).groupBy(F.col("nameOrig").alias("src"), F.col("nameDest").alias("dst")).agg(F.count("*").alias("weight"))


def ends(edges: DataFrame) -> DataFrame:
    """Per account: sources, and transactions sent."""
    none = F.lit(0).cast("long")
    both = edges.select(F.inline(F.array(F.struct(F.col("src").alias("account"), none.alias("in"), F.col("weight").alias("w_out")), F.struct(F.col("dst").alias("account"), F.lit(1).cast("long").alias("in"), none.alias("w_out")))))
    return both.groupBy("account").agg(F.sum("in").alias("in"), F.sum("w_out").alias("w_out"))


#: A run to its end stops once a round moves less than this in all, or after so many rounds.
CONVERGED, MOST_ROUNDS = 1e-6, 100


def pagerank(edges: DataFrame, found: DataFrame, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """Weighted PageRank with evenly spread dangling mass; each round is written, so plans stay short.

    It ends after ``rounds``, or before that once a round moves less than ``tolerance`` in all, if one is given.
    Accounts that receive nothing all have one rank in each round, so what they give to an account is one sum of shares,
    and only pairs between accounts that receive take part in the rounds. Shares lie in buckets of their source and ranks in
    buckets of their account, so that a round exchanges nothing but what accounts are given, summed by each task before.
    """
    found = kept(found.select("account", "w_out", (F.col("in") > 0).alias("receives")), "ranked-nodes")
    seen = found.agg(F.count("*").alias("n"), F.count_if(~F.col("receives")).alias("only_give")).first()
    n, only_give = seen["n"], seen["only_give"]
    if not n:
        return found.select("account", F.lit(0.0).alias("rank"))
    buckets = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = F.when(F.col("receives"), F.col("src")).alias("src")  # null: one of those that only give
    each = edges.select("src", "dst", "weight").join(found.select(F.col("account").alias("src"), "w_out", "receives"), "src").select(source, "dst", (F.col("weight") / F.col("w_out")).alias("share"))
    summed = kept(each.groupBy("src", "dst").agg(F.sum("share").alias("share")), "shares")
    shares = bucketed(summed.where("src is not null"), "shares", "src", buckets)
    fixed = summed.where("src is null").select(F.col("dst").alias("account"), F.col("share").alias("fixed"))
    start = found.where("receives").select("account", (F.col("w_out") == 0).alias("dangling")).join(fixed, "account", "left")
    ranks = bucketed(start.select("account", "dangling", F.coalesce("fixed", F.lit(0.0)).alias("fixed"), F.lit(1.0 / n).alias("rank"), F.lit(None).cast("double").alias("moved")), "ranks", "account", buckets)
    discard(summed)
    giver, giver_moved = 1.0 / n, 0.0
    for _ in range(rounds):
        seen = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"), F.sum("moved").alias("moved")).first()
        if tolerance is not None and seen["moved"] is not None and seen["moved"] + only_give * giver_moved < tolerance:
            break
        before, ranks = ranks, bucketed(round_of(shares, ranks, n, seen["lost"], giver), "ranks", "account", buckets)
        new = (1 - DAMPING) / n + DAMPING * (seen["lost"] / n)
        giver, giver_moved = new, abs(new - giver)
        discard(before)
    discard(shares)
    return ranks.select("account", "rank").union(found.where("not receives").select("account", F.lit(giver)))


def round_of(shares: DataFrame, ranks: DataFrame, n: int, lost: float, giver: float | None = None) -> DataFrame:
    """Ranks after one more round, and how far each has moved; ``giver`` is the rank of accounts that only give, if their shares are summed in ``fixed``."""
    fixed = F.lit(0.0) if giver is None else F.lit(giver) * F.col("fixed")
    given = shares.join(ranks.select(F.col("account").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("account")).agg(F.sum(F.col("share") * F.col("rank")).alias("given"))
    new = (1 - DAMPING) / n + DAMPING * (F.lit(lost) / n + fixed + F.coalesce("given", F.lit(0.0)))
    return ranks.join(given, "account", "left").select(*[c for c in ranks.columns if c not in ("rank", "moved")], new.alias("rank"), F.abs(new - F.col("rank")).alias("moved"))


RANKED = f"""RECURSIVE {NODES}, shares AS MATERIALIZED (SELECT src, dst, weight::DOUBLE / w_out AS share FROM pairs JOIN nodes ON src = account), n AS (SELECT count(*)::DOUBLE AS n FROM nodes),
r0 AS (SELECT account, w_out = 0 AS dangling, 1 / n AS rank FROM nodes, n)""" + "".join(
    f""", g{k} AS (SELECT dst, sum(share * rank) AS given FROM shares JOIN r{k} ON src = account GROUP BY dst),
r{k + 1} AS MATERIALIZED (SELECT account, dangling, {1 - DAMPING!r} / n + {DAMPING} * ((SELECT coalesce(sum(rank) FILTER (WHERE dangling), 0) FROM r{k}) / n + coalesce(given, 0)) AS rank FROM r{k} LEFT JOIN g{k} ON dst = account, n)"""
    for k in range(ROUNDS)
)


@query("gr03_pagerank", f"WITH {RANKED} SELECT account, round(rank, 12) AS pagerank FROM r{ROUNDS}")
def pagerank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = kept(weights(spark, sf_dir), "pairs")
    return pagerank(edges, ends(edges)).select("account", F.round("rank", 12).alias("pagerank"))


@query("gr03_pagerank_converged")
def converged_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks run to their end."""
    edges = kept(weights(spark, sf_dir), "pairs")
    return pagerank(edges, ends(edges), MOST_ROUNDS, CONVERGED).select("account", F.col("rank").alias("pagerank"))


FLAG_STEPS = f""", t AS (SELECT quantile_cont("out", {FAN / 100}) AS o, quantile_cont("in", {FAN / 100}) AS i, quantile_cont(net_flow, {FLOW / 100}) AS hi, quantile_cont(net_flow, {1 - FLOW / 100:.2f}) AS lo FROM nodes),
flags AS (SELECT account, list_filter([CASE WHEN "out" > o THEN 'high_fanout' END, CASE WHEN "in" > i THEN 'high_fanin' END, CASE WHEN net_flow > hi OR net_flow < lo THEN 'net_flow_anomaly' END], lambda x: x IS NOT NULL) AS patterns, CAST((CASE WHEN "out" > o THEN f_out ELSE 0 END) + (CASE WHEN "in" > i THEN f_in ELSE 0 END) AS BIGINT) AS frauds, sent + received AS volume FROM nodes, t)"""
FLAGS = NODES + FLAG_STEPS


def indicators(found: DataFrame, fan: int = FAN, high: int = FLOW) -> DataFrame:
    """Accounts with the patterns that they show; a value has to exceed its percentile over all accounts."""
    (o,), (i,) = (quantiles(found, c, [fan / 100])[None] for c in ("out", "in"))
    most, least = quantiles(found, "net_flow", [high / 100, round(1 - high / 100, 2)])[None]
    limits = [F.lit(x).cast("double") for x in (o, i, most, least)]
    out, into = F.col("out") > limits[0], F.col("in") > limits[1]
    flow = (F.col("net_flow") > limits[2]) | (F.col("net_flow") < limits[3])
    patterns = F.array_compact(F.array(*[F.when(shown, name) for shown, name in zip((out, into, flow), PATTERNS, strict=True)]))
    frauds = F.when(out, F.col("f_out")).otherwise(0) + F.when(into, F.col("f_in")).otherwise(0)
    return found.select("account", patterns.alias("patterns"), frauds.cast("long").alias("frauds"), (F.col("sent") + F.col("received")).alias("volume"))


@query("gr06_gr07_gr10_gr11_indicators", f"WITH {RANKED}{FLAG_STEPS} SELECT account, array_to_string(patterns, ',') AS patterns, CAST(len(patterns) AS BIGINT) AS n_patterns, frauds, round(rank, 12) AS pagerank FROM flags JOIN r{ROUNDS} USING (account) WHERE len(patterns) > 0")
def suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = kept(graph(spark, sf_dir).drop("types", "largest"), "pairs")
    found = kept(nodes(edges), "nodes")
    flags = indicators(found).where(F.size("patterns") > 0)
    joined = flags.join(pagerank(edges, found), "account")
    return joined.select("account", F.array_join("patterns", ",").alias("patterns"), F.size("patterns").cast("long").alias("n_patterns"), "frauds", F.round("rank", 12).alias("pagerank"))


def network_order(flags: DataFrame, ranks: DataFrame) -> DataFrame:
    """(account, n, pagerank, volume) of all accounts: number of patterns, then PageRank, are what the network ranking goes by."""
    joined = flags.join(ranks, "account", "left")
    return joined.select("account", F.size("patterns").alias("n"), F.round(F.coalesce("rank", F.lit(0.0)), 12).alias("pagerank"), F.round("volume", 2).alias("volume"))


@query("gr09_high_value_pairs", f"WITH {PAIRS} SELECT src, dst, round(total, 2) AS total, weight FROM pairs WHERE total > (SELECT quantile_cont(total, {HIGH / 100}) FROM pairs)")
def high_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = kept(graph(spark, sf_dir), "pairs")
    (limit,) = quantiles(edges, "total", [HIGH / 100])[None]
    return edges.where(F.col("total") > F.lit(limit).cast("double")).select("src", "dst", F.round("total", 2).alias("total"), "weight")


def islands(edges: DataFrame) -> DataFrame:
    """(account, label): accounts of one component have one label.

    Accounts are numbered by hash; their names serve where two of them share a hash. Every account takes the least number around
    it as label, and links between labels form the next, smaller graph, until none are left; then labels of all rounds are joined.
    An island that has one label has no links any more and takes no part in later rounds.
    """
    accounts = kept(edges.select(F.explode(F.array("src", "dst")).alias("account")).distinct(), "accounts")
    seen = accounts.agg(F.count("*").alias("n"), F.count_distinct(number("account")).alias("numbers")).first()
    of = number if seen["n"] == seen["numbers"] else F.col
    link = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = kept(edges.where("src <> dst").select(*link(of("src"), of("dst"))).distinct(), "links")
    rounds: list[DataFrame] = []
    while not rounds or not links.isEmpty():
        both = links.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))
        near = kept(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")), "labels")
        rounds.append(near)
        step = links.join(near.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(near.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        before, links = links, kept(step.where("la <> lb").select(*link(F.col("la"), F.col("lb"))).distinct(), "links")
        discard(before)
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("label"), F.col("label").alias("next"))
        found = rounds.pop().join(later, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return accounts.withColumn("node", of("account")).join(found, "node", "left").select("account", F.coalesce("label", "node").alias("label"))


def number(account: str) -> Column:
    return F.xxhash64(account)


def components(edges: DataFrame) -> DataFrame:
    """(account, component): the least name that each account reaches."""
    labelled = kept(islands(edges), "islands")
    least = labelled.groupBy("label").agg(F.min("account").alias("component"))
    return labelled.join(least, "label").select("account", "component")


#: The least account that each account reaches, by labels that spread until none falls.
COMPONENTS = f"""RECURSIVE {NODES}, link AS MATERIALIZED (SELECT src AS a, dst AS b FROM pairs UNION SELECT dst, src FROM pairs),
reach(account, component) USING KEY (account) AS (SELECT account, account FROM nodes UNION SELECT link.b, min(reach.component) FROM reach JOIN link ON link.a = reach.account JOIN recurring.reach AS now ON now.account = link.b WHERE reach.component < now.component GROUP BY link.b),
sizes AS (SELECT count(*) AS n FROM reach GROUP BY component)"""


def component_sizes(edges: DataFrame) -> DataFrame:
    """One row: how many weak components there are, the accounts of the largest and their share of all."""
    sizes = islands(edges).groupBy("label").agg(F.count("*").alias("n"))
    found = sizes.agg(F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_component"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"))
    share = F.coalesce(C.ratio(F.col("largest_component"), F.col("nodes")), F.lit(0.0))
    return found.select("components", "largest_component", F.round(share, 9).alias("largest_share"))


@query("gr04_summary", f"""WITH {COMPONENTS} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM pairs) AS edges, round((SELECT count(*) FROM pairs) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1.0)), 9) AS density, (SELECT count(*) FROM sizes) AS components, (SELECT max(n) FROM sizes) AS largest_component, round((SELECT max(n) / sum(n) FROM sizes), 9) AS largest_share, round((SELECT avg("in" + "out") FROM nodes), 6) AS mean_degree, CAST((SELECT max("in" + "out") FROM nodes) AS BIGINT) AS max_degree, (SELECT count(*) FROM nodes WHERE account LIKE 'M%') AS merchants, (SELECT count(*) FROM pairs WHERE frauds > 0) AS fraud_pairs""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the graph, its degrees and weak components."""
    edges = kept(graph(spark, sf_dir).select("src", "dst", "weight", "total", "frauds"), "pairs")
    found = nodes(edges)
    degree = F.col("in") + F.col("out")
    of_nodes = found.agg(F.count("*").alias("nodes"), F.round(F.avg(degree), 6).alias("mean_degree"), F.max(degree).alias("max_degree"), F.count_if(F.col("account").startswith("M")).alias("merchants"))
    of_edges = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("frauds") > 0).alias("fraud_pairs"))
    density = F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1.0)), 9)
    one = of_nodes.crossJoin(of_edges).crossJoin(component_sizes(edges))
    return one.select("nodes", "edges", density.alias("density"), "components", "largest_component", "largest_share", "mean_degree", "max_degree", "merchants", "fraud_pairs")


#: An account graph of several islands: every customer is an account of its own and links to one 25, 50 or 75 further.
ISLANDS = "links AS (SELECT 'C' || c_custkey AS src, 'C' || (c_custkey + 25 * (1 + c_custkey % 3)) AS dst FROM customer)"


@query("gr04_components", f"WITH RECURSIVE {ISLANDS}, link AS MATERIALIZED (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links), reach(account, component) USING KEY (account) AS (SELECT DISTINCT a, a FROM link UNION SELECT link.b, min(reach.component) FROM reach JOIN link ON link.a = reach.account JOIN recurring.reach AS now ON now.account = link.b WHERE reach.component < now.component GROUP BY link.b), sizes AS (SELECT count(*) AS n FROM reach GROUP BY component) SELECT count(*) AS components, max(n) AS largest_component, round(max(n) / sum(n), 9) AS largest_share FROM sizes")
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a graph of all customers that has many."""
    from ledgerloom.sources.adapters import table

    key = F.col("c_custkey")
    return component_sizes(table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), key).alias("src"), F.concat(F.lit("C"), key + 25 * (1 + key % 3)).alias("dst")))


def cycle_core(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Pairs whose ends both send and receive; accounts that can't lie on a cycle are dropped so many times."""
    core = edges
    for _ in range(rounds):
        both = core.select(F.col("src").alias("x")).intersect(core.select(F.col("dst").alias("x")))
        core = kept(core.join(both.withColumnRenamed("x", "src"), "src", "left_semi").join(both.withColumnRenamed("x", "dst"), "dst", "left_semi").select(*edges.columns), "core")
    return core


def simple_cycles(edges: DataFrame) -> DataFrame:
    """(v, total, frauds) of all simple cycles of up to four accounts in pairs (src, dst, total, frauds).

    Each cycle is found at its account of highest degree, ``top``. Paths of two steps out of and into it through
    accounts of lower degree number, per link, at most the lesser degree of its ends, so a hub's neighbours are
    never paired with each other; a cycle of three closes such a path with a pair, one of four joins two paths with the same ends.
    Paths carry accounts only; sums are joined to the links of the cycles that are found.
    """
    core = cycle_core(edges.select("src", "dst", "total", "frauds"))
    degree = kept(core.select(F.explode(F.array("src", "dst")).alias("x")).groupBy("x").agg(F.count("*").alias("d")), "degrees")
    ranked = core.select("src", "dst").join(degree.select(F.col("x").alias("src"), F.struct("d", "x").alias("rs")), "src").join(degree.select(F.col("x").alias("dst"), F.struct("d", "x").alias("rd")), "dst")
    ranked = kept(ranked, "ranked")
    down, up, apart = ranked.where("rs > rd"), ranked.where("rs < rd"), ranked.where("src <> dst")
    ones = core.where("src = dst").select(F.array("src").alias("v"))
    twos = down.alias("a").join(up.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).select(F.array("a.src", "a.dst").alias("v"))
    # top -> near -> far, and far -> near -> top.
    out = kept(down.alias("a").join(apart.alias("b"), F.col("a.dst") == F.col("b.src")).where("b.rd < a.rs").select(F.col("a.src").alias("top"), F.col("a.dst").alias("near"), F.col("b.dst").alias("far")), "paths-out")
    # Only paths back from where a path out ends can close a cycle.
    ends = out.select("top", "far").distinct()
    into = up.alias("b").join(apart.alias("a"), F.col("a.dst") == F.col("b.src")).where("a.rs < b.rd").select(F.col("b.dst").alias("top"), F.col("b.src").alias("near"), F.col("a.src").alias("far"))
    into = kept(into.join(ends, ["top", "far"], "left_semi"), "paths-into")
    threes = out.alias("a").join(up.alias("b"), (F.col("a.far") == F.col("b.src")) & (F.col("a.top") == F.col("b.dst"))).select(F.array("a.top", "a.near", "a.far").alias("v"))
    fours = out.alias("a").join(into.alias("b"), (F.col("a.top") == F.col("b.top")) & (F.col("a.far") == F.col("b.far")) & (F.col("a.near") != F.col("b.near"))).select(F.array("a.top", "a.near", "a.far", "b.near").alias("v"))
    found = kept(ones.union(twos).union(threes).union(fours), "cycles")
    link = F.explode(F.transform("v", lambda x, i: F.struct(x.alias("src"), F.element_at("v", ((i + 1) % F.size("v") + 1).cast("int")).alias("dst")))).alias("l")
    return found.select("v", link).select("v", "l.src", "l.dst").join(core, ["src", "dst"]).groupBy("v").agg(F.sum("total").alias("total"), F.sum("frauds").alias("frauds"))


@query("gr08_cycles", f"WITH {PAIRS}, c AS (SELECT [src] AS v, total, frauds FROM pairs WHERE src = dst UNION ALL SELECT [a.src, b.src], a.total + b.total, a.frauds + b.frauds FROM pairs a JOIN pairs b ON a.dst = b.src AND b.dst = a.src WHERE a.src < b.src UNION ALL SELECT [a.src, b.src, c.src], a.total + b.total + c.total, a.frauds + b.frauds + c.frauds FROM pairs a JOIN pairs b ON a.dst = b.src JOIN pairs c ON b.dst = c.src AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src AND b.src <> c.src UNION ALL SELECT [a.src, b.src, c.src, d.src], a.total + b.total + c.total + d.total, a.frauds + b.frauds + c.frauds + d.frauds FROM pairs a JOIN pairs b ON a.dst = b.src JOIN pairs c ON b.dst = c.src JOIN pairs d ON c.dst = d.src AND d.dst = a.src WHERE a.src < b.src AND a.src < c.src AND a.src < d.src AND b.src <> c.src AND b.src <> d.src AND c.src <> d.src) SELECT array_to_string(list_sort(v), '>') AS accounts, CAST(len(v) AS BIGINT) AS length, count(*) AS orders, round(max(total), 2) AS largest_total, CAST(max(frauds) AS BIGINT) AS most_frauds FROM c GROUP BY 1, 2")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple cycles of up to four accounts by node set."""
    found = simple_cycles(graph(spark, sf_dir))
    return found.groupBy(F.array_join(F.array_sort("v"), ">").alias("accounts"), F.size("v").cast("long").alias("length")).agg(F.count("*").alias("orders"), F.round(F.max("total"), 2).alias("largest_total"), F.max("frauds").alias("most_frauds"))


@query("gr05_jn07_jn08_ego_graph", f"WITH {PAIRS}, hub AS (SELECT min(src) AS a FROM pairs), ego AS (SELECT a FROM hub UNION SELECT dst FROM pairs, hub WHERE src = a UNION SELECT src FROM pairs, hub WHERE dst = a) SELECT src, dst, weight, round(total, 2) AS total FROM pairs WHERE src IN (SELECT a FROM ego) AND dst IN (SELECT a FROM ego)")
def ego_graph(spark: SparkSession, sf_dir: str, depth: int = 1) -> DataFrame:
    edges = kept(graph(spark, sf_dir), "pairs")
    return ego(edges, edges.agg(F.min("src")).first()[0], depth, most=None)


def ego(edges: DataFrame, account: str | None, depth: int = 1, most: int | None = 500) -> DataFrame:
    """Pairs among an account and all accounts within ``depth`` steps either way; more than ``most`` accounts are refused, as a view of them tells nothing."""
    reached = edges.select(F.explode(F.array("src", "dst")).alias("account")).where(F.col("account") == F.lit(account)).distinct()
    for _ in range(depth):
        out = edges.join(reached.withColumnRenamed("account", "src"), "src").select(F.col("dst").alias("account"))
        into = edges.join(reached.withColumnRenamed("account", "dst"), "dst").select(F.col("src").alias("account"))
        reached = kept(reached.union(out).union(into).distinct(), "reached")
    if most is not None and (n := reached.count()) > most:
        raise ValueError(f"{n} accounts lie within {depth} steps of {account}; {most} at most are shown")
    inner = edges.join(reached.withColumnRenamed("account", "src"), "src", "left_semi").join(reached.withColumnRenamed("account", "dst"), "dst", "left_semi")
    return inner.select("src", "dst", "weight", F.round("total", 2).alias("total"))


@query("gr08_largest_cycles", f"WITH {PAIRS}, c AS (SELECT [src] AS v, total, frauds FROM pairs WHERE src = dst UNION ALL SELECT [a.src, b.src], a.total + b.total, a.frauds + b.frauds FROM pairs a JOIN pairs b ON a.dst = b.src AND b.dst = a.src WHERE a.src < b.src UNION ALL SELECT [a.src, b.src, c.src], a.total + b.total + c.total, a.frauds + b.frauds + c.frauds FROM pairs a JOIN pairs b ON a.dst = b.src JOIN pairs c ON b.dst = c.src AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src AND b.src <> c.src UNION ALL SELECT [a.src, b.src, c.src, d.src], a.total + b.total + c.total + d.total, a.frauds + b.frauds + c.frauds + d.frauds FROM pairs a JOIN pairs b ON a.dst = b.src JOIN pairs c ON b.dst = c.src JOIN pairs d ON c.dst = d.src AND d.dst = a.src WHERE a.src < b.src AND a.src < c.src AND a.src < d.src AND b.src <> c.src AND b.src <> d.src AND c.src <> d.src), g AS (SELECT array_to_string(list_sort(v), '>') AS accounts, CAST(len(v) AS BIGINT) AS length, round(max(total), 2) AS largest_total, CAST(max(frauds) AS BIGINT) AS most_frauds FROM c GROUP BY 1, 2) SELECT * FROM g ORDER BY largest_total DESC, accounts LIMIT 100")
def largest_cycles(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    """The cycles of greatest total, each node set once: a top-k report."""
    return cycles(spark, sf_dir).drop("orders").orderBy(F.desc("largest_total"), "accounts").limit(limit)


@query("gr15_neighbourhood", f"WITH {PAIRS}, hub AS (SELECT min(dst) AS a FROM pairs) SELECT 'in' AS direction, src AS other, weight, round(total, 2) AS total FROM pairs, hub WHERE dst = a UNION ALL SELECT 'out', dst, weight, round(total, 2) FROM pairs, hub WHERE src = a")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph(spark, sf_dir)
    hub = F.broadcast(edges.agg(F.min("dst").alias("hub")))
    near = edges.crossJoin(hub).where("src = hub or dst = hub")
    sides = F.array(F.when(F.col("dst") == F.col("hub"), F.struct(F.lit("in").alias("direction"), F.col("src").alias("other"))), F.when(F.col("src") == F.col("hub"), F.struct(F.lit("out").alias("direction"), F.col("dst").alias("other"))))
    return near.select(F.inline(F.array_compact(sides)), "weight", F.round("total", 2).alias("total")).orderBy(F.desc("total"), "other")


@query("gr13_ord01_volume_ranking", f"WITH {NODES} SELECT account, round(sent + received, 2) AS volume FROM nodes ORDER BY volume DESC, account LIMIT 100")
def volume_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred accounts of largest volume: a top-k report."""
    return nodes(graph(spark, sf_dir)).select("account", F.round(F.col("sent") + F.col("received"), 2).alias("volume")).orderBy(F.desc("volume"), "account").limit(max(BUDGETS))


@query("ord03_top_accounts", f"""WITH {NODES} SELECT account, "in" AS unique_sources FROM nodes ORDER BY "in" DESC, account LIMIT 20""")
def top_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(graph(spark, sf_dir)).select("account", F.col("in").alias("unique_sources")).orderBy(F.desc("unique_sources"), "account").limit(20)


def effective_budgets(asked: tuple[int, ...], accounts: int) -> list[int]:
    """Budgets no greater than the number of accounts, each once, rising; none without accounts."""
    if any(isinstance(k, bool) or not isinstance(k, int) or k < 1 for k in asked) or not asked:
        raise ValueError("budgets have to be positive integers")
    return sorted({min(k, accounts) for k in asked}) if accounts else []


#: Ratios of a selection: numerator, denominator, and why there is none.
RATIOS = {
    "account_precision": ("positives_selected", "selected", "no accounts selected"),
    "account_recall": ("positives_selected", "positives", "no positive accounts"),
    "precision": ("frauds_covered", "covered", "no transaction covered"),
    "fraud_coverage": ("frauds_covered", "frauds", "no frauds"),
}


def compared(rows: DataFrame, ranked: DataFrame, budgets: tuple[int, ...] | list[int] = BUDGETS) -> DataFrame:
    """What the first k accounts of each ranking cover of the transactions, the frauds and the accounts with frauds, and how the network's ratios differ.

    ``ranked`` has (method, account, place) of at most the largest budget's rows a method, so both lookups are broadcast.
    A transaction counts once for both its ends.
    """
    if not budgets:
        raise ValueError("there are no accounts to choose from")
    methods = ("network", "volume")
    places = ranked.groupBy("account").agg(*[F.min(F.when(F.col("method") == m, F.col("place"))).alias(m) for m in methods])
    src, dst = (F.broadcast(places.select(F.col("account").alias(k), *[F.col(m).alias(f"{k}_{m}") for m in methods])) for k in ("nameOrig", "nameDest"))
    joined = rows.join(src, "nameOrig", "left").join(dst, "nameDest", "left")
    fraud = F.col("isFraud") == 1
    within = {(m, k): F.least(f"nameOrig_{m}", f"nameDest_{m}") <= k for m in methods for k in budgets}
    covers = [F.struct(F.lit(m).alias("method"), F.lit(k).cast("long").alias("budget"), F.count_if(x).alias("covered"), F.count_if(x & fraud).alias("frauds_covered")) for (m, k), x in within.items()]
    of_rows = joined.agg(F.coalesce(F.sum("isFraud"), F.lit(0)).cast("long").alias("frauds"), F.array(*covers).alias("r")).select("frauds", F.inline("r"))
    ends = joined.where(fraud).select(F.inline(F.array(*[F.struct(F.col(k).alias("account"), *[F.col(f"{k}_{m}").alias(m) for m in methods]) for k in ("nameOrig", "nameDest")]))).distinct()
    hits = [F.struct(F.lit(m).alias("method"), F.lit(k).cast("long").alias("budget"), F.count_if(F.col(m) <= k).alias("positives_selected")) for m in methods for k in budgets]
    of_accounts = ends.agg(F.count("*").alias("positives"), F.array(*hits).alias("r")).select("positives", F.inline("r"))
    chosen = [F.struct(F.lit(m).alias("method"), F.lit(k).cast("long").alias("budget"), F.count_if((F.col("method") == m) & (F.col("place") <= k)).alias("selected")) for m in methods for k in budgets]
    selected = ranked.agg(F.array(*chosen).alias("r")).select(F.inline("r"))
    one = of_rows.join(F.broadcast(of_accounts), ["method", "budget"]).join(F.broadcast(selected), ["method", "budget"])  # a row a method and budget
    ratios = {name: F.round(C.ratio(F.col(a), F.col(b)), 9) for name, (a, b, _) in RATIOS.items()}
    reasons = F.nullif(F.concat_ws("; ", *[F.when(F.col(b) == 0, F.lit(f"{name}: {why}")) for name, (_, b, why) in RATIOS.items()]), F.lit(""))
    whole = one.select("method", "budget", "selected", "positives_selected", "covered", "frauds_covered", *[r.alias(n) for n, r in ratios.items()], reasons.alias("null_reasons"))
    other = F.broadcast(whole.where("method = 'volume'").select("budget", *[F.col(n).alias(f"volume_{n}") for n in RATIOS]))
    differences = [F.when(F.col("method") == "network", F.round(F.col(n) - F.col(f"volume_{n}"), 9)).alias(f"{n}_difference") for n in RATIOS]
    return whole.join(other, "budget").select(*whole.columns, *differences)


LARGEST = max(BUDGETS)


_COMPARED = ", ".join(f"round({a} / nullif({b}, 0), 9) AS {n}" for n, (a, b, _) in RATIOS.items())
_REASONS = "nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {b} = 0 THEN '{n}: {why}' END" for n, (_, b, why) in RATIOS.items()) + "), '')"


@query("gr12_gr14_agg43_jn03_comparison", f"""WITH {RANKED}{FLAG_STEPS}, pos AS MATERIALIZED (SELECT nameOrig AS account FROM tx WHERE isFraud = 1 UNION SELECT nameDest FROM tx WHERE isFraud = 1),
ranked AS MATERIALIZED (SELECT 'network' AS method, account, row_number() OVER (ORDER BY len(patterns) DESC, round(rank, 12) DESC, account) AS place FROM flags JOIN r{ROUNDS} USING (account) UNION ALL SELECT 'volume', account, row_number() OVER (ORDER BY round(volume, 2) DESC, account) FROM flags),
b(k) AS (SELECT DISTINCT least(x, (SELECT count(*) FROM nodes)) FROM (VALUES {', '.join(f'({k})' for k in BUDGETS)}) v(x)),
p AS (SELECT a.method, least(a.place, c.place) AS place, isFraud FROM tx JOIN ranked a ON a.account = nameOrig JOIN ranked c ON c.account = nameDest AND c.method = a.method),
c AS (SELECT method, k, count(*) AS covered, CAST(sum(isFraud) AS BIGINT) AS frauds_covered FROM p, b WHERE place <= k GROUP BY method, k),
s AS (SELECT method, k, count(*) AS selected, count(*) FILTER (WHERE account IN (SELECT account FROM pos)) AS positives_selected FROM ranked, b WHERE place <= k GROUP BY method, k),
tot AS (SELECT c.method, CAST(c.k AS BIGINT) AS budget, selected, positives_selected, covered, frauds_covered, (SELECT count(*) FROM pos) AS positives, (SELECT sum(isFraud) FROM tx) AS frauds FROM c JOIN s ON c.method = s.method AND c.k = s.k),
w AS (SELECT method, budget, selected, positives_selected, covered, frauds_covered, {_COMPARED}, {_REASONS} AS null_reasons FROM tot)
SELECT w.*, {", ".join(f"CASE WHEN w.method = 'network' THEN round(w.{n} - o.{n}, 9) END AS {n}_difference" for n in RATIOS)} FROM w JOIN w o ON o.budget = w.budget AND o.method = 'volume'""")
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts ranked by number of patterns (ties by PageRank) against accounts ranked by volume; a row counts once for both its ends."""
    rows = transactions(spark, sf_dir)
    edges = kept(pairs(rows).drop("types", "largest"), "pairs")
    found = kept(nodes(edges), "nodes")
    flags = kept(network_order(indicators(found), pagerank(edges, found)), "flags")
    # The first rows of each ranking are taken without a sort of all accounts.
    network = flags.orderBy(F.desc("n"), F.desc("pagerank"), "account").limit(LARGEST)
    volume = flags.orderBy(F.desc("volume"), "account").limit(LARGEST)
    from pyspark.sql import Window

    ranked = network.select(F.lit("network").alias("method"), "account", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("pagerank"), "account")).alias("place")).union(
        volume.select(F.lit("volume"), "account", F.row_number().over(Window.orderBy(F.desc("volume"), "account")))
    )
    return compared(rows, kept(ranked, "ranked"), effective_budgets(BUDGETS, found.count()))


POSITIVE = "pos AS (SELECT nameOrig AS account FROM tx WHERE isFraud = 1 UNION SELECT nameDest FROM tx WHERE isFraud = 1)"


def positive_accounts(edges: DataFrame) -> DataFrame:
    """Accounts at either end of a pair with a fraud."""
    return edges.where("frauds > 0").select(F.explode(F.array("src", "dst")).alias("account")).distinct()


@query("agg42_pattern_coverage", f"WITH {FLAGS}, {POSITIVE}, b(k) AS (VALUES (1), (2), (3)), m AS (SELECT account, len(patterns) AS n FROM flags), p AS (SELECT greatest(coalesce(a.n, 0), coalesce(c.n, 0)) AS n, isFraud FROM tx LEFT JOIN m a ON a.account = nameOrig LEFT JOIN m c ON c.account = nameDest), c AS (SELECT k, count(*) AS covered, CAST(sum(isFraud) AS BIGINT) AS frauds FROM p, b WHERE n >= k GROUP BY k), s AS (SELECT k, count(*) AS flagged, count(*) FILTER (WHERE account IN (SELECT account FROM pos)) AS hit FROM m, b WHERE n >= k GROUP BY k) SELECT CAST(k AS BIGINT) AS min_patterns, covered, frauds, flagged AS flagged_accounts, hit AS flagged_with_fraud, round(hit / flagged, 6) AS precision_at_account, round(frauds / covered, 6) AS precision_at_txn, round(frauds / (SELECT sum(isFraud) FROM tx), 6) AS coverage_fraud FROM c JOIN s USING (k)")
def pattern_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of at least k patterns, and transactions with one at either end; pairs carry the counts, so transactions aren't joined."""
    edges = kept(graph(spark, sf_dir), "pairs")
    n = indicators(kept(nodes(edges), "nodes")).select("account", F.size("patterns").alias("n")).where("n > 0")
    hit = positive_accounts(edges).withColumn("hit", F.lit(1))
    n = kept(n.join(hit, "account", "left"), "patterns")
    joined = edges.join(n.select(F.col("account").alias("src"), F.col("n").alias("a")), "src", "left").join(n.select(F.col("account").alias("dst"), F.col("n").alias("b")), "dst", "left")
    most = F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))
    sums = joined.where(most > 0).groupBy(most.alias("most")).agg(F.sum("weight").alias("w"), F.sum("frauds").alias("f"))
    least = F.explode(F.sequence(F.lit(1).cast("long"), F.col("most").cast("long"))).alias("min_patterns")
    covered = sums.select(least, "w", "f").groupBy("min_patterns").agg(F.sum("w").alias("covered"), F.sum("f").alias("frauds"))
    accounts = n.groupBy(F.col("n").alias("most")).agg(F.count("*").alias("a"), F.count("hit").alias("h")).select(least, "a", "h").groupBy("min_patterns").agg(F.sum("a").alias("flagged_accounts"), F.sum("h").alias("flagged_with_fraud"))
    total = edges.agg(F.sum("frauds").alias("total"))  # one row
    rounded = lambda a, b: F.round(C.ratio_or_zero(F.col(a), F.col(b)), 6)
    return covered.join(accounts, "min_patterns").crossJoin(F.broadcast(total)).select("min_patterns", "covered", "frauds", "flagged_accounts", "flagged_with_fraud", rounded("flagged_with_fraud", "flagged_accounts").alias("precision_at_account"), rounded("frauds", "covered").alias("precision_at_txn"), rounded("frauds", "total").alias("coverage_fraud"))
