"""Property-graph queries and learning over nodes (id, ...) and edges (id, from_node, to_node,
relationship, confidence, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import normal_label
from ..written import written
from .tables import Catalog, upsert


def steps(edges: DataFrame, direction: str = "both", kinds: list[str] | None = None, min_confidence: float = 0.3) -> DataFrame:
    """src, dst, edge, confidence in the direction asked for: outgoing, incoming or both."""
    e = edges.filter(F.col("confidence") >= min_confidence)
    if kinds:
        e = e.filter(F.col("relationship").isin(kinds))
    out = e.select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"), F.col("id").alias("edge"), "confidence")
    back = e.select(F.col("to_node").alias("src"), F.col("from_node").alias("dst"), F.col("id").alias("edge"), "confidence")
    if direction in ("outgoing", "out"):
        return out
    return back if direction in ("incoming", "in") else out.unionByName(back)


def expand(edges: DataFrame, starts: DataFrame, depth: int = 1, direction: str = "both", kinds: list[str] | None = None, min_confidence: float = 0.3) -> DataFrame:
    """starts (node) -> start, node, depth, path: each node reached at its least depth, by the
    strongest edge, then the smallest edge id, then the smallest path; the start itself is left out. Levels but the last are written, so
    no plan holds more than one of them and the loop runs depth times whatever the graph."""
    step = steps(edges, direction, kinds, min_confidence)
    empty = F.array().cast("array<string>")
    front = starts.select("node").distinct().select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), empty.alias("path"))
    seen = front = written(front, "level")
    for d in range(1, depth + 1):
        front = _level(front, seen.filter("depth > 0") if d > 1 else seen, step).withColumn("depth", F.lit(d)).select("start", "node", "depth", "path")
        if d < depth:
            front = written(front, "level")
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


#: What tells sets of nodes apart: how many there are, and two sums of 64-bit hashes.
_SET = ["__n", "__x", "__y"]


def _level(front: DataFrame, seen: DataFrame, step: DataFrame) -> DataFrame:
    """front (start, node, depth, path) -> start, node, path of the next level.

    Starts that have reached the same nodes reach the same ones next, by the same edges: a class of them is joined, aggregated and
    freed of what was reached once. Rows of a start are only made from its class, by a join that has one row for each."""
    own_set = F.count("*").alias("__n"), F.bit_xor(F.xxhash64("node", "depth")).alias("__x"), F.bit_xor(F.xxhash64("depth", "node")).alias("__y")
    keys = seen.groupBy("start").agg(*own_set)
    own = written(front.join(keys, "start").select(*_SET, "start", "node", "path"), "front")
    near = own.select(*_SET, F.col("node").alias("src")).distinct().join(step, "src")
    near = near.select(*_SET, "dst", (-F.col("confidence")).alias("c"), F.col("edge").cast("string").alias("e"), "src").repartition(*_SET, "dst")
    # an edge leads to a node from one other, unless several edges share an id
    near = near.groupBy(*_SET, "dst", "c", "e").agg(F.collect_set("src").alias("via")).groupBy(*_SET, "dst").agg(F.min(F.struct("c", "e", "via")).alias("b"))
    old = seen.join(keys, "start").select(*_SET, F.col("node").alias("dst")).distinct()
    best = written(near.join(old, [*_SET, "dst"], "left_anti").select(*_SET, "dst", "b.e", "b.via"), "reached")
    one = best.filter("size(via) = 1").withColumn("node", F.get("via", 0)).join(own, [*_SET, "node"]).select("start", "dst", "e", "path")
    ties = best.filter("size(via) > 1").withColumn("node", F.explode("via")).join(own, [*_SET, "node"])
    ties = ties.groupBy("start", "dst", "e").agg(F.min("path").alias("path"))
    return one.unionByName(ties).filter("dst <> start").select("start", F.col("dst").alias("node"), F.concat("path", F.array("e")).alias("path"))


def subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_node"), "from_node", "left_semi").join(ids.withColumnRenamed("id", "to_node"), "to_node", "left_semi")


def _then(first: Column, second: Column) -> Column:
    """Two moves (by, low, high), each x -> min(high, max(low, x + by)), as the one move that does both."""
    within = lambda x: F.least(second["high"], F.greatest(second["low"], x + second["by"]))
    return F.struct((first["by"] + second["by"]).alias("by"), within(first["low"]).alias("low"), within(first["high"]).alias("high"))


def _moves(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """df (keys, at, move, wins, losses) -> keys, at, move, wins, losses: the moves of a key as one, in the order of at."""
    none = F.struct(F.lit(0.0).alias("by"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "move")))
    return df.groupBy(*keys).agg(F.min(at).alias("at"), F.aggregate(ordered, none, lambda s, m: _then(s, m["move"])).alias("move"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))


def apply_outcome(edges: DataFrame, outcomes: DataFrame, span: int = 1000) -> DataFrame:
    """outcomes (id, outcome and, for their order, at, a number) of success, failure or partial move confidence, all those of an edge one
    after the other; two successes confirm. Others, and null ones, move nothing.

    Moves are clamped to 0 and 1 and do not commute. Two make one of the same kind, so an edge's outcomes are
    first composed for each span of at, then these: of an edge with very many, a group holds those of a span."""
    at = F.col("at").cast("long") if "at" in outcomes.columns else F.lit(0).cast("long")
    won, lost, part = (F.coalesce(F.col("outcome") == k, F.lit(False)) for k in ("success", "failure", "partial"))
    by = F.when(won, config.REINFORCE).when(lost, -config.WEAKEN).when(part, config.PARTIAL).otherwise(0.0)
    low, high = F.when(lost, 0.0).otherwise(float("-inf")), F.when(won | part, 1.0).otherwise(float("inf"))
    o = outcomes.filter("id is not null").select(F.col("id").alias("__id"), at.alias("at"), F.struct(by.alias("by"), low.alias("low"), high.alias("high")).alias("move"), won.cast("int").alias("wins"), lost.cast("int").alias("losses"))
    o = _moves(o.withColumn("__span", F.floor(F.col("at") / span)), ["__id", "__span"], "at")
    o = _moves(o, ["__id"], "at").select("__id", F.col("move").alias("__move"), F.col("wins").cast("int").alias("__wins"), F.col("losses").cast("int").alias("__losses"))
    e = edges.join(o, F.col("id") == F.col("__id"), "left")
    c, m = F.col("confidence"), F.col("__move")
    moved = F.when(m.isNull(), c).otherwise(F.least(m["high"], F.greatest(m["low"], c + m["by"])))
    successes = F.col("success_count") + F.coalesce("__wins", F.lit(0))
    failures = F.col("failure_count") + F.coalesce("__losses", F.lit(0))
    out = e.withColumns({"confidence": moved, "success_count": successes, "failure_count": failures, "provisional": F.col("provisional") & (successes < config.CONFIRM_AFTER)})
    return out.select(*edges.columns)


def decayed(confidence: Column, age_days: Column, half_life: float = config.HALF_LIFE_DAYS) -> Column:
    """Half of it is left after each half-life."""
    return confidence * F.pow(F.lit(0.5), age_days / half_life)


def collect_garbage(nodes: DataFrame, edges: DataFrame, before: Column, floor: float = config.GC_FLOOR) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without weak edges, and without nodes that then have none and were created before."""
    e = edges.filter(F.col("confidence") >= floor)
    ends = e.select(F.col("from_node").alias("id")).unionByName(e.select(F.col("to_node").alias("id"))).distinct()
    kept = nodes.join(ends.withColumn("__linked", F.lit(True)), "id", "left").filter(F.col("__linked") | (F.col("created_at") >= before))
    return kept.drop("__linked"), e


def _grams(text: Column) -> Column:
    """The distinct triples of characters of a text; of shorter ones the characters."""
    n = F.length(text)
    triples = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.array_distinct(F.when(n >= 3, triples).when(n > 0, F.split(text, "")).otherwise(F.array().cast("array<string>")))


def _contained(p: DataFrame, n: DataFrame) -> DataFrame:
    """Pairs p, l of which one holds the other and is less than twice as long. What is held has all
    its grams in what holds it, so it is looked for under its rarest gram alone. One of three
    characters or more is also held by one of its triples; a shorter one by its characters."""
    both = p.select(F.col("p").alias("s")).unionByName(n.select(F.col("l").alias("s"))).distinct()
    # a holder is found by triples and, for short ones, by characters
    every = F.array_distinct(F.concat(_grams(F.col("s")), F.when(F.length("s") < 6, F.split("s", "")).otherwise(F.array().cast("array<string>"))))
    holds = both.select(F.col("s").alias("long"), F.explode(every).alias("g"))
    counts = holds.groupBy("g").count()
    rarest = both.select("s", F.explode(_grams(F.col("s"))).alias("g")).join(counts, "g").groupBy("s").agg(F.min(F.struct("count", "g")).alias("r")).select(F.col("s").alias("short"), "r.g")
    pairs = rarest.join(holds, "g").filter((F.length("short") < F.length("long")) & (F.length("short") / F.length("long") > config.SUBSTRING_FLOOR) & F.contains(F.col("long"), F.col("short")))
    one = pairs.select(F.col("short").alias("p"), F.col("long").alias("l"))
    return one.unionByName(one.select(F.col("l").alias("p"), F.col("p").alias("l"))).join(p, "p", "left_semi").join(n.select("l").distinct(), "l", "left_semi")


def _edited(p: DataFrame, n: DataFrame) -> DataFrame:
    """Pairs p, l at most MAX_EDITS apart. Cut in one more part than there are edits, l has a part that p holds unchanged, at most MAX_EDITS places away."""
    k = config.MAX_EDITS
    parts = []
    for i in range(k + 1):
        width = F.expr(f"length(l) div {k + 1}") if i < k else F.expr(f"length(l) - {k} * (length(l) div {k + 1})")
        parts.append(F.struct(F.length("l").alias("n"), F.lit(i).alias("i"), F.substring("l", F.expr(f"1 + {i} * (length(l) div {k + 1})"), width).alias("part")))
    left = n.select("l").distinct().select("l", F.explode(F.array(*parts)).alias("key"))
    sizes = p.select("p", F.explode(F.sequence(F.greatest(F.length("p") - k, F.lit(1)), F.length("p") + k)).alias("n"))
    places = sizes.select("p", "n", F.explode(F.array(*[F.lit(i) for i in range(k + 1)])).alias("i"), F.expr(f"n div {k + 1}").alias("w"))
    places = places.select("p", "n", "i", "w", F.explode(F.array(*[F.lit(d) for d in range(-k, k + 1)])).alias("d"))
    width = F.when(F.col("i") < k, F.col("w")).otherwise(F.col("n") - k * F.col("w"))
    at = F.col("i") * F.col("w") + F.col("d")
    right = places.filter((at >= 0) & (at + width <= F.length("p"))).select("p", F.struct("n", "i", F.substring("p", at + 1, width).alias("part")).alias("key")).distinct()
    return left.join(right, "key").select("p", "l").distinct().filter(F.levenshtein("p", "l", k) >= 0)


def resolve(probes: DataFrame, labels: DataFrame) -> DataFrame:
    """probes (probe) x labels (id, label) -> probe, id, label, score, tier: the best match of each probe that
    has one: exact, then containment with a length ratio over one half, then at most two edits.

    Tiers are equi-joins: on the label, on the rarest gram of what is contained, on a part that
    the edits leave; labels that are alike once normalised are compared once. Nulls match nothing."""
    p = probes.filter("probe is not null").select("probe").distinct().withColumn("p", normal_label(F.col("probe"))).filter("p <> ''")
    n = labels.withColumn("l", normal_label(F.col("label"))).filter("l <> ''")
    least = n.groupBy("l").agg(F.min(F.struct("id", "label")).alias("r"))
    exact = p.join(least, p.p == least.l).select("probe", "p", "l", F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
    rest = p.join(exact.select("probe").distinct(), "probe", "left_anti")
    terms = rest.select("p").distinct()
    ratio = F.least(F.length("p"), F.length("l")) / F.greatest(F.length("p"), F.length("l"))
    near = _contained(terms, n.select("l").distinct()).select("p", "l", F.lit(2).alias("tier"), ratio.alias("score"))
    edits = _edited(terms, n).select("p", "l", F.lit(3).alias("tier"), (1 - F.levenshtein("p", "l") / F.greatest(F.length("p"), F.length("l"))).alias("score"))
    found = rest.join(near.unionByName(edits), "p").select("probe", "p", "l", "tier", "score").unionByName(exact)
    found = found.join(least, "l")
    best = found.groupBy("probe").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"), F.col("r.id").alias("id"), F.col("r.label").alias("label"))).alias("b"))
    return best.select("probe", "b.id", "b.label", (-F.col("b.s")).alias("score"), "b.tier")


def like_label(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose label holds text, any case."""
    return nodes.filter(F.contains(F.lower("label"), F.lit(text.lower())))


def start_nodes(nodes: DataFrame, label: str | None = None, kind: str | None = None, record: str | None = None) -> DataFrame:
    """node, distinct: those whose label holds label, else those of the kind; and those of a record id. Without any, none."""
    found = like_label(nodes, label) if label else nodes.filter(F.col("entity_type") == kind) if kind else nodes.filter(F.lit(False))
    found = found.select(F.col("id").alias("node"))
    if record:
        found = found.unionByName(nodes.filter(F.col("record_id") == record).select(F.col("id").alias("node")))
    return found.distinct()


def query_graph(nodes: DataFrame, edges: DataFrame, label: str | None = None, kind: str | None = None, depth: int = 1, direction: str = "both", kinds: list[str] | None = None, min_confidence: float = 0.3, limit: int = 50) -> DataFrame:
    """id, label, entity_type, depth: without a label the entities of the kind at depth 0; else what is reached
    from the nodes of the label, each entity once at its least depth."""
    if not label:
        own = nodes.filter(F.col("entity_type") == kind) if kind else nodes
        return own.select("id", "label", "entity_type", F.lit(0).alias("depth")).orderBy("id").limit(limit)
    reached = expand(edges, start_nodes(nodes, label), depth, direction, kinds, min_confidence).groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"))
    return reached.join(nodes.select("id", "label", "entity_type"), "id").select("id", "label", "entity_type", "depth").orderBy("depth", "id").limit(limit)


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels of both ends; an edge that lacks an end is left out."""
    a = nodes.select(F.col("id").alias("from_node"), F.col("label").alias("from_label"))
    b = nodes.select(F.col("id").alias("to_node"), F.col("label").alias("to_label"))
    return edges.join(a, "from_node").join(b, "to_node")


def view(nodes: DataFrame, edges: DataFrame, label: str | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes with weight, edges with weight) to be drawn: all, weighted by access; or what is around a label, by depth."""
    if label is None:
        return nodes.select("id", "label", "entity_type", F.col("access_count").cast("double").alias("weight")), edges.select("from_node", "to_node", "relationship", F.col("confidence").alias("weight"))
    starts = start_nodes(nodes, label)
    near = expand(edges, starts, depth).select(F.col("node").alias("id"), "depth").unionByName(starts.select(F.col("node").alias("id"), F.lit(0).alias("depth")))
    near = near.groupBy("id").agg(F.min("depth").cast("double").alias("weight"))
    return near.join(nodes.select("id", "label", "entity_type"), "id").select("id", "label", "entity_type", "weight"), subgraph(near, edges).select("from_node", "to_node", "relationship", F.col("confidence").alias("weight"))


def subset(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the nodes in ids (id), with the edges that have both ends there."""
    own = ids.select("id").filter("id is not null").distinct()
    return nodes.join(own, "id", "left_semi"), subgraph(own, edges).select(*edges.columns)


def load_graph(catalog: Catalog, min_confidence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a catalog holds. A type of node that is not known is concept, a kind of edge related_to, a negative or
    missing count 0; metadata that is no JSON is null. Edges that lack an end, and with min_confidence weaker ones, are left out."""
    n, e = catalog.read("nodes"), catalog.read("edges")
    count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).alias(c)
    known = lambda c, values, other: F.when(F.lower(c).isin(*values), F.lower(c)).otherwise(other).alias(c)
    meta = F.when(F.try_parse_json("metadata").isNotNull(), F.col("metadata")).alias("metadata")
    own = {"entity_type": known("entity_type", config.ENTITY_TYPES, "concept"), "access_count": count("access_count"), "metadata": meta}
    n = n.select(*[own.get(c, F.col(c)) for c in n.columns]).dropDuplicates(["id"])
    own = {"relationship": known("relationship", config.RELATIONSHIPS, "related_to")} | {c: count(c) for c in ("access_count", "success_count", "failure_count")}
    e = e.select(*[own.get(c, F.col(c)) for c in e.columns])
    e = e.filter(F.col("confidence") >= min_confidence) if min_confidence is not None else e
    return n, subgraph(n, e).select(*e.columns)


def save_graph(catalog: Catalog, nodes: DataFrame, edges: DataFrame) -> None:
    """Nodes and edges take the place of those of the same id, in one commit; the others stay."""
    there = catalog.state()["tables"]
    both = {"nodes": nodes, "edges": edges}
    catalog.commit({k: upsert(catalog.read(k), v, ["id"]) if k in there else v for k, v in both.items()})


def save_subset(catalog: Catalog, nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> None:
    """save_graph of what subset takes."""
    save_graph(catalog, *subset(nodes, edges, ids))


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes in gone (id) and without edges that touch them."""
    g = gone.select("id").distinct()
    e = edges.join(g.withColumnRenamed("id", "from_node"), "from_node", "left_anti").join(g.withColumnRenamed("id", "to_node"), "to_node", "left_anti")
    return nodes.join(g, "id", "left_anti"), e.select(*edges.columns)
