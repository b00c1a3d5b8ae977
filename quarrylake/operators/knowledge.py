"""Writing to the property graph: entities and edges from notes, checkpoints and code.

Facts are rows (from_type, from_label, relationship, to_type, to_label). An entity is known by its
type and normalised label, an edge by its ends and relationship, so writing a fact twice changes
nothing. Nodes: id, entity_type, label, record_id, access_count. Edges: id, from_node, to_node,
relationship, confidence, provisional, success_count, failure_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import new_id, normal_label
from ..written import written
from .graph import resolve

NODES = "id string, entity_type string, label string, record_id string, access_count long"
EDGES = "id string, from_node string, to_node string, relationship string, confidence double, provisional boolean, success_count int, failure_count int"
FACT = ["from_type", "from_label", "relationship", "to_type", "to_label"]


def _fact(from_type: str, from_label: Column, relationship: str | Column, to_type: str, to_label: Column) -> Column:
    r = F.lit(relationship) if isinstance(relationship, str) else relationship
    return F.struct(F.lit(from_type).alias("from_type"), from_label.alias("from_label"), r.alias("relationship"), F.lit(to_type).alias("to_type"), to_label.alias("to_label"))


def ensure_entities(nodes: DataFrame, wanted: DataFrame, fuzzy: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes x wanted (entity_type, label) -> (nodes, found: entity_type, label, id).

    A wanted label of a type is an existing node of the type with the same normalised label, whose access_count
    grows by one for each wanted row; with fuzzy, also the best match by containment or edits; else a
    new node with an id of its own. Blank and null labels make none."""
    nodes, found = _entities(nodes, wanted, fuzzy)
    return nodes, found.drop("n")


def _entities(nodes: DataFrame, wanted: DataFrame, fuzzy: bool) -> tuple[DataFrame, DataFrame]:
    """What ensure_entities gives, with n, how often each is wanted, in found."""
    w = wanted.filter("trim(label) <> ''").withColumn("key", normal_label(F.col("label")))
    times = w.groupBy("entity_type", "label", "key").agg(F.count("*").alias("n"))
    own = nodes.groupBy("entity_type", normal_label(F.col("label")).alias("key")).agg(F.min("id").alias("old"))
    found = times.join(own, ["entity_type", "key"], "left")
    if fuzzy:
        # a label is matched within its type: the type goes before the label, marked off by a character of neither
        tag = lambda label: F.concat(F.col("entity_type"), F.lit("\x1f"), normal_label(label))
        open_ = found.filter("old is null").select(tag(F.col("label")).alias("probe"), "entity_type", "label")
        labels = nodes.select("id", tag(F.col("label")).alias("label"))
        best = resolve(open_.select("probe"), labels).filter(F.substring_index("probe", "\x1f", 1) == F.substring_index("label", "\x1f", 1))
        best = open_.join(best.select("probe", F.col("id").alias("like")), "probe").select("entity_type", "label", "like")
        found = found.join(best, ["entity_type", "label"], "left").withColumn("old", F.coalesce("old", "like")).drop("like")
    found = found.withColumn("id", F.coalesce("old", new_id("node", F.col("entity_type"), F.col("key"))))
    hits = found.filter("old is not null").groupBy("id").agg(F.sum("n").alias("hits"))
    grown = nodes.join(hits, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("hits", F.lit(0))).select(*nodes.columns)
    new = found.filter("old is null").groupBy("id", "entity_type").agg(F.min("label").alias("label"), F.lit(None).cast("string").alias("record_id"), F.lit(0).cast("long").alias("access_count"))
    return grown.unionByName(new), found.select("entity_type", "label", "id", "n")


def ensure_edges(edges: DataFrame, wanted: DataFrame, confidence: float = config.PROVISIONAL) -> DataFrame:
    """edges and the wanted ones (from_node, to_node, relationship) that are not there yet, as provisional."""
    w = wanted.select("from_node", "to_node", "relationship").filter("from_node is not null and to_node is not null").distinct()
    new = w.join(edges.select("from_node", "to_node", "relationship").distinct(), ["from_node", "to_node", "relationship"], "left_anti")
    new = new.select(
        new_id("edge", F.col("from_node"), F.col("relationship"), F.col("to_node")).alias("id"), "from_node", "to_node", "relationship",
        F.lit(confidence).alias("confidence"), F.lit(True).alias("provisional"), F.lit(0).alias("success_count"), F.lit(0).alias("failure_count"),
    )
    return edges.unionByName(new)


def write_facts(nodes: DataFrame, edges: DataFrame, facts: DataFrame, fuzzy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the facts in them; a fact with a blank end is left out."""
    f = facts.filter("trim(from_label) <> '' and trim(to_label) <> ''")
    ends = f.select(F.col("from_type").alias("entity_type"), F.col("from_label").alias("label")).unionByName(f.select(F.col("to_type").alias("entity_type"), F.col("to_label").alias("label")))
    nodes, found = _entities(nodes, ends, fuzzy)
    found = written(found, "found")
    return nodes, ensure_edges(edges, _named(_named(f, found, "from"), found, "to"))


#: Facts of one label from which on it is frequent: of all facts' ends, one in so many at most is such a label.
FREQUENT = 20_000


def _named(facts: DataFrame, found: DataFrame, end: str) -> DataFrame:
    """facts with the id of that end as {end}_node. The few frequent labels are sent to the facts, so that no task gets all facts of one; the others are joined."""
    on = [f"{end}_type", f"{end}_label"]
    known = found.select(F.col("entity_type").alias(on[0]), F.col("label").alias(on[1]), F.col("id").alias(f"{end}_node"), "n")
    often = F.broadcast(known.filter(F.col("n") >= FREQUENT).drop("n"))
    out = facts.join(often, on, "left")
    rest = out.filter(F.col(f"{end}_node").isNull()).drop(f"{end}_node").join(known.filter(F.col("n") < FREQUENT).drop("n"), on)
    return out.filter(F.col(f"{end}_node").isNotNull()).unionByName(rest)


def lesson_facts(lessons: DataFrame) -> DataFrame:
    """lessons (title, severity, tags) -> facts: a solution related to the concept of each tag, and one that solved the
    problem of a critical or warning lesson."""
    grave = F.col("severity").isin("critical", "warning")
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: _fact("solution", F.col("title"), "related_to", "concept", F.trim(t)))
    problem = _fact("solution", F.col("title"), "solved", "problem", F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("title")))
    none = F.slice(F.array(problem), 1, F.lit(0))
    return lessons.select(F.inline(F.concat(tags, F.when(grave, F.array(problem)).otherwise(none)))).select(*FACT)


def checkpoint_facts(checkpoints: DataFrame) -> DataFrame:
    """checkpoints (agent, working_on) -> facts: the agent's chunk, and its first phrases of more than two characters."""
    chunk = F.col("working_on")
    phrases = F.slice(F.filter(F.transform(F.split(chunk, "[,;:|]"), lambda x: F.trim(x)), lambda x: F.length(x) > 2), 1, config.CONCEPTS_OF_CHECKPOINT)
    said = F.transform(phrases, lambda x: _fact("chunk", chunk, "related_to", "concept", x))
    return checkpoints.select(F.inline(F.concat(F.array(_fact("agent", F.col("agent"), "related_to", "chunk", chunk)), said))).select(*FACT)


def bootstrap(nodes: DataFrame, edges: DataFrame, lessons: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with what stored lessons and checkpoints say."""
    return write_facts(nodes, edges, lesson_facts(lessons).unionByName(checkpoint_facts(checkpoints)))


def seed_facts(seeds: DataFrame) -> DataFrame:
    """seeds (title, tools, concepts, problem) -> facts: the solution used tools, is related to concepts, solved a problem."""
    each = lambda c, r, t: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: _fact("solution", F.col("title"), r, t, x))
    problem = F.filter(F.array(_fact("solution", F.col("title"), "solved", "problem", F.col("problem"))), lambda x: x["to_label"].isNotNull())
    return seeds.select(F.inline(F.concat(each(F.col("tools"), "used", "tool"), each(F.col("concepts"), "related_to", "concept"), problem))).select(*FACT)


def outcome_facts(checkpoints: DataFrame) -> DataFrame:
    """checkpoints (agent, working_on, tools, problems, solutions, outcome) -> facts: tools used, problems, solutions; after a
    failure each solution failed for each problem."""
    chunk = F.col("working_on")
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    used = F.transform(some("tools"), lambda x: _fact("agent", F.col("agent"), "used", "tool", x))
    met = F.transform(some("problems"), lambda x: _fact("chunk", chunk, "related_to", "problem", x))
    done = F.transform(some("solutions"), lambda x: _fact("chunk", chunk, "solved", "solution", x))
    failed = F.flatten(F.transform(some("solutions"), lambda x: F.transform(some("problems"), lambda y: _fact("solution", x, "failed_for", "problem", y))))
    none = F.slice(failed, 1, F.lit(0))
    return checkpoints.select(F.inline(F.concat(used, met, done, F.when(F.col("outcome") == "failure", failed).otherwise(none)))).select(*FACT)


def contradictions(facts: DataFrame) -> DataFrame:
    """Facts of a solution that both solved and failed for one problem: solution, problem."""
    one, other = (facts.filter(F.col("relationship") == r).select(F.col("from_label").alias("solution"), F.col("to_label").alias("problem")).distinct() for r in ("solved", "failed_for"))
    return one.join(other, ["solution", "problem"])


_TYPES = {"class": "struct_class", "interface": "struct_class", "test": "struct_test", "method": "struct_function", "function": "struct_function"}


def structural_facts(symbols: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """symbols and call, import and inheritance edges -> facts: modules contain symbols, scopes contain symbols, tests
    test functions and methods of their name, and the edges, to the first symbol of the target's name. With parts, equal facts are
    looked for in so many parts, dealt before a task collects any: with a number that follows that of edges, what a task holds does not grow."""
    kind = F.coalesce(*[F.when(F.col("symbol_kind") == k, F.lit(v)) for k, v in _TYPES.items()], F.lit("struct_symbol"))
    s = symbols.select("id", "file_path", "symbol_name", "symbol_kind", "scope", kind.alias("type"), F.concat_ws(":", "file_path", "symbol_name").alias("label"))
    module = s.select(F.lit("struct_module").alias("from_type"), F.col("file_path").alias("from_label"), F.lit("contains").alias("relationship"), F.col("type").alias("to_type"), F.col("label").alias("to_label"))
    scope = s.filter("scope is not null").select(F.lit("struct_class").alias("from_type"), F.concat_ws(":", "file_path", "scope").alias("from_label"), F.lit("contains").alias("relationship"), F.col("type").alias("to_type"), F.col("label").alias("to_label"))
    tests = s.filter("symbol_kind = 'test'").withColumn("name", F.regexp_replace("symbol_name", "^(test_|Test)", "")).filter("name <> '' and name <> symbol_name")
    tested = s.filter("symbol_kind in ('function', 'method')").select(F.col("symbol_name").alias("name"), F.col("type").alias("to_type"), F.col("label").alias("to_label"))
    tests = tests.join(tested, "name").select(F.col("type").alias("from_type"), F.col("label").alias("from_label"), F.lit("tests").alias("relationship"), "to_type", "to_label")
    first = s.groupBy("symbol_name").agg(F.min(F.struct("id", "type", "label")).alias("t")).select(F.col("symbol_name").alias("target_symbol_name"), F.col("t.type").alias("to_type"), F.col("t.label").alias("to_label"))
    kinds = F.when(F.col("edge_kind") == "calls", "calls").when(F.col("edge_kind") == "imports", "imported_by").when(F.col("edge_kind") == "inherits", "inherits").otherwise("related_to")
    calls = edges.join(s.select(F.col("id").alias("source_symbol_id"), F.col("type").alias("from_type"), F.col("label").alias("from_label")), "source_symbol_id").join(first, "target_symbol_name")
    every = module.unionByName(scope).unionByName(tests).unionByName(calls.select("from_type", "from_label", kinds.alias("relationship"), "to_type", "to_label"))
    return (every.repartition(parts, *FACT) if parts else every).distinct()


def structural_graph(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    return write_facts(nodes, edges, structural_facts(symbols, calls))


def edge_feed(symbols: DataFrame, edges: DataFrame, limit: int = config.EDGE_FEED) -> DataFrame:
    """source, target, edge_kind of edges from symbols that are neither imports nor call sites: calls, inheritance, imports, then others."""
    s = symbols.filter("symbol_kind not in ('import', 'call_site')").select(F.col("id").alias("source_symbol_id"), F.col("symbol_name").alias("source"))
    order = F.when(F.col("edge_kind") == "calls", 0).when(F.col("edge_kind") == "inherits", 1).when(F.col("edge_kind") == "imports", 2).otherwise(3)
    out = edges.join(s, "source_symbol_id").select("source", F.col("target_symbol_name").alias("target"), "edge_kind", order.alias("o"), "id")
    return first_rows(out, ["o", "id"], limit).drop("o", "id")


#: Rows up to which a limit is left to one task, which then reads as many from each of the others.
ONE_TASK = 10_000


def first_rows(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """df.orderBy(order).limit(limit), in that order. Rows of a large limit stay in the ranges that the sort deals them to: their sizes tell where the limit falls."""
    if limit <= ONE_TASK:
        return df.orderBy(*order).limit(limit)
    # the number of a row has that of its range in its upper bits
    rows = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    left, end = limit, 0
    for r in rows.groupBy(F.shiftright("__at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # a row for each range
        end, left = (r["p"] << 33) + min(left, r["n"]), left - min(left, r["n"])
        if not left:
            break
    return rows.filter(F.col("__at") < end).orderBy("__at").drop("__at")
