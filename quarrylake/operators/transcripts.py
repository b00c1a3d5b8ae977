"""Session logs: parsing, and patterns over the order of entries (session_id, n, kind, text,
tool_name, is_error, output)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import config
from ..functions.kernels import jaro_winkler
from ..functions.text import contains_any, entry_summary, epoch_of, error_snippet, title_cut
from ..shipping import ship_package
from ..written import written

LINE = "uuid string, type string, timestamp string, sessionId string, message struct<role:string,content:variant>"


def parse(lines: DataFrame) -> DataFrame:
    """lines (value, line_no) of JSON -> entries; blank, malformed and id-less lines, and those not of a conversation, are left out."""
    j = lines.withColumn("j", F.from_json("value", LINE)).filter("j.uuid is not null and j.type in ('user', 'assistant', 'system')")
    content = F.col("j.message.content")
    blocks = F.try_variant_get(content, "$", "array<struct<type:string,text:string,name:string,id:string,tool_use_id:string,is_error:boolean>>")
    plain = F.try_variant_get(content, "$", "string")
    j = j.withColumns({"plain": F.when(blocks.isNull(), plain), "blocks": blocks})
    tool = F.get(F.filter("blocks", lambda b: b["type"] == "tool_use"), 0)
    result = F.get(F.filter("blocks", lambda b: b["type"] == "tool_result"), 0)
    said = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.coalesce("plain", said, F.lit(""))
    kind = F.when(result.isNotNull(), "tool_result").when(tool.isNotNull() & (text == ""), "tool_use").otherwise(F.col("j.type"))
    return j.select(
        F.col("j.sessionId").alias("session_id"), F.col("line_no").alias("n"), kind.alias("kind"), text.alias("text"),
        tool["name"].alias("tool_name"), F.coalesce(tool["id"], result["tool_use_id"]).alias("tool_use_id"),
        F.coalesce(result["is_error"], F.lit(False)).alias("is_error"), epoch_of(F.col("j.timestamp")).alias("at"),
    )


def _order():
    return Window.partitionBy("session_id").orderBy("n")


def _back(rows: int):
    return _order().rowsBetween(-rows, -1)


def _previous(answerer: str) -> Column:
    return F.last(F.when(F.col("kind") == answerer, F.col("n")), ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))


def _corrects(previous: Column, phrases: tuple[str, ...], speaker: str) -> Column:
    return (F.col("kind") == speaker) & contains_any(F.lower("text"), phrases) & previous.isNotNull()


def corrections(entries: DataFrame, phrases: tuple[str, ...] = config.CORRECTIONS, speaker: str = "user", answerer: str = "assistant") -> DataFrame:
    """Rows of the speaker that hold a phrase, behind some row of the answerer: session_id, n, text, previous."""
    seen = entries.withColumn("previous", _previous(answerer))
    return seen.filter(_corrects(F.col("previous"), phrases, speaker)).select("session_id", "n", "text", "previous")


def _saves(phrases: tuple[str, ...], speaker: str) -> Column:
    return (F.col("kind") == speaker) & contains_any(F.lower("text"), phrases)


def saves(entries: DataFrame, phrases: tuple[str, ...] = config.SAVES, speaker: str = "user") -> DataFrame:
    return entries.filter(_saves(phrases, speaker)).select("session_id", "n", "text")


def _uses(look_back: int) -> Column:
    return F.collect_list(F.when(F.col("tool_name").isNotNull(), F.struct("tool_use_id", "tool_name"))).over(_back(look_back))


def _failed_tool(uses: str) -> Column:
    same = F.get(F.filter(uses, lambda u: u["tool_use_id"] == F.col("tool_use_id")), 0)["tool_name"]
    nearest = F.try_element_at(uses, F.lit(-1))["tool_name"]
    return F.coalesce(same, nearest, F.lit("unknown"))


def failures(entries: DataFrame, look_back: int = 10) -> DataFrame:
    """Error results with the tool that caused them: by id within look_back rows, else the nearest."""
    e = entries.withColumn("uses", _uses(look_back))
    return e.filter("is_error").select("session_id", "n", _failed_tool("uses").alias("tool_name"), F.substring("text", 1, 60).alias("snippet"))


def _fix(look_ahead: int, fixers: tuple[str, ...]) -> Column:
    return F.first(F.when(F.col("tool_name").isin(*fixers), F.col("tool_name")), ignorenulls=True).over(_order().rowsBetween(1, look_ahead))


def _tool(look_back: int) -> Column:
    return F.last("tool_name", ignorenulls=True).over(_back(look_back))


def _fails_build(tool: Column, markers: tuple[str, ...], shells: tuple[str, ...]) -> Column:
    return (F.col("kind") == "tool_result") & contains_any(F.col("text"), markers) & tool.isin(*shells)


def build_failures(entries: DataFrame, markers: tuple[str, ...] = config.BUILD_FAILURES, look_back: int = 10, look_ahead: int = 6, fixers: tuple[str, ...] = ("Edit", "Write", "Bash"), shells: tuple[str, ...] = ("Bash",)) -> DataFrame:
    """Results of a shell that hold a marker: session_id, n, snippet (the first line with one), severity, and fix, the first
    fixing tool within look_ahead rows. The tool of a result is the nearest one within look_back rows."""
    e = entries.withColumns({"fix": _fix(look_ahead, fixers), "tool": _tool(look_back)})
    bad = e.filter(_fails_build(F.col("tool"), markers, shells))
    return bad.select("session_id", "n", error_snippet(F.col("text"), markers).alias("snippet"), F.lit("critical").alias("severity"), "fix")


def context(entries: DataFrame, before: int = 2, after: int = 3) -> DataFrame:
    """Each row with its neighbours' first characters, oldest first."""
    frame = _order().rowsBetween(-before, after)
    around = F.collect_list(F.concat_ws(" ", F.col("n").cast("string"), "kind", F.substring("text", 1, 40))).over(frame)
    return entries.select("session_id", "n", F.array_join(around, "\n").alias("context"))


def repeated_tools(entries: DataFrame) -> DataFrame:
    """session_id, n, length, tool_name of runs of one tool with like arguments.

    A run lies among rows of one tool that follow each other. Those of RUN_LENGTH rows or more are read in their order, of which a task
    holds the first row of the run that it is in, whatever the length of the session."""
    ship_package(entries.sparkSession)
    e = entries.filter("tool_name is not null").select("session_id", "n", "tool_name", F.coalesce("text", F.lit("")).alias("text"))
    side = lambda k: F.coalesce((F.lag("tool_name", k) if k > 0 else F.lead("tool_name", -k)).over(_order()) == F.col("tool_name"), F.lit(False))
    least = config.RUN_LENGTH
    e = e.withColumns({f"__{k}": side(k) for k in range(1 - least, least) if k})
    # some span of least rows about a row is of its tool
    long = reduce(Column.__or__, [reduce(Column.__and__, [F.col(f"__{k}") for k in range(at - least + 1, at + 1) if k], F.lit(True)) for at in range(least)])
    e = e.filter(long).select("session_id", "n", "tool_name", "text", F.coalesce(~F.col("__1"), F.lit(True)).alias("begins") if least > 1 else F.lit(True).alias("begins"))
    schema = e.schema
    kinds = [f"{c} {schema[c].dataType.simpleString()}" for c in ("session_id", "n")]

    def run(batches):
        first, length, out = None, 0, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("session_id", "n", "tool_name", "text", "begins"))):
                if first is not None and not row[4] and row[0] == first[0] and jaro_winkler(first[3], row[3]) >= config.RUN_SIMILARITY:
                    length += 1
                    continue
                if length >= least:
                    out.append((first[0], first[1], length, first[2]))
                first, length = row, 1
            yield batch(out)
            out = []
        if length >= least:
            yield batch([(first[0], first[1], length, first[2])])

    types = [to_arrow_type(schema["session_id"].dataType), to_arrow_type(schema["n"].dataType), pa.int32(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["session_id", "n", "length", "tool_name"])

    return e.sortWithinPartitions("session_id", "n").mapInArrow(run, f"{', '.join(kinds)}, length int, tool_name string")


def extract_all(entries: DataFrame) -> DataFrame:
    """What a session teaches: session_id, n, title, severity, rule. Rules in the order correction, failure, saving, repeated
    tool, failed build; of one title in a session the first is kept, by rule and place.

    Each session is brought together and ordered once for what its rows have around them, and once more for repeated tools."""
    shells = ("Bash",)
    e = entries.withColumns({"__previous": _previous("assistant"), "__uses": _uses(10), "__tool": _tool(10)})
    lesson = lambda title, severity, rule: F.struct(title.alias("title"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"))
    found = [
        F.when(_corrects(F.col("__previous"), config.CORRECTIONS, "user"), lesson(F.concat(F.lit("Correction: "), title_cut(F.col("text"), 60)), "warning", 1)),
        F.when(F.col("is_error"), lesson(F.concat(_failed_tool("__uses"), F.lit(" failed: "), title_cut(F.substring("text", 1, 60), 60)), "warning", 2)),
        F.when(_saves(config.SAVES, "user"), lesson(title_cut(F.col("text"), 80), "info", 3)),
        F.when(_fails_build(F.col("__tool"), config.BUILD_FAILURES, shells), lesson(F.concat(F.lit("Build failed: "), title_cut(error_snippet(F.col("text"), config.BUILD_FAILURES), 60)), "critical", 5)),
    ]
    every = e.select("session_id", "n", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
    title = F.concat_ws(" ", F.lit("Repeated"), "tool_name", F.col("length").cast("string"))
    every = every.unionByName(repeated_tools(entries).select("session_id", "n", title.alias("title"), F.lit("info").alias("severity"), F.lit(4).alias("rule")))
    first = every.groupBy("session_id", "title").agg(F.min(F.struct("rule", "n", "severity")).alias("f"))
    return first.select("session_id", "f.n", "title", "f.severity", "f.rule")


def summaries(entries: DataFrame) -> DataFrame:
    """One line for each entry."""
    return entries.select("session_id", "n", entry_summary(F.col("kind"), F.col("text"), F.col("tool_name"), F.col("is_error")).alias("summary"))


def ingest(entries: DataFrame, known: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lessons to store, report): what the sessions teach, less what a known lesson (title) says already, any case; a title of several
    sessions is stored once, for the first. The report has a row for each session: found, stored. A dry run stores nothing."""
    found = written(extract_all(entries), "found")
    fresh = found.join(known.select(F.lower("title").alias("__t")).distinct(), F.lower("title") == F.col("__t"), "left_anti")
    # a title that most sessions have is one row of each task before it comes together
    first = fresh.groupBy(F.lower("title").alias("__t")).agg(F.min(F.struct("session_id", "n", "rule", "title", "severity")).alias("f"))
    fresh = first.select("f.session_id", "f.n", "f.title", "f.severity", "f.rule").filter(F.lit(not dry_run))
    stored = fresh.groupBy("session_id").agg(F.count("*").alias("stored"))
    report = found.groupBy("session_id").agg(F.count("*").alias("found")).join(stored, "session_id", "left").select("session_id", "found", F.coalesce("stored", F.lit(0)).alias("stored"))
    return fresh, report
