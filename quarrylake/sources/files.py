"""Files as rows: source trees, session logs, memory files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import parse_memory
from .trees import scan, scan_report  # noqa: F401  a tree is a source of files like the others


def ignore_regex(pattern: str) -> tuple[bool, str] | None:
    """(whether it re-includes, regular expression over a path relative to the folder of the ignore file) of a line; null for blanks and comments."""
    line = pattern.rstrip("\n\r")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    again, line = line.startswith("!"), line[1:] if line.startswith("!") else line
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    out, k = "", 0
    while k < len(line):
        if line.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif line.startswith("/**", k) and k + 3 == len(line):
            out, k = out + "/.*", k + 3
        elif line[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif line[k] == "?":
            out, k = out + "[^/]", k + 1
        elif line[k] == "[" and "]" in line[k + 2 :]:
            end = line.index("]", k + 2)
            body = line[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif line[k] == "\\" and k + 1 < len(line):
            out, k = out + re.escape(line[k + 1]), k + 2
        else:
            out, k = out + re.escape(line[k]), k + 1
    # a folder takes all below it; a name without a slash may stand at any depth
    return again, ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def session_logs(spark: SparkSession, folder: str, modified_after: str | None = None, modified_before: str | None = None) -> DataFrame:
    """value, line_no, file of the *.jsonl files of a folder. A log is split by lines where it is read, not held as one string;
    line_no orders the lines of a file. modified_before leaves out files that may still grow."""
    r = spark.read.option("pathGlobFilter", "*.jsonl")
    r = r.option("modifiedAfter", modified_after) if modified_after else r
    r = r.option("modifiedBefore", modified_before) if modified_before else r
    # the place of a line: its split's offset in the file, then its number there
    lines = r.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"))
    return lines.select("file", F.struct("at", "m").alias("p"), "value").withColumn("line_no", F.row_number().over(_by_place()) - 1).select("file", "line_no", "value")


def _by_place():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("p")


def memory_files(spark: SparkSession, folder: str) -> DataFrame:
    """name, description, type, content of the *.md files of a folder; files without front matter are left out."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return raw.select(*[c.alias(k) for k, c in parse_memory(F.col("value")).items()]).filter("name is not null and description is not null and type is not null")


def known_names(spark: SparkSession, folder: str) -> DataFrame:
    """name: those of the memory files of a folder, each once; none where the folder is not there."""
    try:
        return memory_files(spark, folder).select("name").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "name string")
        raise


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    """title, severity, tags, tools, concepts, problem, content of the *.md seed lessons of a folder."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    head = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1)
    one = lambda k: F.nullif(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}: *(.*)$", 1), "^[\"']|[\"']$", ""), F.lit(""))
    bare = lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")
    many = lambda k: F.filter(F.transform(F.split(F.regexp_extract(head, rf"(?m)^{k}: *\[(.*)\]", 1), ","), bare), lambda x: x != "")
    body = F.regexp_extract("value", r"(?s)^---\n.*?\n---\n*(.*?)\s*$", 1)
    return raw.select(one("title").alias("title"), one("severity").alias("severity"), *[many(k).alias(k) for k in ("tags", "tools", "concepts")], one("problem").alias("problem"), body.alias("content")).filter("title is not null")


def import_seeds(lessons: DataFrame, seed: DataFrame, force: bool = False) -> DataFrame:
    """lessons with the seeds whose exact title they lack; with force the seeds replace the lessons of their titles."""
    titles = seed.select("title").distinct()
    if force:
        return lessons.join(titles, "title", "left_anti").unionByName(seed, allowMissingColumns=True)
    return lessons.unionByName(seed.join(lessons.select("title").distinct(), "title", "left_anti"), allowMissingColumns=True)
