"""Source trees, walked level by level by the tasks: what is ignored is never entered, and nothing is gathered on the driver."""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..shipping import ship_package
from ..written import written

_RULES = pa.list_(pa.struct([("folder", pa.string()), ("line", pa.string())]))
_RULES_DDL = "array<struct<folder: string, line: string>>"
_FOUND = f"path string, folder boolean, mtime long, size long, taken boolean, rules {_RULES_DDL}"


@lru_cache(maxsize=65_536)
def _rule(line: str) -> tuple[bool, bool, re.Pattern] | None:
    """(whether it re-includes, whether it is for folders only, pattern of a path relative to its file) of a line of an ignore file."""
    from .files import ignore_regex

    made = ignore_regex(line)
    if made is None:
        return None
    only = line.rstrip().endswith("/")
    # of a folder the pattern is matched against the folder itself, as what lies below is not entered
    return made[0], only, re.compile(made[1].removesuffix("/.*$") + "$" if only else made[1])


def is_ignored(path: str, folder: bool, rules: list[dict]) -> bool:
    """Whether a path of a tree is ignored by rules (folder of the ignore file, line), outer ones first: the last that fits decides."""
    for r in reversed(rules):
        made = _rule(r["line"])
        if made is None or made[1] and not folder:
            continue
        base = r["folder"] + "/" if r["folder"] else ""
        if path.startswith(base) and made[2].match(path[len(base) :]):
            return not made[0]
    return False


def default_ignored(path: str) -> bool:
    """Whether no ignore file is needed to leave a path out: hidden names but .github and .gitignore, folders of builds and
    dependencies, lock files, minified files, and files of systems and secrets."""
    for part in path.split("/"):
        if part.startswith(".") and len(part) > 1 and part not in config.SHOWN_HIDDEN:
            return True
        if part in config.EXCLUDED_DIRS or part.startswith(config.EXCLUDED_PREFIXES) or part.endswith(".egg-info"):
            return True
    name = path.rsplit("/", 1)[-1].lower()
    return name in config.IGNORED_FILES or name.endswith(config.IGNORED_ENDS)


def language(path: str) -> str | None:
    """The language of a file by its extension, any case."""
    name = path.rsplit("/", 1)[-1]
    return config.LANGUAGES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def _level(root: str, ignore_files: bool):
    """Folders (path, rules) -> what lies in each: kept folders with the rules for what is below, and files, taken or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for folder, rules in zip(b.column("path").to_pylist(), b.column("rules").to_pylist()):
                here = posixpath.join(base, folder) if folder else base
                infos = system.get_file_info(fs.FileSelector(here, allow_not_found=True))
                named = {i.base_name: i for i in infos}
                if ignore_files:
                    for name in config.IGNORE_FILES:
                        if name in named and named[name].type == fs.FileType.File:
                            with system.open_input_stream(named[name].path) as f:
                                lines = f.readall().decode("utf-8", "replace").split("\n")
                            rules = rules + [{"folder": folder, "line": x} for x in lines if _rule(x)]
                rows = []
                for name in sorted(named):
                    info, path = named[name], f"{folder}/{name}" if folder else name
                    is_folder = info.type == fs.FileType.Directory
                    if default_ignored(path) or is_ignored(path, is_folder, rules):
                        continue
                    mtime = int(info.mtime_ns // 1_000_000_000) if info.mtime_ns else 0
                    rows.append((path, is_folder, mtime, info.size or 0, not is_folder and language(path) is not None, rules if is_folder else []))
                columns = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), _RULES]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "folder", "mtime", "size", "taken", "rules"])

    return run


def walk(spark: SparkSession, root: str, ignore_files: bool = True) -> DataFrame:
    """path, mtime, size, taken of the files under root, a URI, that are neither hidden nor ignored; taken ones have a known language.

    One job for each level of folders, as deep as the tree is; a level's folders are dealt to the tasks, and the rules of ignore files
    travel with the folders below them. An ignored folder is not entered, so nothing below it can be taken back in."""
    ship_package(spark)
    folders = spark.createDataFrame([("", [])], f"path string, rules {_RULES_DDL}")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = None
    while True:
        level = written(folders.repartition(parts, "path").mapInArrow(_level(root, ignore_files), _FOUND), "level")
        files = level.filter("not folder").select("path", "mtime", "size", "taken")
        out = files if out is None else out.unionByName(files)
        folders = level.filter("folder").select("path", "rules")
        if not folders.limit(1).count():
            return out


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """listing (path, ...) with content and hash, read by the tasks; a file that went since, or holds no UTF-8, is left out. Content is one batch row at a time in a task."""
    columns = listing.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for k, path in enumerate(b.column("path").to_pylist()):
                try:
                    with system.open_input_stream(posixpath.join(base, path)) as f:
                        data = f.readall()
                    text = data.decode()
                except (FileNotFoundError, UnicodeDecodeError):
                    continue
                row = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([text]), pa.array([hashlib.sha256(data).hexdigest()])], [*columns, "content", "hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema)
    parts = 4 * int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listing.repartition(parts, "path").mapInArrow(run, f"{schema}, content string, hash string")


def scan(spark: SparkSession, root: str, max_bytes: int = config.MAX_FILE_BYTES, ignore_files: bool = True) -> DataFrame:
    """path, mtime, size, language, content, hash of the code files under root that are no larger than max_bytes.

    Only files that are taken are opened."""
    files = walk(spark, root, ignore_files).filter(F.col("taken") & (F.col("size") <= max_bytes))
    ends = F.lower(F.element_at(F.split("path", r"\."), -1))
    table = F.create_map(*[F.lit(x) for pair in config.LANGUAGES.items() for x in pair])
    own = read_files(files.select("path", "mtime", "size", F.element_at(table, ends).alias("language")), root)
    return own.select("path", "mtime", "size", "language", "content", "hash")


def scan_report(spark: SparkSession, root: str, max_bytes: int = config.MAX_FILE_BYTES) -> DataFrame:
    """One row: files found that are neither hidden nor ignored, those a scan takes, those it skips. No content is read."""
    takes = F.col("taken") & (F.col("size") <= max_bytes)
    return walk(spark, root).agg(F.count("*").alias("found"), F.count_if(takes).alias("queued"), F.count_if(~takes).alias("skipped"))
