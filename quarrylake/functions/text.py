"""Column functions over built-ins; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def language_of(path: Column) -> Column:
    """Language by extension, any case; null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in config.LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))


def excluded(path: Column) -> Column:
    """Whether a folder of a relative path is one that is never indexed."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    prefixes = "|".join(config.EXCLUDED_PREFIXES)
    return F.exists(folders, lambda p: p.isin(*config.EXCLUDED_DIRS) | p.endswith(".egg-info") | p.rlike(f"^({prefixes})"))


def score_of(distance: Column) -> Column:
    """Distance of unit vectors, 0 to 2, as a score from 1 to 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))


def normal_label(label: Column) -> Column:
    """Trimmed, lower-cased, without a leading article."""
    plain = F.lower(F.trim(label))
    return F.regexp_replace(F.regexp_replace(plain, "^the ", ""), "^a ", "")


def slug(name: Column) -> Column:
    """A file name: lower case, blanks to underscores, letters, digits, _ and - only."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), " ", "_"), r"[^\p{L}\p{N}_-]", "")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")
    return F.when(F.length(s) > 0, s).otherwise("_unnamed")


def first_line(text: Column, chars: int) -> Column:
    """The first line, cut at the last blank before chars, with an ellipsis if cut."""
    line = F.substring_index(text, "\n", 1)
    head = F.substring(line, 1, chars)
    at_word = F.coalesce(F.nullif(F.regexp_extract(head, r"^(.*)\s\S*$", 1), F.lit("")), head)
    return F.when(F.length(line) <= chars, line).otherwise(F.concat(at_word, F.lit("...")))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 3).when(severity == "warning", 2).when(severity == "info", 1).otherwise(0)


def duration_seconds(text: Column) -> Column:
    """15m, 2h, 3d, 1w as seconds; null if it is none."""
    n = F.regexp_extract(text, r"^(\d+)[mhdw]$", 1).try_cast("long")
    unit = F.right(text, F.lit(1))
    return n * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)


def day_of(epoch: Column) -> Column:
    """YYYY-MM-DD in UTC; unknown before 1970."""
    return F.when(epoch < 0, "unknown").otherwise(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd"))


def epoch_of(iso: Column) -> Column:
    """Seconds of an ISO time in Z, 0 for anything else."""
    return F.when(iso.endswith("Z"), F.coalesce(F.unix_timestamp(F.try_to_timestamp(iso)), F.lit(0))).otherwise(F.lit(0))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return F.coalesce(found, F.lit(False))


def short_id(key: Column) -> Column:
    """Eight characters after the first underscore."""
    return F.substring(F.regexp_extract(key, "_(.*)$", 1), 1, 8)


def version_triple(text: Column) -> Column:
    """Comparable struct of a semantic version."""
    p = F.split(F.regexp_replace(text, "^v", ""), r"\.")
    return F.struct(*[F.coalesce(F.get(p, i).try_cast("int"), F.lit(0)).alias(n) for i, n in enumerate(("major", "minor", "patch"))])


def title_cut(text: Column, chars: int) -> Column:
    """On one line, trimmed; what is longer than chars is cut, with an ellipsis behind."""
    line = F.trim(F.translate(text, "\n", " "))
    return F.when(F.length(line) <= chars, line).otherwise(F.concat(F.substring(line, 1, chars), F.lit("...")))


def entry_summary(kind: Column, text: Column, tool: Column, is_error: Column) -> Column:
    """One line on an entry of a session, by its kind."""
    said = F.coalesce(text, F.lit(""))
    return (
        F.when(kind == "tool_use", F.concat(F.lit("ToolUse: "), tool))
        .when(kind == "tool_result", F.concat(F.when(is_error, "[ERROR] ").otherwise("[OK] "), title_cut(said, 100)))
        .when(kind == "system", F.concat(F.lit("System: "), F.coalesce(text, F.lit("(none)"))))
        .when((kind == "assistant") & tool.isNotNull(), F.concat(title_cut(said, 80), F.lit(" [tools: "), tool, F.lit("]")))
        .otherwise(title_cut(said, 120))
    )


def error_snippet(text: Column, markers: tuple[str, ...], chars: int = 200) -> Column:
    """The first line that holds a marker, cut; null without one."""
    return F.substring(F.get(F.filter(F.split(text, "\n"), lambda x: contains_any(x, markers)), 0), 1, chars)


def upper_each(text: Column) -> Column:
    """Upper case letter for letter: ß is ẞ, and what has no single capital stays, so a text keeps its length and lower() finds it again."""
    big = lambda c: F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), big), "")


def utf8_units(text: Column) -> Column:
    """A text with a character, of code 0 to 255, for each byte of its UTF-8."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def time_ago(seconds: Column, singular: tuple[str, ...] = ("minute", "hour", "day")) -> Column:
    """Seconds that passed, in words; one of a unit in singular has no plural s."""
    unit, n = F.lit("second"), seconds
    for name, length in (("minute", 60), ("hour", 3600), ("day", 86400)):
        unit, n = F.when(seconds >= length, F.lit(name)).otherwise(unit), F.when(seconds >= length, F.floor(seconds / length)).otherwise(n)
    many = F.when((n == 1) & unit.isin(*singular), "").otherwise("s")
    return F.concat_ws(" ", n.cast("string"), F.concat(unit, many), F.lit("ago"))


def path_name(path: Column) -> Column:
    """A path as one name."""
    return F.translate(path, "/", "-")


def string_list(json: Column, key: str) -> Column:
    """The strings under a key: of an array its strings, of an object "name: string" for each of its strings; else none."""
    plain = F.from_json(F.get_json_object(json, f"$.{key}"), "array<variant>")
    named = F.from_json(F.get_json_object(json, f"$.{key}"), "map<string, variant>")

    def word(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    strings = F.filter(F.transform(plain, word), lambda x: x.isNotNull())
    pairs = F.transform(F.map_entries(named), lambda e: F.when(word(e["value"]).isNotNull(), F.concat(e["key"], F.lit(": "), word(e["value"]))))
    is_list = F.ltrim(F.get_json_object(json, f"$.{key}")).startswith("[")
    none = F.array().cast("array<string>")
    return F.when(is_list, F.coalesce(strings, none)).otherwise(F.coalesce(F.filter(pairs, lambda x: x.isNotNull()), none))


def residual(json: Column, keys: tuple[str, ...]) -> Column:
    """The object without those keys; null if it is none or nothing is left."""
    whole = F.from_json(json, "map<string, variant>")
    rest = F.map_filter(whole, lambda k, _: ~k.isin(*keys))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def new_id(prefix: str, *parts: Column) -> Column:
    """An id that depends on the parts alone, so that a task that runs again makes the same."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def agent_of(agent: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(agent), F.lit("")), F.lit("unknown"))


def symbol_kind(kind: Column) -> Column:
    """A stored kind; an unknown one is a function."""
    return F.when(kind.isin("function", "method", "class", "interface", "test", "import", "call_site"), kind).otherwise("function")


def pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is not 0, as a unit vector; zeros stay zeros."""
    own = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    width = F.coalesce(F.size(F.get(vectors, 0)), F.lit(0))
    zero = F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda _: F.lit(0.0))
    total = F.aggregate(own, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(total, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))
