"""Text functions as column expressions. Nothing here runs Python for each row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.relations import REWRITES


def rewrite(text: Column, rules: list[tuple[str, str]] | str) -> Column:
    """Replaces literals one rule after another; rules may be the name of a surface's set."""
    pairs = REWRITES[rules] if isinstance(rules, str) else rules
    return reduce(lambda t, rule: F.replace(t, F.lit(rule[0]), F.lit(rule[1])), pairs, text)


def rewrite_by(text: Column, surface: Column) -> Column:
    """The rewrite of the surface that a row names; other surfaces leave the text as it is."""
    out = text
    for name in ("cursor", "opencode", "github", "agents"):
        out = F.when(surface == f".{name}", rewrite(text, name)).otherwise(out)
    return out


def strip_prefix(line: Column, pattern: str) -> Column:
    """Takes a matched pattern off the front."""
    return F.regexp_replace(line, f"^(?:{pattern})", "")


def unquoted(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit(""))


def byte_prefix(text: Column, n: int = 150) -> Column:
    """The first n bytes, as binary: a cut may split a character."""
    return F.substring(text.cast("binary"), 1, n)


def first_sentence(text: Column) -> Column:
    """Runs of spaces become one, one space at the end goes, and what follows the first full stop and space goes."""
    single = F.regexp_replace(F.regexp_replace(text, " +", " "), r" \z", "")
    return F.regexp_replace(single, r"(?s)\. .*", ".")


def basename(path: Column, suffix: str = "") -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.endswith(suffix) & (name != suffix), F.left(name, F.length(name) - len(suffix))).otherwise(name) if suffix else name


def dirname(path: Column) -> Column:
    """What is before the last slash; empty without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def relative(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def or_default(text: Column, default: Column) -> Column:
    """The empty string counts as missing."""
    return F.coalesce(F.nullif(text, F.lit("")), default)


def is_script(path: Column) -> Column:
    return path.rlike(r"\.(sh|py)$")


def indented(lines: Column, n: int = 10) -> Column:
    return F.transform(lines, lambda x: F.concat(F.lit(" " * n), x))


def tail(items: Column, n: int = 15) -> Column:
    """The last n elements, or all of fewer."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def lines_of(content: Column) -> Column:
    """The lines of a text, as awk has them: no last empty line, and none in an empty text."""
    text = F.regexp_replace(content, r"\n\z", "")
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n", -1))


def name_list(names: Column) -> Column:
    """Names in byte order, comma and space between; empty for none."""
    return F.array_join(F.array_sort(names), ", ")


def numbers_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+(?:[.][0-9]+)*"), F.lit(0))))


def citations_in(text: Column) -> Column:
    """Distinct citations: what stands in square brackets, and round brackets that end in a year."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[[^\[\]]+\]|\([^()]*[0-9]{4}[a-z]?\)"), F.lit(0))))


def sentences_of(text: Column) -> Column:
    """Sentences end with a full stop, or an exclamation or question mark, before white space."""
    marked = F.regexp_replace(text, "([.!?])[ \\t\\n\\f\\r]+", "$1\x01")
    return F.filter(F.split(marked, "\x01", -1), lambda s: s != "")
