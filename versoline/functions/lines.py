"""Extractors over a document's lines.

Each is an expression over the array of lines: first matches and boundaries need no state machine, and no
shuffle, as a file's lines stay in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import byte_prefix, first_sentence, lines_of, or_default, rewrite, strip_prefix, unquoted

BLANK = r"^\s*$"


def first_where(items: Column, keep) -> Column:
    """Position, from 1, of the first element for which keep(element) holds; 0 if there is none."""
    marks = F.transform(items, lambda x: F.when(keep(x), 1).otherwise(0))
    return F.array_position(marks, 1)


def closing(lines: Column) -> Column:
    """Where the front matter ends: the closing --- of a file that opens with one; size + 1 if never; 0 without front matter."""
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))
    at = F.array_position(rest, "---")
    found = F.when(at == 0, F.size(lines) + 1).otherwise(at + 1)
    return F.when(F.try_element_at(lines, F.lit(1)) == "---", found).otherwise(F.lit(0)).cast("int")


def after(lines: Column, n: Column) -> Column:
    """The lines behind the n-th."""
    return F.slice(lines, n + 1, F.greatest(F.size(lines), F.lit(1)))


def description(lines: Column) -> Column:
    """The front matter's description, or else the first prose line, without quotes; 150 bytes at most."""
    end = closing(lines)
    head = F.slice(lines, F.lit(1), F.least(end, F.size(lines)))
    keyed = F.filter(head, lambda x: x.startswith("description:"))
    prose = F.filter(after(lines, end), lambda x: ~x.startswith("<") & ~x.startswith("#") & ~x.rlike(BLANK))
    found = F.when(F.size(keyed) > 0, strip_prefix(F.try_element_at(keyed, F.lit(1)), "description:[ ]*")).otherwise(F.try_element_at(prose, F.lit(1)))
    return byte_prefix(unquoted(F.coalesce(found, F.lit(""))))


def command_body(lines: Column) -> Column:
    """The text without a comment on line 1 or front matter; blank lines at the start go unless front matter was closed."""
    end = closing(lines)
    comment = F.try_element_at(lines, F.lit(1)).rlike(r"^<(\\!|!)--")
    skipped = F.when(F.coalesce(comment, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    start = first_where(after(lines, skipped), lambda x: ~x.rlike(BLANK))
    plain = F.when(start == 0, F.array().cast("array<string>")).otherwise(after(after(lines, skipped), (start - 1).cast("int")))
    return F.array_join(F.when(end > 0, after(lines, end)).otherwise(plain), "\n")


def summary(lines: Column) -> Column:
    """The first sentence of the opening paragraph. Comment and heading lines are passed over; only a blank line ends it."""
    kept = F.filter(lines, lambda x: ~x.startswith("<!--") & ~x.startswith("#"))
    start = first_where(kept, lambda x: ~x.rlike(BLANK))
    rest = after(kept, (start - 1).cast("int"))
    stop = first_where(rest, lambda x: x.rlike(BLANK))
    paragraph = F.when(stop == 0, rest).otherwise(F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))
    joined = F.when(start == 0, F.lit("")).otherwise(F.concat(F.array_join(paragraph, " "), F.lit(" ")))
    return first_sentence(joined)


def title(lines: Column, stem: Column) -> Column:
    """The first H1's text, or the stem."""
    heads = F.filter(lines, lambda x: x.startswith("# "))
    return or_default(F.coalesce(strip_prefix(F.try_element_at(heads, F.lit(1)), "# +"), F.lit("")), stem)


def inline_rules(lines: Column) -> Column:
    """The text without copyright comments, its paths rewritten so that it stands alone."""
    kept = F.filter(lines, lambda x: ~F.contains(x, F.lit("<!-- Copyright")) & ~F.contains(x, F.lit("<\\!-- Copyright")))
    return rewrite(F.array_join(kept, "\n"), "inline_rules")


def with_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(all columns, n, line): a row per line, numbered from 1."""
    return files.select("*", F.posexplode(lines_of(F.col(content).cast("string"))).alias("n", "line")).withColumn("n", F.col("n") + 1)
