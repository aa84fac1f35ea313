"""Text expressions. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters between tokens: everything but letters, numbers and the underscore, in any script.
BREAK = r"[^\p{L}\p{N}_]+"
#: Where identifiers come apart.
IDENTIFIER = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_:./\\-]+"
CODE_SYMBOL = r"(?m)^\s*(?:pub\s+|pub\(crate\)\s+|async\s+|export\s+|static\s+)*(?:def|fn|class|function|struct|impl|interface|type)\s+([A-Za-z_][A-Za-z0-9_]*)"
EXERCISES = (r"(?i)#\s*GRADED\s+CELL:\s*exercise\s+(\d+)", r"(?i)###\s*Exercise\s+(\d+)", r"(?i)Exercise\s+(\d+)")
CITATION = r"\[(?:\s*dsid_[0-9a-f]+\s*[,;]?\s*)+\]|dsid_[0-9a-f]+"


def tokens(text: Column) -> Column:
    """Lower-cased words in order; null text: none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def pieces(text: Column) -> Column:
    """Tokens with an empty one where the text begins or ends between tokens: cheaper than `tokens` where rows are exploded and filtered anyway."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK)


def filled(parts: Column) -> Column:
    """Number of tokens in pieces; only the first and the last can be empty."""
    first, last = (F.element_at(parts, 1) == "").cast("int"), (F.element_at(parts, -1) == "").cast("int")
    return F.when(F.size(parts) == 1, 1 - first).otherwise(F.size(parts) - first - last)


def identifier_words(text: Column) -> Column:
    """Text with identifier boundaries turned into spaces."""
    return F.regexp_replace(text, IDENTIFIER, " ")


def source_title(path: Column) -> Column:
    """Words of a file's name without its extension; none if the name is only a hash."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    words = F.trim(F.regexp_replace(stem, r"[_\-\s]+", " "))
    return F.when(F.replace(words, F.lit(" "), F.lit("")).rlike("^[0-9a-fA-F]{16,}$"), F.lit("")).otherwise(words)


def titled(title: Column, content: Column) -> Column:
    """The title heads the passage, where there is one."""
    return F.when(title != "", F.concat(title, F.lit("\n\n"), content)).otherwise(content)


def first_code_symbol(text: Column) -> Column:
    return F.regexp_extract(text, CODE_SYMBOL, 1)


def exercise_number(text: Column) -> Column:
    """The first of three spellings that is found; else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in EXERCISES])


def line_of(text: Column, offset: Column) -> Column:
    """Line, from 1, of a code point offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def line_location(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("L"), first)).otherwise(F.concat(F.lit("L"), first, F.lit("-L"), last))


def utf16_offset(text: Column, offset: Column) -> Column:
    """A code point offset in UTF-16 units."""
    return (F.octet_length(F.encode(F.substring(text, F.lit(1), offset), "UTF-16LE")) / 2).cast("long")


def strip_citations(text: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(F.regexp_replace(text, CITATION, ""), " {2,}", " "), F.lit(" ."), F.lit(".")))


def estimated_tokens(size: Column) -> Column:
    return F.floor(size / 4) + 1


def collapsed(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))
