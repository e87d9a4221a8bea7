"""Rules for file names and URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.values import strip

# The replacements, lengths and names that results must agree on.
NAME_REPLACEMENTS = {
    "<": "(",
    ">": ")",
    ":": "_",
    '"': "'",
    "/": "_",
    "\\": "_",
    "|": "_",
    "?": "_",
    "*": "_",
    "\t": " ",
    "\n": " ",
    "\r": " ",
}
NAME_MAX_LENGTH = 200
EMPTY_NAME = "document"
CLEAN_EXTENSION = ".docx"
UNNAMED_FILE = "unnamed_file"
DEFAULT_ATTACHMENT_EXTENSION = ".pdf"
UNSAFE_IN_ATTACHMENT = r'[\\/*?:"<>|]'
STAMP = "yyyyMMdd_HHmmss"
STAMP_COMPACT = "yyyyMMddHHmmss"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _after_dot(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def suffix(name: Column) -> Column:
    """B16. Extension with its dot, '' for none; it needs a character on both sides of the dot."""
    tail = _after_dot(name)
    whole = (tail != "") & (F.length(tail) + 1 < F.length(name))
    return F.when(whole, F.concat(F.lit("."), tail)).otherwise(F.lit(""))


def stem(name: Column) -> Column:
    """B16. Name without ``suffix``."""
    return F.left(name, F.length(name) - F.length(suffix(name)))


def root(name: Column) -> Column:
    """B16. Name before the last dot, where leading dots never count."""
    return F.left(name, F.length(name) - F.length(extension(name)))


def extension(name: Column) -> Column:
    """B16. The part that ``root`` cuts off; it may be a single dot at the end."""
    tail = _after_dot(name)
    head = F.left(name, F.length(name) - F.length(tail) - 1)
    return F.when(F.ltrim(head, F.lit(".")) != "", F.concat(F.lit("."), tail)).otherwise(F.lit(""))


def first_part(name: Column) -> Column:
    """B16. Everything before the first dot."""
    return F.substring_index(name, ".", 1)


def _any_of(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def strict_clean(name: Column) -> Column:
    """B14. A safe name of bounded length with a fixed extension."""
    text = strip(stem(name))
    # A dot is replaced like the rest; runs of blanks and of underscores shrink to one.
    to_blank = [c for c, new in NAME_REPLACEMENTS.items() if new == " "]
    to_underscore = [c for c, new in NAME_REPLACEMENTS.items() if new == "_"]
    text = F.regexp_replace(text, _any_of([" ", "\f", "\x0b", *to_blank]) + "+", " ")
    text = F.regexp_replace(text, _any_of(["_", ".", *to_underscore]) + "+", "_")
    for char, new in NAME_REPLACEMENTS.items():
        if new not in (" ", "_"):
            text = F.replace(text, F.lit(char), F.lit(new))
    text = F.left(text, F.lit(NAME_MAX_LENGTH))
    # By pattern and not by a condition, which would compute the text twice.
    return F.concat(F.regexp_replace(text, "^$", EMPTY_NAME), F.lit(CLEAN_EXTENSION))


def base_clean(stem_text: Column) -> Column:
    """B15. Stem without edge marks and without a copy number at its end."""
    text = F.ltrim(strip(stem_text), F.lit("_"))
    text = strip(F.rtrim(text, F.lit(".")))
    text = F.regexp_replace(text, r"[ \t\n\r\f\x0b_]*\(?[0-9]+\)?$", "")
    return F.rtrim(strip(text), F.lit("."))


def group_name(stem_text: Column) -> Column:
    """B15. The name that copies share: ``base_clean`` without any number at its end, in lower case."""
    return F.lower(F.regexp_replace(base_clean(stem_text), r"[ \t\n\r\f\x0b_]*[0-9]+$", ""))


def url_file_name(url: Column) -> Column:
    """B17. Last path segment of a URL, without query, fragment and parameters, not decoded."""
    path = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(path, "(?s)[?#].*$", "")
    name = F.substring_index(basename(path), ";", 1)
    return F.when(name == "", F.lit(UNNAMED_FILE)).otherwise(name)


def text_file_name(name: Column) -> Column:
    """B17. Name of the text made from a file."""
    return F.concat(root(name), F.lit(".txt"))


def attachment_name(url: Column, display_name: Column, run_at: Column) -> Column:
    """B18. Stored name of an attachment; ``run_at`` is the time of the run."""
    ending = extension(basename(url))
    ending = F.when(ending == "", F.lit(DEFAULT_ATTACHMENT_EXTENSION)).otherwise(ending)
    shown = F.when(F.coalesce(display_name, F.lit("")) != "", F.concat(display_name, ending)).otherwise(
        F.concat(F.lit("doc_"), F.date_format(run_at, STAMP_COMPACT))
    )
    return F.concat(F.date_format(run_at, STAMP), F.lit("_"), F.regexp_replace(shown, UNSAFE_IN_ATTACHMENT, "_"))


def archive_name(source_id: Column, run_at: Column) -> Column:
    """B35. Name of a downloaded source archive."""
    return F.concat(F.lit("dataset_"), source_id, F.lit("_"), F.date_format(run_at, STAMP), F.lit(".zip"))


def conversion_log_line(run_at: Column, succeeded: Column, path: Column, seconds: Column) -> Column:
    """B35. One line of the conversion log: time, status label, file, elapsed seconds."""
    label = F.when(succeeded, F.lit("Успешно")).otherwise(F.lit("Ошибка"))
    elapsed = F.format_string("%.2f сек", seconds)
    return F.concat_ws(" | ", F.date_format(run_at, "yyyy-MM-dd HH:mm:ss"), label, path, elapsed)
