"""Text of documents and pages: unescaping, transliteration, clean-up, chunks, checksums."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspan.functions.values import WHITESPACE

# Russian letters in Latin script, single letters and digraphs.
LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "з": "z", "и": "i", "й": "j",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ъ": "'", "ы": "y", "ь": "'", "э": "e",
}
DIGRAPHS = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "ju", "я": "ja"}
# Chunk size, step and marks.
CHUNK_TOKENS = 700
CHUNK_OVERLAP = 300
RTF_MARKUP = r"\\[a-z]+[0-9]*|\{[^}]+\}|\\'[0-9a-f]{2}"
RTF_TOOL_RULE = "----------"
BLOCK_PAGE_WORD = "Captcha"
TOKEN_BREAK = "[ \t\n\r\f\x0b]+"


def unescape_core(value: Column) -> Column:
    """B7. The five XML entities; the ampersand last, so that ``&amp;lt;`` is unescaped once."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


# The entities that are decoded without Python.
ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": "\xa0", "&laquo;": "«", "&raquo;": "»",
    "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&#39;": "'", "&#34;": '"', "&#38;": "&", "&#60;": "<", "&#62;": ">",
}
ENTITY_PARTS = "&[A-Za-z]+;|&#[0-9]+;|[^&]+|&"


@F.pandas_udf(StringType())
def _every_entity(value: pd.Series) -> pd.Series:
    return value.map(html.unescape, na_action="ignore")


def unescape_html(value: Column) -> Column:
    """B7. Every HTML entity. Only values with an ampersand that is no common entity are sent to Python."""
    known = F.create_map(*[F.lit(text) for pair in ENTITIES.items() for text in pair])
    parts = F.regexp_extract_all(value, F.lit(ENTITY_PARTS), F.lit(0))
    common = F.forall(parts, lambda p: ~F.startswith(p, F.lit("&")) | F.map_contains_key(known, p))
    decoded = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")
    rest = _every_entity(F.when(~common, value))
    return F.when(common, decoded).otherwise(rest)


def transliterate(value: Column) -> Column:
    """B26. Russian letters in Latin script; other characters stay."""
    for letter, latin in DIGRAPHS.items():
        value = F.replace(value, F.lit(letter), F.lit(latin))
        value = F.replace(value, F.lit(letter.upper()), F.lit(latin.capitalize()))
    small, latin = "".join(LETTERS), "".join(LETTERS.values())
    return F.translate(value, small + small.upper(), latin + latin.upper())


def rtf_to_text(value: Column) -> Column:
    """B30. RTF without control words, groups and hex characters, and without runs of empty lines."""
    return F.regexp_replace(F.regexp_replace(value, RTF_MARKUP, ""), "\n{3,}", "\n\n")


def cut_at_rule(value: Column) -> Column:
    """B30. Output of the RTF tool up to its rule line."""
    return F.substring_index(value, RTF_TOOL_RULE, 1)


def tokens(value: Column) -> Column:
    """Words between white space; an empty array for blank text."""
    text = F.trim(value, F.lit(WHITESPACE))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, TOKEN_BREAK))


def chunk_starts(count: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """B34. Offsets of the chunks of ``count`` tokens.

    A chunk follows its predecessor by ``size - overlap`` tokens; it exists if it would hold a token
    that its predecessor lacks. Blank text has no chunk.
    """
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(count - F.lit(overlap + 1), F.lit(0)), F.lit(step))
    return F.when(count > 0, starts).otherwise(F.array().cast("array<int>"))


def chunks(words: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """B34. Chunks of an array of tokens, as an array of arrays.

    ``words`` should be a column of an earlier select, or the text is split again for every chunk.
    """
    return F.transform(chunk_starts(F.size(words), size, overlap), lambda s: F.slice(words, s + 1, F.lit(size)))


def is_block_page(text: Column) -> Column:
    """C6. The page is a robot check."""
    return F.contains(text, F.lit(BLOCK_PAGE_WORD))


def is_block_page_after_start(text: Column) -> Column:
    """C6. Variant that ignores the word at the very start of the text."""
    return F.instr(text, BLOCK_PAGE_WORD) > 1


def checksums(value: Column) -> dict[str, Column]:
    """B20. Three digests of the content."""
    return {"md5": F.md5(value), "sha256": F.sha2(value, 256), "crc32": F.crc32(value)}


def signature_format(content: Column) -> Column:
    """B19. doc, rtf or zip by the first bytes; zip is decided by its listing in ``documents``."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head == "D0CF11E0A1B11AE1", "doc")
        .when(F.startswith(head, F.lit("504B0304")), "zip")
        .when(F.startswith(head, F.lit("7B5C727466")), "rtf")
        .otherwise("unknown")
    )


def first_success(attempts: list[tuple[str, Column, Column]]) -> Column:
    """B32. Outcome of a chain of (method, text, error) attempts.

    The first non-empty text wins. Without one, the errors are joined in the order of the attempts.
    """
    texts = [F.nullif(text, F.lit("")) for _, text, _ in attempts]
    method = F.coalesce(*[F.when(text.isNotNull(), F.lit(name)) for (name, _, _), text in zip(attempts, texts)])
    errors = [
        F.when(error.isNotNull(), F.concat(F.lit(f"{name}: "), error)) for name, _, error in attempts
    ]
    text = F.coalesce(*texts)
    return F.struct(
        text.alias("text"),
        method.alias("method"),
        F.when(text.isNull(), F.concat_ws("; ", *errors)).alias("errors"),
    )
