"""Columns of messages: lines, chat ids, prompts and API payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that appear in rendered lines.
SEPARATOR = " | "
MEDIA_SUFFIX = {"photo": " <фото>", "document": " <документ>"}
OWN_NAME = "Я"
OTHER_NAME = "Пользователь"
MEDIA_TEXT = "<медиа-контент>"
STOP_WORD = "exit"
CHAT_KINDS = {"user": "Личный чат", "group": "Группа", "channel": "Канал"}


def message_line(date: Column, text: Column, media_kind: Column) -> Column:
    """B27. ``date | text`` with a mark for a photo or a document."""
    mark = F.lit("")
    for kind, shown in MEDIA_SUFFIX.items():
        mark = F.when(media_kind == kind, F.lit(shown)).otherwise(mark)
    return F.concat(date, F.lit(SEPARATOR), F.coalesce(text, F.lit("")), mark)


def line_date(line: Column) -> Column:
    """A6. Sort key of a stored line: the text before the first separator, '' without one."""
    return F.when(F.instr(line, SEPARATOR) > 0, F.substring_index(line, SEPARATOR, 1)).otherwise(F.lit(""))


def chat_kind(is_user: Column, is_group: Column) -> Column:
    """B28."""
    return (
        F.when(is_user, F.lit(CHAT_KINDS["user"]))
        .when(is_group, F.lit(CHAT_KINDS["group"]))
        .otherwise(F.lit(CHAT_KINDS["channel"]))
    )


def chat_id(username: Column, entity_id: Column, prefix: str = "id") -> Column:
    """B28. User name, or the prefix and the numeric id."""
    return F.coalesce(F.nullif(username, F.lit("")), F.concat(F.lit(prefix), entity_id.cast("string")))


def log_name(username: Column) -> Column:
    """B28. Name of a user's log: the user name without leading at-signs."""
    return F.concat(F.ltrim(username, F.lit("@")), F.lit(".log"))


def turn_line(is_own: Column, text: Column) -> Column:
    """B29. ``name: text`` as it appears in a prompt."""
    speaker = F.when(is_own, F.lit(OWN_NAME)).otherwise(F.lit(OTHER_NAME))
    shown = F.coalesce(F.nullif(text, F.lit("")), F.lit(MEDIA_TEXT))
    return F.concat(speaker, F.lit(": "), shown)


def prompt(template: str, history: Column) -> Column:
    """B29. The template with its ``{history}`` place filled."""
    before, after = template.split("{history}")
    return F.concat(F.lit(before), history, F.lit(after))


def role_line(date: Column, is_assistant: Column, text: Column) -> Column:
    """H5. Line of the log kept per user."""
    role = F.when(is_assistant, F.lit("ASSISTANT")).otherwise(F.lit("USER"))
    return F.concat(F.lit("["), F.date_format(date, "yyyy-MM-dd HH:mm:ss"), F.lit("] "), role, F.lit(": "), text)


def request_payload(model: str, content: Column, max_tokens: int) -> Column:
    """B36. Request body for a chat completion."""
    message = F.struct(F.lit("user").alias("role"), content.alias("content"))
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.array(message).alias("messages"),
            F.lit(max_tokens).alias("max_tokens"),
        )
    )


def answer_text(response: Column) -> Column:
    """B36. Answer in a response body."""
    return F.get_json_object(response, "$.choices[0].message.content")


def model_ids(response: Column) -> Column:
    """B36. Ids in a model listing."""
    return F.transform(F.from_json(response, "data array<struct<id string>>").getField("data"), lambda m: m["id"])
