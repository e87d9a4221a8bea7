"""Document corpus: duplicates, missing outputs, content sync, naming plans.

Nothing is moved or renamed here: every operator gives a table of actions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import names
from larkspan.operators.skew import MAX_GROUP_ROWS, attach, null_safe_join, number_rows, running_sum
from larkspan.operators.state import last_per_key
from larkspan.session import settle

# Extensions and how real types map to them.
VALID_EXTENSIONS = [".doc", ".docx", ".rtf"]
SOURCE_EXTENSIONS = [".doc", ".docx"]
TYPE_EXTENSIONS = {"doc": ".doc", "docx": ".docx", "rtf": ".rtf"}
TEXT_EXTENSION = ".txt"


def has_extension(name: Column, extensions: list[str] = VALID_EXTENSIONS) -> Column:
    """C5. The extension, in lower case, is in the list."""
    return F.lower(names.suffix(name)).isin(extensions)


def with_duplicate_key(files: DataFrame, content: str = "content") -> DataFrame:
    """E3. Add the key that copies share: group name, size in bytes, MD5."""
    data = F.col(content)
    return files.select(
        *[c for c in files.columns if c != content],
        names.group_name(names.stem(F.col("name"))).alias("base_name"),
        F.octet_length(data).cast("long").alias("size"),
        F.md5(data).alias("md5"),
    )


DUPLICATE_KEY = ["base_name", "size", "md5"]


def duplicate_groups(keyed: DataFrame) -> DataFrame:
    """E3. Keys with several files: their number, the redundant ones, and the first file by name."""
    return (
        keyed.groupBy(*DUPLICATE_KEY)
        .agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("name", "path")).alias("keeper"))
        .where("members > 1")
        .withColumn("redundant", F.col("members") - 1)
    )


def duplicate_plan(keyed: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """F5. The first file by name is kept under its clean name, every other one is a duplicate."""
    # From here on only names and keys are read, the contents once for the digest above.
    keyed = settle(keyed)
    rows = attach(keyed, duplicate_groups(keyed), DUPLICATE_KEY, ["path"], max_group_rows)
    is_keeper = F.col("path") == F.col("keeper.path")
    clean = F.concat(names.base_clean(names.stem(F.col("name"))), F.lit(TEXT_EXTENSION))
    return rows.select(
        "path",
        "name",
        F.when(is_keeper, "keep").otherwise("duplicate").alias("action"),
        F.when(is_keeper, clean).otherwise(F.col("name")).alias("new_name"),
        F.col("keeper.path").alias("keeper_path"),
    )


def named_duplicate_plan(plan: DataFrame, folder: DataFrame, moved: DataFrame) -> DataFrame:
    """F5, F8. The duplicate plan with names that are free where the file goes.

    ``folder`` holds the names in the texts' folder, ``moved`` those in the folder of duplicates. A
    keeper whose clean name is its own needs no new one.
    """
    renamed = (F.col("action") == "keep") & (F.col("new_name") != F.col("name"))
    keepers = plan.where(renamed).select("path", F.col("new_name").alias("name"))
    duplicates = plan.where("action = 'duplicate'").select("path", "name")
    given = unique_names(keepers, folder).unionByName(unique_names(duplicates, moved)).select("path", "new_name")
    return plan.drop("new_name").join(given, "path", "left").withColumn("new_name", F.coalesce("new_name", "name"))


def same_stem_groups(files: DataFrame) -> DataFrame:
    """E4. File names that differ only by extension or case."""
    return (
        files.where(F.contains("name", F.lit(".")))
        .groupBy(F.lower(names.stem(F.col("name"))).alias("stem"))
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min(F.when(has_extension(F.col("name")), F.struct("name", "path"))).alias("keeper"),
        )
        .where("members > 1")
    )


def extension_plan(files: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """F6. In a same-stem group with a valid file, the files with other extensions are quarantined.

    Further valid files stay where they are, and so does a group without any valid file.
    """
    dotted = files.where(F.contains("name", F.lit("."))).withColumn("stem", F.lower(names.stem(F.col("name"))))
    rows = attach(dotted, same_stem_groups(files), ["stem"], ["path"], max_group_rows)
    has_keeper, valid = F.col("keeper").isNotNull(), has_extension(F.col("name"))
    action = (
        F.when(has_keeper & (F.col("path") == F.col("keeper.path")), "keep")
        .when(has_keeper & ~valid, "quarantine")
        .otherwise("stay")
    )
    return rows.select("path", "name", "stem", action.alias("action"))


def repair_plan(files: DataFrame, format_column: str = "format") -> DataFrame:
    """F7. Valid extension: keep. Known real type: rename to it. Otherwise: quarantine."""
    pairs = [F.lit(text) for pair in TYPE_EXTENSIONS.items() for text in pair]
    real = F.try_element_at(F.create_map(*pairs), F.col(format_column))
    valid = has_extension(F.col("name"))
    action = F.when(valid, "keep").when(real.isNotNull(), "rename").otherwise("quarantine")
    renamed = F.concat(names.first_part(names.stem(F.col("name"))), real)
    return files.select(
        "path",
        "name",
        action.alias("action"),
        F.when(~valid & real.isNotNull(), renamed).otherwise(F.col("name")).alias("new_name"),
    )


def inventory_summary(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """E5. Totals of source and text files, distinct source names, names with several files."""
    is_source = F.coalesce(has_extension(F.col("name"), SOURCE_EXTENSIONS), F.lit(False))
    stem = F.when(is_source, F.lower(names.stem(F.col("name"))))
    files = (
        sources.groupBy(is_source.alias("is_source"), stem.alias("stem"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("is_source"), F.col("n"))), F.lit(0)).alias("source_files"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("all_files"),
            F.count_if("is_source").alias("distinct_names"),
            F.count_if(F.col("is_source") & (F.col("n") > 1)).alias("duplicated_names"),
        )
    )
    texts = outputs.agg(F.count_if(F.endswith("name", F.lit(TEXT_EXTENSION))).alias("text_files"))
    columns = ["source_files", "all_files", "text_files", "distinct_names", "duplicated_names"]
    counts = files.unionByName(texts, True)
    return counts.agg(*[F.sum(c).alias(c) for c in columns])


def duplicated_name_examples(sources: DataFrame, count: int = 3) -> DataFrame:
    """E5. The first names with several files, and how many."""
    return (
        sources.where(has_extension(F.col("name"), SOURCE_EXTENSIONS))
        .groupBy(F.lower(names.stem(F.col("name"))).alias("stem"))
        .agg(F.count(F.lit(1)).alias("members"))
        .where("members > 1")
        .orderBy("stem")
        .limit(count)
    )


def missing_outputs(sources: DataFrame, outputs: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """D4. Source files (dir, name) that still need an output.

    Without an output every file of the key does. With one, a single source is done, and of several
    all but the first by extension are still to be converted.
    """
    stem = F.lower(names.stem(F.col("name")))
    keyed = sources.withColumn("stem", stem)
    rank = F.struct(F.lower(names.suffix(F.col("name"))).alias("ext"), F.col("name"))
    facts = keyed.groupBy("dir", "stem").agg(F.count(F.lit(1)).alias("members"), F.min(rank).alias("first"))
    done = outputs.select("dir", stem.alias("stem")).distinct().withColumn("done", F.lit(True))
    facts = null_safe_join(facts, done, ["dir", "stem"], "left")
    open_groups = facts.where(F.col("done").isNull() | (F.col("members") > 1))
    is_rest = F.col("name") != F.col("first.name")
    return (
        attach(keyed, open_groups, ["dir", "stem"], ["name"], max_group_rows)
        .where(F.col("done").isNull() | is_rest)
        .select("dir", "name")
    )


def known_files(remote: DataFrame) -> DataFrame:
    """G6. Name -> id and hash of the stored files, under the URL's last part and under the name.

    Entries without a hash are unknown; of several entries for a name the last listed wins.
    """
    twice = F.array(
        F.struct(names.basename(F.col("url")).alias("name"), (F.col("position") * 2).alias("at")),
        F.struct(F.col("name"), (F.col("position") * 2 + 1).alias("at")),
    )
    entries = remote.where("description <> ''").select(
        "id", F.col("description").alias("hash"), F.inline(twice).alias("name", "at")
    )
    return last_per_key(entries.where("name <> ''"), ["name"], "at").drop("at")


def content_sync(local: DataFrame, remote: DataFrame) -> DataFrame:
    """D5. Each local file (name, hash) as NEW, CHANGED or UNCHANGED, with the id that is kept."""
    known = known_files(remote).select("name", F.col("id").alias("known_id"), F.col("hash").alias("known_hash"))
    same = F.col("known_hash") == F.col("hash")
    status = F.when(F.col("known_hash").isNull(), "NEW").when(same, "UNCHANGED").otherwise("CHANGED")
    return local.join(known, "name", "left").select(
        "name", "hash", status.alias("status"), F.when(same, F.col("known_id")).alias("kept_id")
    )


def unique_names(
    newcomers: DataFrame,
    taken: DataFrame,
    style: str = "parentheses",
    max_group_rows: int = MAX_GROUP_ROWS,
    scope: Sequence[str] = (),
) -> DataFrame:
    """F8. A free name for every newcomer (path, name), given the names already taken.

    ``scope`` names columns of both sides, such as the folder, within which a name must be free; a NULL scope
    is one of its own. Rows of ``taken`` from further folders can be added under the newcomer's scope.

    ``parentheses`` makes ``name(n).ext`` from the name as it is; ``underscore`` makes ``name_n.ext``
    after removing a trailing ``_digits``. Plain names are given out first, to the first newcomer by
    path; then the k-th remaining newcomer of a base gets the k-th number that is free for the base.
    A numbered name has exactly one base, so names of different bases cannot meet.
    """
    name = F.col("name")
    if style == "parentheses":
        base, ext = names.root(name), names.extension(name)
        pattern, opened, closed = r"(?s)^(.*)\(([1-9][0-9]{0,17})\)$", "(", ")"
    else:
        base, ext = F.regexp_replace(names.stem(name), "_[0-9]+$", ""), names.suffix(name)
        pattern, opened, closed = r"(?s)^(.*)_([1-9][0-9]{0,17})$", "_", ""

    scope = list(scope)
    group = [*scope, "base", "ext"]
    taken = settle(taken.select(*scope, "name"))
    plain = newcomers.groupBy(*scope, "name").agg(F.min("path").alias("path"))
    plain = settle(null_safe_join(plain, taken, [*scope, "name"], "left_anti"))
    rest = newcomers.join(plain.select("path"), "path", "left_anti")
    rest = settle(rest.select(*scope, "path", "name", base.alias("base"), ext.alias("ext")))
    rest = settle(number_rows(rest, group, [F.col("path")], "place", max_group_rows))

    whole = names.root(name) if style == "parentheses" else names.stem(name)
    numbered = (
        taken.unionByName(plain.select(*scope, "name")).distinct()
        .select(*scope, whole.alias("whole"), ext.alias("ext"))
        .where(F.col("whole").rlike(pattern))
        .select(
            *scope,
            F.regexp_extract("whole", pattern, 1).alias("base"),
            "ext",
            F.regexp_extract("whole", pattern, 2).cast("long").alias("number"),
        )
    )
    numbered = null_safe_join(numbered, rest.select(*group).distinct(), group, "left_semi")
    numbered = number_rows(settle(numbered), group, [F.col("number")], "nth", max_group_rows)

    # The nth used number stands before newcomer k if number - n < k: so many numbers below it are free.
    none = F.lit(None).cast("string")
    merged = rest.select(
        *group, (F.col("place") - 1).alias("slot"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"),
        "path", "name",
    ).unionByName(
        numbered.select(
            *group, (F.col("number") - F.col("nth")).alias("slot"), F.lit(0).alias("kind"),
            F.col("number").alias("tie"), none.alias("path"), none.alias("name"),
        )
    )
    order = [F.col("slot"), F.col("kind"), F.col("tie")]
    merged = running_sum(settle(merged), group, order, 1 - F.col("kind"), "used", max_group_rows)
    number = (F.col("slot") + 1 + F.col("used")).cast("string")
    given = merged.where("kind = 1").select(
        *scope, "path", "name", F.concat("base", F.lit(opened), number, F.lit(closed), "ext").alias("new_name")
    )
    return given.unionByName(plain.select(*scope, "path", "name", F.col("name").alias("new_name")))


def head_files(files: DataFrame, count: int) -> DataFrame:
    """F10. The first files by name."""
    return files.orderBy("name", "path").limit(count)


def file_labels(files: DataFrame, label: str = "Файл", max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """F12. ``label 1..n`` over the files in name order, numbered without one task sorting them all."""
    numbered = number_rows(files, [], [F.col("name"), F.col("path")], "ordinal", max_rows)
    return numbered.withColumn("label", F.concat(F.lit(label + " "), F.col("ordinal").cast("string")))
