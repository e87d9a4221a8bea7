"""Line-oriented inputs: JSON dumps, link lists, message logs, conversion logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions.chat import line_date
from larkspan.functions.values import strip
from larkspan.session import small

# Fixed value: the conversion log's message about a file that could not be read.
DAMAGED_FILE = r"Ошибка конвертации (.*?\.docx?):"


def parse_json_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """A3. Non-blank lines as ``line``, ``is_json`` and the variant ``item``, NULL unless an object.

    Leading commas are dropped. Spark's parser accepts text after the value, so a line counts as JSON
    only if it is exactly one element of an array and one member of an object.
    """
    # Of a key that is given twice the last value counts; without the setting such a line would be no JSON.
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = strip(F.col(column))
    rows = lines.where((text != "") & (text != ",")).select(F.ltrim(F.col(column), F.lit(",")).alias("line"))
    elements = F.expr("cast(try_parse_json(concat('[', line, ']')) as array<variant>)")
    member = F.expr("try_parse_json(concat('{\"v\":', line, '}'))")
    item = F.get(elements, F.lit(0))
    is_json = F.coalesce((F.size(elements) == 1) & member.isNotNull(), F.lit(False))
    is_object = F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))
    return rows.select("line", is_json.alias("is_json"), F.when(is_json & is_object, item).alias("item"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """A3."""
    return parse_json_lines(spark.read.text(path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """A4. Lines with their number over the whole input, from 0, in the order of files and offsets.

    Only one count per file split is kept: a line's number is the number of lines in earlier splits
    plus its place in its own split. No line moves between tasks.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    splits = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row per split, so one small sort for any input.
    in_order = Window.partitionBy(F.lit(0)).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(splits.withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0))).drop("n"))
    return lines.join(offsets, ["file", "start"]).select(
        (F.col("before") + F.col("row") - F.col("first")).alias("line_no"), "value"
    )


def lines_after(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """A4. The lines after the first ``skip``, by file and offset, without joining all lines.

    The counts of the splits show in which one the boundary lies. Later splits are kept whole by a filter
    on file and offset, and only the boundary's own lines are numbered.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    if skip <= 0:
        return lines.select("value")
    splits = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row per split, so one small sort for any input.
    in_order = Window.partitionBy(F.lit(0)).orderBy("file", "start").rowsBetween(Window.unboundedPreceding, 0)
    upto = splits.withColumn("upto", F.sum("n").over(in_order))
    boundary = upto.where(F.col("upto") > skip).orderBy("file", "start").limit(1).collect()
    if not boundary:
        return lines.limit(0).select("value")
    file, start, first, n, end = boundary[0]
    later = (F.col("file") > file) | ((F.col("file") == file) & (F.col("start") > start))
    inside = (F.col("file") == file) & (F.col("start") == start) & (F.col("row") - first >= skip - (end - n))
    return lines.where(later | inside).select("value")


def links(lines: DataFrame, skip: int = 0) -> DataFrame:
    """A4. Links after the first ``skip`` lines; a skip beyond the end gives no rows."""
    url = strip(F.col("value"))
    return lines.where((F.col("line_no") >= skip) & F.startswith(url, F.lit("http"))).select(
        "line_no", url.alias("url")
    )


def read_message_log(spark: SparkSession, path: str) -> DataFrame:
    """A6. Stored message lines with their sort key."""
    return message_log(spark.read.text(path))


def message_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """A6."""
    return lines.select(line_date(F.col(column)).alias("date"), F.col(column).alias("line"))


def damaged_file(line: Column) -> Column:
    """A7. File named by a conversion error, else NULL."""
    return F.nullif(F.regexp_extract(line, DAMAGED_FILE, 1), F.lit(""))


def damaged_files(lines: DataFrame, column: str = "value") -> DataFrame:
    """A7, E11. Distinct names of files that could not be converted."""
    return lines.select(damaged_file(F.col(column)).alias("name")).where("name IS NOT NULL").distinct()
