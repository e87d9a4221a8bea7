"""Document registry: dump items to links, known links, sources and their status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from larkspan.functions import names
from larkspan.operators.state import first_per_key, upsert
from larkspan.session import settle

# What the dump is filtered by and how outcomes are called.
CATEGORY_PART = "долев"
LINK_PREFIX = "http"
OUTCOMES = {
    "success": "success",
    "download": "download_failed",
    "extract": "extraction_failed",
    "empty": "empty_archive",
}
FUNNEL = ["total", "valid_json", "matching_category", "has_attachments", "valid_links", "new_links", "existing_links"]


def category_text(item: str = "item") -> Column:
    """C3. Category as text: '' if missing, 'none' for JSON null, numbers as written."""
    value = F.try_variant_get(item, "$.category", "string")
    is_null = F.schema_of_variant(F.try_variant_get(item, "$.category", "variant")) == "VOID"
    return F.coalesce(value, F.when(is_null, F.lit("none")), F.lit(""))


def contains_folded(text: Column, part: str) -> Column:
    """C3. Case-folded containment."""
    return F.contains(F.lower(text), F.lower(F.lit(part)))


def is_link(kind: Column, link: Column) -> Column:
    """C4. The link is a JSON string and starts like a web address."""
    return F.coalesce((kind == "STRING") & F.startswith(link, F.lit(LINK_PREFIX)), F.lit(False))


def categorised(items: DataFrame, part: str = CATEGORY_PART) -> DataFrame:
    """C3. Parsed lines whose item is in the category, with its attachments variant."""
    return items.where(F.col("item").isNotNull() & contains_folded(category_text(), part)).select(
        F.try_variant_get("item", "$.attachments", "variant").alias("attachments")
    )


def has_attachments(attachments: Column) -> Column:
    """E6. Present and neither null, empty, zero nor false."""
    return F.coalesce(~F.to_json(attachments).isin("null", "[]", "{}", '""', "0", "false"), F.lit(False))


def valid_links(attachments: Column) -> Column:
    """C4. The valid links of an attachments variant as an array."""

    def link(a: Column) -> Column:
        value = F.try_variant_get(a, "$.link", "variant")
        text = F.try_variant_get(a, "$.link", "string")
        return F.when(is_link(F.schema_of_variant(value), text), text)

    elements = F.try_variant_get(attachments, "$", "array<variant>")
    return F.array_compact(F.transform(elements, link))


def attachment_rows(categorised_items: DataFrame) -> DataFrame:
    """D10, C4. One row per attachment object with its link, type-checked, and its display name."""
    elements = F.expr("try_variant_get(attachments, '$', 'array<variant>')")
    link = F.try_variant_get("a", "$.link", "variant")
    return (
        categorised_items.select(F.explode(elements).alias("a"))
        .where(F.startswith(F.schema_of_variant("a"), F.lit("OBJECT")))
        .select(
            F.schema_of_variant(link).alias("kind"),
            F.try_variant_get("a", "$.link", "string").alias("link"),
            F.try_variant_get("a", "$.displayName", "string").alias("display_name"),
        )
        .select("link", "display_name", is_link(F.col("kind"), F.col("link")).alias("is_valid"))
    )


def unknown_links(links: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    """D3. Links that the registry lacks; all of them when forced."""
    return links if force else links.join(registry.select("url"), links["link"] == registry["url"], "left_anti")


def registry_rows(
    links: DataFrame, registry: DataFrame, run_at: Column, source_id: int = 1
) -> DataFrame:
    """D3, G3, B18. Rows to append for the valid links of a dump: one per new URL."""
    # One row per URL before the join, so that a URL that fills the dump is no hot key in it. Forcing
    # loads a known file again, but a known URL never gets a second row.
    fresh = first_per_key(links.where("is_valid"), ["link"], [F.col("display_name").asc_nulls_last()])
    return new_rows(unknown_links(fresh, registry), run_at, source_id)


def new_rows(fresh: DataFrame, run_at: Column, source_id: int = 1) -> DataFrame:
    """B18. Registry rows of links that are new."""
    name = names.attachment_name(F.col("link"), F.col("display_name"), run_at)
    return fresh.select(
        F.lit(source_id).cast("int").alias("source_id"),
        run_at.alias("download_date"),
        F.col("link").alias("url"),
        name.alias("original_file_name"),
        F.concat(name, F.lit(".txt")).alias("txt_file_name"),
        run_at.alias("created_at"),
        run_at.alias("updated_at"),
    )


def link_rows(links: DataFrame, source_id: Column, run_at: Column) -> DataFrame:
    """A4, B17. Registry rows of a link list; links are appended as they are, repeats included."""
    name = names.url_file_name(F.col("url"))
    return links.select(
        source_id.alias("source_id"),
        run_at.alias("download_date"),
        "url",
        name.alias("original_file_name"),
        names.text_file_name(name).alias("txt_file_name"),
        run_at.alias("created_at"),
        run_at.alias("updated_at"),
    )


def funnel(items: DataFrame, registry: DataFrame, part: str = CATEGORY_PART) -> DataFrame:
    """E6. One row of counts per level. A URL seen twice is new once and existing after that."""
    attachments = F.try_variant_get("item", "$.attachments", "variant")
    matches = F.coalesce(contains_folded(category_text(), part), F.lit(False))
    # The dump is parsed once, into flags and the valid links of each line; the levels are counted as it is written.
    seen = Observation()
    rows = settle(
        items.select("is_json", F.col("item").isNotNull().alias("is_object"), matches.alias("m"), attachments.alias("a"))
        .select("is_json", (F.col("is_object") & F.col("m")).alias("matches"), "a")
        .select(
            "is_json", "matches", (F.col("matches") & has_attachments(F.col("a"))).alias("attached"),
            F.when(F.col("matches"), valid_links(F.col("a"))).alias("links"),
        )
        .observe(
            seen,
            F.count(F.lit(1)).alias("total"),
            F.count_if("is_json").alias("valid_json"),
            F.count_if("matches").alias("matching_category"),
            F.count_if("attached").alias("has_attachments"),
        )
    )
    lines = items.sparkSession.createDataFrame([tuple(seen.get[level] for level in FUNNEL[:4])], ", ".join(f"{level} long" for level in FUNNEL[:4]))
    # Counted per URL first, so a URL that fills the dump is one row in the join.
    per_url = rows.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("seen"))
    known = registry.select(F.col("url").alias("link")).distinct().withColumn("known", F.lit(True))
    is_new = F.col("known").isNull()
    links = per_url.join(known, "link", "left").agg(
        F.coalesce(F.sum("seen"), F.lit(0)).alias("valid_links"),
        F.count_if(is_new).alias("new_links"),
        F.coalesce(F.sum("seen"), F.lit(0)).alias("_seen"),
    )
    links = links.select("valid_links", "new_links", (F.col("_seen") - F.col("new_links")).alias("existing_links"))
    counts = lines.unionByName(links, True)
    return counts.agg(*[F.sum(level).alias(level) for level in FUNNEL])


def default_source_id(sources: DataFrame) -> DataFrame:
    """F1. The lowest source id."""
    return sources.agg(F.min("id").alias("id"))


def remaining_sources(sources: DataFrame) -> DataFrame:
    """F2. Every source but the one with the lowest id, without a global sort."""
    return sources.where(F.col("id") > default_source_id(sources).scalar()).select("id", "url")


def outcome(downloaded: Column, extracted: Column, files: Column) -> Column:
    """G4. Status of a source by its first failed step."""
    return (
        F.when(~downloaded, OUTCOMES["download"])
        .when(~extracted, OUTCOMES["extract"])
        .when(files == 0, OUTCOMES["empty"])
        .otherwise(OUTCOMES["success"])
    )


def status_changes(results: DataFrame, run_at: Column) -> DataFrame:
    """G4. Time and status of this run for each source with a result."""
    return results.select(
        "id",
        run_at.alias("last_update"),
        outcome(F.col("downloaded"), F.col("extracted"), F.col("files")).alias("update_status"),
    )


def update_status(sources: DataFrame, results: DataFrame, run_at: Column) -> DataFrame:
    """G4. Sources with the time and status of this run; sources without a result are unchanged."""
    known = status_changes(results, run_at).join(sources.select("id"), "id", "left_semi")
    return upsert(sources, known, "id", ["last_update", "update_status"])


def stale_snapshots(remote: DataFrame, local: DataFrame) -> DataFrame:
    """C11. Remote files to load again: no local copy, another size, or 2 whole seconds apart or more."""
    r, o = remote.alias("r"), local.alias("o")
    seconds = F.abs(F.floor("r.mtime") - F.floor("o.mtime"))
    fresh = F.coalesce((F.col("r.size") == F.col("o.size")) & (seconds < 2), F.lit(False))
    return r.join(o, F.col("r.path") == F.col("o.path"), "left").select("r.*", (~fresh).alias("reload"))


def totals(actions: DataFrame, by: str = "status") -> DataFrame:
    """E7, E12. Rows per status or action."""
    return actions.groupBy(by).agg(F.count(F.lit(1)).alias("files"))
