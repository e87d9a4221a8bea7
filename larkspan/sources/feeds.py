"""XML feeds of listings and housing complexes."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions import texts
from larkspan.functions import values as V

# Element names of the feed by the type rule of their text, and the one that is never read.
IGNORED = "district"
LENIENT_INTS = ["newobject-id", "agency-id", "rooms"]
STRICT_INTS = ["time-on-foot", "floor", "floors-total", "built-year"]
TRUTHY = ["payed-adv", "manually-added", "new-flat"]
FLOATS = ["latitude", "longitude", "value", "ceiling-height"]
FLAGS = [
    "mortgage", "phone", "internet", "room-furniture", "television", "washing-machine", "refrigerator", "lift",
    "studio", "rubbish-chute", "water-supply", "sewerage-supply", "electricity-supply", "gas-supply",
]
TEXTS = ["type", "property-type", "category", "url", "creation-date", "last-update-date", "bathroom-unit"]
ID_ATTRIBUTE = "_internal-id"
# The text of a record that is no well-formed element; every other column of such a row is NULL.
MALFORMED = "_malformed"


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# Every leaf is read as text; the rules below give it its type.
OFFER_SCHEMA = T.StructType(
    [
        *_strings(ID_ATTRIBUTE, *TEXTS, *LENIENT_INTS[:1], "rooms", "payed-adv", "manually-added", "new-flat"),
        T.StructField(
            "location",
            T.StructType(
                [
                    *_strings("country", "region"),
                    T.StructField("locality-name", T.ArrayType(T.StringType())),
                    *_strings("sub-locality-name", "address", "latitude", "longitude"),
                    T.StructField("metro", T.StructType(_strings("name", "time-on-foot"))),
                ]
            ),
        ),
        T.StructField("price", T.StructType(_strings("value", "currency"))),
        T.StructField("area", T.StructType(_strings("value", "unit"))),
        T.StructField(
            "sales-agent", T.StructType(_strings("name", "phone", "category", "organization", "agency-id"))
        ),
        T.StructField("image", T.ArrayType(T.StringType())),
        *_strings("renovation", "floor", "floors-total", "built-year", "ceiling-height", "description", *FLAGS),
    ]
)

COMPLEX_SCHEMA = T.StructType(
    [
        *_strings("_id", "name", "region", "address"),
        T.StructField(
            "houses",
            T.StructType(
                [
                    T.StructField(
                        "house",
                        T.ArrayType(T.StructType(_strings("_Id", "name", "address"))),
                    )
                ]
            ),
        ),
    ]
)


def default_rules(unescape: Callable[[Column], Column] = texts.unescape_html) -> dict[str, Callable[[Column], Column]]:
    """Type rule per element name; a caller may add, replace or remove entries."""
    rules: dict[str, Callable[[Column], Column]] = {"unit": V.squeeze_unit, "renovation": V.blank_to_null}
    rules |= dict.fromkeys(LENIENT_INTS + STRICT_INTS, V.lenient_int)
    rules |= dict.fromkeys(TRUTHY, V.non_empty)
    rules |= dict.fromkeys(FLOATS, V.comma_float)
    rules |= dict.fromkeys(FLAGS, V.flag)
    rules["description"] = unescape
    return rules


def _records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """The text of each record of a UTF-8 XML file, plain or gzip; a plain file is read in splits.

    The file is cut at the closing tags and again before opening tags.
    """
    parts = spark.read.option("lineSep", f"</{row_tag}>").text(path)
    # Of a piece only its last part stands before the closing tag. The pattern begins with plain letters, which are looked for fast.
    pieces = F.split(F.concat("value", F.lit(f"</{row_tag}>")), f"<{row_tag}(?=[\\s/>])")
    named = parts.select(F.posexplode(pieces).alias("at", "piece"))
    # What stands before the first opening tag is no record, but for an element whose name only begins like it.
    opened = named.where((F.col("at") > 0) | F.startswith("piece", F.lit(f"<{row_tag}")))
    record = F.when(F.col("at") > 0, F.concat(F.lit(f"<{row_tag}"), "piece")).otherwise(F.col("piece"))
    # An element without content has no closing tag of its own.
    alone = rf"(?s)^(<{row_tag}(?:\s[^>]*)?/>).*$"
    closed = F.endswith(F.substring_index("record", ">", 1), F.lit("/"))
    shorter = F.when(closed, F.regexp_replace("record", alone, "$1")).otherwise(F.col("record"))
    return opened.select(record.alias("record")).select(shorter.alias("record"))


def read_rows(
    spark: SparkSession, path: str, row_tag: str, schema: T.StructType, partitions: int | None = None
) -> DataFrame:
    """Rows of a UTF-8 XML file, plain or gzip. Empty elements give '' so that blank and absent differ.

    Each record is parsed by itself: an element that is not well-formed costs no other one. Such a record keeps
    its text in ``_malformed``. With ``partitions`` the texts are spread before they are parsed.
    """
    kind = T.StructType([*schema, T.StructField(MALFORMED, T.StringType())])
    options = {
        "rowTag": row_tag, "nullValue": "\0", "ignoreSurroundingSpaces": "true", "columnNameOfCorruptRecord": MALFORMED,
    }
    records = _records(spark, path, row_tag)
    records = records.repartition(partitions) if partitions else records
    # A filter on the columns would move below a plain select and parse each record once more; it stays above an explode.
    return records.select(F.explode(F.array(F.from_xml("record", kind, options))).alias("row")).select("row.*")


LEAVES = T.StructType(
    [
        T.StructField("leaves", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))),
        T.StructField("last", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _leaves_of(record: str) -> list[tuple[str, str]] | None:
    """(path, text) of the attributes of the record and of its elements without children, in order; None if malformed."""
    # The paths of the open elements.
    open_paths: list[str] = []
    content: list[str] | None = None
    found: list[tuple[str, str]] = []

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal content
        if open_paths:
            content = []
            above = open_paths[-1]
            open_paths.append(f"{above}/{name}" if above else name)
        else:
            found.extend((f"_{k}", v) for k, v in attributes.items())
            open_paths.append("")

    def end(_: str) -> None:
        nonlocal content
        path = open_paths.pop()
        if content is not None:
            found.append((path, "".join(content).strip()))
            content = None

    def text(data: str) -> None:
        if content is not None:
            content.append(data)

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse(record, True)
    except expat.ExpatError:
        return None
    return found


def _pairs(found: list[list[tuple[str, str]] | None]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Where the pairs of each record begin, with NULL for a malformed one, and all paths and texts one after another."""
    ends = itertools.accumulate((len(f or ()) for f in found), initial=0)
    offsets = pa.array([end if f is not None else None for end, f in zip(ends, [*found, []], strict=True)], pa.int32())
    pairs = [pair for f in found if f is not None for pair in f]
    return offsets, pa.array([path for path, _ in pairs], pa.string()), pa.array([value for _, value in pairs], pa.string())


def _parse_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = batch.column("record").to_pylist()
        found = [_leaves_of(r) for r in records]
        offsets, paths, values = _pairs(found)
        # Of a repeated element the last one counts.
        last = _pairs([None if f is None else list(dict(f).items()) for f in found])
        columns = [
            pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([paths, values], ["path", "value"])),
            pa.MapArray.from_arrays(*last),
            pa.array([r if f is None else None for r, f in zip(records, found, strict=True)], pa.string()),
        ]
        yield pa.record_batch(columns, names=["leaves", "last", MALFORMED])


def read_leaves(spark: SparkSession, path: str, row_tag: str = "offer") -> DataFrame:
    """A1, B8. The leaves of each record in document order, whatever their names.

    ``leaves`` has path (elements below the record joined by ``/``, attributes of the record with ``_``) and text,
    ``last`` the last text of each path; a record that is not well-formed has only its text in ``_malformed``.
    """
    kind = T.StructType([*LEAVES, T.StructField(MALFORMED, T.StringType())])
    return _records(spark, path, row_tag).mapInArrow(_parse_leaves, kind)


def leaf_paths(rows: DataFrame) -> DataFrame:
    """B8. Every path of a feed, with the records that have it and how often at most: one aggregation."""
    per_record = F.transform(F.map_keys("last"), lambda k: F.struct(k.alias("path"), F.size(F.filter("leaves", lambda x: x["path"] == k)).alias("times")))
    each = rows.select(F.explode(per_record).alias("p")).select("p.*")
    return each.groupBy("path").agg(F.count(F.lit(1)).alias("records"), F.max("times").alias("most"))


def malformed(rows: DataFrame) -> DataFrame:
    """A1, A2. The text of the records that could not be parsed."""
    return rows.where(F.col(MALFORMED).isNotNull()).select(F.col(MALFORMED).alias("record"))


def read_offers(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A1. One nested row per ``<offer>``, malformed ones included.

    A gzip file is one task: pass ``partitions`` to spread its rows.
    """
    return read_rows(spark, path, "offer", OFFER_SCHEMA, partitions)


def _leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    for field in schema:
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, (*path, field.name))
        else:
            yield (*path, field.name), field.dataType


def flat_offers(offers: DataFrame, rules: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """B8-B11. Flat typed rows: element path joined by ``_``, one rule per leaf name.

    The agent's telephone keeps its text; the yes/no rule for ``phone`` is for the listing's own field. An id
    that is no number is NULL and listed in ``rejected_fields``; malformed records are left out.
    """
    offers = _well_formed(offers).drop(MALFORMED)
    localities = F.col("location.`locality-name`")
    given = {
        ("location", "locality-name"): first_locality(localities),
        ("location", "address"): F.coalesce(F.col("location.address"), later_locality(localities)),
    }
    return offers.select(*_typed(offers.schema, lambda path: F.col(".".join(f"`{name}`" for name in path)), given, rules))


def flat_leaves(rows: DataFrame, rules: dict[str, Callable[[Column], Column]] | None = None, schema: T.StructType = OFFER_SCHEMA) -> DataFrame:
    """B8-B11. As ``flat_offers``, from the leaves of ``read_leaves``, with their order and with unknown ones.

    Of address elements and localities after the first non-empty one, the last in the document is the address.
    ``other`` maps the paths that the schema lacks to their last text; ``district`` is ignored wherever it is.
    """
    locality, address = (lambda x: x["path"] == "location/locality-name"), (lambda x: x["path"] == "location/address")
    filled = F.transform("leaves", lambda x, i: F.when(locality(x) & (x["value"] != ""), i))
    # In a select of its own, or it is found again for every use.
    rows = _well_formed(rows).select("leaves", "last", F.array_min(filled).alias("settled"))
    addresses = F.filter("leaves", lambda x, i: address(x) | (locality(x) & (i > F.col("settled"))))
    given = {
        ("location", "locality-name"): F.coalesce(
            F.get("leaves", F.col("settled"))["value"], F.get(F.filter("leaves", locality), F.lit(0))["value"]
        ),
        ("location", "address"): F.try_element_at(addresses, F.lit(-1))["value"],
        ("image",): F.nullif(F.transform(F.filter("leaves", lambda x: x["path"] == "image"), lambda x: x["value"]), F.array().cast("array<string>")),
    }
    known = ["/".join(path) for path, _ in _leaves(schema)]
    columns = _typed(schema, lambda path: F.try_element_at("last", F.lit("/".join(path))), given, rules)
    other = F.map_filter("last", lambda k, _: ~k.isin(known) & (F.substring_index(k, "/", -1) != IGNORED))
    return rows.select(*columns, other.alias("other"))


def _typed(
    schema: T.StructType,
    source_of: Callable[[tuple[str, ...]], Column],
    given: dict[tuple[str, ...], Column],
    rules: dict[str, Callable[[Column], Column]] | None,
) -> list[Column]:
    """A column for every leaf of the schema and the list of those whose text has not the leaf's type."""
    rules = default_rules() if rules is None else rules
    columns, rejects = [], []
    for path, data_type in _leaves(schema):
        name, leaf = "_".join(path).replace("-", "_"), path[-1]
        source = given[path] if path in given else source_of(path)
        if leaf == ID_ATTRIBUTE:
            number = source.try_cast("long")
            columns.append(number.alias("id"))
            rejects.append(F.when(source.isNotNull() & number.isNull(), F.lit("id")))
        elif path in given or isinstance(data_type, T.ArrayType) or path == ("sales-agent", "phone") or leaf not in rules:
            columns.append(source.alias(name))
        else:
            columns.append(rules[leaf](source).alias(name))
            if leaf in LENIENT_INTS or leaf in STRICT_INTS:
                rejects.append(F.when(V.int_rejected(source, leaf in LENIENT_INTS), F.lit(name)))
            elif leaf in FLOATS:
                rejects.append(F.when(source.isNotNull() & V.comma_float(source).isNull(), F.lit(name)))
    # A filter of an array would leave the generated code, and all rules with it.
    named = F.array(*[F.coalesce(r, F.lit("")) for r in rejects])
    return [*columns, F.array_remove(named, "").alias("rejected_fields")]


def first_locality(names: Column) -> Column:
    """B10. The first non-empty name; '' if all are empty."""
    return F.coalesce(F.get(F.filter(names, lambda n: n != ""), F.lit(0)), F.get(names, F.lit(0)))


def later_locality(names: Column) -> Column:
    """B10. The last name after the first non-empty one, which the feed uses for the address."""
    first = F.array_position(F.transform(names, lambda n: n != ""), True)
    rest = F.when(first > 0, F.slice(names, first.cast("int") + 1, F.size(names)))
    return F.try_element_at(rest, F.lit(-1))


def read_complexes(spark: SparkSession, path: str) -> DataFrame:
    """A2. One nested row per ``<newobject>``."""
    return read_rows(spark, path, "newobject", COMPLEX_SCHEMA)


def complexes(nested: DataFrame) -> DataFrame:
    """A2. Parent rows, with the region's name in its normal spelling."""
    return _well_formed(nested).select(
        F.col("_id").try_cast("long").alias("id"), V.normal_region(F.col("region")).alias("region"), "name", "address"
    )


def houses(nested: DataFrame) -> DataFrame:
    """A2, D10. Child rows with the id of their complex."""
    children = _well_formed(nested).select(
        F.col("_id").try_cast("long").alias("newobject_id"), F.explode("houses.house").alias("h")
    )
    return children.select("newobject_id", F.col("h._Id").try_cast("long").alias("id"), "h.name", "h.address")


def _well_formed(nested: DataFrame) -> DataFrame:
    return nested.where(F.col(MALFORMED).isNull()) if MALFORMED in nested.columns else nested


def write_offers(offers: DataFrame, path: str, compression: str = "none") -> None:
    """Nested offers as a feed, a line each; malformed records are left out."""
    (
        _well_formed(offers).drop(MALFORMED).write.format("xml")
        .option("rowTag", "offer")
        .option("rootTag", "realty-feed")
        .option("indent", "")
        .option("compression", compression)
        .save(path)
    )


def feed_sample(offers: DataFrame, count: int = 100) -> DataFrame:
    """A13. The first offers by id; those without a numeric id come last, by its text."""
    identity = F.col(f"`{ID_ATTRIBUTE}`").cast("string")
    return _well_formed(offers).orderBy(F.asc_nulls_last(identity.try_cast("long")), identity).limit(count)


def offer_count(spark: SparkSession, path: str) -> DataFrame:
    """A14. Number of offers in a feed, malformed ones included."""
    # A record counts whether it can be parsed or not, so none is.
    return _records(spark, path, "offer").agg(F.count(F.lit(1)).alias("offers"))
