"""Page documents: strict JSON test, shape repair, typed form and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.functions.text import clean_key, to_int

# The entry fields, their older names and the flag defaults.
TEXT_FIELDS = (
    "mr", "townland", "os", "sublocation_1", "sublocation_2", "occupier", "lessor", "desc", "area",
    "land_val", "building_val", "total_val",
)
FLAG_DEFAULTS = {"n_shared": 1, "is_total": 0, "is_exemption": 0, "is_continued": 0}
OLD_NAMES = {
    "mr": "map_reference",
    "desc": "description",
    "land_val": "land_valuation",
    "building_val": "building_valuation",
    "total_val": "total_valuation",
}
UNKNOWN_PARISH = "UNKNOWN"

_ENTRY = ", ".join(f"{f}: string" for f in (*TEXT_FIELDS, *FLAG_DEFAULTS, *OLD_NAMES.values()))
DOCUMENT_SCHEMA = f"parishes array<struct<parish: string, entries: array<struct<{_ENTRY}>>>>"


def marked_json(text: Column) -> Column:
    """The text parsed as the first item of an array whose second item is the text's own digest.

    The parser ignores what follows the first value; the mark shows whether anything did.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))


def is_marked_strict(marked: Column, text: Column) -> Column:
    """Whether a text, parsed by ``marked_json``, is exactly one JSON value."""
    exact = (F.try_variant_get(marked, "$[1]", "string") == F.md5(text)) & F.try_variant_get(marked, "$[2]", "variant").isNull()
    return F.coalesce(exact, F.lit(False))


def is_strict_json(text: Column) -> Column:
    """True if the whole text is exactly one JSON value."""
    return is_marked_strict(marked_json(text), text)


def _kind(variant: Column) -> Column:
    """ARRAY, OBJECT, VOID or a scalar type name; null for a missing value."""
    return F.regexp_extract(F.schema_of_variant(variant), r"^\w+", 0)


def _items(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "array<variant>")


def _is_block_list(parishes: Column) -> Column:
    """Every item is an object whose entries are absent or a list."""
    return F.forall(
        parishes,
        lambda p: (_kind(p) == "OBJECT")
        & (F.coalesce(_kind(F.try_variant_get(p, "$.entries", "variant")), F.lit("ARRAY")) == "ARRAY"),
    )


def repair_shape(df: DataFrame, text: str, name: str = "document") -> DataFrame:
    """add the JSON text of a page document, or null if the shape cannot be repaired.

    A bare array becomes one block of parish UNKNOWN, {parish?, entries} is
    wrapped, blocks without entries get an empty list. Each step is a column
    of its own, so no step is evaluated twice.
    """
    steps = df.withColumn("_value", F.try_parse_json(text))
    value = F.col("_value")
    steps = steps.withColumns(
        {
            "_kind": _kind(value),
            "_blocks": F.try_variant_get(value, "$.parishes", "variant"),
            "_items": _items(value, "$.parishes"),
            "_entries": F.try_variant_get(value, "$.entries", "variant"),
            "_label": F.coalesce(
                F.nullif(F.try_variant_get(value, "$.parish", "string"), F.lit("")), F.lit(UNKNOWN_PARISH)
            ),
        }
    )
    kind, items, entries = F.col("_kind"), F.col("_items"), F.col("_entries")
    incomplete = F.exists(items, lambda p: F.try_variant_get(p, "$.entries", "variant").isNull())
    steps = steps.withColumn(
        "_plan",
        F.when(kind == "ARRAY", "wrap_list")
        .when(kind != "OBJECT", "reject")
        .when(F.col("_blocks").isNotNull(), F.when(~F.coalesce(_is_block_list(items), F.lit(False)), "reject").when(incomplete, "complete").otherwise("keep"))
        .when(_kind(entries) == "ARRAY", "wrap_block")
        .otherwise("reject"),
    )

    def one_block(label: Column, inner: Column) -> Column:
        listed = F.to_json(F.array(label))
        quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
        return F.concat(F.lit('{"parishes":[{"parish":'), quoted, F.lit(',"entries":'), inner, F.lit("}]}"))

    loose = F.from_json(text, "parishes array<struct<parish: string, entries: array<variant>>>")
    no_entries = F.array().cast("array<variant>")
    completed = F.transform(loose["parishes"], lambda p: p.withField("entries", F.coalesce(p["entries"], no_entries)))
    plan = F.col("_plan")
    repaired = (
        F.when(plan == "keep", F.col(text))
        .when(plan == "complete", F.to_json(F.struct(completed.alias("parishes"))))
        .when(plan == "wrap_list", one_block(F.lit(UNKNOWN_PARISH), F.col(text)))
        .when(plan == "wrap_block", one_block(F.col("_label"), F.to_json(entries)))
    )
    return steps.withColumn(name, repaired).drop("_value", "_kind", "_blocks", "_items", "_entries", "_label", "_plan")


def can_flatten(value: Column) -> Column:
    """Whether a JSON variant has no blocks or a list of blocks with lists of objects."""
    blocks = F.try_variant_get(value, "$.parishes", "variant")
    items = _items(value, "$.parishes")
    objects_only = F.forall(
        items,
        lambda p: F.coalesce(
            F.forall(_items(p, "$.entries"), lambda e: _kind(e) == "OBJECT"), F.lit(True)
        ),
    )
    return blocks.isNull() | F.coalesce(_is_block_list(items) & objects_only, F.lit(False))


def raw_blocks(text: Column) -> Column:
    """The blocks of a page document as typed fields, without defaults; what has another shape is null."""
    return F.from_json(text, DOCUMENT_SCHEMA)["parishes"]


def is_whole(blocks: Column) -> Column:
    """Whether every block and entry was read, so that the shape needs no closer look: only objects give a non-null one."""
    read = F.forall(
        blocks, lambda p: F.coalesce(F.forall(p["entries"], lambda e: e.isNotNull()), F.lit(False))
    )
    return F.coalesce(read, F.lit(False))


def typed_document(blocks: Column) -> Column:
    """``raw_blocks`` with default values: flags as int, missing text as '', no blocks as an empty list."""

    def entry(e: Column) -> Column:
        old = {f: e[OLD_NAMES[f]] for f in OLD_NAMES}
        values = [F.coalesce(e[f], *([old[f]] if f in old else []), F.lit("")).alias(f) for f in TEXT_FIELDS]
        flags = [to_int(e[f], d).alias(f) for f, d in FLAG_DEFAULTS.items()]
        return F.struct(*values, *flags)

    def block(p: Column) -> Column:
        entries = F.coalesce(p["entries"], F.array().cast(p_entries_type))
        return F.struct(F.coalesce(p["parish"], F.lit("")).alias("parish"), F.transform(entries, entry).alias("entries"))

    p_entries_type = f"array<struct<{_ENTRY}>>"
    empty = F.array().cast(f"array<struct<parish: string, entries: {p_entries_type}>>")
    return F.transform(F.coalesce(blocks, empty), block)


def document_statistics(document: Column) -> Column:
    """Number of blocks, entries and distinct non-blank names of a typed document."""
    entries = F.flatten(F.transform(document, lambda p: p["entries"]))
    names = F.array_distinct(F.filter(F.transform(entries, lambda e: e["townland"]), lambda n: clean_key(n) != ""))
    known = document.isNotNull()
    return F.when(
        known, F.struct(F.size(document).alias("parishes"), F.size(entries).alias("entries"), F.size(names).alias("townlands"))
    )
