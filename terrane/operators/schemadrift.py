"""Problem 3: schemas that drift between the files of a dataset.

Method: tagged-union inference. Each task fuses the schemas of its rows into counts per (file, path, type); the partial schemas
are added up by an aggregation, so a path keeps every alternative type it was seen with. A path with several alternatives is split into
typed branches, one per type, beside one canonical value; alternatives that appear in a dataset for the first time are reported.
Consecutive files are compared on the fused schemas alone. Values are read again only for the fields that one of two neighbouring files
lacks, to tell renamings from additions and removals.

Skew. A file or dataset that holds a third of all rows is never grouped in one task: schemas shrink to counts in the task that read
the rows, and values are matched by (file, feature). Only lists of files, not of rows, are ordered within a dataset.

Defined results for dirty input: records that are not a JSON object have no fields; null values do not exist; a key written twice
in one object counts by its last value; a row or file delivered several times counts once, a row without a key each time; a file without readable rows has no
fields; ties of type counts go to the type named first in ``TYPES``; the files of a dataset are ordered by published_at (null
first), then file_id; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import durable
from terrane.streams import over_groups

TYPES = ("string", "integer", "decimal", "boolean", "list", "object")
#: Two fields are one renamed field if so large a share of the features has equal values in both.
RENAMED_SHARE = 0.6


class _Whole(str):
    """The text of a JSON number without fraction or exponent."""


class _Fraction(str):
    """The text of a JSON number with a fraction or an exponent."""


_decode = json.JSONDecoder(parse_int=_Whole, parse_float=_Fraction, parse_constant=_Fraction).decode


def read_record(text: str | None) -> dict:
    try:
        value = _decode(text)
    except (ValueError, TypeError, RecursionError):
        return {}
    return value if type(value) is dict else {}


def type_of(value) -> str:
    kind = type(value)
    return {_Whole: "integer", _Fraction: "decimal", str: "string", bool: "boolean", list: "list", dict: "object"}[kind]


def text_of(value, ordered: bool = True) -> str:
    """Numbers and strings by their text; the rest as JSON, with the keys in order if ``ordered``."""
    return str(value) if isinstance(value, str) else _json(value, ordered)


def _json(value, ordered: bool, number=str) -> str:
    """Compact JSON; numbers as ``number`` spells them."""
    kind = type(value)
    if kind is _Whole or kind is _Fraction:
        return number(value) or str(value)
    if kind is dict:
        items = sorted(value.items()) if ordered else value.items()
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v, ordered, number)}" for k, v in items) + "}"
    if kind is list:
        return "[" + ",".join(_json(v, ordered, number) for v in value) + "]"
    return json.dumps(value, ensure_ascii=False)


#: Numbers with more digits before or after the point are spelled with an exponent.
PLAIN_DIGITS = 400


def exact_number(text: str) -> str | None:
    """The one spelling of a number, exact: no exponent, no needless zero or sign. None for what is no number (NaN, Infinity)."""
    try:
        sign, digits, exponent = Decimal(text).as_tuple()
    except InvalidOperation:
        return None
    if not isinstance(exponent, int):
        return None
    shown = "".join(map(str, digits)).lstrip("0")
    bare = shown.rstrip("0")
    exponent += len(shown) - len(bare)
    if not bare:
        return "0"
    minus = "-" if sign else ""
    if exponent > PLAIN_DIGITS or exponent < -PLAIN_DIGITS:
        return f"{minus}{bare}E{exponent}"
    if exponent >= 0:
        return minus + bare + "0" * exponent
    padded = bare.rjust(1 - exponent, "0")
    return f"{minus}{padded[:exponent]}.{padded[exponent:]}"


def canonical_of(value) -> str | None:
    """The one spelling of a value: exact numbers, JSON with sorted keys."""
    kind = type(value)
    if kind is _Whole or kind is _Fraction:
        return exact_number(value)
    return value if kind is str else _json(value, True, exact_number)


def alternatives(value, path: str) -> Iterator[tuple[str, str]]:
    """(path, type) of a value and of everything inside it; list elements share the path ``name[]``."""
    if value is None:
        return
    yield path, type_of(value)
    if type(value) is dict:
        for key, inner in value.items():
            yield from alternatives(inner, f"{path}.{key}")
    elif type(value) is list:
        for inner in value:
            yield from alternatives(inner, path + "[]")


def distinct_rows(rows: DataFrame) -> DataFrame:
    own = F.when(F.col("row_id").isNull(), F.monotonically_increasing_id())  # a row without a key has no copies
    return rows.select("row_id", "file_id", "feature_id", "record", own.alias("_own")).dropDuplicates(["row_id", "_own"]).drop("_own")


def ordered_files(files: DataFrame) -> DataFrame:
    """One row per file with its predecessor in the dataset (``former``, null for the first)."""
    columns = ["dataset", "published_at", "version", "primary_column", "encoding", "geometry_types"]
    one = files.filter("file_id is not null").groupBy("file_id").agg(F.min_by(F.struct(*columns), "loaded_at").alias("f")).select("file_id", "f.*")
    by_time = Window.partitionBy("dataset").orderBy("published_at", "file_id")
    return one.select("*", F.lag("file_id").over(by_time).alias("former"), F.row_number().over(by_time).alias("place"))


def fused_schemas(rows: DataFrame, nested: bool = True) -> DataFrame:
    """(file_id, path, type, n): how many values of each type each path has in each file; without ``nested``, of top-level fields only."""

    def fuse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: Counter = Counter()
            for file_id, record in zip(frame["file_id"], frame["record"]):
                for key, value in read_record(record).items():
                    if key == "id" or value is None:
                        continue
                    if nested:
                        counts.update((file_id, path, kind) for path, kind in alternatives(value, key))
                    else:
                        counts[file_id, key, type_of(value)] += 1
            if counts:
                yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["file_id", "path", "type", "n"])

    parts = rows.filter("file_id is not null").select("file_id", "record").mapInPandas(fuse, "file_id bigint, path string, type string, n bigint")
    return parts.groupBy("file_id", "path", "type").agg(F.sum("n").alias("n"))


def main_types(schemas: DataFrame) -> DataFrame:
    """(file_id, field, type): the type of most values of each path."""
    rank = F.create_map(*[F.lit(x) for k, name in enumerate(TYPES) for x in (name, -k)])
    return schemas.groupBy("file_id", F.col("path").alias("field")).agg(F.max_by("type", F.struct("n", rank[F.col("type")])).alias("type"))


def _values(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pair, feature_id, lost, field, text) for the fields in ``wanted`` (file_id, pair, lost, field) only."""
    lists = wanted.groupBy("file_id").agg(F.collect_list(F.struct("pair", "lost", "field")).alias("wanted"))
    joined = rows.filter("feature_id is not null").join(lists, "file_id").select("feature_id", "record", "wanted")

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for feature, record, wanted_fields in zip(frame["feature_id"], frame["record"], frame["wanted"]):
                values = read_record(record)
                for w in wanted_fields:
                    value = values.get(w["field"])
                    if value is not None:
                        tag = "s" if isinstance(value, str) else "b" if isinstance(value, bool) else "j"
                        out.append((w["pair"], feature, w["lost"], w["field"], tag + text_of(value)))
            if out:
                yield pd.DataFrame(out, columns=["pair", "feature_id", "lost", "field", "text"])

    return joined.mapInPandas(pick, "pair bigint, feature_id bigint, lost boolean, field string, text string")


def renamings(rows: DataFrame, lost_and_new: DataFrame) -> DataFrame:
    """(file_id, field_name, old_name) from (file_id, former, field, lost); each field takes part in one renaming at most, best shares first."""
    both = lost_and_new.groupBy("file_id").agg(F.expr("bool_or(lost) and bool_or(not lost)").alias("both")).filter("both").select("file_id")
    wanted = lost_and_new.join(both, "file_id", "left_semi").select(F.when(F.col("lost"), F.col("former")).otherwise(F.col("file_id")).alias("raw"), F.col("file_id").alias("pair"), "lost", "field")
    values = _values(rows, wanted.withColumnRenamed("raw", "file_id"))
    side = lambda lost: F.collect_set(F.when(F.col("lost") if lost else ~F.col("lost"), F.struct("field", "text")))
    met = values.groupBy("pair", "feature_id").agg(side(True).alias("olds"), side(False).alias("news")).filter("size(olds) > 0 and size(news) > 0")
    crossed = met.select("pair", F.explode("olds").alias("o"), "news").select("pair", "o", F.explode("news").alias("w"))
    shares = (
        crossed.groupBy("pair", F.col("o.field").alias("old_name"), F.col("w.field").alias("field_name"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("o.text") == F.col("w.text")).alias("same"))
        .filter(F.col("same") >= RENAMED_SHARE * F.col("n"))
    )
    ranked = shares.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct((-F.col("same") / F.col("n")).alias("a"), (-F.col("n")).alias("b"), "old_name", "field_name"))).alias("all"))
    none = F.slice("all", 1, 0)
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["old_name"] == x["old_name"]) | (y["field_name"] == x["field_name"]))
    chosen = F.aggregate("all", none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return ranked.select(F.col("pair").alias("file_id"), F.explode(chosen).alias("c")).select("file_id", "c.field_name", "c.old_name")


def field_changes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(file_id, change_kind, field_name, old_name) of each file against the one published before it in its dataset.

    The fused schemas and the one-sided fields, a few rows per file, are checkpointed, so that the plans that use them stay small.
    """
    later, rows = durable(ordered_files(files).filter("former is not null").select("file_id", "former")), distinct_rows(rows)
    fields = durable(main_types(fused_schemas(rows, nested=False)))
    now = later.join(fields, "file_id").select("file_id", "former", "field", F.col("type").alias("new_type"))
    then = later.join(fields.withColumnRenamed("file_id", "former"), "former").select("file_id", "former", "field", F.col("type").alias("old_type"))
    sides = durable(now.join(then, ["file_id", "former", "field"], "full_outer").filter("new_type is null or old_type is null or new_type != old_type"))
    one_sided = sides.filter("new_type is null or old_type is null").select("file_id", "former", "field", F.col("new_type").isNull().alias("lost"), F.coalesce("new_type", "old_type").alias("type"))
    renamed = durable(renamings(rows, one_sided.select("file_id", "former", "field", "lost")))
    both = renamed.select("file_id", "field_name", "old_name", F.explode(F.array(F.struct(F.col("old_name").alias("field"), F.lit(True).alias("lost")), F.struct(F.col("field_name").alias("field"), F.lit(False).alias("lost")))).alias("s"))
    told = one_sided.join(both.select("file_id", "s.*", "field_name", "old_name"), ["file_id", "field", "lost"], "left")
    # a renaming has two rows here, the old and the new side; all else has one
    joined = told.groupBy("file_id", F.coalesce("field_name", "field").alias("field_name"), F.coalesce("old_name", F.lit("")).alias("old_name")).agg(
        F.when(F.first("old_name").isNotNull(), "renamed").when(F.bool_and("lost"), "removed").otherwise("added").alias("change_kind"), (F.count_distinct("type") > 1).alias("retyped")
    )
    kinds = joined.select("file_id", F.explode(F.array_compact(F.array("change_kind", F.when(F.col("retyped"), "retyped")))).alias("change_kind"), "field_name", "old_name")
    kinds = kinds.select("file_id", "change_kind", "field_name", F.when(F.col("change_kind") == "renamed", F.col("old_name")).otherwise("").alias("old_name"))
    retyped = sides.filter("new_type != old_type").select("file_id", F.lit("retyped").alias("change_kind"), F.col("field").alias("field_name"), F.lit("").alias("old_name"))
    return kinds.unionByName(retyped)


def metadata_changes(files: DataFrame) -> DataFrame:
    """(file_id, change_kind, field_name, old_name) for version, encoding and geometry_types."""
    files = ordered_files(files)
    by_time = Window.partitionBy("dataset").orderBy("published_at", "file_id")
    kinds = F.array_sort(F.array_distinct(F.coalesce("geometry_types", F.array().cast("array<string>"))))
    said = files.select("*", F.lower("encoding").alias("enc"), kinds.alias("kinds"))
    before = said.select("file_id", "primary_column", "former", "version", "enc", "kinds", *[F.lag(c).over(by_time).alias("old_" + c) for c in ("version", "enc", "kinds")]).filter("former is not null")
    checks = F.array(*[F.when(~F.col(c).eqNullSafe(F.col("old_" + c)), F.lit(name)) for c, name in (("version", "version"), ("enc", "encoding"), ("kinds", "geometry_types"))])
    return before.select("file_id", F.explode(F.array_compact(checks)).alias("change_kind"), F.coalesce("primary_column", F.lit("")).alias("field_name"), F.lit("").alias("old_name"))


def all_changes(files: DataFrame, rows: DataFrame) -> DataFrame:
    return field_changes(files, rows).unionByName(metadata_changes(files))


def appearing_alternatives(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(dataset, path, type, file_id, n_files, n_values): every alternative of every path, nested ones too, with the file that brought it."""
    placed = fused_schemas(distinct_rows(rows)).join(ordered_files(files).select("file_id", "dataset", "place"), "file_id")
    return placed.groupBy("dataset", "path", "type").agg(F.min_by("file_id", "place").alias("file_id"), F.count("*").alias("n_files"), F.sum("n").alias("n_values"))


def lineage(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_id, field, origin): renamed fields under the first name they had in their dataset; fields never renamed are left out."""
    renamed = changes.filter("change_kind in ('renamed', 'added')").select("file_id", "change_kind", "field_name", "old_name")
    listed = ordered_files(files).select("file_id", "dataset", "place").join(renamed.groupBy("file_id").agg(F.collect_list(F.struct("change_kind", "field_name", "old_name")).alias("renamed")), "file_id", "left")

    def follow(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        origin: dict[str, str] = {}
        out = []
        for file_id, changes_ in sorted(zip(group["file_id"], group["renamed"]), key=lambda x: order[x[0]]) if (order := dict(zip(group["file_id"], group["place"]))) else ():
            if changes_ is not None:
                was = {c["field_name"]: origin.get(c["old_name"], c["old_name"]) for c in changes_ if c["change_kind"] == "renamed"}
                for c in changes_:
                    origin.pop(c["old_name"] if c["change_kind"] == "renamed" else c["field_name"], None)
                origin.update(was)
            out += [(file_id, field, first) for field, first in origin.items() if field != first]
        if out:
            yield pd.DataFrame(out, columns=["file_id", "field", "origin"])

    return over_groups(listed.withColumn("dataset", F.coalesce("dataset", F.lit(""))), ["dataset"], follow, "file_id bigint, field string, origin string")


def consistent_table(files: DataFrame, rows: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """All values of all files under one schema, one row per (file, feature, field).

    ``field_name`` is the field's first name in the dataset. ``type_tag`` says which of the typed branches holds the value as it was
    written: v_string, v_boolean, v_integer, v_big_integer (the text of what is beyond 64 bits), v_decimal (the nearest double), v_json.
    ``canonical_type`` is the one type all alternatives of the field in its dataset convert to (integer and decimal to decimal, other
    mixtures to string), ``canonical`` the converted value as text, exact and in one spelling. ``conversion`` is ``kept``, ``converted`` from
    another type, or ``failed`` (NaN and Infinity have no canonical value). Rows whose file is null, unknown or without a dataset
    keep their field's name and stand under the dataset they have, or null.
    """
    distinct = distinct_rows(rows)
    changes = durable(field_changes(files, rows)) if changes is None else changes

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [
                (f, i, key, type_of(value), text_of(value, False), canonical_of(value))
                for f, i, record in zip(frame["file_id"], frame["feature_id"], frame["record"])
                for key, value in read_record(record).items()
                if value is not None and key != "id"
            ]
            if out:
                yield pd.DataFrame(out, columns=["file_id", "feature_id", "field", "type_tag", "text", "canonical"]).astype({"file_id": "Int64", "feature_id": "Int64"})

    whole = distinct.select("file_id", "feature_id", "record")
    values = whole.mapInPandas(read, "file_id bigint, feature_id bigint, field string, type_tag string, text string, canonical string")
    # the names and types of all files are joined to the values, per (file, field); the values themselves are not shuffled by a skewed key
    names = lineage(files, changes)
    placed = fused_schemas(distinct, nested=False).join(ordered_files(files).select("file_id", "dataset"), "file_id").withColumnRenamed("path", "field").join(names, ["file_id", "field"], "left").withColumn("field_name", F.coalesce("origin", "field"))
    placed = durable(placed.select("dataset", "file_id", "field", "field_name", "type"))
    kinds = placed.groupBy("dataset", "field_name").agg(F.collect_set("type").alias("kinds"))
    numbers = F.array(F.lit("integer"), F.lit("decimal"))
    canonical = F.when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).when(F.size(F.array_except("kinds", numbers)) == 0, "decimal").otherwise("string")
    of_kind = kinds.select(F.col("dataset").alias("d"), F.col("field_name").alias("f"), canonical.alias("canonical_type"))
    each = placed.select("file_id", "field", "dataset", "field_name").distinct()
    known = each.join(of_kind, F.col("dataset").eqNullSafe(F.col("d")) & (F.col("field_name") == F.col("f"))).drop("d", "f")
    branch = lambda name, kind: F.when(F.col("type_tag") == name, F.col("text").try_cast(kind)).alias("v_" + name)
    kind = F.coalesce("canonical_type", "type_tag")
    return values.join(known, ["file_id", "field"], "left").select(
        "dataset", "file_id", "feature_id", F.coalesce("field_name", "field").alias("field_name"), F.col("field").alias("source_field"), "type_tag",
        branch("string", "string"), branch("boolean", "boolean"), branch("integer", "bigint"),
        F.when((F.col("type_tag") == "integer") & F.col("text").try_cast("bigint").isNull(), F.col("text")).alias("v_big_integer"), branch("decimal", "double"),
        F.when(F.col("type_tag").isin("list", "object"), F.col("text")).alias("v_json"), kind.alias("canonical_type"), "canonical",
        F.when(F.col("canonical").isNull(), "failed").when(F.col("type_tag") == kind, "kept").otherwise("converted").alias("conversion"),
    )
