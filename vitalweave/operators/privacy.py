"""Detection, masking and tokenization of personal health information.

Everything up to the vault is a row-local expression built from the schema: no
shuffle, no Python, and a record of any shape is scanned where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalweave.functions.once import evaluate_once
from vitalweave.functions.scalars import clean, token
from vitalweave.sources.reference_data import CLINICAL_RULES, Rule

#: Leaves that a worker searches before it hands on what it found.
LEAVES = 256
TEXTS = "array<string>"
LEAF = "array<struct<path:string,text:string>>"
MATCH = "array<struct<path:string,type:string,mask:string,value:string>>"
POSITION = "array<struct<path:string,type:string,start:bigint,end:bigint,value:string>>"

_WORD = "[0-9A-Za-z_]"
_ASCII_FORMS = {
    "b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    "s": r"[\t\n\f\r ]",
}


def ascii_pattern(pattern: str) -> str:
    """Pattern for Spark whose word boundary and white space are ASCII only.

    Next to a digit only the other side of a boundary is open, so one look-around is enough there.
    """

    def form(found: re.Match) -> str:
        if found[0] == r"\b" and re.match(r"\\d(?![*?]|\{0)", pattern[found.end() :]):
            return f"(?<!{_WORD})"
        if found[0] == r"\b" and re.search(r"(?<!\\)\\d(\{[1-9]\d*(,\d*)?\})?$", pattern[: found.start()]):
            return f"(?!{_WORD})"
        return _ASCII_FORMS.get(found[1], found[0])

    return re.sub(r"\\(.)", form, pattern)


def _joined(parts: Sequence[Column], result: str) -> Column:
    """Arrays end to end; empty when there are none."""
    return F.concat(*parts) if parts else F.array().cast(result)


def _each_text(value: Column, kind: T.DataType, path: Column, found: Callable[[Column, Column], Column], result: str):
    """Concatenation of ``found(path, text)`` over all leaves of a value of any type."""

    def walk(value: Column, kind: T.DataType, path: Column) -> Column:
        if isinstance(kind, T.StringType):
            return found(path, value)
        if isinstance(kind, T.StructType):
            parts = [
                walk(value.getField(f.name), f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind.fields
            ]
            return _joined(parts, result)
        if isinstance(kind, T.ArrayType):
            items = F.flatten(F.transform(value, lambda item: walk(item, kind.elementType, path)))
        elif isinstance(kind, T.MapType):
            items = F.flatten(
                F.transform(
                    F.map_entries(value),
                    lambda e: walk(
                        e["value"], kind.valueType, F.concat_ws(".", path, e["key"].cast("string"))
                    ),
                )
            )
        else:
            return found(path, F.nullif(clean(value.cast("string")), F.lit("")))
        return F.coalesce(items, F.array().cast(result))

    return walk(value, kind, path)


def _over_columns(df: DataFrame, cols: Sequence[str], found: Callable[[Column, Column], Column], result: str) -> Column:
    parts = [_each_text(F.col(c), df.schema[c].dataType, F.lit(c), found, result) for c in cols]
    return _joined(parts, result)


class Search:
    """A rule with its constant columns, which many leaves share."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.kind, self.mask = F.lit(rule.type).alias("type"), F.lit(rule.mask).alias("mask")
        self._needs, self._pattern = F.lit(rule.needs), F.lit(ascii_pattern(rule.pattern))
        self._whole, self._none = F.lit(0), F.array().cast(TEXTS)

    def find_all(self, text: Column) -> Column:
        """All matches; text without what every match needs is not searched."""
        needed = F.contains(text, self._needs) if self.rule.needs else text.isNotNull()
        return F.when(needed, F.regexp_extract_all(text, self._pattern, self._whole)).otherwise(self._none)


def find_all(text: Column, rule: Rule) -> Column:
    return Search(rule).find_all(text)


def replace_all(text: Column, rules: Sequence[Rule]) -> Column:
    """Text with every match replaced by the mask of its rule, rule after rule.

    A rule is skipped for text that, as masked so far, lacks what each of its matches
    needs. Masks stand for themselves, whatever characters they have. Each step is an
    element of a one-element array, so that no later step repeats it.
    """
    changed = text
    for rule in rules:
        changed = F.transform(F.array(changed), _masking(rule))[0]
    return changed


def _masking(rule: Rule) -> Callable[[Column], Column]:
    """One masking step. In a replacement, a backslash and a dollar sign stand for themselves behind a backslash."""
    pattern, needed = F.lit(ascii_pattern(rule.pattern)), F.lit(rule.needs)
    mask = F.lit(rule.mask.replace("\\", "\\\\").replace("$", "\\$"))

    def step(text: Column) -> Column:
        masked = F.regexp_replace(text, pattern, mask)
        return F.when(F.contains(text, needed), masked).otherwise(text) if rule.needs else masked

    return step


def leaves(df: DataFrame, cols: Sequence[str]) -> Column:
    """All text leaves as (path, text); numbers and flags count as their text."""

    def found(path: Column, text: Column) -> Column:
        leaf = F.struct(path.alias("path"), text.alias("text"))
        return F.when(text.isNotNull(), F.array(leaf)).otherwise(F.array().cast(LEAF))

    return _over_columns(df, cols, found, LEAF)


def string_leaves(df: DataFrame, id: str, cols: Sequence[str]) -> DataFrame:
    return df.select(id, F.inline(leaves(df, cols)))


def matches(df: DataFrame, cols: Sequence[str], rules: Sequence[Rule] = CLINICAL_RULES) -> Column:
    """Every match of every rule in the record, in leaf, rule and text order."""

    searches = [Search(rule) for rule in rules]

    def found(path: Column, text: Column) -> Column:
        def rows(search: Search) -> Column:
            def row(value: Column) -> Column:
                return F.struct(path.alias("path"), search.kind, search.mask, value.alias("value"))

            return F.transform(search.find_all(text), row)

        return _joined([rows(search) for search in searches], MATCH)

    return _over_columns(df, cols, found, MATCH)


def detect_phi(df: DataFrame, id: str, cols: Sequence[str], rules: Sequence[Rule] = CLINICAL_RULES) -> DataFrame:
    """One row per match: id, path, type, mask, value."""
    return df.select(id, F.inline(matches(df, cols, rules)))


def positions(df: DataFrame, cols: Sequence[str], rules: Sequence[Rule] = CLINICAL_RULES) -> Column:
    """Matches with their UTF-8 byte range in the leaf.

    Text is split at the matches; a match starts after the pieces and matches before it.
    """

    searches = [Search(rule) for rule in rules]

    def found(path: Column, text: Column) -> Column:
        def rows(search: Search) -> Column:
            def starts(values: Column) -> Column:
                pieces = F.split(text, ascii_pattern(search.rule.pattern), -1)
                pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(values)).alias("piece"), values.alias("value"))
                first = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<bigint>").alias("starts"))

                def step(seen: Column, pair: Column) -> Column:
                    start = seen["end"] + F.octet_length(pair["piece"])
                    end = start + F.octet_length(pair["value"])
                    return F.struct(end.alias("end"), F.array_append(seen["starts"], start).alias("starts"))

                return F.aggregate(pairs, first, step, lambda seen: seen["starts"])

            def place(values: Column) -> Column:
                return F.transform(F.array(F.struct(values.alias("values"), starts(values).alias("starts"))), each)[0]

            def each(both: Column) -> Column:
                def one(value: Column, i: Column) -> Column:
                    start = F.get(both["starts"], i)
                    end = start + F.octet_length(value)
                    return F.struct(
                        path.alias("path"), search.kind, start.alias("start"), end.alias("end"), value.alias("value")
                    )

                return F.transform(both["values"], one)

            some = F.filter(F.array(search.find_all(text)), lambda values: F.size(values) > 0)
            return F.flatten(F.transform(some, place))

        return _joined([rows(search) for search in searches], POSITION)

    return _over_columns(df, cols, found, POSITION)


def phi_positions(df: DataFrame, id: str, cols: Sequence[str], rules: Sequence[Rule] = CLINICAL_RULES) -> DataFrame:
    return df.select(id, F.inline(positions(df, cols, rules)))


def _byte_pattern(pattern: str) -> bytes:
    """Pattern over UTF-8 bytes, where word boundary and digits are ASCII; white space is spelled out."""
    return re.sub(r"\\(.)", lambda found: _ASCII_FORMS["s"] if found[1] == "s" else found[0], pattern).encode()


def phi_offsets(df: DataFrame, id: str, cols: Sequence[str], rules: Sequence[Rule] = CLINICAL_RULES) -> DataFrame:
    """The rows of :func:`phi_positions`, in one pass over the bytes of each leaf for each rule.

    Leaves go to the workers in Arrow batches; the work is linear in the text and its matches.
    """
    searches = [(r.type, r.needs.encode(), re.compile(_byte_pattern(r.pattern)).finditer) for r in rules]
    kind = df.schema[id].dataType
    schema = T.StructType([T.StructField("_id", kind), *T._parse_datatype_string("path string, type string, start bigint, end bigint, value string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, LEAVES):
                part = batch.slice(start, LEAVES)
                at, found = [], [[] for _ in range(5)]
                for row, (path, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    content = text.encode()
                    for kind, needs, search in searches:
                        for m in search(content) if needs in content else ():
                            at.append(row)
                            for column, value in zip(found, (path, kind, m.start(), m.end(), m[0].decode())):
                                column.append(value)
                if at:
                    texts = [pa.array(found[i], pa.string()) for i in (0, 1)]
                    places = [pa.array(found[i], pa.int64()) for i in (2, 3)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), *texts, *places, pa.array(found[4], pa.string())], names=schema.names)

    opened = df.select(F.col(id).alias("_id"), F.inline(leaves(df, cols)))
    return opened.mapInArrow(run, schema).withColumnRenamed("_id", id)


def phi_confidence(count: Column) -> Column:
    """0, 0.7, 0.85, then 0.95 by number of matches."""
    return F.when(count <= 0, 0.0).when(count == 1, 0.7).when(count == 2, 0.85).otherwise(0.95)


def phi_summary(df: DataFrame, id: str, cols: Sequence[str], rules: Sequence[Rule] = CLINICAL_RULES) -> DataFrame:
    """Per record: detected, match count, confidence, sorted types and suggested masks."""
    found = evaluate_once(df.select(id, *cols), {"_found": matches(df, cols, rules)})
    count = F.size("_found")
    return found.select(
        id,
        (count > 0).alias("detected"),
        count.alias("match_count"),
        phi_confidence(count).alias("confidence"),
        F.array_sort(F.array_distinct(F.col("_found.type"))).alias("phi_types"),
        F.array_sort(F.array_distinct(F.col("_found.mask"))).alias("suggestions"),
    )


def _rebuilt(value: Column, kind: T.DataType, change: Callable[[Column], Column]) -> Column:
    """The same value with ``change`` applied to each string leaf; other types stay as they are."""
    if isinstance(kind, T.StringType):
        return change(value)
    if isinstance(kind, T.StructType):
        fields = [_rebuilt(value.getField(f.name), f.dataType, change).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _rebuilt(item, kind.elementType, change))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, item: _rebuilt(item, kind.valueType, change))
    return value


def mask_phi(df: DataFrame, cols: Sequence[str], rules: Sequence[Rule] = CLINICAL_RULES) -> DataFrame:
    """Replace every match in the named columns; types other than text stay as they are."""

    def masked(text: Column) -> Column:
        return replace_all(text, rules)

    return df.withColumns({c: _rebuilt(F.col(c), df.schema[c].dataType, masked) for c in cols})


def detected_values(df: DataFrame, cols: Sequence[str], rules: Sequence[Rule] = CLINICAL_RULES) -> Column:
    """Distinct matched texts of the whole record."""

    searches = [Search(rule) for rule in rules]

    def found(_path: Column, text: Column) -> Column:
        return _joined([search.find_all(text) for search in searches], TEXTS)

    return F.array_distinct(_over_columns(df, cols, found, TEXTS))


def _holds_any(text: Column, values: Column) -> Column:
    return F.exists(values, lambda v: F.contains(text, v))


def tokenize(
    df: DataFrame, cols: Sequence[str], salt: str, rules: Sequence[Rule] = CLINICAL_RULES, values: str | None = None
) -> DataFrame:
    """Replace each string leaf that contains any value detected in its record by a token.

    ``values`` names a column that already holds :func:`detected_values`.
    """
    kinds = {c: df.schema[c].dataType for c in cols}
    found = evaluate_once(df, {"_values": F.col(values) if values else detected_values(df, cols, rules)})

    def hidden(text: Column) -> Column:
        return F.when(_holds_any(text, F.col("_values")), token(text, salt)).otherwise(text)

    changed = evaluate_once(found, {c: _rebuilt(F.col(c), kinds[c], hidden) for c in cols})
    return changed.select(*df.columns)


def hidden_texts(df: DataFrame, cols: Sequence[str], values: Column) -> Column:
    """The string leaves that :func:`tokenize` replaces for the given detected values."""
    none = F.array().cast(TEXTS)

    def found(_path: Column, text: Column) -> Column:
        return F.when(_holds_any(text, values), F.array(text)).otherwise(none)

    strings = [c for c in cols if not isinstance(df.schema[c].dataType, T.NumericType)]
    return _over_columns(df, strings, found, TEXTS)


def vault_entries(texts: DataFrame, salt: str, existing: DataFrame | None = None) -> DataFrame:
    """(token, value) of each distinct text in column ``value``, without those already stored."""
    rows = texts.select("value").distinct().select(token("value", salt).alias("token"), "value")
    return rows if existing is None else rows.join(existing.select("token"), "token", "left_anti")


def vault_rows(
    df: DataFrame,
    cols: Sequence[str],
    salt: str,
    rules: Sequence[Rule] = CLINICAL_RULES,
    existing: DataFrame | None = None,
) -> DataFrame:
    """New (token, value) pairs behind :func:`tokenize` of the same raw records."""
    records = evaluate_once(df.select(*cols), {"_values": detected_values(df, cols, rules)})
    texts = hidden_texts(records, cols, F.col("_values"))
    return vault_entries(records.filter(F.size("_values") > 0).select(F.explode(texts).alias("value")), salt, existing)


def reidentify(df: DataFrame, vault: DataFrame, column: str = "token") -> DataFrame:
    """Original value of each token, null for text that is no known token."""
    known = vault.select(F.col("token").alias("_token"), F.col("value").alias("original"))
    return df.join(known, F.col(column) == F.col("_token"), "left").drop("_token")


def anonymity_report(df: DataFrame, quasi_ids: Sequence[str], sensitive: str) -> DataFrame:
    """k (smallest group) and l (fewest distinct sensitive values) over the quasi-identifier groups."""
    groups = df.groupBy(*quasi_ids).agg(F.count("*").alias("rows"), F.count_distinct(sensitive).alias("kinds"))
    return groups.agg(
        F.count("*").alias("group_count"),
        F.min("rows").alias("k"),
        F.min("kinds").alias("l"),
        F.max("rows").alias("largest_group"),
    )


def suppress_small_groups(df: DataFrame, quasi_ids: Sequence[str], k: int) -> DataFrame:
    """Rows whose quasi-identifier group has at least ``k`` members.

    Only the small groups are joined back, and each holds fewer than ``k`` rows, so a hot group never meets a match.
    """
    small = df.groupBy(*quasi_ids).agg(F.count("*").alias("_rows")).filter(F.col("_rows") < k)
    keys = small.select(*[F.col(c).alias(f"_q_{c}") for c in quasi_ids])
    same = None
    for c in quasi_ids:
        part = F.col(c).eqNullSafe(F.col(f"_q_{c}"))
        same = part if same is None else same & part
    return df.join(keys, same, "left_anti")
