"""Scoring of fields: each document pair's fields, by each of their scoring types and each method.

A scoring type says how the lists of values of a field are compared: as one string, in order, out of order, as sets,
or as tables; a partial type sums up its values' counts, the others count the field once. All of it is columns of
the row that holds both lists: the fan-out over fields, types and methods is one explode, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import edits, scores, text
from . import box_lists, boxes, equality, mapping, matching

Measure = Callable[[Column, Column], Column]
ITEM = "struct<tp:bigint,fp:bigint,fn:bigint,tn:bigint,score:double,expected:string,actual:string>"
MATCH = ITEM[:-1] + f",sub_scores:array<{ITEM}>>"


@dataclass(frozen=True)
class Method:
    """score is the measure of values, `whole` of joined texts; both go through `prepare` where values are joined or matched out of order.

    `plain` is prepare() for Python's texts, of methods that only ask whether values are equal.
    """

    name: str
    score: Measure
    threshold: float
    prepare: Callable[[Column], Column] = lambda x: x
    bounded: bool = False
    whole: Measure | None = None
    plain: equality.Plain | None = None

    def measure(self, a: Column, b: Column) -> Column:
        return self.score(self.prepare(a), self.prepare(b))


IGNORED = dict.fromkeys(map(ord, text.IGNORED))
METHODS = {
    "exact": Method("exact", scores.exact, scores.THRESHOLDS["exact"], plain=str),
    "soft": Method("soft", scores.exact, scores.THRESHOLDS["soft"], text.strip_punctuation, plain=lambda s: s.translate(IGNORED)),
    "levenshtein": Method("levenshtein", scores.levenshtein, scores.THRESHOLDS["levenshtein"], bounded=True, whole=scores.levenshtein_of_texts),
}


def add_method(name: str, measure: Measure, threshold: float, prepare: Callable[[Column], Column] = lambda x: x) -> None:
    """A method of one's own, by which all types can score; functions.sql.measure() makes its measure of one of Spark's functions."""
    if name in METHODS:
        raise ValueError(f"there is a method {name}")
    METHODS[name] = Method(name, measure, threshold, prepare)


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x worked out once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _item(expected: Column, actual: Column, score: Column, threshold: float) -> Column:
    def made(v: Column) -> Column:
        counts = scores.confusion(v["e"], v["a"], v["s"], threshold)
        return F.struct(*(c.alias(k) for k, c in counts.items()), v["s"].alias("score"), v["e"].alias("expected"), v["a"].alias("actual")).cast(ITEM)

    return _let(F.struct(expected.alias("e"), actual.alias("a"), score.cast("double").alias("s")), made)


def _whole(item: Column) -> Column:
    """The score of a field as one value, without sub-scores."""
    names = ("tp", "fp", "fn", "tn", "score", "expected", "actual")
    return F.struct(*(item[n].alias(n) for n in names), F.lit(None).cast(f"array<{ITEM}>").alias("sub_scores")).cast(MATCH)


def _mean(items: Column) -> Column:
    return F.when(F.size(items) == 0, 1.0).otherwise(F.aggregate(items, F.lit(0.0), lambda s, x: s + x["score"]) / F.size(items))


def _partial(items: Column, expected: Column, actual: Column) -> Column:
    """Counts summed over the values, their mean score, and the values' own scores."""

    def made(xs: Column) -> Column:
        sums = (_total(xs, c) for c in ("tp", "fp", "fn", "tn"))
        return F.struct(*sums, _mean(xs).alias("score"), expected.alias("expected"), actual.alias("actual"), xs.alias("sub_scores")).cast(MATCH)

    return _let(items, made)


def _total(xs: Column, name: str) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x[name]).alias(name)


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _ordered_items(e: Column, a: Column, m: Method) -> Column:
    return F.zip_with(e, a, lambda x, y: _item(_blank(x), _blank(y), m.score(_blank(x), _blank(y)), m.threshold))


def _all_or_nothing(items: Column, same_size: Column, threshold: float) -> Column:
    """The mean score if both sides are equally long and no value is below the threshold, else 0."""
    return _let(items, lambda xs: F.when(~same_size | F.exists(xs, lambda x: x["score"] < threshold), 0.0).otherwise(_mean(xs)))


def _joined(xs: Column) -> Column:
    return text.normalize_whitespace(F.array_join(xs, ""))


def as_string(e: Column, a: Column, m: Method, similarity: Column | None = None) -> Column:
    """The values as one text; its edit similarity may be given."""
    one = lambda xs: m.prepare(_joined(xs))
    return _let(F.struct(one(e).alias("e"), one(a).alias("a")), lambda v: _whole(_item(v["e"], v["a"], (m.whole or m.score)(v["e"], v["a"]) if similarity is None else similarity, m.threshold)))


def as_list(e: Column, a: Column, m: Method, partial: bool = False) -> Column:
    said = F.array_join(e, ", "), F.array_join(a, ", ")
    items = _ordered_items(e, a, m)
    if partial:
        return _partial(items, *said)
    return _whole(_item(*said, _all_or_nothing(items, F.size(e) == F.size(a), m.threshold), m.threshold))


def as_unordered(e: Column, a: Column, m: Method, partial: bool = False) -> Column:
    said = F.array_join(e, ", "), F.array_join(a, ", ")
    pairs = matching.greedy_equal(e, a, m.prepare) if m.score is scores.exact else matching.greedy(e, a, m.measure, m.threshold, bounded=m.bounded)
    items = F.transform(pairs, lambda p: _item(p["e"], p["a"], p["score"], m.threshold))
    if partial:
        return _partial(items, *said)
    score = F.when(F.size(e) != F.size(a), 0.0).otherwise(_let(items, _mean))  # the pairs are only made where sizes are equal
    return _whole(_item(*said, score, m.threshold))


def as_set(e: Column, a: Column, m: Method, partial: bool = False) -> Column:
    return _let(F.struct(matching.as_set(e).alias("e"), matching.as_set(a).alias("a")), lambda v: as_unordered(v["e"], v["a"], m, partial))


def _table_item(e: Column, a: Column, m: Method) -> Column:
    """Of two tables' rows: 1 if both are empty, 0 if the shapes differ, else their cells in order as a list."""
    some = lambda rows: F.when(F.size(rows) > 0, "dummy").otherwise("")
    shapes = (F.size(e) != F.size(a)) | F.exists(F.zip_with(e, a, lambda x, y: F.size(x) == F.size(y)), lambda same: ~F.coalesce(same, F.lit(False)))
    cells = F.flatten(e), F.flatten(a)
    score = _all_or_nothing(_ordered_items(*cells, m), F.lit(True), m.threshold)
    return F.when((F.size(e) == 0) & (F.size(a) == 0), _item(F.lit(""), F.lit(""), F.lit(1.0), 1.0)).when(shapes, _item(some(e), some(a), F.lit(0.0), 1.0)).otherwise(_item(F.array_join(cells[0], ", "), F.array_join(cells[1], ", "), score, m.threshold))


def as_tables(e: Column, a: Column, m: Method, partial: bool = False) -> Column:
    """Of two lists of tables, each an array of rows of cells."""
    none = F.array().cast("array<array<string>>")
    said = [F.when(F.size(x) > 0, F.to_json(x)).otherwise("") for x in (e, a)]
    items = F.zip_with(e, a, lambda x, y: _table_item(F.coalesce(x, none), F.coalesce(y, none), m))
    if partial:
        return _partial(items, *said)
    return _whole(_item(*said, _all_or_nothing(items, F.size(e) == F.size(a), m.threshold), m.threshold))


TYPES: dict[str, Callable[[Column, Column, Method], Column]] = {
    "string": as_string,
    "list": as_list,
    "partial_list": lambda e, a, m: as_list(e, a, m, True),
    "ulist": as_unordered,
    "partial_ulist": lambda e, a, m: as_unordered(e, a, m, True),
    "set": as_set,
    "partial_set": lambda e, a, m: as_set(e, a, m, True),
}
TABLE_TYPES = {"table": as_tables, "partial_table": lambda e, a, m: as_tables(e, a, m, True)}


def values(xs: Column, lower: bool = False) -> Column:
    """A list of values, normalised; a null list is empty, a null value an empty text."""
    return F.coalesce(F.transform(xs, lambda x: text.normalize(_blank(x), lower)), F.array().cast("array<string>"))


def table_rows(tables: Column, lower: bool = False) -> Column:
    """Rows, head before body, of tables that are struct<head, body> (or typed values), their cells normalised; a null list is empty."""
    none = F.array().cast("array<array<string>>")
    rows = lambda t: F.concat(F.coalesce(t["head"], none), F.coalesce(t["body"], none))
    return F.coalesce(F.transform(tables, lambda t: F.transform(rows(t), lambda r: values(r, lower))), F.array().cast("array<array<array<string>>>"))


#: Between the items of a value, while lists of items are matched.
MARK = "\x01"
#: The methods that lists of items have.
ITEMS = {"exact": Method("exact", lambda a, b: matching.items_exact(F.split(a, MARK), F.split(b, MARK)), scores.THRESHOLDS["exact"])}


def _unmarked(match: Column) -> Column:
    """A score whose values show items with commas between them."""
    shown = lambda s: F.replace(s, F.lit(MARK), F.lit(", "))
    names = [x.partition(":")[0] for x in ITEM[7:-1].split(",")]
    one = lambda m: F.struct(*((shown(m[n]) if n in ("expected", "actual") else m[n]).alias(n) for n in names))
    return F.struct(*(one(match)[n].alias(n) for n in names), F.transform(match["sub_scores"], one).alias("sub_scores")).cast(MATCH)


def is_table_type(scoring_type: str) -> bool:
    kind = "string" if scoring_type == "str" else scoring_type
    if kind not in TYPES and kind not in TABLE_TYPES:
        raise ValueError(f"scoring type must be one of {sorted([*TYPES, *TABLE_TYPES])}: {scoring_type}")
    return kind in TABLE_TYPES


def _table_of(x: Column) -> Column:
    """The table that a text gives as JSON, or an empty one."""
    return F.from_json(x, f"struct<{mapping.TABLE}>")


def prepared(expected: Column, actual: Column, types: Sequence[str], typed: bool, lower: bool = False, json: bool = False, similarity: Column | None = None) -> Column:
    """What the scoring types need of both sides, normalised once: e and a, texts; te and ta, rows of tables; items, whether both are lists of items, then ie and ia.

    `typed` values are those of mapping.VALUE, others are texts or, for table types alone, struct<head, body>; or, with
    `json`, texts that can be tables as JSON.
    """
    tables = [is_table_type(t) for t in types]
    made: dict[str, Column] = {}
    if any(tables):
        made |= {n: table_rows(F.transform(x, _table_of) if json else x, lower) for n, x in (("te", expected), ("ta", actual))}
    if not all(tables):
        made |= {n: values(mapping.texts(x) if typed else x, lower) for n, x in (("e", expected), ("a", actual))}
    if typed and not all(tables):
        first_is = lambda x: F.coalesce(F.get(x, F.lit(0))["kind"] == "items", F.lit(False))
        items = lambda x: F.coalesce(F.transform(x, lambda v: F.array_join(values(F.when(v["kind"] == "items", v["items"]).otherwise(mapping.texts(F.array(v))), lower), MARK)), F.array().cast("array<string>"))
        made |= {"items": first_is(expected) | first_is(actual), "ie": items(expected), "ia": items(actual)}
    if similarity is not None:
        made["similarity"] = similarity
    return F.struct(*(c.alias(n) for n, c in made.items()))


def _score(v: Column, scoring_type: str, method: str, typed: bool, measured: bool = False) -> Column:
    """The score of prepared values; null where items have no such method."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {sorted(METHODS)}: {method}")
    m = METHODS[method]
    if is_table_type(scoring_type):
        return TABLE_TYPES[scoring_type](v["te"], v["ta"], m)
    of = TYPES["string" if scoring_type == "str" else scoring_type]
    said = as_string(v["e"], v["a"], m, v["similarity"]) if measured and of is as_string and m.whole else of(v["e"], v["a"], m)
    if not typed or of is as_string:
        return said
    by_items = _let(of(v["ie"], v["ia"], ITEMS[method]), _unmarked) if method in ITEMS else F.lit(None).cast(MATCH)
    return F.when(v["items"], by_items).otherwise(said)


def score(expected: Column, actual: Column, scoring_type: str, method: str, lower: bool = False, typed: bool = False) -> Column:
    """struct<tp, fp, fn, tn, score, expected, actual, sub_scores> of two lists of texts, or of tables for the table types, or of `typed` values."""
    return _let(prepared(expected, actual, [scoring_type], typed, lower), lambda v: _score(v, scoring_type, method, typed))


def join_sides(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, field_name, expected, actual, error) of two tables (keys, field_name, values); a prediction without the field is an error.

    Both are shuffled by key and field, unless they already are partitioned so.
    """
    on = [*keys, "field_name"]
    got = actual.select(*on, F.col("values").alias("actual"), F.lit(True).alias("found"))
    joined = expected.withColumnRenamed("values", "expected").join(got, on, "left")
    lacks = F.when(F.col("found").isNull(), F.concat(F.lit("field missing in prediction: "), F.col("field_name")))
    return joined.select(*on, "expected", "actual", lacks.alias("error"))


def by_field(pairs: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """(keys, field_name, expected, actual): a row for each field of the maps `expected` and `actual`.

    Fields that aren't expected are skipped; `error` tells those that only the actual side lacks.
    """
    chosen = F.map_keys("expected") if names is None else F.filter(F.array(*map(F.lit, names)), lambda f: F.map_contains_key("expected", f))
    each = pairs.select(*keys, "expected", "actual", F.explode(chosen).alias("field_name"))
    lacks = F.when(~F.coalesce(F.map_contains_key("actual", F.col("field_name")), F.lit(False)), F.concat(F.lit("field missing in prediction: "), F.col("field_name")))
    return each.select(*keys, "field_name", F.element_at("expected", F.col("field_name")).alias("expected"), F.try_element_at("actual", F.col("field_name")).alias("actual"), lacks.alias("error"))


def score_fields(fields: DataFrame, types: Mapping[str, Sequence[str]], methods: Sequence[str] = ("exact", "levenshtein"), lower: bool = False, skip_errors: bool = True, counters: Observation | None = None, details: bool = True) -> DataFrame:
    """Adds scoring_type, scoring_method, match_score and sub_scores to fields: a row for each of a field's types and each method.

    types maps fields, and `default`, to their scoring types; string where there is neither. Values are texts, or typed
    (mapping.VALUE): tables are then scored by the table types, lists of items by the share of them that is found. Rows with an `error` are
    left out, and counted by `counters` (fields, errors), or end the job if errors aren't to be skipped. Without
    `details` there are no values and sub-scores in the result, which then needn't be copied for each type and method; texts that
    are compared for equality alone are then counted in their row by operators.equality.
    """
    if "error" in fields.columns:
        if counters is not None:
            fields = fields.observe(counters, F.count(F.lit(1)).alias("fields"), F.count("error").alias("errors"))
        good = F.col("error").isNull()
        fields = fields.where(good if skip_errors else F.when(good, True).otherwise(F.raise_error(F.col("error")))).drop("error")
    default = list(types.get("default", ["string"]))
    own = {f: list(t) for f, t in types.items() if f != "default"}
    every = list(dict.fromkeys([*default, *(t for ts in own.values() for t in ts)]))
    of = F.create_map(*(c for f, ts in own.items() for c in (F.lit(f), F.array(*map(F.lit, ts))))) if own else None
    wanted = F.array(*map(F.lit, default)) if of is None else F.coalesce(F.try_element_at(of, F.col("field_name")), F.array(*map(F.lit, default)))
    kind = fields.schema["expected"].dataType
    of_structs = isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType)
    typed = of_structs and "kind" in kind.elementType.names
    keep = [c for c in fields.columns if c not in ("expected", "actual")]
    if not details and not of_structs and set(every) <= set(equality.TYPES) and all(m in METHODS and METHODS[m].plain for m in methods):
        sides = (values(F.col(c), lower).alias(c[0]) for c in ("expected", "actual"))
        return equality.counted(fields.select(*keep, wanted.alias("wanted"), *sides), every, {m: METHODS[m].plain for m in methods})
    # joined texts are measured ahead, as what follows is in lambdas: only those of fields that are scored so
    strings = [t for t in every if t in ("string", "str")]
    measured = bool(strings) and any(METHODS[m].whole for m in methods if m in METHODS)
    fields = fields.withColumn("wanted", wanted)
    if measured:
        one = lambda c: F.when(F.arrays_overlap("wanted", F.array(*map(F.lit, strings))), _joined(values(mapping.texts(F.col(c)) if typed else F.col(c), lower)))
        fields = fields.select(*keep, "expected", "actual", "wanted", one("expected").alias("one"), one("actual").alias("other"))
        fields = fields.withColumn("similarity", edits.text_similarity(F.col("one"), F.col("other"))).drop("one", "other")

    counts = ("tp", "fp", "fn", "tn", "score")

    def one(v: Column, t: str, m: str) -> Column:
        made = _let(_score(v, t, m, typed, measured), lambda s: F.when(s.isNotNull(), F.struct(F.lit(t).alias("scoring_type"), F.lit(m).alias("scoring_method"), (s if details else F.struct(*(s[c].alias(c) for c in counts))).alias("match_score"))))
        return F.when(F.array_contains("wanted", t), made)

    # what all types need is a column of its own, so that no type is within another's lambda
    ready = fields.select(*keep, "wanted", prepared(F.col("expected"), F.col("actual"), every, typed, lower, not of_structs, F.col("similarity") if measured else None).alias("sides"))
    each = F.filter(F.array(*(one(F.col("sides"), t, m) for t in every for m in methods)), lambda x: x.isNotNull())
    made = ready.select(*keep, each.alias("each")).select(*keep, F.explode("each").alias("s")).select(*keep, "s.*")
    if not details:
        return made.select(*keep, "scoring_type", "scoring_method", *(F.col(f"match_score.{c}") for c in counts))
    return made.select(*keep, "scoring_type", "scoring_method", F.col("match_score").dropFields("sub_scores").alias("match_score"), F.col("match_score.sub_scores").alias("sub_scores"), *(F.col(f"match_score.{c}") for c in ("tp", "fp", "fn", "tn", "score")))


def joined_values(side: str, names: Sequence[str]) -> Column:
    """The values of several fields of a map, in the order of the names; missing ones give nothing."""
    every = F.flatten(F.array(*(F.coalesce(F.try_element_at(F.col(side), F.lit(n)), F.array()) for n in names)))
    return every


def _boxes(e: Column, a: Column, kind: str, settings: Mapping) -> Column:
    if kind == "bounding_box_intersection_area":
        got = lambda xs: boxes.parse(F.array_join(xs, ";"))
        counted = boxes.area_counts(got(e), got(a), float(settings.get("resolution", boxes.RESOLUTION)))
        return _let(counted, lambda s: F.struct(*(s[c].alias(c) for c in ("tp", "fp", "fn")), F.lit(0).alias("tn"), s["score"].alias("score"), F.array_join(e, ";").alias("expected"), F.array_join(a, ";").alias("actual"), F.lit(None).cast(f"array<{ITEM}>").alias("sub_scores")).cast(MATCH))
    m = Method(kind, lambda x, y: boxes.similarity(boxes.parse(x), boxes.parse(y)), 0.8)
    return TYPES[settings.get("scoring_type", "partial_ulist")](e, a, m)


def _box_counts(pairs: DataFrame, keys: Sequence[str], custom: Sequence[Mapping], typed: bool) -> DataFrame:
    """score_custom() without details: values are parsed once, for custom fields of the same names too."""
    names = list(dict.fromkeys((tuple(c["expected"]["field_names"]), tuple(c["actual"]["field_names"])) for c in custom))
    sides = {f"s{k}{side[0]}": (mapping.texts(x) if typed else x).alias(f"s{k}{side[0]}") for k, of in enumerate(names) for side, x in (("expected", joined_values("expected", of[0])), ("actual", joined_values("actual", of[1])))}
    parsed = [c for n in sides for c in (F.transform(n, boxes.parse).alias(n), F.transform(n, lambda x: _blank(x) != "").alias(f"{n}_some"))]
    wanted = [(c["name"], c["type"], f"s{names.index((tuple(c['expected']['field_names']), tuple(c['actual']['field_names'])))}", float((c.get("config") or {}).get("resolution", boxes.RESOLUTION)) if c["type"] == "bounding_box_intersection_area" else 0.8) for c in custom]
    return box_lists.counted(pairs.select(*keys, *sides.values()).select(*keys, *parsed), keys, wanted)


def score_custom(pairs: DataFrame, keys: Sequence[str], custom: Sequence[Mapping], details: bool = True) -> DataFrame:
    """Rows as of score_fields() for custom fields (name, type, expected and actual field_names, config): shared boxes of several fields."""
    unknown = {c["type"] for c in custom} - {"bounding_box_intersection", "bounding_box_intersection_area"}
    if unknown:
        raise KeyError(", ".join(sorted(unknown)))
    made, typed = [], isinstance(pairs.schema["expected"].dataType.valueType.elementType, StructType)
    if not details and all((c.get("config") or {}).get("scoring_type", "partial_ulist") == "partial_ulist" for c in custom):
        return _box_counts(pairs, keys, custom, typed)
    for c in custom:
        kind = c["type"]
        e, a = (mapping.texts(x) if typed else x for x in (joined_values(side, c[side]["field_names"]) for side in ("expected", "actual")))
        made.append(F.struct(F.lit(c["name"]).alias("field_name"), F.lit(kind).alias("scoring_type"), F.lit(kind).alias("scoring_method"), _boxes(e, a, kind, c.get("config") or {}).alias("match_score")))
    each = pairs.select(*keys, F.explode(F.array(*made)).alias("s")).select(*keys, "s.*")
    return each.select(*keys, "field_name", "scoring_type", "scoring_method", F.col("match_score").dropFields("sub_scores").alias("match_score"), F.col("match_score.sub_scores").alias("sub_scores"), *(F.col(f"match_score.{c}") for c in ("tp", "fp", "fn", "tn", "score")))


def score_documents(pairs: DataFrame, keys: Sequence[str], names: Sequence[str] | None, types: Mapping[str, Sequence[str]], methods: Sequence[str] = ("exact", "levenshtein"), lower: bool = False, custom: Sequence[Mapping] = (), skip_errors: bool = True, counters: Observation | None = None, details: bool = True) -> DataFrame:
    """Standard fields, then custom ones, which are scored whether they are selected or not."""
    scored = score_fields(by_field(pairs, keys, names), types, methods, lower, skip_errors, counters, details)
    more = score_custom(pairs, keys, custom, details) if custom else None
    return scored if more is None else scored.unionByName(more.select(*scored.columns))
