"""File lists, the files that they name, tables of results, and the tables and report that are written."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.details import SUMMARY
from .stored import stored


def positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """Numbers rows from 0 in their order, without bringing them together: only the partitions' sizes are.

    The partitions are stored first, so sizes and numbers come from one result.
    """
    ids = stored(df.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = ids.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    numbered = ids.withColumn("__part", part).join(F.broadcast(before), "__part")
    return numbered.select(*df.columns, (F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).alias(name))


def file_list(spark: SparkSession, path: str, column: str = "url", limit: int | None = None) -> DataFrame:
    """(pos, path) of a list: a column of .csv or .tsv, or the lines of any other text. Relative entries are under the list's folder."""
    name = path.removesuffix(".gz")
    if name.endswith((".csv", ".tsv")):
        rows = spark.read.csv(path, header=True, sep="\t" if name.endswith(".tsv") else ",").select(F.col(f"`{column}`").alias("path"))
    else:
        rows = spark.read.text(path).select(F.col("value").alias("path"))
    folder = path.rpartition("/")[0]
    full = F.when(F.col("path").rlike(r"^(/|[a-z][a-z0-9+.-]*:)"), F.col("path")).otherwise(F.concat(F.lit(f"{folder}/" if folder else ""), "path"))
    numbered = positions(rows.where(F.trim("path") != "").select(full.alias("path")))
    return numbered if limit is None else numbered.where(F.col("pos") < limit)


def file_pairs(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """(pos, target_file, prediction_file); ValueError if one list is empty or longer than the other."""
    sizes = targets.count(), predictions.count()
    if sizes[0] != sizes[1] or not sizes[0]:
        raise ValueError(f"file lists must have the same number of files, and some: {sizes}")
    return targets.withColumnRenamed("path", "target_file").join(predictions.withColumnRenamed("path", "prediction_file"), "pos")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        content, errors = [], []
        for c in b.column("content"):
            raw, error = c.as_py(), None
            try:
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
            except (OSError, EOFError) as e:
                raw, error = None, str(e)
            content.append(raw)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["path", "content", "error"])


def contents(spark: SparkSession, folders: Sequence[str] | str, glob: str = "*") -> DataFrame:
    """(path, content, error) of the files under folders; gzip files opened, with an error and no content if that fails."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folders)
    return files.select("path", "content").mapInArrow(_opened, "path string, content binary, error string")


#: Paths that one read of listed files takes at most.
AT_ONCE = 20_000


def listed(spark: SparkSession, folders: Sequence[str] | str, paths: DataFrame, glob: str = "*") -> DataFrame:
    """(path, content, error) like contents(), of the files under folders that paths (path) lists.

    The folders are listed without reading a file; then only the files that are there and asked for are read, AT_ONCE to
    a read. Their names pass through the driver, as those of any files that Spark reads do.
    """
    there = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folders).select("path")
    wanted = paths.select(local(F.col("path")).alias("__wanted")).distinct()
    found = there.join(wanted, local(F.col("path")) == F.col("__wanted"), "left_semi").distinct().orderBy("path").toLocalIterator()
    made, some = None, []

    def more(part: list[str]) -> DataFrame:
        plain = [re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in part]  # names, not patterns
        return spark.read.format("binaryFile").load(plain).select("path", "content")

    for row in found:
        some.append(row.path)
        if len(some) == AT_ONCE:
            made, some = more(some) if made is None else made.unionByName(more(some)), []
    if some:
        made = more(some) if made is None else made.unionByName(more(some))
    kind = "path string, content binary, error string"
    return spark.createDataFrame([], kind) if made is None else made.mapInArrow(_opened, kind)


def local(path: Column) -> Column:
    """A path without its file scheme, to join listed paths with those read."""
    return F.regexp_replace(path, r"^file:/*", "/")


def with_content(pairs: DataFrame, files: DataFrame, counters: Observation | None = None) -> DataFrame:
    """File pairs with both contents; pairs with a file that is missing or can't be opened are counted (file_pairs, read_error) and left out."""
    for c in ("target", "prediction"):
        side = files.select(local(F.col("path")).alias(f"__{c}"), F.col("content").alias(f"{c}_content"), F.coalesce("error", F.lit("")).alias(f"__{c}_error"))
        pairs = pairs.join(side, local(F.col(f"{c}_file")) == F.col(f"__{c}"), "left").drop(f"__{c}")
    bad = F.concat(F.coalesce("__target_error", F.lit("missing")), F.coalesce("__prediction_error", F.lit("missing"))) != ""
    if counters is not None:
        pairs = pairs.observe(counters, F.count(F.lit(1)).alias("file_pairs"), F.count_if(bad).alias("read_error"))
    return pairs.where(~bad).drop("__target_error", "__prediction_error")


def results(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Written results or summaries of several tools, with `tool` and `key` (field:type)."""
    tables = [spark.read.csv(p, header=True, nullValue="None", multiLine=True, escape='"').withColumn("tool", F.lit(t)) for t, p in paths.items()]
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    return whole.withColumn("key", F.concat_ws(":", "field_name", "scoring_type"))


def write_details(details: DataFrame, path: str) -> None:
    details.write.csv(path, header=True, nullValue="None", escape='"', emptyValue="")


def write_summary(summary: DataFrame, path: str) -> None:
    """One file: a summary has as many rows as fields, types and methods."""
    summary.select(*SUMMARY).coalesce(1).write.csv(path, header=True, nullValue="None", escape='"', emptyValue="")


#: The report's methods in order with their headings, its columns and their widths.
HEADINGS = {
    "exact": "======= Strict Matching ======= (exact matches)",
    "soft": "======== Soft Matching ======== (ignoring punctuation, case and space characters mismatches)",
    "levenshtein": "==== Levenshtein Matching ===== (Minimum Levenshtein distance at 0.8)",
    "ratcliff_obershelp": "= Ratcliff/Obershelp Matching = (Minimum Ratcliff/Obershelp similarity at 0.95)",
}
RESULTS = "===== Field-level results ====="
METRICS, WIDTHS = ("accuracy", "precision", "recall", "f1"), (20, 10, 10, 10, 10, 20)


def report(summary: DataFrame, field_names: Sequence[str] | None = None) -> DataFrame:
    """(scoring_method, report): each method's metrics of joined strings as a block of text, made by Spark.

    Rows are fields in the order of field_names, or by name, the micro row, and the macro row, which has no label and
    so stands a column further left. Other scoring types are left out.
    """

    def row(*cells: Column) -> Column:
        return F.array_join(F.array(*(F.when(F.char_length(c) >= w, c).otherwise(F.lpad(c, w, " ")) for c, w in zip(cells, WIDTHS))), " ")

    rows = summary.where("scoring_type = 'string'") if "scoring_type" in summary.columns else summary
    place = F.lit(0) if field_names is None else F.array_position(F.array(*map(F.lit, field_names)), F.col("field_name"))
    if field_names is not None:
        rows = rows.where(F.col("field_name").isNull() | F.col("field_name").isin(*field_names))
    numbers = [F.format_string("%.2f", F.bround(F.col(m) * 100, 2)) for m in METRICS]
    line = F.when(F.col("stats_name") == "micro", row(F.lit("all fields"), *numbers, F.lit("(micro average)"))).when(F.col("stats_name") == "macro", row(*numbers, F.lit("(macro average)"))).otherwise(row(F.col("field_name"), *numbers))
    rank = F.when(F.col("stats_name") == "micro", 1).when(F.col("stats_name") == "macro", 2).otherwise(0)
    lines = rows.groupBy("scoring_method").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), place.alias("place"), "field_name", line.alias("line")))).alias("rows"))
    part = lambda k: F.transform(F.filter("rows", lambda r: r["rank"] >= 1 if k else r["rank"] == 0), lambda r: r["line"])
    head = F.create_map(*(F.lit(x) for kv in HEADINGS.items() for x in kv))[F.col("scoring_method")]
    body = F.concat(F.array(row(*map(F.lit, ("label", *METRICS))), F.lit("")), part(0), F.array(F.lit("")), part(1))
    block = F.concat(F.lit("\n  "), head, F.lit(f"\n\n  {RESULTS}\n\n  "), F.array_join(body, "\n"))
    return lines.where(F.col("scoring_method").isin(*HEADINGS)).select("scoring_method", block.alias("report"))


def report_text(summary: DataFrame, field_names: Sequence[str] | None = None) -> str:
    """The blocks of all methods in their order: four rows at most. ValueError if there are results, but of no known method."""
    blocks = dict(tuple(r) for r in report(summary, field_names).collect())
    if not blocks and not summary.isEmpty():
        raise ValueError(f"no results of any of {list(HEADINGS)}")
    return "\n\n".join(blocks[m] for m in HEADINGS if m in blocks)
