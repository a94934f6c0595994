"""python -m docassay evaluate|extract: evaluates two file lists of XML documents, or gives one document's fields as JSON."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import details, extraction, mapping, scoring, summary
from .sources import config, files


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="docassay")
    tasks = top.add_subparsers(dest="task", required=True)
    one = tasks.add_parser("evaluate")
    for side in ("target", "prediction"):
        one.add_argument(f"--{side}-file-list", required=True)
        one.add_argument(f"--{side}-file-column", default="url")
    one.add_argument("--folder", action="append", required=True, help="folder that holds listed files; may be repeated")
    one.add_argument("--limit", type=int)
    one.add_argument("--evaluation-config", help="INI file with scoring types by field")
    one.add_argument("--evaluation-yaml-config", help="file with custom fields")
    one.add_argument("--scoring-type-overrides", default="")
    one.add_argument("--measures", default="exact,levenshtein")
    one.add_argument("--convert-to-lower", action="store_true")
    one.add_argument("--skip-errors", action=argparse.BooleanOptionalAction, default=True)
    one.add_argument("--output-path", required=True)
    two = tasks.add_parser("extract")
    two.add_argument("--xml-file", required=True)
    for task in (one, two):
        task.add_argument("--xml-mapping", required=True)
        task.add_argument("--fields", default="")
    return top.parse_args(args)


def text_of(spark: SparkSession, path: str | None) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect()) if path else ""


def field_maps(pairs: DataFrame, maps: dict, names: list[str] | None, skip_errors: bool = True, counters: Observation | None = None) -> DataFrame:
    """Pairs with `expected` and `actual`, maps of fields, for their contents.

    Pairs with a document that can't be read, or whose root the mapping doesn't have, are counted (documents,
    document_error) and left out, or end the job if errors aren't to be skipped.
    """
    errors = []
    for side, to in (("target", "expected"), ("prediction", "actual")):
        keys = [c for c in pairs.columns if c != f"{side}_content"]
        made = mapping.with_fields(extraction.shred(pairs, f"{side}_content", keys), maps, names)
        errors.append(f"{side}_error")
        pairs = made.select(*keys, F.col("fields").alias(to), F.col("error").alias(errors[-1]))
    wrong = F.concat_ws("; ", *errors)
    if counters is not None:
        pairs = pairs.observe(counters, F.count(F.lit(1)).alias("documents"), F.count_if(wrong != "").alias("document_error"))
    return pairs.where((wrong == "") if skip_errors else F.when(wrong == "", True).otherwise(F.raise_error(wrong))).drop(*errors)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    """Writes results, summary and report under the output path; the counts of pairs and errors."""
    maps = config.ini(text_of(spark, a.xml_mapping))
    given = config.ini(text_of(spark, a.evaluation_config)) if a.evaluation_config else {}
    types = given.get("scoring_type") or given.get("scoring_types") or {}
    custom = config.custom_fields(config.settings(text_of(spark, a.evaluation_yaml_config))) if a.evaluation_yaml_config else []
    over = config.overrides(a.scoring_type_overrides)
    names = config.field_list(a.fields, config.DEFAULT_FIELDS) if a.fields else list(config.DEFAULT_FIELDS)
    by_field = {f: config.scoring_types(types, over, f) for f in names} | {"default": config.names(types.get("default", "string"))}
    read, taken, scored_fields = Observation("files"), Observation("documents"), Observation("fields")
    lists = [files.file_list(spark, p, c, a.limit) for p, c in ((a.target_file_list, a.target_file_column), (a.prediction_file_list, a.prediction_file_column))]
    asked = lists[0].select("path").unionByName(lists[1].select("path"))
    pairs = files.with_content(files.file_pairs(*lists), files.listed(spark, a.folder, asked), read)
    fields = files.stored(field_maps(pairs, maps, config.source_fields(names, custom), a.skip_errors, taken))
    keys = ["target_file", "prediction_file"]
    scored = files.stored(scoring.score_documents(fields, keys, names, by_field, config.names(a.measures), a.convert_to_lower, custom, a.skip_errors, scored_fields))
    files.write_details(details.flatten_details(scored, names), f"{a.output_path}/results")
    rows = files.stored(summary.summary(scored, names))
    files.write_summary(summary.in_order(details.flatten_summary(rows, fields.count()).withColumnRenamed("evaluation_method", "scoring_method"), names).withColumnRenamed("scoring_method", "evaluation_method"), f"{a.output_path}/summary")
    spark.createDataFrame([(files.report_text(rows, names),)], "value string").coalesce(1).write.text(f"{a.output_path}/report")
    return dict(read.get) | dict(taken.get) | dict(scored_fields.get)


def extract(spark: SparkSession, a: argparse.Namespace) -> str:
    """The fields of one document as JSON."""
    content = files.contents(spark, a.xml_file)
    made = mapping.with_fields(extraction.shred(content, "content", ["path"]), config.ini(text_of(spark, a.xml_mapping)), config.names(a.fields) or None)
    row = made.select(mapping.as_json(F.col("fields")).alias("fields"), "error").first()
    if row.error:
        raise ValueError(row.error)
    return row.fields


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = SparkSession.builder.appName("docassay").getOrCreate()
    print(evaluate(spark, a) if a.task == "evaluate" else extract(spark, a))


if __name__ == "__main__":
    main()
