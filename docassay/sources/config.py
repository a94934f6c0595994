"""Settings, read on the driver: mappings and scoring types in INI files, lists of fields, overrides."""

from __future__ import annotations

import configparser
import json
from collections.abc import Iterable, Mapping


def ini(text: str) -> dict[str, dict[str, str]]:
    """Sections and their keys, in order and with their case."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.optionxform = str  # type: ignore[assignment]
    parser.read_string(text)
    return {s: dict(parser[s]) for s in parser.sections()}


def custom_fields(config: Mapping) -> list[dict]:
    """The custom fields of an evaluation's settings, which the caller has loaded from YAML or JSON."""
    return list((config.get("custom") or {}).get("fields") or [])


def names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def field_list(text: str, default: Iterable[str] = ()) -> list[str]:
    """A list a,b instead of the default; or +a,b,-c to add to and take from it, a sign holding until the next one.

    ValueError if what is to be taken isn't there.
    """
    every = names(text)
    if not every or every[0][0] not in "+-":
        return every
    chosen, sign = list(default), "+"
    for x in every:
        if x[0] in "+-":
            sign, x = x[0], x[1:].strip()
        if sign == "+":
            chosen.append(x)
        else:
            chosen.remove(x)
    return chosen


def overrides(text: str) -> dict[str, list[str]]:
    """field=type,type|field=type."""
    pairs = (p.partition("=") for p in text.split("|") if p.strip())
    return {k.strip(): names(v) for k, _, v in pairs}


def scoring_types(config: Mapping[str, str], over: Mapping[str, list[str]], field: str) -> list[str]:
    """A field's scoring types: overridden, configured, the configured default, or string."""
    return over.get(field) or names(config.get(field) or config.get("default") or "string")


def source_fields(fields: list[str] | None, custom: list[dict]) -> list[str] | None:
    """Fields to extract: the selected ones and what the selected custom fields are made of."""
    if not fields:
        return fields
    more = [f for c in custom if c.get("name") in fields for side in ("expected", "actual") for f in (c.get(side) or {}).get("field_names", [])]
    return list(dict.fromkeys([*fields, *more]))


#: The fields that are evaluated where none are named, in order.
DEFAULT_FIELDS = """
title
abstract
keywords
first_author_surname
corresp_author_surnames
author_surnames
first_author_given_name
corresp_author_given_names
author_given_names
first_author_full_name
corresp_author_full_names
author_full_names
corresp_author_emails
author_emails
affiliation_text
affiliation_strings
affiliation_label
affiliation_institution
affiliation_country
body_section_labels
body_section_titles
body_section_label_titles
first_body_section_paragraph
body_reference_citation_text
body_asset_citation_text
tables
table_strings
table_labels
table_captions
table_label_captions
figure_labels
figure_captions
figure_label_captions
acknowledgement
back_section_labels
back_section_titles
back_section_label_titles
back_section_paragraphs
first_back_section_paragraph
first_reference_text
first_reference_author_surnames
first_reference_author_given_names
first_reference_author_full_names
first_reference_title
first_reference_year
first_reference_source
first_reference_publication_type
first_reference_volume
first_reference_fpage
first_reference_lpage
first_reference_doi
first_reference_pmid
first_reference_pmcid
reference_text
reference_author_surnames
reference_author_given_names
reference_author_full_names
reference_title
reference_year
reference_source
reference_publication_type
reference_volume
reference_fpage
reference_lpage
reference_doi
reference_pmid
reference_pmcid
all_section_labels
all_section_titles
all_section_label_titles
first_all_section_paragraph
""".split()


def settings(text: str) -> dict:
    """An evaluation's settings in JSON, or in YAML where its reader is installed."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text) or {}
