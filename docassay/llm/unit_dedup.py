"""Substring dedup by hashing lines or paragraphs.

The units of a text are its lines, or its paragraphs (blocks between blank lines). Units are normalised (lower case,
single spaces) and their digests grouped over all documents; the occurrence of least rank (doc_id, then place) is kept
and every later one is removed, however short it is (`least_words` raises that). With `passages`, the sentences
inside the units are grouped in the same way, so that a passage is found wherever it stands in a line: later runs of
repeated sentences with at least so many words, or characters, are removed; shorter ones inside a unit that stays are
common phrases and stay. What is removed is told by its offsets in the original text.

Edge cases: a null text stays null and has no units; blank units aren't units; repeats within a text are removed like
those across texts; rows that repeat doc_id and text are one document, rows that repeat only doc_id are told apart by
text; an empty table gives an empty one. `text`, `removed` and `n_removed` are replaced, other columns pass.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField

from .common import append, by_heat, stored, text_key, unused, without

#: Words, and characters, of a run of repeated sentences from which it is a passage.
PASSAGES = (20, 120)
UNITS = {"line": re.compile(r"\S[^\n]*"), "paragraph": re.compile(r"\S(?:[^\n]|\n(?![^\S\n]*(?:\n|\Z)))*")}
SENTENCE = re.compile(r"\S(?:[^\n.!?]|[.!?]+(?=[^\s.!?]))*[.!?]*")

Unit = tuple[int, int, bytes, int, int]  # start, end, digest, words, number of the unit that it is or is in


def _unit(text: str, start: int, end: int, number: int, level: str) -> Unit:
    words = text[start:end].lower().split()
    return start, end, hashlib.md5((level + " ".join(words)).encode()).digest(), len(words), number


def units(text: str, unit: str = "line", sentences: bool = False) -> tuple[list[Unit], list[Unit]]:
    """The units of a text, and their sentences; digests of a unit and of a sentence are never equal."""
    whole, parts = [], []
    for i, m in enumerate(UNITS[unit].finditer(text)):
        whole.append(_unit(text, *m.span(), i, "\n"))
        if sentences:
            parts += [_unit(text, *s.span(), i, "") for s in SENTENCE.finditer(text, *m.span())]
    return whole, parts


def digests(text: str, unit: str, sentences: bool) -> list[bytes]:
    """Digests of the units, then of the sentences."""
    whole, parts = units(text, unit, sentences)
    return [u[2] for u in whole + parts]


def removed(text: str, repeats: set[int], unit: str = "line", least_words: int = 0, passages: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Offsets of what goes, repeats being the places in digests() that occur earlier."""
    if not repeats:
        return []
    whole, parts = units(text, unit, passages is not None)
    gone = {i for i, u in enumerate(whole) if i in repeats and u[3] >= least_words}
    found = [whole[i][:2] for i in gone]
    run: list[Unit] = []
    for at in range(len(parts) + 1 if passages else 0):
        if at < len(parts) and len(whole) + at in repeats:
            run.append(parts[at])
            continue
        if sum(p[3] for p in run) >= passages[0] or sum(p[1] - p[0] for p in run) >= passages[1]:
            found += [p[:2] for p in run if p[4] not in gone]
        run = []
    return _merged(text, sorted(found))


def _merged(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with only white space between them as one."""
    made: list[tuple[int, int]] = []
    for a, b in spans:
        if made and not text[made[-1][1] : a].strip():
            made[-1] = (made[-1][0], b)
        else:
            made.append((a, b))
    return made


def repeated(docs: DataFrame, unit: str, sentences: bool) -> DataFrame:
    """(doc_id, key, at): the places in digests() of what occurs earlier."""
    hashed = append(docs.select("doc_id", text_key(F.col("text")).alias("key"), "text"), [StructField("digests", ArrayType(BinaryType()))], lambda b: [pa.array([digests(t.as_py() or "", unit, sentences) for t in b.column("text")], pa.list_(pa.binary()))])
    rows = stored(hashed.select("doc_id", "key", F.posexplode("digests").alias("at", "digest")))
    place = F.struct("doc_id", "key", "at")
    several = rows.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first != last").select("digest", "first", "n")
    return by_heat(rows, stored(several), "digest", "n", rows.count()).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "key", "at")


def dedup(docs: DataFrame, unit: str = "line", least_words: int = 0, passages: tuple[int, int] | None = None) -> DataFrame:
    """docs with later occurrences gone from `text`; adds `removed`, "start:end,...", and `n_removed`."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    docs = without(docs, "removed", "n_removed")
    d, k, places = unused(docs, "gone_from", "gone_key", "gone_at")
    gone = repeated(docs, unit, passages is not None).groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias(places)).withColumnsRenamed({"doc_id": d, "key": k})
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(d)) & (text_key(docs["text"]) == F.col(k)), "left").drop(d, k)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, offsets, counts = [], [], []
        for t, at in zip(batch.column("text"), batch.column(places), strict=True):
            text = t.as_py()
            spans = removed(text or "", set(at.as_py() or ()), unit, least_words, passages)
            rest, last = [], 0
            for a, b in spans:
                rest.append(text[last:a])
                last = b
            texts.append("".join([*rest, text[last:]]) if spans else text)
            offsets.append(",".join(f"{a}:{b}" for a, b in spans))
            counts.append(len(spans))
        return [pa.array(texts, pa.string()), pa.array(offsets, pa.string()), pa.array(counts, pa.int64())]

    return append(joined, [StructField("text", StringType()), StructField("removed", StringType()), StructField("n_removed", LongType())], run).drop(places)
