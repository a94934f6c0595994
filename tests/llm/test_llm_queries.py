"""The registered queries over the smallest tables, against plain Python or SQL, and the pipeline stage by stage."""

import base64
import hashlib
import os
import re
import struct
import zlib

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from docassay.llm import order_minhash, queries, quality_fm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall()
    assert len({i for i, _ in rows}) == len(rows)
    return {i: t or "" for i, t in rows}


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def by_id(spark, name, key="doc_id"):
    rows = queries.queries()[name](spark, SF).collect()
    got = {r[key]: r for r in rows}
    assert len(got) == len(rows)
    return got


def test_op1(spark, texts, encoding):
    got = by_id(spark, "op1_bpe")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = encoding.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(t))


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= sum(map(str.isdigit, m.group())) <= 19 and luhn([int(c) for c in m.group() if c.isdigit()])),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(map(str.isdigit, m.group())) <= 15),
}
SECRETS = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 16),
}


@pytest.mark.parametrize(("name", "rules"), [("op2_pii", PII), ("op7_secrets", SECRETS)])
def test_base_spans(spark, texts, name, rules):
    got = by_id(spark, name)
    assert got.keys() == texts.keys()
    kinds = list(rules)
    for i, t in texts.items():
        found = [(m.start(), k, m.end()) for k, kind in enumerate(kinds) for m in re.finditer(rules[kind][0], t) if rules[kind][1](m)]
        said = [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found)]
        assert got[i].base_sha256 == sha(",".join(said)) and set(said) <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s.startswith(f"{k}:") for s in said) for k in kinds]


def test_op3(spark, texts):
    got = by_id(spark, "op3_quality")
    labels = dict(duckdb.sql(f"select doc_id, quality from read_parquet('{SF}/labels.parquet')").fetchall())
    assert got.keys() == texts.keys() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [r.predicted == labels[i] for i, r in got.items() if r.held_out and labels.get(i) is not None]
    assert sum(held) >= 0.9 * len(held) > 0


def test_op5(spark, texts):
    got = by_id(spark, "op5_gif")
    assert got.keys() == texts.keys()
    same = {}
    for i, t in texts.items():
        data = t.encode()
        payload = data + b"\0" * (-len(data) % 64 or 64 * (not data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert same.setdefault(t, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_op5_stores_and_loads_in_one_python_worker_a_task(spark):
    """Two of them, each with whole batches, took an executor's memory twice."""
    made = queries.queries()["op5_gif"](spark, SF)
    assert len(re.findall("MapInArrow", made._jdf.queryExecution().executedPlan().toString())) == 1


def test_op6(spark):
    got = by_id(spark, "op6_chat", "conv_id")
    rows = duckdb.sql(f"select conv_id, turn, role, text from read_parquet('{SF}/conversations.parquet') order by conv_id, turn").fetchall()
    said = "</s>[INST] ok [/INST]"
    convs: dict = {-1: [("user", said), ("assistant", said)]}
    for c, _, role, text in rows:
        convs.setdefault(c, []).append((role, text or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
        assert got[c].formatted_chars == sum(len(f"<s>[{r}]</s>") + len(t) + sum(t.count(x) for x in "\\<[]") for r, t in turns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    tidy = lambda d: d[sorted(d.columns)].sort_values(sorted(d.columns), ignore_index=True)
    pd.testing.assert_frame_equal(tidy(queries.queries()[name](spark, SF).toPandas()), tidy(c.sql(queries.oracle_sql()[name]).df()), check_dtype=False)


def test_op4(spark, texts):
    got = by_id(spark, "op4_unit_dedup")
    assert got.keys() == texts.keys()
    seen = set()
    for i in sorted(texts):
        spans = [tuple(map(int, s.split(":"))) for s in got[i].removed.split(",") if s]
        assert len(spans) == got[i].n_removed
        assert "".join(texts[i][b:a] for (_, b), (a, _) in zip([(0, 0), *spans], [*spans, (len(texts[i]), 0)])) == got[i].text
        lines = [" ".join(x.lower().split()) for x in texts[i].split("\n") if x.strip()]
        left = {" ".join(x.lower().split()) for x in got[i].text.split("\n")}
        assert not left & seen - {""}  # no line that occurs earlier is left
        seen |= set(lines)


def test_op8_recall_and_classes(spark, texts):
    got = by_id(spark, "op8_near_dedup")
    grams = {i: order_minhash.gram_hashes(order_minhash.word_hashes(order_minhash.WORD.findall(t.lower()), {})) for i, t in texts.items()}
    sets = {i: set(g.tolist()) for i, g in grams.items()}
    ids, together, apart = sorted(texts), 0, 0
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 2 * len(sets[i] & sets[j]) >= 0.8 * max(len(sets[i]), len(sets[j])) and order_minhash.similarity(grams[i], grams[j]) >= 0.8:
                together += got[i].class_id == got[j].class_id
                apart += got[i].class_id != got[j].class_id
    assert together and apart <= 0.02 * together
    classes = {}
    for i in ids:
        classes.setdefault(got[i].class_id, []).append(i)
    assert all(k == min(v) and got[k].class_size == len(v) for k, v in classes.items())


def test_pipeline_stage_by_stage(spark, texts, encoding, tmp_path):
    docs, kept = corpus_pipeline.read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{len(kept)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(kept)}")
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(kept[-1])
    machine = quality_fm.train(corpus_pipeline.read(spark, SF, "documents"), corpus_pipeline.read(spark, SF, "labels"))
    assert kept[0].keys() == {i for i, t in texts.items() if machine.score(t, {}) >= 0.5}
    lines = {i: (r.text or "").split("\n") for i, r in kept[0].items()}
    assert kept[1].keys() == kept[0].keys()
    for i, r in kept[1].items():
        at = 0
        for x in (r.text or "").split("\n") if r.text else ():  # what is left stands in order in what there was
            at = lines[i].index(x, at) + 1
        assert r.n_chars == len(r.text or "")
    table = spark.createDataFrame(list(kept[1].values()), corpus_pipeline.read(spark, SF, "documents").schema)
    class_of = {r.doc_id: r.class_id for r in order_minhash.classes(table).collect()}
    assert kept[2].keys() == set(class_of.values())
    bench = [winnowing_words(t) for (t,) in duckdb.sql(f"select text from read_parquet('{SF}/benchmark.parquet')").fetchall()]
    wins = {tuple(w[i : i + min(13, len(w))]) for w in bench for i in range(len(w) - min(13, len(w)) + 1) if w}
    for i, r in kept[2].items():
        w = winnowing_words(r.text)
        hit = {p for n in {len(x) for x in wins} for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in wins for p in range(a, a + n)}
        assert (i in kept[3]) == (not (hit and 20 * len(hit) >= len(w)))
    assert kept[4].keys() == kept[3].keys()
    for i, r in kept[4].items():
        ids = encoding.encode_ordinary(kept[3][i].text or "")
        assert bytes(r.tokens) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded_sha256 == sha(kept[3][i].text or "")
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id: r.ids_sha256 for r in whole.collect()} == {i: r.ids_sha256 for i, r in kept[4].items()}


def test_pipeline_sends_each_text_to_python_once(spark, monkeypatch):
    docs, sent = corpus_pipeline.read(spark, SF, "documents"), []
    monkeypatch.setattr(quality_fm, "score", lambda df, machine, score=quality_fm.score: sent.append(df) or score(df, machine))
    assert corpus_pipeline.quality(spark, docs, SF).schema.fields == docs.schema.fields
    assert [f.name for f in sent[0].schema["row"].dataType.fields] == [c for c in docs.columns if c != "text"]
    for made in (corpus_pipeline.tokenize(spark, docs, SF), queries.queries()["op1_bpe"](spark, SF)):  # two Python workers a task took memory twice
        assert len(re.findall("MapInArrow", made._jdf.queryExecution().executedPlan().toString())) == 1


def winnowing_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
