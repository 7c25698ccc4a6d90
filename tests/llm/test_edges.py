"""Every training-data operator, and the pipeline, on nulls, empty, repeated and very long texts, ties, empty tables and clashing columns."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import bpe, chat, decontaminate, exact_dedup, language, lm, near_dedup, pii, token_counts, toxicity

LONG = " ".join(f"w{k % 997} x{k}" for k in range(60_000))
DOCS = [(1, None), (2, ""), (3, " \t"), (4, "one two three"), (4, "one two three"), (None, "no id"), (None, None), (5, LONG), (6, LONG + " end"), (7, "x" * 200_000), (8, "one  two three")]
CLASH = {"row": 1, "__row": 2, "__row_": 3, "n_words": 4, "spans": 5, "removed": 6, "bands": 7, "key1": 8, "label": 9, "run": 10, "rejected": 11, "toxic": 12, "item_id": 13, "held_out": 14, "class_id": 15}


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame([(i, t, "en" if i and i % 2 else None) for i, t in DOCS], "doc_id long, text string, lang string")
    return out.select("*", *[F.lit(v).alias(c) for c, v in CLASH.items()]).repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 1), (6, 0, 1), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(LONG.split()[500:530])), (2, None), (None, "two three"), (3, ""), (1, "one")], "item_id long, text string")


def test_every_operator_gives_a_row_for_each_document(docs, none, labels, benchmark):
    operators = {
        "token_counts": token_counts.count,
        "decontaminate": lambda d: decontaminate.search(d, benchmark),
        "language": language.identify,
        "bpe": bpe.encode,
        "pii": pii.find,
        "exact_dedup": exact_dedup.resolve,
        "lm": lm.score,
        "near_dedup": near_dedup.classes,
        "toxicity": lambda d: toxicity.grade(d, labels),
    }
    for name, operator in operators.items():
        got = [r.doc_id for r in operator(docs).collect()]
        assert sorted(got, key=str) == sorted((i for i, _ in DOCS), key=str), name
        assert operator(none).collect() == [], name


def test_results_on_odd_texts(docs, benchmark):
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    tokens, hits, scores = by_id(token_counts.count(docs)), by_id(decontaminate.search(docs, benchmark)), by_id(lm.score(docs))
    assert tokens[1].n_tokens == tokens[2].n_tokens == tokens[3].n_tokens == 0 and tokens[5].n_bytes == len(LONG) and tokens[5].over_limit
    assert (hits[5].n_words, hits[5].n_hit, hits[5].contaminated) == (120_000, 30, False) and hits[4].n_hit == 3 and hits[4].contaminated
    assert scores[5].n_tokens == 120_001 and scores[1].n_tokens == 1 and all(r.score < 0 for r in scores.values())
    exact = exact_dedup.resolve(docs).collect()
    assert [(r.keep_id, r.group_size) for r in exact if r.doc_id == 4] == [(8, 3)] * 2  # the longer original stays
    assert sum(r.kept for r in exact) == 6  # empty, the threes, no id, both long ones, x
    near = near_dedup.classes(docs).collect()
    assert {r.class_id for r in near if r.doc_id in (5, 6)} == {5} and sum(r.kept for r in near if r.doc_id == 4) == 1


def test_rows_keep_all_their_columns(docs, none, labels, benchmark):
    for change in (exact_dedup.deduplicate, near_dedup.deduplicate, lambda d: decontaminate.remove(d, benchmark), lambda d: toxicity.keep(d, labels), pii.sanitised):
        out = change(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == v for r in rows for c, v in CLASH.items())
        assert change(none).collect() == []


def test_labels_of_equal_texts_take_the_highest(spark):
    texts = [(k, f"vile rotten {k // 2}") for k in range(80)] + [(100 + k, f"mild kind {k // 2}") for k in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 80 and k % 2 == 0)) for k, _ in texts], "doc_id long, toxic int")
    got = {r.doc_id: r.rejected for r in toxicity.grade(docs, labels).collect()}
    assert all(got[k] for k in range(80)) and not any(got[100 + k] for k in range(80))


def test_turns_with_equal_numbers_are_ordered_by_their_raw_text(spark):
    turns = spark.createDataFrame([(1, 0, "user", "A"), (1, 0, "user", "<"), (1, None, "user", None), (1, 1, "assistant", "y" * 300_000), (None, 0, None, "z"), (None, 0, None, "z")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.text_parts(turns.withColumn("parts", F.lit(1))))).collect()}
    assert [t.text for t in got[1].turns] == ["", "<", "A", "y" * 300_000] and got[1].loss_text == "y" * 300_000
    assert [t.text for t in got[None].turns] == ["z", "z"]


def written(path, docs, labels, benchmark):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_the_pipeline_on_odd_and_empty_tables(spark, docs, none, labels, benchmark, tmp_path):
    rows = corpus_pipeline.run(spark, written(tmp_path / "odd", docs, labels.limit(0), benchmark)).collect()
    assert {r.doc_id for r in rows} >= {7} and len(rows) == len({r.doc_id for r in rows})
    assert all(r.decoded_sha256 == hashlib.sha256(dict(DOCS)[r.doc_id].encode()).hexdigest() for r in rows if r.doc_id in (5, 7))
    assert corpus_pipeline.run(spark, written(tmp_path / "empty", none, labels, benchmark)).collect() == []
