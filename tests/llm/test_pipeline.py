import collections

import __spark_entry__ as entry
import corpus_pipeline
from lumenframe.llm import bpe, minhash, mixing

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    assert clean.columns == docs.columns and 0.7 * docs.count() < clean.count() <= docs.count()
    one = corpus_pipeline.drop_copies(spark, clean, SF).cache()
    assert one.columns == docs.columns
    groups = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(clean).collect()}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(groups.values()))
    mixed = corpus_pipeline.mix(spark, one, SF).cache()
    assert mixed.columns == docs.columns
    counts = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert max(counts.values()) <= 2 and set(counts) <= set(groups.values())
    out = corpus_pipeline.encode(spark, mixed, SF).collect()
    model = bpe.load(bpe.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(out) == mixed.count() and all(r["n_tokens"] == len(model.encode(texts[r["doc_id"]] or "")) for r in out)


def test_mix_keeps_documents_without_words_once(spark):
    schema = "doc_id long, text string, source string"
    empty = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (None, None, "b")]
    words = [(i, "one two three four", "a") for i in range(10, 40)]
    for rows in (empty, empty + words):
        docs = spark.createDataFrame(rows, schema)
        assert collections.Counter(r["doc_id"] for r in mixing.mix_sources(docs).collect()) == collections.Counter(r[0] for r in rows)
        counts = collections.Counter(r["doc_id"] for r in corpus_pipeline.mix(spark, docs, SF).collect())
        assert [counts[r[0]] for r in empty] == [1] * len(empty)


def test_stages_take_columns_of_any_name(spark):
    schema = "doc_id long, text string, source string, copies string, copy long, rate double, `row of id` long, `toxicity score` double, `id of` string"
    rows = [(i if i % 9 else None, f"some words {i} here", "ab"[i % 2], f"c{i}", i, 0.5, -i, 2.0, "x") for i in range(60)] + [(100, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    own = {r[3]: r for r in rows}
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_copies, corpus_pipeline.mix):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and all(r == own[r[3]] for r in got)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.encode(spark, docs.limit(0), SF).count() == 0
