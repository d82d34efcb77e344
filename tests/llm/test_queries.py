"""The registered queries: oracles, contracts, and the pipeline stage by stage."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from oracle_check import compare, duck
from quiver.llm import queries
from quiver.llm import toxicity as tox
from test_models_and_matching import brute_hits
from test_text_dedup import brute_components, brute_suffix, word_sets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_all_are_registered():
    names = set(E.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(spark, duck(SF), SF, name, queries.QUERIES[name], queries.ORACLE[name])
    assert r["ok"] is True, r


def test_near_dedup_query(spark, documents):
    sets = word_sets(documents, 4)
    roots = brute_components(sets, (80, 100))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.QUERIES["op8_minhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (len(sets[i]), roots[i], roots[i] == i) for i in sets}


def test_suffix_query(spark, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op6_suffix_array_dedup"](spark, SF).collect()}
    assert got == {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for i, x in brute_suffix(documents, 100).items()}


def test_decontamination_query(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_hits(documents, items)
    got = {r.doc_id: r for r in queries.QUERIES["op9_benchmark_decontamination"](spark, SF).collect()}
    assert set(got) == set(want)
    for i, (n, hit, found) in want.items():
        ids = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, sum(hit), len(found), ids, any(hit))


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in kept[name]}
        if name == "toxicity":
            model = tox.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            scores = tox.scores(spark.read.parquet(f"{SF}/documents.parquet"), model)
            assert set(after) == {r.doc_id for r in scores.where("toxicity < 0.5").collect()}
        if name == "near_dedup":
            roots = brute_components(word_sets(before, 5), (80, 100))
            assert set(after) == {i for i in roots if roots[i] == i}
        if name == "suffix_dedup":
            want = {i: x for i, x in brute_suffix(before, 100).items() if not (x[1] and not x[3].decode("utf-8", "ignore"))}
            assert {i: t or "" for i, t in after.items()} == {i: x[3].decode("utf-8", "ignore") for i, x in want.items()}
            assert all(r.n_chars == len(r.text) for r in kept[name] if want[r.doc_id][1])
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            hit = {i: x for i, x in brute_hits(before, items).items() if any(x[1])}
            assert hit and {i for i, _ in before} - set(hit) <= set(after)
            for i, t in before:
                if i not in hit:
                    assert after[i] == t
                elif i in after:
                    assert len(after[i]) < len(t)
                else:
                    assert sum(hit[i][1]) > 0.5 * hit[i][0]
        if name == "mixing":
            assert {r.doc_id for r in kept[name]} == {i for i, _ in before} and all(r.rate >= 0 for r in kept[name])
    final = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in final.select("doc_id").collect()) == sorted(r.doc_id for r in kept["mixing"])


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_keep_extra_columns_and_take_empty_tables(spark, stage):
    name, run = stage
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false").withColumn("hits", F.lit(1)).withColumn("root", F.lit("x"))
    out = run(spark, docs, SF)
    assert out.count() == 0
    if name != "mixing":
        assert out.columns == docs.columns


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_nulls(spark, stage):
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "a lone clean text", None, "s", 17), (3, "a lone clean text", None, "s", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in stage[1](spark, docs, SF).collect()} == {1, 2, 3}
