import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import ALNUM, LOW, brute_base, brute_components, brute_hits, docs_of, near_texts, odd_docs, toxic_data

import corpus_pipeline as pipeline
from weft.llm import queries, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with near copies, toxic texts, benchmark passages and secrets."""
    rnd = random.Random(21)
    texts, marks = toxic_data(300, 5)
    texts += [t for t in near_texts(22)]
    item = " ".join(f"b{k}" for k in range(20))
    other = " ".join(f"c{k}" for k in range(20))
    texts += [f"intro {item} tail one", f"{item} and {other} too", 'key token = "0123456789abcdef0123456789abcdef" end', f"password: hunter2222 {' '.join(f'k{k}' for k in range(30))}"]
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, "en", f"s{rnd.randrange(3)}", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, other)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, (item, other)


def test_stages_against_plain_versions(spark, folder):
    at, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontaminate", "secrets", "bpe"]

    kept = pipeline.hold(stages["toxicity"](spark, docs, at), "t")
    scores = toxicity.score(docs, toxicity.fitted(spark, docs, at), ["doc_id"]).collect()
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in scores if r["score"] < 0.5}
    assert kept.columns == docs.columns and 0 < docs.count() - kept.count() < 120

    own = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    groups = brute_components([t for _, t in own], [d for d, _ in own])
    want = {d for (d, _), (n, c) in zip(own, groups, strict=True) if not n or c == d}
    unique = pipeline.hold(stages["near_duplicates"](spark, kept, at), "n")
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(want) and unique.columns == docs.columns

    own = {r["doc_id"]: r["text"] for r in unique.collect()}
    hits = dict(zip(own, brute_hits(list(own.values()), enumerate(items)), strict=True))
    clean = pipeline.hold(stages["decontaminate"](spark, unique, at), "d")
    got = {r["doc_id"]: r for r in clean.collect()}
    assert set(got) == {d for d, (_, _, ids) in hits.items() if len(ids) < 2}
    for d, r in got.items():
        if not hits[d][2]:
            assert r["text"] == own[d]
        else:
            assert len(ALNUM.findall(r["text"].translate(LOW))) == hits[d][0] - hits[d][1] and r["n_chars"] == len(r["text"])
    assert any(h[2] for d, h in hits.items() if d in got)

    safe = pipeline.hold(stages["secrets"](spark, clean, at), "s")
    for r in safe.collect():
        before = got[r["doc_id"]]["text"]
        assert brute_base(r["text"]) == ""
        if not brute_base(before):
            assert r["text"] == before
    assert safe.count() == clean.count() and safe.filter("text like '%[SECRET]%'").count() == 2

    last = {r["doc_id"]: r for r in stages["bpe"](spark, safe, at).collect()}
    for r in safe.collect():
        assert last[r["doc_id"]]["text"] == (r["text"] or "") and last[r["doc_id"]]["n_tokens"] == len(last[r["doc_id"]]["ids"])
    assert {r["doc_id"] for r in pipeline.run(spark, at).select("doc_id").collect()} == set(last)


def test_stages_take_empty_and_odd_tables(spark, folder):
    at, _ = folder
    for docs in (spark.createDataFrame([], COLUMNS), spark.createDataFrame([(None, None, None, None, None), (1, "", "x", "y", 0), (1, "", "x", "y", 0), (None, "a b", None, None, 3)], COLUMNS)):
        n = docs.count()
        for _, stage in pipeline.STAGES:
            docs = pipeline.hold(stage(spark, docs, at), "e")
        assert docs.count() == n


def test_stages_take_odd_columns(spark, folder):
    df = odd_docs(spark).withColumn("n_tokens", F.lit(3)).withColumn("ids", F.lit("own"))
    docs = df
    for name, stage in pipeline.STAGES:
        docs = pipeline.hold(stage(spark, docs, folder[0]), "o")
        if name != "bpe":
            assert docs.columns == df.columns
    assert docs.columns[-3:] == ["ids", "n_tokens", "text"] and "ids_input" in docs.columns and "a.b" in docs.columns
    assert docs.count() == 6  # of nine rows, two are copies and one is a near copy


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(queries.ORACLES[name])
    names = sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted([tuple(r[c] for c in names) for r in got.collect()], key=repr) == sorted([tuple(r[k] for k in at) for r in want.fetchall()], key=repr)


def test_all_ten_are_registered(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert docs_of(spark, ["x"]).count() == 1
