import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspark.llm import langid, queries
from cohortspark.llm.common import fold_of

from helpers import SF, awkward, brute_components, brute_contaminated

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
        after = stage(spark, docs, SF).cache()
        ids = {r[0] for r in after.select("doc_id").collect()}
        if name == "language_id":
            told = langid.predict(docs, langid.fit(docs.where(fold_of(F.col("doc_id")) != 0)), ("doc_id",)).collect()
            assert ids == {r["doc_id"] for r in told if r["lang_pred"] != "und" and r["score"] >= langid.LEAST} == {d for d, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "near_dedup":
            assert ids == {d for d, (_, c) in brute_components(before.items()).items() if d == c}
        elif name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet")
            bad = {d for d, _ in brute_contaminated(before.items(), items.select("item_id", "text").collect())}
            assert ids == set(before) - bad and bad
        else:
            assert ids == set(before)
        assert after.columns == columns if name != "source_mixing" else after.columns[: len(columns)] == columns
        docs = after
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def test_language_stage_rejects_what_no_profile_fits(spark):
    """Random letters, other scripts and languages that the labels don't teach go; documents of the tables stay."""
    import random

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = random.Random(3)
    junk = ["".join(noise.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (100, 900, 5000)]
    junk += ["Привет, как дела сегодня, мы пойдем гулять", "漢字漢字漢字", "12 34 !!", "Łódź żaneta jest w domu i nie ma go tu wcale" * 5, "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo" * 30]
    rows = docs.unionByName(spark.createDataFrame([(10**6 + i, t, None, "src1", len(t)) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars int"), allowMissingColumns=True)
    kept = {r[0] for r in corpus_pipeline.language_id(spark, rows, SF).select("doc_id").collect()}
    assert not kept & set(range(10**6, 10**6 + len(junk)))
    assert kept == {r[0] for r in docs.where(F.col("text").rlike("[A-Za-zÀ-ÿ]")).select("doc_id").collect()}


def test_stages_on_awkward_rows(spark):
    for rows in (awkward(spark, "id part mix_slot kept spans"), awkward(spark, "id").limit(0)):
        profiles = langid.fit(rows.where(fold_of(F.col("doc_id")) != 0))
        told = sum(r["lang_pred"] != "und" and r["score"] >= langid.LEAST for r in langid.predict(rows, profiles, ("doc_id",)).collect())
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).cache()
        assert docs.count() == told
        assert set(rows.columns) <= set(docs.columns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    found = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_all_thirteen_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries.queries()}
    assert numbers == set(range(1, 14)) and F is not None
