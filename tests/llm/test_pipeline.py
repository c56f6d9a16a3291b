"""The pipeline's stages by brute force over their own inputs, and the registration of the queries."""

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from edgeloom.llm import queries, sql
from tests.llm.conftest import untouched
from tests.llm.test_mixing import plain_targets, size
from tests.llm.test_nearcopies import plain_kept


def test_stages_are_the_five():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]


def test_run(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        docs = docs.cache()
        seen[name] = (before, docs)
        if name != "token_output":
            assert docs.columns == before.columns
    a, b = seen["near_duplicates"]
    assert sorted((r.doc_id for r in b.collect()), key=str) == plain_kept(sorted((r.doc_id, r.text) for r in a.collect())), "five words, four fifths"
    a, b = seen["mixing"]
    sizes, taken = {}, {}
    for r in a.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in b.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for s, t in plain_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= 0.05 * t + 5
    a, b = seen["token_output"]
    assert b.count() == a.count() and b.agg(F.sum("n_tokens")).first()[0] == b.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
    a, b = seen["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    gone = a.join(b, "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() <= 0.1 * labels.count()


def test_stages_take_awkward_rows(spark, docs, tmp_path):
    spark.createDataFrame([(1, "some words that nobody writes")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            if name != "token_output":
                untouched(now, given) if given is docs else None
        assert now.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_registered():
    known, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in known)] == [] and "pipeline" in known
    assert set(queries.QUERIES) <= set(known) and set(sql.ORACLES) <= set(oracles) <= set(known)


def test_one_whole_item_is_caught(spark, tmp_path):
    item = "what is the name of the river that runs through the old town"
    spark.createDataFrame([(1, item), (2, "an item that no document holds in whole or in part")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, f"Before it. {item.capitalize()}? After it."), (2, "Nothing of the kind, only the old town and its river.")], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["decontamination"]
    assert [r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()] == [2]
