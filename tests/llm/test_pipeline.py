"""The pipeline and the queries of the subpackage on the smallest tables."""

import collections
import os
import random

import pytest
from compare import differences, duck
from pyspark.sql import functions as F

import corpus_pipeline
from prismill.llm.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        assert differences(df, duck(DATA), SQL[name], need_rows=True) == []
    else:
        table, key = ("embeddings", "vec_id") if name.startswith("op10") else ("documents", "doc_id")
        found, rows = df.select(key).distinct().count(), spark.read.parquet(f"{DATA}/{table}.parquet").count()
        # Only the search for passages leaves documents out: those without any.
        assert 0 < found < rows if name.startswith("op7") else found == rows


def through_stages(spark, docs, sf_dir, tmp_path):
    """The frame before the first stage and after each, written and read as the pipeline does."""
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == docs.columns
    return seen


def test_stages_keep_the_columns_and_their_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [df.count() for df in through_stages(spark, docs, DATA, tmp_path)[:-1]]
    before, toxic, lines, near, mixed = counts
    assert before >= toxic == lines >= near > 0 and mixed > 0


def test_stages_take_effect_on_planted_documents(spark, tmp_path):
    draw = random.Random(6)
    letters = [c + v for c in "bdfgklmnprst" for v in "aeiou"]
    word = lambda: "".join(draw.choices(letters, k=draw.randrange(2, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rude = lambda n: " ".join(draw.choice(["grumbolt", "snarkwad", word()]) for _ in range(n))
    shared, near = "this very line stands in many documents", prose(200)
    rows = [(k, prose(120), "en", f"s{k % 3}") for k in range(200)]
    rows += [(200 + k, rude(60), "en", "s0") for k in range(60)]
    rows += [(300 + k, prose(80) + "\n" + shared + "\n" + prose(20), "en", "s1") for k in range(5)]
    rows += [(400 + k, near + " " + word(), "en", "s2") for k in range(5)]
    rows += [(500, None, None, None), (501, "", "en", None), (None, prose(30), "en", "s0"), (502, "twice the same row here", "en", "s1"), (502, "twice the same row here", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    spark.createDataFrame([(k, 1, int(200 <= k < 260)) for k in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = through_stages(spark, docs, str(tmp_path), tmp_path)
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    planted = set(range(200, 260))
    assert not ids[1] & planted and ids[1] == ids[0] - planted
    texts = {r.doc_id: r.text for r in seen[2].collect()}
    assert [k for k in range(300, 305) if shared in texts[k]] == [300] and ids[2] == ids[1]
    assert ids[3] == ids[2] - {401, 402, 403, 404}
    size = lambda df: df.select(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " |\n"), lambda w: w != "")))).first()[0]
    assert abs(size(seen[4]) / size(seen[3]) - 1) < 0.02
    pieces = seen[5].collect()
    filled = collections.Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert {r.doc_id for r in pieces} == ids[4] and all(n <= 4096 and n & (n - 1) == 0 for n in filled.values())


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert [df.count() for df in through_stages(spark, docs, DATA, tmp_path)] == [0] * 6
