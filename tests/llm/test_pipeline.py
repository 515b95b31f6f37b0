import re

import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, quality
from tests.llm.test_near import survivors

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_run_is_what_plain_python_makes_of_it(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = quality.fit(docs, labels)
    stats = docs.select("doc_id", "text", "source", *(c.alias(k) for k, c in quality.statistics(F.col("text")).items())).toPandas().sort_values("doc_id")
    stats = stats[model.score(stats[list(quality.NAMES)].to_numpy(float)) >= 0.3]
    seen, rows = set(), []
    for r in stats.itertuples():
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        if plain not in seen:
            seen.add(plain)
            rows.append(r)
    left, _ = survivors([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if r.doc_id in set(left)]
    kept = spark.createDataFrame([(int(r.doc_id), r.text, r.source) for r in rows], "doc_id long, text string, source string")
    copies = {r.doc_id: r["_copies"] for r in mixing.mix_counts(kept).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((int(r.doc_id), library.encode(r.text)) for r in rows for _ in range(copies[r.doc_id]))
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids) for r in out) == want
    assert all(r.round_trip for r in out)


@pytest.mark.parametrize("k", range(5))
def test_stages_with_odd_and_empty_tables(spark, odd, nothing, k):
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd, SF)
    if k < 4:
        assert out.columns == odd.columns
    assert out.count() <= (3 if k == 3 else 1) * odd.count()
    assert stage(spark, nothing, SF).count() == 0
