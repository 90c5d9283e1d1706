"""Each stage on its own input against a plain version, and the whole run."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_near import plain_classes
from test_repeats import plain
from test_secrets import base_spans
from tokenizers import Tokenizer

import corpus_pipeline as P
from statloom.llm.queries import fit_toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_stages_keep_the_columns(spark, documents):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0)], documents.schema)
    for name, stage in P.STAGES[1:-1]:
        for docs in (documents.limit(5), odd, documents.limit(0)):
            out = stage(spark, docs, FOLDER)
            assert out.columns == documents.columns and [f.dataType for f in out.schema] == [f.dataType for f in documents.schema], name
            assert out.count() <= docs.count()


def test_toxic_documents_go(spark, documents):
    scores = fit_toxicity(spark, FOLDER, documents).transform(documents)
    expected = {r["doc_id"] for r in scores.where("score < 0.5").collect()}
    assert {r["doc_id"] for r in P.drop_toxic(spark, documents, FOLDER).collect()} == expected


def test_one_of_each_class_stays(spark, documents):
    rows = documents.collect()
    least = {}
    for r, c in zip(rows, plain_classes([r["text"] for r in rows])):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert sorted(map(tuple, P.drop_near_duplicates(spark, documents, FOLDER).collect())) == sorted(tuple(r) for r in rows if r["doc_id"] in set(least.values()))


def test_repeated_passages_go(spark, documents):
    rows = documents.collect()
    found = {r["doc_id"]: r for r in P.remove_repeated_passages(spark, documents, FOLDER).collect()}
    for r, (kept, _) in zip(rows, plain([r["text"] for r in rows], P.PASSAGE)):
        assert found[r["doc_id"]]["text"] == kept.decode("utf-8", "ignore") and found[r["doc_id"]]["n_chars"] == len(found[r["doc_id"]]["text"])


def test_secrets_go(spark, documents):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in documents.collect() if base_spans(r["text"])]
    found = {r["doc_id"]: r["text"] for r in P.redact_secrets(spark, documents, FOLDER).collect()}
    assert held and all("[secret]" in found[r["doc_id"]] and not base_spans(found[r["doc_id"]].replace("[secret]", "\n")) for r in held)


def test_run(spark, documents):
    rows = P.run(spark, FOLDER).orderBy("doc_id", "start").collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).extend(memoryview(bytes(r["ids"])).cast("I").tolist())
    docs = documents
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), documents.schema)
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert pieces == {r["doc_id"]: encode.encode(r["text"], add_special_tokens=False).ids + [0] for r in docs.collect()}
