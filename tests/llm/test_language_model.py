"""Scores against SQL, and against counting word by word."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from statloom.llm import language_model as M
from statloom.llm.queries import OP2_SQL, OP2_TRIGRAMS_SQL, QUERIES, op2_stupid_backoff

FOLDER = "/root/testdata/sf0.001"


def micro(x):
    return int(math.floor(math.log(x) * 1e6 + 0.5))


def plain(texts, order, least=2):
    docs = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    counts = Counter(tuple(d[i : i + n]) for d in docs for n in range(1, order + 1) for i in range(len(d) - n + 1))
    total = sum(map(len, docs))
    out = []
    for d in docs:
        score = found = 0
        for i in range(len(d)):
            value = micro(counts[(d[i],)]) - micro(total)
            for n in range(2, min(order, i + 1) + 1):
                gram = tuple(d[i - n + 1 : i + 1])
                if counts[gram] >= least:
                    value = micro(counts[gram]) - micro(counts[gram[:-1]])
                    found += 1
                else:
                    value += micro(0.4)
            score += value
        out.append((len(d), found, score))
    return out


@pytest.mark.parametrize(("order", "hot"), [(1, 20_000), (2, 20_000), (2, 3), (3, 5)])
def test_scores(spark, monkeypatch, order, hot):
    monkeypatch.setattr(M, "HOT", hot)
    draw = random.Random(1)
    texts = [" ".join(draw.choices(["the", "of", *(f"w{i}" for i in range(60))], [30, 20, *[1] * 60], k=draw.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "...", "The the THE", texts[0], texts[1]]
    ids = list(range(len(texts))) + [0, None]
    texts += [texts[0], "one two"]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id int, text string").withColumn("n", F.lit(1)).repartition(3)
    found = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_found"], r["score_micro"]) for r in M.score(df, order=order).collect()))
    expected = sorted((i if i is not None else -1, *x) for i, x in zip(ids, plain(texts, order)))
    assert found == expected


def test_empty_table(spark):
    assert M.score(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_query(spark):
    found = op2_stupid_backoff(spark, FOLDER).toPandas()
    assert difference(found, connect(FOLDER).execute(OP2_SQL).df()) is None


def test_query_of_trigrams(spark):
    found = QUERIES["op2_stupid_backoff_trigrams"](spark, FOLDER).toPandas()
    assert difference(found, connect(FOLDER).execute(OP2_TRIGRAMS_SQL).df()) is None
    assert found["n_found"].sum() > op2_stupid_backoff(spark, FOLDER).agg(F.sum("n_found")).first()[0]
    # The SQL itself against counting word by word.
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((r["doc_id"], *x) for r, x in zip(rows, plain([r["text"] for r in rows], 3)))
    assert sorted(zip(found["doc_id"], found["n_words"], found["n_found"], found["score_micro"])) == expected


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_many_slices_and_parts(spark, monkeypatch, order):
    monkeypatch.setattr(M, "SLICE", 300)
    draw = random.Random(2)
    texts = [" ".join(draw.choices(["the", "of", *(f"w{i}" for i in range(40))], [30, 20, *[1] * 40], k=draw.randint(0, 50))) for _ in range(60)]
    texts += [None, "", None, "...", "Ünïcode ÜNÏCODE one", texts[0], texts[1], "the of " * 300]
    ids = [*range(len(texts) - 2), None, None]
    rows = [*zip(ids, texts), (ids[0], texts[0]), (ids[3], texts[3])]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    found = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_found"], r["score_micro"]) for r in M.score(df, order=order).collect()))
    expected = sorted((i if i is not None else -1, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], order)))
    assert found == expected


def test_ids_of_any_name(spark):
    rows = [(1, "a", "x y x y"), (1, "b", "x y z"), (2, None, None)]
    df = spark.createDataFrame(rows, "slice int, n_words string, id_0 string")
    found = M.score(df.select("slice", F.col("n_words").alias("Text"), F.col("id_0").alias("words")), "words", ("slice", "Text"))
    assert found.columns == ["slice", "Text", "n_words", "n_found", "score_micro", "mean_score"]
    expected = [(i, j, *x) for (i, j, _), x in zip(rows, plain([t for _, _, t in rows], 2))]
    assert sorted(tuple(r)[:5] for r in found.collect()) == expected


def test_shuffle_is_in_proportion(spark):
    """Rare n-grams, the most there can be, take a few bytes of shuffle each: less than four times the texts in all."""
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(1000)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def written():
        return {path: path.stat().st_size for folder in disk.localDirs() for path in Path(folder.toString()).rglob("shuffle_*.data")}

    before = written()
    M.score(df).write.format("noop").mode("overwrite").save()
    size = sum(length for path, length in written().items() if path not in before)
    assert 0 < size < 4 * sum(map(len, texts))
