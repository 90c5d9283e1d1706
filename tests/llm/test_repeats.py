"""Removal of repeated strings against all windows of all texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import repeats as R
from statloom.llm.queries import op1_suffix_dedup

FOLDER = "/root/testdata/sf0.001"


def plain(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans, at = [], None
        for i, g in enumerate(gone + [False]):
            if g and at is None:
                at = i
            elif not g and at is not None:
                spans.append((at, i))
                at = None
        out.append((bytes(b for b, g in zip(r, gone) if not g), spans))
    return out


def texts():
    draw = random.Random(9)
    passages = ["".join(draw.choices("abcdé ", k=draw.randint(10, 90))) for _ in range(6)]
    made = []
    for _ in range(150):
        parts = [draw.choice(passages) if draw.random() < 0.4 else "".join(draw.choices("abcdefgh", k=draw.randint(1, 60))) for _ in range(draw.randint(0, 6))]
        made.append("".join(parts))
    return [None, "", "a" * 300, "ab" * 100, "short", *made, *made[:10], *[m + "x" for m in made[10:20]]]


@pytest.mark.parametrize("window", [2, 20, 33])
def test_against_all_windows(spark, window):
    rows = texts()
    df = spark.createDataFrame([(i % 7, i, t) for i, t in enumerate(rows)], "doc_id int, rid int, text string").withColumn("count", F.lit(1))
    found = {r["rid"]: r for r in R.remove_repeats(df, window=window).collect()}
    assert len(found) == len(rows)
    for i, (kept, spans) in enumerate(plain(rows, window)):
        assert bytes(found[i]["kept"]) == kept and [tuple(s) for s in found[i]["spans"]] == spans, rows[i]


def test_rows_repeated_whole_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 50)
    rows = [(1, "x" * 10 + "abcdefghij" * 3), (1, "x" * 10 + "abcdefghij" * 3), (None, "0123456789" * 20)]
    out = R.remove_repeats(spark.createDataFrame(rows, "doc_id int, text string"), window=25).collect()
    assert sorted(len(r["kept"]) for r in out) == [0, 0, 0]
    for window in (7, 20):
        raw = "".join(random.Random(1).choices("ab", k=400)).encode()
        data, starts = np.frombuffer(raw, np.uint8), np.array([0, 130, 130, 135, 400])
        row, begin, count, _, _ = R.runs(data, starts, window, window // 2)
        covered = {(r, b + i) for r, b, c in zip(row.tolist(), begin.tolist(), count.tolist()) for i in range(c)}
        assert covered == {(r, i) for r in range(4) for i in range(int(np.diff(starts)[r]) - window + 1)} and count.sum() == len(covered)


def test_empty_table_and_taken_name(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert R.remove_repeats(df).count() == 0
    with pytest.raises(ValueError):
        R.remove_repeats(df.withColumn("SPANS", F.lit(1)))


def test_query(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    found = {r["doc_id"]: r for r in op1_suffix_dedup(spark, FOLDER).collect()}
    assert len(found) == len(documents)
    for d, (kept, spans) in zip(documents, plain([d["text"] for d in documents], 400)):
        r = found[d["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len((d["text"] or "").encode()), sum(b - a for a, b in spans), len(spans))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("shorter,window", [(2, 3), (7, 30), (20, 33)])
def test_shorter_passages_beside_the_window(spark, monkeypatch, shorter, window):
    monkeypatch.setattr(R, "SHEET", 300)
    monkeypatch.setattr(R, "PART", 1000)
    rows = texts()
    df = spark.createDataFrame([(i % 7, i, t) for i, t in enumerate([*rows, *rows[5:9]])], "doc_id int, rid int, text string")
    found = {r["rid"]: r for r in R.remove_repeats(df, window=window, shorter=shorter).collect()}
    rows = [*rows, *rows[5:9]]
    for i, ((kept, spans), (_, passages)) in enumerate(zip(plain(rows, window), plain(rows, shorter))):
        assert bytes(found[i]["kept"]) == kept and [tuple(s) for s in found[i]["spans"]] == spans, rows[i]
        assert [tuple(s) for s in found[i]["passages"]] == passages, rows[i]
    for wrong in (1, window):
        with pytest.raises(ValueError):
            R.remove_repeats(df, window=window, shorter=wrong)


def test_equal_rows_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(R, "SHEET", 100)
    draw = random.Random(4)
    common = "".join(draw.choices("abcdefgh", k=60))
    made = ["".join(draw.choices("abcdefgh", k=40)) + common + "".join(draw.choices("abcdefgh", k=40)) for _ in range(40)]
    rows = [*made, *made[:1] * 30, None, ""]
    df = spark.createDataFrame([(1, t) for t in rows], "doc_id int, text string")
    found = R.remove_repeats(df, window=50, shorter=25).collect()
    expected = [(t, kept, spans, passages) for t, (kept, spans), (_, passages) in zip(rows, plain(rows, 50), plain(rows, 25))]
    got = [(r["text"], bytes(r["kept"]), [tuple(s) for s in r["spans"]], [tuple(s) for s in r["passages"]]) for r in found]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_query_counts_passages_shorter_than_its_window(spark, tmp_path):
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(3, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    assert 250 <= len(passage) < 400
    rows = [(i, text(80) + (f" {passage} " if i < 2 else " ") + text(80)) for i in range(6)]
    spark.createDataFrame([*rows, (6, None)], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in op1_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, (_, passages) in enumerate(plain([t for _, t in rows] + [None], 250)):
        r = found[i]
        assert (r["n_removed"], r["n_spans"]) == (0, 0)
        assert (r["n_passages"], r["n_passage_bytes"]) == (len(passages), sum(b - a for a, b in passages))
        assert r["n_passages"] == (1 if i < 2 else 0)
