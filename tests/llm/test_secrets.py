"""Base spans against Python's patterns, the battery against what it is for."""

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from statloom.llm import secrets as S
from statloom.llm.queries import op7_secrets

FOLDER = "/root/testdata/sf0.001"
BASE = [
    ("assign", re.compile(S.ASSIGN, re.ASCII), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base_spans(text):
    found = [(m.start(), i, m.end(), kind) for i, (kind, p, ok) in enumerate(BASE) for m in p.finditer(text or "") if ok(m)]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


BITS = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abcdefgh12", "x", "==", "é", "😀", "\n"]
BITS += ["AKIA", "AKIA" + "Q" * 12, "0123456789abcdef" * 2, "a" * 33, "AKIAAKIA12345678", "token=secret:abcdefgh12", "F" * 40]
BITS += ["-----------1-----------", " 1=================== "]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    made = ["".join(draw.choices(BITS, k=draw.randint(1, 12))) for _ in range(800)]
    return [None, "", "plain words only", *made, *made[:5], "z" * 200_000, "word " * 40_000 + "password=hunter2hunter2"]


def test_base_spans(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "k int, text string").withColumn("_base", F.lit(1))
    out = {r["k"]: [tuple(s) for s in r["spans"]] for r in S.find_secrets(df).collect()}
    for k, text in enumerate(rows):
        assert [s for s in out[k] if s[0] != "random"] == base_spans(text), repr(text)[:200]


def test_random_tokens_are_told_from_text(spark):
    draw = random.Random(5)
    noise = [base64.b64encode(draw.randbytes(30)).decode() for _ in range(60)]
    plain = ["Internationalisation" * 2, "someLongCamelCaseIdentifier", "2024" * 8, "aaaaaaaaaaaaaaaa1aaaaaaaaaaaaaaa", "https/www/example/path/of/words2", "abc1" * 10]
    df = spark.createDataFrame([(t, f"a key {t} here") for t in noise + plain], "t string, text string")
    found = {r["t"]: [tuple(s) for s in r["spans"] if s["kind"] == "random"] for r in S.find_secrets(df).collect()}
    assert sum(found[t] == [("random", 6, 6 + len(t))] for t in noise) >= 55
    assert not any(found[t] for t in plain)


def test_random_tokens_of_each_encoding(spark):
    draw = random.Random(9)
    kinds = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base 32": S.CAPITALS + "234567", "base 62": S.DIGITS + S.CAPITALS + S.SMALL}
    # A small letter, then a capital, or a digit stands in each, so that all are tokens.
    made = {(k, n): [t for t in ("".join(draw.choices(a, k=n)) for _ in range(300)) if re.fullmatch(S.TOKEN, t)][:200] for k, a in kinds.items() for n in (20, 24, 31)}
    made["base 64", 24] = [base64.b64encode(draw.randbytes(16)).decode() for _ in range(200)]
    rows = [(k, n, t) for (k, n), ts in made.items() for t in ts] + [(k, n, " ".join(ts[i : i + 20])) for (k, n), ts in made.items() for i in range(0, len(ts), 20)]
    df = spark.createDataFrame(rows, "k string, n int, text string").repartition(4)
    found = {}
    for r in S.find_secrets(df).collect():
        found.setdefault((r["k"], r["n"], len(r["text"]) > r["n"]), []).append(len(r["spans"]))
    for (k, n, many), sizes in found.items():
        assert sum(sizes) >= 0.9 * (20 if many else 1) * len(sizes), (k, n, many, sum(sizes))


def test_identifiers_are_text(spark):
    plain = "createDataFrameFromPandas getOrCreateSparkSession20 some_long_snake_case_name2 MAXIMUM_RETRY_COUNT_2 AbstractHttpConnectionPool org/apache/spark/Sql4 "
    plain += "20240131235959123456 2024-01-31-23-59-59-000 my-long-blog-post-about-2024 numberOfPartitionsPerTask defaultMinimumValueAllowed 12345678901234567890"
    df = spark.createDataFrame([(t,) for t in [plain, *plain.split()]], "text string")
    assert not [r["text"] for r in S.find_secrets(df).collect() if r["spans"]]


def test_tokens_of_few_letters(spark):
    rows = ["-----------1-----------", "1===================", "a 1=================== b", "=" * 30, "=" * 19 + "1", "-" * 20 + "1", "_" * 25 + "aB", "1" + "+" * 20, "ab1" + "=" * 20]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, text string")
    assert [r["spans"] for r in S.find_secrets(df).collect()] == [[]] * len(rows)


def test_redaction(spark):
    rows = [(None,), ("",), ("clean",), ("a password=abcdefgh12 b",), ("x token='" + "0123456789abcdef" * 2 + "' é",)]
    df = S.redact(S.find_secrets(spark.createDataFrame(rows, "text string")))
    assert [r["text"] for r in df.collect()] == [None, "", "clean", "a [secret] b", "x [secret]' é"]


def test_many_spans_in_one_text(spark):
    draw = random.Random(9)
    pieces = []
    for _ in range(3000):
        pieces.append(draw.choice(["".join(draw.choices("0123456789abcdef", k=32)), "token: " + "".join(draw.choices("abcXYZ019", k=12)), "AKIA" + "A1B2" * 4, "plain wörds \U0001f600"]))
    text = draw.choice([" ", "\n"]).join(pieces)
    found = S.find_secrets(spark.createDataFrame([(text,)], "text string"))
    spans = [(s["kind"], s["start"], s["end"]) for s in found.first()["spans"]]
    base = [s for s in spans if s[0] != "random"]
    assert base == base_spans(text) and len(base) > 1500
    masked, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            masked += [text[at:start], "[secret]"]
        at = max(at, end)
    assert S.redact(found).first()["text"] == "".join([*masked, text[at:]])
    for kind, start, end in spans:
        assert kind != "random" or not any(a < end and start < b for _, a, b in base)


def test_empty_table_and_taken_name(spark):
    df = spark.createDataFrame([], "text string")
    assert S.find_secrets(df).count() == 0
    with pytest.raises(ValueError):
        S.find_secrets(df.withColumn("Spans", F.lit(1)))


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    frame = op7_secrets(spark, FOLDER)
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    seen = frame.collect()
    assert sorted(r["doc_id"] for r in seen) == sorted(texts)
    for r in seen:
        spans = base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in S.KINDS[:3]] == [sum(s[0] == k for s in spans) for k in S.KINDS[:3]]
        assert r["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == ["%s:%d:%d" % s for s in spans]
