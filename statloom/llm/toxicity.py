"""Toxicity by boosted trees over dense features, with isotonic calibration.

Features of a text: how dense learned words and word beginnings are, how near
they stand to a second-person pronoun, capitals, punctuation, and signs of
obfuscation. The lexicon is learned from labelled texts: words, and beginnings
of words, that toxic texts hold far more often than others, by the lower end of
a confidence interval of their share. Boosted trees are fitted on most of the
labelled rows and calibrated by isotonic regression on the rest.

Fitting uses at most `MAX_LABELLED` labelled rows, those of least hash of their
id; this is the documented bound of the sample, and all that the driver, the
broadcast of ids and the trees depend on. Scoring reads every whole text where
it lies and shuffles nothing.

Defined results: NULL and empty texts have features of zero and get a score like
any other. A document with several labels is toxic if one of them says so;
labels that are NULL, or whose id no document has, are not used. Repeated rows
are scored alike. Without both classes among the labelled rows every score is
the share of toxic ones (0 when there are none). Extra columns are kept, and
taken result names are refused.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import cut_lineage, fresh, long_texts, quoted

#: Labelled rows that a fit uses at most.
MAX_LABELLED = 20_000
#: Toxic texts that must hold an entry of the lexicon: so many, and this share of them; most entries.
LEAST_SHARE = 0.006
LEAST_TEXTS, MAX_ENTRIES = 3, 2_000
#: Share of toxic texts among those with an entry that is believed at least, as a multiple of the overall share.
LEAST_LIFT = 3.0
BEGINNINGS = (4, 5, 6)
TREES, DEPTH = 20, 4

#: Second-person pronouns of four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros vuestro tus".split()
)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
MASKED = re.compile(r"[^\W\d_][0-9@$*#!+]+[^\W\d_]")
STRETCHED = re.compile(r"(\w)\1\1")
SHOUTED = re.compile(r"\b[^\W\d_a-z]{3,}\b")

FEATURES = (
    "words", "lexicon_density", "lexicon_count", "lexicon_kinds", "beginning_density", "beginning_count", "weight_sum", "second_person",
    "nearness", "capitals", "shouted", "exclamations", "questions", "punctuation", "masked", "stretched", "other_signs",
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def text_features(text: str, lexicon: dict[str, float], beginnings: dict[str, float], firsts: frozenset[str]) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    words = words_of(text)
    n, size = max(1, len(words)), len(text)
    hits = [(i, w) for i, w in enumerate(words) if w in lexicon]
    likely = [(i, w) for i, w in enumerate(words) if w[:4] in firsts]
    begun = [(i, p) for i, w in likely for p in (w[:6], w[:5], w[:4]) if p != w and p in beginnings]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits or begun else []
    near = 0.0
    if you:
        where = np.array(you)
        for i, _ in hits + begun:
            k = int(np.searchsorted(where, i))
            near += math.exp(-min(abs(int(where[j]) - i) for j in (k - 1, k) if 0 <= j < len(where)) / 5)
    counts = Counter(text)
    upper = sum(c for x, c in counts.items() if x.isupper())
    letters = max(1, sum(c for x, c in counts.items() if x.isalpha()))
    marks = sum(c for x, c in counts.items() if not x.isalnum() and not x.isspace())
    usual = sum(counts[x] for x in ".,;:!?'\"()-")
    kinds = len({w for _, w in hits} | {p for _, p in begun})
    weight = sum(lexicon[w] for _, w in hits) + sum(beginnings[p] for _, p in begun)
    return [
        math.log1p(len(words)), len(hits) / n, math.log1p(len(hits)), float(kinds), len(begun) / n, math.log1p(len(begun)), weight,
        sum(w in SECOND_PERSON for w in words) / n, near, upper / letters, len(SHOUTED.findall(text)) / n, counts["!"] / size, counts["?"] / size,
        marks / size, len(MASKED.findall(text)) / n, len(STRETCHED.findall(text)) / n, (marks - usual) / size,
    ]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    beginnings: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def transform(self, df: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
        """Add the score of each text."""
        if score.lower() in {c.lower() for c in df.columns}:
            raise ValueError(f"column {score!r} is there already; choose another result name")
        if self.trees is None:
            return df.withColumn(score, F.lit(float(self.share)))
        features, vector, raw, odds, guess, smooth = fresh(df, "_features", "_vector", "_raw", "_odds", "_guess", "_smooth")
        rows = with_features(df, self.lexicon, self.beginnings, text, features)
        rows = rows.withColumn(vector, array_to_vector(features))
        trees = self.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(odds).setPredictionCol(guess)
        rows = trees.transform(rows).withColumn(odds, vector_to_array(odds)[1])
        rows = self.calibration.copy().setFeaturesCol(odds).setPredictionCol(smooth).transform(rows)
        return rows.select(*[F.col(quoted(c)) for c in df.columns], F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(smooth))).alias(score))


def with_features(df: DataFrame, lexicon: dict[str, float], beginnings: dict[str, float], text: str, name: str) -> DataFrame:
    place = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType(), False), False)])

    firsts = frozenset(b[:4] for b in beginnings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(x.as_py() or "", lexicon, beginnings, firsts) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return long_texts(df).mapInArrow(run, schema)


def labelled_sample(labels: DataFrame, limit: int, id_col: str, target: str) -> DataFrame:
    """At most `limit` ids with their label, those of least hash."""
    known = labels.where(F.col(quoted(id_col)).isNotNull() & F.col(quoted(target)).isNotNull())
    each = known.groupBy(F.col(quoted(id_col)).alias("id")).agg(F.max(F.col(quoted(target)).cast("int")).alias("toxic"))
    return each.orderBy(F.xxhash64("id"), "id").limit(limit)


def learn_lexicon(rows: DataFrame, text: str, share: float) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings that toxic texts hold far more often, with the logarithm of how much more."""
    place, target = rows.columns.index(text), rows.columns.index("toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, every = Counter(), Counter()
        for batch in batches:
            for x, y in zip(batch.column(place).to_pylist(), batch.column(target).to_pylist()):
                words = set(words_of(x or ""))
                entries = words | {f"{w[:k]}*" for w in words for k in BEGINNINGS if len(w) > k}
                every.update(entries)
                if y:
                    toxic.update(entries)
            if len(every) > 500_000:
                yield _counted(every, toxic)
                every.clear()
                toxic.clear()
        yield _counted(every, toxic)

    counted = long_texts(rows).mapInArrow(run, "entry string, n_all long, n_toxic long")
    each = counted.groupBy("entry").agg(F.sum("n_all").alias("n"), F.sum("n_toxic").alias("t"))
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * rows.where("toxic = 1").count()))
    each = each.where(F.col("t") >= least)
    # The lower end of Wilson's interval of the share of toxic texts among those with the entry.
    p, n, z = F.col("t") / F.col("n"), F.col("n"), 2.0
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    best = each.withColumn("low", low).where(F.col("low") > min(0.5, LEAST_LIFT * share)).orderBy(F.desc(F.col("low") * F.log1p("t")), "entry")
    words, beginnings = {}, {}
    for entry, low_share in best.select("entry", "low").limit(2 * MAX_ENTRIES).collect():
        weight = math.log(low_share / share)
        if entry.endswith("*"):
            beginnings[entry[:-1]] = weight
        else:
            words[entry] = weight
    return words, beginnings


def _counted(every: Counter, toxic: Counter) -> pa.RecordBatch:
    keys = list(every)
    columns = [pa.array(keys, pa.string()), pa.array([every[k] for k in keys], pa.int64()), pa.array([toxic.get(k, 0) for k in keys], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["entry", "n_all", "n_toxic"])


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", target: str = "toxic", limit: int = MAX_LABELLED) -> ToxicityModel:
    """Learn from the labels given; pass only those that may be learned from."""
    sample = labelled_sample(labels, limit, id_col, target)
    texts = documents.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).alias("text")).where(F.col("id").isNotNull())
    # The sample holds at most `limit` ids, so it may be sent to every executor. Texts repeated under one id count once.
    rows = cut_lineage(texts.join(F.broadcast(sample), "id").dropDuplicates(["id"]))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") != 0).cast("long")), F.lit(0))).first()
    share = toxic / n if n else 0.0
    if not 0 < toxic < n:
        return ToxicityModel({}, {}, None, None, share)
    # Three parts of six for the lexicon, two for the trees, one for the calibration.
    rows = rows.withColumn("toxic", (F.col("toxic") != 0).cast("int")).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(6)))
    lexicon, beginnings = learn_lexicon(rows.where("part < 3").select("text", "toxic"), "text", share)
    made = with_features(rows.where("part >= 3"), lexicon, beginnings, "text", "f")
    vectors = cut_lineage(made.select(F.col("toxic").cast("double").alias("label"), array_to_vector("f").alias("features"), "part"))
    learned = vectors.where("part < 5")
    if learned.agg(F.count_distinct("label")).first()[0] < 2:
        return ToxicityModel({}, {}, None, None, share)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(learned.coalesce(2))
    held = trees.transform(vectors.where("part = 5")).select("label", vector_to_array("probability")[1].alias("features"))
    if held.agg(F.count_distinct("label")).first()[0] < 2:
        held = trees.transform(vectors).select("label", vector_to_array("probability")[1].alias("features"))
    calibration = IsotonicRegression(featuresCol="features", labelCol="label").fit(held)
    return ToxicityModel(lexicon, beginnings, trees, calibration, share)
