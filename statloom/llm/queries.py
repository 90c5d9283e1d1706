"""The named queries of this subpackage, thin calls of its operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import bpe as bpe_codec
from statloom.llm import chat, html, language_model, near, negatives, packing, repeats, secrets, toxicity, vafile, vptree, whitening
from statloom.llm.common import load


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its bytes in strings of 400 bytes that occur more than once; shorter passages that do are counted."""
    found = repeats.remove_repeats(load(spark, folder, "documents").select("doc_id", "text"), shorter=repeats.PASSAGE)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
        F.size("passages").cast("long").alias("n_passages"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"]).alias("n_passage_bytes"),
    )


def op2_stupid_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document by the bigram model of all documents."""
    return language_model.score(load(spark, folder, "documents"))


OP2_SQL = """
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS ws
    FROM documents),
places AS (
    SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(list_concat([NULL], ws[:-2])) AS before FROM words WHERE len(ws) > 0),
one AS (SELECT w, count(*) AS c FROM places GROUP BY w),
two AS (SELECT before, w, count(*) AS c FROM places WHERE before IS NOT NULL GROUP BY before, w HAVING count(*) >= 2),
logs AS (SELECT w, CAST(round(ln(c) * 1e6) AS BIGINT) AS l FROM one),
whole AS (SELECT CAST(round(ln(count(*)) * 1e6) AS BIGINT) AS l FROM places),
scored AS (
    SELECT p.r, p.before IS NOT NULL AND two.c IS NOT NULL AS found,
        CASE WHEN two.c IS NOT NULL THEN CAST(round(ln(two.c) * 1e6) AS BIGINT) - b.l
            WHEN p.before IS NULL THEN a.l - whole.l
            ELSE CAST(round(ln(0.4) * 1e6) AS BIGINT) + a.l - whole.l END AS s
    FROM places p JOIN logs a ON p.w = a.w LEFT JOIN logs b ON p.before = b.w LEFT JOIN two ON two.before = p.before AND two.w = p.w, whole),
sums AS (SELECT r, count(*) AS n, sum(found::INT) AS f, sum(s) AS s FROM scored GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(f, 0) AS BIGINT) AS n_found,
    CAST(coalesce(s, 0) AS BIGINT) AS score_micro, CASE WHEN n > 0 THEN CAST(s AS BIGINT) / CAST(n AS BIGINT) / 1e6::DOUBLE END AS mean_score
FROM words LEFT JOIN sums USING (r)
"""


def op2_stupid_backoff_trigrams(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document by the trigram model of all documents."""
    return language_model.score(load(spark, folder, "documents"), order=3)


OP2_TRIGRAMS_SQL = """
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS ws
    FROM documents),
places AS (
    SELECT r, unnest(ws) AS w, unnest(list_concat([NULL], ws)[1:len(ws)]) AS b, unnest(list_concat([NULL, NULL], ws)[1:len(ws)]) AS a
    FROM words WHERE len(ws) > 0),
one AS (SELECT w, count(*) AS c FROM places GROUP BY w),
two AS (SELECT b, w, count(*) AS c FROM places WHERE b IS NOT NULL GROUP BY b, w HAVING count(*) >= 2),
three AS (SELECT a, b, w, count(*) AS c FROM places WHERE a IS NOT NULL GROUP BY a, b, w HAVING count(*) >= 2),
l1 AS (SELECT w, CAST(round(ln(c) * 1e6) AS BIGINT) AS l FROM one),
l2 AS (SELECT b, w, CAST(round(ln(c) * 1e6) AS BIGINT) AS l FROM two),
l3 AS (SELECT a, b, w, CAST(round(ln(c) * 1e6) AS BIGINT) AS l FROM three),
fixed AS (SELECT CAST(round(ln(count(*)) * 1e6) AS BIGINT) AS l, CAST(round(ln(0.4) * 1e6) AS BIGINT) AS back FROM places),
scored AS (
    SELECT p.r, (g2.l IS NOT NULL)::INT + (g3.l IS NOT NULL)::INT AS found,
        CASE WHEN g3.l IS NOT NULL THEN g3.l - h2.l
            WHEN g2.l IS NOT NULL THEN (p.a IS NOT NULL)::INT * back + g2.l - h1.l
            ELSE ((p.a IS NOT NULL)::INT + (p.b IS NOT NULL)::INT) * back + g1.l - fixed.l END AS s
    FROM places p JOIN l1 g1 ON g1.w = p.w LEFT JOIN l1 h1 ON h1.w = p.b
        LEFT JOIN l2 g2 ON g2.b = p.b AND g2.w = p.w LEFT JOIN l2 h2 ON h2.b = p.a AND h2.w = p.b
        LEFT JOIN l3 g3 ON g3.a = p.a AND g3.b = p.b AND g3.w = p.w, fixed),
sums AS (SELECT r, count(*) AS n, sum(found) AS f, sum(s) AS s FROM scored GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(f, 0) AS BIGINT) AS n_found,
    CAST(coalesce(s, 0) AS BIGINT) AS score_micro, CASE WHEN n > 0 THEN CAST(s AS BIGINT) / CAST(n AS BIGINT) / 1e6::DOUBLE END AS mean_score
FROM words LEFT JOIN sums USING (r)
"""


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the bytes they decode to."""
    codec = bpe_codec.ByteBpe.from_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    documents = load(spark, folder, "documents").select("doc_id", "text")
    encoded = bpe_codec.encode(documents, codec).select("doc_id", "ids", "offsets")
    decoded = bpe_codec.decode(encoded, codec)
    return decoded.select(
        "doc_id",
        bpe_codec.token_count("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors of largest whole-number inner product for every fiftieth vector."""
    rows = load(spark, folder, "embeddings")
    return vafile.largest(rows, rows.where("vec_id % 50 = 0"), k=5)


OP4_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM whole q JOIN whole r ON q.vec_id <> r.vec_id AND q.vec_id % 50 = 0 AND len(q.v) = len(r.v)),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM scored)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5
"""


def op10_vantage_points(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth vector."""
    rows = load(spark, folder, "embeddings")
    return vptree.nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document, by its least doc_id."""
    found = near.near_classes(load(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "stays")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Documents whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(spark: SparkSession, folder: str, documents: DataFrame) -> toxicity.ToxicityModel:
    """Learn from the labels of rows that are not held out."""
    return toxicity.fit(documents, load(spark, folder, "labels").where(~held_out()))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document."""
    documents = load(spark, folder, "documents").select("doc_id", "text")
    scored = fit_toxicity(spark, folder, documents).transform(documents)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, by patterns and by tests of randomness."""
    found = secrets.find_secrets(load(spark, folder, "documents").select("doc_id", "text"))
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.listed("spans", secrets.KINDS[:3]), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


def op8_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = load(spark, folder, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in pieces of 1024 tokens and of smaller powers of two."""
    codec = bpe_codec.ByteBpe.from_merges(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(load(spark, folder, "documents"), codec)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the sixteen largest components of the covariance, whitened."""
    rows, model = whitening.whiten(load(spark, folder, "embeddings").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(float(e) / model.trace) for e in model.values]).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted from its log and read back."""
    control = "</s>[INST] ok [/INST]"
    rows = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    both = f"VALUES (-1L, 0L, 'user', '{control}'), (-1L, 1L, 'assistant', '{control}') AS t(conv_id, turn, role, text)"
    log = chat.streamed(rows.unionByName(spark.sql(f"SELECT * FROM {both}")))
    formatted = chat.format_chats(log)
    read = formatted.select(
        "conv_id",
        chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss")), "").alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


_ESCAPED_SQL = r"regexp_replace({}, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|role\|>|\|text\|>|\|end\|>)', '\1\\\2\3', 'g')"
OP12_SQL = f"""
WITH told AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
turns AS (
    SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
        ELSE 24 + length({_ESCAPED_SQL.format('role')}) END + length({_ESCAPED_SQL.format('text')}) AS chars
    FROM told)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Ten rows of other labels for every hundredth vector and each of its five nearest of its label, within 30 to 90 hundredths of their score."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = load(spark, folder, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return negatives.mine(rows, rows.where("vec_id % 100 = 0"))


OP13_SQL = """
WITH w AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM w a JOIN w b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
    SELECT p.*, s.id AS negative_id, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS "rank"
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, "rank", negative_id, positive_score, negative_score FROM n WHERE "rank" <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_stupid_backoff": op2_stupid_backoff,
    "op2_stupid_backoff_trigrams": op2_stupid_backoff_trigrams,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_html_main_text": op8_html_main_text,
    "op9_packing": op9_packing,
    "op10_vantage_points": op10_vantage_points,
    "op11_whitening": op11_whitening,
    "op12_chat_format": op12_chat_format,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op2_stupid_backoff": OP2_SQL,
    "op2_stupid_backoff_trigrams": OP2_TRIGRAMS_SQL,
    "op4_exact_top_k": OP4_SQL,
    "op12_chat_format": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
