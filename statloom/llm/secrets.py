"""Secret scans by patterns and by a battery of randomness tests, in SQL functions only.

Three patterns give the base spans. The battery adds spans of kind `random`:
runs of letters, digits and `+/_=-` of `MIN_RANDOM` characters or more that hold
a digit or step from a small to a capital letter. For each such token

* the encoding is inferred: hexadecimal, base 32, or base 64 with or without its
  two extra symbols; it gives the alphabet and the value of each symbol;
* tests ask whether the values are random, each with its chance for random values:
  the chi-squared distance from a uniform alphabet over symbols (by its exact mean,
  variance and skewness for the length) and over digits, capitals and small letters,
  the number of runs above and below the middle, and the products of neighbours;
* the chances of a token are combined by Brown's form of Fisher's rule, as runs and
  products depend on each other, and the tokens of a document by the step-up rule of
  Benjamini and Hochberg, in which a token weighs by its length. What the rule
  rejects is not random, and random tokens are at most a share `RATE` of that. So a
  random token is found alike in any encoding and beside any number of others; short
  text that looks random stays, which longer text hardly can.

Base spans are never dropped; a random token that overlaps one is left out.
A document is judged by itself, so nothing is shuffled and a hot source or group
of copies needs no care.

Defined results: NULL and empty texts have no spans; positions count code
points, ends are exclusive; repeated rows get equal spans; extra columns are
kept, and a taken result name is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import fold_before, fresh, let, quoted

#: The base patterns, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

MIN_RANDOM = 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}"
#: Symbols of the shortest token without the padding of its encoding; what has fewer is not tested.
MIN_BODY = MIN_RANDOM - 2
#: The share of random tokens among those dismissed as text, at most.
RATE = 0.05
#: Sum of the covariances between the tests' -2 ln(chance), as measured on random tokens.
SHARED = 3.4
#: Four chances count as a chi-squared figure of mean 8 with so many degrees of freedom.
FREEDOM = 2 * 8**2 / (4 * 4 + 2 * SHARED)

#: Code points of a part of a text, and its stretches: their least size and how many at most.
PART, STRETCH, STRETCHES = 4096, 1024, 256

DIGITS, CAPITALS, SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _starts(found: Column, between: Column) -> Column:
    """Where each match begins: all that stands between matches, and the matches before it."""
    sizes = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, f: F.struct(F.length(b).alias("b"), F.length(f).alias("f")))
    add = lambda a, b: a + b
    return let(sizes, lambda z: F.zip_with(z, fold_before(z, lambda e: e["b"] + e["f"], add), lambda e, at: at + e["b"]))


NO_SPANS = "CAST(array() AS array<struct<start:int,rank:int,end:int,token:string>>)"


def _matches(text: Column, pattern: str, rank: int, value: int = 0) -> Column:
    """Spans of a pattern as (start, rank of the kind, end, token); for texts without a match at no more cost than the test."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = F.zip_with(
        found,
        _starts(found, F.split(text, pattern, -1)),
        lambda f, s: F.struct(s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(f)).alias("end"), f.alias("token")),
    )
    if value:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        kept = F.zip_with(spans, values, lambda s, v: F.when(F.length(v) >= value, s))
        spans = F.filter(kept, lambda s: s.isNotNull())
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(NO_SPANS))


def _tail(z: str) -> str:
    """SQL for the chance that a normal deviate exceeds `z`, to seven digits also where it is small."""
    series = "0.17087277D"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        series = f"({c}D + t * {series})"
    beyond = f"transform(array(1D / (1D + abs(z) / sqrt(8D))), t -> t * exp({series} - z * z / 2D) / 2D)[0]"
    return f"transform(array({z}), z -> transform(array({beyond}), e -> IF(z >= 0D, e, 1D - e))[0])[0]"


def _battery(token: str) -> str:
    """SQL for the figures of one token: (chance for random values, weight); the chance is NULL for too few symbols."""
    alphabet = f"""
        CASE WHEN {token} RLIKE '^[0-9a-f]+$' THEN '{DIGITS}abcdef'
             WHEN {token} RLIKE '^[0-9A-F]+$' THEN '{DIGITS}ABCDEF'
             WHEN {token} RLIKE '^[A-Z2-7]+=*$' THEN '{CAPITALS}234567'
             WHEN {token} RLIKE '[+/]' THEN '{DIGITS}{CAPITALS}{SMALL}+/'
             WHEN {token} RLIKE '[-_]' THEN '{DIGITS}{CAPITALS}{SMALL}-_'
             ELSE '{DIGITS}{CAPITALS}{SMALL}' END"""
    # Digits count with the two extra symbols.
    of = lambda x: ", ".join(f"1D * length(regexp_replace({x}, '{c}', ''))" for c in ("[A-Za-z]", "[^A-Z]", "[^a-z]"))
    neighbours = "zip_with(slice(q.values, 1, size(q.values) - 1), slice(q.values, 2, size(q.values) - 1), (a, b) -> {})"
    return f"""
    transform(array(named_struct('body', regexp_replace({token}, '=+', ''), 'alphabet', {alphabet})), p ->
    IF(length(p.body) < {MIN_BODY}, named_struct('chance', CAST(NULL AS DOUBLE), 'weight', 0D),
    transform(array(named_struct(
        'n', 1D * length(p.body), 'k', 1D * length(p.alphabet),
        'counts', transform(regexp_extract_all(p.alphabet, '.', 0), s -> 1D * (length(p.body) - length(replace(p.body, s, '')))),
        'classes', zip_with(array({of("p.body")}), array({of("p.alphabet")}), (o, e) -> named_struct('o', o, 'e', e * length(p.body) / length(p.alphabet))),
        'values', transform(regexp_extract_all(p.body, '.', 0), c -> instr(p.alphabet, c) - (length(p.alphabet) + 1) / 2D))), q ->
    transform(array(named_struct(
        'n', q.n, 'within', aggregate(q.counts, 0D, (a, c) -> a + c) = q.n,
        'equal', aggregate(q.counts, 0D, (a, c) -> a + c * (c - 1D) / 2D) - q.n * (q.n - 1D) / 2D / q.k,
        'deviation', sqrt(q.n * (q.n - 1D) / 2D * (q.k - 1D)) / q.k,
        'third', q.n * (q.n - 1D) / 2D * (q.k - 1D) / power(q.k, 3) * (q.k - 2D + 2D * (q.n - 2D)),
        'parts', size(filter(q.classes, c -> c.e > 0D)),
        'apart', aggregate(filter(q.classes, c -> c.e > 0D), 0D, (a, c) -> a + (c.o - c.e) * (c.o - c.e) / c.e),
        'turns', aggregate({neighbours.format("IF((a > 0D) != (b > 0D), 1D, 0D)")}, 0D, (a, v) -> a + v),
        'lag', aggregate({neighbours.format("a * b")}, 0D, (a, v) -> a + v) * 12D / (q.k * q.k - 1D))), r ->
    transform(array(named_struct('z', (r.equal - 0.5D) / r.deviation, 'skew', r.third / power(r.deviation, 3))), s ->
    transform(array(array(
        {_tail("6D / s.skew * (cbrt(greatest(1D + s.skew * s.z / 2D, 0D)) - 1D) + s.skew / 6D")},
        IF(r.parts = 3, exp(-r.apart / 2D), 2D * {_tail("sqrt(r.apart)")}),
        2D * {_tail("greatest(abs(r.turns - (r.n - 1D) / 2D) - 0.5D, 0D) / sqrt((r.n - 1D) / 4D)")},
        2D * {_tail("abs(r.lag) / sqrt(r.n - 1D)")})), t ->
    named_struct(
        'chance', IF(r.within, {_tail(f"(cbrt(aggregate(t, 0D, (a, c) -> a - 2D * ln(greatest(c, 1e-300D))) / 8D) - (1D - 2D / {9 * FREEDOM}D)) / sqrt(2D / {9 * FREEDOM}D)")}, 0D),
        'weight', r.n)
    )[0])[0])[0])[0]))[0]"""


def find_secrets(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add `spans`, an array of (kind, start, end) by start and then kind."""
    if spans.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {spans!r} is there already; choose another result name")
    base, tokens, judged, picked = fresh(df, "_base", "_tokens", "_judged", "_picked")
    source = F.col(quoted(text))
    marked = df.select(
        "*",
        F.array_sort(F.concat(_matches(source, ASSIGN, 0, ASSIGN_VALUE), _matches(source, ACCESS, 1), _matches(source, HEX, 2))).alias(base),
        _matches(source, TOKEN, 3).alias(tokens),
    )
    scored = marked.withColumn(judged, F.expr(f"transform({tokens}, t -> struct(t AS span, {_battery('t.token')} AS score))"))
    scored = scored.withColumn(judged, F.expr(f"filter({judged}, j -> j.score.chance IS NOT NULL)"))
    # The step-up rule: what is at or below the largest weighted chance within its share of the rate is text.
    mean = f"aggregate({judged}, 0D, (a, j) -> a + j.score.weight) / size({judged})"
    weighted = f"transform(array({mean}), m -> transform({judged}, j -> struct(j.score.chance * m / j.score.weight AS chance, j.span AS span)))[0]"
    ranked = scored.withColumn(picked, F.expr(f"IF(size({judged}) = 0, NULL, array_sort({weighted}))"))
    cut = f"array_max(transform({picked}, (p, i) -> IF(p.chance <= {RATE}D * (i + 1) / size({picked}), p.chance, -1D)))"
    # A token meets the base spans of its own stretches of the text only.
    width = f"greatest({STRETCH}, length({quoted(text)}) div {STRETCHES})"
    stretches = f"transform(sequence(0, CAST(length({quoted(text)}) div w AS INT)), k -> filter({base}, b -> b.start < (k + 1) * w AND b.end > k * w))"
    own = "flatten(slice(g, CAST(p.span.start div w AS INT) + 1, CAST(p.span.end div w - p.span.start div w AS INT) + 1))"
    overlaps = f"exists({own}, b -> b.start < p.span.end AND p.span.start < b.end)"
    apart = f"filter({picked}, p -> p.chance > c AND (size({base}) = 0 OR NOT {overlaps}))"
    bound = f"transform(array({width}), w -> transform(array({stretches}), g -> transform(array({cut}), c -> transform({apart}, p -> p.span))[0])[0])[0]"
    added = f"IF({picked} IS NULL, {NO_SPANS}, {bound})"
    named = f"element_at(array({', '.join(_text(k) for k in KINDS)}), s.rank + 1)"
    every = f"array_sort(concat({base}, {added}))"
    return ranked.select(
        *[F.col(quoted(c)) for c in df.columns],
        F.expr(f"transform({every}, s -> named_struct('kind', {named}, 'start', s.start, 'end', s.end))").alias(spans),
    )


def listed(spans: str, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of some kinds as kind:start:end, joined by commas."""
    chosen = ", ".join(_text(k) for k in kinds)
    return F.expr(f"array_join(transform(filter({quoted(spans)}, s -> s.kind IN ({chosen})), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mask: str = "[secret]") -> DataFrame:
    """Put `mask` in place of every run of characters that spans cover; NULL texts stay NULL.

    The text is cut in parts once, so that a piece of it costs its own length and that of a part.
    """
    source, found = F.col(quoted(text)), F.col(quoted(spans))

    def piece(parts: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / PART).cast("int")
        held = F.array_join(F.slice(parts, first + 1, F.floor(end / PART).cast("int") - first + 1), "")
        return F.substring(held, start % PART + 1, end - start)

    def joined(parts: Column, before: Column) -> Column:
        # A span that begins inside an earlier one belongs to its run.
        pieces = F.zip_with(found, before, lambda s, at: F.when(s["start"] < at, "").otherwise(F.concat(piece(parts, at, s["start"]), F.lit(mask))))
        last = F.array_max(F.transform(found, lambda s: s["end"]))
        return F.array_join(F.concat(pieces, F.array(piece(parts, last, F.length(source)))), "")

    ends = fold_before(found, lambda s: s["end"], lambda a, b: F.greatest(a, b))
    parts = F.regexp_extract_all(source, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    done = let(parts, lambda p: let(ends, lambda b: joined(p, b)))
    # Where one span touches the next, each has its mask, as it would if text stood between them.
    return df.withColumn(text, F.when(F.coalesce(F.size(found), F.lit(0)) <= 0, source).otherwise(done))
