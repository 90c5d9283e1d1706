"""Packing by powers of two: no sequence crosses documents and none is padded.

A document's tokens, with the closing id, are cut into full sequences of
`length` tokens and what is left over into pieces whose lengths are the binary
digits of the rest, longest first. Each piece is a sequence by itself; pieces of
equal length share a bucket, from which a trainer draws batches of one shape.
Every document is cut on its own, so nothing is shuffled, whatever the size of
a source or of a group of copies.

Defined results: a NULL or empty text has the closing id alone, one piece of
length 1. Repeated rows are packed once each. Sequence ids are unique, not
dense. An empty table gives no rows. Columns carried along must not have the
names of result columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.bpe import ENCODED_BYTES, ByteBpe
from statloom.llm.common import long_texts, quoted, row_slices, text_bytes

RESULT = ("start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset")


def piece_lengths(tokens: int, length: int) -> list[int]:
    """Full sequences, then the binary digits of the rest, longest first."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    df: DataFrame, bpe: ByteBpe, text: str = "text", keep: tuple[str, ...] = ("doc_id",), length: int = 1024, closing: int = 0
) -> DataFrame:
    """A row for each piece: the kept columns and those of RESULT; `length` is a power of two."""
    if length < 1 or length & (length - 1):
        raise ValueError(f"the length of a sequence must be a power of two, not {length}")
    clash = {c.lower() for c in keep} & set(RESULT)
    if clash:
        raise ValueError(f"columns {sorted(clash)} have names of result columns")
    rows = df.select(*[F.col(quoted(c)) for c in keep], F.col(quoted(text)).alias("_text"))
    added = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType())]
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, t, False) for n, t in added]])
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(len(keep)))
            for a, b in row_slices(starts, ENCODED_BYTES):
                own = starts[a : b + 1]
                owner, begins, lengths, pieces, totals = [], [], [], [], []
                for row, ids in enumerate(bpe.encode_slice(data[own[0] : own[-1]], own - own[0]), a):
                    ids += end
                    total, at = len(ids) // 4, 0
                    for size in piece_lengths(total, length):
                        owner.append(row)
                        begins.append(at)
                        lengths.append(size)
                        pieces.append(ids[4 * at : 4 * (at + size)])
                        totals.append(total)
                        at += size
                kept = batch.select(range(len(keep))).take(pa.array(owner, pa.int64()))
                made = [pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(pieces, pa.binary()), pa.array(totals, pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=schema.names)

    return long_texts(rows).mapInArrow(run, schema).select(
        "*",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
