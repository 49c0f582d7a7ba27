"""Packing by power-of-two decomposition (Pouransari et al. 2024): no sequence holds tokens of two documents.

A document of n tokens becomes pieces of ``limit`` tokens and then one piece for each binary digit of the rest. Pieces of
one length form a bucket, from which batches of equal length are drawn, so nothing is padded. Each piece is a sequence;
sequences are numbered bucket by bucket, shortest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gapless, give_back, materialize

#: Longest sequence, and the id put at the end of each document.
LIMIT, END_ID = 1024, 0

#: Parts in which the pieces of a bucket are numbered.
CELLS = 4096

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def piece_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Powers of two that sum up to n, largest first, none above ``limit`` (itself a power of two)."""
    whole, rest = divmod(n, limit)
    return [limit] * whole + [1 << b for b in range(limit.bit_length() - 2, -1, -1) if rest >> b & 1]


def cut_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids.

    ``ids`` are little-endian unsigned 32-bit integers. A null or empty text is its end id alone.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from .subwords import encoder, in_pieces

        ids_of, end = encoder(tokenizer).ids, end_id.to_bytes(4, "little")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
        kinds = [*[pa.int64()] * 5, *[pa.binary()] * with_ids]
        for part in (p for batch in batches for p in in_pieces(batch, 1)):
            out: list[list] = [[] for _ in names]
            for doc_id, found in zip(part.column(0).to_pylist(), ids_of(part.column(1)), strict=True):
                ids, at = found.tobytes() + end, 0
                tokens = len(ids) // 4
                for length in piece_lengths(tokens, limit):
                    piece = ids[4 * at : 4 * (at + length)]
                    values = (doc_id, at, length, zlib.crc32(piece), tokens, piece)
                    for column, value in zip(out, values, strict=False):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds, strict=True)], names=names)
            give_back()

    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(cut, _SCHEMA + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Sequences of the whole table, one row a piece, each a sequence of its own at offset 0.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id (gapless from 0, shorter lengths first), offset
    and, if asked for, ids. Repeated rows and null ids are packed like others. An empty table gives an empty result.
    A very long text is encoded in one go where it is read; pieces of one length are numbered by id, start and checksum, and
    equal ones in any order.
    """
    pieces = materialize(cut_documents(docs, tokenizer, limit, end_id, key, text, with_ids))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one a power of two
    first, at = F.lit(0), 0
    for length in sorted(counts):
        first, at = F.when(F.col("length") == length, F.lit(at)).otherwise(first), at + counts[length]
    cell = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.lit(CELLS))
    numbered = gapless(pieces, ["length"], cell, [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "_index")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return numbered.select(*columns, (first + F.col("_index")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
