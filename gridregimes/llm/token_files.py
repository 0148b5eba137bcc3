"""Token files coded by canonical length-limited Huffman codes, and their reader.

Writing: texts are encoded once and their ids kept in a scratch table, with the counts of each batch; the counts over
the whole corpus give code lengths (package-merge, ``max_bits`` at most), from which canonical codes follow. Documents are put in id order over
range partitions; each partition writes its files of segments.

A folder holds ``codebook`` (symbol, bits: all a reader needs), ``segments`` and ``parts`` (ids in each part). A segment
is a row: part, segment, first (ids before it in its part), nulls (documents without an id, which come first), docs (their ids), lengths (ids in each), payload (codes,
most significant bit first) and checkpoints: the bit at which each block of ``BLOCK`` ids begins. Blocks are decoded
independently, by one table of 2**max_bits entries: a step decodes the next id of all blocks of a segment together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .tokens import binaries, encoder, id_type

BLOCK = 256
#: Ids after which a segment ends; it ends with a document, so one long document makes a longer segment.
SEGMENT_IDS = 1 << 19
SEGMENTS = "part int, segment int, first long, n long, nulls long, docs binary, lengths binary, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths of an optimal prefix code with no length over ``max_bits``, for positive counts (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols do not fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    merged, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        merged = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        k = int(leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) by symbol value: shorter codes first, then by symbol."""
    size = int(symbols.max()) + 1 if len(symbols) else 1
    code, bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
    top = int(lengths.max()) if len(lengths) else 1
    order = np.lexsort((symbols, lengths))
    s, b = symbols[order], lengths[order]
    width = np.left_shift(1, top - b)  # codes as intervals of [0, 2**top)
    code[s] = ((np.cumsum(width) - width) >> (top - b)).astype(np.uint64)
    bits[s] = b
    return code, bits


def decode_table(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, bits) of the code that begins each string of ``top`` bits, and top."""
    top = int(lengths.max()) if len(lengths) else 1
    order = np.lexsort((symbols, lengths))
    width = np.left_shift(1, top - lengths[order])
    table = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.int64)
    table[0][: width.sum()] = np.repeat(symbols[order], width)
    table[1][: width.sum()] = np.repeat(lengths[order], width)
    return *table, top


#: Ids coded at once: what a step needs stays in the processor's cache.
AT_ONCE = 1 << 15


def encode_bits(ids: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of all ids in a row, and the bit at which each block begins."""
    if not len(ids):
        return b"", np.empty(0, np.uint64)
    left = code << (64 - np.maximum(bits, 1)).astype(np.uint64)  # codes from the top bit on
    n = bits.astype(np.uint8)[ids]
    ends = np.cumsum(n, dtype=np.int64)
    words = np.zeros(int(ends[-1] + 63 >> 6) + 1, np.uint64)
    for k in range(0, len(ids), AT_ONCE):
        end, c = ends[k : k + AT_ONCE], left[ids[k : k + AT_ONCE]]
        begin = end - n[k : k + AT_ONCE]
        word, off = begin >> 6, (begin & 63).astype(np.uint64)
        firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[firsts]] += np.add.reduceat(c >> off, firsts)  # codes do not overlap, so adding is or
        over = np.flatnonzero(end - 1 >> 6 != word)
        words[word[over] + 1] += c[over] << (64 - off[over])
    return words.astype(">u8").tobytes()[: int(ends[-1] + 7 >> 3)], (ends[::BLOCK] - n[::BLOCK]).astype(np.uint64)


def decode_bits(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ``n`` ids: each step decodes one id in every block."""
    symbol, bits, top = table
    out = np.zeros((len(checkpoints), BLOCK), np.uint32)
    data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    at = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]  # 32 bits from each byte on
    pos, last, drop = checkpoints.astype(np.int64), len(payload), 32 - top
    for k in range(BLOCK):
        if k and len(pos) > 1 and k >= n - (len(checkpoints) - 1) * BLOCK:
            pos = pos[: len(checkpoints) - 1]  # the last block may be shorter
        elif k >= n - (len(checkpoints) - 1) * BLOCK and len(checkpoints) == 1:
            break
        here = (at[np.minimum(pos >> 3, last)] << (pos & 7).astype(np.uint32)) >> drop
        out[: len(pos), k] = symbol[here]
        pos = pos + bits[here]
    return out.ravel()[:n]


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, max_bits: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token files of ``docs`` in ascending id order (nulls first; rows with one id in any order).

    A null text counts as empty and gives the end id alone. Ids are longs. ``max_bits`` is 24 at most and grows to what
    the number of different ids needs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token_files")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer_path)
        end = np.array([end_id], tok.dtype)
        squeeze = pa.Codec("zstd", compression_level=1)
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            parts = [np.concatenate([x, end]) for x in tok.batch(batch.column(1))]
            n = np.bincount(np.concatenate([np.empty(0, tok.dtype), *parts]))
            seen = np.flatnonzero(n)
            counts = pa.StructArray.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], ["symbol", "n"])
            counts = pa.ListArray.from_arrays(pa.array([0] + [len(seen)] * len(parts), pa.int32()), counts)  # all in the first row
            data = binaries([squeeze.compress(x.tobytes(), asbytes=True) for x in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(at, at + len(parts)), pa.int64()), pa.array([x.nbytes for x in parts], pa.int64()), data, counts], ["id", "at", "size", "data", "counts"])
            at += len(parts)

    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tokenize, "id long, at long, size long, data binary, counts array<struct<symbol:long,n:long>>")
    raw = scratch.write(raw, "ids")

    def unpack(batch: pa.RecordBatch, dtype: np.dtype) -> list[np.ndarray]:
        codec = pa.Codec("zstd")
        sizes, data = batch.column(batch.schema.get_field_index("size")).to_pylist(), batch.column(batch.schema.get_field_index("data"))
        return [np.frombuffer(codec.decompress(x.as_buffer(), n), dtype) for x, n in zip(data, sizes, strict=True)]

    dtype = id_type(tokenizer_path)

    counts = raw.select(F.explode("counts").alias("c")).groupBy("c.symbol").agg(F.sum("c.n").alias("n")).orderBy("symbol").toPandas()  # a row for each id of the vocabulary at most
    symbols = counts["symbol"].to_numpy(np.int64)
    max_bits = max(max_bits, (max(len(symbols), 2) - 1).bit_length())
    lengths = code_lengths(counts["n"].to_numpy(np.int64), max_bits)
    code, bits = canonical_codes(symbols, lengths)
    book = pa.table({"symbol": symbols, "bits": lengths})
    spark.createDataFrame(book.to_pandas(), "symbol long, bits long").coalesce(1).write.parquet(f"{folder}/codebook")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        docs_, held, n = [], [], 0

        def row() -> pa.RecordBatch:
            payload, marks = encode_bits(np.concatenate(held), code, bits)
            own = np.array([d or 0 for d in docs_], "<i8")
            cells = [own, np.array([len(x) for x in held], "<i8"), marks.astype("<u8"), payload]
            numbers = [pa.array([x], t) for x, t in ((part, pa.int32()), (segment, pa.int32()), (first, pa.int64()), (n, pa.int64()), (docs_.count(None), pa.int64()))]
            return pa.RecordBatch.from_arrays([*numbers, *(binaries([x]) for x in cells)], ["part", "segment", "first", "n", "nulls", "docs", "lengths", "checkpoints", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), unpack(batch, dtype), strict=True):
                docs_.append(doc)
                held.append(ids)
                n += len(ids)
                if n >= SEGMENT_IDS:
                    yield row()
                    segment, first = segment + 1, first + n
                    docs_, held, n = [], [], 0
        if held:
            yield row()

    ordered = raw.drop("counts").repartitionByRange(partitions(spark), "id", "at").sortWithinPartitions("id")
    ordered.mapInArrow(write, SEGMENTS).write.parquet(f"{folder}/segments")
    scratch.drop("ids")
    spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").groupBy("part").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{folder}/parts")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit).

    Documents without an id come first, those repeated with one id each have a row of their own. Files of an empty table
    give none.
    """
    book = spark.read.schema("symbol long, bits long").parquet(f"{folder}/codebook").toPandas()  # bounded by the vocabulary
    symbols, lengths = book["symbol"].to_numpy(), book["bits"].to_numpy()
    parts = spark.read.schema("part int, n long").parquet(f"{folder}/parts")  # a row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(symbols, lengths)
        for batch in batches:
            for row in batch.to_pylist():
                docs, sizes = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["lengths"], "<i8")
                ids = decode_bits(row["payload"], np.frombuffer(row["checkpoints"], "<u8"), row["n"], table).astype("<u4")
                ends = np.cumsum(sizes)
                data = ids.view(np.uint8)
                offsets = pa.py_buffer(np.r_[0, ends * 4].astype("<i4").tobytes())
                whole = pa.Array.from_buffers(pa.binary(), len(docs), [None, offsets, pa.py_buffer(data)]) if ends[-1] < 1 << 28 else binaries([ids[e - s : e] for e, s in zip(ends, sizes, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=np.arange(len(docs)) < row["nulls"]), pa.array(row["base"] + row["first"] + ends - sizes), pa.array(sizes), whole], ["doc_id", "start", "n_tokens", "ids"])

    segments = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")
    return segments.join(F.broadcast(parts), "part").drop("part", "segment").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
