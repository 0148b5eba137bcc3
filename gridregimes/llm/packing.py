"""Packing by the sum-of-squares rule: documents as token ids into windows of one length.

A document's full windows go out as they are. Its last piece, of s ids, is put into a window that is filled to level h
or into a new one, such that the sum over all levels of (number of open windows at that level) squared is least
afterwards; ties take the fuller window. The numbers of open windows by level are one array, so a choice is one vector
operation. At the end of a partition what the open windows hold is cut anew into full windows, so that a partition
leaves one padded window at most.

Partitions of the input are packed on their own: nothing is shuffled, and a lost task is run again alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tokens import binaries, encoder

#: Open windows of a partition after which what they hold is cut into full windows: 64 MB of ids at most. That pads
#: nothing; it costs one more cut a window.
MAX_OPEN = 16_384
_BIG = np.iinfo(np.int64).max // 4

PIECES = "id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Windows of ``capacity`` ids; ``out`` gets (doc, start, ids, doc_tokens, sequence, offset) once a place is final."""

    def __init__(self, capacity: int, first_sequence: int = 0, max_open: int = MAX_OPEN):
        self.capacity, self.next, self.max_open = capacity, first_sequence, max_open
        self.join = np.full(capacity, _BIG, np.int64)  # change of the sum if a window leaves level h
        self.join[0] = 0
        self.leave = np.ones(capacity + 1, np.int64)  # change if one arrives at level h
        self.leave[capacity] = 0
        self.levels: list[list[list]] = [[] for _ in range(capacity + 1)]  # open windows: lists of their pieces
        self.open = 0
        self.out: list[tuple] = []

    def level_counts(self) -> np.ndarray:
        return np.array([len(x) for x in self.levels])

    def _count(self, level: int) -> None:
        n = len(self.levels[level])
        self.join[level] = 1 - 2 * n if n else _BIG
        self.leave[level] = 2 * n + 1

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def place(self, piece: tuple) -> None:
        size, c = len(piece[2]), self.capacity
        change = self.join[: c - size + 1] + self.leave[size:] if size < c else np.zeros(1)
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        window = self.levels[level].pop() if level else []
        self.open += not level
        window.append(piece)
        if level:
            self._count(level)
        if level + size == c:
            self.open -= 1
            self._emit(window)
        else:
            self.levels[level + size].append(window)
            self._count(level + size)
        if self.open >= self.max_open:
            self.cut_open(last=False)

    def add(self, doc: object, ids: np.ndarray) -> None:
        c = self.capacity
        for k in range(0, len(ids) - c + 1, c):
            self._emit([(doc, k, ids[k : k + c], len(ids))])
        if rest := len(ids) % c:
            self.place((doc, len(ids) - rest, ids[len(ids) - rest :].copy(), len(ids)))

    def cut_open(self, last: bool = True) -> None:
        """Cuts what the open windows hold into full ones; what is left over is padded (``last``) or stays open."""
        window, fill = [], 0
        for level in range(self.capacity - 1, 0, -1):
            for doc, start, ids, total in (p for w in self.levels[level] for p in w):
                while len(ids):
                    part = ids[: self.capacity - fill]
                    window.append((doc, start, part, total))
                    fill, start, ids = fill + len(part), start + len(part), ids[len(part) :]
                    if fill == self.capacity:
                        self._emit(window)
                        window, fill = [], 0
            self.levels[level] = []
            self._count(level)
        self.open = 0
        if window and last:
            self._emit(window)
        elif window:
            self.levels[fill].append(window)
            self._count(fill)
            self.open = 1


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", max_open: int = MAX_OPEN) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    A null or empty text is the end id alone. Repeated rows and null ids are packed like any others; columns besides id
    and text are not read. sequence_id is the partition's number times 2**40 and a count, so it is unique, not dense.
    """
    id_type = docs.schema[id_col].dataType
    schema = PIECES.format(id=id_type.simpleString())
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(tokenizer_path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40, max_open)
        end = np.array([end_id], tok.dtype)

        def flush() -> pa.RecordBatch:
            rows, packer.out = packer.out, []
            doc, start, ids, total, seq, offset = zip(*rows, strict=True)
            longs = [pa.array(x, pa.int64()) for x in (start, map(len, ids), total, seq, offset)]
            return pa.RecordBatch.from_arrays([pa.array(doc, arrow_id), *longs, binaries([x.astype("<u4") for x in ids])], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), tok.batch(batch.column(1)), strict=True):
                packer.add(doc, np.concatenate([ids, end]))
                if len(packer.out) >= 2048:
                    yield flush()
        packer.cut_open()
        if packer.out:
            yield flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
