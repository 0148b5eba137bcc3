"""Alignment of two tokenizers' tokens, with corpus-wide counts of the id pairs that are linked.

Both encode a text to tokens that stand for the same bytes. The byte offsets where a token of each ends cut them into
groups; every token of a group is linked with every token of the other side there. A pair's count is the number of
documents that hold it.

1. Texts are encoded once; ids go to a scratch table. Tasks also hand on the different pairs that they have seen.
2. Different pairs are put into slices by their first id, and a minimal perfect hash is built for each slice.
3. A pass over the ids aligns each document and counts its pairs into one dense vector a task, indexed by the hash. The
   vectors are added up as a tree: first those of some tasks, then those sums.
4. A second pass aligns the documents again and looks their pairs up; the key in a slot is compared.

Slices are told to tasks in rounds of ``ROUND`` bytes at most, each a pass of 3 and 4, so their number has no limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held, prepare
from .perfect_hash import Slices, build
from .tokens import Encoder, binaries, byte_names

#: Pairs of a slice (on average; an id's own pairs are never split), and bytes of slices that a task holds at once.
SLICE, ROUND = 1 << 14, 64 << 20
#: Different pairs that a task holds before it hands them on, and links that are counted at once.
HELD, LINKS = 1 << 22, 1 << 20
#: A document that has a group with more links is counted by its groups' different ids.
LARGE = 1 << 12
SUMS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"


class PieceEncoder:
    """Ids by the sentencepiece library. If no piece crosses the beginning of a word, a batch's different words are
    encoded once each.

    A word is a run of spaces and what follows up to the next space or line end; or such a run of line ends.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if m.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.space = m.piece_to_id("▁")
        self.by_word = not any(re.search("[^▁]▁|\n", x) for x in pieces)
        sample = "a  b\n c"
        self.by_word = self.by_word and self._by_words([sample])[0].tolist() == m.encode(sample)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, to which the library adds a space."""
        simple = [k for k, x in enumerate(texts) if self.by_word and "\0" not in x and "▁" not in x]  # the library takes the latter for a space
        out: list = [None] * len(texts)
        rest = sorted(set(range(len(texts))).difference(simple))
        for own, encoded in ((simple, self._by_words), (rest, self._whole)):
            for k, ids in zip(own, encoded([texts[k] for k in own]) if own else []):
                out[k] = ids
        return out

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        marked = pc.replace_substring_regex(pa.array([" " + x for x in texts], pa.large_string()), r" +[^ \n]*|\n+[^ \n]*", "\0\\0")
        cut = pc.split_pattern(marked, "\0")  # each text begins with an empty word
        coded = cut.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        # the library puts a space before all it is given: a word's own first one, or one to be taken off
        ids = self.model.encode([x[1:] if x[:1] == " " and len(x) > 1 else x for x in words], num_threads=1)
        ids = [[self.space] if x == " " else i for x, i in zip(words, ids)]
        added = np.fromiter((x[:1] == "\n" for x in words), np.int64, len(words))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        begin, size = np.cumsum(size) - size + added, size - added
        flat = np.fromiter(chain.from_iterable(ids), np.uint32)
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        found = flat[np.repeat(begin[at] - (ends - n), n) + np.arange(int(ends[-1]))]
        return np.split(found, np.r_[0, ends][cut.offsets.to_numpy()[1:-1]])


class Pair:
    """Both encoders, and the bytes that each id stands for."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a), PieceEncoder(path_b)
        self.a.tokenizer.encode_special_tokens = True
        of = {c: bytes([k]) for k, c in enumerate(byte_names())}
        vocab = sorted(self.a.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        bytes_a = [b""] * (vocab[-1][1] + 1)
        for word, i in vocab:
            bytes_a[i] = b"".join(of.get(c, c.encode()) for c in word)
        self.bytes = [pa.array(x, pa.large_binary()) for x in (bytes_a, self.b.bytes)]
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (bytes_a, self.b.bytes)]

    def _same(self, side: int, ids: list[np.ndarray], raw: list[bytes]) -> list[bool]:
        """Whether each text's tokens stand for its bytes, none of them for no byte."""
        every = np.concatenate(ids)
        found = self.bytes[side].take(pa.array(every))
        edges = np.frombuffer(found.buffers()[1], np.int64)[np.r_[0, np.cumsum(list(map(len, ids)))]].tolist()
        data = (found.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        empty = self.sizes[side][every].min(initial=1) == 0
        return [data[i:j] == x and not (empty and (self.sizes[side][k] == 0).any()) for i, j, x, k in zip(edges[:-1], edges[1:], raw, ids)]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each side; none of a text that is null or empty or that one side does not keep byte for byte."""
        given = [k for k, x in enumerate(texts) if x]
        none = np.zeros(0, np.uint32)
        out = [(none, none)] * len(texts)
        if not given:
            return out
        raw = [(" " + texts[k]).encode() for k in given]
        a = self.a.batch(pa.array([" " + texts[k] for k in given], pa.string()))
        b = self.b.batch([texts[k] for k in given])
        for k, x, y, same_a, same_b in zip(given, a, b, self._same(0, a, raw), self._same(1, b, raw)):
            if same_a and same_b:
                out[k] = x.astype(np.uint32), y.astype(np.uint32)
        return out


class Batch:
    """Documents' tokens side by side, and the groups that they form.

    a, b: ids of all documents; n_a, n_b: tokens of each document. group_a, group_b: each token's group; in_a, in_b: a
    group's tokens; group_doc: a group's document.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        # documents hold as many bytes on both sides, so offsets over all documents agree wherever they do within one
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        marks = np.zeros((2, int(end_a[-1]) + 1 if len(a) else 1), bool)
        marks[0, end_a], marks[1, end_b] = True, True
        both = marks[0] & marks[1]
        both_a, both_b = both[end_a], both[end_b]
        self.group_a, self.group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
        groups = int(both_a.sum())
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        doc_a = np.repeat(np.arange(len(n_a)), n_a)
        self.group_doc = doc_a[both_a]
        self.first_a, self.first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums over each document's groups."""
        total = np.r_[0, np.cumsum(values)]
        edges = np.searchsorted(self.group_doc, np.arange(len(self.n_a) + 1))
        return total[edges[1:]] - total[edges[:-1]]

    def links(self, n_ids_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, key of the pair, number of its links), each document's pair once; a * n_ids_b + b is the key."""
        of_group = self.in_a * self.in_b
        of_doc = self.per_doc(of_group)
        vast = (of_doc > LINKS) | (self.per_doc(of_group > LARGE) > 0)
        plain = np.flatnonzero(~vast)
        ends, k = np.cumsum(of_doc[plain]), 0
        usual = ~vast[self.group_doc]
        while k < len(plain):
            m = max(int(np.searchsorted(ends, (ends[k - 1] if k else 0) + LINKS, "right")), k + 1)
            lo, hi = np.searchsorted(self.group_doc, [plain[k], plain[m - 1] + 1])
            yield self._distinct(*self._expanded(lo + np.flatnonzero(usual[lo:hi]), n_ids_b))
            k = m
        for doc in np.flatnonzero(vast):
            yield from self._vast(doc, n_ids_b)

    def _vast(self, doc: int, n_ids_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A document with very many links: of each group its different ids with their numbers, some first ids at a time."""
        low = np.uint64(0xFFFFFFFF)
        lo, hi = np.searchsorted(self.group_doc, [doc, doc + 1])
        groups = [slice(*np.searchsorted(x, [lo, hi])) for x in (self.group_a, self.group_b)]
        a, times_a = np.unique(self.a[groups[0]].astype(np.uint64) << np.uint64(32) | (self.group_a[groups[0]] - lo).astype(np.uint64), return_counts=True)
        b, times_b = np.unique((self.group_b[groups[1]] - lo).astype(np.uint64) << np.uint64(32) | self.b[groups[1]].astype(np.uint64), return_counts=True)
        of_group = np.searchsorted(b >> np.uint64(32), np.arange(hi - lo + 1).astype(np.uint64))
        group, first = (a & low).astype(np.int64), (a >> np.uint64(32)).astype(np.int64)
        width = np.diff(of_group)[group]
        ends, k = np.cumsum(width), 0
        while k < len(a):
            m = min(int(np.searchsorted(ends, (ends[k - 1] if k else 0) + LINKS, "right")), len(a) - 1)
            begin, end = np.searchsorted(first, [first[m], first[m] + 1])
            m = len(a) if ends[-1] - (ends[k - 1] if k else 0) <= LINKS else int(begin if begin > k else end)
            n = width[k:m]
            each = np.repeat(np.arange(k, m), n)
            other = np.repeat(of_group[group[k:m]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            key = first[each] * n_ids_b + (b[other] & low).astype(np.int64)
            yield self._distinct(np.full(len(key), doc), key, times_a[each] * times_b[other])
            k = m

    def _expanded(self, groups: np.ndarray, n_ids_b: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, key) of every link of these groups."""
        width, height = self.in_b[groups], self.in_a[groups]
        # each first token with its group's second ones, one after the other
        rows = np.repeat(self.first_a[groups] - (np.cumsum(height) - height), height) + np.arange(int(height.sum()))
        n = np.repeat(width, height)
        ends = np.cumsum(n)
        other = np.repeat(np.repeat(self.first_b[groups], height) - (ends - n), n) + np.arange(int(n.sum()))
        return np.repeat(np.repeat(self.group_doc[groups], height), n), np.repeat(self.a[rows].astype(np.int64) * n_ids_b, n) + self.b[other]

    @staticmethod
    def _distinct(doc: np.ndarray, key: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, low = int(doc[0]) if len(doc) else 0, np.uint64(32)
        both = (doc - first).astype(np.uint64) << low | key.astype(np.uint64)
        if times is None:
            both = np.sort(both)
        else:
            order = np.argsort(both)
            both, times = both[order], times[order]
        begins = np.flatnonzero(np.r_[True, both[1:] != both[:-1]][: len(both)])
        total = np.diff(np.r_[begins, len(both)]) if times is None or not len(both) else np.add.reduceat(times, begins)
        both = both[begins]
        return (both >> low).astype(np.int64) + first, (both & np.uint64(0xFFFFFFFF)).astype(np.int64), total

    def strings(self, words: pa.Array) -> list[str]:
        """Each document's groups (``a1,a2|b1;a3|b2,b3``) by ``id_words``."""
        place, mark = np.zeros(len(self.a) + len(self.b), np.int64), np.zeros(len(self.a) + len(self.b), np.int64)
        place[np.arange(len(self.a)) + self.first_b[self.group_a]] = self.a
        place[np.arange(len(self.b)) + (self.first_a + self.in_a)[self.group_b]] = self.b
        mark[self.first_a + self.in_a + self.first_b - 1] = 1
        mark[self.first_a + self.in_a + self.first_b + self.in_b - 1] = 2
        found = words.take(pa.array(3 * place + mark))
        edges = np.frombuffer(found.buffers()[1], np.int64)[np.r_[0, np.cumsum(self.n_a + self.n_b)]].tolist()
        text = (found.buffers()[2] or pa.py_buffer(b"")).to_pybytes().decode()
        return [text[i : max(i, j - 1)] for i, j in zip(edges[:-1], edges[1:])]


def id_words(n_ids: int) -> pa.Array:
    """Each id as text, with a comma, a bar or a semicolon after it."""
    return pa.array([f"{i}{mark}" for i in range(n_ids) for mark in ",|;"], pa.large_string())


def _sizes(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(Pair(path_a, path_b).sizes)


def _encode(path_a: str, path_b: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ids; and rows without a document that hold the different pairs of the rows before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held(("pair", path_a, path_b), lambda: Pair(path_a, path_b))
        size_a, size_b = pair.sizes
        seen, kind = np.zeros(0, np.int64), pa.int64()
        names = ["doc_id", "a", "b", "keys"]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), binaries([seen.astype("<u4")])], names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ids = pair.encode(batch.column("text").to_pylist())
            group = Batch(*(np.concatenate([x[s] for x in ids]) if ids else np.zeros(0, np.uint32) for s in (0, 1)), *(np.array([len(x[s]) for x in ids], np.int64) for s in (0, 1)), size_a, size_b)
            for _, key, _ in group.links(len(size_b)):
                seen = np.union1d(seen, key)
                if len(seen) > HELD:
                    yield told()
                    seen = seen[:0]
            code = ["<u2" if len(x) <= 1 << 16 else "<u4" for x in (size_a, size_b)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(binaries([x[s].astype(code[s]) for x in ids]) for s in (0, 1)), pa.nulls(len(batch), pa.binary())], names)
        if len(seen):
            yield told()

    return run


def _batches(batches: Iterator[pa.RecordBatch], size_a: np.ndarray, size_b: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    """Aligns documents again from their ids."""
    code = ["<u2" if len(x) <= 1 << 16 else "<u4" for x in (size_a, size_b)]
    for batch in batches:
        sides = [batch.column(s).to_pylist() for s in ("a", "b")]
        ids = [np.frombuffer(b"".join(x), c).astype(np.uint32) for x, c in zip(sides, code)]
        n = [np.array([len(x) for x in s], np.int64) // np.dtype(c).itemsize for s, c in zip(sides, code)]
        yield batch, Batch(*ids, *n, size_a, size_b)


def _slice(a: np.ndarray, n_slices: int) -> np.ndarray:
    return (a.astype(np.uint64) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)).astype(np.int64) % n_slices


def _built(found: pa.Table) -> pa.Table:
    sizes, bits, keys = build(found.column("key").to_numpy().astype(np.uint32))
    values = [binaries([sizes.astype("<i8")]), binaries([np.packbits(bits, bitorder="little")]), binaries([keys.astype("<u4")])]
    return pa.Table.from_arrays([found.column("slice").slice(0, 1), *values], ["slice", "sizes", "bits", "keys"])


def _added(found: pa.Table) -> pa.Table:
    """The sum of a slice's vectors."""
    total = sum(np.frombuffer(x.as_py(), "<i8") for x in found.column("counts"))
    return pa.Table.from_arrays([found.column("slice").slice(0, 1), binaries([total])], ["slice", "counts"])


def _rounds(table: DataFrame) -> list[list[int]]:
    """Slices of each round, by the bytes that their rows have."""
    sizes = table.select("slice", F.expr("octet_length(bits) + 13 * octet_length(keys) div 4 + 8 * octet_length(sizes)").alias("n")).orderBy("slice").collect()
    out, room = [], 0
    for x in sizes:
        if not out or room + x["n"] > ROUND:
            out.append([])
            room = 0
        out[-1].append(x["slice"])
        room += x["n"]
    return out


def _slices(rows: list, n_slices: int) -> Slices:
    rows = sorted(rows, key=lambda r: r["slice"])
    sizes = [np.frombuffer(r["sizes"], "<i8") for r in rows]
    bits = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(s.sum()), bitorder="little") for r, s in zip(rows, sizes)]
    return Slices([r["slice"] for r in rows], n_slices, sizes, bits, [np.frombuffer(r["keys"], "<u4") for r in rows])


def _count(told: object, size_a: np.ndarray, size_b: np.ndarray, n_slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's documents for each pair, as a vector for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Slices = told.value
        counts = np.zeros(len(index.keys), np.int64)
        for _, group in _batches(batches, size_a, size_b):
            for _, key, _ in group.links(len(size_b)):
                slot = index.slots(key, _slice(key // len(size_b), n_slices))
                counts += np.bincount(slot[slot >= 0], minlength=len(counts))
        task = TaskContext.get().partitionId()
        begin = 0
        for name, end in zip(index.ids, index.ends):
            own = counts[begin:end]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([task], pa.int64()), binaries([own.astype("<i8")])], ["slice", "task", "counts"])
            begin = end

    return run


def _look_up(told: object, size_a: np.ndarray, size_b: np.ndarray, n_slices: int, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds what this round's slices give to each document's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, best = told.value
        words = id_words(max(len(size_a), len(size_b)))
        for batch, group in _batches(batches, size_a, size_b):
            docs = len(batch)
            sums = np.zeros((2, docs), np.int64)
            for doc, key, times in group.links(len(size_b)):
                slot = index.slots(key, _slice(key // len(size_b), n_slices))
                doc, times, slot = doc[slot >= 0], times[slot >= 0], slot[slot >= 0]
                np.add.at(sums[0], doc[best[slot]], times[best[slot]])
                np.add.at(sums[1], doc, times * counts[slot])
            if not first:
                sums += np.array([batch.column(x).to_numpy(zero_copy_only=False) for x in ("n_best", "count_sum")])
            ones = np.ones(len(group.in_a), np.int64)
            values = [group.n_a, group.n_b, group.per_doc(ones), group.per_doc(group.in_a * group.in_b), *sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "a", "b")), *(pa.array(x, pa.int64()) for x in values), pa.array(group.strings(words), pa.string())], ["doc_id", "a", "b", *[x.split()[0] for x in SUMS.split(", ")], "groups"])

    return run


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each row of ``docs`` (doc_id of any type, text): its groups, and sums over its links.

    doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair has the highest count of its first id),
    count_sum (of the pairs' counts over links), groups (``a1,a2|b1;...``), a and b (ids, as little-endian unsigned
    integers of two bytes, or four beyond 65,536 ids). ``path_a`` is a byte-level tokenizer of the tokenizers library and
    encodes a space and the text; ``path_b`` is a sentencepiece model, which adds that space itself.

    A null or empty text, and one that a side does not keep byte for byte, has no tokens: zeros and an empty string.
    Every row is a document of its own, with a repeated or null id too. An empty table gives none. Other columns are left out.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "alignment")
    size_a, size_b = _sizes(path_a, path_b)
    if len(size_a) * len(size_b) > 1 << 32:
        raise ValueError("pairs of ids do not fit 32 bits")
    kind = dict(docs.dtypes)["doc_id"]
    encoded = docs.select("doc_id", "text").mapInArrow(_encode(path_a, path_b), f"doc_id {kind}, a binary, b binary, keys binary")
    ids = scratch.write(encoded, "ids", compression="zstd")
    keys = ids.where("keys is not null").select("keys").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_py(), "<u4").astype(np.int64))], ["key"]) for batch in it for x in batch.column(0)), "key long")
    keys = scratch.write(keys.distinct(), "keys")
    n_slices = keys.count() // SLICE + 1
    placed = keys.select(F.expr(f"((key div {len(size_b)}) * 2654435761 & 4294967295) % {n_slices}").alias("slice"), "key")
    table = scratch.write(placed.groupBy("slice").applyInArrow(_built, "slice long, sizes binary, bits binary, keys binary"), "slices")
    ids = ids.where("keys is null").drop("keys")
    rounds = _rounds(table)
    for k, chosen in enumerate(rounds):
        own = table.where(F.col("slice").between(chosen[0], chosen[-1]))
        told = spark.sparkContext.broadcast(_slices(own.collect(), n_slices))
        vectors = scratch.write(ids.mapInArrow(_count(told, size_a, size_b, n_slices), "slice long, task long, counts binary"), f"vectors{k}")
        tasks = vectors.agg(F.count_distinct("task")).first()[0]
        some = vectors.withColumn("task", F.col("task") % max(1, round(tasks**0.5)))
        sums = some.groupBy("slice", "task").applyInArrow(_added, "slice long, counts binary")
        scratch.write(sums.groupBy("slice").applyInArrow(_added, "slice long, counts binary"), f"counts{k}")
        told.destroy()
    names = ["doc_id", "a", "b", *[x.split()[0] for x in SUMS.split(", ")], "groups"]
    schema = f"doc_id {kind}, a binary, b binary, {SUMS}, groups string"
    if not rounds:  # no document has tokens
        return ids.select("doc_id", "a", "b", *[F.lit(0).cast("long").alias(x) for x in names[3:-1]], F.lit("").alias("groups"))
    out = ids
    for k, chosen in enumerate(rounds):
        rows = table.where(F.col("slice").between(chosen[0], chosen[-1])).join(spark.read.parquet(f"{scratch.path}/counts{k}"), "slice").collect()
        rows = sorted(rows, key=lambda r: r["slice"])
        index = _slices(rows, n_slices)
        counts = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in rows])
        told = spark.sparkContext.broadcast((index, counts, _highest(index.keys // np.uint32(len(size_b)), counts)))
        out = out.mapInArrow(_look_up(told, size_a, size_b, n_slices, k == 0), schema)
        if k + 1 < len(rounds):
            out = scratch.write(out, f"sums{k}", compression="zstd")
    return out.select(*names)


def _highest(a: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair has the highest count of its first id; all pairs of an id are in one slice."""
    order = np.argsort(a, kind="stable")
    begins = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1]][: len(a)])
    top = np.maximum.reduceat(counts[order], begins) if len(begins) else counts[:0]
    out = np.zeros(len(a), bool)
    out[order] = counts[order] == np.repeat(top, np.diff(np.r_[begins, len(a)]))
    return out
