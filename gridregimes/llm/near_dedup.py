"""Near duplicates by b-bit MinHash over sets of word shingles, with every link confirmed on the full sets.

1. One scan of the texts gives each document its set's size, a 128-bit key of the set, the keys of 28 bands of 4 minima,
   and 256 minima cut to their lowest 2 bits, packed into eight longs. Documents with equal sets form a class; only
   classes go on.
2. Classes that share a band meet in a bucket. Each is paired with one other: of the smallest members of its buckets the
   one it shares most of them with. A pair goes on to be confirmed if its sizes allow the similarity, and if the
   similarity estimated by counting equal bits (corrected for the 1 in 4 that agree by chance) is not five standard
   deviations low. So a bucket of k classes gives k pairs, and most families are connected by them.
3. In each bucket that still has members of several components, one member of each component is paired with one of the
   bucket's largest component.
4. The members of buckets that still have several components meet by their rarest shingles. In an order common to all
   sets, two sets of similarity t share one of the first n - ceil(t n) + 1 shingles of each; the order puts the rarest
   first, by counts in hashed slots, so sets that only share common passages do not meet. Of those that share such a
   shingle the members outside the largest component meet the others, by sizes, bits and parities alone, dealt over several
   tasks where a shingle has many; the different pairs that are left are confirmed on the sets. A set's parities tell of each
   of 512 slots whether it has an odd number of shingles there. Sets differ by at least as many shingles as slots, so
   this loses no link, and of members of a family that are not quite similar few are left. So any two classes that share
   a band have been compared or are connected.

At a similarity of 0.8 two sets share no band with a probability of 4e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, small
from .components import components

BANDS, ROWS, MINIMA = 28, 4, 256
#: What an estimate may lie below the wanted similarity: five standard deviations of 256 two-bit minima.
SLACK = 0.15
LONGS = MINIMA // 32
BITS = [f"s{i}" for i in range(LONGS)]
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20_240_607)
_MULTIPLY = (_rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * 2 + 1)[:, None]
_ADD = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = 2048
#: Slots of shingle counts: what a task gets of them has 8 MB, whatever the corpus.
SLOTS = 1 << 20
#: Slots of a set's parities, packed into longs.
PARITIES = 512
ODD = [f"o{i}" for i in range(PARITIES // 64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return h ^ (h >> np.uint64(29))


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of ``k`` words (white space: space and \\x09 to \\x0D; A-Z as a-z).

    Fewer words give one shingle of all of them; no words give none.
    """
    from xxhash import xxh3_64_intdigest

    words = raw.translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _B + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _CHUNK):
        low = np.minimum(low, (x[i : i + _CHUNK] * _MULTIPLY + _ADD).min(axis=1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    m = low[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * _B + m[:, r])
    return key.view(np.int64)


def packed_bits(low: np.ndarray) -> np.ndarray:
    """Two bits of each minimum (mixed first, as low bits of a linear hash are weak), 32 minima a long."""
    two = ((low * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.uint64) & np.uint64(3)
    return np.bitwise_or.reduce(two.reshape(LONGS, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether the number of shingles is odd in each of ``PARITIES`` slots, 64 slots a long."""
    slots = (hashes >> np.uint64(40)).astype(np.int64) & (PARITIES - 1)
    return np.packbits(np.bincount(slots, minlength=PARITIES).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def parities_allow(n: Column, percent: int, a: str, b: str) -> Column:
    """False only for sets, of ``n`` shingles together, whose parities ``{a}0..`` and ``{b}0..`` show that they differ too much.

    Of sets that differ by d shingles, 100 (n - d) >= percent (n + d) if they are similar.
    """
    differ = sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(len(ODD))), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * n


def estimate(a: str, b: str) -> Column:
    """Similarity of the classes whose packed longs are ``{a}0..`` and ``{b}0..``."""
    differ = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return (0.75 - differ / MINIMA) / 0.75


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, key, s0.., bands) of every row; n is 0 and the rest null for a text without words."""
    schema = f"id long, n long, key binary, {', '.join(f'{s} long' for s in BITS)}, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n, keys, bits, bands = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else b"", k)
                n.append(len(s))
                if len(s):
                    low = minima(s)
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bits.append(packed_bits(low))
                    bands.append(band_keys(low))
                else:
                    keys.append(None)
                    bits.append(np.zeros(LONGS, np.int64))
                    bands.append(None)
            columns = np.array(bits, np.int64).reshape(-1, LONGS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(columns[:, i]) for i in range(LONGS)), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "key", *BITS, "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "utf-8").alias("text")).mapInArrow(run, schema)


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, o0.., shingles) of (node, text): the set's parities, and the whole set as sorted longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_buffer().to_pybytes(), k) for x in batch.column(1)]
            odd = np.array([parities(x) for x in sets], np.int64).reshape(-1, len(ODD))
            sets = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(odd[:, i]) for i in range(len(ODD))), sets], ["node", *ODD, "shingles"])

    return texts.select("node", F.encode("text", "utf-8").alias("text")).mapInArrow(run, f"node long, {', '.join(f'{x} long' for x in ODD)}, shingles array<long>")


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all ``sets`` fall into each of ``SLOTS`` slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy() & (SLOTS - 1), minlength=SLOTS)
        slots = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(n[slots])], ["slot", "n"])

    got = sets.select("shingles").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(node, shingles) cut to the first n - ceil(n percent / 100) + 1 shingles, those of the least frequent slots first."""
    counts = slot_counts(sets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                x = x.values.to_numpy()
                order = np.lexsort((x, counts[x & (SLOTS - 1)]))
                out.append(x[order[: len(x) - -(-percent * len(x) // 100) + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["node", "shingles"])

    return sets.select("node", "shingles").mapInArrow(cut, "node long, shingles array<long>")


#: Rows of a key that meet in one task; a key with more is dealt over as many tasks as it needs.
HUB = 1000


def spread(many: DataFrame, few: DataFrame, key: str, by: str, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``, to be joined by it besides ``key``: rows of a frequent key of ``many`` are dealt by
    ``by``, and the rows of ``few`` with that key are copied for each deal. Frequent keys are few: one in ``HUB`` rows."""
    hubs = many.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB)
    hubs = scratch.write(hubs.select(F.col(key).alias("hub"), (F.floor(F.col("n") / HUB) + 1).alias("salts")), name)
    hubs = small(hubs, 16 * hubs.count())
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    dealt = many.join(hubs, F.col(key) == F.col("hub"), "left").withColumn("salt", F.pmod(F.xxhash64(by), salts)).drop("hub", "salts")
    copied = few.join(hubs, F.col(key) == F.col("hub"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("hub", "salts")
    return dealt, copied


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union; ``texts`` has (node, text).

    Many pairs may have one b; they are dealt over tasks, each of which gets its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[bytes, np.ndarray] = b"", np.empty(0, np.uint64)
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes()
                if y != kept[0]:
                    kept = y, shingle_set(y, k)
                s, t = shingle_set(x, k), kept[1]
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.encode("text", "utf-8").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.encode("text", "utf-8").alias("y"))
    dealt, right = spread(pairs.select("a", "b"), right, "b", "a", scratch, name)
    return dealt.join(left, "a").join(right, ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable over links), kept.

    A null or empty text has no shingles and no links. Ids are longs; a row with a null id has no links, a null
    component and stays. Rows with one id are one document, which is linked if any of its texts with words is. Classes
    of equal sets are linked without being expanded into pairs. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near_dedup")
    sigs = scratch.write(signatures(docs, k, id_col, text_col), "signatures")
    live = sigs.where("n > 0 AND id IS NOT NULL")
    classes = live.groupBy("key").agg(F.min("id").alias("node"), F.first("n").alias("n"), *(F.first(s).alias(s) for s in BITS), F.first("bands").alias("bands"))
    classes = scratch.write(classes, "classes")

    member = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low")).where("size > 1")
    met = scratch.write(member.join(buckets, "bucket"), "met")

    def side(name: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), *(F.col(s).alias(f"{name}{s[1:]}") for s in BITS))

    may = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (estimate("a", "b") >= percent / 100 - SLACK)

    # texts of the classes that a pair may need: those that met another
    wanted = met.select("node").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = scratch.write(texts.join(small(wanted, 16 * wanted.count()), "node", "left_semi"), "texts")
    tried, roots, steps = [], None, 0

    # ids that stand in several classes link them
    twice = live.groupBy("id").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 <> k1").select("id")
    again = live.join(twice, "id", "left_semi").join(classes.select("key", "node"), "key").select(F.col("id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()

    def link(pairs: DataFrame) -> bool:
        """Confirms pairs (a > b) that have not been tried and may be similar, and joins the components they connect."""
        nonlocal roots, steps
        steps += 1
        for old in tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = scratch.write(pairs.join(side("a"), "a").join(side("b"), "b").where(may).select("a", "b"), f"pairs{steps}")
        tried.append(pairs)
        return join_links(confirm(pairs, texts, k, percent, scratch, f"hubs{steps}"))

    def join_links(links: DataFrame) -> bool:
        nonlocal roots
        new = scratch.write(links, f"links{steps}")
        if roots is not None:
            if not new.limit(1).count():
                return False
            new = new.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = scratch.write(components(new, scratch, f"round{steps}_"), f"roots{steps}")
        return True

    def mixed(rows: DataFrame, key: str, name: str) -> DataFrame:
        """Rows (key, node) whose key has members of several components, with their component c."""
        rows = rows.join(roots, "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root")
        several = rows.groupBy(key).agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select(key)
        return scratch.write(rows.join(several, key), name)

    def largest(rows: DataFrame, key: str) -> DataFrame:
        """(key, c, rep, main, main_rep) of each component under each key, and the key's largest component."""
        own = rows.groupBy(key, "c").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("rep"))
        main = own.groupBy(key).agg(F.max(F.struct("size", "c", "rep")).alias("m")).select(key, F.col("m.c").alias("main"), F.col("m.rep").alias("main_rep"))
        return own.join(main, key)

    def ordered(a: str, b: str) -> list[Column]:
        return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]

    again = scratch.write(again, "again")
    if again.limit(1).count():
        join_links(again)
    shared = met.where("node <> low").groupBy("node", "low").agg(F.count(F.lit(1)).alias("times"))
    link(shared.groupBy("node").agg(F.max(F.struct("times", (-F.col("low")).alias("low"))).alias("m")).select(F.col("node").alias("a"), (-F.col("m.low")).alias("b")))
    rows = mixed(met.select("bucket", "node"), "bucket", "mixed0")
    if link(largest(rows, "bucket").where("c <> main").select(*ordered("rep", "main_rep")).distinct()):
        rows = mixed(met.select("bucket", "node"), "bucket", "mixed1")
    rest = scratch.write(rows.select("node").distinct(), "rest")
    if rest.limit(1).count():
        sets = scratch.write(full_sets(texts.join(rest, "node", "left_semi"), k), "sets")
        rows = mixed(rarest(sets, percent).select("node", F.posexplode("shingles").alias("at", "shingle")), "shingle", "by_shingle")
        rows = scratch.write(rows.join(classes.select("node", "n", *BITS), "node").join(sets.select("node", *ODD), "node"), "rows")
        main = largest(rows, "shingle").select("shingle", "main").distinct()
        a = rows.join(main, "shingle").where("c <> main").select("shingle", "main", *(F.col(x).alias(f"{x}_a") for x in ("node", "c", "n", "at")), *(F.col(x).alias(f"a{x[1:]}") for x in BITS), *(F.col(x).alias(f"oa{x[1:]}") for x in ODD))
        b = rows.select("shingle", *(F.col(x).alias(f"{x}_b") for x in ("node", "c", "n", "at")), *(F.col(x).alias(f"b{x[1:]}") for x in BITS), *(F.col(x).alias(f"ob{x[1:]}") for x in ODD))
        b, a = spread(b, a, "shingle", "node_b", scratch, "hot_shingles")
        once = (F.col("c_b") == F.col("main")) | (F.col("node_a") > F.col("node_b"))  # two outside members meet from either side
        # what two similar sets share begins with their first common shingle, so it is not far on in either
        left = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        near = (100 + percent) * left >= percent * (F.col("n_a") + F.col("n_b"))
        pairs = a.join(b, ["shingle", "salt"]).where((F.col("c_a") != F.col("c_b")) & once & near & parities_allow(F.col("n_a") + F.col("n_b"), percent, "oa", "ob") & may).select(*ordered("node_a", "node_b")).distinct()
        link(pairs)

    of_class = classes.select("node", "key").join(roots.where("node <> root"), "node").select("key", "root")
    named = classes.select("key", "node").join(of_class, "key", "left").select("key", F.coalesce("root", "node").alias("component_id"))
    out = sigs.join(named, "key", "left").withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    for name in ("met", "texts", "sets", "mixed0", "mixed1", "by_shingle", "rows"):
        scratch.drop(name)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component those with the smallest id.

    An id goes with all its rows. Nulls, empty and repeated rows are as in :func:`near_duplicates`.
    """
    found = near_duplicates(docs, k, percent, id_col, text_col)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("gone")).distinct()
    gone = Scratch(docs.sparkSession, "near_gone").write(gone, "ids")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own"))
    return rows.join(small(gone, 16 * gone.count()), F.col("own") == F.col("gone"), "left_anti").select("row.*")
