"""Benchmark passages in documents, found by one Aho-Corasick automaton over normalised words.

Words are runs of ASCII letters and digits and of all non-ASCII characters, with A-Z lower-cased. Every run of ``window``
words of a benchmark item is a pattern (an item with fewer words is one pattern), written with a space before, between
and after its words. A document is normalised to the same form, scanned once, and its hits are mapped back to word
numbers and, for the documents that have any, to offsets in the original text.

The automaton is built in each worker from the benchmark's texts. Their size is counted first: a benchmark over
``max_bytes`` is split into groups of items under that size, and the documents pass once over each group's automaton,
with the hits so far carried along in a table, so memory stays bounded and nothing is left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held

MAX_BENCHMARK_BYTES = 8 << 20
#: Byte for byte: A-Z to a-z, other ASCII outside letters and digits to a space, the rest as it is.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def patterns(items: list[tuple[str, str | None]], window: int) -> dict[bytes, list[int]]:
    """Pattern to the numbers of the items that have it."""
    found: dict[bytes, list[int]] = {}
    for k, (_, text) in enumerate(items):
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            own = found.setdefault(b" " + b" ".join(w[i : i + window]) + b" ", [])
            if not own or own[-1] != k:
                own.append(k)
    return found


def automaton(items: list[tuple[str, str | None]], window: int) -> object:
    """One for each process and benchmark; its values are (words in the pattern, item numbers)."""

    def build() -> object:
        import ahocorasick

        built = ahocorasick.Automaton()
        for pattern, own in patterns(items, window).items():
            built.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, own))
        if len(built):
            built.make_automaton()
        return built

    return held(("automaton", hashlib.sha256(repr((items, window)).encode()).hexdigest()), build)


def scan(text: str | None, built: object) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(number of words, hit word ranges [first, last], item numbers)."""
    w = words(text)
    spans, items = [], set()
    if w and len(built):
        line = (b" " + b" ".join(w) + b" ").decode("latin-1")
        at = seen = 0
        for end, (k, own) in built.iter(line):
            seen += line.count(" ", at, end)
            at = end
            spans.append((seen - k, seen - 1))
            items.update(own)
    return len(w), spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points [start, end) in the original text of word ranges in ascending order."""
    raw = text.encode()
    place = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    out, chars, at = [], 0, 0
    for a, b in spans:
        chars += len(raw[at : place[a][0]].decode())
        begin, at = chars, place[a][0]
        chars += len(raw[at : place[b][1]].decode())
        at = place[b][1]
        out.append((begin, chars))
    return out


def _groups(benchmark: DataFrame, max_bytes: int, item_col: str, text_col: str) -> Iterator[tuple[list[tuple[str, str | None]], bool]]:
    """The items in groups of ``max_bytes`` at most (or of one item), each fetched when it is asked for, and whether it is the last."""
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    size = b.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-2 * size // max_bytes)) if size > max_bytes else 1
    group = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        yield sorted((r["item"], r["text"]) for r in b.where(group == k).toLocalIterator()), k == n - 1


_FOUND = "struct<n_words:long,n_hit:long,items:array<string>,words:array<struct<a:long,b:long>>,spans:array<struct<start:long,end:long>>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("words", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _looker(items: list[tuple[str, str | None]], window: int) -> Callable[..., Column]:
    """A column function of text and what was found in it before."""

    def look(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        built = automaton(items, window)
        for texts, before in batches:
            rows = []
            for text, old in zip(texts, before, strict=True):
                text, old = text.as_py(), old.as_py() or {"words": [], "items": []}
                n, spans, own = scan(text, built)
                spans = merge(spans + [(x["a"], x["b"]) for x in old["words"]])
                ids = {items[i][0] for i in own} | set(old["items"])
                places = offsets(text, spans) if spans else []
                rows.append({"n_words": n, "n_hit": sum(b - a + 1 for a, b in spans), "items": sorted(ids), "words": [{"a": a, "b": b} for a, b in spans], "spans": [{"start": a, "end": b} for a, b in places]})
            yield pa.array(rows, _ARROW)

    return F.arrow_udf(look, _FOUND)


def find_benchmark_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = MAX_BENCHMARK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` and ``found`` (replaced if there): n_words, n_hit, items (ids as sorted strings), spans.

    ``spans`` are code points [start, end) of the original text, merged. A null or empty text has no words; an empty
    benchmark hits nothing; items with a null id or text are ignored; of items repeated with one id all texts count.
    """
    spark = docs.sparkSession
    out, found_at = docs, None
    for k, (items, last) in enumerate(_groups(benchmark, max_bytes, item_col, item_text_col)):
        out = out.withColumn("found", _looker(items, window)(F.col(text_col), F.col("found") if k else F.lit(None).cast(_FOUND)))
        if not last:
            found_at = found_at or Scratch(spark, "decontaminate")
            out = found_at.write(out, f"group{k}")
    return out.withColumn("found", F.col("found").dropFields("words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of the benchmark occurs."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    found = find_benchmark_passages(rows, benchmark, window)
    return found.where(F.col("found.n_hit") == 0).select("row.*")
