"""Fill-in-middle: texts cut into prefix, middle and suffix, reordered in place, and put back exactly.

Units of a text are runs of ASCII letters and single other characters. Two cuts between units are drawn from a hash of
the document's id, as are the form and whether the text stays plain, so a document's result never depends on where or
when it is computed. The text's bytes stand in a bytearray: the three sentinels are inserted in the order of the text
(``<P>`` prefix ``<M>`` middle ``<S>`` suffix), and neighbouring segments change places by three reversals in place. The
way back finds the sentinels, exchanges the segments again and takes the sentinels out.

Forms: ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle), ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle) and
``plain`` (the text itself).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks the three parts, and the seed that the draws are hashed with.
P, M, S = b"<P>", b"<M>", b"<S>"
SEED = 1
#: Bytes that a reversal holds beside the array.
AT_ONCE = 1 << 16
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers for a document."""
    found = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(found[k : k + 4], "big") for k in (0, 4, 8, 12))


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which units of a UTF-8 text begin."""
    lower = data | 0x20
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(begins)


def _reverse(a: np.ndarray) -> None:
    """Reverses in place, block by block from both ends."""
    i, j = 0, len(a)
    while j - i > 1:
        k = min(AT_ONCE, (j - i) // 2)
        left = a[i : i + k].copy()
        a[i : i + k] = a[j - k : j][::-1]
        a[j - k : j] = left[::-1]
        i, j = i + k, j - k


def rotate(data: bytearray, begin: int, cut: int, end: int) -> None:
    """Exchanges data[begin:cut] and data[cut:end] in place: each is reversed, then both together."""
    a = np.frombuffer(data, np.uint8)
    for i, j in ((begin, cut), (cut, end), (begin, end)):
        _reverse(a[i:j])


def transform(text: str, key: str, seed: int = SEED, plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text.

    ``plain_from`` of a hundred texts are changed, ``spm_below`` of a hundred of those to ``spm``. An empty text and one
    that holds a sentinel's string stay plain.
    """
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts = unit_starts(data)
    n = len(starts)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= plain_from or P in raw or S in raw or M in raw:
        return n, "plain", None, None, text
    first, second = (int(starts[k]) if k < n else len(raw) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    chars = (data & 0xC0) != 0x80
    out = bytearray(raw)
    out[second:second] = S
    out[first:first] = M
    out[0:0] = P
    middle, suffix = first + len(P), second + len(P) + len(M)
    if h4 % 100 < spm_below:
        form = "spm"
        rotate(out, 0, suffix, len(out))
    else:
        form = "psm"
        rotate(out, middle, suffix, len(out))
    return n, form, int(chars[:first].sum()), int(chars[first:second].sum()), out.decode()


def restore(output: str, form: str) -> str:
    """The text that ``transform`` was given, from its output and form."""
    if form == "plain":
        return output
    out = bytearray(output.encode())
    if form == "spm":
        rotate(out, 0, out.index(P), len(out))
    else:
        rotate(out, out.index(S), out.index(M), len(out))
    for mark in (S, M, P):  # they stand in the order of the text again: the last is taken out first
        k = out.index(mark)
        del out[k : k + len(mark)]
    return out.decode()


def fill_in_middle(key: Column, text: Column, seed: int = SEED, plain_from: int = 90, spm_below: int = 20) -> Column:
    """A struct of ``FIELDS`` for each row, from its key (a null one counts as an empty string) and whole text.

    A null text is an empty one: plain, no units. Equal rows get equal results. Row by row: nothing is shuffled.
    """

    @F.pandas_udf(FIELDS)
    def apply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FIELDS.split(", ")]
        for keys, texts in parts:
            rows = [transform(t, k, seed, plain_from, spm_below) for k, t in zip(keys, texts)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return apply(F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def restore_text(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone."""

    @F.pandas_udf("string")
    def apply(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return apply(output, form)


def fim_documents(docs: DataFrame, seed: int = SEED, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """All columns of ``docs`` and one more, ``fim`` (a struct of ``FIELDS``), in place of one of that name.

    An empty table gives none.
    """
    return docs.withColumn("fim", fill_in_middle(F.col("doc_id"), F.col("text"), seed, plain_from, spm_below))
