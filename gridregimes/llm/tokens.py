"""Token ids by the tokenizers library, with a bounded memory of recurring words.

Byte-level BPE cuts a text into words (with the space before them), numbers, signs and white space, and codes each by
itself; they recur, so the library's BPE model is asked once for each while it is remembered. The cuts are made here
for texts of ASCII and the letters of Latin-1. Such texts come in batches: Arrow cuts them and finds the different words,
each of which is looked up once for the batch. Other texts are cut before every space that a visible character follows,
which is a cut of the tokenizer's too, and the pieces with other characters go to the whole tokenizer, as its notion of
a letter is its own affair.
"""

from __future__ import annotations

import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: Before a space that a letter, digit or visible ASCII character follows.
_CUT = re.compile(r"(?= [\w!-~])")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIGNS = r"!-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[\t\n\r -~{_LETTERS}]*")
#: Fixed value: the byte-level pre-tokenizer's pattern, for plain characters.
_WORD = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
#: The same without looking ahead, for texts without loose spaces. White space is taken with the word it precedes, as the
#: pattern above splits a run by what follows it.
_TAIL = rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]+|[{_SIGNS}]+"
_CUTS = rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|[\t\n\r]+(?:{_TAIL})?"
#: A space that no visible character follows.
_LOOSE = re.compile(r" (?!\S)")
#: _Words that a process remembers: those seen twice in two generations of ``REPEATED`` at most, and the last new ones.
#: A word takes some 130 bytes, so all take 52 MB at most. Longer words than ``LONGEST`` characters are not remembered.
REPEATED, NEW, LONGEST = 150_000, 100_000, 32
#: Bytes of text encoded at once (or one longer text).
AT_ONCE = 2 << 20

def byte_names() -> str:
    """Byte-level BPE writes a byte as its Latin-1 character if that is visible, else as the next one from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return "".join(chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256))


class _Words(dict):
    """Ids of words, as bytes, from ``ask``.

    Half of all different words occur once, so a new word is kept apart and moves here when it is seen again. When this
    dictionary is full it becomes the older generation, from which words still in use move back.
    """

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self.ask = ask
        self.old: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.pop(word, None) or self.new.pop(word, None)
        if ids is None:
            ids = self.ask(word)
            if len(word) <= LONGEST:
                if len(self.new) >= NEW:
                    self.new.clear()
                self.new[word] = ids
            return ids
        if len(self) >= REPEATED:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _dtype(tokenizer: object) -> np.dtype:
    return np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.dtype = _dtype(t)
        pre = t.pre_tokenizer
        self.by_word = t.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space
        self.model, self.code, self.names = t.model, {2: "H", 4: "I"}[self.dtype.itemsize], byte_names()
        self.words = _Words(self._ask)
        self.marks = re.compile("|".join(re.escape(x.content) for x in t.get_added_tokens_decoder().values()) or r"(?!)")

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _ask(self, word: str) -> bytes:
        if len(word) > 1 and word[0] in "\t\n\r":
            parts = _WORD.findall(word)
            if len(parts) > 1:
                return b"".join([self.words[x] for x in parts])
        name = charmap_decode(word.encode(), "strict", self.names)[0]
        return array(self.code, [x.id for x in self.model.tokenize(name)]).tobytes()

    def _plain(self, text: str) -> bool:
        return bool(_PLAIN.fullmatch(text)) and not self.marks.search(text)

    def _slow(self, text: str) -> bytes:
        if not self.by_word:
            return self._encode(text)
        return b"".join(b"".join(map(self.words.__getitem__, _WORD.findall(x))) if self._plain(x) else self._encode(x) for x in _CUT.split(text))

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; of a tokenizer that is not byte-level BPE straight from the library."""
        return self.batch(pa.array([text], pa.string()))[0]

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each whole text; a null counts as empty."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        out, k = [], 0
        while k < len(texts):
            n = max(int(np.searchsorted(ends, (ends[k - 1] if k else 0) + AT_ONCE, "right")), k + 1)
            out += self._some([x or "" for x in texts[k:n].to_pylist()])
            k = n
        return out

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        simple = [k for k, x in enumerate(texts) if self.by_word and self._plain(x) and not _LOOSE.search(x)]
        out: list = [None] * len(texts)
        for k in set(range(len(texts))).difference(simple):
            out[k] = np.frombuffer(self._slow(texts[k]), self.dtype)
        if not simple:
            return out
        marked = pc.replace_substring_regex(pa.array([texts[k] for k in simple], pa.string()), _CUTS, "\0\\0")
        cut = pc.split_pattern(marked, "\0")  # each text begins with an empty word
        edges = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        at = coded.indices.to_numpy()
        own = list(map(self.words.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        size = np.fromiter(map(len, own), np.int64, len(own)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        ids = np.frombuffer(b"".join(own), self.dtype)
        n = size[at]
        ends = np.cumsum(n)
        ids = ids[np.repeat(begin[at] - (ends - n), n) + np.arange(int(ends[-1]))]
        bounds = np.r_[0, ends][edges]
        for i, k in enumerate(simple):
            out[k] = ids[bounds[i] : bounds[i + 1]]
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each process and file; workers that are used again keep it until another operator needs them."""
    return held(("encoder", path), lambda: Encoder(path))


def id_type(path: str) -> np.dtype:
    """The type of an encoder's ids."""
    from tokenizers import Tokenizer

    return _dtype(Tokenizer.from_file(path))


def binaries(parts: list[np.ndarray] | list[bytes]) -> pa.Array:
    return pa.array([p if isinstance(p, bytes) else p.tobytes() for p in parts], pa.binary())
