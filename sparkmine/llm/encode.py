"""Token ids of whole texts by a byte-level BPE of the tokenizers library, quick on repeated words.

The pre-tokenizer of such a vocabulary never joins what a single space between two other characters parts, nor what
a single newline between two other characters parts. So a text is cut there, each distinct unit is encoded by the
library once per worker, and a text's ids are its units' ids in order.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np

#: White space other than space and newline, as str.split() takes it.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of one generation of the store, about; two are held, and longer units aren't kept. ENTRY: what Python takes beside.
#: A smaller store gives the same ids, at a fifth more time for a third of the size.
KEPT, LONGEST, ENTRY = 128 << 20, 40, 200
#: What may end a unit behind a letter or digit; the pre-tokenizer always cuts before it.
_ENDS = ".,;:!?\"#$%&*()[]{}/+-=_~^`@"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class _Store(dict):
    """unit -> its ids as bytes; what is missing is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        return self.encode(unit)


class Encoder:
    """ids(texts): the ids of each text as bytes of dtype, little-endian; store: bytes of a generation."""

    def __init__(self, path: str, store: int = KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = byte_letters()
        self.store, self.kept, self.older, self.held = store, _Store(self.unit), {}, 0

    @staticmethod
    def units(text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or _ODD.search(text):
            first, *rest = _BETWEEN.split(text)
            return [first, *[" " + x for x in rest]]
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if "\0" not in text else [text]

    def unit(self, unit: str) -> bytes:
        raw = self.older.get(unit)
        if raw is None:
            stem = unit.rstrip(_ENDS)
            if len(stem) < len(unit) and stem[-1:].isalnum():
                raw = self.kept[stem] + self.kept[unit[len(stem) :]]
            elif unit.isalpha() or (unit[:1] == " " and unit[1:].isalpha()):  # one word: the pre-tokenizer has nothing to cut
                raw = array(self.code, [t.id for t in self.word(unit.encode().decode("latin-1").translate(self.letters))]).tobytes()
            else:
                raw = array(self.code, self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        if len(unit) <= LONGEST:
            self.kept[unit] = raw
            self.held += ENTRY + len(unit) + len(raw)
        return raw

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for t in texts:
            if self.held > self.store:
                self.older, self.kept, self.held = self.kept, _Store(self.unit), 0
            out.append(b"".join(map(self.kept.__getitem__, self.units(t or ""))))
        return out


def encoder(path: str, store: int = KEPT) -> Encoder:
    """The worker's own; a tokenizer is loaded once per worker."""
    from sparkmine.llm.common import worker_cache

    cache = worker_cache("encode")
    if (path, store) not in cache:
        cache[path, store] = Encoder(path, store)
    return cache[path, store]


def batches(texts: list, chars: int = 1 << 20):
    """Ranges of texts of about so many characters, so that memory is bounded by one text or that much."""
    at = n = 0
    for i, t in enumerate(texts):
        n += len(t or "") + 64
        if n >= chars:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
