"""Words of dirty texts: runs of letters or digits without case, accents, character width and invisible characters."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_RUN = re.compile(r"[^\W_]+")
#: Letters that show nothing: Hangul fillers.
_BLANK_LETTERS = {0x115F: None, 0x1160: None, 0x3164: None, 0xFFA0: None}


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text.translate(_BLANK_LETTERS)).casefold())
    return "".join(c for c in text if c.isascii() or unicodedata.category(c) not in ("Mn", "Me", "Cf"))


def words(text: str | None) -> list[str]:
    return _RUN.findall(folded(text)) if text else []


class WordHashes:
    """32-bit hashes of words, never 0; a word met before isn't hashed again."""

    def __init__(self, kept: int = 500_000):
        self.known: dict[str, int] = {}
        self.kept = kept

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.kept:
            known.clear()
        out = []
        for w in found:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) or 1
            out.append(h)
        return np.array(out, dtype=np.uint32)
