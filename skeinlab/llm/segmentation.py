"""Splitting oversized texts at topic boundaries found by lexical cohesion."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinlab.llm.bpe import TOKENIZERS, Transducer, transducer

LIMIT = 512
OVERLAP = 64
#: A piece has at least this share of the limit (the overlap's share) where a natural end beyond it is in the window.
FROM = 0.125
#: Words on either side of a gap whose likeness is measured.
BLOCK = 40

PIECES = "doc_id long, piece int, start_char long, end_char long, n_tokens long, shared_tokens long, text string"

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ENDS = regex.compile(r"[.!?…。！？]['\")\]”’]*$")
_CLAUSE = regex.compile(r"[,;:)\]，；：、]$")

_FULL_STOPS = ("。", "！", "？")

# Grades of a gap, best last.
INSIDE, ANY, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(7)


class Units:
    """What is known of a piece of text that is kept together, kept per worker for pieces met before."""

    KEPT = 200_000

    def __init__(self) -> None:
        self.known: dict[str, tuple[tuple[str, ...], bool, bool, bool, int]] = {}

    def __call__(self, unit: str) -> tuple[tuple[str, ...], bool, bool, bool, int]:
        """Its words, whether a sentence, a clause ends with it, whether it is blank, and its line breaks."""
        found = self.known.get(unit)
        if found is None:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            blank = not unit.strip()
            found = self.known[unit] = (
                tuple(w.lower() for w in _WORD.findall(unit)), bool(_ENDS.search(unit)), bool(_CLAUSE.search(unit)), blank, unit.count("\n") + unit.count("\r") if blank else 0,
            )
        return found


def _units(machine: Transducer, words: list[tuple[str, tuple[int, ...]]], most: int) -> tuple[list[str], list[int], bool]:
    """Pieces of text that may be kept together with their token counts, and whether they are all whole words; only
    words over `most` tokens are cut up, and then between characters."""
    parts, sizes, whole = [], [], True
    for word, ids in words:
        if len(ids) <= most:
            parts.append(word)
            sizes.append(len(ids))
            continue
        whole = False
        held, n = b"", 0
        for i in ids:
            held, n = held + machine.token_bytes[i], n + 1
            try:
                piece = held.decode("utf-8")
            except UnicodeDecodeError:
                continue
            parts.append(piece)
            sizes.append(n)
            held, n = b"", 0
    return parts, sizes, whole


def _grades(parts: list[str], about: list[tuple]) -> list[int]:
    """Grade of the gap before each unit: a unit with leading space or a line break starts anew."""
    grades, quiet, lines, last = [PARAGRAPH], False, 0, -1
    for i in range(1, len(parts)):
        _, _, _, blank, breaks = about[i - 1]
        if blank:
            lines += breaks
            quiet = True
        else:
            last, lines, quiet = i - 1, 0, False
        if about[i][3]:
            grades.append(INSIDE)
        elif lines >= 2:
            grades.append(PARAGRAPH)
        elif lines:
            grades.append(LINE)
        elif quiet or parts[i][0].isspace():
            grades.append(SPACE if last < 0 else SENTENCE if about[last][1] else CLAUSE if about[last][2] else SPACE)
        else:
            grades.append(SENTENCE if last >= 0 and parts[last] in _FULL_STOPS else ANY)
    return grades


def valley_depths(words: list[str], at: list[int], block: int = BLOCK) -> list[float]:
    """For each gap (a position in words, ascending) how deep the cosine likeness of the blocks around it lies below the
    peaks beside it. Both blocks slide over the words, so the work is one step a word."""
    left_of, right_of = Counter(), Counter(words[:block])
    dot, left_sq, right_sq = 0, 0, sum(n * n for n in right_of.values())
    sims, p = [], 0
    for gap in at:
        while p < gap:
            w = words[p]
            n, m = left_of[w], right_of[w]  # w goes from the right block to the left one
            dot += (n + 1) * (m - 1) - n * m
            left_sq += 2 * n + 1
            right_sq -= 2 * m - 1
            left_of[w], right_of[w] = n + 1, m - 1
            if p >= block:
                w = words[p - block]
                n = left_of[w]
                dot -= right_of[w]
                left_sq -= 2 * n - 1
                left_of[w] = n - 1
            if p + block < len(words):
                w = words[p + block]
                m = right_of[w]
                dot += left_of[w]
                right_sq += 2 * m + 1
                right_of[w] = m + 1
            p += 1
        sims.append(dot / sqrt(left_sq * right_sq) if left_sq and right_sq else 0.0)
    n = len(sims)
    left, right = sims[:], sims[:]
    for i in range(1, n):  # the peak is climbed to without a step down
        if sims[i - 1] >= sims[i]:
            left[i] = max(sims[i - 1], left[i - 1])
    for i in range(n - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            right[i] = max(sims[i + 1], right[i + 1])
    return [left[i] + right[i] - 2 * sims[i] for i in range(n)]


def split_text(machine: Transducer, text: str, limit: int = LIMIT, overlap: int = OVERLAP, units: Units | None = None, found: list | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, tokens, shared tokens) of ordered pieces of text; positions are characters.

    Every piece encodes to at most limit tokens, together they cover the text, and each starts at most overlap tokens
    before the end of the last. The cut is the deepest cohesion valley at a paragraph, line or sentence end in the size
    window, of equally deep ones that of the better grade and then the later one; without any such end it is the last
    clause, space or other gap.
    """
    units = units or Units()
    parts, sizes, whole = _units(machine, list(machine.words(text)) if found is None else found, max(1, min(OVERLAP // 2, limit // 8)))
    n = len(parts)
    about = [units(p) for p in parts]
    chars, tokens, words_before, words = [0], [0], [0], []
    for unit, size, known in zip(parts, sizes, about):
        words.extend(known[0])
        chars.append(chars[-1] + len(unit))
        tokens.append(tokens[-1] + size)
        words_before.append(len(words))
    if tokens[-1] <= limit:
        yield 0, len(text), tokens[-1], 0
        return
    grades = _grades(parts, about)
    natural = [i for i in range(1, n) if grades[i] >= SENTENCE]
    depth = dict(zip(natural, valley_depths(words, [words_before[i] for i in natural])))

    def count(a, b):
        """Tokens of units a to b encoded by themselves. Where no word is cut up, words keep their tokens in any piece,
        but for blanks at its end, which run together."""
        if not whole:
            return sum(len(ids) for _, ids in machine.words(text[chars[a] : chars[b]]))
        c = b
        while c > a and about[c - 1][3]:
            c -= 1
        return tokens[c] - tokens[a] + (sum(len(ids) for _, ids in machine.words(text[chars[c] : chars[b]])) if c < b else 0)

    start, last_end = 0, 0
    while True:
        end = bisect_right(tokens, tokens[start] + limit) - 1
        end = min(max(end, start), n)
        if end < n:
            first = max(last_end + 1, start + 1)
            from_on = max(first, bisect_left(tokens, tokens[start] + FROM * limit))
            best = [i for i in range(from_on, end + 1) if grades[i] >= SENTENCE] or [i for i in range(first, end + 1) if grades[i] >= SENTENCE]
            if best:
                end = max(best, key=lambda i: (depth[i], grades[i], i))
            else:
                end = max(range(max(first, bisect_left(tokens, tokens[start] + limit / 2)), end + 1) or [end], key=lambda i: (grades[i], i))
        size = count(start, end)
        while size > limit and end > last_end + 1:  # a piece cut inside a word may encode to more than it did within it
            end -= 1
            size = count(start, end)
        shared = count(start, last_end) if start < last_end else 0
        yield chars[start], chars[end], size, shared
        if end >= n:
            return
        last_end = end
        near = max(start + 1, bisect_left(tokens, tokens[end] - overlap))
        back = [i for i in range(near, end) if grades[i] >= SENTENCE] or [i for i in range(near, end) if grades[i] >= SPACE] or [i for i in range(near, end) if grades[i] > INSIDE] or [*range(near, end)]
        start = next((i for i in back if count(i, end) <= overlap), end)


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, folder: str = TOKENIZERS) -> DataFrame:
    """Ordered pieces of every text longer than limit tokens: doc_id, piece, start_char, end_char, n_tokens,
    shared_tokens, text.

    Whole texts are read; shorter, empty and null ones have no pieces. shared_tokens is what a piece has in common
    with the last one. Repeated rows give repeated pieces. No shuffle: a text is cut where it is read.
    """
    if limit < 32 or not 0 <= overlap < limit // 2:
        raise ValueError("limit must be at least 32 tokens and overlap under half of it")

    def cut(batches):
        machine, units = transducer(folder), Units()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.doc_id, batch.text):
                if not text or len(text.encode("utf-8")) <= limit:
                    continue
                found = list(machine.words(text))
                if sum(len(ids) for _, ids in found) <= limit:
                    continue
                for k, (a, b, n, shared) in enumerate(split_text(machine, text, limit, overlap, units, found)):
                    rows.append((doc_id, k, a, b, n, shared, text[a:b]))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start_char", "end_char", "n_tokens", "shared_tokens", "text"])

    return documents.select("doc_id", "text").mapInPandas(cut, PIECES)


def rebuilt(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id and text of every document with a text, from its pieces where it has any: what each adds to the last."""
    last_end = F.coalesce(F.lag("end_char").over(Window.partitionBy("doc_id").orderBy("piece")), F.lit(0))
    added = pieces.withColumn("added", F.substring("text", (last_end - F.col("start_char") + 1).cast("int"), F.length("text")))
    whole = added.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "added"))), lambda x: x.added), "").alias("joined"))
    return documents.where("text is not null").select("doc_id", "text").join(whole, "doc_id", "left").select("doc_id", F.coalesce("joined", "text").alias("text"))
