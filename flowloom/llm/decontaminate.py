"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and everything between letters and digits
becomes one space. An item of m characters may be changed by k = floor(rate * m)
edits. Cut into k + 1 pieces, at least one piece of it survives in every match,
so exact piece hits (Aho-Corasick) find every candidate place. Each place is
verified with Myers' bit-parallel edit distance on a window that covers all
matches through that hit.

The items are read in blocks of at most ``BLOCK_CHARS`` characters; each block
is sent to the workers and all texts are read once per block.

Null texts and items count as empty. An empty item matches nothing. Repeated
items match each on its own; repeated documents give repeated rows. Offsets are
code points of the original text. Of several places of one item in one text,
the one with the fewest edits, then the first, is returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import release_arrow

RATE = 0.05
BLOCK_CHARS = 4_000_000
_BETWEEN = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _BETWEEN.sub(" ", text.lower()).strip()


def places(text: str) -> list[int]:
    """Original position of each character of ``normal(text)``."""
    out: list[int] = []
    pending = None
    for at, original in enumerate(text):
        for c in original.lower():
            if _BETWEEN.fullmatch(c):
                pending = at if pending is None else pending
            else:
                if pending is not None and out:
                    out.append(pending)
                pending = None
                out.append(at)
    return out


def distances(pattern: str, text: str, anchored: bool = False) -> list[int]:
    """Edit distance of the pattern to the best part of the text ending at each place.

    ``anchored`` parts start at the start of the text.
    """
    size = len(pattern)
    full, top = (1 << size) - 1, 1 << (size - 1)
    where: dict[str, int] = {}
    for place, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << place
    plus, minus, score, out = full, 0, size, []
    for c in text:
        equal = where.get(c, 0)
        vertical = equal | minus
        equal |= ((equal & plus) + plus) ^ plus
        up = minus | ~(equal | plus) & full
        down = plus & equal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) | anchored
        down <<= 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        out.append(score)
    return out


class ItemMatcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.items: list[tuple[int, str, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            pattern = normal(text or "")
            if not pattern:
                continue
            edits = min(int(rate * len(pattern)), len(pattern) - 1)
            number = len(self.items)
            self.items.append((item_id, pattern, edits))
            cuts = [len(pattern) * i // (edits + 1) for i in range(edits + 2)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(pattern[start:end], []).append((number, start))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def _verify(self, text: str, number: int, begin: int) -> tuple[int, int, int] | None:
        """Edits, start and end of the best match through a hit."""
        _, pattern, edits = self.items[number]
        if text.startswith(pattern, max(begin, 0)) and begin >= 0:
            return 0, begin, begin + len(pattern)
        low = max(0, begin - edits)
        window = text[low : begin + len(pattern) + edits]
        if not window:
            return None
        scores = distances(pattern, window)
        best = min(scores)
        if best > edits:
            return None
        end = scores.index(best) + 1
        back = distances(pattern[::-1], window[:end][::-1], anchored=True)
        return best, low + end - (back.index(best) + 1) if best in back else low, low + end

    def find(self, original: str) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of each item found."""
        if not self.items or not original:
            return []
        text = normal(original)
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (length, uses) in self.automaton.iter(text):
            for number, offset in uses:
                begin = last - length + 1 - offset
                if (number, begin) in tried or best.get(number, (1,))[0] == 0:
                    continue
                tried.add((number, begin))
                found = self._verify(text, number, begin)
                if found and found < best.get(number, (len(text) + 1,)):
                    best[number] = found
        if not best:
            return []
        where = places(original)
        return [
            (self.items[n][0], edits, where[start], where[end - 1] + 1)
            for n, (edits, start, end) in sorted(best.items())
        ]


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and item found in it: key, item id, edits, span_start, span_end."""
    texts = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    out = None
    for search in _searches(items, item_key, item_text, rate, block_chars):
        hits = texts.select("__key", F.explode(search("__text")).alias("m"))
        out = hits if out is None else out.unionByName(hits)
    return out.select(
        F.col("__key").alias(key),
        F.col("m.item").alias("item_id"),
        F.col("m.edits").alias("edits"),
        F.col("m.span_start").alias("span_start"),
        F.col("m.span_end").alias("span_end"),
    )


def without_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows that hold no item. Each is judged by its own text, whatever its key, and nothing is shuffled."""
    out = docs
    for search in _searches(items, item_key, item_text, rate, block_chars):
        out = out.filter(F.size(search(F.col(text).cast("string"))) == 0)
    return out


def _searches(items: DataFrame, item_key: str, item_text: str, rate: float, block_chars: int) -> Iterator:
    """A search for the items of each block of about ``block_chars`` characters."""
    spark = items.sparkSession
    items = items.select(
        F.col(item_key).cast("bigint").alias("i"),
        F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"),
    ).filter(F.col("i").isNotNull())
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        yield _searcher(spark.sparkContext.broadcast(sorted(tuple(r) for r in part.collect())), rate)


def _searcher(shared, rate: float):
    @F.pandas_udf("array<struct<item: bigint, edits: int, span_start: int, span_end: int>>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = ItemMatcher(shared.value, rate).find
        names = ("item", "edits", "span_start", "span_end")
        for texts in batches:
            found = [[dict(zip(names, m, strict=True)) for m in find(t or "")] for t in texts]
            yield pd.Series(found, dtype=object)
        release_arrow()

    return search
