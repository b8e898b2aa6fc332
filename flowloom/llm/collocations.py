"""Phrase collocations by marginalising the longest windows.

Each word position of a piece gives one window: the word and up to ``MOST - 1``
words behind it (the lead columns), padded with nulls at the end of the piece. A
phrase occurs as often as windows begin with it, so the counts of all lengths are
the sums of ``ROLLUP (lang, w1, .., w5)`` over windows that were counted once.

Before, windows are cut where no phrase with ``least`` occurrences can go on: at
a word, then behind a pair of words, that is too rare. Which ones are is told by
two bit filters of at most 2^``FILTER_BITS`` bits, made of the hashes whose
occurrences reach ``least``. A rare pair that shares a bit, or a hash, with a
frequent one passes, and is counted exactly by the windows. So filters decide
what is shuffled, never a result.

Pieces, words and lower case are those of :data:`SEPARATORS`; a null text is
empty, a null language ``und``. Repeated rows count each. Texts are read whole,
in segments: the words behind a cut inside a piece are read with the segment in
front of it. Score of a cut of a phrase with a occurrences into parts with l and
r: ``floor(scale * a * n / (l * r))`` with n words in the language, in decimals
of 38 digits (a * n * scale below 10^38). Scores tie to more occurrences, then to
the smaller phrase. An empty table has no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import stored

UNKNOWN_LANGUAGE = "und"
MOST = 5
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Largest size of a filter (16 MB), and bits of it for each hash if that leaves it smaller.
FILTER_BITS, BITS_PER_HASH = 27, 16
#: Bytes of text taken at a time; bounds memory, not results.
SEGMENT_BYTES = 4_000_000
#: A language's batch of counts is sent on beyond this many words.
WORDS_PER_BATCH = 400_000
#: Join keys that the requests for the count of a part are dealt to, by words of the part.
SALTS = {1: 64, 2: 8}
#: Parts of a language that are ranked apart.
PARTS = 64

_ENDS = bytes.maketrans(SEPARATORS, b"." * len(SEPARATORS))
_CUT = re.compile(b"[" + re.escape(SEPARATORS) + b"]")
_SPACE = re.compile(rb"[ \t]")
_NEXT_WORDS = re.compile(rb"(?:[ \t]+[^ \t" + re.escape(SEPARATORS) + rb"]+){0,%d}" % (MOST - 1))


class Segment(NamedTuple):
    """Words of some whole pieces; b"." ends each piece. Windows begin at the first ``own`` words."""

    words: list[bytes]
    own: int


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(_ENDS).replace(b".", b" . ").split()


def segments(data: bytes, size: int = SEGMENT_BYTES) -> Iterator[Segment]:
    """The text in segments of about ``size`` bytes, cut behind a piece or, in very long pieces, in front of a space."""
    at = 0
    while at < len(data):
        if len(data) - at <= size:
            found = words_of(data[at:])
            yield Segment([*found, b"."], len(found))
            return
        end = _CUT.search(data, at + size, at + 2 * size)
        if end:
            found = words_of(data[at : end.end()])
            yield Segment(found, len(found))
            at = end.end()
            continue
        space = _SPACE.search(data, at + size)
        stop = space.start() if space else len(data)
        if (sign := _CUT.search(data, at + size, stop)) is not None:
            stop = sign.start()
        found = words_of(data[at:stop])
        behind = words_of(_NEXT_WORDS.match(data, stop)[0])
        yield Segment([*found, *behind, b"."], len(found))
        at = stop


class Filter:
    """Bits of the hashes that may be frequent."""

    def __init__(self, bits: int, data: bytes) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.bytes = np.frombuffer(data, dtype=np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * np.uint64(3) + _mixed(second))


class Batch:
    """Segments of one language as numbers: ids are places in ``words``, pieces end with -1."""

    def __init__(self, lang: str) -> None:
        self.lang = lang
        self.place: dict[bytes, int] = {b".": -1}
        self.ids: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.size = 0

    def add(self, segment: Segment) -> None:
        place = self.place
        for word in set(segment.words).difference(place):
            place[word] = len(place) - 1
        self.ids.append(np.fromiter(map(place.__getitem__, segment.words), np.int32, len(segment.words)))
        own = np.zeros(len(segment.words), dtype=bool)
        own[: segment.own] = True
        self.own.append(own)
        self.size += len(own)

    def finish(self) -> None:
        import xxhash

        ids, own = np.concatenate(self.ids), np.concatenate(self.own)
        self.words = [w for w in self.place if w != b"."]
        self.ids, self.own, self.place = ids, own & (ids >= 0), {}
        head = self.lang.encode() + b"\0"
        # The last hash is that of the end of a piece; it is never looked at.
        self.hash = np.array([*(xxhash.xxh3_64_intdigest(head + w) for w in self.words), 0], dtype=np.uint64)

    def pairs(self, words: Filter) -> tuple[np.ndarray, np.ndarray]:
        """Where both words of a pair may be frequent, and the hashes of those pairs."""
        good = words(self.hash)
        good[-1] = False
        good = good[self.ids]
        at = np.flatnonzero(good[:-1] & good[1:])
        return at, pair_hash(self.hash[self.ids[at]], self.hash[self.ids[at + 1]])


def _batches(stream: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    """Batches of one language each, for columns lang and text (binary)."""
    open_: dict[str, Batch] = {}
    total = 0
    for record in stream:
        for lang, text in zip(record.column("lang").to_pylist(), record.column("text"), strict=True):
            for segment in segments(text.as_py() or b""):
                batch = open_.setdefault(lang, Batch(lang))
                batch.add(segment)
                total += len(segment.words)
                if batch.size >= WORDS_PER_BATCH * 4 or len(batch.place) >= WORDS_PER_BATCH:
                    total -= batch.size
                    batch.finish()
                    yield open_.pop(lang)
                elif total >= WORDS_PER_BATCH * 8:
                    # Many languages with little each.
                    lang_of_most = max(open_, key=lambda name: open_[name].size)
                    batch = open_.pop(lang_of_most)
                    total -= batch.size
                    batch.finish()
                    yield batch
    for batch in open_.values():
        batch.finish()
        yield batch


# -- filters -----------------------------------------------------------------

_COUNTS = "lang string, hash bigint, count bigint"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("hash", pa.int64()), ("count", pa.int64())])


def _counted(lang: str | None, hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(hashes), dtype=np.int32)))
    return pa.RecordBatch.from_arrays(
        [langs, pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], schema=_COUNTS_ARROW
    )


def _word_hashes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _batches(stream):
        counts = np.bincount(batch.ids[batch.own], minlength=len(batch.words))
        some = np.flatnonzero(counts)
        yield _counted(batch.lang, batch.hash[some], counts[some])


def _pair_hashes(words):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = words.value
        for batch in _batches(stream):
            at, hashes = batch.pairs(keep)
            yield _counted(None, *np.unique(hashes[batch.own[at]], return_counts=True))

    return run


def _filter(counted: DataFrame, least: int) -> Filter:
    """The filter of the hashes that occur often enough; made of 4096-byte pieces that Spark builds."""
    frequent = counted.groupBy("hash").agg(F.sum("count").alias("count")).filter(F.col("count") >= least)
    frequent = stored(frequent.select("hash"), "frequent")
    bits = min(FILTER_BITS, max(15, (BITS_PER_HASH * frequent.count()).bit_length()))
    at = F.col("hash").bitwiseAND((1 << bits) - 1)
    # Bit numbers of the built-in functions begin at 1.
    pieces = frequent.groupBy(F.bitmap_bucket_number(at + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("piece")
    )
    data = bytearray(1 << (bits - 3))
    for row in pieces.toLocalIterator():
        start = (row["bucket"] - 1) * 4096
        data[start : start + 4096] = row["piece"]
    return Filter(bits, bytes(data))


# -- windows -----------------------------------------------------------------

_LEADS = [f"w{i}" for i in range(1, MOST + 1)]
_WINDOW = f"lang string, {', '.join(f'{c} string' for c in _LEADS)}, count bigint"
_WINDOW_ARROW = pa.schema([("lang", pa.string()), *[(c, pa.string()) for c in _LEADS], ("count", pa.int64())])


def _windows(words, pairs):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(stream):
            yield _count_windows(batch, words.value, pairs.value)

    return run


def _count_windows(batch: Batch, words: Filter, pairs: Filter) -> pa.RecordBatch:
    """Distinct padded windows and how often they occur, by numbering longer and longer prefixes."""
    ids = batch.ids
    known = words(batch.hash)
    known[-1] = False
    at, hashes = batch.pairs(words)
    goes_on = np.zeros(len(ids), dtype=bool)
    goes_on[at] = pairs(hashes)
    start = np.flatnonzero(batch.own & known[ids])
    prefix = ids[start].astype(np.int64)
    leads = [prefix.copy()]
    live = np.arange(len(start))
    for step in range(1, MOST):
        live = live[goes_on[start[live] + step - 1]]
        lead = np.full(len(start), -1, dtype=np.int64)
        lead[live] = ids[start[live] + step]
        leads.append(lead)
        # Windows that ended keep the number of their last prefix.
        _, number = np.unique((prefix[live] << 32) | lead[live], return_inverse=True)
        prefix[live] = number + (int(prefix.max(initial=0)) + 1)
    _, first, counts = np.unique(prefix, return_index=True, return_counts=True)
    # Word ids are far below 2^32; the last value is the padding.
    text = pa.array([*batch.words, None], pa.binary()).cast(pa.string())
    columns = [text.take(pa.array(np.where(lead < 0, len(batch.words), lead)[first])) for lead in leads]
    lang = pa.array([batch.lang], pa.string()).take(pa.array(np.zeros(len(first), dtype=np.int32)))
    return pa.RecordBatch.from_arrays([lang, *columns, pa.array(counts.astype(np.int64))], schema=_WINDOW_ARROW)


def phrase_counts(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Stored rows (lang, words, count) of phrases of 1 to ``MOST`` words with ``least`` or more occurrences, and (lang, n)."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"),
        F.col(f"`{text}`").cast("string").cast("binary").alias("text"),
    )
    single = stored(
        rows.mapInArrow(_word_hashes, _COUNTS).groupBy("lang", "hash").agg(F.sum("count").alias("count")), "words"
    )
    totals = stored(single.groupBy("lang").agg(F.sum("count").alias("n")), "word_totals")
    # The language is part of the hash.
    words = context.broadcast(_filter(single, least))
    pairs = context.broadcast(_filter(rows.mapInArrow(_pair_hashes(words), _COUNTS).select("hash", "count"), least))
    windows = rows.mapInArrow(_windows(words, pairs), _WINDOW)
    summed = windows.rollup("lang", *_LEADS).agg(F.sum("count").alias("count"), F.grouping_id().alias("level"))
    # Level 2^j - 1 has summed over the last j leads; padding is no word of a phrase.
    kept = functools.reduce(
        lambda so_far, j: so_far | ((F.col("level") == (1 << j) - 1) & F.col(_LEADS[MOST - 1 - j]).isNotNull()),
        range(1, MOST),
        (F.col("level") == 0) & F.col(_LEADS[-1]).isNotNull(),
    )
    phrases = summed.filter(kept & (F.col("count") >= least)).select(
        "lang", F.array_join(F.array_compact(F.array(*_LEADS)), " ").alias("phrase"), "count"
    )
    return stored(phrases, "phrases"), totals


# -- scores ------------------------------------------------------------------


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def _part(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _cuts(phrase: Column) -> Column:
    """Each cut (k, first part, rest)."""
    words = _words(phrase)
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda k: F.struct(k.alias("k"), _part(words, 1, k).alias("first"), _part(words, k + 1, F.size(words)).alias("rest")),
    )


def _salts(part: Column) -> Column:
    out = F.lit(1)
    for size, salts in SALTS.items():
        out = F.when(F.size(_words(part)) == size, salts).otherwise(out)
    return out


def _with_counts(cuts: DataFrame, phrases: DataFrame, part: str, name: str) -> DataFrame:
    """Add the occurrences of a part; short parts, which many phrases share, have several join keys."""
    salt = F.explode(F.sequence(F.lit(0), _salts(F.col("phrase")) - 1))
    held = phrases.select("lang", F.col("phrase").alias(part), F.col("count").alias(name), salt.alias("salt"))
    asked = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), _salts(F.col(part))).cast("int"))
    return asked.join(held, ["lang", part, "salt"]).drop("salt", part)


def collocations(
    docs: DataFrame,
    least: int = 100,
    top: int = 2000,
    scale: int = 1000,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases whose words lie inside a longer one with as many occurrences are left
    out. It is enough to look at phrases of one word more: one of those holds the
    phrase and lies in the longer one, so it occurs as often.
    """
    return scored(*phrase_counts(docs, least, text, lang), top, scale)


def scored(phrases: DataFrame, totals: DataFrame, top: int, scale: int) -> DataFrame:
    """The result of :func:`collocations` by the rows of :func:`phrase_counts`."""
    words = _words(F.col("phrase"))
    size = F.size(words)
    longer = phrases.filter(size > 2)
    inside = F.explode(F.array(_part(words, 1, size - 1), _part(words, 2, size - 1)))
    covered = longer.select("lang", "count", inside.alias("phrase")).groupBy("lang", "phrase")
    covered = covered.agg(F.max("count").alias("covering"))
    found = phrases.filter(size > 1).join(covered, ["lang", "phrase"], "left")
    found = found.filter(F.col("covering").isNull() | (F.col("covering") < F.col("count")))
    cuts = found.select("lang", "phrase", F.col("count").alias("a"), F.explode(_cuts(F.col("phrase"))).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut.*")
    counted = _with_counts(_with_counts(cuts, phrases, "first", "l"), phrases, "rest", "r")
    # One row per language.
    known = counted.join(F.broadcast(totals) if _few(totals) else totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    above = (exact("a") * exact("n")).cast("decimal(38,0)") * F.lit(scale).cast("decimal(5,0)")
    judged = known.withColumn("score", F.call_function("div", above.cast("decimal(38,0)"), exact("l") * exact("r")))
    worst = judged.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("worst")
    )
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of each part of a language first, so that no task ranks all its phrases.
    parted = worst.select("lang", "phrase", "worst.*").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        parted = parted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best)))
        parted = parted.filter(F.col("rank") <= top)
    return parted.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _few(totals: DataFrame, rows: int = 10_000) -> bool:
    return totals.limit(rows + 1).count() <= rows
