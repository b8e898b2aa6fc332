"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over labelled sample text. A text is
parsed greedily against it: each phrase is the longest match from where the last
one ended. The number of phrases times the bits of a pointer into the sample,
divided by the length, estimates the cross entropy; the language with the
fewest normalised phrases wins.

Every letter of the samples is told apart. Where all languages together have more
letters than single symbols, the frequent ones are one symbol and the others a
code of several, so the table stays ``WIDTH`` wide. Letters of no sample are one
symbol that no phrase holds.

The automaton walk is a table lookup, so many texts are parsed at a time: texts
are cut into lanes of ``LANE`` symbols (a phrase ends at a cut, for every
language alike) and all lanes of a batch advance together.

The same entropy tells texts in none of the languages: :func:`bounds` learns from
the labelled rows outside the sample how many bits per letter a text of its
language takes, and how far rows lie from that. A bound is ``SPREADS`` spreads
above the median; the part of the spread that shrinks with the root of the
length is large for short texts.

Only the sample is bounded (``DOCS_PER_LANGUAGE`` rows of at most
``CHARS_PER_DOC`` characters, ``SAMPLE_CHARS`` symbols per language); texts are
parsed whole. A null text and one without letters get ``und`` and score 0, as
does every text if there are no labelled rows. Ties go to the language that
sorts first. Repeated rows get the same answer.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.common import release_arrow, stored

UNDETERMINED = "und"
DOCS_PER_LANGUAGE = 64
CHARS_PER_DOC = 4096
SAMPLE_CHARS = 16_384
LANE = 1024
#: Characters parsed at a time, if one text is not longer; bounds memory, not results.
BATCH_CHARS = 500_000
WIDTH = 64
#: Spreads above the median, fewest rows to learn a bound of, least spread as a part of the median.
SPREADS, LEAST_ROWS, LEAST_SPREAD = 12.0, 20, 0.02
SPACE, UNKNOWN, PAD = 0, 62, 63
#: In a code of several symbols the last is up to this, those in front are above.
LAST = 29


def letter_codes(n: int) -> list[tuple[int, ...]]:
    """Codes of n letters, shortest first; no code begins with another."""
    if n < UNKNOWN:
        return [(c,) for c in range(1, n + 1)]
    codes: list[tuple[int, ...]] = []
    fronts: list[tuple[int, ...]] = [()]
    while len(codes) < n:
        codes += [(*front, last) for front in fronts for last in range(1, LAST + 1)]
        fronts = [(*front, more) for front in fronts for more in range(LAST + 1, UNKNOWN)]
    return codes[:n]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        state = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and code not in moves[at]:
            moves[at][code] = state
            at = link[at]
        if at >= 0:
            target = moves[at][code]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                link[target] = link[state] = copy
                while at >= 0 and moves[at].get(code) == target:
                    moves[at][code] = copy
                    at = link[at]
        last = state
    return moves


class PhraseModel:
    """One table of moves for all languages.

    An entry is twice the next state, plus one where a new phrase starts. State
    numbers of a language start at its entry of ``roots``.
    """

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        seen: dict[str, int] = {}
        for texts in samples.values():
            for text in texts:
                for letter in text.lower():
                    if letter.isalpha():
                        seen[letter] = seen.get(letter, 0) + 1
        alphabet = sorted(seen, key=lambda c: (-seen[c], c))
        codes = letter_codes(len(alphabet))
        #: The last symbol of each letter, and those in front of it, nearest first (0: none).
        self.symbols = np.full(0x110000, SPACE, dtype=np.uint8)
        self.fronts = np.zeros((max(map(len, codes), default=1) - 1, 0x110000), dtype=np.uint8)
        for point in range(0x110000):
            if not 0xD800 <= point < 0xE000 and chr(point).isalpha():
                self.symbols[point] = UNKNOWN
        for code, letter in zip(codes, alphabet, strict=True):
            self.symbols[ord(letter)] = code[-1]
            for back, symbol in enumerate(reversed(code[:-1])):
                self.fronts[back, ord(letter)] = symbol
        tables, self.roots, self.bits, base = [], [], [], 0
        #: How many texts of each language reach into its sample, and the keys of those of all languages.
        self.used: dict[str, int] = {}
        self.learned: list = []
        for language in self.languages:
            codes, lengths = self.encode(samples[language])
            self.used[language] = int((np.cumsum(lengths) - lengths < SAMPLE_CHARS).sum())
            sample = codes[:SAMPLE_CHARS].tolist()
            moves = suffix_automaton(sample)
            table = np.empty((len(moves), WIDTH), dtype=np.int32)
            restart = np.full(WIDTH, base * 2 + 1, dtype=np.int32)
            for code, target in moves[0].items():
                restart[code] = (base + target) * 2 + 1
            table[:] = restart
            for state, step in enumerate(moves):
                for code, target in step.items():
                    table[state, code] = (base + target) * 2
            table[:, PAD] = (base + np.arange(len(moves), dtype=np.int32)) * 2
            tables.append(table)
            self.roots.append(base)
            self.bits.append(max(1.0, float(np.log2(max(2, len(sample))))))
            base += len(moves)
        self.moves = np.concatenate(tables).ravel() if tables else np.empty(0, dtype=np.int32)

    def shared(self, spark: SparkSession) -> Broadcast:
        """This model as a broadcast. Workers keep what they have read, so all plans of a session use one."""
        app, found = getattr(self, "_shared", (None, None))
        if app != spark.sparkContext.applicationId:
            self.__dict__.pop("_shared", None)
            found = spark.sparkContext.broadcast(self)
            self._shared = (spark.sparkContext.applicationId, found)
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, each behind a space, runs of spaces as one; lengths."""
        lowered = [" " + t.lower() for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype=np.uint32)
        symbols = self.symbols[points]
        keep = np.ones(len(symbols), dtype=bool)
        keep[1:] = (symbols[1:] != SPACE) | (symbols[:-1] != SPACE)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
        keep[starts[:-1]] = True
        if not len(self.fronts):
            before = np.concatenate([[0], np.cumsum(keep)])
            return symbols[keep], np.diff(before[starts])
        sizes = keep.astype(np.int64)
        for front in self.fronts:
            sizes += front[points] > 0
        before = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(before[-1]), dtype=np.uint8)
        last = before[1:] - 1
        out[last[keep]] = symbols[keep]
        for back, front in enumerate(self.fronts, 1):
            found = front[points]
            out[last[found > 0] - back] = found[found > 0]
        return out, np.diff(before[starts])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and letters per text."""
        symbols, lengths = self.encode(texts)
        lanes = -(-lengths // LANE)
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = np.concatenate([[0], np.cumsum(lanes)])[:-1]
        number = np.arange(len(owner)) - np.repeat(first, lanes)
        offset = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        start = offset[owner] + number * LANE
        size = np.minimum(LANE, lengths[owner] - number * LANE)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        padded = np.concatenate([symbols, np.full(LANE, PAD, dtype=np.uint8)])
        state = np.repeat(np.array(self.roots, dtype=np.int32)[:, None], len(owner), axis=1)
        count = np.ones(state.shape, dtype=np.int32)
        for step in range(int(size.max(initial=0))):
            active = int(np.searchsorted(-size, -step, side="left"))
            code = padded[start[:active] + step].astype(np.int32)
            entry = self.moves[(state[:, :active] << 6) | code]
            count[:, :active] += entry & 1
            state[:, :active] = entry >> 1
        total = np.stack(
            [np.bincount(owner, weights=row, minlength=len(texts)) for row in count], axis=1
        )
        # Every text has a symbol at least, the space in front.
        ends = (symbols != SPACE) & ((symbols <= LAST) | (symbols == UNKNOWN)) if len(self.fronts) else symbols != SPACE
        letters = np.add.reduceat(ends, offset, dtype=np.int64).astype(float)
        return total, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the relative lead over the next."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """As predict; bits per letter under the best language (0 without letters) and letters too."""
        if not texts or not self.languages:
            nothing = np.zeros(len(texts))
            return [UNDETERMINED] * len(texts), nothing, nothing, nothing
        phrases, letters = self.phrases(texts)
        cost = phrases * np.array(self.bits)
        best = np.argmin(cost, axis=1)
        ranked = np.sort(cost, axis=1)
        if ranked.shape[1] == 1:
            score = np.ones(len(texts))
        else:
            score = 1.0 - ranked[:, 0] / ranked[:, 1]
        known = letters > 0
        names = [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
        bits = np.where(known, ranked[:, 0] / np.maximum(letters, 1), 0.0)
        return names, np.where(known, np.clip(score, 0.0, 1.0), 0.0), bits, letters


def train(
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
) -> PhraseModel:
    """Fit on a bounded sample of the labelled rows: the smallest hashes of the key."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    order = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    chosen = (
        rows.select("k", "l")
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= docs_per_language)
        .select("k", "l")
        .distinct()
    )
    # At most docs_per_language rows per language.
    picked = rows.join(F.broadcast(chosen), ["k", "l"]).select(
        "l", F.xxhash64("k").alias("h"), "k", F.substring("t", 1, CHARS_PER_DOC).alias("t")
    )
    samples: dict[str, list[str]] = {}
    keys: dict[str, list] = {}
    for row in sorted(picked.collect(), key=lambda r: (r["l"], r["h"], r["k"], r["t"])):
        samples.setdefault(row["l"], []).append(row["t"])
        keys.setdefault(row["l"], []).append(row["k"])
    model = PhraseModel(samples)
    model.learned = [k for language, own in keys.items() for k in own[: model.used[language]]]
    return model


class Bound(NamedTuple):
    """Bits per letter of a language: median, spread whatever the length, spread times the root of the letters."""

    median: float
    spread: float
    by_length: float

    def most(self, letters: Column) -> Column:
        return F.lit(self.median) + SPREADS * (F.lit(self.spread) + self.by_length / F.sqrt(letters))


def bounds(
    labelled: DataFrame, model: PhraseModel, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> dict[str, Bound]:
    """A bound per language of the model, from all labelled rows that are not in its sample.

    Rows that are taken for another language do not count, equal figures count
    once, and spreads are those of the upper half, as copies of the sample lie
    far below. A language with too few rows gets the bound of all languages
    together; without enough rows of any language there are no bounds.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    if model.learned:
        rows = rows.filter(~F.col(key).isin(model.learned))
    found = identify(rows.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t")), model, "t", True)
    right = found.filter((F.col("l") == F.col("lang_pred")) & (F.col("letters") > 0))
    seen = stored(right.select("l", "bits", "letters").distinct(), "language_bits")
    out = {language: bound for language, bound in _bounds(seen).items() if language in model.languages}
    if len(out) < len(model.languages):
        for bound in _bounds(seen.withColumn("l", F.lit(""))).values():
            out = dict.fromkeys(model.languages, bound) | out
    return out


def _bounds(seen: DataFrame) -> dict[str, Bound]:
    half = seen.groupBy("l").agg(
        F.percentile_approx("bits", [0.5, 0.75]).alias("q"), F.count(F.lit(1)).alias("n")
    )
    medians = {r["l"]: r["q"] for r in half.filter(F.col("n") >= LEAST_ROWS).collect()}
    off = (F.col("bits") - F.col("q")[0]) * F.sqrt("letters")
    wide = seen.join(F.broadcast(half), "l").groupBy("l").agg(F.percentile_approx(off, 0.75).alias("d")).collect()
    upper = {r["l"]: r["d"] for r in wide}
    normal = 0.6745  # upper quartile of the normal distribution
    return {
        language: Bound(
            middle,
            max(high - middle, LEAST_SPREAD * middle) / normal,
            max(upper[language], LEAST_SPREAD * middle) / normal,
        )
        for language, (middle, high) in medians.items()
    }


def plausible(limits: dict[str, Bound]) -> Column:
    """Whether a row of identify(bits=True) has a language, and no more bits per letter than that allows."""
    good = F.col("lang_pred") != UNDETERMINED
    for language, bound in limits.items():
        good = good & ((F.col("lang_pred") != language) | (F.col("bits") <= bound.most(F.col("letters"))))
    return good


def identify(docs: DataFrame, model: PhraseModel, text: str = "text", bits: bool = False) -> DataFrame:
    """Add lang_pred and score to every row, on demand also bits (per letter) and letters."""
    shared = model.shared(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, bits double, letters double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        values = texts.fillna("").tolist()
        names: list[str] = []
        figures: list[np.ndarray] = [np.empty((3, 0))]
        at = 0
        while at < len(values):
            end, chars = at, 0
            while end < len(values) and (end == at or chars + len(values[end]) <= BATCH_CHARS):
                chars += len(values[end])
                end += 1
            some, *rest = shared.value.judge(values[at:end])
            names += some
            figures.append(np.stack(rest))
            at = end
        score, cost, letters = np.concatenate(figures, axis=1)
        release_arrow()
        return pd.DataFrame({"lang_pred": names, "score": score, "bits": cost, "letters": letters})

    added = docs.withColumn("__lang", predict(F.col(text).cast("string")))
    names = ["lang_pred", "score", *(["bits", "letters"] if bits else [])]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return added.select(*kept, *[F.col(f"__lang.{n}").alias(n) for n in names])
