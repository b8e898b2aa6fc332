"""Near-duplicate join on word shingles with Bayesian candidate pruning.

Documents are linked if the Jaccard similarity of their sets of five-word
shingles reaches the threshold (0.8).

1. Equal shingle sets collapse to one representative with a weight.
2. Representatives get 128 MinHash values. Those that share the four values of
   a band meet in a bucket (32 bands: a pair at the threshold misses all of them
   with a chance of 5e-8). Buckets of one are dropped by counting first.
3. Inside a bucket, values are compared 16 at a time; a pair is dropped once the
   posterior probability (uniform prior) that its similarity reaches the
   threshold falls below 1e-9. What survives is reduced to a spanning forest.
4. The trees of all buckets join to candidate clusters. Each cluster is checked
   pair by pair: pruned again in the same way, and the rest verified exactly on
   the shingle sets. Only link counts and a spanning forest leave the task.
5. The verified forest gives the classes.

Large buckets and clusters are cut into tiles; each task compares two tiles.
No pair of documents is ever a row of a table.

A text with fewer than five words has one shingle, all its words; without words
(or null) it has none, links to nothing and is its own class. Words are runs of
letters and digits, lower-cased. Repeated ids count as documents each; a null id
takes no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import numbered, release_arrow, stored
from flowloom.llm.components import components

THRESHOLD = 0.8
SHINGLE = 5
HASHES, ROWS = 128, 4
STEP = 16
TOLERANCE = 1e-9
BUCKET_TILE = 4096
TILE_DOCS, TILE_SHINGLES = 1024, 1_500_000

_WORD = re.compile(r"[^\W_]+")
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(_word_code, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(codes))
    total = np.zeros(len(codes) - size + 1, dtype=np.uint64)
    for place in range(size):
        total = _mixed(total + codes[place : place + len(total)])
    return np.unique(total)


#: Hashes of words; emptied at the end of a partition, so that a waiting worker holds none.
_CODES: dict[str, int] = {}
_MOST_CODES = 200_000


def _word_code(word: str) -> int:
    import xxhash

    if (code := _CODES.get(word)) is None:
        if len(_CODES) >= _MOST_CODES:
            _CODES.clear()
        code = _CODES[word] = xxhash.xxh64_intdigest(word)
    return code


def _forget_words() -> None:
    _CODES.clear()
    release_arrow()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each)."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        low = np.minimum(low, (part[None, :] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior and m of n equal, the chance that the similarity is at
    least t is the chance of at most m successes in n + 1 draws at t.
    """
    t, out = Fraction(threshold).limit_denominator(1000), []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = Fraction(0), -1
        while m < n and tail < Fraction(tolerance):
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(one: np.ndarray, many: np.ndarray, least: list[int]) -> np.ndarray:
    """Places of the signatures that one signature may be similar to."""
    open_rows = np.arange(len(many))
    matches = np.zeros(len(many), dtype=np.int64)
    for step, keep in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (many[open_rows, part] == one[part]).sum(axis=1)
        good = matches >= keep
        open_rows, matches = open_rows[good], matches[good]
        if not len(open_rows):
            break
    return open_rows


def _forest(signatures: np.ndarray, least: list[int]) -> list[tuple[int, int]]:
    """Spanning forest of the surviving pairs, as places."""
    waiting, edges = np.arange(len(signatures)), []
    while len(waiting):
        front, waiting = [int(waiting[0])], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            found = surviving(signatures[at], signatures[waiting], least)
            reached = waiting[found]
            edges += [(at, int(r)) for r in reached]
            front += reached.tolist()
            waiting = np.delete(waiting, found)
    return edges


def _tiled(rows: DataFrame, tiles: str, salt: str) -> DataFrame:
    """Each row once per pair of tiles that holds its tile: columns x <= y, tile."""
    tile = F.pmod(F.xxhash64(F.lit(7), F.col(salt)), F.col(tiles)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(tiles).cast("int") - 1))
    rows = rows.withColumn("tile", tile).withColumn("other", other)
    return rows.withColumns({"x": F.least("tile", "other"), "y": F.greatest("tile", "other")}).drop("other")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Rows (key, class_id, n_links): one per row of ``docs`` with a key.

    The class is the smallest key of all documents joined by links; n_links
    counts the other rows at or above the threshold, equal texts included.
    """
    least = least_matches(threshold, tolerance)
    hashed = stored(_hashed(docs, key, text), "shingled")
    sets = hashed.filter("n > 0").groupBy("digest").agg(
        F.min("k").alias("rep"), F.count("*").alias("weight"), F.min("sig").alias("sig"), F.max("n").alias("n")
    )
    sets = stored(sets, "sets")
    clusters = _clusters(sets, least)
    verified = stored(_verified(docs, sets, clusters, key, text, least, threshold), "links")
    counts = verified.groupBy("digest").agg(F.sum("links").alias("links"))
    roots = components(verified.select("digest", F.explode("near").alias("other")), "digest", "other")
    members = (
        sets.select("digest", "rep", "weight")
        .join(counts, "digest", "left")
        .join(roots.withColumnRenamed("node", "digest"), "digest", "left")
        .withColumn("root", F.coalesce("root", "digest"))
    )
    smallest = members.groupBy("root").agg(F.min("rep").alias("class_id"))
    found = members.join(smallest, "root").select(
        "digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    alone = F.encode(F.concat(F.lit("text without words "), F.col("k").cast("string")), "utf-8")
    return (
        # Texts without words belong to no set; keys of their own keep them from meeting in one task.
        hashed.select("k", F.when(F.col("n") > 0, F.col("digest")).otherwise(alone).alias("digest"))
        .join(found, "digest", "left")
        .select(
            F.col("k").alias(key),
            F.coalesce("class_id", "k").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        )
    )


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows k, digest of the set, number of shingles, signature."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for frame in frames:
            sets = [shingle_set(t or "") for t in frame["t"]]
            yield pd.DataFrame(
                {
                    "k": frame["k"],
                    "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "n": [len(s) for s in sets],
                    "sig": [signature(s).tobytes() if len(s) else b"" for s in sets],
                }
            )
        _forget_words()

    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t"))
    return rows.filter(F.col("k").isNotNull()).mapInPandas(run, "k bigint, digest binary, n int, sig binary")


def _clusters(sets: DataFrame, least: list[int]) -> DataFrame:
    """Rows (digest, root) of all sets that may be similar to another."""
    bands = F.explode(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)))
    width = 4 * ROWS
    keyed = sets.select("digest", "sig", bands.alias("band")).select(
        "digest", F.xxhash64("band", F.substring("sig", F.col("band") * width + 1, F.lit(width))).alias("bucket")
    )
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = keyed.join(sizes, "bucket")
    members = shared.join(sets.select("digest", "sig"), "digest").withColumn(
        "tiles", F.ceil(F.col("size") / F.lit(BUCKET_TILE))
    )

    tiled = _tiled(members, "tiles", "digest").select("bucket", "x", "y", "digest", "sig")
    dealt = tiled.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "digest")
    edges = dealt.mapInPandas(_bucket_forests(least), "a binary, b binary")
    return components(edges).withColumnRenamed("node", "digest")


def _bucket_forests(least: list[int]):
    """Spanning edges of each bucket; most buckets are small, so a batch of them is done at a time."""

    def forests(rows: pd.DataFrame) -> pd.DataFrame:
        signatures = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint32).reshape(-1, HASHES)
        names, starts = rows["digest"].to_numpy(), np.flatnonzero(_starts(rows))
        sizes = np.diff(np.append(starts, len(rows)))
        two = starts[sizes == 2]
        same = signatures[two] == signatures[two + 1]
        same = same.reshape(len(two), HASHES // STEP, STEP).sum(axis=2).cumsum(axis=1)
        kept = two[(same >= np.array(least)).all(axis=1)]
        edges = [np.stack([kept, kept + 1], axis=1)]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            found = _forest(signatures[start : start + size], least)
            edges.append(np.array(found, dtype=np.int64).reshape(-1, 2) + start)
        every = np.concatenate(edges)
        return pd.DataFrame({"a": names[every[:, 0]], "b": names[every[:, 1]]}, dtype=object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The rows are sorted by bucket; the last bucket of a batch may go on in the next.
        waiting: list[pd.DataFrame] = []
        for frame in frames:
            begins = _starts(pd.concat([waiting[-1].tail(1), frame]))[1:] if waiting else _starts(frame)
            if not begins.any():
                waiting.append(frame)
                continue
            first = np.flatnonzero(begins)[-1]
            if waiting or first:
                yield forests(pd.concat([*waiting, frame.iloc[:first]]))
            waiting = [frame.iloc[first:]]
        if waiting:
            yield forests(pd.concat(waiting))

    return run


def _starts(rows: pd.DataFrame) -> np.ndarray:
    """True where a row begins another bucket or pair of tiles than the row before."""
    keys = rows[["bucket", "x", "y"]].to_numpy()
    return np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])


def _verified(
    docs: DataFrame,
    sets: DataFrame,
    clusters: DataFrame,
    key: str,
    text: str,
    least: list[int],
    threshold: float,
) -> DataFrame:
    """Rows (digest, links, near): weights of verified neighbours, and some of them that span."""
    ratio = Fraction(threshold).limit_denominator(1000)
    inside = stored(clusters.join(sets, "digest"), "clusters")
    sizes = inside.groupBy("root").agg(F.count("*").alias("docs"), F.sum("n").alias("all"))
    tiles = F.greatest(F.ceil(F.col("docs") / TILE_DOCS), F.ceil(F.col("all") / TILE_SHINGLES), F.lit(1))
    inside = inside.join(sizes.select("root", tiles.alias("tiles")), "root")
    texts = docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).cast("string").alias("t"))
    members = inside.join(texts, "rep")

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for frame in frames:
            found = [shingle_set(t or "").tobytes() for t in frame["t"]]
            # Rows of one id may have other texts.
            same = [xxhash.xxh3_128_digest(s) == bytes(d) for s, d in zip(found, frame["digest"], strict=True)]
            yield frame.assign(shingles=found)[same][["root", "digest", "weight", "tiles", "sig", "shingles"]]
        _forget_words()

    schema = "root binary, digest binary, weight bigint, tiles bigint, sig binary, shingles binary"
    ready = members.select("root", "digest", "weight", "tiles", "sig", "t").mapInPandas(prepare, schema)

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _compare(frame.drop_duplicates("digest").sort_values("digest"), group[1] == group[2], least, ratio)

    tiled = _tiled(ready, "tiles", "digest").drop("tiles")
    return tiled.groupBy("root", "x", "y").applyInPandas(run, "digest binary, links bigint, near array<binary>")


def _compare(frame: pd.DataFrame, same_tile: bool, least: list[int], ratio: Fraction) -> pd.DataFrame:
    """Exact links between the rows of two tiles (or inside one)."""
    signatures = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint32).reshape(-1, HASHES)
    sets = [np.frombuffer(s, dtype=np.uint64) for s in frame["shingles"]]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names, weights = frame["digest"].to_numpy(), frame["weight"].to_numpy()
    tile = frame["tile"].to_numpy()
    links = np.zeros(len(frame), dtype=np.int64)
    parent = list(range(len(frame)))
    near: list[list[bytes]] = [[] for _ in parent]
    member = np.zeros(int(codes.max()) + 1, dtype=bool)

    def root(at: int) -> int:
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    for at in range(len(frame)):
        others = np.arange(at + 1, len(frame))
        if not same_tile:
            others = others[tile[others] != tile[at]]
        # Sizes alone rule a pair out exactly.
        low = np.minimum(sizes[others], sizes[at]) * ratio.denominator
        others = others[low >= np.maximum(sizes[others], sizes[at]) * ratio.numerator]
        others = others[surviving(signatures[at], signatures[others], least)]
        if not len(others):
            continue
        member[codes[starts[at] : starts[at + 1]]] = True
        lengths = sizes[others]
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        cells = np.repeat(starts[others] - begin, lengths) + np.arange(int(lengths.sum()))
        common = np.add.reduceat(member[codes[cells]].astype(np.int64), begin)
        member[codes[starts[at] : starts[at + 1]]] = False
        union = sizes[at] + lengths - common
        linked = others[common * ratio.denominator >= union * ratio.numerator]
        links[at] += weights[linked].sum()
        links[linked] += weights[at]
        for other in linked.tolist():
            one, two = root(at), root(other)
            if one != two:
                parent[max(one, two)] = min(one, two)
                near[at].append(names[other])
    kept = [i for i in range(len(frame)) if links[i]]
    return pd.DataFrame({"digest": pd.Series(names[kept], dtype=object), "links": links[kept], "near": pd.Series([near[i] for i in kept], dtype=object)})


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that with the smallest key, a row without a key only where no other is there.

    Rows are told apart by a number, so rows with one key are judged by their own
    texts, and of repeated rows one stays. Texts without words all stay.
    """
    rows, row = numbered(docs)
    classes = near_duplicates(rows, row, text)
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row")))
    kept = classes.join(rows.select(row, key), row).groupBy("class_id").agg(first.alias("first"))
    return rows.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").drop(row)


