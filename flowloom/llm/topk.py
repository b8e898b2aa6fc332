"""Exact top-k inner products on a bit-sliced index.

Rows are indexed in blocks. Each component of a block is shifted to be
non-negative and stored as bit slices: slice b of component j is a bitmap with
one bit per row. The score slices of a query are the sum of the component
slices at the places where the weight has a one bit; negative weights take the
complement. All bitmaps of one place are added at a time by carry-save adders.

The best rows are selected from the most significant score slice downward:
rows that certainly belong are kept, rows that still tie go on to the next
slice. The rows that tie at the very end are settled exactly by id.

The index is a table of bitmaps in the shared folder. Blocks of queries meet
groups of index blocks in a grid of cells, so no key gathers the index or the
queries, and each side is copied once per row or column of the grid. Each pair of
blocks gives at most k rows per query, and the best of those are ranked by a
grouped limit before the shuffle.

Components are ``floor(256 * x)``. Vectors that are null or hold null or
non-finite components take no part; a vector is only compared with vectors of
its length. Rows of one id are all indexed; a query id given twice is answered
from its smallest vector. Scores must fit 64 bits (components below 2**26).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import stored

SCALE = 256
BLOCK_ROWS = 65_536
#: Queries of one block: at least, and at most.
QUERY_BLOCK, QUERY_BLOCK_MOST = 256, 16_384
#: Index blocks of one cell of the grid.
CELL_BLOCKS = 4


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v): components as integers; unusable vectors are gone."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vectors.filter(usable & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"),
        F.transform(values, lambda x: F.floor(x * F.lit(float(SCALE))).cast("bigint")).alias("v"),
    )


def slices_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (component, place, word) and the shift per component."""
    low = rows.min(axis=0)
    shifted = (rows - low).astype(np.uint64)
    places = max(1, int(shifted.max(initial=0)).bit_length())
    words = -(-len(rows) // 64)
    out = np.zeros((rows.shape[1], places, words * 8), dtype=np.uint8)
    for place in range(places):
        bits = np.packbits(((shifted >> np.uint64(place)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        out[:, place, : len(bits)] = bits.T
    return out.view(np.uint64), low


def score_slices(index: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Slices of the scores, least significant first, without their constant part."""
    at: dict[int, list[np.ndarray]] = {}
    size = np.abs(weights)
    for place in range(int(size.max(initial=0)).bit_length()):
        used = (size >> place) & 1 == 1
        plus, minus = index[used & (weights > 0)], ~index[used & (weights < 0)]
        for b in range(index.shape[1]):
            at.setdefault(place + b, []).extend((plus[:, b], minus[:, b]))
    out: list[np.ndarray] = []
    place = 0
    while place <= max(at, default=-1):
        waiting = at.pop(place, [])
        maps = np.concatenate(waiting) if waiting else np.empty((0, index.shape[2]), np.uint64)
        while len(maps) > 1:
            n = max(1, len(maps) // 3)
            a, b = maps[:n], maps[n : 2 * n]
            if len(maps) == 2:
                total, carry, rest = a ^ b, a & b, maps[:0]
            else:
                c, rest = maps[2 * n : 3 * n], maps[3 * n :]
                half = a ^ b
                total, carry = half ^ c, (a & b) | (half & c)
            at.setdefault(place + 1, []).append(carry)
            maps = np.concatenate([total, rest])
        out.append(maps[0] if len(maps) else np.zeros(index.shape[2], np.uint64))
        place += 1
    return out


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _rows(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def select_top(slices: list[np.ndarray], valid: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are certainly among the best k, and the rows that tie for the last places."""
    sure, open_rows = np.zeros_like(valid), valid.copy()
    if _count(open_rows) <= k:
        return _rows(open_rows, n), np.empty(0, dtype=np.int64)
    need = k
    for bitmap in reversed(slices):
        ones = open_rows & bitmap
        count = _count(ones)
        if count > need:
            open_rows = ones
        else:
            sure |= ones
            need -= count
            open_rows &= ~bitmap
            if not need:
                open_rows[:] = 0
                break
    return _rows(sure, n), _rows(open_rows, n)


def _index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    held: dict[int, int] = {}

    def block(length: int) -> pa.RecordBatch:
        ids = np.concatenate([i for i, _ in waiting[length]])
        rows = np.concatenate([r for _, r in waiting[length]])
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        maps, low = slices_of(rows)
        waiting[length], held[length] = [], 0
        return pa.RecordBatch.from_pydict(
            {
                "length": pa.array([length], pa.int32()),
                "ids": [ids.tobytes()],
                "places": pa.array([maps.shape[1]], pa.int32()),
                "maps": [maps.tobytes()],
                "low": [low.tobytes()],
            }
        )

    for batch in batches:
        ids, lists = batch.column("id").to_numpy(), batch.column("v")
        lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False))
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        for length in np.unique(lengths):
            chosen = np.flatnonzero(lengths == length)
            cells = flat[(starts[chosen][:, None] + np.arange(length)[None, :])]
            for at in range(0, len(chosen), BLOCK_ROWS):
                part = slice(at, at + BLOCK_ROWS)
                waiting.setdefault(int(length), []).append((ids[chosen[part]], cells[part].astype(np.int64)))
                held[int(length)] = held.get(int(length), 0) + len(chosen[part])
                if held[int(length)] >= BLOCK_ROWS:
                    yield block(int(length))
    for length in list(waiting):
        if waiting[length]:
            yield block(length)


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The bit-sliced index: block, length, ids, places, maps, low."""
    rows = quantised(vectors, key, vector)
    blocks = rows.mapInArrow(
        _index_blocks, "length int, ids binary, places int, maps binary, low binary"
    )
    return stored(blocks.withColumn("block", F.monotonically_increasing_id()), "slices")


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                ids = np.frombuffer(row.ids, dtype=np.int64)
                low = np.frombuffer(row.low, dtype=np.int64)
                words = -(-len(ids) // 64)
                maps = np.frombuffer(row.maps, dtype=np.uint64).reshape(row.length, row.places, words)
                everyone = np.packbits(np.ones(len(ids), dtype=np.uint8), bitorder="little")
                valid = np.zeros(maps.shape[2] * 8, dtype=np.uint8)
                valid[: len(everyone)] = everyone
                valid = valid.view(np.uint64)
                out: list[tuple[int, int, int]] = []
                queries = np.frombuffer(row.query_ids, dtype=np.int64)
                vectors = np.frombuffer(row.query_maps, dtype=np.int64).reshape(len(queries), row.length)
                for query, weights in zip(queries, vectors, strict=True):
                    others = valid.copy()
                    first = np.searchsorted(ids, query)
                    while first < len(ids) and ids[first] == query:
                        others[first // 64] &= ~(np.uint64(1) << np.uint64(first % 64))
                        first += 1
                    slices = score_slices(maps, weights)
                    sure, ties = select_top(slices, others, k, len(ids))
                    # Rows are sorted by id, so the first ties are the ones with the smallest ids.
                    best = np.concatenate([sure, ties[: k - len(sure)]])
                    cells = (maps[:, :, best // 64] >> (best % 64).astype(np.uint64)) & np.uint64(1)
                    places = (np.int64(1) << np.arange(row.places, dtype=np.int64))[None, :, None]
                    values = (cells.astype(np.int64) * places).sum(axis=1) + low[:, None]
                    scores = weights @ values
                    out += [(int(query), int(ids[b]), int(s)) for b, s in zip(best, scores, strict=True)]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def _query_block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    length, part = key
    cells = np.array(frame["v"].tolist(), dtype=np.int64).reshape(len(frame), length)
    ids = frame["id"].to_numpy(dtype=np.int64)
    return pd.DataFrame(
        {"length": [length], "part": [part], "query_ids": [ids.tobytes()], "query_maps": [cells.tobytes()]}
    )


def grid(queries: int, blocks: int, tasks: int) -> tuple[int, int]:
    """Query blocks, and groups of index blocks, so that the cells make at least ``tasks`` tasks if they can."""
    most, least = -(-queries // QUERY_BLOCK), -(-queries // QUERY_BLOCK_MOST)
    parts = max(1, least, min(most, -(-tasks // max(1, blocks))))
    return parts, max(1, min(blocks, -(-tasks // parts)), -(-blocks // CELL_BLOCKS))


def top_k(
    queries: DataFrame,
    index: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k best rows of each query by inner product, without the query's own id.

    ``index`` is the result of :func:`build_index`. Returns query_id, rank,
    vec_id, score.
    """
    asked = quantised(queries, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    tasks = 4 * asked.sparkSession.sparkContext.defaultParallelism
    parts, groups = grid(asked.count(), index.count(), tasks)
    cell = ["length", "part", "group"]
    blocks = (
        asked.withColumns({"length": F.size("v"), "part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")})
        .groupBy("length", "part")
        .applyInPandas(_query_block, "length int, part int, query_ids binary, query_maps binary")
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    )
    dealt = index.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    pairs = dealt.repartition(parts * groups, *cell).join(blocks.repartition(parts * groups, *cell), cell)
    found = pairs.mapInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
