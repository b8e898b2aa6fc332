"""Trigram language model in sharded Elias-Fano tries.

Counts and tries cover all training documents. Documents are tokenised into
blocks of about ``BLOCK_BYTES``. A block sends each shard its distinct words,
later its distinct bigrams, as one packed row; the shard adds up the counts of
all blocks, builds its level, looks up what each block asked for and sends the
answers back. So the shuffles carry distinct, sorted and compressed keys, never
single tokens, and a task holds one block or one shard. Bigrams of a frequent
context are spread over shards by their second word.

Probability of a word behind a context, with Dirichlet smoothing:
``(n(context, word) + MU * p(word)) / (n(context) + MU)``, where p(word) is the
unigram estimate ``(c + 0.1) / (N + 0.1 * (V + 1))``; unseen bigrams back off to
``MU * p(word) / (n(context) + MU)``. The tries hold counts, as places among the
distinct counts of their shard. Shards answer with counts, from which a block
makes the estimates itself: log10, for seen bigrams and trigrams in steps of
1 / 4096. So neither what an estimate takes nor the estimate is ever sent.

A trigram is asked for where the bigram in front and the one at its end were
seen; its key is the place of the bigram in its shard plus the word, its estimate
``(n(bigram, word) + MU * p(word | context)) / (n(bigram) + MU)`` with the bigram
estimate as p. Where the bigram in front was not seen, the bigram estimate is
left as it is. ``score`` sums the trigram estimates, ``bigram_score`` those of the level below.

A context begins each document; an end token closes it. Null texts are empty and
score their end token alone; a null key is never learned from; repeated rows
count and score each on its own. Without training documents N and V are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import held_out, release_arrow, scratch_folder, stored
from flowloom.llm.elias_fano import Trie, mapped

BLOCK_BYTES = 8_000_000
MU = 10.0
STEPS = 4096
MOST_STEPS = 65_534
END = b""
#: Block number of rows that hold a shard's level, and the id of words a model does not know.
LEVEL, UNKNOWN = -1, 0xFFFFFFFE


def pack(values: np.ndarray) -> bytes:
    """Compressed integers: bytes of one weight lie together."""
    values = np.ascontiguousarray(values)
    head = bytes([values.dtype.itemsize]) + values.dtype.kind.encode()
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()
    return head + zstandard.compress(planes, 1)


def unpack(data: bytes) -> np.ndarray:
    size, kind = data[0], chr(data[1])
    planes = np.frombuffer(zstandard.decompress(data[2:]), dtype=np.uint8)
    flat = np.ascontiguousarray(planes.reshape(size, -1).T)
    return flat.view(np.dtype(f"{kind}{size}")).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Unsigned integers, best in runs that ascend: halves as differences, the lower ones where the upper one stays."""
    high, low = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)
    steps = low.copy()
    steps[1:] -= np.where(high[1:] == high[:-1], low[:-1], np.uint32(0))
    upper = pack(np.diff(high, prepend=np.uint32(0)))
    return len(upper).to_bytes(4, "little") + upper + pack(steps)


def unpack_keys(data: bytes) -> np.ndarray:
    cut = 4 + int.from_bytes(data[:4], "little")
    upper, steps = unpack(data[4:cut]), unpack(data[cut:])
    low = np.cumsum(steps, dtype=np.uint32)
    # Sums begin anew where the upper half moves.
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(upper)), dtype=bool), upper[1:] != 0]))
    low -= np.repeat(low[first] - steps[first], np.diff(np.append(first, len(steps))))
    return (np.cumsum(upper, dtype=np.uint32).astype(np.uint64) << np.uint64(32)) | low


def pack_words(words: list[bytes]) -> bytes:
    """Words hold no white space."""
    return zstandard.compress(b" ".join(words), 3)


def unpack_words(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b" ")


def shard_of(word: bytes, shards: int) -> int:
    return xxhash.xxh3_64_intdigest(word) % shards


def unigram(count: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    return (count + 0.1) / (tokens + 0.1 * (distinct + 1))


# -- blocks ------------------------------------------------------------------

_BLOCK = "block bigint, keys array<bigint>, held binary, lengths binary, tokens binary, words binary, counts binary, shards binary"


def _tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words in the order of their bytes; the word of each token, the end as -1; tokens of each text."""
    # Not all texts need be valid, and only bytes are looked at.
    whole = pa.array([t.lower() for t in texts], pa.large_binary()).view(pa.large_string())
    lists = pc.ascii_split_whitespace(whole)
    flat, of = lists.flatten().view(pa.large_binary()), pc.list_parent_indices(lists).to_numpy()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = flat.filter(pa.array(real)).dictionary_encode()
    lengths = np.bincount(of[real], minlength=len(texts)) + 1
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order))
    tokens = np.full(int(lengths.sum()), -1, dtype=np.int32)
    inside = np.ones(len(tokens), dtype=bool)
    inside[np.cumsum(lengths) - 1] = False
    tokens[inside] = rank[coded.indices.to_numpy()]
    return coded.dictionary.take(pa.array(order)).to_pylist(), tokens, lengths.astype(np.int64)


def _block(number: int, keys: list, held: list[bool], texts: list[bytes], shards: int) -> dict:
    """Tokens as places in the block's words, which are sorted by shard and bytes."""
    words, tokens, lengths = _tokens(texts)
    words, tokens = [END, *words], tokens + 1
    shard = np.array([shard_of(w, shards) for w in words])
    order = np.argsort(shard, kind="stable")
    known = [words[i] for i in order.tolist()]
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order))
    tokens = place[tokens]
    learned = np.repeat(~np.array(held, dtype=bool), lengths)
    counts = np.bincount(tokens[learned], minlength=len(known)).astype(np.int64)
    sizes = np.bincount(shard, minlength=shards).astype(np.int64)
    return {
        "block": number,
        "keys": keys,
        "held": np.array(held, dtype=np.uint8).tobytes(),
        "lengths": pack(lengths),
        "tokens": pack(tokens),
        "words": pack_words(known),
        "counts": pack(counts),
        "shards": pack(sizes),
    }


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_BLOCK_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("keys", pa.list_(pa.int64())),
        *[(n, pa.binary()) for n in ("held", "lengths", "tokens", "words", "counts", "shards")],
    ]
)


def make_blocks(docs: DataFrame, key: str, text: str, folds: int | None, shards: int) -> str:
    """Writes the blocks, each into a folder of its own; returns the folder of all. Without folds nothing is learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        keys: list = []
        held: list[bool] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            words = batch.column("t").cast(pa.binary())
            for row in range(batch.num_rows):
                data = words[row].as_py() or b""
                keys.append(batch.column("k")[row].as_py())
                held.append(batch.column("h")[row].as_py())
                texts.append(data)
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield _rows([_block(number, keys, held, texts, shards)], _BLOCK_ARROW)
                    number, size = number + 1, 0
                    keys, held, texts = [], [], []
                    release_arrow()
        if texts:
            yield _rows([_block(number, keys, held, texts, shards)], _BLOCK_ARROW)

    rows = docs.select(
        F.col(key).cast("bigint").alias("k"),
        (F.lit(True) if folds is None else held_out(key, folds)).alias("h"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
    )
    folder = scratch_folder(docs.sparkSession, "blocks")
    rows.mapInArrow(run, _BLOCK).write.partitionBy("block").parquet(folder)
    return folder


def read_block(folder: str, number: int) -> dict:
    """A block, read by the task that needs it, so that tokens are never shuffled."""
    from pyarrow import fs, parquet

    system, base = fs.FileSystem.from_uri(folder)
    files = system.get_file_info(fs.FileSelector(f"{base}/block={number}"))
    (path,) = [f.path for f in files if f.path.endswith(".parquet")]
    with system.open_input_file(path) as source:
        return parquet.ParquetFile(source).read().to_pylist()[0] | {"block": number}


def blocks_in(spark, folder: str) -> DataFrame:
    return spark.read.schema(_BLOCK).parquet(folder)


# -- words -------------------------------------------------------------------

_ANSWER = "shard int, block bigint, first binary, second binary, third binary, tokens bigint, distinct bigint"
_ANSWER_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int64()),
        ("first", pa.binary()),
        ("second", pa.binary()),
        ("third", pa.binary()),
        ("tokens", pa.int64()),
        ("distinct", pa.int64()),
    ]
)
_ASK = "shard int, block bigint, keys binary, counts binary"
_ASK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            words, counts, sizes = unpack_words(row["words"]), unpack(row["counts"]), unpack(row["shards"])
            ends = np.cumsum(sizes)
            asked = [
                {
                    "shard": shard,
                    "block": row["block"],
                    "keys": pack_words(words[end - size : end]),
                    "counts": pack(counts[end - size : end]),
                }
                for shard, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True))
                if size
            ]
            yield _rows(asked, _ASK_ARROW)


def _count_words(shards: int):
    """The words of a shard, and answers: id and count of each word.

    Ids are the place in the shard times the shards, plus the shard.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shard = rows[0]["shard"]
        lists = [unpack_words(r["keys"]) for r in rows]
        place: dict[bytes, int] = {}
        spots = []
        for words in lists:
            spots.append(np.array([place.setdefault(w, len(place)) for w in words], dtype=np.int64))
        total = np.zeros(len(place), dtype=np.int64)
        for spot, row in zip(spots, rows, strict=True):
            total[spot] += unpack(row["counts"])
        # By falling count, so frequent words have small ids.
        number = np.empty(len(place), dtype=np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(place))
        ids = number * shards + shard
        if len(ids) and int(ids.max()) >= UNKNOWN:
            raise ValueError("more words than 32-bit ids tell apart")
        ids = ids.astype(np.uint32)
        out = [_answer(row, pack(ids[spot]), pack(total[spot])) for spot, row in zip(spots, rows, strict=True)]
        level = _answer({"shard": shard, "block": LEVEL}, pack_words(list(place)), pack(total), pack(ids))
        # The sums of the shard go with its level.
        out.append(level | {"tokens": int(total.sum()), "distinct": int((total > 0).sum())})
        return pa.Table.from_pylist(out, schema=_ANSWER_ARROW)

    return run


def _answer(row: dict, first: bytes, second: bytes = b"", third: bytes = b"") -> dict:
    return {
        "shard": row["shard"], "block": row["block"], "first": first, "second": second, "third": third, "tokens": 0, "distinct": 0
    }


def _known_words(left: pa.Table, right: pa.Table) -> pa.Table:
    """As _count_words, by the stored words of a shard."""
    place: dict[bytes, int] = {}
    ids, total = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
    for level in right.to_pylist():
        place = {w: i for i, w in enumerate(unpack_words(level["first"]))}
        ids, total = unpack(level["third"]), unpack(level["second"])
    ids, total = np.append(ids, np.uint32(UNKNOWN)), np.append(total, 0)
    out = []
    for row in left.to_pylist():
        spot = np.array([place.get(w, len(ids) - 1) for w in unpack_words(row["keys"])], dtype=np.int64)
        out.append(_answer(row, pack(ids[spot]), pack(total[spot])))
    return pa.Table.from_pylist(out, schema=_ANSWER_ARROW)


# -- bigrams -----------------------------------------------------------------


def _bigrams(row: dict, ids: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys sorted by shard and key, their shards, the key place of each token, training counts.

    A key is the context in the upper and the word in the lower 32 bits. Context
    0 is the start of a document, ids are moved up by one.
    """
    lengths, tokens = unpack(row["lengths"]), unpack(row["tokens"])
    moved = ids.astype(np.uint64)[tokens] + np.uint64(1)
    context = np.concatenate([[np.uint64(0)], moved[:-1]]) if len(moved) else moved
    context[np.cumsum(lengths)[:-1]] = 0
    keys, place = np.unique((context << np.uint64(32)) | moved, return_inverse=True)
    mixed = (keys >> np.uint64(32)) * np.uint64(0x9E3779B1) + (keys & np.uint64(15)) * np.uint64(0x85EBCA77)
    shard = ((mixed >> np.uint64(7)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    place = back[place]
    learned = np.repeat(np.frombuffer(row["held"], dtype=np.uint8) == 0, lengths)
    counts = np.bincount(place[learned], minlength=len(keys))
    return keys[order], shard[order], place, counts


def _joined(rows: list[dict], column: str, read=unpack) -> np.ndarray:
    """The answers of all shards, which were asked in the order of their numbers."""
    return np.concatenate([read(r[column]) for r in sorted(rows, key=lambda r: r["shard"])])


def _asks(block: int, shards: int, shard: np.ndarray, keys: np.ndarray, seen: np.ndarray) -> pa.Table:
    """A row per shard that is asked; keys are sorted by shard."""
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    out = []
    for s in np.flatnonzero(np.diff(bounds)).tolist():
        part = slice(bounds[s], bounds[s + 1])
        row = {"shard": s, "block": block, "keys": pack_keys(keys[part]), "counts": pack(seen[part].astype(np.uint32))}
        out.append(row)
    return pa.Table.from_pylist(out, schema=_ASK_ARROW)


def _ask_bigrams(shards: int, folder: str):
    def run(right: pa.Table) -> pa.Table:
        release_arrow()
        answers = right.to_pylist()
        row = read_block(folder, answers[0]["block"])
        keys, shard, _, seen = _bigrams(row, _joined(answers, "first"), shards)
        return _asks(row["block"], shards, shard, keys, seen)

    return run


def smoothed(seen: np.ndarray, word: np.ndarray, context: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    return (seen + MU * unigram(word, tokens, distinct)) / (context + MU)


def stepped(estimate: np.ndarray) -> np.ndarray:
    """Their log10 in steps."""
    return np.clip(np.round(-np.log10(estimate) * STEPS), 0, MOST_STEPS) / -STEPS


class _Asked:
    """The distinct keys that blocks ask a shard for, and where each block's keys are among them."""

    def __init__(self, rows: list[dict]) -> None:
        lists = [unpack_keys(r["keys"]) for r in rows]
        self.rows, self.ends = rows, np.cumsum([len(k) for k in lists], dtype=np.int64)
        self.keys, self.back = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *lists]), return_inverse=True)

    def level(self) -> tuple[bytes, np.ndarray]:
        """The trie of the training n-grams, and their distinct counts, whose places are its values."""
        seen = np.concatenate([unpack(r["counts"]) for r in self.rows])
        total = np.bincount(self.back, weights=seen, minlength=len(self.keys)).astype(np.int64)
        learned = total > 0
        return _trie(self.keys[learned], total[learned])

    def answers(self, level: bytes, counts: np.ndarray, places: bool) -> list[dict]:
        """The count of each key, and the places in the trie of those that were seen."""
        value, found, spot = Trie(mapped(level)).find(self.keys >> np.uint64(32), self.keys & np.uint64(0xFFFFFFFF))
        total = np.zeros(len(self.keys), dtype=np.uint32)
        total[found] = counts[value[found]]
        out = []
        for row, back in zip(self.rows, np.split(self.back, self.ends[:-1]), strict=True):
            at = spot[back[found[back]]].astype(np.uint64) if places else None
            out.append(_answer(row, pack(total[back]), third=b"" if at is None else pack_keys(at)))
        return out


def _trie(keys: np.ndarray, seen: np.ndarray) -> tuple[bytes, np.ndarray]:
    counts, value = np.unique(seen, return_inverse=True)
    if len(counts) > 1 << 16:
        raise ValueError("a shard has more distinct counts than 16 bits tell apart; use more shards")
    return Trie.encode(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), value.astype(np.uint16)), counts.astype(np.uint32)


def _look_up(places: bool):
    """The n-grams of a shard, and answers."""

    def run(table: pa.Table) -> pa.Table:
        release_arrow()
        rows = table.to_pylist()
        asked = _Asked(rows)
        level, counts = asked.level()
        # The trie holds the keys.
        own = _answer({"shard": rows[0]["shard"], "block": LEVEL}, level, pack(counts))
        return pa.Table.from_pylist([*asked.answers(level, counts, places), own], schema=_ANSWER_ARROW)

    return run


def _known_ngrams(places: bool):
    """As _look_up, by the stored level of a shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, levels = left.to_pylist(), right.to_pylist()
        if levels:
            level, counts = levels[0]["first"], unpack(levels[0]["second"])
        else:
            level, counts = _trie(np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
        out = _Asked(asked).answers(level, counts, places) if asked else []
        return pa.Table.from_pylist(out, schema=_ANSWER_ARROW)

    return run


# -- trigrams ----------------------------------------------------------------


class _Trigrams:
    """Distinct trigrams of a block whose two bigrams were seen, sorted by shard, first bigram and word.

    A key is the place of the first bigram in its shard in the upper and the
    word in the lower 32 bits. Trigrams lie in the shard of the first bigram,
    moved on by the word, so those of a frequent bigram are spread; shard and word
    tell which shard the place is of.
    """

    def __init__(self, row: dict, ids: np.ndarray, counts: np.ndarray, shards: int) -> None:
        keys, shard, self.place, _ = _bigrams(row, ids, shards)
        self.counts = counts
        seen = counts > 0
        lengths = unpack(row["lengths"])
        self.before = np.concatenate([[0], self.place[:-1]]) if len(self.place) else self.place
        #: Tokens behind a seen bigram, and those of them whose own bigram was seen too.
        self.behind = seen[self.before]
        self.behind[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
        self.asked = np.flatnonzero(self.behind & seen[self.place])
        front = self.before[self.asked].astype(np.uint64)
        word = keys[self.place[self.asked]] & np.uint64(0xFFFFFFFF)
        # Bigrams lie in the order of shard and key, so their places ascend with their numbers in a shard.
        names, of = np.unique((front << np.uint64(32)) | word, return_inverse=True)
        front, word = (names >> np.uint64(32)).astype(np.int64), names & np.uint64(0xFFFFFFFF)
        moved = ((word & np.uint64(15)) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(shards)
        to = (shard[front] + moved.astype(np.int64)) % shards
        order = np.argsort(to, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        self.of, self.shard, self.front, self.word = back[of], to[order], front[order], word[order]
        learned = np.repeat(np.frombuffer(row["held"], dtype=np.uint8) == 0, lengths)[self.asked]
        self.seen = np.bincount(self.of[learned], minlength=len(names))

    def keys(self, spots: np.ndarray) -> np.ndarray:
        """By the places of the seen bigrams."""
        if len(spots) and int(spots.max()) >> 32:
            raise ValueError("a shard has more bigrams than 32 bits tell apart; use more shards")
        spot = np.zeros(len(self.counts), dtype=np.uint64)
        spot[self.counts > 0] = spots
        return (spot[self.front] << np.uint64(32)) | self.word


def _split(answers: list[dict]) -> list[list[dict]]:
    """Answers about words, bigrams and trigrams."""
    return [[r for r in answers if r["level"] == level] for level in (1, 2, 3)]


def _ask_trigrams(shards: int, folder: str):
    def run(right: pa.Table) -> pa.Table:
        release_arrow()
        answers = right.to_pylist()
        of_words, of_bigrams, _ = _split(answers)
        row = read_block(folder, answers[0]["block"])
        own = _Trigrams(row, _joined(of_words, "first"), _joined(of_bigrams, "first"), shards)
        return _asks(row["block"], shards, own.shard, own.keys(_joined(of_bigrams, "third", unpack_keys)), own.seen)

    return run


# -- scores ------------------------------------------------------------------

_SCORE = "k bigint, h boolean, n_tokens bigint, n_known bigint, base_score double, bigram_score double, score double"
_SCORE_ARROW = pa.schema(
    [
        ("k", pa.int64()),
        ("h", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base_score", pa.float64()),
        ("bigram_score", pa.float64()),
        ("score", pa.float64()),
    ]
)


def _score(shards: int, tokens: int, distinct: int, folder: str):
    def run(right: pa.Table) -> pa.Table:
        release_arrow()
        answers = right.to_pylist()
        of_words, of_bigrams, of_trigrams = _split(answers)
        row = read_block(folder, answers[0]["block"])
        ids, counts = _joined(of_words, "first"), _joined(of_words, "second")
        deep = _Trigrams(row, ids, _joined(of_bigrams, "first"), shards)
        own, lengths = unpack(row["tokens"]), unpack(row["lengths"])
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        word = counts[own]
        # Documents start as often as they end.
        context = np.concatenate([[0], word[:-1]])
        context[first] = word[-1]
        seen = deep.counts[deep.place]
        estimate = smoothed(seen, word, context, tokens, distinct)
        logs = np.where(seen > 0, stepped(estimate), np.log10(estimate))
        # Back off from trigrams that were not seen.
        deeper = logs.copy()
        deeper[deep.behind] += np.log10(MU / (deep.counts[deep.before[deep.behind]] + MU))
        if of_trigrams:
            seen, at = _joined(of_trigrams, "first")[deep.of], deep.asked
            estimate = (seen + MU * 10.0 ** logs[at]) / (deep.counts[deep.before[at]] + MU)
            deeper[at] = np.where(seen > 0, stepped(estimate), deeper[at])
        base = np.log10(unigram(counts, tokens, distinct))
        return pa.table(
            [
                pa.array(row["keys"], pa.int64()),
                pa.array(np.frombuffer(row["held"], dtype=np.uint8) == 1),
                pa.array(lengths),
                pa.array(np.add.reduceat((word > 0).astype(np.int64), first)),
                pa.array(np.add.reduceat(base[own], first)),
                pa.array(np.add.reduceat(logs, first)),
                pa.array(np.add.reduceat(deeper, first)),
            ],
            schema=_SCORE_ARROW,
        )

    return run


class LanguageModel(NamedTuple):
    """Levels of all shards in the shared folder, and the sums of the training documents."""

    shards: int
    tokens: int
    distinct: int
    words: DataFrame
    bigrams: DataFrame
    trigrams: DataFrame


def fit_and_score(
    docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10
) -> tuple[LanguageModel, DataFrame]:
    """Learn from the documents that are not held out and score all; keys and texts travel once for both."""
    rows = docs.select(key, text)
    shards = max(8, 2 * rows.rdd.getNumPartitions())
    blocks = make_blocks(rows, key, text, folds, shards)
    asked = blocks_in(docs.sparkSession, blocks).select("block", "words", "counts", "shards").mapInArrow(_ask_words, _ASK)
    words = stored(asked.groupBy("shard").applyInArrow(_count_words(shards), _ANSWER), "unigrams")
    sums = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, distinct = int(sums[0]), int(sums[1])
    pairs = _pairs(blocks, words, shards)
    bigrams = stored(pairs.groupBy("shard").applyInArrow(_look_up(True), _ANSWER), "bigrams")
    triples = _triples(blocks, words, bigrams, shards)
    trigrams = stored(triples.groupBy("shard").applyInArrow(_look_up(False), _ANSWER), "trigrams")
    levels = [t.filter(F.col("block") == LEVEL) for t in (words, bigrams, trigrams)]
    model = LanguageModel(shards, tokens, distinct, *levels)
    return model, _scores(blocks, words, bigrams, trigrams, model, key)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> LanguageModel:
    return fit_and_score(docs, key, text, folds)[0]


def score(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score any documents by a fitted model; nothing is learned from them, so all are held out."""
    blocks = make_blocks(docs.select(key, text), key, text, None, model.shards)
    asked = blocks_in(docs.sparkSession, blocks).select("block", "words", "counts", "shards").mapInArrow(_ask_words, _ASK)
    words = stored(_known(asked, model.words, _known_words), "unigrams")
    bigrams = stored(_known(_pairs(blocks, words, model.shards), model.bigrams, _known_ngrams(True)), "bigrams")
    trigrams = _known(_triples(blocks, words, bigrams, model.shards), model.trigrams, _known_ngrams(False))
    return _scores(blocks, words, bigrams, trigrams, model, key)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Rows: key, held_out, n_tokens, n_known, train_tokens, base_score, bigram_score, score."""
    return fit_and_score(docs, key, text, folds)[1]


def _known(asked: DataFrame, level: DataFrame, look_up) -> DataFrame:
    return asked.groupBy("shard").cogroup(level.groupBy("shard")).applyInArrow(look_up, _ANSWER)


def _of_blocks(*answers: tuple[DataFrame, str]) -> DataFrame:
    """Answers about words, bigrams and trigrams, as level 1 to 3, without the levels of the shards.

    Each comes with the columns that are wanted of it; the others stay behind.
    """
    found = None
    for level, (one, wanted) in enumerate(answers, 1):
        empty = F.lit(b"")
        columns = [F.col(c) if c in wanted.split() else empty.alias(c) for c in ("first", "second", "third")]
        rows = one.filter(F.col("block") != LEVEL).select("block", "shard", *columns, F.lit(level).alias("level"))
        found = rows if found is None else found.unionByName(rows)
    return found


def _pairs(blocks: str, words: DataFrame, shards: int) -> DataFrame:
    return _of_blocks((words, "first")).groupBy("block").applyInArrow(_ask_bigrams(shards, blocks), _ASK)


def _triples(blocks: str, words: DataFrame, bigrams: DataFrame, shards: int) -> DataFrame:
    answers = _of_blocks((words, "first"), (bigrams, "first third"))
    return answers.groupBy("block").applyInArrow(_ask_trigrams(shards, blocks), _ASK)


def _scores(blocks: str, words, bigrams, trigrams, model: LanguageModel, key: str) -> DataFrame:
    answers = _of_blocks((words, "first second"), (bigrams, "first"), (trigrams, "first")).groupBy("block")
    scored = answers.applyInArrow(_score(model.shards, model.tokens, model.distinct, blocks), _SCORE)
    return scored.select(
        F.col("k").alias(key),
        F.col("h").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "bigram_score",
        "score",
    )
