"""Shards, Merkle manifest, collocations."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.llm import collocations, merkle, prefix, sharding
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, place string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(data_dir):
    found = duckdb.execute(f"select doc_id, text, lang, source, n_chars from '{data_dir}/documents.parquet'").fetchall()
    odd = [
        (None, None, None, None, None),
        (None, "", "", "s", 0),
        (None, None, None, None, None),
        (7, "é漢🙂 a, b", "en", None, 9),
        (7, "é漢🙂 a, b", "en", None, 9),
        (900_001, "long, " * 60_000, "xx", "s", 360_000),
        (900_002, "alone", "zz", "s", None),
    ]
    return [*found, *odd]


# -- numbering ---------------------------------------------------------------


def test_numbers_and_sums_of_hot_groups(spark):
    draw = random.Random(5)
    rows = [("hot" if draw.random() < 0.7 else f"g{draw.randrange(9)}", draw.choice([None, *range(20)]), draw.randrange(99)) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "g string, k bigint, v bigint").repartition(7)
    found, totals = prefix.numbered(frame, ["k", "v"], group="g", sums=["v"])
    found = [r.asDict() for r in found.collect()]
    for g in {r[0] for r in rows}:
        own = sorted((r for r in found if r["g"] == g), key=lambda r: r["place"])
        wanted = sorted((r[1:] for r in rows if r[0] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [(r["k"], r["v"]) for r in own] == wanted
        assert [r["place"] for r in own] == list(range(len(wanted)))
        assert [r["v_before"] for r in own] == [sum(v for _, v in wanted[:i]) for i in range(len(wanted))]
        assert {(r["n"], r["v_all"]) for r in own} == {(len(wanted), sum(v for _, v in wanted))}
    assert {r["g"]: r["n"] for r in totals.collect()} == Counter(r[0] for r in rows)


# -- shards ------------------------------------------------------------------


def plain_shards(docs, shards):
    sized = [(k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, *_ in docs]
    sized.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, before, slots, out = sum(r[1] for r in sized), 0, Counter(), []
    for k, size, crc in sized:
        shard = (2 * before + size) * shards // (2 * total)
        out.append((k, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_equal_the_plain_cut(spark, docs, shards):
    found = sharding.assign(frame(spark, docs).repartition(5), shards)
    assert Counter(map(tuple, found.collect())) == Counter(plain_shards(docs, shards))


def test_shards_of_small_tables(spark):
    assert sharding.assign(frame(spark, []), 40).count() == 0
    one = sharding.assign(frame(spark, [(1, None, None, None, None)]), 40).collect()
    assert [(r["size"], r["text_crc32"], r["slot"]) for r in one] == [(16, 0, 0)] and 0 <= one[0]["shard"] < 40


def test_shards_are_balanced(spark, docs):
    usual = [d for d in docs if d[0] is not None and d[0] < 900_000]
    rows = sharding.assign(frame(spark, usual), 10).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()
    most = max(len(d[1].encode()) + 16 for d in usual)
    target = sum(r["bytes"] for r in rows) / 10
    assert len(rows) == 10 and all(abs(r["bytes"] - target) <= most for r in rows)


def test_written_shards_hold_the_rows_in_order(spark, docs, folder):
    sharding.write_shards(frame(spark, docs), f"{folder}/shards", 7)
    written = spark.read.parquet(f"{folder}/shards").select("shard", "slot", "row.doc_id", "row.text").collect()
    wanted = {(r[4], r[5]): (r[0], r[2]) for r in plain_shards(docs, 7)}
    assert {(r["shard"], r["slot"]): (r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in written} == wanted
    assert len(written) == len(docs)


# -- Merkle manifest ---------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc, more=0):
    k, text, lang, source, n = doc
    fields = [k, source, lang, n if n is None else n + more, text]
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def plain_tree(leaves):
    """Levels of the tree, lowest first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def plain_path(levels, at):
    path = []
    for level in levels[:-1]:
        beside = at ^ 1
        path.append((beside < at, level[beside]) if beside < len(level) else None)
        at >>= 1
    return path


def plain_manifest(docs):
    groups = {}
    for doc in docs:
        groups.setdefault(doc[2], []).append(doc)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda d: (d[0] is not None, d[0] or 0, plain_leaf(d)))
    trees = {g: plain_tree([plain_leaf(d) for d in groups[g]]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names])
    root, out = top[-1][0], []
    for place, g in enumerate(names):
        for at, doc in enumerate(groups[g]):
            path = plain_path(trees[g], at) + plain_path(top, place)
            tampered = doc[0] is not None and doc[4] is not None and brute.crc(doc[0]) % 7 == 0
            end = plain_leaf(doc, 1) if tampered else plain_leaf(doc)
            for step in path:
                end = sha(end) if step is None else sha(step[1], end) if step[0] else sha(end, step[1])
            proof = sha(*[step[1] for step in path if step])
            out.append((doc[0], plain_leaf(doc), trees[g][-1][0], root, proof, end, end == root))
    return out


def built(docs):
    fields = lambda n: merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang")], n, F.col("text"))
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return merkle.manifest(docs, fields(F.col("n_chars")), F.when(tampered & F.col("n_chars").isNotNull(), fields(F.col("n_chars") + 1)))


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest_equals_the_plain_tree(spark, docs, levels, monkeypatch):
    """Small runs take several rounds in the groups and above them."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "RUN", 1 << levels)
    some = docs if levels > 1 else docs[-40:]
    found = built(frame(spark, some).repartition(5)).collect()
    assert Counter(map(tuple, found)) == Counter(plain_manifest(some))
    assert any(r["verified"] for r in found) and not all(r["verified"] for r in found)


def test_manifest_of_small_tables(spark):
    assert built(frame(spark, [])).count() == 0
    lone = [(1, "a", "en", "s", 1)]
    assert [tuple(r) for r in built(frame(spark, lone)).collect()] == plain_manifest(lone)


def test_sweeps_deliver_every_proof():
    for n in (1, 2, 3, 5, 8, 13):
        leaves = [sha(str(i)) for i in range(n)]
        levels = plain_tree(leaves)
        known = merkle.up_sweep(leaves, len(levels) - 1)
        assert [known[len(levels) - 1, 0]] == levels[-1]
        for at, proof in enumerate(merkle.down_sweep(known, len(levels) - 1, "-")):
            assert [(side == "L", digest) if digest else None for side, digest in merkle.steps_of(proof)] == [*plain_path(levels, at), None]
            assert merkle.folded(leaves[at], proof) == sha(levels[-1][0])


# -- collocations ------------------------------------------------------------


def pieces_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def plain_collocations(docs, least, top):
    out = []
    by_lang = {}
    for _, text, lang, *_ in docs:
        by_lang.setdefault("und" if lang is None else lang, []).extend(pieces_of(text))
    for lang, pieces in by_lang.items():
        n = sum(map(len, pieces))
        count = Counter(tuple(p[i : i + k]) for p in pieces for i in range(len(p)) for k in range(1, 6) if i + k <= len(p))
        found = {g: c for g, c in count.items() if len(g) > 1 and c >= least}
        inside = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        rows = []
        for g, a in found.items():
            if any(len(h) > len(g) and 100 * c >= 100 * a and inside(g, h) for h, c in found.items()):
                continue
            cuts = [((1000 * a * n) // (count[g[:k]] * count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


ODD = [
    (1, None, None, None, 0),
    (2, "", "en", None, 0),
    (3, "A a\ta A a a\x0ba a. .,!? É é É é a\xa0b a\xa0b \x1c \x1c \x1c \x1c", "en", None, 0),
    (4, "no full stop " * 4000, "en", None, 0),
    (5, "x" * 20_000 + " y", "fr", None, 0),
    (6, "A b c d e f a b c d e f \U0001f642 漢字 " * 30, None, None, 0),
    (7, "a b c d e f a b c d e f " * 30, "und", None, 0),
]


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (8, 7)])
def test_collocations_equal_plain_counts(spark, docs, least, top):
    rows = [*ODD, *docs[:60]]
    found = collocations.collocations(frame(spark, rows).repartition(3), least=least, top=top)
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, least, top)


@pytest.mark.parametrize("segment", [1, 9, 50, 700, 4_000_000])
@pytest.mark.parametrize("batch", [3, 60, 400_000])
def test_windows_do_not_depend_on_segments_and_batches(docs, monkeypatch, segment, batch):
    """Cut pieces, and filters that let everything pass, give every phrase its count."""
    monkeypatch.setattr(collocations.segments, "__defaults__", (segment,))
    monkeypatch.setattr(collocations, "WORDS_PER_BATCH", batch)
    rows = [(r[2] or "und", (r[1] or "")[:3000].encode()) for r in [*ODD, *docs[:6]]]
    record = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "text"]
    )
    everything = lambda hashes: np.ones(len(hashes), dtype=bool)
    found = Counter()
    for one in collocations._batches(iter([record])):
        for row in collocations._count_windows(one, everything, everything).to_pylist():
            words = [row[f"w{i}"] for i in range(1, 6) if row[f"w{i}"] is not None]
            for k in range(1, len(words) + 1):
                found[row["lang"], *words[:k]] += row["count"]
    wanted = Counter()
    for lang, text in rows:
        for p in pieces_of(text.decode()):
            wanted.update((lang, *p[i : i + k]) for i in range(len(p)) for k in range(1, 6) if i + k <= len(p))
    assert found == wanted


def test_filters_keep_every_frequent_hash(spark):
    hashes = np.array([*range(-50, 50), 2**63 - 1, -(2**63)], dtype=np.int64)
    counted = spark.createDataFrame([(int(h), 5 + (i % 2)) for i, h in enumerate(hashes)], "hash bigint, count bigint")
    kept = collocations._filter(counted, 6)(hashes.view(np.uint64))
    assert kept[1::2].all() and not kept[0::2].all()


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    phrases = [("en", "a b", 10**12 + 1), ("en", "a", 3 * 10**12), ("en", "b", 7 * 10**12)]
    made = spark.createDataFrame(phrases, "lang string, phrase string, count bigint")
    totals = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n bigint")
    row = collocations.scored(made, totals, 5, 1000).collect()[0]
    assert row["score"] == (1000 * (10**12 + 1) * 9 * 10**13) // (21 * 10**24)
