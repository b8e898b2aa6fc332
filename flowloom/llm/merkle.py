"""Merkle manifest of a dataset by time-forward processing.

Nodes of the tree have labels in the order in which they can be computed: by
level, then place. A priority queue ordered by label delivers the digests of
children to their parents; nodes are taken in the order of their labels, so a
node is taken when all its messages are there. A reversed sweep, parents first,
delivers to each child what proves its parent, with the child's own sibling in
front: the proof of a leaf is the suffix that arrives there.

The queue is external: labels are dealt to runs of ``RUN`` leaves below one node
``LEVELS`` levels up. Messages inside a run stay in its task's heap; messages
that leave it are rows of a stored table, which Spark deals and sorts by the
label of the run they go to. So a task holds one run, whatever the size of a
group, and a group of n leaves takes log(n) / ``LEVELS`` rounds.

A leaf is the digest of its fields, each ``-`` if null, else its UTF-8 bytes, a
colon and its text. Leaves of a group stand in the order of their key (nulls
first), those of one key in the order of their digests; repeated rows have equal
digests. The subroots of the groups, null first, form the tree above. An empty
table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored
from flowloom.llm.prefix import numbered

LEVELS = 12
RUN = 1 << LEVELS


def leaf_digest(*fields: Column) -> Column:
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(field.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def digest_of(*children: str) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def up_sweep(digests: list[str], levels: int) -> dict[tuple[int, int], str]:
    """Digest of every node of a run, by label (level, place); the leaves are level 0."""
    queue = [((0, place), 0, digest) for place, digest in enumerate(digests)]
    known: dict[tuple[int, int], str] = {}
    while queue:
        label, _, digest = heappop(queue)
        if label[0]:
            # Messages of one label lie next to each other in the queue, left child first.
            children = [digest]
            while queue and queue[0][0] == label:
                children.append(heappop(queue)[2])
            digest = digest_of(*children)
        known[label] = digest
        level, place = label
        if level < levels:
            heappush(queue, ((level + 1, place >> 1), place & 1, digest))
    return known


def down_sweep(known: dict[tuple[int, int], str], levels: int, suffix: str) -> list[str]:
    """Proof of every leaf of a run, whose top is proved by ``suffix``.

    A proof has a step per level: L or R (the side of the sibling) and its digest, or
    ``-`` where there is none.
    """
    queue = [((-levels, 0), suffix)] if known else []
    proofs: dict[int, str] = {}
    while queue:
        (minus, place), proof = heappop(queue)
        if not minus:
            proofs[place] = proof
            continue
        below = -minus - 1
        left, right = known[below, 2 * place], known.get((below, 2 * place + 1))
        if right is None:
            heappush(queue, ((minus + 1, 2 * place), f"-{proof}"))
        else:
            heappush(queue, ((minus + 1, 2 * place), f"R{right}{proof}"))
            heappush(queue, ((minus + 1, 2 * place + 1), f"L{left}{proof}"))
    return [proofs[place] for place in range(len(proofs))]


def steps_of(proof: str) -> list[tuple[str, str]]:
    """Side and digest of each step."""
    steps, at = [], 0
    while at < len(proof):
        size = 0 if proof[at] == "-" else 64
        steps.append((proof[at], proof[at + 1 : at + 1 + size]))
        at += 1 + size
    return steps


def folded(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof come to."""
    for side, sibling in steps_of(proof):
        leaf = digest_of(sibling, leaf) if side == "L" else digest_of(leaf, sibling)
    return leaf


def siblings_digest(proof: str) -> str:
    return digest_of(*[sibling for _, sibling in steps_of(proof)])


# -- rounds ------------------------------------------------------------------

_UP = "g string, place bigint, digest binary, n bigint"
_UP_ARROW = pa.schema([("g", pa.string()), ("place", pa.int64()), ("digest", pa.binary()), ("n", pa.int64())])
_DOWN = "g string, run bigint, suffix string, subroot string"
_DOWN_ARROW = pa.schema([("g", pa.string()), ("run", pa.int64()), ("suffix", pa.string()), ("subroot", pa.string())])


def _levels(n: Column, below: int) -> Column:
    """Levels that a run goes up, if ``below`` of the levels above n leaves are done."""
    whole = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    return F.greatest(F.least(whole - below, F.lit(LEVELS)), F.lit(0)).cast("int")


def _runs(nodes: DataFrame, below: int, name: str) -> DataFrame:
    """Stored rows (g, run, n, levels, nodes) of nodes (g, place, digest, ...) and leaves n of the group."""
    rest = [c for c in nodes.columns if c not in ("g", "place", "n")]
    dealt = nodes.withColumn("run", F.shiftright("place", LEVELS)).groupBy("g", "run")
    # At most RUN nodes a row.
    nodes_of = F.sort_array(F.collect_list(F.struct("place", *rest))).alias("nodes")
    packed = dealt.agg(F.max("n").alias("n"), nodes_of)
    return stored(packed.withColumn("levels", _levels(F.col("n"), below)), name)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One run at a time as Python values."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _go_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        known = up_sweep([x["digest"].hex() for x in row["nodes"]], row["levels"])
        top = bytes.fromhex(known[row["levels"], 0])
        yield pa.RecordBatch.from_pylist(
            [{"g": row["g"], "place": row["run"], "digest": top, "n": row["n"]}], schema=_UP_ARROW
        )


def _go_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        known = up_sweep([x["digest"].hex() for x in row["nodes"]], row["levels"])
        proofs = down_sweep(known, row["levels"], row["suffix"])
        out = [
            {"g": row["g"], "run": x["place"], "suffix": p, "subroot": row["subroot"]}
            for x, p in zip(row["nodes"], proofs, strict=True)
        ]
        yield pa.RecordBatch.from_pylist(out, schema=_DOWN_ARROW)


def _climb(nodes: DataFrame, most: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every round, lowest first, and the single node of each group."""
    rounds: list[DataFrame] = []
    while True:
        rounds.append(_runs(nodes, LEVELS * len(rounds), f"{name}_runs"))
        nodes = stored(rounds[-1].mapInArrow(_go_up, _UP), f"{name}_nodes")
        most = -(-most // RUN)
        if most <= 1:
            return rounds, nodes


def _ask(runs: DataFrame, suffixes: DataFrame) -> DataFrame:
    return runs.join(suffixes, ["g", "run"])


def manifest(
    docs: DataFrame,
    leaf: Column,
    claimed: Column,
    group: str = "lang",
    key: str = "doc_id",
    proofs: bool = False,
) -> DataFrame:
    """Rows: key, leaf, subroot, root, proof_sha256, folded_root, verified; on demand also proof.

    The tree is built of the leaves. ``claimed`` is the leaf that a holder of the
    row would show (null: the leaf itself); it is folded with the proof of the
    leaf, and verified if that gives the root.
    """
    name = F.col(f"`{group}`").cast("string")
    bare = docs.select(
        # Null first, then by the bytes.
        F.when(name.isNull(), "0").otherwise(F.concat(F.lit("1"), name)).alias("g"),
        F.col(f"`{key}`").cast("bigint").alias("k"),
        F.unhex(leaf).alias("digest"),
        F.unhex(claimed).alias("claimed"),
    )
    shown = F.when(F.col("claimed") != F.col("digest"), F.col("claimed"))
    rows, sizes = numbered(bare.withColumn("claimed", shown), ["k", "digest"], group="g")
    most = sizes.agg(F.max("n")).first()[0] or 0
    rounds, subroots = _climb(rows, most, "leaf")

    groups, of_all = numbered(subroots.select("g", "digest"), ["g"])
    top = groups.select(F.lit("").alias("g"), "place", "digest", "n")
    tops, root_node = _climb(top, of_all.agg(F.max("n")).first()[0] or 0, "top")
    found = root_node.select(F.lower(F.hex("digest"))).first()
    root = found[0] if found else ""

    # From the root down; a run's suffix proves its top.
    spark = docs.sparkSession
    down = spark.createDataFrame([("", 0, "", "")], _DOWN)
    for runs in reversed(tops):
        down = stored(_ask(runs, down).mapInArrow(_go_down, _DOWN), "top_proofs")
    named = groups.select(F.col("g").alias("name"), "place", F.lower(F.hex("digest")).alias("own"))
    down = named.join(down.withColumnRenamed("run", "place"), "place").select(
        F.col("name").alias("g"), F.lit(0).cast("bigint").alias("run"), "suffix", F.col("own").alias("subroot")
    )
    for runs in reversed(rounds[1:]):
        down = stored(_ask(runs, down).mapInArrow(_go_down, _DOWN), "run_proofs")
    return _ask(rounds[0], down).mapInArrow(_leaves(root, key, proofs), _leaf_schema(key, proofs))


def _leaf_schema(key: str, proofs: bool) -> str:
    extra = ", proof string" if proofs else ""
    return (
        f"`{key}` bigint, leaf string, subroot string, root string, proof_sha256 string, "
        f"folded_root string, verified boolean{extra}"
    )


def _leaves(root: str, key: str, proofs: bool):
    text = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    schema = pa.schema(
        [
            (key, pa.int64()),
            *[(c, pa.string()) for c in text],
            ("verified", pa.bool_()),
            *([("proof", pa.string())] if proofs else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            leaves = [x["digest"].hex() for x in row["nodes"]]
            paths = down_sweep(up_sweep(leaves, row["levels"]), row["levels"], row["suffix"])
            out = []
            for node, leaf, path in zip(row["nodes"], leaves, paths, strict=True):
                end = folded(node["claimed"].hex() if node["claimed"] else leaf, path)
                values = [node["k"], leaf, row["subroot"], root, siblings_digest(path), end, end == root]
                out.append([*values, path] if proofs else values)
            columns = zip(zip(*out, strict=True), schema, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in columns], schema=schema)

    return run
