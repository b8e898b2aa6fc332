"""Multi-party perspective rotation of dialogues.

For every participant of a dialogue the whole dialogue is rendered once with
that speaker as the assistant and all others as named users. The mask holds the
character spans of the assistant's answers, the only ones to be learned.

A rendered dialogue is cut into parts of about ``part_chars`` characters at
turn borders, so that no task ever holds an endless dialogue; one that is
shorter is a single part. Turn offsets are running sums inside ranges of the
(dialogue, turn) order plus the sums of the ranges before, so a dialogue that
holds a third of all turns spreads over many tasks.

Edge cases: turns without a dialogue id are left out; a null text is empty; a
null speaker is the participant ``unknown``; ``system`` turns are context and no
participant, and a dialogue with nothing else gives no rows; turns with the same
number are ordered by speaker and a hash of the text; repeated turns are rendered each time.

Marks inside texts and names are escaped, so that none can forge a turn: ``<|``
gets a backslash in between, ``<\\|`` a second one and so on, in names ``|>`` too.
Taking one backslash away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import stored

PART_CHARS = 1_000_000


def escaped(text: Column) -> Column:
    """The text without marks that open a head."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(name: Column) -> Column:
    """The name without marks that open or close a head."""
    return F.regexp_replace(escaped(name), r"\|(\\*)>", r"|\\$1>")


def rotate_perspectives(
    turns: DataFrame,
    dialogue: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    part_chars: int = PART_CHARS,
) -> DataFrame:
    """Rows: dialogue, speaker (the assistant), part, part_start, n_turns, rendered, mask.

    The mask lists ``start:end`` of the assistant's answers, relative to the
    part and with the end mark, comma-joined.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(dialogue).alias("d"),
        F.col(turn).alias("n"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("s"),
        body.alias("t"),
        F.sha2(body, 256).alias("h"),
    ).filter(F.col("d").isNotNull())
    order = ["n", "s", "h"]
    dealt = stored(
        rows.repartitionByRange("d", *order).withColumn("r", F.spark_partition_id()), "turns"
    )
    people = dealt.filter(F.col("s") != "system").select("d", F.col("s").alias("p")).distinct()
    own = F.col("s") == F.col("p")
    head = (
        F.when(F.col("s") == "system", F.lit("<|system|>\n"))
        .when(own, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), escaped_name(F.col("s")), F.lit("|>\n")))
    )
    lines = dealt.join(people, "d").withColumns(
        {"head": F.length(head), "line": F.concat(head, escaped(F.col("t")), F.lit("<|end|>\n")), "own": own}
    )
    lines = lines.withColumn("size", F.length("line").cast("bigint"))
    inside = (
        Window.partitionBy("d", "p", "r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranges = lines.groupBy("d", "p", "r").agg(F.sum("size").alias("all"))
    across = Window.partitionBy("d", "p").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("d", "p", "r", F.coalesce(F.sum("all").over(across), F.lit(0)).alias("base"))
    placed = (
        lines.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(bases, ["d", "p", "r"])
        .withColumn("at", F.col("base") + F.col("before"))
        .withColumn("part", F.floor(F.col("at") / F.lit(part_chars)))
    )
    pieces = placed.groupBy("d", "p", "part").agg(
        F.sort_array(F.collect_list(F.struct("at", "line", "own", "head", "size"))).alias("x")
    )
    start = F.col("x")[0]["at"]
    answers = F.transform(
        F.filter("x", lambda e: e["own"]),
        # The newline behind the end mark is not learned.
        lambda e: F.concat_ws(
            ":", e["at"] - start + e["head"], e["at"] - start + e["size"] - F.lit(1)
        ),
    )
    return pieces.select(
        F.col("d").alias(dialogue),
        F.col("p").alias("speaker"),
        F.col("part").cast("bigint").alias("part"),
        start.alias("part_start"),
        F.size("x").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("x", lambda e: e["line"]), "").alias("rendered"),
        F.array_join(answers, ",").alias("mask"),
    )
