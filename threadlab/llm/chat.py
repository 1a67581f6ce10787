"""Chat formatting: cumulative snapshots of a conversation collapse into the longest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlab.session import materialise

DEFAULT_ROLE = "user"


def snapshots(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> one row per conversation: ``turns`` in order, ``n_turns``.

    A conversation is one rendered row in the end, so its turns are brought together here.
    Repeated rows count once; rows that only share the turn number are ordered by role, then text;
    null turns come first. Null ids make up a conversation of their own. Null role: ``user``; null
    text: empty.
    """
    clean = turns.select(
        "conv_id",
        F.struct(
            "turn", F.coalesce("role", F.lit(DEFAULT_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    ).distinct()
    return clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).withColumn(
        "n_turns", F.size("turns").cast("long")
    )


def prefix_hashes(convs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, k, a, b): a rolling 128-bit hash of the first ``k`` turns, for every k."""
    turns = convs.select(
        "conv_id",
        "n_turns",
        F.posexplode(
            F.transform(
                "turns",
                lambda t, i: F.struct(
                    F.xxhash64(i, t["role"], t["text"]).alias("a"),
                    F.xxhash64(t["text"], i, t["role"], F.lit("b")).alias("b"),
                ),
            )
        ).alias("i", "h"),
    )
    upto = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select(
        "conv_id",
        "n_turns",
        (F.col("i") + 1).cast("long").alias("k"),
        F.expr("bit_xor(h.a)").over(upto).alias("a"),
        F.expr("bit_xor(h.b)").over(upto).alias("b"),
    )


def maximal(convs: DataFrame) -> DataFrame:
    """Ids (conv_id, n_snapshots) of conversations that are no proper prefix of another one.

    Of equal conversations the smallest id stays (null last); ``n_snapshots`` counts them.
    Both sides of the anti-join hold one row per hash, so a popular opening is not a hot key.
    """
    hashes = materialise(prefix_hashes(convs), "prefix-hashes")
    whole = (
        hashes.where("k = n_turns")
        .groupBy("k", "a", "b")
        .agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id")).alias("first"), F.count("*").alias("n_snapshots"))
    )
    opening = hashes.where("k < n_turns").select("k", "a", "b").distinct()
    return whole.join(opening, ["k", "a", "b"], "left_anti").select("first.conv_id", "n_snapshots")


def render(turns: DataFrame) -> DataFrame:
    """Maximal conversations as chat text: (conv_id, n_turns, n_snapshots, text)."""
    convs = snapshots(turns)
    kept = maximal(convs)
    lines = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n")))
    return (
        convs.join(kept.withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id")))
        .select("conv_id", "n_turns", "n_snapshots", F.array_join(lines, "").alias("text"))
    )
