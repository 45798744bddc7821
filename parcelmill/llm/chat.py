"""Chat logs that hold every stage of a growing conversation, reduced to the complete ones.

A logger that writes the whole conversation after each turn leaves snapshots:
conversations that are a prefix of longer ones. Each turn is hashed once; the
rolling hash of a prefix is the hash of the turn hashes before it. A
conversation whose own hash occurs among the proper prefixes of any other is a
snapshot and goes (an anti-join); equal conversations are kept once. The rest is
rendered for training.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmill.llm.common import field

#: How a turn is rendered; {role} and {text} are replaced.
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"


def maximal_conversations(
    turns: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: str = TEMPLATE,
) -> DataFrame:
    """One row per kept conversation: conv_id, n_turns, n_copies, prefix_hash, rendered.

    ``n_copies`` counts the conversations with exactly these turns; the smallest
    id stands for them (a missing id only if there is no other).

    Turns are ordered by number (missing first), then role and the hash of role and
    text, so repeated turn numbers have a fixed order. Rows without a conversation id form one
    conversation. A missing role is rendered as ``unknown`` and a missing text as
    empty, and they compare as such. Extra columns are not read. An empty table
    gives no rows.
    """
    rows = turns.select(
        field(conversation).alias("conv"),
        field(turn).alias("nth"),
        F.coalesce(field(role), F.lit("unknown")).alias("said_by"),
        F.coalesce(field(text), F.lit("")).alias("said"),
    )
    # The length of the role keeps (ab, c) apart from (a, bc).
    hashed = rows.withColumn(
        "hash", F.sha2(F.concat_ws("|", F.length("said_by").cast("string"), "said_by", "said").cast("binary"), 256)
    )
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
    prefixes = (
        hashed.groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "said_by", "hash"))).alias("turns"))
        .select(
            "conv",
            F.size("turns").alias("n_turns"),
            F.aggregate(
                "turns",
                F.array().cast("array<string>"),
                lambda done, one: F.array_append(done, F.sha2(F.concat(last(done), one["hash"]).cast("binary"), 256)),
            ).alias("prefix_hashes"),
        )
    )
    whole = (
        prefixes.select("conv", "n_turns", F.element_at("prefix_hashes", -1).alias("prefix_hash"))
        .groupBy("prefix_hash")
        .agg(F.min("conv").alias("conv"), F.min("n_turns").alias("n_turns"), F.count(F.lit(1)).alias("n_copies"))
    )
    proper = prefixes.where("n_turns > 1").select(
        F.explode(F.slice("prefix_hashes", 1, F.col("n_turns") - 1)).alias("prefix_hash")
    ).distinct()
    kept = whole.join(proper, "prefix_hash", "left_anti")
    before, between = template.split("{role}", 1)
    between, after = between.split("{text}", 1)
    rendered = hashed.join(kept.withColumnRenamed("conv", "kept_conv"), F.col("conv").eqNullSafe(F.col("kept_conv"))).groupBy(
        "conv", "n_turns", "n_copies", "prefix_hash"
    ).agg(
        F.array_sort(F.collect_list(F.struct("nth", "said_by", "hash", "said"))).alias("turns")
    )
    line = lambda one: F.concat(F.lit(before), one["said_by"], F.lit(between), one["said"], F.lit(after))
    return rendered.select(
        F.col("conv").alias(conversation), "n_turns", "n_copies", "prefix_hash",
        F.array_join(F.transform("turns", line), "").alias("rendered"),
    )
