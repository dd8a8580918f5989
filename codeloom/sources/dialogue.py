"""Suggestion candidates from recorded conversations."""

from pyspark.sql import functions as F


def conversation_pairs(conversations):
    """(conv_id, turn, prompt, completion): each user turn with the assistant turn after it.

    An equi-join on (conversation, turn), so a very long conversation is spread by turn.
    """
    asked = conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt")
    )
    given = conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")
    )
    return asked.join(given, ["conv_id", "turn"])
