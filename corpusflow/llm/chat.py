"""Chat formatting by prefix-target expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"


def prefix_targets(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """(conv_id, turn, n_context, text, train_start, train_end): an example for each turn of the target role.

    text has all turns up to and with the reply, each as <|im_start|>role, newline, text, <|im_end|>, newline. The
    characters train_start to train_end, from 0 and without the end, are the reply with its end mark: the only
    trainable ones. n_context is the number of turns before it.

    Turns are ordered by (turn, role, text) with null turns last; equal rows follow one another, each a turn. A null
    role is rendered as unknown and is never a target; a null text is rendered as empty. Replies that are null or
    empty are context for later ones but no examples. Rows with a null conv_id belong to no conversation and are left
    out. Other columns are not read.

    One shuffle on conv_id. A conversation is one array, exploded by index: the contexts are sliced from it row by
    row and never held together. The output is quadratic in a conversation's turns by definition.
    """
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")))
    whole = conversations.where("conv_id is not null").groupBy("conv_id").agg(turns.alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(START), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END)))
    places = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (F.get("turns", i)["role"] == target) & (F.length(F.get("turns", i)["text"]) > 0))
    rows = whole.select("conv_id", "turns", shown.alias("shown")).select("conv_id", "turns", "shown", F.explode(places).alias("n_context"))
    reply = F.get("turns", F.col("n_context"))
    head = f"{START}{target}\n"
    return (
        rows.select("conv_id", reply["turn"].alias("turn"), "n_context", F.array_join(F.slice("shown", F.lit(1), F.col("n_context")), "").alias("context"), reply["text"].alias("reply"))
        .select("conv_id", "turn", "n_context", F.concat("context", F.lit(head), "reply", F.lit(END)).alias("text"), (F.length("context") + len(head)).alias("train_start"), F.length("reply").alias("n"))
        .select("conv_id", "turn", "n_context", "text", "train_start", (F.col("train_start") + F.col("n") + len(END)).alias("train_end"))
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_targets(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_chat_formatting": op1_chat_formatting}
SQL = {
    "op1_chat_formatting": """
        WITH t AS (
            SELECT conv_id, turn, role, text,
                   CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) - 1 AS INTEGER) AS n_context,
                   '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS shown
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT *, coalesce(string_agg(shown, '') OVER (PARTITION BY conv_id ORDER BY n_context ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
            FROM t
        )
        SELECT conv_id, turn, n_context, context || shown AS text,
               CAST(length(context) + length('<|im_start|>assistant' || chr(10)) AS INTEGER) AS train_start,
               CAST(length(context) + length(shown) AS INTEGER) AS train_end
        FROM c WHERE role = 'assistant' AND length(text) > 0
    """
}
