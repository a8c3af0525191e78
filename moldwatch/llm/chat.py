"""Operator 9: chat formatting from reply trees.

Messages name their parent.  Root-to-leaf paths are enumerated by iterated
self-joins: joining the parent table with itself gives the table of ancestors two,
four, eight ... steps up, each with the summed scores of the messages passed.  Going
through these tables from the longest step to the shortest carries every leaf to its
root with the sum and length of its path, one row a leaf.  The branches of a tree are
ranked by the mean score of their messages, ties by leaf id, and only chosen leaves go
through the tables again to collect each of their ancestors exactly once.  That is three
times log2(depth) joins on (tree, message), so neither a deep thread nor a tree with a
third of all messages makes a long loop or a hot key, and branches that are not chosen
are never written out.  Each chosen path becomes one conversation.

Template: every turn is ``<|im_start|>role\\ntext<|im_end|>\\n`` (the role
URL-encoded).  Control strings inside texts are broken by a backslash after their first
character, backslashes are doubled; ``unescape`` reverses both.  The loss mask is a list
of spans (characters and UTF-8 bytes) of the assistant texts.

Defined results: null texts and roles are empty; a message whose parent is not in its tree
is a root; of messages with the same tree and id the smallest (parent, role, text,
score) stands; null ids count as an id of their own; a null tree is a tree; messages on or
below a cycle have no root and give no path; an empty table gives no rows.
Extra columns are ignored.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moldwatch.llm.store import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"([<\[])(\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _tag(c: Column) -> Column:
    """A non-null string key: null and the empty string differ."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of ancestors and the leaves.  Table k: (tree, id, anc, passed), ``anc`` 2^k steps above
    ``id``, ``passed`` the summed scores from ``id`` to below ``anc``.  Leaves: (tree, leaf, score), the mean
    over the messages of the path.  ``nodes``: distinct non-null string keys (tree, id), parent and score."""
    parents = nodes.select("tree", F.col("parent").alias("id")).distinct()
    up = written(nodes.join(nodes.select("tree", F.col("id").alias("parent")), ["tree", "parent"], "left_semi")
                 .select("tree", "id", F.col("parent").alias("anc"), F.col("score").alias("passed")), "steps")
    most = math.ceil(math.log2(nodes.count() + 1)) + 1
    steps = []
    while len(steps) <= most and not up.isEmpty():
        steps.append(up)
        far = up.select("tree", F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("passed").alias("more"))
        up = written(up.join(far, ["tree", "anc"]).select(
            "tree", "id", F.col("next").alias("anc"), (F.col("passed") + F.col("more")).alias("passed")), "steps")
    leaves = nodes.join(parents, ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "id")
    if len(steps) > most:  # more steps than messages: on or below a cycle
        leaves = leaves.join(steps.pop(), ["tree", "id"], "left_anti")
    leaves = leaves.select("*", F.lit(0.0).alias("total"), F.lit(1).cast("bigint").alias("n"))
    for k in reversed(range(len(steps))):
        on = F.col("anc").isNotNull()
        leaves = leaves.join(steps[k], ["tree", "id"], "left").select(
            "tree", "leaf", F.coalesce("anc", "id").alias("id"),
            (F.col("total") + F.coalesce("passed", F.lit(0.0))).alias("total"),
            (F.col("n") + F.when(on, F.lit(1 << k)).otherwise(0)).alias("n"))
        leaves = written(leaves, "leaves")
    leaves = leaves.join(nodes.select("tree", "id", F.col("score").alias("top")), ["tree", "id"])
    return steps, leaves.select("tree", "leaf", ((F.col("total") + F.col("top")) / F.col("n")).alias("score"))


def leaf_paths(leaves: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, id, up): every message of the path of each of ``leaves``, ``up`` steps above its leaf."""
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("bigint").alias("up"))
    for k in reversed(range(len(steps))):
        above = paths.join(steps[k], ["tree", "id"]).select(
            "tree", "leaf", F.col("anc").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        paths = written(paths.unionByName(above), "paths")
    return paths


def format_conversations(messages: DataFrame, *, tree_col: str = "conv_id", id_col: str = "id", parent_col: str = "parent",
                         role_col: str = "role", text_col: str = "text", score_col: str = "score",
                         top: int | None = 1) -> DataFrame:
    """One row per chosen path: ``tree_col``, leaf, rank, score, n_turns, formatted and spans
    (start, chars, byte_start, bytes) of the loss mask.  ``top``: paths per tree, None for all."""
    m = messages.select(
        F.col(tree_col).alias("tree_value"), _tag(F.col(tree_col)).alias("tree"), _tag(F.col(id_col)).alias("id"),
        F.when(F.col(parent_col).isNotNull(), _tag(F.col(parent_col))).alias("parent"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)).alias("score"))
    m = m.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score", "tree_value")).alias("m")).select(
        "tree", "id", "m.*")
    m = written(m, "messages")
    steps, ranked = climb(m.select("tree", "id", "parent", "score"))
    if top == 1:
        ranked = ranked.groupBy("tree").agg(F.min(F.struct((-F.col("score")).alias("low"), "leaf")).alias("b")).select(
            "tree", F.col("b.leaf").alias("leaf"), (-F.col("b.low")).alias("path_score"), F.lit(1).alias("rank"))
    else:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
        ranked = ranked.select("tree", "leaf", F.col("score").alias("path_score"), rank.alias("rank"))
        ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    ranked = written(ranked, "chosen")
    paths = leaf_paths(ranked, steps)
    turns = (paths.join(ranked, ["tree", "leaf"]).join(m.drop("parent", "score"), ["tree", "id"])
             .select("tree", "tree_value", "leaf", "rank", "path_score", "up", "role",
                     F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body")))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)

    def offset(length):
        whole = length(F.col("head")) + length(F.col("body")) + len(CLOSE)
        return (F.coalesce(F.sum(whole).over(before), F.lit(0)) + length(F.col("head"))).cast("bigint")

    turns = turns.select("*", F.struct(
        offset(F.char_length).alias("start"), F.char_length("body").cast("bigint").alias("chars"),
        offset(F.octet_length).alias("byte_start"), F.octet_length("body").cast("bigint").alias("bytes")).alias("span"))
    paths = turns.groupBy("tree", "leaf").agg(
        F.first("tree_value").alias(tree_col), F.first("rank").alias("rank"), F.first("path_score").alias("score"),
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "head", "body", "span"))).alias("turns"))
    return paths.select(
        tree_col, "leaf", "rank", "score", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["span"]).alias("spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1)))
    return F.transform(pieces, lambda p: F.struct(
        F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    data = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(data, s["byte_start"].cast("int") + 1, s["bytes"].cast("int")).cast("string"))), "")


def conversation_messages(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                          text_col: str = "text") -> DataFrame:
    """Rows by turn as reply trees: each row replies to the one before.  Null turns come
    first; repeated rows follow each other."""
    order = Window.partitionBy(conv_col).orderBy(turn_col, role_col, text_col)
    m = rows.select(conv_col, role_col, text_col, F.row_number().over(order).alias("id"))
    return m.select("*", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"))


def op9_chat(spark, sf_dir):
    """Contract query: all ``conversations`` and conversation -1, read back from the formatted text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)],
                                                  "conv_id bigint, turn bigint, role string, text string"))
    c = format_conversations(conversation_messages(rows))
    c = c.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                 masked_text(F.col("formatted"), F.col("spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                    F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("bigint").alias("formatted_chars"))


OP9_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length('<|im_start|>') + length(role) + 1 + length(regexp_replace(replace(text, '\', '\\'),
    '([<\[])(\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1x\2', 'g')) + length('<|im_end|>') + 1 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
