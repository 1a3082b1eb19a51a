"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees by (tree, msg, parent). Self-joins double the reach of every message's ancestor link until all
reach a root, which also sums scores along each branch; leaves are ranked by the mean score of their path; the same
links, applied in turn, enumerate the messages on the chosen paths, and each path is written as one conversation.

Template: every turn is ``<s>role[INST] text [/INST]</s>``. Inside roles and texts ``~`` becomes ``~t``, ``<`` becomes
``~l`` and ``[`` becomes ``~b``, so no control string can occur there and reading back is exact.

Defined cases: null role or text is empty; a message whose parent is missing starts a tree; messages repeated under
one (tree, msg) count once, the least (parent, role, text) stays; messages without a ``tree`` or ``msg`` are left out,
before anything is their parent or child; equal scores go to the leaf of least ``msg``;
messages on a cycle belong to no path; an empty table gives an empty result; columns beyond the named ones are ignored,
whatever their names. In op9_chat a conversation -7 of the table would be one with the added one. One conversation
is one string, so its turns meet in one task; the paths themselves are found without gathering any tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialise, table

#: Paths of up to 2 ** 30 messages.
DOUBLINGS = 30
CODES = (("~", "~t"), ("<", "~l"), ("[", "~b"))


def escaped(text: Column) -> Column:
    for raw, code in CODES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def union_of(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def reply_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, msg, depth) for the messages on the best ``keep`` root-to-leaf paths of each tree.

    ``messages`` has tree, msg, parent and score.
    """
    messages = messages.filter("tree is not null and msg is not null")
    messages = materialise(messages.select("tree", "msg", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    parents = messages.select("tree", F.col("parent").alias("msg")).distinct()
    leaves = messages.select("tree", "msg").join(parents, ["tree", "msg"], "left_anti")
    known = messages.select("tree", F.col("msg").alias("up"), F.lit(True).alias("_known"))
    reach = messages.withColumn("up", F.col("parent")).join(known, ["tree", "up"], "left")
    written = [messages]
    written.append(reach := materialise(reach.select("tree", "msg", F.when(F.col("_known"), F.col("up")).alias("up"), "score", F.lit(1).cast("long").alias("depth"))))
    opened, finished = [], [reach.filter("up is null")]
    for _ in range(DOUBLINGS):  # only messages that have not reached their root go on
        open_ = reach.filter("up is not null")
        if open_.isEmpty():
            break
        opened.append(open_)
        known = union_of([open_, *finished])
        far = known.select("tree", F.col("msg").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        written.append(reach := materialise(open_.join(far, ["tree", "up"]).select("tree", "msg", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("depth") + F.col("depth2")).alias("depth"))))
        finished.append(reach.filter("up is null"))
    rooted = union_of(finished)
    by_score = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("depth")), "msg")
    best = leaves.join(rooted, ["tree", "msg"]).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= keep)
    path = materialise(best.select("tree", F.col("msg").alias("leaf"), "rank", "msg"))
    for link in opened:  # after the k-th step: all ancestors less than 2 ** k away; a table a step keeps the plan short
        further = path.join(link.select("tree", "msg", "up"), ["tree", "msg"]).select("tree", "leaf", "rank", F.col("up").alias("msg"))
        longer = materialise(path.unionByName(further))
        discard(path)
        path = longer
    out = materialise(path.join(rooted.select("tree", "msg", "depth"), ["tree", "msg"]))
    discard(path, *written)
    return out


def format_trees(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, loss) of each chosen path.

    ``messages`` has tree, msg, parent, role, text and score; ``loss`` lists the (start, length) of each assistant
    text in ``formatted``, in code points.
    """
    messages = messages.filter("tree is not null and msg is not null")
    whole = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    messages = materialise(messages.groupBy("tree", "msg").agg(F.min(whole).alias("m")).select("tree", "msg", "m.*"))
    turns = reply_paths(messages, keep).join(messages.select("tree", "msg", "role", "text"), ["tree", "msg"])
    head, body, tail = F.concat(F.lit("<s>"), escaped(F.col("role")), F.lit("[INST] ")), escaped(F.col("text")), F.lit(" [/INST]</s>")
    turns = turns.select("tree", "leaf", "rank", "depth", "role", head.alias("head"), body.alias("body"), F.concat(head, body, tail).alias("turn"))
    earlier = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(earlier), F.lit(0)) + F.length("head")
    turns = turns.select("tree", "leaf", "rank", F.struct("depth", "turn", (F.col("role") == "assistant").alias("counts"), start.cast("int").alias("start"), F.length("body").alias("length")).alias("t"))
    paths = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list("t")).alias("t"))
    loss = F.transform(F.filter("t", lambda t: t["counts"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return paths.select("tree", "leaf", "rank", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    shape = r"(?s)^<s>(.*?)\[INST\] (.*) \[/INST\]$"
    part = lambda t, k: unescaped(F.regexp_extract(t, shape, k))
    return F.transform(F.filter(F.split(formatted, "</s>", -1), lambda t: t != ""), lambda t: F.struct(part(t, 1).alias("role"), part(t, 2).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """Conversations, rows in order of turn (then role and text), as trees of one branch."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "role", "text"))
    rows = rows.withColumn("tree", tree).withColumn("msg", place)
    return rows.select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


CONTROL = "</s>[INST] ok [/INST]"


def op9_chat(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    formatted = format_trees(conversation_trees(conversations.unionByName(probe)))
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("loss"))
    return formatted.select(
        F.when(F.col("tree") != "none", F.col("tree")).cast("long").alias("conv_id"),
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(x: str) -> str:
    for raw, code in CODES:
        x = f"replace({x}, '{raw}', '{code}')"
    return x


OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<s>' || {_sql_escaped("role")} || '[INST] ' || {_sql_escaped("text")} || ' [/INST]</s>'))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
