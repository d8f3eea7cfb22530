"""Reply trees to formatted conversations, in DataFrame operations only.

Messages are nodes ``(tree, id, parent, role, text, score)``.  Self-joins
double the ancestor that each node points to, so a tree of depth d takes
log2(d) rounds; a second run over the same jump tables lists the nodes of each
root-to-leaf path.  Paths are ranked by the sum of their scores and each chosen
path becomes one conversation.

The template writes ``### role: text</turn>\\n`` per turn.  Inside roles and
texts a backslash becomes ``\\b``, ``#`` becomes ``\\h``, ``<`` becomes ``\\l``
and, in roles, ``:`` becomes ``\\c``; so no control string can occur in a text
and ``unescape`` gives back the original.

Defined results: null roles and texts are empty; a null score is 0; a parent
that the tree doesn't hold makes its child a root; nodes that hang on a cycle
have no root and are left out; of repeated ids in a tree the least (role, text)
counts; nodes without tree or id are left out; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.common import Workspace, table

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: In this order when escaping, in the opposite order when reading back.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    for char, code in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for char, code in reversed(ESCAPES if role else ESCAPES[:3]):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def reply_paths(nodes: DataFrame, ws: Workspace) -> DataFrame:
    """``(tree, leaf, id, dist)``: each node of each root-to-leaf path, ``dist`` steps above the leaf.

    Every table that is joined has been written, so a hot parent is a skewed
    join between two scans, which adaptive execution splits.
    """
    known = nodes.select("tree", F.col("id").alias("parent"))
    linked = nodes.where("parent is not null").join(known, ["tree", "parent"], "left_semi").select("tree", "id", "parent")
    # Each table holds only the nodes that still have an ancestor so far up; those on a cycle always have.
    jumps, most = [ws.save(linked.select("tree", "id", F.col("parent").alias("up")), "jump0")], 1
    total = jumps[0].count()
    while most <= total and not jumps[-1].isEmpty():
        a = jumps[-1].select("tree", F.col("id").alias("up"), F.col("up").alias("next"))
        jump = jumps[-1].join(a, ["tree", "up"]).select("tree", "id", F.col("next").alias("up"))
        jumps.append(ws.save(jump, f"jump{len(jumps)}"))
        most *= 2

    parents = jumps[0].select("tree", F.col("up").alias("id")).distinct()
    rooted = nodes.select("tree", "id").join(jumps[-1].select("tree", "id"), ["tree", "id"], "left_anti")
    leaves = rooted.join(parents, ["tree", "id"], "left_anti")
    paths = ws.save(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("dist")), "paths")
    for k, jump in enumerate(jumps[:-1]):
        up = paths.join(jump, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), F.col("dist") + (1 << k))
        paths = ws.save(paths.unionByName(up.toDF("tree", "leaf", "id", "dist")), f"paths{k}")
    return paths


def format_trees(messages: DataFrame, ws: Workspace, *, best: int | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen path: ``tree, leaf, branch_rank, path_score, formatted, loss_spans``.

    ``loss_spans`` are (start, length) in code points from 1; they hold the
    escaped texts of the ``loss_roles`` and nothing else.  ``best`` keeps the
    paths of highest score in each tree (a top-k report); None keeps all.
    """
    nodes = messages.where("tree is not null and id is not null").select("tree", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = ws.save(nodes.groupBy("tree", "id").agg(F.min(F.struct("role", "text", "score", "parent")).alias("m")).select("tree", "id", "m.*"), "nodes")
    paths = reply_paths(nodes, ws)

    piece = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(COLON), escape(F.col("text")), F.lit(CLOSE))
    parts = paths.join(nodes, ["tree", "id"]).withColumn("piece", piece).withColumn("chars", F.char_length("piece"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("dist"))
    end = F.sum("chars").over(before) - len(CLOSE)
    size = F.char_length(escape(F.col("text")))
    span = F.when(F.col("role").isin(*loss_roles), F.struct((F.col("end") - F.col("size") + 1).cast("int").alias("start"), F.col("size").cast("int").alias("length")))
    parts = parts.withColumn("end", end).withColumn("size", size).withColumn("span", span)
    one = F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "piece", "span")))
    chats = parts.groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"), one.alias("parts"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))
    chats = chats.withColumn("branch_rank", rank)
    if best is not None:
        chats = chats.where(F.col("branch_rank") <= best)
    return chats.select(
        "tree",
        "leaf",
        "branch_rank",
        "path_score",
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted conversation."""
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")
    head = lambda x: F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), COLON, 1)
    body = lambda x: F.substr(x, F.lit(len(OPEN) + 1 + len(COLON)) + F.char_length(head(x)))
    return F.transform(turns, lambda x: F.struct(unescape(head(x), True).alias("role"), unescape(body(x)).alias("text")))


def from_turns(conversations: DataFrame) -> DataFrame:
    """A linear conversation as a tree: each turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null").withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = format_trees(from_turns(turns), Workspace(spark, "chat"))
    said = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"], s["length"]))), "")
    chats = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("said", said).withColumn("loss", loss)
    return chats.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_CHARS = "(length({0}) + length(regexp_replace({0}, '[^\\\\#<]', '', 'g')))"
_ROLE = "(length({0}) + length(regexp_replace({0}, '[^\\\\#<:]', '', 'g')))"

ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), c AS (
  SELECT conv_id, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum({len(OPEN) + len(COLON) + len(CLOSE)} + {_ROLE.format('role')} + {_CHARS.format('text')}) AS chars
  FROM t GROUP BY conv_id
)
SELECT conv_id, n::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM c
"""
