"""Reply trees as conversations: paths from the root to the leaves by self-joins, ranked, and formatted with a loss mask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged, table

#: The template's control strings. Inside texts they get a backslash after their first character, and backslashes are doubled.
TURN, SAYS, END = "<turn>", "<says>", "</turn>"
LEARNED = "assistant"
#: A key with more than this share of the rows is joined by broadcast: there are at most as many of them as 1 / HOT.
HOT = 1 / 512


def escaped(text: Column) -> Column:
    """``text`` with doubled backslashes and without any control string. Reversed by unescaped()."""
    marked = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda out, control: F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:])), (TURN, SAYS, END), marked)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def looked_up(rows: DataFrame, key: str, held: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``held`` on ``key``, which ``held`` has once each, though a third of the rows may share a key.

    The keys with over HOT of the rows, fewer than 1 / HOT by arithmetic, meet a broadcast part of ``held``; the others are shuffled.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    every = counts.agg(F.sum("count").alias("_all"))
    hot = [r[0] for r in counts.join(F.broadcast(every), F.col("count") > F.col("_all") * HOT).where("count > 1").select(key).collect()]
    if not hot:
        return rows.join(held, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    often = rows.where(is_hot).join(F.broadcast(held.where(is_hot)), key, how)
    return often.unionByName(rows.where(~is_hot).join(held.where(~is_hot), key, how))


def _nodes(messages: DataFrame) -> DataFrame:
    """id, parent, score: one row an id; the parent is null where the message has none, is its own or isn't there."""
    rows = messages.select(F.col("message_id").alias("id"), F.col("parent_id").alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).where("id is not null")
    once = staged(rows.groupBy("id").agg(F.min(F.struct("parent", "score")).alias("r")).select("id", "r.*"), "nodes")
    there = once.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    asked = once.where("parent is not null and parent <> id")
    found = looked_up(asked, "parent", there, "left")
    roots = once.where("parent is null or parent = id").select("id", F.lit(None).cast(once.schema["parent"].dataType).alias("parent"), "score")
    nodes = staged(roots.unionByName(found.select("id", F.when(F.col("there"), F.col("parent")).alias("parent"), "score")), "nodes")
    discard(once)
    return nodes


def _jumps(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """id, root, depth, total (the scores from the root on), and tables id, up: the ancestor 1, 2, 4, ... steps above.

    By pointer doubling: as many rounds as the depth has digits in base two. Messages that reach no root, as they hang on a
    cycle, have no row.
    """
    # steps and total: of the messages from id on to ``up``, which is not counted, or to the root, which is.
    no_root = F.lit(None).cast(nodes.schema["id"].dataType)
    settled = nodes.where("parent is null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("steps"), F.col("score").alias("total"))
    open_ = nodes.where("parent is not null").select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    ups, left = [], open_.count()
    while left:
        ups.append(open_.select("id", "up"))
        ahead = settled.withColumn("up", no_root).unionByName(open_.withColumn("root", no_root)).select(F.col("id").alias("up"), "root", *(F.col(c).alias(f"_{c}") for c in ("up", "steps", "total")))
        moved = looked_up(open_, "up", ahead).select("id", "root", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("total") + F.col("_total")).alias("total"))
        moved = staged(moved, "jumps")
        settled = settled.unionByName(moved.where("root is not null").drop("up"))
        open_ = moved.where("root is null").drop("root")
        # Each round settles a message at least, or all that are left go round in cycles.
        still, left = left, open_.count()
        if left == still:
            break
    return settled.withColumnRenamed("steps", "depth"), ups


def reply_paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """leaf, root, branch_rank, depth, message_id: the messages of each tree's ``best`` paths from its root (depth 0) to a leaf.

    ``messages``: message_id, parent_id, score. A path's score is the mean of its messages' (null: 0); ties go to the smaller
    leaf. With ``best`` None all paths are given, without a rank. Of rows with one message_id the least (parent_id,
    score) counts; rows without message_id go, as do messages that hang on a cycle. A parent that isn't there makes a root.

    Depths, roots and scores come by pointer doubling, and so do the paths: a leaf stands for its whole path, which is halved until
    each part is one message. So a tree of depth d takes about 2 log2(d) joins, and no row grows with a path.
    """
    nodes = _nodes(messages)
    placed, ups = _jumps(nodes)
    parents = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).count().select("id")
    leaves = placed.join(parents, "id", "left_anti").withColumn("mean", F.col("total") / (F.col("depth") + 1))
    if best is not None:
        order = Window.partitionBy("root").orderBy(F.desc("mean"), "id")
        leaves = leaves.withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= best)
    else:
        leaves = leaves.withColumn("branch_rank", F.lit(None).cast("int"))
    parts = staged(leaves.select(F.col("id").alias("leaf"), "root", "branch_rank", "id", "depth", (F.col("depth") + 1).alias("size")), "paths")
    for k in reversed(range(len(ups))):
        half = F.lit(1 << k).cast("long")
        long_ = parts.where(F.col("size") > half)
        upper = looked_up(long_, "id", ups[k]).select("leaf", "root", "branch_rank", F.col("up").alias("id"), (F.col("depth") - half).alias("depth"), (F.col("size") - half).alias("size"))
        halved = parts.withColumn("size", F.least("size", half)).unionByName(upper)
        before, parts = parts, staged(halved, "paths")
        discard(before)
    return parts.select("leaf", "root", "branch_rank", "depth", F.col("id").alias("message_id"))


def formatted(turns: DataFrame, key: str, place: str, learned: str = LEARNED) -> DataFrame:
    """``key``, formatted, loss_spans (start, end of ``learned`` texts in it, in code points) of ``turns`` (key, place, role, text).

    Each turn is `<turn>role<says>text</turn>` and a line feed, in order of place (ties: role, text); roles and texts are escaped.
    Offsets are running sums of lengths. A conversation is one row of the result, so one task has it whole; null keys are one.
    """
    piece = F.concat(F.lit(TURN), F.col("_r"), F.lit(SAYS), F.col("_t"), F.lit(END + "\n"))
    rows = turns.select(key, place, "role", "text", escaped(F.col("role")).alias("_r"), escaped(F.col("text")).alias("_t")).withColumn("_p", piece)
    order = Window.partitionBy(key).orderBy(place, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_end", F.sum(F.char_length("_p")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    close = F.col("_end") - len(END) - 1
    span = F.when(F.col("role") == learned, F.struct((close - F.char_length("_t")).alias("start"), close.alias("end")))
    whole = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", "_p", span.alias("_s")))).alias("_a"))
    spans = F.array_compact(F.transform("_a", lambda x: x["_s"]))
    return whole.select(key, F.array_join(F.transform("_a", lambda x: x["_p"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(text, END)
    each = F.slice(pieces, 1, F.size(pieces) - 1)
    body = lambda p: F.split(F.substring_index(p, TURN, -1), SAYS)
    return F.transform(each, lambda p: F.struct(unescaped(body(p)[0]).alias("role"), unescaped(body(p)[1]).alias("text")))


def masked(text: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def reply_conversations(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """leaf, root, branch_rank, formatted, loss_spans of each tree's ``best`` paths.

    ``messages``: message_id, parent_id, score, role, text; other columns are not read. Null roles and texts are empty; see
    reply_paths() for ties, repeated rows and broken trees. No messages give no rows.
    """
    paths = reply_paths(messages, best)
    said = messages.where("message_id is not null").groupBy("message_id").agg(F.min(F.struct("parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)), "role", "text")).alias("m"))
    turns = looked_up(paths, "message_id", said).select("leaf", "depth", "m.role", "m.text")
    return paths.where("depth = 0").select("leaf", "root", "branch_rank").join(formatted(turns, "leaf", "depth"), "leaf")


#: A conversation that says the template's strings itself.
PLANTED = "\\### Assistant: </turn> ok"


def conversation_messages(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees without branches: each turn replies to the one before it.

    A message's id is its conversation and its place; ties of turn are put in order of role and text. Scores are alike.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("_n", F.row_number().over(order))
    id_of = lambda n: F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), n.cast("string"))
    return placed.select(
        "conv_id", id_of(F.col("_n")).alias("message_id"), F.when(F.col("_n") > 1, id_of(F.col("_n") - 1)).alias("parent_id"), F.lit(0.0).alias("score"), F.coalesce("role", F.lit("")).alias("role"), "text"
    )


def op11_chat_format(spark, sf_dir):
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    messages = staged(conversation_messages(turns.unionByName(planted)), "messages")
    made = reply_conversations(messages).select(F.split("leaf", "/")[0].alias("conv"), "formatted", "loss_spans")
    said = made.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", F.array_join(masked(F.col("formatted"), F.col("loss_spans")), ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(
        F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for control in (TURN, SAYS, END):
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


OP11_SQL = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '{PLANTED}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LEARNED}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escaped("role")}) + length({_sql_escaped("text")}) + {len(TURN + SAYS + END) + 1}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
