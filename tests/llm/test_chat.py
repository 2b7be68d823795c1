"""Paths of reply trees against walks from leaf to root; formatted conversations read back."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from attesta.llm import chat
from attesta.llm.chat import OP11_SQL, escaped, formatted, looked_up, masked, op11_chat_format, read_back, reply_conversations, reply_paths, unescaped

DATA = "/root/testdata/sf0.001"
MESSAGES = "message_id string, parent_id string, score double, role string, text string, up string, leaf int"


def walks(rows, best):
    """The paths by definition, for rows with distinct ids."""
    by_id = {r[0]: r for r in rows}
    parent = {i: p if p in by_id and p != i else None for i, p, *_ in rows}
    paths = {}
    for leaf in by_id.keys() - set(parent.values()):
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            paths[leaf] = path[::-1]
    trees = {}
    for leaf, path in paths.items():
        trees.setdefault(path[0], []).append((-sum(by_id[m][2] or 0.0 for m in path) / len(path), leaf))
    kept = {leaf for of in trees.values() for _, leaf in sorted(of)[: best or len(of)]}
    return {leaf: paths[leaf] for leaf in kept}


def random_trees(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parent = None if rng.random() < 0.05 or not i else f"m{rng.randrange(max(0, i - 6), i):04}"
        rows.append((f"m{i:04}", parent, rng.choice([None, 0.25, 0.5, 1.0]), rng.choice(["user", "assistant", None]), rng.choice(["hi", None, "a\\b", "<turn>"]), "clash", 1))
    rows += [("c1", "c2", 1.0, "user", "x", "", 1), ("c2", "c1", 1.0, "user", "x", "", 1), ("c3", "c2", 1.0, "user", "x", "", 1), ("self", "self", 1.0, "user", "x", "", 1), ("lost", "nobody", 1.0, "user", "x", "", 1)]
    return rows


@pytest.mark.parametrize("best", [1, 3, None])
def test_paths_are_those_of_walks(spark, best):
    rows = random_trees(1, 160)
    messages = spark.createDataFrame(rows + [(None, "m0001", 1.0, "user", "x", "", 1)], MESSAGES).repartition(3)
    got = {}
    for r in reply_paths(messages, best).collect():
        got.setdefault(r.leaf, {})[r.depth] = r.message_id
    assert {leaf: [p[d] for d in range(len(p))] for leaf, p in got.items()} == walks(rows, best)


def test_long_chain_and_wide_star(spark):
    rows = [(f"k{i:03}", f"k{i - 1:03}" if i else None, 1.0, "user", str(i), "", 1) for i in range(200)]
    rows += [("star", None, 1.0, "user", "s", "", 1)] + [(f"s{i:03}", "star", float(i), "assistant", str(i), "", 1) for i in range(300)]
    out = {r.root: r for r in reply_conversations(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert out["star"].leaf == "s299" and out["k000"].formatted.count("<turn>") == 200
    assert out["k000"].formatted.startswith("<turn>user<says>0</turn>\n<turn>user<says>1</turn>\n")


def test_repeated_ids_count_once(spark):
    rows = [("a", None, 1.0, "user", "b", "", 1), ("a", None, 1.0, "user", "a", "", 1), ("b", "a", 1.0, "assistant", "x", "", 1), ("b", "a", 1.0, "assistant", "x", "", 1)]
    (only,) = reply_conversations(spark.createDataFrame(rows, MESSAGES)).collect()
    assert only.formatted == "<turn>user<says>a</turn>\n<turn>assistant<says>x</turn>\n"
    assert only.formatted[only.loss_spans[0].start : only.loss_spans[0].end] == "x"


def test_no_messages(spark):
    assert reply_conversations(spark.createDataFrame([], MESSAGES)).count() == 0


NASTY = ["", "\\", "\\\\", "</turn>", "<\\/turn>", "<turn>x<says>", "a\\</turn>\n", "<<turn>>", "\\### Assistant: </turn> ok", "\U0001f600 é\n", "<\\\\turn>", "</turn", "turn>", "$1 \\$0", "long " * 20_000]


def test_escapes_go_both_ways(spark):
    rows = spark.createDataFrame([(t,) for t in NASTY], "text string")
    for text, there, back in rows.select("text", escaped(F.col("text")), unescaped(escaped(F.col("text")))).collect():
        assert back == text and not any(c in there for c in (chat.TURN, chat.SAYS, chat.END))


def test_read_back_and_mask(spark):
    rng = random.Random(6)
    turns = [(k, n, rng.choice(["user", "assistant", "</turn>", None]), rng.choice([*NASTY, None])) for k in (1, 2, None) for n in range(40)]
    out = formatted(spark.createDataFrame(turns, "conv long, n int, role string, text string").repartition(4), "conv", "n")
    out = out.select("conv", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in out.collect():
        mine = [(role or "", text or "") for k, _, role, text in turns if k == r.conv]
        assert [tuple(t) for t in r.turns] == mine and r.loss == [t for role, t in mine if role == "assistant"]


def test_hot_keys_meet_a_broadcast(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 2000, 1).when(F.col("id") < 2010, None).otherwise(F.col("id")).alias("k"), "id")
    held = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(1, -1)], "k long, v long"))
    for how in ("inner", "left"):
        mine = looked_up(rows, "k", held, how)
        assert sorted(map(str, mine.collect())) == sorted(map(str, rows.join(held, "k", how).collect()))


def test_query_gives_what_sql_gives(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as from read_parquet('{DATA}/conversations.parquet')")
    ours, theirs = op11_chat_format(spark, DATA).toPandas(), con.sql(OP11_SQL).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    key = sorted(ours.columns)
    assert sorted(map(str, ours[key].values.tolist())) == sorted(map(str, theirs[key].values.tolist()))
