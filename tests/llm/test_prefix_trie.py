"""The conversation prefix trie against a plain one, its SQL, and tree contraction on odd trees."""

import collections
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import prefix_trie, queries
from marlstone.llm.common import join_hot

DATA = "/root/testdata/sf0.001"


def plain(convs):
    members, kids = collections.defaultdict(list), collections.Counter()
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids.update(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    told = lambda n, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n)).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], told(n, m)) for n, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    want = duck.execute(f"select {', '.join(COLUMNS)} from ({queries.ORACLES['op11_prefix_trie']})").fetchall()
    assert rows_of(queries.op11_prefix_trie(spark, DATA)) == sorted(want)


def test_nulls_ties_repeats_and_a_hot_first_turn(spark):
    rng = random.Random(4)
    rows, convs = [], collections.defaultdict(list)
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            role, text = ("user", "hello é") if t == 0 and c % 3 else (rng.choice(["user", None, ""]), rng.choice(["a", "b", None, "🙂" * 300]))
            rows.append((c, None if t == 0 and c % 2 else t, role, text, "extra", 1))
            convs[c].append((role or "", text or ""))
    rows += [(70, 5, "a", "second", "x", 1), (70, 5, "a", "second", "x", 1), (70, None, "a", "first", "x", 1), (None, 1, "a", "no id", "x", 1), (-3, 1, "user", "hello é", "x", 1)]
    convs[70], convs[-3] = [("a", "first"), ("a", "second"), ("a", "second")], [("user", "hello é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, depth long")
    trie = prefix_trie.conversation_trie(df)
    assert rows_of(trie) == plain(convs)
    told = {(r.conv_id, r.depth): (r.role, r.text) for r in prefix_trie.node_texts(trie, df).collect()}
    assert len(told) == len(plain(convs)) - 1 and all(convs[c][d - 1] == x for (c, d), x in told.items())
    assert rows_of(prefix_trie.conversation_trie(df.limit(0))) == []


def test_turnless_conversations(spark):
    rows = [(1, 0, None, 0), (2, 0, None, 0), (3, 0, None, 0), (3, 1, b"x", 4)]
    turns = spark.createDataFrame(rows, "conv_id long, pos long, digest binary, bytes long")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert rows_of(prefix_trie.trie_of(turns)) == [(1, 0, None, 3, 1, 1, 0, sha(b"1,2")), (3, 1, 1, 1, 0, 1, 0, sha(b"3"))]


def test_long_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit(b"b")).otherwise(F.lit(b"a")).alias("node"), (F.col("id") - 700).alias("conv_id"))
    got = {bytes(r.node): r.sha256 for r in prefix_trie.id_lists_sha256(df).collect()}
    for name, ids in ((b"a", [k - 700 for k in range(3000) if k % 10]), (b"b", range(-700, 2300, 10))):
        assert got[name] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "random", "forest"])
def test_contraction_on_odd_trees(spark, shape):
    rng, n = random.Random(7), 45
    parent = {"chain": lambda k: k - 1, "star": lambda k: 0, "comb": lambda k: max(0, k - 2 + k % 2), "random": lambda k: rng.randrange(k), "forest": lambda k: None if k % 30 == 0 else k - 1 - k % 3 if k % 3 < k % 30 else k - 1}[shape]
    tree = [(k, None if k == 0 else parent(k), rng.randint(-5, 9) if k % 11 else None) for k in range(n)]
    want = {k: v or 0 for k, _, v in tree}
    for k, p, _ in reversed(tree):
        if p is not None:
            want[p] += want[k]
    df = spark.createDataFrame(tree, "node long, parent long, v long")
    assert {r.node: r.v for r in prefix_trie.subtree_totals(df, ["v"]).collect()} == want
    assert prefix_trie.subtree_totals(df.limit(0), ["v"]).count() == 0


def test_join_with_hot_keys(spark):
    many = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("rows"))
    got = join_hot(many, one, "k", "rows", 4000, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(one, "k").collect())) and got.count() == 4000
