"""Prefix trie of conversations; subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns, named by a chained digest. Totals of subtrees come from rounds of joins on
unique keys. Each round rakes all leaves (their totals go to their parents) and compresses chains: a node with one child
whose random priority is above its parent's and its child's leaves the tree, and its own value moves to the edge of that
child. The nodes that left are put back in reverse order of the rounds, each by one join with its child's total. A tree of
n nodes needs O(log n) rounds, whatever its depth.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import join_hot, release, staged

#: Bytes of a node's name: the start of a chained SHA-256.
NAME = 16
ROOT = bytes(NAME)
#: Characters of ids that one row of a list of ids holds.
CHUNK = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def ordered_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest and bytes (UTF-8 length of the text) of each turn, without the texts.

    Turns ascend, null first; equal turns are ordered by role and then by the digest of role and text, and all kept.
    Null role or text is empty. Rows without conv_id belong to no conversation and are left out, as are other columns.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)), 1, NAME)
    rows = df.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), digest.alias("digest"), F.octet_length(text_).cast("long").alias("bytes"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "digest", "bytes")

    def number(batches):
        last, pos = None, 0
        for batch in batches:
            places = []
            for c in batch.column(0).to_pylist():
                pos = pos + 1 if c == last else 1
                last = c
                places.append(pos)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), batch.column(1), batch.column(2)], names=["conv_id", "pos", "digest", "bytes"])

    return rows.mapInArrow(number, "conv_id long, pos long, digest binary, bytes long")


def prefixes(turns: DataFrame) -> DataFrame:
    """Each conversation's nodes from the root down: conv_id, depth, node, parent, bytes (of its last text), ends.

    ``turns``: conv_id, pos, digest, bytes; a conversation without turns has one row whose digest is null. Long
    conversations pass through as a stream.
    """
    rows = turns.select("conv_id", "pos", "digest", "bytes").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    names = ["conv_id", "depth", "node", "parent", "bytes", "ends"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]

    def run(batches):
        held: list | None = None  # the last row, whose end is not known yet
        for batch in batches:
            out: list[list] = []
            for c, digest, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held is None or held[0] != c:
                    if held is not None:
                        out.append([*held, True])
                    held = [c, 0, ROOT, None, 0]
                if digest is not None:
                    out.append([*held, False])
                    held = [c, held[1] + 1, hashlib.sha256(held[2] + digest).digest()[:NAME], held[2], size]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([*held, True], kinds, strict=True)], names=names)
        release()

    return rows.mapInArrow(run, "conv_id long, depth long, node binary, parent binary, bytes long, ends boolean")


def id_lists_sha256(rows: DataFrame, key: str = "node", value: str = "conv_id") -> DataFrame:
    """(key, SHA-256 hex of the key's ids in ascending order, comma-joined). A digest is a sequence by nature: ids are
    dealt by ranges of (key, id) and joined to pieces first, so that the last step of a key with very many ids only hashes
    pieces as they come, in constant memory."""
    dealt = rows.select(key, value).repartitionByRange(key, value).sortWithinPartitions(key, value)

    def pieces(batches):
        held, first, ids, size = None, None, [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=[key, "first", "ids"])

        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != held or size > CHUNK:
                    if ids:
                        yield row()
                    held, first, ids, size = k, v, [], 0
                ids.append(str(v))
                size += len(ids[-1]) + 1
        if ids:
            yield row()

    def digests(batches):
        held, state = None, None
        for batch in batches:
            keys, made = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != held:
                    if state is not None:
                        keys.append(held)
                        made.append(state.hexdigest())
                    held, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(made)], names=[key, "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()])], names=[key, "sha256"])

    packed = dealt.mapInArrow(pieces, f"{key} binary, first long, ids string")
    return packed.repartition(key).sortWithinPartitions(key, "first").mapInArrow(digests, f"{key} binary, sha256 string")


def _priority(node: Column, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn))


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """node and the sum of each value column over the node's subtree, the node itself included.

    ``tree``: node, parent (null for a root) and the values (long); nodes are unique, each parent is a node, null values
    count as 0. A forest is as good as a tree; no rows give no rows.
    """
    own, up = [f"own_{v}" for v in values], [f"up_{v}" for v in values]
    kids = tree.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids")).withColumnRenamed("parent", "node")
    state = tree.join(kids, "node", "left").select("node", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *(F.coalesce(F.col(v), F.lit(0)).cast("long").alias(o) for v, o in zip(values, own, strict=True)), *(F.lit(0).cast("long").alias(u) for u in up))
    state = staged(state, "tree")
    rounds, leaf = [], F.col("kids") == 0
    while True:
        # what each parent gets from its raked leaves, how many other children it has, and the one of them if it is alone
        gains = state.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            F.count(F.when(~leaf, 1)).alias("left"),
            F.max(F.when(~leaf, F.struct("node", *up))).alias("only"),
            *(F.coalesce(F.sum(F.when(leaf, F.col(o) + F.col(u))), F.lit(0)).alias(f"gain_{o}") for o, u in zip(own, up, strict=True)),
        )
        grown = state.where(~leaf).drop("kids").join(gains, "node").select("node", "parent", F.col("left").alias("kids"), *((F.col(o) + F.col(f"gain_{o}")).alias(o) for o in own), *up, "only")
        pri = _priority(F.col("node"), len(rounds))
        goes = (F.col("kids") == 1) & F.col("parent").isNotNull() & (pri > _priority(F.col("parent"), len(rounds))) & (pri > _priority(F.col("only.node"), len(rounds)))
        kept = grown.select("*", F.when(F.coalesce(goes, F.lit(False)), "compressed").otherwise("kept").alias("how"))
        raked = state.where(leaf).select("node", "parent", "kids", *own, *up, F.lit(None).cast(grown.schema["only"].dataType).alias("only"), F.lit("raked").alias("how"))
        table = staged(kept.unionByName(raked), f"round-{len(rounds)}")
        rounds.append(table)
        left = {r["how"]: r["count"] for r in table.groupBy("how").count().collect()}
        if not left.get("kept"):
            break
        state = table.where("how = 'kept'").select("node", "parent", "kids", *own, *up)
        if left.get("compressed"):
            spliced = table.where("how = 'compressed'").select(F.col("only.node").alias("node"), F.col("parent").alias("above"), F.lit(True).alias("spliced"), *((F.col(o) + F.col(u)).alias(f"more_{u}") for o, u in zip(own, up, strict=True)))
            state = state.join(spliced, "node", "left").select("node", F.when(F.col("spliced"), F.col("above")).otherwise(F.col("parent")).alias("parent"), "kids", *own, *((F.col(u) + F.coalesce(F.col(f"more_{u}"), F.lit(0))).alias(u) for u in up))
    known: DataFrame | None = None
    for k, table in reversed(list(enumerate(rounds))):
        made = table.where("how = 'raked'").select("node", *(F.col(o).alias(v) for o, v in zip(own, values, strict=True)))
        if known is not None:
            gone = table.where("how = 'compressed'").select("node", F.col("only.node").alias("child"), *((F.col(o) + F.col(f"only.{u}")).alias(o) for o, u in zip(own, up, strict=True)))
            below = known.withColumnRenamed("node", "child")
            made = made.unionByName(gone.join(below, "child").select("node", *((F.col(v) + F.col(o)).alias(v) for o, v in zip(own, values, strict=True))))
            made = staged(made, f"expanded-{k}")
        known = made if known is None else known.unionByName(made)
    return known


def trie_of(turns: DataFrame) -> DataFrame:
    """The trie of conversations given as ``prefixes`` takes them; one row for each node.

    node and parent (names; the root's parent is null), conv_id (the smallest member), depth, parent_conv_id, n_convs
    (members: conversations that begin with the node's turns, repeated or not), n_children, n_leaves, saved_tokens (bytes of
    the last text times members but one, summed over the subtree) and ends_sha256 (of the ids of the members that end here,
    ascending). Every conversation is a member of the root; without conversations there are no nodes.
    """
    paths = staged(prefixes(turns), "prefixes")
    found = paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"))
    nodes = staged(found, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = staged(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")
    own = nodes.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    ids = join_hot(nodes.where("parent is not null").select("node", "parent"), parents, "parent", "n_children", nodes.count()).select("node", "parent_conv_id")
    ends = id_lists_sha256(paths.where("ends"))
    out = nodes.join(totals, "node").join(ids, "node", "left").join(ends, "node", "left")
    return out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``trie_of`` the conversations of a table with one row for each turn (``ordered_turns`` says how they are read)."""
    return trie_of(ordered_turns(df, conv_id, turn, role, text))


def node_texts(trie: DataFrame, df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie's nodes but for the root, each with role and text of its last turn, read from its smallest member.

    ``df`` is the table that the trie was made from; both sides of the join have unique keys.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")).cast("long")
    rows = df.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"), digest.alias("digest")).withColumn("depth", at)
    return trie.join(rows.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"])
