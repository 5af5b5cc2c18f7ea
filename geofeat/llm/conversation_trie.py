"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

Conversations (a table of conv_id, turn, role, text) are put in order and, on request, rebuilt on the first turns of another one. Each
distinct sequence of first turns is a node, named by the 128-bit exclusive or of its turns' hashes, each mixed with its place; the root is the empty
sequence. Turns are numbered, and prefixes named, by ranges of (conversation, turn) with sums carried from range to range, so that a
conversation of any length is many tasks.

Totals over subtrees come by contraction in rounds of joins, each of which rakes and compresses. Rake: every leaf adds its sums to its
parent and goes. Compress: a node with one child goes if a coin falls for it and not for its parent; the child is hung on the grandparent,
and what went is kept as an addend on the new edge. Of a chain a fixed share goes in each round, so rounds grow with the logarithm of the
nodes, however deep the trie is. Then the rounds are undone from the last one: a compressed node's total is its own sums, the addend that its
child's edge had, and the child's total, which is known by then; a raked leaf's total was its own.

Defined results. Null conv_id: takes no part. Null turn: first. Null role or text: empty. Turns that share a number: by role, then text;
repeated rows are turns of their own. Very long texts: hashed whole; only hashes and lengths go on. A conversation without turns:
a member of the root alone. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from geofeat.llm.common import materialize, numbered, require, scratch_mark, settled
from geofeat.llm.merkle import crc32_sql

_NOTHING = hashlib.sha256(b"").hexdigest()


def _mixed(place: Column) -> tuple[Column, Column]:
    """A turn's two hashes (columns k1, k2) at a place."""
    return F.xxhash64(place.cast("long"), "k1"), F.xxhash64("k2", place.cast("long"))


def _running(by: list[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def members(conversations: DataFrame, base: Column, keep: Column) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, size, last): one row a conversation and prefix, the empty one included.

    A conversation is the first ``keep`` turns of conversation ``base`` (both columns over conv_id), then its own turns after its first
    ``keep``. a, b name the prefix, pa, pb the one before it; size is the length of its last text, last whether the whole conversation is meant.
    """
    rows = require(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    k1, k2 = F.xxhash64(F.lit(11), "role", "text"), F.xxhash64(F.lit(29), "text", "role")
    hashed = rows.select("conv_id", "turn", "role", "text", k1.alias("k1"), k2.alias("k2"), F.char_length("text").cast("long").alias("size"))
    turns = numbered(hashed, ["conv_id"], order, "turns").select("conv_id", "part", "k1", "k2", "size", (F.col("pos") + 1).alias("i"), "n")
    turns = materialize(turns, "numbered")
    runs = turns.groupBy("conv_id", "part").agg(F.max("n").alias("n"))
    convs = runs.groupBy("conv_id").agg(F.max("n").alias("n")).select("conv_id", "n", base.cast("long").alias("base"), keep.cast("long").alias("h"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("m"))
    convs = convs.join(lengths, "base", "left").withColumn("head", F.least("h", F.coalesce("m", F.lit(0)))).withColumn("whole", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", "head", "whole"), "conversations")

    # Heads: the few first turns of a base, at the places that they keep.
    most = convs.agg(F.coalesce(F.max("head"), F.lit(0))).head()[0]
    m1, m2 = _mixed(F.col("i"))
    heads = turns.filter(F.col("i") <= most).select(F.col("conv_id").alias("base"), "i", m1.alias("m1"), m2.alias("m2"), "size")
    w = _running(["base"], "i")
    heads = heads.select("base", "i", "size", F.bit_xor("m1").over(w).alias("a"), F.bit_xor("m2").over(w).alias("b"))
    before = F.lag("a", 1, 0).over(Window.partitionBy("base").orderBy("i")), F.lag("b", 1, 0).over(Window.partitionBy("base").orderBy("i"))
    heads = materialize(heads.select("*", before[0].alias("pa"), before[1].alias("pb")), "heads")
    first = convs.join(heads, "base").filter(F.col("i") <= F.col("head")).select("conv_id", F.col("i").alias("depth"), "a", "b", "pa", "pb", "size", (F.col("i") == F.col("whole")).alias("last"))

    # Tails: own turns after the head; what the head and earlier ranges hold comes before what a range holds so far.
    of = heads.select("base", F.col("i").alias("head"), F.col("a").alias("a0"), F.col("b").alias("b0"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    begun = convs.join(of, ["base", "head"], "left").select("conv_id", "h", "head", "whole", zero("a0").alias("a0"), zero("b0").alias("b0"))
    begun = runs.select("conv_id", "part").join(begun, "conv_id")
    own = turns.select("conv_id", "part", "k1", "k2", "size", "i").join(begun, ["conv_id", "part"]).filter(F.col("i") > F.col("h"))
    own = own.withColumn("depth", F.col("i") - F.col("h") + F.col("head"))
    m1, m2 = _mixed(F.col("depth"))
    own = own.withColumns({"m1": m1, "m2": m2})
    sums = own.groupBy("conv_id", "part").agg(F.bit_xor("m1").alias("s1"), F.bit_xor("m2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(s).over(earlier), F.lit(0).cast("long")).alias(s) for s in ("s1", "s2")])
    w = _running(["conv_id", "part"], "i")
    own = own.join(sums, ["conv_id", "part"])
    own = own.withColumns({"a": F.bit_xor("m1").over(w).bitwiseXOR(F.col("s1")).bitwiseXOR(F.col("a0")), "b": F.bit_xor("m2").over(w).bitwiseXOR(F.col("s2")).bitwiseXOR(F.col("b0"))})
    tail = own.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("m1")).alias("pa"), F.col("b").bitwiseXOR(F.col("m2")).alias("pb"), "size", (F.col("depth") == F.col("whole")).alias("last"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("size"), (F.col("whole") == 0).alias("last"))
    return root.unionByName(first).unionByName(tail)


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): SHA-256 of a node's conversation ids, ascending, joined by commas. Ids stream through in order; none are gathered."""

    def run(batches):
        node, state = None, None
        for batch in batches:
            a, b, ids = (batch.column(k).to_numpy() for k in range(3))
            if not len(a):
                continue
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            out = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)]):
                now, text = (int(a[lo]), int(b[lo])), ",".join(map(str, ids[lo:hi].tolist())).encode()
                if now == node:
                    state.update(b"," + text)
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = now, hashlib.sha256(text)
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], ["a", "b", "ends_sha256"])
        if node is not None:
            yield pa.record_batch([pa.array([x]) for x in (*node, state.hexdigest())], ["a", "b", "ends_sha256"])

    dealt = ends.select("a", "b", "conv_id").repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
    return dealt.mapInArrow(run, "a long, b long, ends_sha256 string")


def _coin(k: int, a: str, b: str) -> Column:
    """Whether the coin of a node falls for it in a round; never for the root."""
    return (F.xxhash64(F.lit(k), a, b).bitwiseAND(F.lit(1)) == 1) & ~((F.col(a) == 0) & (F.col(b) == 0))


def contract(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(a, b, values): the sum of each value over the subtree of each node.

    ``nodes``: (a, b, pa, pb, n, values); n is the number of children, the root's parent is null and its name (0, 0).
    """
    extra = [f"edge_{v}" for v in values]
    plus = lambda x, y, names: [(F.col(f"{x}{v}") + F.col(f"{y}{v}")).alias(names.format(v)) for v in values]
    live = materialize(nodes.select("a", "b", "pa", "pb", "n", *values, *[F.lit(0).cast("long").alias(e) for e in extra]), "live")
    rounds, left, k = [], live.count(), 0
    while left > 1:
        raked = live.filter("n = 0 and pa is not null").select(F.col("pa").alias("a"), F.col("pb").alias("b"), *plus("", "edge_", "in_{}"))
        sums = raked.groupBy("a", "b").agg(F.count("*").alias("gone"), *[F.sum(f"in_{v}").alias(f"in_{v}") for v in values])
        rest = live.filter("n > 0 or pa is null").join(sums, ["a", "b"], "left").fillna(0, ["gone", *[f"in_{v}" for v in values]])
        rest = rest.select("a", "b", "pa", "pb", (F.col("n") - F.col("gone")).alias("n"), *plus("", "in_", "{}"), *extra)
        # A node with one child goes where the coin falls for it and not for its parent: never two in a row.
        rest = rest.withColumn("goes", F.coalesce((F.col("n") == 1) & _coin(k, "a", "b") & ~_coin(k, "pa", "pb"), F.lit(False)))
        going = rest.filter("goes").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("pa").alias("up_a"), F.col("pb").alias("up_b"), *[F.col(v).alias(f"up_{v}") for v in values], *[F.col(e).alias(f"up_{e}") for e in extra])
        both = rest.join(going, ["pa", "pb"], "left").withColumn("moved", F.col("up_a").isNotNull())
        hung = lambda old, new: F.when(F.col("moved"), F.col(new)).otherwise(F.col(old)).alias(old)
        onto = [F.when(F.col("moved"), F.col(e) + F.col(f"up_{v}") + F.col(f"up_{e}")).otherwise(F.col(e)).alias(e) for v, e in zip(values, extra)]
        none = F.lit(None).cast("long")
        stays = F.struct(F.lit("live").alias("kind"), "a", "b", hung("pa", "up_a"), hung("pb", "up_b"), "n", *values, *onto)
        # A record: node (a, b) went, (pa, pb) here names its child, and values are what is to be added to the child's total.
        record = F.struct(F.lit("gone").alias("kind"), F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("a").alias("pa"), F.col("b").alias("pb"), none.alias("n"), *[(F.col(f"up_{v}") + F.col(e)).alias(v) for v, e in zip(values, extra)], *[none.alias(e) for e in extra])
        rows = F.array_compact(F.array(F.when(~F.col("goes"), stays), F.when(F.col("moved"), record)))
        seen = Observation()
        made = both.select(F.inline(rows)).observe(seen, F.count_if(F.col("kind") == "live").alias("live"), F.count_if(F.col("kind") == "gone").alias("gone"))
        made = materialize(made, f"round-{k}")
        rounds.append((live, made.filter("kind = 'gone'") if seen.get["gone"] else None))
        live, left, k = made.filter("kind = 'live'").drop("kind"), seen.get["live"], k + 1
    known = live.select("a", "b", *values)
    for before, gone in reversed(rounds):
        raked = before.filter("n = 0 and pa is not null").select("a", "b", *values)
        if gone is not None:
            total = known.select(F.col("a").alias("pa"), F.col("b").alias("pb"), *[F.col(v).alias(f"in_{v}") for v in values])
            known = known.unionByName(materialize(gone.join(total, ["pa", "pb"]).select("a", "b", *plus("", "in_", "{}")), "expanded"))
        known = known.unionByName(raked)
    return known


def trie(conversations: DataFrame, base: Callable[[Column], Column] | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``base`` and ``keep``, functions of conv_id, say on whose first turns, and how many of them, a conversation is rebuilt; without them it stays.
    """
    mark, c = scratch_mark(), F.col("conv_id")
    rows = materialize(members(conversations, base(c) if base else c, keep(c) if keep else F.lit(0)), "members")
    nodes = rows.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(x).alias(x) for x in ("depth", "pa", "pb", "size")])
    nodes = materialize(nodes, "nodes")
    children = nodes.filter("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "counted")
    sums = contract(
        nodes.select("a", "b", "pa", "pb", F.col("n_children").alias("n"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")),
        ["n_leaves", "saved_tokens"],
    )
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(sums, ["a", "b"]).join(end_digests(rows.filter("last")), ["a", "b"], "left").join(parents, ["pa", "pb"], "left")
    out = whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
    return settled(out, "trie", mark)


#: The whole of op13 in DuckDB SQL: a node is the list of its turns, and each node adds to the nodes on its smallest member's way.
ORACLE = f"""
WITH t AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
conv AS (SELECT conv_id AS c, count(*) AS n, {crc32_sql("conv_id::VARCHAR")}::BIGINT % 6 AS h, conv_id - conv_id % 100 AS b FROM t GROUP BY conv_id),
headed AS (SELECT x.c, x.h, x.b, least(x.h, coalesce(y.n, 0)) AS head, least(x.h, coalesce(y.n, 0)) + greatest(x.n - x.h, 0) AS whole FROM conv x LEFT JOIN conv y ON y.c = x.b),
rebuilt AS (
    SELECT c, i AS p, role, text FROM headed JOIN t ON t.conv_id = b AND i <= head
    UNION ALL SELECT c, i - h + head, role, text FROM headed JOIN t ON t.conv_id = c AND i > h),
member AS (
    SELECT c, p, list({{'r': role, 't': text}}) OVER (PARTITION BY c ORDER BY p) AS node, length(text) AS size FROM rebuilt
    UNION ALL SELECT c, 0, [], 0 FROM headed),
nodes AS (SELECT node, min(c) AS conv_id, max(p) AS depth, count(*) AS n_convs, max(size) AS size FROM member GROUP BY node),
parents AS (SELECT n.node, n.conv_id, m.node AS parent FROM nodes n JOIN member m ON m.c = n.conv_id AND m.p = n.depth - 1),
children AS (SELECT parent AS node, count(*) AS n_children FROM parents GROUP BY parent),
sums AS (
    SELECT m.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size)::BIGINT AS saved_tokens
    FROM nodes n JOIN member m ON m.c = n.conv_id AND m.p <= n.depth LEFT JOIN children k ON k.node = n.node GROUP BY m.node),
ends AS (SELECT m.node, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS ends FROM member m JOIN headed h ON h.c = m.c AND h.whole = m.p GROUP BY m.node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN children k ON k.node = n.node LEFT JOIN ends e ON e.node = n.node
LEFT JOIN parents p ON p.node = n.node LEFT JOIN nodes u ON u.node = p.parent
"""
