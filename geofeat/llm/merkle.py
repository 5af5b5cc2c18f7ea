"""Merkle manifest of a dataset: a digest of every row, a tree of digests over each group, one root, and a proof for each row.

H is the lower-case hex SHA-256 of its inputs, concatenated. A leaf is H of a row's fields, each as its UTF-8 byte count, ``:`` and the
value, or ``-`` for null. The leaves of a group stand in the order of a column. While several nodes remain, every ``fanout`` consecutive ones
become their H; the last run may be shorter, even of one. The groups' roots, ordered by group (null first), likewise give the root.

A slot pivot makes each level: conditional aggregates spread the children of a parent into ``fanout`` columns; the columns together hash to
the parent, and all but a child's own are the child's siblings. ``levels`` levels are made per shuffle: nodes are brought together by
blocks of ``fanout ** levels`` places, within which each parent's children already lie in one partition, whatever a group's size. A row's
siblings grow along with its block; the path above a block comes back from the tree over the blocks, by (group, block), one row each.

Defined results. Null fields: ``-``. Null group: a group of its own, first. Null order value: first. Rows that share the order value:
by leaf digest; equal rows are interchangeable and each has its own place. A lone row: its leaf is the root and its path is empty. Empty
table: no rows. Very long texts: hashed whole. Extra columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geofeat.llm.common import materialize, numbered, require, scratch_mark, settled

_WIDTH = 64
_PATH = "array<struct<slot:int,others:string>>"


def digest(*fields: Column) -> Column:
    """H of some values, each with its length before it."""
    shown = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*shown), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""

    def up(node, step):
        cut = step["slot"] * _WIDTH
        return F.sha2(F.concat(step["others"].substr(F.lit(1), cut), node, step["others"].substr(cut + 1, F.length(step["others"]))), 256)

    return F.aggregate(path, leaf, up)


def proof(path: Column) -> Column:
    """All siblings of a path, from the leaf up, as one text."""
    return F.array_join(F.transform(path, lambda s: s["others"]), "")


def _blocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Nodes (grp, n of its group, pos, digest, data) to blocks (grp, n, block, digest, items): items are (data, pos, path within the block)."""
    size = fanout**levels
    item = F.array(F.struct("data", "pos", F.array().cast(_PATH).alias("path")))
    at = nodes.select("grp", "n", F.floor(F.col("pos") / size).alias("block"), F.pmod("pos", F.lit(size)).alias("p"), "digest", item.alias("items")).repartition("grp", "block")
    for t in range(levels):
        slot, alone = F.pmod("p", F.lit(fanout)), F.col("n") <= fanout**t
        own = lambda i, c: F.when(slot == i, F.col(c))  # noqa: B023, E731
        wide = [F.max(own(i, "digest")).alias(f"d{i}") for i in range(fanout)] + [F.first(own(i, "items"), True).alias(f"i{i}") for i in range(fanout)]
        at = at.groupBy("grp", "n", "block", F.floor(F.col("p") / fanout).alias("p")).agg(*wide)
        filled = [F.coalesce(f"d{i}", F.lit("")) for i in range(fanout)]
        grown = []
        for i in range(fanout):
            step = F.array(F.struct(F.lit(i).alias("slot"), F.concat(F.lit(""), *filled[:i], *filled[i + 1 :]).alias("others")))
            path = lambda x: F.when(alone, x["path"]).otherwise(F.concat(x["path"], step))  # noqa: B023, E731
            grown.append(F.transform(f"i{i}", lambda x: F.struct(x["data"].alias("data"), x["pos"].alias("pos"), path(x).alias("path"))))  # noqa: B023
        made = F.when(alone, F.col("d0")).otherwise(F.sha2(F.concat(*filled), 256))
        at = at.select("grp", "n", "block", "p", made.alias("digest"), F.flatten(F.array_compact(F.array(*grown))).alias("items"))
    return at.select("grp", "n", "block", "digest", "items")


def _grown(nodes: DataFrame, fanout: int, levels: int, name: str) -> list[DataFrame]:
    """The tables of blocks from the leaves up, each written; in the last one a group is one block, and its digest the group's root."""
    size, tables = fanout**levels, []
    while True:
        tables.append(materialize(_blocks(nodes, fanout, levels), f"{name}-{len(tables)}"))
        if tables[-1].filter(F.col("n") > size).isEmpty():
            return tables
        nodes = tables[-1].select("grp", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("pos"), "digest", F.lit(None).cast("int").alias("data"))


def _spread(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """(grp, pos, data, path, kept columns of ``above``): paths from the top block of each group down; ``above`` has (grp, path, ..) a group."""
    carried = [c for c in above.columns if c not in ("grp", "path")]
    above, keys = above.withColumnRenamed("path", "more"), ["grp"]
    for blocks in reversed(tables):
        both = blocks.select("grp", "block", "items").join(above, keys).select("grp", "more", *carried, F.inline("items"))
        placed = both.select("grp", "pos", "data", F.concat("path", "more").alias("path"), *carried)
        above, keys = placed.select("grp", F.col("pos").alias("block"), F.col("path").alias("more"), *carried), ["grp", "block"]
    return placed


def manifest(rows: DataFrame, columns: tuple[str, ...], group: str, order: str, altered: dict[str, Column] | None = None, fanout: int = 2, levels: int = 8) -> DataFrame:
    """Per row: the order column, leaf, told, path, subroot, root.

    ``told`` is the leaf of the row with ``altered`` fields, as one who tampers with them would tell it; without ``altered`` it is the leaf.
    """
    if fanout < 2:
        raise ValueError("a parent has two children or more")
    mark, rows = scratch_mark(), require(rows, *dict.fromkeys((*columns, group, order)))
    told = digest(*[(altered or {}).get(c, F.col(c)) for c in columns])
    leaf = digest(*map(F.col, columns))
    # A group's name sorts as the group does, and null before all others.
    name = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("grp")
    leaves = rows.select(name, F.col(order), leaf.alias("digest"), (F.nullif(told, leaf) if altered else F.lit(None).cast("string")).alias("told"))
    nodes = numbered(leaves, ["grp"], [F.col(order).asc_nulls_first(), F.col("digest")], "leaves")
    tables = _grown(nodes.select("grp", "n", "pos", "digest", F.struct(order, "digest", "told").alias("data")), fanout, levels, "blocks")
    # The groups' roots are the leaves of one more tree.
    tops = tables[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    tops = numbered(tops, ["grp"], [F.col("of")], "subroots").select("grp", "n", "pos", "digest", F.struct("of", "digest").alias("data"))
    high = _grown(tops, fanout, levels, "roots")
    roots = high[-1].select("grp", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    above = _spread(high, roots).select(F.col("data.of").alias("grp"), "path", F.col("data.digest").alias("subroot"), "root")
    out = _spread(tables, above).select(F.col(f"data.{order}").alias(order), F.col("data.digest").alias("leaf"), F.coalesce("data.told", "data.digest").alias("told"), "path", "subroot", "root")
    return settled(out, "manifest", mark)


def verified(made: DataFrame) -> DataFrame:
    """The manifest's rows with proof_sha256, folded_root (from ``told`` and the path) and whether that is the root."""
    folded = made.withColumn("folded_root", fold(F.col("told"), F.col("path")))
    return folded.withColumn("proof_sha256", F.sha2(proof(F.col("path")), 256)).withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text in DuckDB SQL: a byte goes in, then eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_prepend(ascii(ch)::HUGEINT, [-1::HUGEINT for _ in range(8)])))"
    shift = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END"
    return f"xor(4294967295::HUGEINT, list_reduce(list_prepend(4294967295::HUGEINT, {steps}), lambda a, x: {shift}))"


def _field_sql(expression: str) -> str:
    return f"coalesce(strlen({expression}) || ':' || {expression}, '-')"


def _leaf_sql(n_chars: str) -> str:
    shown = ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")
    return f"sha256({' || '.join(map(_field_sql, shown))})"


#: The whole of op12 in DuckDB SQL: levels by recursion, siblings by place, the fold by a list.
ORACLE = f"""
WITH RECURSIVE rows_ AS (
    SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("CASE WHEN " + crc32_sql("doc_id::VARCHAR") + " % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS told FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rows_),
tree AS (
    SELECT lang, 0 AS lev, pos, n, leaf AS digest FROM placed
    UNION ALL SELECT lang, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, lev, pos // 2, n),
tops AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
high AS (
    SELECT 0 AS lev, pos, n, subroot AS digest FROM tops
    UNION ALL SELECT lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lev, pos // 2, n),
low_steps AS (
    SELECT p.lang, p.pos, l.lev, CASE WHEN (p.pos >> l.lev) % 2 = 0 THEN '0' ELSE '1' END || coalesce(s.digest, '') AS step
    FROM placed p JOIN (SELECT DISTINCT lang, lev FROM tree WHERE n > 1) l ON p.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lev = l.lev AND s.pos = xor(p.pos >> l.lev, 1)),
high_steps AS (
    SELECT p.lang, l.lev, CASE WHEN (p.pos >> l.lev) % 2 = 0 THEN '0' ELSE '1' END || coalesce(s.digest, '') AS step
    FROM tops p CROSS JOIN (SELECT DISTINCT lev FROM high WHERE n > 1) l LEFT JOIN high s ON s.lev = l.lev AND s.pos = xor(p.pos >> l.lev, 1)),
low_path AS (SELECT lang, pos, list(step ORDER BY lev) AS steps FROM low_steps GROUP BY lang, pos),
high_path AS (SELECT lang, list(step ORDER BY lev) AS steps FROM high_steps GROUP BY lang),
whole AS (
    SELECT p.doc_id, p.leaf, p.told, t.subroot, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
    FROM placed p JOIN tops t ON p.lang IS NOT DISTINCT FROM t.lang
    LEFT JOIN low_path a ON a.lang IS NOT DISTINCT FROM p.lang AND a.pos = p.pos LEFT JOIN high_path b ON b.lang IS NOT DISTINCT FROM p.lang),
folded AS (
    SELECT *, sha256(coalesce(array_to_string(list_transform(steps, lambda x: x[2:]), ''), '')) AS proof_sha256,
        list_reduce(list_prepend(told, steps), lambda a, x: sha256(CASE WHEN x[1] = '0' THEN a || x[2:] ELSE x[2:] || a END)) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded CROSS JOIN (SELECT digest AS root FROM high WHERE n = 1)
"""
