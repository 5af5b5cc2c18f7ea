"""Merkle manifest and conversation trie against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geofeat.llm import conversation_trie, merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, items string, path string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, fanout):
    """(root, path of each): a path is (slot, siblings) a level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // fanout * fanout : p // fanout * fanout + fanout]
            paths[k].append((p % fanout, run[: p % fanout] + run[p % fanout + 1 :]))
        level = [sha("".join(level[a : a + fanout])) for a in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], paths


def plain_manifest(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, high = tree([made[g][0] for g in names], fanout)
    out = []
    for g, above in zip(names, high):
        for (_, _, own, row), path in zip(sorted(groups[g]), made[g][1]):
            whole = path + above
            tampered = zlib.crc32(str(row[0]).encode()) % 7 == 0 if row[0] is not None else False
            node = leaf((*row[:3], row[3] + 1, row[4])) if tampered and row[3] is not None else own
            for slot, others in whole:
                node = sha("".join([*others[:slot], node, *others[slot:]]))
            out.append((row[0], own, made[g][0], root, sha("".join("".join(o) for _, o in whole)), node, node == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(k, rng.choice(["a", None, ""]), rng.choices(["en", "de", None, "é", ""], [60, 9, 6, 1, 3])[0], rng.choice([None, k]), rng.choice(["", None, "x:1", "t" * 2000, "ü"])) for k in range(160)]
    return out + [out[3], out[3], (None, "s", "en", 1, "a"), (None, "s", "en", 1, "b"), (7, "other", "en", 2, "tie"), (1, None, "solo", None, None)]


@pytest.mark.parametrize("fanout,levels", [(2, 3), (3, 2)])
def test_manifest(spark, rows, fanout, levels):
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    altered = {"n_chars": F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    made = merkle.verified(merkle.manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), "lang", "doc_id", altered, fanout, levels))
    got = made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest(rows, fanout)


def test_manifest_of_little(spark):
    columns = ("doc_id", "lang")
    one = spark.createDataFrame([(5, None)], "doc_id long, lang string")
    row = merkle.verified(merkle.manifest(one, columns, "lang", "doc_id")).head()
    assert row["leaf"] == row["root"] == row["subroot"] == leaf((5, None)) and row["path"] == [] and row["verified"] and row["proof_sha256"] == sha("")
    assert merkle.manifest(one.limit(0), columns, "lang", "doc_id").count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(one, columns, "lang", "doc_id", fanout=1)


def plain_trie(turns, rebuild=True):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}
    nodes, whole = defaultdict(list), defaultdict(list)
    for c, seq in own.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
        whole[tuple(seq)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in nodes:
        children[node[:-1]] += bool(node)
    for node, who in nodes.items():
        gain = (len(who) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += gain
    out = [(min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(",".join(map(str, sorted(whole[n]))))) for n, m in nodes.items()]
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(9)
    said = [("user", "hi"), ("user", "hi"), ("bot", "yes, é漢"), (None, None), ("", ""), ("bot", "no"), ("user", "x" * 500)]
    turns = []
    for c in [*range(0, 40), 100, 101, 105, 199, 250, 251, 300, 1234]:
        for t in range(rng.randint(1, 9)):
            turns.append((c, rng.choice([t, t, t, None]), *rng.choice(said)))
    turns += [(77, t, "user", f"deep {t}") for t in range(90)]  # one long chain, and a copy that leaves it late
    turns += [(78, t, "user", f"deep {min(t, 80)}") for t in range(90)]
    turns += [(100 * k, 0, "user", "same") for k in range(20, 60)]  # many copies
    return turns + [turns[0], turns[0], (None, 1, "user", "lost")]


SCHEMA_C = "conv_id long, turn long, role string, text string, a string, depth string"


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie(spark, rebuild):
    turns = conversations()
    table = spark.createDataFrame([(*t, "clash", "clash") for t in turns], SCHEMA_C).repartition(3)
    rule = {"base": lambda c: c - c % 100, "keep": lambda c: F.crc32(c.cast("string").cast("binary")) % 6} if rebuild else {}
    assert sorted(map(tuple, conversation_trie.trie(table, **rule).collect()), key=repr) == plain_trie(turns, rebuild)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], SCHEMA_C)
    assert conversation_trie.trie(table).count() == 0


def test_contraction_rounds_follow_the_logarithm(spark, monkeypatch):
    """A chain of 150 nodes: far fewer rounds than nodes, totals exact."""
    names = []
    plain = conversation_trie.materialize
    monkeypatch.setattr(conversation_trie, "materialize", lambda df, name: names.append(name) or plain(df, name))
    chain = [(k, k, k - 1 if k else None, k - 1 if k else None, int(k < 149), 1) for k in range(150)]
    nodes = spark.createDataFrame(chain, "a long, b long, pa long, pb long, n long, v long")
    assert {(r["a"], r["v"]) for r in conversation_trie.contract(nodes, ["v"]).collect()} == {(k, 150 - k) for k in range(150)}
    assert len([n for n in names if n.startswith("round")]) <= 30


def test_ids_stream_into_one_digest(spark):
    ends = spark.range(3000).selectExpr("id % 2 as a", "-1L as b", "id * 7 as conv_id").unionByName(spark.sql("select 9L a, 9L b, -5L conv_id"))
    got = {(r["a"], r["ends_sha256"]) for r in conversation_trie.end_digests(ends).collect()}
    assert got == {(p, sha(",".join(str(k * 7) for k in range(p, 3000, 2)))) for p in (0, 1)} | {(9, sha("-5"))}


def test_queries_are_registered():
    assert {"op11_sentencepiece", "op12_merkle_manifest", "op13_conversation_trie"} <= set(queries.queries())
