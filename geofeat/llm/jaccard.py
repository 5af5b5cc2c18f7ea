"""N-gram Jaccard join with several global token orders.

Every linked pair shares a token within the prefixes of both sets under *each* global order, so candidates are those pairs
that do so under all of three orders, and only they are verified:

* A: rarest first, ties by hash;  * B: rarest first, ties by descending hash;  * C: by hash alone.

Rarity must be known only for tokens that can stand in a prefix. The orders put tokens whose hash lies in the lowest ``window`` of
the hash range before all others, so a set emits just its lowest max(prefix length, tokens in the window) hashes; the document
frequencies of these are counted exactly over all sets. Tokens found in one set only fill prefixes without making candidates.
Small sets would have too few tokens in the window to leave the frequent ones out, so the join is made twice: once among sets of at
most ``small`` tokens, with a window over the whole range, and once among those that can link to a larger one.

Sets equal in (size, 128-bit signature) are one class and need no pairs. Within a class's posting list pairs are not all made: each
set first meets one leader of each of its lists (two rounds), components are joined, and only pairs whose components still differ
are then made, once for lists of the same sets, and where the places of the token leave room for the overlap (a linked pair passes
this at the first token that it shares). That loses no link: two sets of one component need none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofeat.llm.common import FOLD_SPACE, freed, materialize, mix64, release, require, scratch_mark, settled, signed, slices, utf8, word_hashes, words

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


#: A set's parity bitmap: bit k tells whether it has an odd number of the tokens that hash to k (256 bits). Two sets differ in at
#: least as many tokens as their bitmaps in bits, which bounds their overlap from above.
BITS = ("b0", "b1", "b2", "b3")


def shingle_sets(batch: pa.RecordBatch, n: int):
    """For each text its sorted distinct n-word shingle hashes; a text of fewer words has its whole sequence as one, none has none."""
    off, data = utf8(batch.column("text"))
    folded = FOLD_SPACE[data]
    starts, lengths, first = words(off, folded)
    h = word_hashes(folded, starts, lengths)
    s = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        s += h[k : len(h) - n + 1 + k] * (_ODD[k % len(_ODD)] + np.uint64(2 * (k // len(_ODD)) << 32))
    s = mix64(s)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(s[a : b - n + 1])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix64(x * _ODD[0] + h[k : k + 1])
            yield x
        else:
            yield s[:0]


def _class(s: np.ndarray) -> int:
    """One 64-bit name of a whole set, from its size and two 64-bit folds of its tokens."""
    folds = [mix64(s + _ODD[1]).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s + _ODD[2]), initial=np.uint64(0)), np.uint64(len(s))]
    name = mix64(np.array(folds, np.uint64) * _ODD[3] + np.arange(3, dtype=np.uint64))
    return int(mix64(name.cumsum()).sum(dtype=np.uint64).view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """Two sets with 100*inter >= percent*union share at least ceil(percent*n/100) tokens of the one with n, so one of these many."""
    return n - -(-n * percent // 100) + 1


def sketch(docs: DataFrame, n: int, percent: int, window: float, small: int) -> DataFrame:
    """Per document: set size, class, tokens in the window, emitted tokens (null where the task has met the class before).

    The lowest bit of an emitted token tells the join: 1 among the small sets (all tokens), 0 among the others (the lowest hashes).
    """
    limit = np.uint64(int(window * 2**64))

    def run(batches):
        met = set()
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                size, cls, inside, emit = [], [], [], []
                for s in shingle_sets(piece, n):
                    key = _class(s)
                    size.append(len(s))
                    cls.append(key if len(s) else None)
                    w = int(np.searchsorted(s, limit))
                    inside.append(w)
                    if key in met or not len(s):
                        emit.append(None)
                    else:
                        met.add(key)
                        own = signed(s)
                        low = own[: max(w, prefix_length(len(s), percent))] & ~1 if len(s) * 100 > small * percent else own[:0]
                        emit.append(np.concatenate([low, own | 1]) if len(s) <= small else low)
                yield pa.record_batch(
                    [piece.column("doc_id"), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(inside, pa.int64()), pa.array(emit, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "cls", "inside", "emit"],
                )

    return docs.mapInArrow(freed(run), "doc_id long, n_shingles long, cls long, inside long, emit array<long>")


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable. Each round takes the neighbours' least label, then follows that label."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both, "edges")
    now = materialize(nodes.select("node", F.col("node").alias("comp")), "labels")
    while True:
        near = both.join(now, both.b == now.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = now.join(near, now.node == near.a, "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        step = materialize(step, "labels")
        up = step.select(F.col("node").alias("at"), F.col("comp").alias("up"))
        step = step.join(up, step.comp == up.at, "left").select("node", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
        step = materialize(step, "labels")
        if step.filter("was <> comp").isEmpty():
            return step.select("node", "comp")
        now = step.select("node", "comp")


def jaccard_join(docs: DataFrame, n: int = 4, percent: int = 85, window: float | None = None, small: int = 100) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links, its own included), links (of its class).

    ``links`` counts the verified links of the document's class to other classes; pairs within a component may stay unverified.
    Null or blank text: size 0, linked with nothing, its own component. Repeated rows: one class. A repeated doc_id: each row counts.
    A null doc_id takes part; its component id is the least non-null id of its component, or null. Empty table: no rows.
    """
    window, mark = window or (100 - percent) / 70, scratch_mark()
    docs = require(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = materialize(sketch(docs, n, percent, window, small), "sketch")
    classes = base.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("inside").alias("inside"))
    limit = int(window * 2**64) - 2**63
    flat = base.filter("emit is not null").select("cls", F.explode("emit").alias("token"))
    # A class that several tasks have met counts once a task, alike for all sets; the distinct leaves one row of it.
    seen = flat.groupBy("token").agg(F.count("*").alias("rows")).filter("rows > 1")
    shared = flat.join(seen.hint("shuffle_hash"), "token").distinct()
    # Per class and join (g): the shared tokens of its emission. All other emitted tokens are in this set alone.
    ranked = (F.col("token") < limit) | (F.col("g") == 1)
    shared = shared.withColumn("g", F.pmod("token", F.lit(2)).cast("int"))
    held = shared.groupBy("cls", "g").agg(F.collect_list(F.struct(F.when(ranked, F.col("rows")).otherwise(F.lit(2**62)).alias("df"), "token")).alias("held"))
    size = classes.select("cls", "rep", "n", "inside", (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).alias("p"))
    held = held.join(size, "cls")
    inside = F.when(F.col("g") == 1, F.col("n") - F.size("held")).otherwise(F.col("inside") - F.size(F.filter("held", lambda x: x["token"] < limit)))
    held = held.withColumn("alone", inside).withColumn("room", (F.col("p") - F.col("alone")).cast("int")).filter("room > 0")
    tokens = lambda order: F.transform(F.slice(order, F.lit(1), F.col("room")), lambda x: x["token"])
    by_b = F.array_sort(F.transform("held", lambda x: F.struct(x["df"], (-1 - x["token"]).alias("turned"), x["token"].alias("token"))))
    by_c = F.array_sort(F.transform("held", lambda x: x["token"]))
    # Order C: the set's p lowest hashes. Those of them that are shared are among the p lowest shared ones.
    prefixes = held.select("cls", "g", "rep", "n", "alone", tokens(F.array_sort("held")).alias("pa"), tokens(by_b).alias("pb"), F.slice(by_c, F.lit(1), F.col("p").cast("int")).alias("pc"))
    prefixes = materialize(prefixes, "prefixes")
    release(docs.sparkSession)

    lists = prefixes.select("cls", "g", "n", "alone", F.posexplode("pa").alias("pos", "token"))
    alive = lists.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("token")
    lists = materialize(lists.join(alive, "token"), "lists")
    at = lists.select("cls", "g").distinct()
    reps = prefixes.join(at, ["cls", "g"], "left_semi").select("cls", "g", "rep", "n", "pb", "pc")
    reps = materialize(reps, "reps")
    sets = materialize(_sets(docs, reps, n), "sets")
    release(docs.sparkSession)
    # A token that no other candidate holds can't be shared: sets with too few others have no link, and leave fewer to the next count.
    for _ in range(2):
        tokens_of = sets.select("cls", F.explode("set").alias("token"))
        common = tokens_of.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token")
        shares = tokens_of.join(common.hint("shuffle_hash"), "token", "left_semi").groupBy("cls").agg(F.count("*").alias("m"))
        shares = materialize(shares.join(sets.select("cls", F.size("set").alias("n")), "cls").filter(F.col("m") * 100 >= F.col("n") * percent).select("cls", "m"), "shares")
        sets = sets.join(shares.select("cls"), "cls", "left_semi")
    sets = materialize(sets, "sets")
    lists = materialize(lists.join(shares.join(sets.select("cls", *BITS), "cls"), "cls"), "lists")
    reps = materialize(reps.join(shares.select("cls"), "cls", "left_semi"), "reps")
    release(docs.sparkSession)

    def verified(pairs: DataFrame) -> DataFrame:
        one = reps.select(F.col("cls").alias("a"), "g", F.col("n").alias("na"), F.col("pb").alias("pb_a"), F.col("pc").alias("pc_a"))
        two = reps.select(F.col("cls").alias("b"), "g", F.col("n").alias("nb"), F.col("pb").alias("pb_b"), F.col("pc").alias("pc_b"))
        kept = pairs.join(one, ["a", "g"]).join(two, ["b", "g"]).filter(F.arrays_overlap("pb_a", "pb_b") & F.arrays_overlap("pc_a", "pc_b"))
        kept = kept.select("a", "b", "na", "nb").distinct()
        left, right = sets.select(F.col("cls").alias("a"), F.col("set").alias("sa")), sets.select(F.col("cls").alias("b"), F.col("set").alias("sb"))
        both = kept.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
        return both.filter(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b")


    def near(x: str, y: str, mx: str, my: str):
        """Sizes alike, enough tokens that others hold, bitmaps alike enough, and pairs of small sets only in their own join."""
        apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_b"))) for b in BITS[1:]), F.bit_count(F.col("b0").bitwiseXOR(F.col("b0_b"))))
        meet = (F.col(x) + F.col(y) - apart) * (100 + percent) >= (F.col(x) + F.col(y)) * (2 * percent)
        alike = (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
        return alike & meet & (F.least(mx, my) * (100 + percent) >= (F.col(x) + F.col(y)) * percent) & ((F.col("g") == 1) | (F.greatest(x, y) > small))

    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "g").distinct()
    nodes = reps.select(F.col("cls").alias("node")).distinct()
    comps, edges = None, None
    for pick in (F.min_by, F.max_by):
        now = lists if comps is None else _open_lists(lists, comps)
        lead = now.groupBy("token").agg(pick(F.struct("cls", "n", "m", *BITS), F.struct(F.col("n") - F.col("m"), "cls")).alias("lead")).select("token", F.col("lead.cls").alias("b"), F.col("lead.n").alias("nb"), F.col("lead.m").alias("mb"), *[F.col(f"lead.{b}").alias(f"{b}_b") for b in BITS])
        pairs = now.withColumnRenamed("cls", "a").join(lead, "token").filter((F.col("a") != F.col("b")) & near("n", "nb", "m", "mb"))
        if comps is not None:
            pairs = _apart(pairs, comps)
        new = verified(materialize(ordered(pairs), "pairs"))
        edges = materialize(new if edges is None else edges.union(new), "links")
        comps = connected_components(edges, nodes)
    left = _open_lists(lists, comps)
    # Of lists of the same sets the one of the first token stands for all: every pair of them meets there first.
    same = left.groupBy("token", "g").agg(F.count("*").alias("many"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("folded"), F.sum("pos").alias("places"))
    once = same.groupBy("many", "folded", "g").agg(F.min_by("token", "places").alias("token")).select("token")
    rest = left.join(once, "token").join(comps.withColumnRenamed("node", "cls"), "cls")
    rest = rest.select("token", "cls", "g", "n", "m", *BITS, "comp", (F.col("n") - F.col("alone") - F.col("pos")).alias("room"))
    rest = materialize(rest, "rest")
    other = rest.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), *[F.col(b).alias(f"{b}_b") for b in BITS], F.col("comp").alias("comp_b"), F.col("room").alias("room_b"))
    overlap = F.least("room", "room_b") * (100 + percent) >= (F.col("n") + F.col("nb")) * percent
    pairs = rest.withColumnRenamed("cls", "a").join(other, "token").filter((F.col("a") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & near("n", "nb", "m", "mb") & overlap)
    pairs = materialize(pairs.select("a", "b", "g").distinct(), "pairs")
    last = materialize(verified(pairs), "links")
    if not last.isEmpty():
        edges = materialize(edges.union(last), "links")
        comps = connected_components(edges, nodes)
    named = comps.withColumnRenamed("node", "cls").join(classes.select("cls", "rep"), "cls").groupBy("comp").agg(F.min("rep").alias("component_id"))
    links = edges.select("a").union(edges.select("b")).groupBy("a").agg(F.count("*").alias("links"))
    info = classes.select("cls", "rep").join(comps.withColumnRenamed("node", "cls"), "cls", "left").join(named, "comp", "left").join(links.withColumnRenamed("a", "cls"), "cls", "left")
    info = info.select("cls", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = base.select("doc_id", "n_shingles", "cls").join(info, "cls", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return settled(out, "components", mark)


def _open_lists(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The posting lists whose sets are not yet all in one component."""
    known = lists.join(comps.withColumnRenamed("node", "cls"), "cls")
    open_ = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    return known.drop("comp").join(open_, "token")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    x = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    y = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(x, "a").join(y, "b").filter("ca <> cb").drop("ca", "cb")


def _sets(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """Whole shingle sets of the classes that have candidates, from one text of each."""
    wanted = reps.select("cls", F.col("rep").alias("doc_id")).distinct()
    # Rows that share a doc_id may belong to other classes; the recomputed class tells them apart.
    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    text = docs.join(ids, docs.doc_id.eqNullSafe(ids.wanted_id), "left_semi")

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                cls, sets, bits = [], [], []
                for s in shingle_sets(piece, n):
                    cls.append(_class(s))
                    sets.append(signed(s))
                    odd = np.bincount((mix64(s + _ODD[4]) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                    bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                columns = [pa.array([b[k] for b in bits], pa.int64()) for k in range(4)]
                yield pa.record_batch([pa.array(cls, pa.int64()), pa.array(sets, pa.list_(pa.int64())), *columns], ["cls", "set", *BITS])

    made = text.mapInArrow(freed(run), "cls long, set array<long>, " + ", ".join(f"{b} long" for b in BITS)).join(wanted.select("cls"), "cls", "left_semi")
    return made.dropDuplicates(["cls"])
