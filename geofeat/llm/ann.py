"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of several full-dimensional codebooks. Codebooks are fitted on a bounded sample:
k-means on the residuals of the books before, then each book anew by alternating least squares over beam-search codes. Every row is
encoded by beam search and stored as codes and the squared norm of its approximation. A query scores a row by look-up tables:
|x|^2 - 2 sum(<q, codeword>), up to the query's own norm. The best ``shortlist`` rows of a query over all blocks are reranked
by the exact distance on the original vectors. All rows are scored; no cells are left out.

Tasks pack the codes of ``pack_rows`` vectors into one binary row. Queries are dealt into groups of ``query_rows``; to each group all packs are
streamed, in ``shares`` of at most ``share_rows`` vectors, and a task keeps nothing but its group's queries and the best ``shortlist`` rows of each so far. The
best of a query over its shares are reranked.

Defined results. Vectors null, zero, of another length than most, or holding null or non-finite components take no part; all others do, whatever their
scale: codes and scores are of the vectors divided by a power of two, and distances that overflow are taken in scaled form. Null vec_id:
takes no part. Repeated vec_ids: each row is a query or candidate of its own; only the query's own row is left out, and a repeated query id gives a
list a row. Ties: smaller vec_id first. Fewer candidates than k: all of them. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofeat.llm.common import materialize, require, scratch_mark, settled


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    rows = require(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.filter("vec_id is not null and v is not null").filter(finite & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d").collect()
    return rows.filter(F.size("v") == (most[0]["d"] if most else 0))


class AdditiveQuantiser:
    """Full-dimensional codebooks (books, words, dimensions) with beam-search encoding."""

    def __init__(self, books: int = 20, words: int = 256, beam: int = 4):
        self.m, self.k, self.beam = books, words, beam
        self.code = np.zeros((0, 0, 0), np.float32)

    def fit(self, x: np.ndarray, rounds: int = 1, seed: int = 5) -> AdditiveQuantiser:
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        k = min(self.k, len(x))
        self.code = np.zeros((self.m, k, x.shape[1]), np.float32)
        rest = x.copy()
        for m in range(self.m):
            self.code[m] = _kmeans(rest, k, rng)
            rest -= self.code[m][_nearest(rest, self.code[m])]
        for _ in range(rounds):  # refit each book against what the others leave
            codes = self.encode(x)[0]
            rest = x - self.decode(codes)
            for m in range(self.m):
                target = rest + self.code[m][codes[:, m]]
                n = np.bincount(codes[:, m], minlength=k)
                sums = np.zeros_like(self.code[m])
                np.add.at(sums, codes[:, m], target)
                new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.code[m])
                rest = target - new[codes[:, m]]
                self.code[m] = new
        return self

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.code[m][codes[:, m]] for m in range(self.m))

    def encode(self, x: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) and the squared norms of the approximations."""
        norms = (self.code**2).sum(2)
        cross = np.einsum("akd,bld->abkl", self.code, self.code)
        out = np.zeros((len(x), self.m), np.uint8)
        for a in range(0, len(x), block):
            part = x[a : a + block].astype(np.float32)
            dots = np.einsum("nd,mkd->nmk", part, self.code)
            n, codes = len(part), np.zeros((len(part), 1, self.m), np.int64)
            score = np.zeros((n, 1), np.float32)
            for m in range(self.m):
                # |x - s - c|^2 less |x - s|^2 is |c|^2 - 2<x,c> + 2<s,c>, s the words chosen so far
                step = norms[m][None, None] - 2 * dots[:, m][:, None]
                for j in range(m):
                    step = step + 2 * cross[j, m][codes[:, :, j]]
                total = (score[:, :, None] + step).reshape(n, -1)
                width = min(self.beam, total.shape[1])
                best = np.argpartition(total, width - 1, axis=1)[:, :width]
                score = np.take_along_axis(total, best, 1)
                parent, word = best // step.shape[2], best % step.shape[2]
                codes = np.take_along_axis(codes, parent[:, :, None], 1).copy()
                codes[:, :, m] = word
            out[a : a + block] = codes[np.arange(n), score.argmin(1)]
        return out, (self.decode(out).astype(np.float64) ** 2).sum(1)

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """(queries, rows): squared distances to the approximations, less the queries' own norms."""
        tables = np.einsum("qd,mkd->qmk", queries.astype(np.float32), self.code)
        dots = np.zeros((len(queries), len(codes)), np.float32)
        for m in range(self.m):
            dots += tables[:, m][:, codes[:, m]]
        return norms[None].astype(np.float32) - 2 * dots


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = (words**2).sum(1) / 2
    return np.concatenate([(half[None] - x[a : a + 4096] @ words.T).argmin(1) for a in range(0, len(x), 4096)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, words)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return words.astype(np.float32)


def fit(rows: DataFrame, sample: int, scale: float, **sizes) -> AdditiveQuantiser:
    """Fitted on the ``sample`` rows that come first by a hash: a bounded, repeatable choice. Equal vectors count once."""
    part = rows.select("v").withColumn("h", F.xxhash64("v")).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(sample)
    x = np.array([r["v"] for r in part.collect()], np.float64) * scale
    return AdditiveQuantiser(**sizes).fit(x) if len(x) else AdditiveQuantiser(**sizes)


def _best(near: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least of a row of scores, least first, ties to smaller ids."""
    cut = np.partition(near, n - 1)[n - 1] if len(near) > n else np.inf
    some = np.flatnonzero(near <= cut)
    return some[np.lexsort((ids[some], near[some]))[:n]]


class _Shortlists:
    """The best rows so far of each query of a group."""

    def __init__(self, aq: AdditiveQuantiser, own: np.ndarray, vectors: np.ndarray, size: int):
        self.aq, self.own, self.x, self.size, self.waiting, self.held = aq, own, vectors, size, [], 0
        self.best = [(np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]

    def add(self, pack: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], enough: int = 16384) -> None:
        self.waiting.append(pack)
        self.held += len(pack[0])
        if self.held >= enough:
            self.score()

    def score(self) -> None:
        if not self.waiting:
            return
        rows, ids, norms, codes = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.held = [], 0
        for a in range(0, len(self.own), 64):
            for q, near in enumerate(self.aq.scores(self.x[a : a + 64], codes, norms), a):
                near = np.concatenate([self.best[q][0], np.where(rows == self.own[q], np.inf, near)])
                every = np.concatenate([self.best[q][1], ids]), np.concatenate([self.best[q][2], rows])
                some = _best(near, every[0], self.size + 1)
                some = some[every[1][some] != self.own[q]][: self.size]
                self.best[q] = near[some], every[0][some], every[1][some]

    def table(self) -> pa.RecordBatch:
        self.score()
        q = np.repeat(self.own, [len(b[0]) for b in self.best])
        near, ids, rows = (np.concatenate([b[k] for b in self.best]) if self.best else np.zeros(0) for k in range(3))
        return pa.record_batch([pa.array(q, pa.int64()), pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(near, pa.float32())], ["q", "row", "vec_id", "near"])


def search(vectors: DataFrame, is_query, k: int = 10, shortlist: int = 800, sample: int = 6144, pack_rows: int = 256, query_rows: int = 1024, share_rows: int = 1 << 24, **sizes) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's k nearest found."""
    spark, mark = vectors.sparkSession, scratch_mark()
    rows = materialize(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, most = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))).head()
    # A power of two changes no digit; with it all components lie within 1, so that single precision holds norms and products.
    scale = 2.0 ** -max(-1000, min(1000, math.frexp(most)[1])) if n else 1.0
    told = spark.sparkContext.broadcast(fit(rows, sample, scale, **sizes))
    queries = rows.filter(is_query)
    groups, shares = max(1, -(-queries.count() // query_rows)), max(1, -(-n // share_rows))

    def encode(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                codes, norms = told.value.encode(np.array(part.column("v").to_pylist(), np.float64) * scale)
                columns = part.column("row").to_numpy(), part.column("vec_id").to_numpy(), norms.astype(np.float32), codes
                cuts = range(0, part.num_rows, pack_rows)
                packed = [pa.array([np.ascontiguousarray(x[c : c + pack_rows]).tobytes() for c in cuts], pa.binary()) for x in columns]
                yield pa.record_batch([pa.array(columns[0][::pack_rows], pa.int64()), *packed], ["first", "rows", "ids", "norms", "codes"])

    packs = materialize(rows.select("row", "vec_id", "v").mapInArrow(encode, "first long, rows binary, ids binary, norms binary, codes binary"), "codes")
    every = lambda m, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(name)
    asked = queries.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("asks"), every(shares, "share"), F.col("row").alias("first"), "v")
    spread = packs.select(every(groups, "asks"), F.pmod(F.xxhash64("first"), F.lit(shares)).alias("share"), "first", "rows", "ids", "norms", "codes")
    both = asked.withColumn("pack", F.lit(0)).unionByName(spread.withColumn("pack", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("asks", "share").sortWithinPartitions("asks", "share", "pack", "first")

    def score(batches):
        group, lists, own, vectors_ = None, None, [], []
        types = (("rows", np.int64), ("ids", np.int64), ("norms", np.float32), ("codes", np.uint8))
        for batch in batches:
            kinds, firsts, v = batch.column("pack").to_pylist(), batch.column("first").to_pylist(), batch.column("v")
            for i, now in enumerate(zip(batch.column("asks").to_pylist(), batch.column("share").to_pylist())):
                if now != group:
                    if lists:
                        yield lists.table()
                    group, lists, own, vectors_ = now, None, [], []
                if not kinds[i]:
                    own.append(firsts[i])
                    vectors_.append(v[i].as_py())
                elif own:
                    lists = lists or _Shortlists(told.value, np.array(own, np.int64), np.array(vectors_, np.float64) * scale, shortlist)
                    pack = [np.frombuffer(batch.column(c)[i].as_py(), d) for c, d in types]
                    lists.add((*pack[:3], pack[3].reshape(len(pack[0]), -1)))
        if lists:
            yield lists.table()

    found = both.mapInArrow(score, "q long, row long, vec_id long, near float")
    at = F.row_number().over(Window.partitionBy("q").orderBy("near", "vec_id", "row"))
    found = found.withColumn("at", at).filter(F.col("at") <= shortlist)
    own = queries.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("v").alias("w"))
    both = found.select("q", "row").join(own, "q").join(rows, "row")
    gap = F.zip_with("w", "v", lambda a, b: a - b)
    plain = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, d: s + d * d))
    top = F.aggregate(gap, F.lit(0.0), lambda m, d: F.greatest(m, F.abs(d)))
    scaled = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, d: s + (d / top) * (d / top))) * top
    exact = both.select("q", "query_id", "row", "vec_id", F.when(plain < float("inf"), plain).otherwise(scaled).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id", "row"))
    out = exact.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return settled(out, "neighbours", mark)
