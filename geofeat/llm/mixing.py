"""Mixing sources to target weights by temperature.

Source shares of tokens p are raised to an exponent and normalised: w = p**a / sum(p**a); a = 1 keeps the natural mix, a = 0 weighs all
sources alike. The exponent is bisected until the weights have a target entropy (as a part of the largest possible one) or until
the most repeated source reaches a repetition limit; each Spark pass over the source table evaluates the 31 inner points of five halvings.

The budget (tokens in all) gives each source w * budget tokens. They are realised as passes over a permutation of the source's
documents by hash, and all sources are dealt into blocks of equal size in proportion, each block permuted by hash.

Defined results. A document counts as max(1, words) tokens, so that empty and null texts take part. Null source: a source of its own.
Null doc_id and repeated rows: every row is a document; ties in the permutation fall to doc_id, equal rows are interchangeable.
One source: weight 1. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofeat.llm.common import materialize, scratch_mark, settled

HALVINGS = 5


SEED = 17


def row_hash(seed: int = SEED):
    """Rows alike in id, source and text share it; nulls are marked, as the hash itself skips them."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in ("doc_id", "source", "text")])
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"), nulls)


def mixed_documents(docs: DataFrame, seed: int = SEED, **target) -> DataFrame:
    """The documents in their own columns, one row per use; texts are shuffled once, by the hash that the narrow plan carries."""
    mark = scratch_mark()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__of")
    uses = settled(mix(docs, seed=seed, **target).select(F.col("order").alias("__use"), key), "mix-uses", mark)
    # Equal rows share one hash and stand for each other, so each hash keeps one row and takes all uses.
    rows = docs.select(*docs.columns, row_hash(seed).alias("__use"), key).dropDuplicates(["__use", "__of"])
    return rows.join(uses, ["__use", "__of"]).select(*[rows[c] for c in docs.columns])


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source, tokens, docs): summed map-side, one row a source and task."""
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def bisect_exponent(sources: DataFrame, entropy: float | None = None, repetition: float | None = None, passes: int = 8) -> float:
    """The exponent in [0, 1] whose weights meet the target; both measures fall as the exponent grows.

    ``entropy`` is a part of log(sources); ``repetition`` bounds the passes over the most repeated source when the least
    repeated one is read once. The smallest exponent within the limit is taken, or 1 where none is.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either entropy or repetition")
    total = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).head()
    if not total["n"] or total["n"] == 1:
        return 1.0
    lo, hi = 0.0, 1.0
    logp = F.log(F.col("tokens") / F.lit(float(total["t"])))
    for _ in range(passes):
        width = (hi - lo) / 2**HALVINGS
        grid = [lo + width * k for k in range(1, 2**HALVINGS)]
        each = sources.select(logp.alias("l"), F.explode(F.array(*[F.lit(a) for a in grid])).alias("a"))
        e = F.exp(F.col("a") * F.col("l"))
        got = each.groupBy("a").agg(F.sum(e).alias("z"), F.sum(e * F.col("a") * F.col("l")).alias("s"), F.min("l").alias("least"), F.max("l").alias("most"))
        value = F.log("z") - F.col("s") / F.col("z") if entropy is not None else F.exp((1 - F.col("a")) * (F.col("most") - F.col("least")))
        limit = entropy * math.log(total["n"]) if entropy is not None else repetition
        over = {r["a"]: r["v"] > limit for r in got.select("a", value.alias("v")).collect()}
        for a in grid:
            if over[a]:
                lo = a
            else:
                hi = a
                break
    return hi


def weights(sources: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """(source, tokens, docs, weight, budget). Without a budget: the smallest that reads each source at least once."""
    total = float(sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0] or 1)
    raised = sources.withColumn("raised", F.pow(F.col("tokens") / total, F.lit(exponent)))
    z, cover = raised.agg(F.sum("raised"), F.max(F.col("tokens") / F.col("raised"))).head()
    z = z or 1.0
    whole = float(budget) if budget is not None else (cover or 0.0) * z
    exact = F.col("raised") / z * whole
    if budget is None:
        exact = F.greatest(exact, F.col("tokens"))  # against the last bit of rounding
    return raised.select("source", "tokens", "docs", (F.col("raised") / z).alias("weight"), F.ceil(exact).cast("long").alias("budget"))


def mix(docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, bucket_docs: int = 4096, seed: int = SEED) -> DataFrame:
    """One row per use of a document: doc_id, source, tokens, pass, block, place (within the block), order (its row's hash)."""
    tokens = F.greatest(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")
    docs = docs.select("doc_id", "source", tokens.alias("tokens"), row_hash(seed).alias("order"))
    docs = materialize(docs, "mix-docs")
    sources = materialize(source_tokens(docs), "mix-sources")
    plan = weights(sources, bisect_exponent(sources, entropy, repetition), budget)
    blocks = max(1, -(-int(plan.agg(F.coalesce(F.sum("budget"), F.lit(0))).head()[0]) // block_tokens))
    # Running sums in two steps, so that no source, however large, is one task: buckets of the hash range, then documents within.
    fine = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(bucket_docs))).cast("long")
    plan = plan.withColumn("buckets", fine)
    small = sources.count() <= 100_000
    known = plan.select(F.col("source").alias("of"), F.col("tokens").alias("total"), "budget", "buckets")
    dealt = docs.join(F.broadcast(known) if small else known, docs.source.eqNullSafe(F.col("of"))).drop("of")
    dealt = dealt.withColumn("bucket", F.floor((F.shiftrightunsigned("order", 11) / F.lit(float(2**53))) * F.col("buckets")).cast("long"))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    run = run.join(bases, run.source.eqNullSafe(bases.s) & (run.bucket == bases.b)).withColumn("start", F.col("base") + F.col("inner"))
    # A pass is open to a document while its start lies before what is left of the budget.
    passes = F.ceil((F.col("budget") - F.col("start")) / F.col("total")).cast("long")
    used = run.filter(passes > 0).select("doc_id", "source", "tokens", "order", "start", "total", "budget", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)).alias("pass"))
    share = (F.col("start") + F.col("pass") * F.col("total")) / F.col("budget")
    used = used.withColumn("block", F.least(F.floor(share * blocks), F.lit(blocks - 1)).cast("long"))
    shuffled = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), F.col("order"), F.col("pass")), "source", "doc_id", "pass")
    return used.select("doc_id", "source", "tokens", "pass", "block", (F.row_number().over(shuffled) - 1).cast("long").alias("place"), "order")
