"""Language ID by multilingual mixture inference.

Training counts hashed byte n-grams of all labelled training texts per language. A text is then a mixture of languages: each word
was drawn in one of them, with the likelihood of its n-grams; expectation-maximisation gives the proportions. Languages are
taken out of the mixture, smallest proportion first, while that costs less log-likelihood than the penalty for one more language.

The log-likelihood is concave in the proportions, so its slopes at a single language bound what any mixture could gain over it; texts
in which that is less than the penalty need no rounds. All other texts of a slice go through the rounds together. Likelihoods
are worked out once for each distinct word of a slice.

Defined results. Null text or a text without a letter (Unicode category L): ``und``, score 0. No training rows: ``und``, score 0.
Null lang: not learned from. Null doc_id: counts as the empty text for the fold. Equal proportions: the language that sorts first.
Repeated rows: each on its own. Columns named lang_pred, score or langs are replaced by the results; other extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofeat.llm.common import _LOWER, freed, mix64, require, slices, utf8, word_hashes, words

BITS = 16
SLICE = 1 << 20
#: EM stops when no proportion moves by more, or after so many rounds.
MOVE, ROUNDS = 1e-3, 40
_FOLD = _LOWER.copy()
_FOLD[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32
_LETTER = regex.compile(r"\p{L}")


def distinct_words(batch: pa.RecordBatch, column: str = "text"):
    """Letter runs of the texts: (bin and distinct run of each byte 2- to 4-gram, distinct run of each run, each text's first run)."""
    off, data = utf8(batch.column(column))
    folded = _FOLD[data]
    starts, lengths, first = words(off, folded)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), first
    _, at, of = np.unique(word_hashes(folded, starts, lengths), return_index=True, return_inverse=True)
    starts, lengths = starts[at], lengths[at]
    size = lengths + 2  # a blank on either side
    begin = np.cumsum(size) - size
    text = np.full(int(size.sum()), 32, np.uint64)
    inner = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[np.repeat(begin + 1, lengths) + inner] = folded[np.repeat(starts, lengths) + inner]
    run = np.repeat(np.arange(len(size), dtype=np.int32), size)
    bins, owner = [], []
    gram = text
    for n in range(2, 5):
        gram = gram[:-1] * np.uint64(256) + text[n - 1 :]
        whole = run[: len(gram)] == run[n - 1 :]
        bins.append((mix64(gram[whole] + np.uint64(n << 40)) >> np.uint64(64 - BITS)).astype(np.int32))
        owner.append(run[: len(gram)][whole])
    return np.concatenate(bins), np.concatenate(owner), of.ravel(), first


def train(docs: DataFrame) -> DataFrame:
    """(lang, bin, n): n-gram counts of labelled texts, summed in tasks first and then by Spark."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                bins, owner, of, first = distinct_words(piece)
                if not len(of):
                    continue
                codes = piece.column("lang").dictionary_encode()
                lang = np.repeat(codes.indices.to_numpy(), np.diff(first))
                types = int(of.max()) + 1
                times = np.bincount(lang * np.int64(types) + of, minlength=len(codes.dictionary) * types).reshape(-1, types)
                for x, n in zip(codes.dictionary.to_pylist(), times):
                    if x not in sums:
                        sums[x] = np.zeros(1 << BITS)
                    sums[x] += np.bincount(bins, n[owner], minlength=1 << BITS)
        for x, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "bin", "n"])

    return docs.mapInArrow(freed(run), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities of the 2**BITS bins per language; its size is bounded by the number of languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], alpha: float = 0.5):
        self.langs = sorted(counts)
        table = np.full((len(self.langs), 1 << BITS), alpha)
        for row, lang in zip(table, self.langs):
            bins, n = counts[lang]
            np.add.at(row, bins, n)
        self.logp = np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if self.langs else table.astype(np.float32)

    @classmethod
    def learned(cls, labelled: DataFrame) -> Model:
        """One row a language reaches the driver, of at most 2**BITS bins."""
        rows = train(labelled).groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).toArrow().combine_chunks()
        counts = {}
        for lang, bins in zip(rows.column("lang").to_pylist(), rows.column("bins")):
            counts[lang] = bins.values.field("bin").to_numpy(), bins.values.field("n").to_numpy()
        return cls(counts)

    def word_likelihoods(self, bins: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Log-likelihood of each distinct word (columns) in each language (rows), less that of its best language."""
        out = np.stack([np.bincount(owner, logp[bins], minlength=n) for logp in self.logp])
        return (out - out.max(0)).astype(np.float32)


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the words (columns) of each text."""
    return np.add.reduceat(values, first, axis=1, dtype=np.float64)


def _of_texts(values: np.ndarray, first: np.ndarray, size: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts alone, and where each now begins."""
    n = size[texts]
    begin = np.cumsum(n) - n
    return values.take(np.repeat(first[texts] - begin, n) + np.arange(int(n.sum())), axis=1), begin


def proportions(like: np.ndarray, first: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many texts at once: mixture weights over the ``kept`` languages of each text, and the log-likelihoods.

    ``like`` and ``kept`` have a row a language; text i has the words (columns) from ``first[i]`` on. A text stays as it is from the round on in
    which it moves little, whatever the others do; when enough are at rest, their words leave the rounds.
    """
    size = np.diff(np.append(first, like.shape[1]))
    pi = kept / kept.sum(0)
    live, part, begin, text = np.arange(len(first)), like, first, np.repeat(np.arange(len(first)), size)
    moving = np.ones(len(live), bool)
    for _ in range(ROUNDS):
        joint = pi.astype(np.float32).take(live, axis=1).take(text, axis=1) * part
        joint *= 1 / np.maximum(joint.sum(0), np.float32(1e-37))
        new = np.where(kept[:, live], np.maximum(np.add.reduceat(joint, begin, axis=1) / size[live], 1e-12), 0)
        new /= new.sum(0)
        moves = moving & (np.abs(new - pi[:, live]).max(0) > MOVE)
        pi[:, live[moving]] = new[:, moving]
        moving = moves
        if not moving.any():
            break
        if moving.mean() < 0.8:
            live = live[moving]
            part, begin = _of_texts(like, first, size, live)
            text = np.repeat(np.arange(len(live)), size[live])
            moving = np.ones(len(live), bool)
    mixed = (like * pi.astype(np.float32).take(np.repeat(np.arange(len(first)), size), axis=1)).sum(0)
    return pi, _by_text(np.log(np.maximum(mixed, np.float32(1e-37)))[None], first)[0]


def infer(rel: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions (languages x texts; 0: taken out) of texts with words; ``rel``, a row a language, is the words' relative log-likelihoods."""
    size = np.diff(np.append(first, rel.shape[1]))
    cost = penalty * np.maximum(1.0, np.log(size))
    single = _by_text(rel, first)
    best, texts = single.argmax(0), np.arange(len(first))
    out = np.zeros(single.shape)
    out[best, texts] = 1
    # A mixture's log-likelihood is 0 here at most, and at most that of the best language plus its steepest slope.
    gain = -single[best, texts]
    if len(rel) == 1 or not (gain > cost).any():
        return out
    ratio = np.exp(np.minimum(rel - np.take_along_axis(rel, best[np.repeat(texts, size)][None], 0), 80))
    gain = np.minimum(gain, _by_text(ratio, first).max(0) - size)
    open_ = np.flatnonzero(gain > cost)
    if not len(open_):
        return out
    like = np.maximum(np.exp(rel), np.float32(1e-30))
    part, begin = _of_texts(like, first, size, open_)
    kept = np.ones((len(rel), len(open_)), bool)
    pi, value = proportions(part, begin, kept)
    out[:, open_] = pi
    while len(open_):
        # The smallest goes; with it all that hold less than a hundredth of a word between them; one always stays.
        order = np.argsort(np.where(kept, pi, 2), axis=0, kind="stable")
        ranked = np.take_along_axis(np.where(kept, pi, 2), order, 0)
        go = np.cumsum(ranked, 0) * size[open_] < 0.01
        go[0] = True
        drop = np.zeros_like(kept)
        np.put_along_axis(drop, order, go, 0)
        less = kept & ~drop
        pi_less, value_less = proportions(part, begin, less)
        gone = value - value_less <= cost[open_] * (kept.sum(0) - less.sum(0))
        out[:, open_[gone]] = pi_less[:, gone]
        still = gone & (less.sum(0) > 1)
        open_, kept, pi, value = open_[still], less[:, still], pi_less[:, still], value_less[still]
        if len(open_):
            part, begin = _of_texts(like, first, size, open_)
    return out


def identify(docs: DataFrame, labelled: DataFrame, penalty: float = 2.0, prefix: str = "") -> DataFrame:
    """Per document: the given columns, then lang_pred, score (0 to 1), langs (kept languages and their proportions).

    The new names begin with ``prefix``; given columns of just these names give way to them.
    """
    known = require(labelled, "text", "lang").filter("text is not null and lang is not null").selectExpr("text", "cast(lang as string) lang")
    told = docs.sparkSession.sparkContext.broadcast(Model.learned(known))
    added = [prefix + c for c in ("lang_pred", "score", "langs")]
    docs = docs.drop(*added)
    names = docs.columns

    def run(batches):
        model = told.value
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                n = piece.num_rows
                pred, score, langs = np.full(n, "und", object), np.zeros(n), [[] for _ in range(n)]
                bins, owner, of, first = distinct_words(piece)
                texts = piece.column("text").to_pylist()
                some = np.array([k for k, t in enumerate(texts) if first[k + 1] > first[k] and _LETTER.search(t)], np.int64) if model.langs else []
                if len(some):
                    rel = model.word_likelihoods(bins, owner, int(of.max()) + 1)
                    size = np.diff(first)[some]
                    begin = np.cumsum(size) - size
                    pi = infer(rel.take(of[np.repeat(first[some] - begin, size) + np.arange(int(size.sum()))], axis=1), begin, penalty)
                    best = pi.argmax(0)
                    pred[some] = np.array(model.langs, object)[best]
                    score[some] = np.clip(pi[best, np.arange(len(some))], 0, 1)
                    for k, row in zip(some.tolist(), pi.T):
                        langs[k] = [(model.langs[j], float(row[j])) for j in np.flatnonzero(row)]
                extra = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.map_(pa.string(), pa.float64()))]
                yield pa.record_batch(piece.columns + extra, [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(freed(run), f"{schema}, `{added[0]}` string, `{added[1]}` double, `{added[2]}` map<string,double>")
