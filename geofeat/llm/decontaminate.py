"""Benchmark decontamination with FM-indexes over training shards.

A shard is a run of documents of bounded size within a task. Its text is the sequence of word numbers in the benchmark's
vocabulary (0: a word that no window holds). Only stretches that could hold a window are indexed: runs of known words at least as
long as the shortest window. Windows are found by backward search: ranks come from a wavelet tree over the Burrows-Wheeler
transform, places from sampled suffix positions, and the spans found are merged per document. Nothing is shuffled.

Defined results. Null or wordless text: no words, no hits. A null or wordless item: never occurs. Repeated items with one text:
each counts by its own id. A null item_id: its windows hit, but it has no id to list or count. Repeated documents: each row on its own.
An empty benchmark: nothing is hit. Extra columns: ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofeat.llm.common import freed, materialize, mix64, require, slices, utf8, word_hashes, words

#: Other bytes than digits, letters and those of multi-byte characters part words; A-Z are folded.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


_FOLDED = np.frombuffer(_WORD, np.uint8)


class WaveletTree:
    """rank(symbol, place) in one step a bit: at each level the sequence is stably parted by a bit, high bit first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            ones = self.ones[k][at]
            at = np.where((symbols >> (self.bits - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place ``at``."""
        return self._down(symbols, at) - self._down(symbols, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        symbols = np.zeros_like(at)
        for k in range(self.bits):
            here = self.ones[k]
            ones = here[at]
            bit = here[at + 1] - ones
            symbols = symbols * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return symbols


class FMIndex:
    """Of a sequence of numbers; 0 parts stretches and is never part of a pattern."""

    SAMPLE = 8

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0).astype(np.int64)
        n = len(text)
        order, rank, k = None, np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while True:  # prefix doubling until all suffixes differ
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            k *= 2
            if new[-1] == n - 1:
                break
        bwt = text[order - 1]
        counts = np.bincount(text)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletTree(bwt, max(1, int(len(counts) - 1).bit_length()))
        self.sampled = (order % self.SAMPLE == 0) | (bwt == 0)  # stretch starts, so that no step crosses a 0
        self.slot = np.concatenate([[0], np.cumsum(self.sampled)])
        self.places = order[self.sampled]
        self.n, self.symbols = n, len(counts)

    def search(self, sequence: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of all patterns at once: pattern i is the ``lengths[i]`` numbers of ``sequence`` before ``ends[i]``."""
        live = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for k in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > k) & (lo[live] < hi[live])]
            c = sequence[ends[live] - 1 - k].astype(np.int64)
            known = c < self.symbols
            hi[live[~known]] = lo[live[~known]]
            at, c = live[known], c[known]
            lo[at], hi[at] = self.before[c] + self.tree.rank(c, lo[at]), self.before[c] + self.tree.rank(c, hi[at])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffixes: step back through the text until a sampled suffix is met."""
        steps, found, open_ = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64), np.arange(len(rows))
        at = rows.copy()
        while len(open_):
            hit = self.sampled[at]
            found[open_[hit]] = self.places[self.slot[at[hit]]] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            c = self.tree.access(at)
            at = self.before[c] + self.tree.rank(c, at)
            steps[open_] += 1
        return found


class Windows:
    """The benchmark's distinct windows, for use in tasks: places in one sequence of word numbers, and the items of each, all in arrays.

    Words and windows are told apart by 64-bit hashes.
    """

    def __init__(self, item_ids: pa.Array, texts: pa.Array, size: int):
        off, data = utf8(texts)
        folded = _FOLDED[data]
        starts, lengths, first = words(off, folded)
        h = word_hashes(folded, starts, lengths)
        self.vocabulary = np.unique(h)
        self.sequence = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int32)
        n = np.diff(first)
        many = np.where(n >= size, n - size + 1, n > 0)
        item = np.repeat(np.arange(len(n), dtype=np.int32), many)
        start = np.repeat(first[:-1] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        length = np.minimum(n, size)[item]
        name = length.astype(np.uint64)
        for k in range(int(length.max(initial=0))):
            at = np.flatnonzero(length > k)
            name[at] = mix64(name[at] * np.uint64(0x9E3779B97F4A7C15) + self.sequence[start[at] + k].astype(np.uint64))
        _, one, of = np.unique(name, return_index=True, return_inverse=True)
        self.lengths = length[one]
        self.ends = start[one] + self.lengths
        self.owners = item[np.argsort(of.ravel(), kind="stable")]
        self.first_owner = np.concatenate([[0], np.cumsum(np.bincount(of.ravel(), minlength=len(one)))])
        self.item_ids = item_ids
        self.least = int(self.lengths.min()) if len(one) else 0

    def items(self, windows: np.ndarray) -> set[str]:
        owners = np.concatenate([self.owners[self.first_owner[w] : self.first_owner[w + 1]] for w in windows])
        return {x for x in self.item_ids.take(pa.array(np.unique(owners))).to_pylist() if x is not None}

    def scan(self, column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, set[str]]]]:
        """The texts' word counts, and for each text with a hit its merged spans as rows (first word, end) and its items."""
        off, data = utf8(column)
        folded = _FOLDED[data]
        starts, lengths, first = words(off, folded)
        counts = np.diff(first)
        if not self.least or not len(starts):
            return counts, {}
        h = word_hashes(folded, starts, lengths)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        numbers = np.where(self.vocabulary[at] == h, at + 1, 0)
        flat = np.insert(numbers, first[1:], 0)  # a 0 after each text
        ends = np.flatnonzero(flat == 0)
        begins = np.concatenate([[0], ends[:-1] + 1])
        keep = ends - begins >= self.least
        begins, ends = begins[keep], ends[keep]
        if not len(begins):
            return counts, {}
        size = ends - begins + 1  # with the 0 that closes each stretch
        index_at = np.cumsum(size) - size
        fm = FMIndex(flat[np.repeat(begins - index_at, size) + np.arange(int(size.sum()))])
        lo, hi = fm.search(self.sequence, self.ends, self.lengths)
        hits = hi - lo
        which = np.repeat(np.arange(len(hits)), hits)
        place = fm.locate(np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum())))
        stretch = np.searchsorted(index_at, place, "right") - 1
        place = place - index_at[stretch] + begins[stretch]  # back to ``flat``
        doc_at = first[:-1] + np.arange(len(counts))
        doc = np.searchsorted(doc_at, place, "right") - 1
        order = np.lexsort((place, doc))
        doc, place, which = doc[order], place[order], which[order]
        out = {}
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])), [len(doc)]]).tolist() if len(doc) else []
        for a, b in zip(edges[:-1], edges[1:]):
            begin = place[a:b] - doc_at[doc[a]]
            end = np.maximum.accumulate(begin + self.lengths[which[a:b]])
            new = np.concatenate([[True], begin[1:] > end[:-1]])
            last = np.concatenate([np.flatnonzero(new)[1:] - 1, [b - a - 1]])
            out[int(doc[a])] = np.stack([begin[new], end[last]], 1), self.items(np.unique(which[a:b]))
        return counts, out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 16 << 20, shard_bytes: int = 4 << 20, keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Per document: doc_id, text, the ``keep`` columns, n_words, spans (merged hit spans of words), items (ids with an occurrence).

    ``prefix`` goes before the names of the last three; a kept column of such a name gives way to the result. The benchmark is sent to tasks in
    blocks of at most ``block_bytes`` (one longer item makes a block). Several blocks are scanned in passes, each of which is written before
    the next begins, so that one block at a time is held by the driver and by a task; spans and items are merged from pass to pass.
    """
    items = require(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item_id"), "text")
    spark = docs.sparkSession
    need = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head()["n"]
    blocks = max(1, -(-need // block_bytes))
    results = [prefix + x for x in ("n_words", "spans", "items")]
    found = require(docs, "doc_id", "text", *(c for c in keep if c not in (*results, "doc_id", "text")))
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        table = part.toArrow().combine_chunks()
        told = spark.sparkContext.broadcast(Windows(*(table.column(c).combine_chunks() for c in ("item_id", "text")), window))
        del table
        found = _scan(found, told, shard_bytes, results, k == 0)
        if blocks > 1:
            found = materialize(found, "decontaminated")
            told.destroy()
    return found


def _scan(docs: DataFrame, told, shard_bytes: int, results: list[str], first: bool) -> DataFrame:
    names = [c for c in docs.columns if c not in results]
    n_words, spans_name, items_name = results
    span = pa.struct([("first", pa.int64()), ("end", pa.int64())])

    def run(batches):
        windows = told.value
        for batch in batches:
            for piece in slices(batch, "text", shard_bytes):
                counts, hit = windows.scan(piece.column("text"))
                spans, items = [[] for _ in counts], [[] for _ in counts]
                for d, (s, i) in hit.items():
                    spans[d], items[d] = s.tolist(), sorted(i)
                if not first:
                    for d, (s, i) in enumerate(zip(piece.column(spans_name).to_pylist(), piece.column(items_name).to_pylist())):
                        spans[d], items[d] = merge_spans(spans[d] + [[x["first"], x["end"]] for x in s]), sorted({*items[d], *i})
                made = [
                    pa.array(counts, pa.int64()),
                    pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], pa.list_(span)),
                    pa.array(items, pa.list_(pa.string())),
                ]
                yield pa.record_batch([piece.column(c) for c in names] + made, [*names, *results])

    schema = "".join(f"`{c}` {t}, " for c, t in docs.dtypes if c in names)
    return docs.mapInArrow(freed(run), f"{schema}`{n_words}` long, `{spans_name}` array<struct<first:long,end:long>>, `{items_name}` array<string>")


def cut_spans(found: DataFrame, spans: str = "spans") -> DataFrame:
    """The texts without their hit spans, from the first word's start to the last word's end; other columns as they are."""
    names = found.columns
    word = re.compile(rb"[^ ]+")

    def run(batches):
        for batch in batches:
            out = []
            for text, hit in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist()):
                if hit:
                    raw = text.encode()
                    at = [m.span() for m in word.finditer(raw.translate(_WORD))]
                    kept, done = [], 0
                    for s in hit:
                        kept.append(raw[done : at[s["first"]][0]])
                        done = at[s["end"] - 1][1]
                    text = b"".join([*kept, raw[done:]]).decode()
                out.append(text)
            yield batch.set_column(names.index("text"), "text", pa.array(out, batch.schema.field("text").type))

    return found.mapInArrow(freed(run), found.schema)


def merge_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
