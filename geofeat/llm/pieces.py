"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table.

A merge encoding has two properties. It is one exactly if each two neighbours, encoded together, stay as they are; so every prefix of a text
ends in one certain token, the last of its own encoding. The prefix table stores that token for each prefix: an automaton lists the tokens that
end at a place, and of these the one counts that is compatible with the last token of the prefix before it. The ids are then recovered from
the end backwards. Compatibility of a pair is decided by merging the two side by side, once a pair and worker.

Merges never cross from another sign into a word mark (no piece does), nor touch a sign that no piece holds; a text is therefore taken apart there, and each
distinct part is encoded once a worker. Caches are of bounded size, are emptied when full and never change a result.

Covered models: merge type, identity normalisation with a word mark before the text and blanks as word marks, byte fallback; others
are refused. Defined results. Null text: empty, only the end id. Empty text: the same. Null and repeated ids: rows of their own. Very long
texts: encoded whole. Empty table: no rows. Extra columns: ignored, but for those named in ``keep``.
"""

from __future__ import annotations

import codecs
import functools
import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofeat.llm.common import freed, require, slices

MARK = "▁"


def _one_by_one(error: UnicodeDecodeError):
    return "�", error.start + 1


codecs.register_error("geofeat-pieces", _one_by_one)


class PrefixTable:
    """Encoder and decoder of one model file. As a dictionary it maps a part of a text, word marks in place, to its ids (as bytes of uint16)."""

    SIZE = 500_000

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(k) for k in range(size)]
        special = [model.is_control(k) or model.is_unknown(k) or model.is_byte(k) for k in range(size)]
        self.ids = {names[k]: k for k in range(size) if not special[k]}
        self.rank = {p: -model.get_score(k) for p, k in self.ids.items()}
        self.bytes_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.eos, self.unk = model.eos_id(), model.unk_id()
        self._check(model, names, size)
        self.held = {c for p in self.ids for c in p}
        # Tokens are numbered as their ids; then come the signs that only longer pieces hold.
        self.names = names + sorted(self.held - set(self.ids))
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.names):
            if k >= size or not special[k]:
                self.automaton.add_word(p, (k, len(p)))
        self.automaton.make_automaton()
        # Pairs of signs within pieces: between others nothing ever merges.
        self.joints = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, tuple] = {}
        foreign = "".join(re.escape(c) for c in sorted(self.held))
        self.cut = re.compile(f"({MARK}*[^{MARK}]+|{MARK}+)")
        self.runs = re.compile(f"([{foreign}]+|[^{foreign}])")
        # What a token adds to a decoded text; control tokens add nothing.
        self.out = [b"" if model.is_control(k) else " ⁇ ".encode() if model.is_unknown(k) else names[k].replace(MARK, " ").encode() for k in range(size)]
        for b, k in enumerate(self.bytes_ids):
            self.out[k] = bytes([b])
        self.marked = [p.startswith(MARK) for p in names]
        self.silent = {k for k in range(size) if model.is_control(k)}

    def _check(self, model, names: list[str], size: int) -> None:
        if size > 1 << 16 or any(k == self.unk for k in self.bytes_ids):
            raise ValueError("a model with byte fallback and at most 65536 pieces is needed")
        if any(MARK in p.lstrip(MARK) or (p.count(MARK) > 1 and p.strip(MARK)) for p in self.ids) or any(model.is_unused(k) for k in range(size)):
            raise ValueError("a piece crosses into a word, or is unused")
        probe = " \ta  bé ﬁ "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model changes texts before it encodes them")

    def history(self, k: int) -> tuple[list[float], list[str], list[str], bool]:
        """How a token merges from its signs, alone: per state the rank of the next merge, its first part and its last; and whether it comes out whole.

        The best pair goes first, of equal ones the leftmost.
        """
        known = self.histories.get(k)
        if known is None:
            parts, ranks, firsts, lasts = list(self.names[k]), [], [], []
            while True:
                best = [self.rank.get(x + y, math.inf) for x, y in zip(parts, parts[1:])]
                rank = min(best, default=math.inf)
                ranks.append(rank)
                firsts.append(parts[0])
                lasts.append(parts[-1])
                if rank == math.inf:
                    break
                at = best.index(rank)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = self.histories[k] = (ranks, firsts, lasts, len(parts) == 1)
        return known

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens, merged together, stay as they are; ``left`` is -1 before a text's first token.

        Both merge as they do alone until the parts on either side of the border are the best pair.
        """
        if len(self.pairs) >= self.SIZE:
            self.pairs.clear()
        right_ranks, firsts, _, good = self.history(right)
        if left >= 0:
            left_ranks, _, lasts, whole = self.history(left)
            good, i, j = good and whole, 0, 0
            while good:
                across = self.rank.get(lasts[i] + firsts[j], math.inf)
                if across < left_ranks[i] and across <= right_ranks[j] and across < math.inf:
                    good = False
                elif left_ranks[i] == right_ranks[j] == math.inf:
                    break
                elif left_ranks[i] <= right_ranks[j]:
                    i += 1
                else:
                    j += 1
        self.pairs[left << 20 | right] = good
        return good

    def tokens(self, text: str) -> list[int]:
        """The tokens of a text of signs that pieces hold, by the table of prefixes."""
        last, pairs = [-1] + [None] * len(text), self.pairs
        for end, (token, length) in self.automaton.iter(text):
            if last[end + 1] is None:
                before = last[end + 1 - length]
                if before is not None:
                    good = pairs.get(before << 20 | token)
                    if self.fits(before, token) if good is None else good:
                        last[end + 1] = token
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= len(self.names[last[end]])
        return out[::-1]

    def part(self, text: str) -> bytes:
        """Ids of a part; signs without a piece of their own are bytes."""
        if self.held.issuperset(text):
            ids = self.tokens(text)
        else:
            ids = []
            for run in self.runs.findall(text):
                ids += self.tokens(run) if run[0] in self.held else [self.bytes_ids[b] for b in run.encode()]
        if ids and max(ids) >= len(self.out):
            ids = [j for k in ids for j in ([k] if k < len(self.out) else [self.bytes_ids[b] for b in self.names[k].encode()])]
        return array("H", ids).tobytes()


class Coder(dict):
    """Words after a blank to ids, with two generations of a cache: when the younger is full, the older goes."""

    def __init__(self, table: PrefixTable):
        self.table = table
        self.older: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if len(word) > 1 and not word[-1].isalnum() and word[-2:] not in self.table.joints:
                ids = self[word[:-1]] + self.start(word[-1])
            else:
                ids = self.table.part(MARK + word)
        if len(self) >= self.table.SIZE:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def start(self, word: str) -> bytes:
        """Ids of signs that no mark precedes, as at the start of a line."""
        ids = self.starts.get(word)
        if ids is None:
            if len(self.starts) >= self.table.SIZE // 4:
                self.starts.clear()
            ids = self.starts[word] = self.table.part(word)
        return ids

    def line(self, line: str, first: bool) -> bytes:
        """Ids of a line; a first one has a word mark before it."""
        words = line.split(" ")
        if "" in words or MARK in line:
            # Runs of blanks: they belong to the word after them.
            text = (MARK if first else "") + line.replace(" ", MARK)
            return b"".join([self[p[1:]] if p[0] == MARK else self.start(p) for p in self.table.cut.findall(text)])
        if first:
            return b"".join(map(self.__getitem__, words))
        return self.start(words[0]) + b"".join(map(self.__getitem__, words[1:]))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        lines = text.split("\n")
        return self.newline.join([self.line(x, k == 0) if x or k == 0 else b"" for k, x in enumerate(lines)])

    @functools.cached_property
    def newline(self) -> bytes:
        return self.table.part("\n")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the word mark that it begins with goes, bytes that are no UTF-8 become U+FFFD one by one."""
        ids = ids.tolist()
        text = b"".join(map(self.table.out.__getitem__, ids)).decode("utf-8", "geofeat-pieces")
        first = next((k for k in ids if k not in self.table.silent), None)
        return text[1:] if first is not None and self.table.marked[first] else text


@functools.lru_cache(maxsize=1)
def coder_of(path: str) -> Coder:
    """One coder a worker process and file: its caches serve all tasks of the worker."""
    return Coder(PrefixTable(path))


def encode(docs: DataFrame, path: str, end: bool = True, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """(kept columns, ids array<int>): the ids of each text, with the end id at last; with ``decoded`` also the text that the ids give."""
    coder_of(path)  # an unfit model fails here, not in tasks
    rows = docs.select(*[docs[c] for c in keep], docs["text"].alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = ", ".join(x for x in (kinds, "ids array<int>", "decoded string" if decoded else "") if x)

    def run(batches):
        coder = coder_of(path)
        last = np.array([coder.table.eos] if end else [], np.uint16).tobytes()
        for batch in batches:
            for piece in slices(batch, "__text", 4 << 20):
                coded = [np.frombuffer(coder.encode(t) + last, np.uint16) for t in piece.column("__text").fill_null("").to_pylist()]
                places = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(places, pa.array(np.concatenate(coded).astype(np.int32)))
                columns = [*piece.columns[:-1], ids] + ([pa.array([coder.decode(x) for x in coded], pa.string())] if decoded else [])
                yield pa.record_batch(columns, [*keep, "ids", *(["decoded"] if decoded else [])])

    return rows.mapInArrow(freed(run), schema)


def decode(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, text): the texts of ids (array<int>). Null or empty ids: empty; ids outside the model are an error."""
    rows = require(rows, *keep, "ids").withColumn("ids", F.col("ids").cast("array<int>"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        coder = coder_of(path)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(freed(run), f"{kinds}, text string")
