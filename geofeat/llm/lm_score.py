"""LM scoring by logistic context mixing.

A text is its words (ASCII case folded, parted at white space), each with a blank after it, and one end. It is scored bit by bit:

* hashed contexts hold counts of what followed: the last 2, 4 and 6 bytes of the text, across words, and the word so far. Their
  stretched predictions are summed with weights chosen by gates (bit place and longest context that leans to a side), and an adaptive
  probability map refines the sum. Counts come from all running text of the training documents, summed by Spark; a training text is
  left out of the counts that predict it, byte by byte;
* weights and map are learned online over blocks of about ``lesson_bytes`` of all training texts, each block from the same start, and averaged over the
  blocks by how often each gate was used. Nothing else teaches: a text is scored with what the
  training texts taught, so its score hangs on them and on itself alone, not on other texts, blocks or slices;
* while a text is scored, caches of its own words so far are mixed in with several shares, each growing with the words seen. How far each is trusted
  is learned online, within the text, from how well it has predicted so far, and forgotten after it;
* the longest hashed context is the whole line: given the line breaks, a line of ``line_words`` words or more is either spelled word by word
  or drawn from the training lines, in the part in which training lines repeat (a training text's own lines don't count for it).

Documents are dealt into blocks of about ``block_bytes``. A block meets only the words and lines that it holds: their counts are joined by
hash and come back to the block. Within a block equal contexts predict alike, so each distinct word with the bytes before it, and of these each
distinct pair of contexts and byte, is worked out once, in parts of bounded size. The mixer's tables are sent to each task; rows of a table follow the number of distinct words up to ``2**(SLOT_BITS - 4)`` a
context, beyond which contexts share rows, as in any hashed-context model of bounded memory.

Defined results. Null text: empty, only the end token. Null doc_id: counts as the empty text for the fold. Repeated rows: each on its own.
No training documents: counts are 0, nothing is known. Empty table: no rows. Extra columns: ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geofeat.llm.common import FOLD_SPACE, freed, give_back, materialize, mix64, require, signed, slices, utf8, words

ORDERS = (2, 4, 6)
#: One more context: the word so far.
CONTEXTS = len(ORDERS) + 1
#: Shares of the caches of a text's own words.
SHARES = (0.02, 0.1, 0.35)
#: A table has 2**SLOT_BITS cells at most, 16 a row: how often each half byte followed a context.
SLOT_BITS = 23
#: Counts up to EXACT are kept as they are, greater ones to the nearest of a geometric series that goes on beyond 10**14.
EXACT, RATIO = 32, 0.13
END = 10
STEP = 8192
SLICE = 1 << 20
#: Bytes of text whose equal contexts are worked out together.
TOGETHER = 24 << 20
#: Neighbours that learn in one step.
RUN = 64
_REGION = 1 << 15
_GRID = 4096
_K = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MORE = np.uint64(0xC2B2AE3D27D4EB4F)
_NAMES = np.arange(1, max(ORDERS) + 2, dtype=np.uint64) * _STEP
_BIT = np.arange(4)[:, None]
_DOWN = 4 - _BIT
_CODED = np.concatenate([np.arange(EXACT + 1), EXACT * np.exp(RATIO * np.arange(1, 256 - EXACT))])


def running_text(folded: np.ndarray, off: np.ndarray):
    """(bytes, text of each byte, unit of each byte, first byte of each unit); units are the words, and after each text's words its end."""
    n = len(off) - 1
    wide = np.empty(len(folded) + 2 * n, np.uint8)
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        wide[a + 2 * k : b + 2 * k] = folded[a:b]
        wide[b + 2 * k], wide[b + 2 * k + 1] = 32, END
    ends = wide == END
    word = (wide != 32) & ~ends
    keep = word | ends
    keep[1:] |= word[:-1]
    text = wide[keep]
    ends = text == END
    begin = np.concatenate([[True], ends[:-1] | (text[:-1] == 32)])
    doc = np.cumsum(ends, dtype=np.int32) - ends
    return text, doc, np.cumsum(begin, dtype=np.int32) - 1, np.flatnonzero(begin)


def histories(text: np.ndarray, doc: np.ndarray, unit: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Before each byte: the eight bytes of its text before it (the last one highest), and a hash of its unit so far."""
    padded = np.concatenate([np.zeros(8, np.uint8), text, np.zeros(8, np.uint8)])
    before = np.ndarray(len(text), "<u8", padded, 0, (1,)).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    for k in range(8):
        at = first + k
        before[at[at < len(text)]] &= np.uint64((0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF)
    inner = np.arange(len(text), dtype=np.int32) - start.astype(np.int32)[unit]
    place = mix64((np.arange(int(inner.max()) + 1, dtype=np.uint64) + np.uint64(1)) * _STEP)
    spread = place[inner]
    spread *= text.astype(np.uint64) + np.uint64(1)
    sums = np.cumsum(spread) - spread
    return before, sums - sums[start][unit]


def run_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes (none empty), eight bytes at a time."""
    if not len(start):
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    many = (size + 7) >> 3
    first = np.cumsum(many) - many
    turn = np.arange(int(many.sum())) - np.repeat(first, many)
    part = eight[np.repeat(start, many) + 8 * turn].astype(np.uint64)
    part[first + many - 1] &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 * many - size)).astype(np.uint64)
    part += mix64((np.arange(int(many.max()), dtype=np.uint64) + np.uint64(1)) * _MORE)[turn]
    return mix64(np.add.reduceat(mix64(part), first) + size.astype(np.uint64))


def distinct(before: np.ndarray, so_far: np.ndarray, text: np.ndarray, own: np.ndarray):
    """(one place, count) of each distinct pair of contexts and byte, and which of them each byte is. Exact up to 64-bit hashes."""
    key = before >> np.uint64(16)
    key *= _K
    key += so_far * _MORE
    key += ((text >> 4).astype(np.uint16) * 2 + own) * _STEP
    key ^= key >> np.uint64(29)
    key *= _K
    n = len(key)
    low = np.uint64((1 << n.bit_length()) - 1)
    last = (text & 15).astype(np.uint64)
    # In the order of the last three bytes, so that contexts that share rows of the tables come one after another; then of the contexts' hash with the
    # first half byte, which is worked out once where these are equal; then of the last half byte.
    packed = key >> np.uint64(24)
    packed |= before & np.uint64(0xFFFFFF0000000000)
    packed &= ~((low << np.uint64(4)) | np.uint64(15))
    packed |= last << np.uint64(n.bit_length())
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    packed &= low
    at = packed.view(np.int64)
    key += last
    key = key[at]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    which = np.empty(n, np.int32)
    which[at] = np.cumsum(new, dtype=np.int32) - 1
    new = np.flatnonzero(new)
    return at[new], np.diff(np.append(new, n)), which


def contexts_of(before: np.ndarray, so_far: np.ndarray) -> list[np.ndarray]:
    """Per context its hash."""
    return [(before >> np.uint64(64 - 8 * n)) * _K + _NAMES[n] for n in ORDERS] + [so_far * _K + _NAMES[0]]


def _rows(context: np.ndarray, node, bits: int) -> np.ndarray:
    h = context + node * _STEP
    h ^= h >> np.uint64(32)
    h *= _K
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def row_bits(types: int) -> int:
    """Rows of a table, as a power of two: as many as distinct words, within what a task's memory holds."""
    return min(SLOT_BITS - 4, max(12, int(types).bit_length()))


def code(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each: exact when small, the nearest of the series otherwise."""
    large = EXACT + np.rint(np.log(np.maximum(counts, EXACT) / EXACT) / RATIO)
    return np.where(counts <= EXACT, counts, np.minimum(large, 255)).astype(np.uint8)


def coded(cells: np.ndarray) -> np.ndarray:
    """Rows of 16 counts as rows of 16 pairs: at place p (1 to 15 of the tree over a half byte's bits) the codes of how often each bit followed."""
    tree = np.zeros((len(cells), 32), np.int64)
    tree[:, 16:] = cells
    for p in range(15, 0, -1):
        tree[:, p] = tree[:, 2 * p] + tree[:, 2 * p + 1]
    tree[:, 0] = tree[:, 1] = 0
    c = code(tree).astype(np.uint16)
    return c[:, 0::2] | c[:, 1::2] << np.uint16(8)


def _stretches() -> np.ndarray:
    """ln of the odds of bit 1 for each pair of codes: as counted, less one occurrence of bit 0, and less one of bit 1."""
    zero, one = _CODED[None, :], _CODED[:, None]
    less = lambda c: np.maximum(c - 1, 0)
    return np.stack([np.log(b + 0.4) - np.log(a + 0.4) for a, b in ((zero, one), (less(zero), one), (zero, less(one)))]).astype(np.float32).reshape(-1)


class Mixer:
    """Coded counts of each context, and the weights (bit places, gates, inputs) and refining map: those in use, and those being learned."""

    RATE, REST, SHARE = 0.3, 300, 0.5

    def __init__(self, table: np.ndarray):
        """``table``: contexts x rows x 16 pairs of codes."""
        self.n, self.bits = len(table), int(table.shape[1]).bit_length() - 1
        self.table = table.reshape(-1)
        self.stretch = _stretches()
        self.reset()
        self.use(None)

    def __getstate__(self) -> dict:
        """On its way to tasks the table, which is mostly zeros, is packed."""
        return {"n": self.n, "bits": self.bits, "table": zlib.compress(self.table.tobytes(), 1)}

    def __setstate__(self, state: dict) -> None:
        table = np.frombuffer(zlib.decompress(state["table"]), np.uint16)
        self.__init__(table.reshape(state["n"], 1 << state["bits"], 16))

    def reset(self) -> None:
        """Begin to learn: first weights, nothing seen."""
        self.weights = np.full((8, self.n + 1, self.n + 1), 0.3, np.float32)
        self.weights[:, :, -1] = 0
        self.seen = np.zeros((8, self.n + 1, 1))
        self.counts = np.zeros((8, self.n + 1, 33, 2))

    def learned(self) -> np.ndarray:
        """What has been learned since ``reset``, in a form whose sums over blocks ``use`` takes: weights by their use, its number, and the map's counts."""
        return np.concatenate([(self.weights * self.seen).ravel(), self.seen.ravel(), self.counts.ravel()])

    def use(self, sums: np.ndarray | None) -> None:
        """From now on score with summed lessons (None: first weights, map at rest): weights, and log10 of each bit's probability over a grid of sums."""
        self.used = np.full((8, self.n + 1, self.n + 1), 0.3)
        self.used[:, :, -1] = 0
        rest = 1 / (1 + np.exp(-np.linspace(-8, 8, 33)))
        table = np.tile(rest, (8, self.n + 1, 1))
        if sums is not None:
            weights, seen, counts = np.split(sums, np.cumsum([self.used.size, self.seen.size]))
            seen, counts = seen.reshape(self.seen.shape), counts.reshape(self.counts.shape)
            self.used = np.where(seen > 0, weights.reshape(self.used.shape) / np.maximum(seen, 1), self.used).round(6)
            table = (counts[..., 1] + self.REST * rest) / (counts.sum(-1) + self.REST)
        self.used = self.used.astype(np.float32)
        z = (np.arange(_GRID) + 0.5) * (16 / _GRID) - 8
        near, part = np.divmod((z + 8) * 2, 1)
        near = near.astype(np.int64)
        refined = table[:, :, near] * (1 - part) + table[:, :, near + 1] * part
        p = np.clip((1 - self.SHARE) / (1 + np.exp(-z)) + self.SHARE * refined, 1e-6, 1 - 1e-6)
        self.bits_log10 = np.log10(np.stack([1 - p, p], 1)).astype(np.float32).reshape(-1)

    def _inputs(self, half: int, text: np.ndarray, contexts: list[np.ndarray], own: np.ndarray):
        """The first bit place of a half byte; of its four: the bits, the contexts' stretches (and a last row of ones), and the gates."""
        nibble = (text >> 4 if half == 0 else text & 15).astype(np.int64)
        node = np.zeros(1, np.uint64) if half == 0 else (text >> 4).astype(np.uint64) + np.uint64(1)
        path, bits = (16 + nibble) >> _DOWN, (nibble >> (_DOWN - 1)) & 1
        less = own * (1 + bits) << 16
        x = np.ones((4, self.n + 1, len(text)), np.float32)
        gates = np.zeros(bits.shape, np.int64)
        for c, context in enumerate(contexts):
            base = (_rows(context, node, self.bits) + (c << self.bits)) << 4
            np.take(self.stretch, self.table.take(base + path) + less, out=x[:, c], mode="clip")
            np.copyto(gates, c + 1, where=x[:, c] != 0)
        return 4 * half, bits, x, gates

    def _learn(self, k: int, bit: np.ndarray, x: np.ndarray, gate: np.ndarray, z: np.ndarray, times: np.ndarray) -> None:
        error = (bit.astype(np.float32) - 1 / (1 + np.exp(-z))) * times
        chosen = (gate.astype(np.uint8) == np.arange(self.n + 1, dtype=np.uint8)[:, None]).astype(np.float32)
        many = (chosen @ times)[:, None]
        self.weights[k] += self.RATE * (chosen @ (x * error).T) / np.maximum(many, 256)
        self.seen[k] += many
        cell = gate * 33 + ((z + np.float32(8.25)) * 2).astype(np.int64)
        self.counts[k] += np.bincount(2 * cell + bit, times, minlength=self.counts[k].size).reshape(self.counts[k].shape)

    def log10(self, text, contexts, own) -> np.ndarray:
        """log10 of each byte's probability."""
        out = np.zeros(len(text), np.float32)
        for a in range(0, len(text), STEP):
            part = slice(a, a + STEP)
            for k, first, bits, x, gates, mine in self._steps(text[part], [c[part] for c in contexts], own[part].astype(np.int64)):
                z = np.clip((self.used[k : k + 4] @ x).take(mine) + np.float32(8), 0, np.float32(15.998))
                cell = (z * np.float32(_GRID / 16)).astype(np.int64)
                cell += (((k + _BIT) * 2 + bits) * (self.n + 1) + gates) * _GRID
                got = self.bits_log10.take(cell).sum(0)
                out[part] += got if first is None else np.repeat(got, np.diff(np.append(first, len(out[part]))))
        return out

    def learn(self, text, contexts, own, times) -> None:
        """Learn from bytes that occur ``times`` times each. A step takes short runs from all over them, so that each step's bytes are a mixture of all."""
        runs = -(-len(text) // RUN)
        steps = -(-len(text) // STEP)
        for s in range(steps):
            part = (np.arange(s, runs, steps)[:, None] * RUN + np.arange(RUN)).ravel()
            part = part[part < len(text)]
            often = times[part].astype(np.float32)
            for k, first, bits, x, gates, mine in self._steps(text[part], [c[part] for c in contexts], own[part].astype(np.int64)):
                z = np.clip((self.weights[k : k + 4] @ x).take(mine), -8, 8)
                many = often if first is None else np.add.reduceat(often, first)
                for j in range(4):
                    self._learn(k + j, bits[j], x[j], gates[j], z[j], many)

    def _steps(self, text, contexts, own):
        """Per half byte: first bit place, which bytes stand for those that follow them (None: each for itself), and inputs; equal first halves go together."""
        new = np.concatenate([[True], (text[1:] ^ text[:-1]) > 15])
        for c in (own, *contexts):
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        for half, chosen in ((0, first), (1, None)):
            if chosen is None:
                k, bits, x, gates = self._inputs(half, text, contexts, own)
            else:
                k, bits, x, gates = self._inputs(half, text[first], [c[first] for c in contexts], own[first])
            # The sums of all gates at once; each byte takes its own gate's.
            n = bits.shape[1]
            yield k, chosen, bits, x, gates, (_BIT * (self.n + 1) + gates) * n + np.arange(n)

    def units(self, pieces) -> list[np.ndarray]:
        """The score of each unit of the texts of each piece (folded bytes, offsets, and which texts the counts hold)."""
        units = Units(pieces)
        scores = np.empty(len(units.at))
        for part, first, alike, which in units.alike():
            got = self.log10(alike.text, alike.contexts(), alike.own)
            scores[part] = np.add.reduceat(got[which], first, dtype=np.float64)
        return np.split(scores[units.which], np.cumsum(units.counts)[:-1])


class Alike:
    """Distinct pairs of contexts and byte: the byte, the eight bytes before it, its unit's hash so far, own or not, and how often they occur."""

    def __init__(self, before, so_far, text, own, times):
        self.before, self.so_far, self.text, self.own, self.times = before, so_far, text, own, times

    def contexts(self) -> list[np.ndarray]:
        return contexts_of(self.before, self.so_far)

    def merged(self) -> tuple[Alike, np.ndarray]:
        """Without repetition, and which of these each one was."""
        at, _, which = distinct(self.before, self.so_far, self.text, self.own)
        return Alike(self.before[at], self.so_far[at], self.text[at], self.own[at], np.bincount(which, self.times, minlength=len(at)).astype(np.float32)), which


class Units:
    """The units of all pieces (folded bytes, offsets, and which texts the counts hold), each distinct one once.

    Units are alike if their bytes, the bytes before them that contexts reach and ``own`` are; exact up to 64-bit hashes. ``at`` and ``size`` tell
    where the distinct ones lie in ``text``, in which eight zero bytes come before each text; ``times`` how often each occurs, and ``which`` of
    them each unit of the pieces is. They go by the bytes they begin with: units with equal pairs of contexts and byte begin alike, so that few
    pairs lie in two parts.
    """

    def __init__(self, pieces):
        texts, starts, sizes, keys, owns, self.counts = [], [], [], [], [], []
        base = 0
        for folded, off, own in pieces:
            text, doc, _, start = running_text(folded, off)
            padded = np.zeros(len(text) + 8 * len(own), np.uint8)
            ends = np.flatnonzero(text == END) + 1
            for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                padded[a + 8 * k + 8 : b + 8 * k + 8] = text[a:b]
            size = np.diff(np.append(start, len(text)))
            of = doc[start]
            start = start + 8 * (of + np.int64(1))
            keys.append(_unit_keys(padded, start, size, own[of]))
            texts.append(padded)
            starts.append((start + base).astype(np.uint32))
            sizes.append(size.astype(np.int32))
            owns.append(own[of])
            self.counts.append(len(start))
            base += len(padded)
        texts.append(np.zeros(8, np.uint8))  # eight bytes are read from any place
        self.text = np.concatenate(texts)
        del texts
        key = np.concatenate([*keys, np.zeros(0, np.uint64)])
        del keys
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        del key
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(order))).astype(np.int32)
        unit = order[first]
        at = np.concatenate([*starts, np.zeros(0, np.uint32)])[unit]
        del starts, first
        by = np.argsort(self._eight()[at].astype(np.uint64).byteswap())
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        self.which = np.empty(len(order), np.int32)
        self.which[order] = place[np.cumsum(new, dtype=np.int32) - 1]
        self.at, self.times, unit = at[by], times[by], unit[by]
        self.size = np.concatenate([*sizes, np.zeros(0, np.int32)])[unit]
        self.own = np.concatenate([*owns, np.zeros(0, bool)])[unit]

    def _eight(self) -> np.ndarray:
        """The eight bytes from each place of the text on."""
        return np.ndarray(len(self.text) - 7, "<u8", self.text, 0, (1,))

    def spelled(self, limit: int = 1 << 19):
        """(range of distinct units, the first byte of each, bytes before each of their bytes, hash of the unit so far, byte, own, times), by parts of
        at most ``limit`` bytes or one longer unit."""
        total = np.concatenate([[0], np.cumsum(self.size, dtype=np.int64)])
        longest = int(self.size.max()) if len(self.size) else 0
        place = mix64((np.arange(longest, dtype=np.uint64) + np.uint64(1)) * _STEP)
        eight = self._eight()
        a = 0
        while a < len(self.at):
            b = max(a + 1, int(np.searchsorted(total, total[a] + limit, "right")) - 1)
            size = self.size[a:b]
            first = total[a:b] - total[a]
            inner = np.arange(total[b] - total[a]) - np.repeat(first, size)
            at = inner + np.repeat(self.at[a:b].astype(np.int64), size)
            text, before = self.text[at], eight[at - 8].astype(np.uint64)
            spread = place[inner]
            spread *= text.astype(np.uint64) + np.uint64(1)
            sums = np.cumsum(spread)
            sums -= spread
            sums -= np.repeat(sums[first], size)
            yield slice(a, b), first, before, sums, text, np.repeat(self.own[a:b], size), np.repeat(self.times[a:b], size)
            a = b

    def alike(self):
        """By parts: range of distinct units, the first byte of each, distinct pairs of contexts and byte, and which of them each byte is."""
        for part, first, *columns in self.spelled():
            yield part, first, *Alike(*columns).merged()


def _unit_keys(text: np.ndarray, start: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A hash of each unit, of what contexts see before it (``start`` is 8 or more), and of ``own``."""
    before = np.ndarray(len(text) - 7, "<u8", text, 0, (1,))[start - 8].astype(np.uint64)
    return mix64(run_hashes(text, start, size) * _K + mix64((before >> np.uint64(16)) + _STEP * (own + np.uint64(1))))


def gathered(pieces) -> tuple[Alike, list[int]]:
    """The distinct pairs of contexts and byte of all pieces, and each piece's number of units."""
    units = Units(pieces)
    parts = [a for _, _, a, _ in units.alike()] or [Alike(*(np.zeros(0, d) for d in (np.uint64, np.uint64, np.uint8, bool, np.float32)))]
    counts = units.counts
    del units
    columns = []
    for c in ("before", "so_far", "text", "own", "times"):
        columns.append(np.concatenate([getattr(p, c) for p in parts]))
        for p in parts:
            delattr(p, c)  # a column is held once
    return Alike(*columns), counts


def together(pieces: list[pa.RecordBatch]):
    """Neighbouring pieces, up to ``TOGETHER`` bytes of text or one longer piece at a time."""
    group, held = [], 0
    for p in pieces:
        n = int(utf8(p.column("text"))[0][-1])
        if group and held + n > TOGETHER:
            yield group
            group, held = [], 0
        group.append(p)
        held += n
    if group:
        yield group


def line_hashes(data: np.ndarray, off: np.ndarray, starts: np.ndarray, h: np.ndarray, first: np.ndarray):
    """(hash, word count) of each run of words without a line break or text end between, and the run of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.concatenate([[True], breaks[1:] != breaks[:-1]])
    new[first[:-1][first[:-1] < len(starts)]] = True
    line = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    place = (np.arange(len(starts)) - begin[line]).astype(np.uint64)
    return mix64(np.add.reduceat(mix64(h + place * _K), begin)), np.diff(np.append(begin, len(starts))), line


def _distinct(docs: DataFrame, line_words: int) -> DataFrame:
    """(kind, h, n): the hash of every word (kind 0) and longer line (kind 1) of every document, and its count in training documents."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                off, data = utf8(piece.column("text"))
                folded = FOLD_SPACE[data]
                starts, lengths, first = words(off, folded)
                h = run_hashes(folded, starts, lengths)
                train = np.repeat(~piece.column("held_out").to_numpy(zero_copy_only=False), np.diff(first))
                lh, many, _ = line_hashes(data, off, starts, h, first)
                long = many >= line_words
                for kind, x, t in ((0, h, train), (1, lh[long], train[(np.cumsum(many) - many)[long]])):
                    x, inverse = np.unique(x, return_inverse=True)
                    n = np.bincount(inverse, t, minlength=len(x)).astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(x), kind, np.int32)), pa.array(signed(x)), pa.array(n)], ["kind", "h", "n"])

    return docs.mapInArrow(freed(run), "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))


def _summed(table: pa.Table) -> np.ndarray:
    total = np.zeros(_REGION, np.int64)
    for cells in table.column("cells"):
        part = np.frombuffer(zlib.decompress(cells.as_py()), np.int64)
        total[: len(part)] += part
    return total


def _region(table: pa.Table, cells: np.ndarray) -> pa.Table:
    return pa.table([table.column("o").slice(0, 1), table.column("r").slice(0, 1), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], ["o", "r", "cells"])


def _table_counts(docs: DataFrame, n_bytes: int, bits: int, task_bytes: int = 64 << 20) -> np.ndarray:
    """The mixer's coded counts over the running text of all training documents: summed in tasks, then by region of the tables."""
    cells = 16 << bits

    def run(batches):
        sums = None
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                off, data = utf8(piece.column("text"))
                text, doc, unit, start = running_text(FOLD_SPACE[data], off)
                before, so_far = histories(text, doc, unit, start)
                at, times, _ = distinct(before, so_far, text, np.zeros(len(text), bool))
                text, times = text[at], times.astype(np.uint32)
                sums = np.zeros((CONTEXTS, cells), np.uint32) if sums is None else sums
                high = (text >> 4).astype(np.int64)
                for o, c in enumerate(contexts_of(before[at], so_far[at])):
                    np.add.at(sums[o], (_rows(c, np.zeros(1, np.uint64), bits) << 4) + high, times)
                    np.add.at(sums[o], (_rows(c, high.astype(np.uint64) + np.uint64(1), bits) << 4) + (text & 15), times)
        if sums is not None:
            for o in range(CONTEXTS):
                for r in range(0, cells, _REGION):
                    part = sums[o, r : r + _REGION]
                    if part.any():
                        packed = zlib.compress(part.astype(np.int64).tobytes(), 1)
                        yield pa.record_batch([pa.array([o], pa.int32()), pa.array([r], pa.int32()), pa.array([packed], pa.binary())], ["o", "r", "cells"])

    # Each task sends one row a region at most; a region is summed from as many rows as there are tasks, 32 tasks at a time first.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // task_bytes))
    made = docs.filter(~F.col("held_out")).select("text").coalesce(tasks).mapInArrow(freed(run), "o int, r int, cells binary")
    salted = made.withColumn("salt", F.floor(F.spark_partition_id() / 32)).groupBy("o", "r", "salt")
    halfway = salted.applyInArrow(lambda t: _region(t, _summed(t)), "o int, r int, cells binary")
    whole = halfway.groupBy("o", "r").applyInArrow(lambda t: _region(t, coded(_summed(t).reshape(-1, 16))), "o int, r int, cells binary")
    counts = np.zeros((CONTEXTS, cells), np.uint16)
    for row in whole.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["cells"]), np.uint16)
        counts[row["o"], row["r"] : row["r"] + _REGION] = part[: cells - row["r"]]
    return counts.reshape(CONTEXTS, -1, 16)


def _lessons(docs: DataFrame, told, lesson_bytes: int) -> np.ndarray | None:
    """The sum of what the mixer learns from blocks of all training texts; None where there is none. One short row a block is summed in two steps."""
    chosen = docs.filter(~F.col("held_out") & (F.octet_length("text") > 0))
    n = max(1, -(-chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0] // lesson_bytes))
    dealt = chosen.select("text", F.pmod(F.xxhash64("text", "doc_id"), F.lit(n)).alias("block"), F.xxhash64("doc_id", "text").alias("turn"))

    def run(key, t):
        mixer = told.value
        mixer.reset()
        for batch in t.sort_by("turn").combine_chunks().to_batches():
            for pieces in together(list(slices(batch, "text", SLICE))):
                alike, _ = gathered((FOLD_SPACE[data], off, np.ones(len(off) - 1, bool)) for off, data in (utf8(p.column("text")) for p in pieces))
                mixer.learn(alike.text, alike.contexts(), alike.own, alike.times)
                del alike
        give_back()
        return pa.table([pa.array([key[0].as_py() % 64], pa.int64()), pa.array([mixer.learned().tobytes()], pa.binary())], ["share", "sums"])

    def added(key, t):
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in t.column("sums"))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["share", "sums"])

    sums = dealt.groupBy("block").applyInArrow(run, "share long, sums binary").groupBy("share").applyInArrow(added, "share long, sums binary")
    rows = sums.collect()  # 64 at most
    return sum(np.frombuffer(r["sums"], np.float64) for r in sorted(rows, key=lambda r: bytes(r["sums"]))) if rows else None


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums of a text's words before each word (columns)."""
    sums = np.cumsum(values, axis=1) - values
    size = np.diff(first)
    start = np.zeros((len(values), len(size)))
    some = size > 0
    start[:, some] = sums[:, first[:-1][some]]
    return sums - np.repeat(start, size, axis=1)


def _mixed(logs: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """ln of the mean of several predictions (rows of ``logs``), each weighted by e to its ``trust``."""
    total = lambda x: np.log(np.exp(x - (top := x.max(axis=0))).sum(axis=0)) + top
    return total(logs + trust) - total(trust)


def with_caches(spelled: np.ndarray, ends: np.ndarray, before: np.ndarray, turn: np.ndarray, first: np.ndarray, cache_words: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each word and of each text's end, from the mixer's log10 and the text's own words.

    ``before`` tells how often a word came before in its text, ``turn`` how many words did. Each share of ``SHARES`` is one predictor; they are
    weighted by what they gave to the text's words so far, all alike at its start.
    """
    shares = np.array(SHARES)[:, None]
    held = shares * turn / (turn + cache_words)
    logs = np.log((1 - held) * np.maximum(10.0**spelled, 1e-300) + held * before / np.maximum(turn, 1))
    trust = _by_text(logs, first)
    size = np.diff(first)
    total = np.zeros((len(shares), len(size)))
    some = size > 0
    last = first[1:][some] - 1
    total[:, some] = trust[:, last] + logs[:, last]
    end = np.log(1 - shares * size / (size + cache_words)) + ends * math.log(10)
    return _mixed(logs, trust) / math.log(10), _mixed(end, total) / math.log(10)


def score(docs: DataFrame, held_out, block_bytes: int = 16 << 20, lesson_bytes: int = 16 << 20, cache_words: float = 100.0, line_words: int = 4) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    docs = require(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out.alias("held_out"))
    kind = dict(docs.dtypes)["doc_id"]
    sizes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))).head()
    n_blocks, trained = max(1, -(-sizes[0] // block_bytes)), sizes[1]
    counted = materialize(_distinct(docs, line_words), "counts")
    vocabulary, lines = counted.filter("kind = 0"), counted.filter("kind = 1 and n > 0")
    n_lines, again = lines.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))).head()
    repeat = min(0.9, max(0.01, again / n_lines)) if n_lines else 0.01
    stats = vocabulary.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    total, types = stats[0] + trained, stats[1] + (trained > 0)
    told = spark.sparkContext.broadcast(Mixer(_table_counts(docs, sizes[0], row_bits(stats[1]))))
    lessons = _lessons(docs, told, lesson_bytes)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block")
    dealt = docs.select("doc_id", "text", "held_out", block).repartition(n_blocks, "block")

    def held(batches):
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for piece in slices(batch, "text"):
                off, data = utf8(piece.column("text"))
                folded = FOLD_SPACE[data]
                starts, lengths, at = words(off, folded)
                h, of = run_hashes(folded, starts, lengths), np.repeat(piece.column("block").to_numpy(), np.diff(at))
                lh, many, line = line_hashes(data, off, starts, h, at)
                of_line = of[np.cumsum(many) - 1] if len(many) else of[:0]
                for b in np.unique(of).tolist():
                    for kind_, x in ((0, h[of == b]), (1, lh[(of_line == b) & (many >= line_words)])):
                        seen.setdefault((b, kind_), []).append(np.unique(x))
        for (b, kind_), parts in seen.items():
            h = np.unique(np.concatenate(parts))
            yield pa.record_batch([pa.array(np.full(len(h), b)), pa.array(np.full(len(h), kind_, np.int32)), pa.array(signed(h))], ["block", "kind", "h"])

    looked_up = vocabulary.unionByName(lines)
    needed = dealt.mapInArrow(freed(held), "block long, kind int, h long").join(looked_up, ["kind", "h"]).select("block", "kind", "h", "n")
    unit = total + types + 1
    end_known = int(trained > 0)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, order = right.column("kind").to_numpy(), np.argsort(right.column("h").to_numpy())
        order, of_lines = order[kinds[order] == 0], order[kinds[order] == 1]
        h, n = (right.column(c).to_numpy()[order] for c in ("h", "n"))
        line_h, line_n = (right.column(c).to_numpy()[of_lines] for c in ("h", "n"))
        out, mixer = [], told.value
        mixer.use(lessons)
        pieces = [p for batch in left.combine_chunks().to_batches() for p in slices(batch, "text", SLICE)]

        def scored():
            for part in together(pieces):
                own = [~p.column("held_out").to_numpy(zero_copy_only=False) for p in part]
                folded = ((FOLD_SPACE[data], off, o) for (off, data), o in zip((utf8(p.column("text")) for p in part), own))
                yield from zip(part, own, mixer.units(folded))

        for piece, mine, spelled in scored():
            off, data = utf8(piece.column("text"))
            folded = FOLD_SPACE[data]
            starts, lengths, first = words(off, folded)
            hashes = run_hashes(folded, starts, lengths)
            known, of = np.unique(signed(hashes), return_inverse=True)
            at = np.searchsorted(h, known)[of]
            size = np.diff(first)
            doc = np.repeat(np.arange(len(size)), size)
            turn = np.arange(len(at)) - np.repeat(first[:-1], size)
            key = doc * (len(h) + 1) + at
            sort = np.argsort(key, kind="stable")
            new = np.concatenate([[True], key[sort][1:] != key[sort][:-1]]) if len(sort) else np.zeros(0, bool)
            place = np.arange(len(sort))
            before = np.empty(len(sort), np.int64)
            before[sort] = place - np.maximum.accumulate(np.where(new, place, 0)) if len(sort) else 0
            by_word, by_end = with_caches(spelled[np.arange(len(starts)) + doc], spelled[first[1:] + np.arange(len(size))], before, turn, first, cache_words)
            add = lambda v: np.bincount(doc, v, minlength=len(size)) if len(v) else np.zeros(len(size))
            base = add(np.log10((n[at] + 1) / unit)) + math.log10((trained + 1) / unit)
            lh, many, line = line_hashes(data, off, starts, hashes, first)
            by_line = np.bincount(line, by_word, minlength=len(many)) if len(many) else np.zeros(0)
            of_line = doc[np.cumsum(many) - 1] if len(many) else doc[:0]
            if len(line_h) and len(many):
                place = np.minimum(np.searchsorted(line_h, signed(lh)), len(line_h) - 1)
                seen = np.where((line_h[place] == signed(lh)) & (many >= line_words), line_n[place], 0).astype(float)
                _, same, times = np.unique(np.stack([of_line.astype(np.uint64), lh]), axis=1, return_inverse=True, return_counts=True)
                seen -= np.where(mine[of_line] & (many >= line_words), times[same.ravel()], 0)
                spelled_out = by_line + np.where(many >= line_words, math.log10(1 - repeat), 0)
                drawn = np.log10(np.maximum(repeat * seen / max(n_lines, 1), 1e-300))
                by_line = np.where(seen > 0, np.logaddexp(spelled_out * math.log(10), drawn * math.log(10)) / math.log(10), spelled_out)
            total_score = np.bincount(of_line, by_line, minlength=len(size)) + by_end
            count = add((n[at] > 0).astype(float)).astype(np.int64) + end_known
            length = np.maximum(np.diff(off), 1)
            out.append(
                pa.table(
                    [piece.column("doc_id"), piece.column("held_out"), pa.array(size + 1, pa.int64()), pa.array(count), pa.array(np.full(len(size), total), pa.int64()), pa.array(base), pa.array(total_score), pa.array(-total_score / math.log10(2) / length)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
                )
            )
        give_back()
        schema = pa.schema([("doc_id", left.schema.field("doc_id").type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    both = dealt.groupBy("block").cogroup(needed.groupBy("block"))
    return both.applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
