"""Token-ID / binary output: Arrow files of fixed-size-list batches.

Documents are range-partitioned by id, encoded, and packed one after another into sequences of equal length.
A shard (one partition) is one Arrow IPC file whose record batches hold ``ids`` (fixed-size list of uint16, or of uint32 for larger
vocabularies) and ``mask`` (fixed-size list of bits: token or padding), so that sequence k of a shard is row k % rows of batch k // rows, and is
read without a copy through a memory map. A second small file lists (doc_id, start, n_tokens) of the shard.

Defined results. Null text: empty, only the end id. Null doc_id: sorted first. Repeated doc_ids: all kept, ordered by a hash of
the text; equal rows are interchangeable. Empty table: no files, no rows. Extra columns: ignored. Very long texts: encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geofeat.llm.common import freed, materialize, require, scratch_path, slices

MANIFEST = "shard int, ids_path string, docs_path string, n_docs long, n_ids long, n_sequences long"


def plain_byte_level(path: str) -> bool:
    """Whether a tokenizer file is one that ``UnitEncoder`` may take apart: byte-level, with nothing before, around or after it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    wanted = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    after = (spec.get("post_processor") or {"type": "ByteLevel"}).get("type") == "ByteLevel"  # touches offsets only
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    added = any(t.get(k) for t in spec.get("added_tokens") or () for k in ("lstrip", "rstrip", "normalized", "single_word"))
    cut = spec.get("truncation") or spec.get("padding")
    return wanted and after and spec.get("normalizer") is None and model.get("type") == "BPE" and not odd and not added and not cut


class UnitEncoder(dict):
    """A tokenizers-library encoder that meets each distinct blank-separated piece once a task.

    Files other than ``plain_byte_level`` ones are not taken apart: each text is encoded whole by the library. The byte-level pre-tokenizer always breaks before a blank that is followed by a non-blank, so ids of a text are those of
    its pieces in order: ``self[piece]`` is the ids of the piece after a blank. Pieces for which this does not hold (a blank next to
    other white space) and texts with an added token are encoded whole. The dictionary is a cache of bounded size; it is
    emptied when full and never changes a result.
    """

    SIZE = 800_000

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.apart = plain_byte_level(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.id_bytes = [k.to_bytes(self.dtype.itemsize, "little") for k in range(size)]
        # The pattern of the byte-level pre-tokenizer.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        # Byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.alphabet = [chr(b if b in shown else next(rest)) for b in range(256)]
        self.signs = {chr(c): self.part(chr(c)) for c in range(0x250)} if self.apart else {}
        self.starts: dict[str, bytes] = {}  # words at the start of a line

    def part(self, part: str) -> bytes:
        """Ids of one piece of the pre-tokenizer, from the library's model."""
        ids = self.id_bytes
        return b"".join([ids[t.id] for t in self.tokenize("".join(map(self.alphabet.__getitem__, part.encode())))])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def __missing__(self, unit: str) -> bytes | None:
        """Letters, or letters and one other sign, need no pattern; beyond the Latin blocks the pattern decides."""
        if not unit or unit[0].isspace():
            return None
        if unit.isascii() or max(unit) < "\u0250":
            if unit.isalpha():
                return self.keep(unit, self.part(" " + unit))
            if unit[:-1].isalpha() and not unit[-1].isspace():
                return self[unit[:-1]] + self.signs[unit[-1]]
            head, line, tail = unit.partition("\n")
            if tail.isalpha() and not head[-1].isspace():
                ids = self.starts.get(tail)
                if ids is None:
                    if len(self.starts) >= self.SIZE // 8:
                        self.starts.clear()
                    ids = self.starts[tail] = self.part(tail)
                return self[head] + self.signs[line] + ids
        return self.keep(unit, b"".join(map(self.part, self.split(" " + unit))))

    def keep(self, unit: str, ids: bytes) -> bytes:
        if len(self) >= self.SIZE:
            self.clear()
        self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        pieces = text.split(" ")
        if self.apart and not any(a in text for a in self.added):
            try:
                return b"".join(map(self.part, self.split(pieces[0]))) + b"".join(map(self.__getitem__, pieces[1:]))
            except TypeError:
                pass
        return self.whole(text)


def _schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Packs ids into sequences; a file appears under its final name only when it is whole, so that repeated tasks do no harm."""

    def __init__(self, folder: str, shard: int, length: int, rows: int, dtype: np.dtype):
        self.length, self.rows, self.dtype, self.pending, self.held = length, rows, dtype, [], 0
        self.schema = _schema(length, dtype)
        self.docs: list[tuple] = []
        self.n_ids = self.n_sequences = 0
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.uris = [f"{folder}/{kind}-{shard:06d}.arrow" for kind in ("ids", "docs")]
        self.final = [f"{root}/{kind}-{shard:06d}.arrow" for kind in ("ids", "docs")]
        mark = f"-{TaskContext.get().taskAttemptId()}.part" if TaskContext.get() else ".part"
        self.temp = [x + mark for x in self.final]
        self.sink = self.fs.open_output_stream(self.temp[0])
        self.out = ipc.new_file(self.sink, self.schema)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n_ids, len(ids)))
        self.pending.append(ids)
        self.n_ids += len(ids)
        self.held += len(ids)
        while self.held >= self.length * self.rows:
            self.flush(False)

    def flush(self, last: bool) -> None:
        """One batch of exactly ``rows`` sequences; the last one of a file may be shorter, and its last sequence padded."""
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, self.dtype)
        n = -(-len(ids) // self.length) if last else self.rows
        cut = min(len(ids), n * self.length)
        if n:
            mask = np.arange(n * self.length) < cut
            whole = np.pad(ids[:cut], (0, n * self.length - cut))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (whole, mask)]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.n_sequences += n
        self.pending = [ids[cut:]] if cut < len(ids) else []
        self.held = len(ids) - cut

    def close(self) -> dict:
        self.flush(True)
        self.out.close()
        self.sink.close()
        with self.fs.open_output_stream(self.temp[1]) as sink, ipc.new_file(sink, _DOCS) as out:
            columns = list(zip(*self.docs)) or [(), (), ()]
            out.write_batch(pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, _DOCS)], schema=_DOCS))
        for a, b in zip(self.temp, self.final):
            self.fs.move(a, b)
        return {"ids_path": self.uris[0], "docs_path": self.uris[1], "n_docs": len(self.docs), "n_ids": self.n_ids, "n_sequences": self.n_sequences}


def open_file(uri: str) -> ipc.RecordBatchFileReader:
    """Random access to a shard: a memory map where the file is local, ranged reads elsewhere."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def sequence(reader: ipc.RecordBatchFileReader, k: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence k, a view into the file, and its mask: row k % rows of batch k // rows, as every batch but a file's last holds ``rows``."""
    if not 0 <= k // rows < reader.num_record_batches or k % rows >= (batch := reader.get_batch(k // rows)).num_rows:
        raise IndexError(k)
    size = batch.schema.field("ids").type.list_size
    part = slice(k % rows * size, (k % rows + 1) * size)
    mask = batch.column("mask").flatten()
    return batch.column("ids").flatten().to_numpy()[part], mask.slice(part.start, size).to_numpy(zero_copy_only=False)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, length: int = 2048, rows: int = 64) -> DataFrame:
    """Write the files in ascending doc_id order; returns the manifest, one row a shard."""
    docs = require(docs, "doc_id", "text")

    def write(batches):
        shard = TaskContext.get().partitionId()
        coder, writer = UnitEncoder(tokenizer_path), None
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            for piece in slices(batch, "text", 8 << 20):
                writer = writer or ShardWriter(folder, shard, length, rows, coder.dtype)
                texts = piece.column("text").fill_null("").to_pylist()
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), map(coder.encode, texts)):
                    writer.add(doc_id, np.frombuffer(ids + end, coder.dtype))
        if writer:
            row = {"shard": shard} | writer.close()
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("ids_path", pa.string()), ("docs_path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_sequences", pa.int64())]))

    order = [F.col("doc_id").cast("long").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(freed(write), MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32; ``start`` counts the ids of all documents before it."""
    # The manifest has one short row a file, so the running sum over all of them is one small task.
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("base", base)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = open_file(row["ids_path"])
                values = [ids.get_batch(k).column("ids").flatten().to_numpy() for k in range(ids.num_record_batches)]
                flat = values[0] if len(values) == 1 else np.concatenate(values)
                docs = open_file(row["docs_path"])
                for k in range(docs.num_record_batches):
                    part = docs.get_batch(k)
                    start, n = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(flat[a : a + m].astype("<u4")) for a, m in zip(start.tolist(), n.tolist())]
                    yield pa.record_batch([part.column("doc_id"), pa.array(start + row["base"]), part.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = shards.repartition(F.col("shard"))
    return spread.mapInArrow(freed(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 0, length: int = 2048) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "tokens")
    if not re.match(r"[a-zA-Z][\w+.-]*:", folder):
        folder = "file://" + os.path.abspath(folder)
    return read_tokens(write_tokens(docs, tokenizer_path, folder, end_id, length))
