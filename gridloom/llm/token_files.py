"""Operator 10: token ids in wavelet-matrix shard files.

Documents are range-partitioned and sorted by id; each task encodes its texts and writes shard files to a shared folder.
A shard is one compressed file: a JSON head, the documents' ids and lengths, and one bit-plane per bit of the token ids.
A plane is stored in compressed blocks, with the ones before every block; a block is a rank directory entry and a unit of
access. ``WaveletShard`` reads a file and answers token access, count (rank) and occurrence (select) by walking the planes.

Cases: null text is empty and gives its end id alone; null ids come first; rows with the same id are ordered by a hash of
their text; a document longer than a shard gets a larger one; an empty table gives no files. Files are written under a
temporary name and renamed, and their names depend on the partition only, so a task that runs again replaces its own.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridloom.llm.common import new_folder, pick, staged, store_of
from gridloom.llm.tokens import SLICE, byte_batches, encoder

END_ID = 2
DTYPE = "<u2"
BITS = 16
SHARD_TOKENS = 2**22
#: Bits of a plane that are compressed together.
BLOCK = 2**19
MAGIC = b"GLWM1\n"


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The bytes of a shard file."""
    out, at, planes = [], 0, []

    def put(data: bytes) -> list[int]:
        nonlocal at
        packed = zlib.compress(data, 1)
        packed = packed if len(packed) < 0.97 * len(data) else data
        out.append(packed)
        at += len(packed)
        return [at - len(packed), len(packed), len(data)]

    known = np.array([x is not None for x in doc_ids], dtype=bool)
    head = {"n": len(ids), "docs": len(doc_ids), "ids": put(np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes()), "known": put(np.packbits(known).tobytes()), "lengths": put(np.array(lengths, dtype="<i8").tobytes())}
    current = ids.astype(np.uint16)
    for b in range(BITS - 1, -1, -1):
        bit = (current >> np.uint16(b)) & np.uint16(1) != 0
        packed, ones = np.packbits(bit), 0
        blocks = []
        for lo in range(0, len(bit), BLOCK):
            blocks.append([ones, *put(packed[lo // 8 : (lo + BLOCK) // 8].tobytes())])
            ones += int(np.count_nonzero(bit[lo : lo + BLOCK]))
        planes.append({"zeros": len(bit) - ones, "blocks": blocks})
        current = np.concatenate([current[~bit], current[bit]])
    head["planes"] = planes
    meta = json.dumps(head).encode()
    return MAGIC + struct.pack("<I", len(meta)) + meta + b"".join(out)


class WaveletShard:
    """Read side of a shard file. Blocks are unpacked when they are needed."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard file")
        (size,) = struct.unpack_from("<I", data, len(MAGIC))
        self.head = json.loads(data[len(MAGIC) + 4 : len(MAGIC) + 4 + size])
        self.body, self.n, self.planes = memoryview(data)[len(MAGIC) + 4 + size :], self.head["n"], self.head["planes"]
        self._bits: dict[tuple[int, int], np.ndarray] = {}

    def _get(self, where: list[int]) -> bytes:
        at, packed, full = where
        data = bytes(self.body[at : at + packed])
        return data if packed == full else zlib.decompress(data)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        n = self.head["docs"]
        ids = np.frombuffer(self._get(self.head["ids"]), dtype="<i8")
        known = np.unpackbits(np.frombuffer(self._get(self.head["known"]), dtype=np.uint8), count=n)
        return [int(x) if k else None for x, k in zip(ids, known, strict=True)], np.frombuffer(self._get(self.head["lengths"]), dtype="<i8")

    def _block(self, plane: int, block: int) -> np.ndarray:
        key = (plane, block)
        if key not in self._bits:
            self._bits[key] = np.unpackbits(np.frombuffer(self._get(self.planes[plane]["blocks"][block][1:]), dtype=np.uint8), count=min(BLOCK, self.n - block * BLOCK))
        return self._bits[key]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        if i <= 0 or not self.n:
            return 0
        block = min(i // BLOCK, len(self.planes[plane]["blocks"]) - 1)
        return self.planes[plane]["blocks"][block][0] + int(np.count_nonzero(self._block(plane, block)[: i - block * BLOCK]))

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(BITS):
            bit = int(self._block(p, i // BLOCK)[i % BLOCK])
            ones = self._rank1(p, i)
            i = self.planes[p]["zeros"] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for p in range(BITS):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (self.planes[p]["zeros"] + a, self.planes[p]["zeros"] + b) if token >> (BITS - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, i: int | None = None) -> int:
        """Occurrences of ``token`` before position i (default: in the shard)."""
        lo, hi = self._range(token, self.n if i is None else i)
        return hi - lo

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane."""
        blocks = self.planes[plane]["blocks"]
        before = [b[0] if bit else j * BLOCK - b[0] for j, b in enumerate(blocks)]
        j = int(np.searchsorted(before, k, side="right")) - 1
        return j * BLOCK + int(np.flatnonzero(self._block(plane, j) == bit)[k - before[j]])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(BITS - 1, -1, -1):
            zeros = self.planes[p]["zeros"]
            i = self._select(p, 1, i - zeros) if token >> (BITS - 1 - p) & 1 else self._select(p, 0, i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens: the partitions of the planes undone from the last to the first."""
        value = np.zeros(self.n, dtype=np.uint16)
        for p in range(BITS - 1, -1, -1):
            packed = b"".join(self._get(b[1:]) for b in self.planes[p]["blocks"])
            bit = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=self.n).view(bool) if self.n else np.zeros(0, dtype=bool)
            before = np.empty(self.n, dtype=np.uint16)
            before[~bit] = value[: self.planes[p]["zeros"]]
            before[bit] = value[self.planes[p]["zeros"] :] | np.uint16(1 << (BITS - 1 - p))
            value = before
        return value


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards; returns their manifest (part, shard, path, n_docs, n_tokens), in ascending document order."""

    def run(batches):
        from pyspark import TaskContext

        task, enc = TaskContext.get(), encoder(tokenizer, DTYPE, False)
        part, attempt = task.partitionId(), task.taskAttemptId()
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        names, blobs, held, shard = [], [], 0, 0

        def flush():
            ids = np.concatenate(blobs)
            data = encode_shard(ids, names, [len(b) for b in blobs])
            path = f"{root}/part-{part:06d}-{shard:05d}.wm"
            with store.open_output_stream(f"{path}.{attempt}") as f:
                f.write(data)
            store.move(f"{path}.{attempt}", path)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [f"{folder}/part-{part:06d}-{shard:05d}.wm"], "n_docs": [len(names)], "n_tokens": [len(ids)]})

        for batch in byte_batches(batches, 1, SLICE):
            ids, counts = enc.encode_ended(batch.column(1), end_id)
            for name, blob in zip(batch.column(0).to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                names.append(name)
                blobs.append(blob)
                held += len(blob)
                if held >= shard_tokens:
                    yield flush()
                    names, blobs, held, shard = [], [], 0, shard + 1
        if names:
            yield flush()

    d = pick(docs, doc_id="long", text="string").withColumn("_h", F.xxhash64("text"))
    ordered = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h").select("doc_id", "text")
    return staged(ordered.mapInArrow(run, "part int, shard int, path string, n_docs long, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), ids (little-endian unsigned 16-bit), from the files."""

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, where = store_of(path)
                with store.open_input_stream(where) as f:
                    shard = WaveletShard(f.read())
                names, lengths = shard.documents()
                tokens, ends = shard.tokens(), np.cumsum(lengths)
                first = ends - lengths
                for lo in range(0, len(names), 2_000):
                    part = slice(lo, lo + 2_000)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names[part], pa.int64()), "start": pa.array(first[part] + start, pa.int64()), "ids": pa.array([tokens[a:b].tobytes() for a, b in zip(first[part], ends[part], strict=True)], pa.binary())})

    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    files = max(1, manifest.count())
    return placed.select("path", "start").repartition(files).mapInArrow(run, "doc_id long, start long, ids binary")


@F.pandas_udf(LongType())
def ids_crc32(ids):
    return ids.map(lambda b: zlib.crc32(np.frombuffer(b, dtype=DTYPE).astype("<u4").tobytes()))


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), new_folder(spark, "shards"))
    out = read_token_files(manifest)
    return out.select("doc_id", "start", (F.length("ids") / 2).cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"))
