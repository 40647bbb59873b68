"""Operator 8: exact dedup over a log-structured merge index of text digests.

Texts are equal when identical after lower-casing A-Z. The index is cut by leading digest bits into buckets, as many as the
rows ask for. Ingest: every task fills a memtable (digest -> best id, rows, rows that share the best id); a full one is
flushed as a sorted run, one segment per bucket, to level 0 in the shared folder. When a level has FAN tables of runs, or on
``compact``, its segments are merged bucket by bucket, in the order of their digests, into one run a level deeper; the best
identifier (``keep``: largest or smallest) and the counts stay. A segment carries a Bloom filter of its repeated digests,
sized by their number. Lookup: where all filters of the merged level together are small enough to broadcast, they bar most
rows; the others are hits, and a join with the run decides. The texts of hits are shuffled and compared byte by byte with
their group. Should two texts share a SHA-256 digest, their rows are grouped again by the texts themselves.

A group may hold any share of the rows: memtables shrink it before the shuffle; in the lookup, digests with more than
1/HEAVY_SHARE of all rows (fewer than HEAVY_SHARE of them, so broadcast) are joined without a shuffle, and compared in
salts, which stream.

Cases: null text equals empty text; null ids rank below all others; when the best id itself occurs several times in a
group, one of its rows stays; an empty table gives an empty result; extra columns travel along untouched.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import HEAVY_SHARE, freed, staged
from gridloom.llm.tokens import byte_batches

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MEMTABLE_ROWS = 100_000
#: Digests of a bucket, about; tables of one level before they are merged.
BUCKET_ROWS = 500_000
FAN = 4
#: Filter bits per repeated digest, positions per digest, and the most bytes of filters that are broadcast.
KEY_BITS = 16
HASHES = 4
FILTER_BYTES = 32 << 20
_SEGMENT = "bucket int, run string, digests binary, ids binary, known binary, counts binary, tied binary, filter binary"


def _binary(column) -> list[bytes]:
    return [(x or b"").translate(LOWER) for x in column.cast(pa.binary()).to_pylist()]


def _slots(digests: bytes, bits: int) -> np.ndarray:
    """HASHES filter positions per digest."""
    return (np.frombuffer(digests, dtype="<u8").reshape(-1, 4)[:, :HASHES] % np.uint64(bits)).astype(np.int64)


def _buckets_of(digests: bytes, buckets: int) -> np.ndarray:
    """Bucket of each digest: by its leading bits, so buckets follow the order of digests."""
    return (np.frombuffer(digests, dtype=">u4").reshape(-1, 8)[:, 0].astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _filter(digests: list[bytes]) -> bytes:
    if not digests:
        return b""
    bits = np.zeros(-(-KEY_BITS * len(digests) // 8) * 8, dtype=bool)
    bits[_slots(b"".join(digests), len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def _segments(entries: list[tuple], run: str, buckets: int) -> pa.RecordBatch:
    """Sorted (digest, id, rows, rows with that id) as one segment per bucket."""
    at = _buckets_of(b"".join(e[0] for e in entries), buckets) if entries else np.zeros(0, dtype=np.int64)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if entries else [0]
    rows = []
    for lo, hi in zip(cut, cut[1:], strict=False):
        some = entries[lo:hi]
        ids, counts, tied = (np.array([e[i] or 0 for e in some], dtype=np.int64) for i in (1, 2, 3))
        known = np.array([e[1] is not None for e in some], dtype=np.uint8)
        rows.append((int(at[lo]), run, b"".join(e[0] for e in some), *(x.tobytes() for x in (ids, known, counts, tied)), _filter([e[0] for e in some if e[2] > 1])))
    kinds = (pa.int32(), pa.string(), *[pa.binary()] * 6)
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _entries(digests: bytes, ids: bytes, known: bytes, counts: bytes, tied: bytes) -> Iterator[tuple]:
    """The sorted entries of a segment."""
    ids = [i if k else None for i, k in zip(np.frombuffer(ids, dtype=np.int64).tolist(), known, strict=True)]
    keys = (digests[i : i + 32] for i in range(0, len(digests), 32))
    return zip(keys, ids, np.frombuffer(counts, dtype=np.int64).tolist(), np.frombuffer(tied, dtype=np.int64).tolist(), strict=True)


def _better(largest: bool):
    """Of two (id, rows, rows with that id): the better id, all rows."""

    def better(a: tuple, b: tuple) -> tuple:
        if a[0] == b[0]:
            return a[0], a[1] + b[1], a[2] + b[2]
        first = b[0] is None or a[0] is not None and (a[0] > b[0]) == largest
        return (a[0], a[1] + b[1], a[2]) if first else (b[0], a[1] + b[1], b[2])

    return better


class DigestIndex:
    """Levels of sorted runs, as tables in the shared folder."""

    def __init__(self, buckets: int, keep: str = "largest"):
        self.buckets, self.better = buckets, _better(keep == "largest")
        self.levels: list[list[DataFrame]] = []

    def ingest(self, docs: DataFrame) -> None:
        """``docs``: doc_id long, text string."""
        better, buckets = self.better, self.buckets

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            table: dict[bytes, tuple] = {}
            runs, part = 0, TaskContext.get().partitionId()
            for batch in byte_batches(batches, 1):
                for doc_id, text in zip(batch.column(0).to_pylist(), _binary(batch.column(1)), strict=True):
                    key = hashlib.sha256(text).digest()
                    old = table.get(key)
                    table[key] = better(old, (doc_id, 1, 1)) if old else (doc_id, 1, 1)
                if len(table) >= MEMTABLE_ROWS:
                    yield _segments([(k, *table[k]) for k in sorted(table)], f"{part}-{runs}", buckets)
                    table, runs = {}, runs + 1
            if table:
                yield _segments([(k, *table[k]) for k in sorted(table)], f"{part}-{runs}", buckets)

        self._add(0, staged(docs.mapInArrow(fill, _SEGMENT), "runs"))

    def _add(self, level: int, runs: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(runs)
        if len(self.levels[level]) >= FAN:
            self._merge([level], level + 1)

    def _merge(self, levels: list[int], to: int) -> None:
        tables = [t for level in levels for t in self.levels[level]]
        for level in levels:
            self.levels[level] = []
        runs, better, buckets = tables[0], self.better, self.buckets
        for more in tables[1:]:
            runs = runs.unionByName(more)

        def merge(table: pa.Table) -> pa.Table:
            columns = [table.column(c).to_pylist() for c in ("digests", "ids", "known", "counts", "tied")]
            out = []
            for key, same in groupby(heapq.merge(*(_entries(*s) for s in zip(*columns, strict=True)), key=itemgetter(0)), itemgetter(0)):
                best = next(same)[1:]
                for other in same:
                    best = better(best, other[1:])
                out.append((key, *best))
            return pa.Table.from_batches([_segments(out, f"merged-{to}", buckets)])

        merged = staged(runs.groupBy("bucket").applyInArrow(merge, _SEGMENT), "merged")
        freed(*tables)
        self._add(to, merged)

    def compact(self) -> DataFrame:
        """Merge all levels into one run; its segments."""
        full = [i for i, tables in enumerate(self.levels) if tables]
        if len(full) > 1 or full == [0] or len(self.levels[full[0]]) > 1:
            self._merge(full, max(full[-1], 1))
        return self.levels[-1][0]

    @staticmethod
    def repeated(run: DataFrame) -> DataFrame:
        """digest, keep_id, n, tied of the digests that occur more than once."""

        def unpack(batches):
            for batch in batches:
                for segment in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    some = [e for e in _entries(*segment) if e[2] > 1]
                    yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in some], k) for i, k in enumerate((pa.binary(), *[pa.int64()] * 3))], names=["digest", "keep_id", "n", "tied"])

        return run.select("digests", "ids", "known", "counts", "tied").mapInArrow(unpack, "digest binary, keep_id long, n long, tied long")


def _probe(filters: dict[int, bytes] | None, buckets: int):
    """Digest of a text, and whether the filter of its bucket (None: there are none) lets it pass."""

    @F.pandas_udf("struct<digest: binary, maybe: boolean>")
    def probe(texts):
        import pandas as pd

        digests = [hashlib.sha256((x or "").encode("utf-8", "surrogatepass").translate(LOWER)).digest() for x in texts]
        hit = np.ones(len(digests), dtype=bool)
        if filters is not None and digests:
            joined = b"".join(digests)
            at = _buckets_of(joined, buckets)
            for b in np.unique(at).tolist():
                table, rows = np.frombuffer(filters.get(b, b""), dtype=np.uint8), np.flatnonzero(at == b)
                if len(table):
                    slot = _slots(b"".join(digests[i] for i in rows), 8 * len(table))
                    hit[rows] = ((table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).all(axis=1)
                else:
                    hit[rows] = False
        return pd.DataFrame({"digest": digests, "maybe": hit})

    return probe


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (digest, salt): digests of texts that differ from the first of their run, and the runs' first texts."""
    key = head = None
    for batch in byte_batches(batches, 2):
        digests, salts, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _binary(batch.column(2))
        out = []
        for d, s, t in zip(digests, salts, texts, strict=True):
            if (d, s) != key:
                key, head = (d, s), t
                if s >= 0:
                    out.append((d, True, t))
            elif t != head:
                out.append((d, False, None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.bool_(), pa.binary()))], names=["digest", "same", "head"])


def _false_hits(hits: DataFrame) -> DataFrame:
    """Digests whose texts differ: digest. Expected to be empty."""
    kind = "digest binary, same boolean, head binary"
    ordered = hits.select("digest", "salt", "text").repartition("digest", "salt").sortWithinPartitions("digest", "salt")
    first = staged(ordered.mapInArrow(_compare, kind), "heads")
    heads = first.filter("same").select("digest", F.lit(-1).cast("long").alias("salt"), F.col("head").cast("string").alias("text"))
    second = heads.repartition("digest").sortWithinPartitions("digest").mapInArrow(_compare, kind)
    return first.filter("NOT same").select("digest").unionByName(second.filter("NOT same").select("digest")).distinct()


def exact_dedup(docs: DataFrame, keep: str = "largest", whole: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of ``docs`` (doc_id, text); ``whole``: also ``_row``, a struct
    of all columns of ``docs``. No text is written but those that travel for the comparison."""
    spark = docs.sparkSession
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *([F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row")] if whole else []))
    total = src.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ROWS))
    index = DigestIndex(buckets, keep)
    index.ingest(src.select("doc_id", "text"))
    run = index.compact()
    repeated = staged(index.repeated(run), "repeated")
    size = run.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]
    filters = {r["bucket"]: r["filter"] for r in run.filter(F.octet_length("filter") > 0).select("bucket", "filter").toLocalIterator()} if size <= FILTER_BYTES else None
    freed(run)
    heavy = repeated.filter(F.col("n") * HEAVY_SHARE > total)  # fewer than HEAVY_SHARE
    light = repeated.filter(F.col("n") * HEAVY_SHARE <= total)
    probed = src.withColumn("_d", _probe(filters, buckets)("text")).withColumn("digest", F.col("_d.digest")).withColumn("maybe", F.col("_d.maybe")).drop("_d")

    salted = probed.filter("maybe").select("digest", "text").join(F.broadcast(heavy.select("digest", F.col("n").alias("_hn"))), "digest", "left")
    salted = salted.withColumn("salt", F.when(F.col("_hn").isNull(), F.lit(-1)).otherwise(F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("_hn") * HEAVY_SHARE / F.lit(max(1, total))))).cast("long"))
    wrong = staged(_false_hits(salted), "collisions")

    extra = ["_row"] if whole else []
    rows = probed.select("doc_id", "digest", "maybe", *extra)
    single = rows.filter("NOT maybe").select("doc_id", "digest", *extra, *(F.lit(None).cast("long").alias(c) for c in ("keep_id", "n", "tied")))
    marked = rows.filter("maybe").drop("maybe").join(F.broadcast(heavy.select("digest", F.col("keep_id").alias("_hk"), F.col("n").alias("_hn"), F.col("tied").alias("_ht"))), "digest", "left")
    hot = marked.filter("_hn IS NOT NULL").select("doc_id", "digest", *extra, F.col("_hk").alias("keep_id"), F.col("_hn").alias("n"), F.col("_ht").alias("tied"))
    rest = marked.filter("_hn IS NULL").select("doc_id", "digest", *extra).join(light, "digest", "left").select(*hot.columns)
    tagged = single.unionByName(hot).unionByName(rest).withColumn("kept", F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if repeated.filter("tied > 1").take(1):  # the best id occurs several times: one of its rows stays
        several = F.col("kept") & (F.coalesce("tied", F.lit(1)) > 1)
        tied = staged(tagged.filter(several).withColumn("_u", F.monotonically_increasing_id()), "tied")
        first = tied.groupBy("digest").agg(F.min("_u").alias("_u")).select("_u", F.lit(True).alias("_first"))
        tagged = tagged.filter(~several).unionByName(tied.join(first, "_u", "left").withColumn("kept", F.coalesce("_first", F.lit(False))).select(*tagged.columns))
    decided = tagged.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), "kept", "digest", *extra)
    if wrong.take(1):  # two texts with one digest: group these rows by their texts
        again = staged(probed.join(wrong, "digest", "left_semi").withColumn("_t", F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("_u", F.monotonically_increasing_id()), "regrouped")
        pick_row = F.max if keep == "largest" else F.min
        groups = again.groupBy("_t").agg(pick_row(F.struct(F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull(), "doc_id", "_u")).alias("_b"), F.count(F.lit(1)).alias("group_size"))
        again = again.join(groups, "_t").select("doc_id", F.col("_b.doc_id").alias("keep_id"), "group_size", (F.col("_u") == F.col("_b._u")).alias("kept"), "digest", *extra)
        decided = decided.join(wrong, "digest", "left_anti").unionByName(again)
    return decided


def deduplicated(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay."""
    return exact_dedup(docs, keep, whole=True).filter("kept").select("_row.*")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""
