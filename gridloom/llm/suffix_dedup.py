"""Operator 6: removal of repeated byte strings by sampled suffixes.

Every byte that lies in a ``length``-byte string which also starts elsewhere (in any text, or in the same one) is removed.

A window of ``length`` bytes is looked at through its anchor, the leftmost least of its GRAM-byte hashes; equal windows have
equal anchors at equal offsets. Neighbouring windows share anchors, so a text falls into units (runs of windows with one
anchor), about one per 90 bytes. Suffixes are sampled at the anchors.

1. Candidates. A window contains the HALF bytes from its anchor on or the HALF bytes up to it, so a unit whose two half keys
   occur nowhere else has no repeat. Keys travel packed by bucket, each at most twice per batch; those that occur twice fill
   a Bloom filter sized by their number. (With more than FILTER_KEYS of them, every unit is a candidate.)
2. The bytes of candidate units travel once per distinct unit and batch, with the places where it stands. Spark's sampled
   splitters range-partition them by the leading bytes of the suffix; equal leading bytes stay in one partition, so no group
   crosses a boundary.
3. In a group of equal leading bytes, equal units are found by their bytes. Distinct units are sorted twice by multikey
   quicksort: by the suffix from the anchor on, and by the reversed bytes before it. Two units share the window whose anchor
   is at offset p when they agree on length - p bytes in the one order and on p bytes in the other; both are read off the
   common prefixes of neighbours, for all p.
4. The units of a heavy anchor are dealt again, by CLASS offsets at a time and by the bytes that windows
   of these offsets must share; there, windows are compared with the first of their kind in one pass of bounded memory.

All matches are decided by the bytes themselves; hashes only choose candidates and places of work. Texts are cut into slices
of SLICE bytes at the edges of units, so a text of any size takes the same memory.

Cases: null text is empty; texts shorter than ``length`` lose nothing; a text that stands in several rows goes as a whole;
spans are keyed by the text (its MD5 digest and size); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BROADCAST_ROWS, HEAVY_SHARE, freed, pick, staged
from gridloom.llm.jaccard import _by_bucket, _mix, _passes, _unpacked, grouped_join, row_filter
from gridloom.llm.tokens import byte_batches

LENGTH = 200
GRAM = 16
#: Windows of a text that are looked at in one go.
SLICE = 1 << 17
FILTER_KEYS = 20_000_000
BUCKET_KEYS = 2_000_000
#: Offsets that a class of a heavy anchor holds; distinct units of whole groups that are sorted in one go.
CLASS = 4
UNITS = 3_000
#: An anchor is heavy with more units than this, or than 1/HEAVY_SHARE of all and UNITS.
HEAVY_UNITS = 20_000
#: Rows up to which the quicksort leaves the rest to a plain sort of byte strings.
PLAIN = 24
_TABLE = _mix(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


def _power() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, enough for a slice."""
    if not _powers:
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            out = np.full(SLICE + 4096, b, dtype=np.uint64)
            out[0] = 1
            _powers.append(np.multiply.accumulate(out))
    return _powers


def units(text: bytes, length: int):
    """(first, last, anchor, on, upto) arrays of the units of a text, slice by slice: first and last window, place of the
    anchor, keys of the length / 2 bytes from the anchor on and of those that end with it (0 where the text is too short)."""
    n, half, start = len(text), length // 2, 0
    power, inverse = _power()
    while start + length <= n:
        windows = min(SLICE, n - length + 1 - start)  # of this slice
        low, high = max(0, start - length), min(n, start + windows - 1 + 2 * length)
        data = np.frombuffer(text, dtype=np.uint8, count=high - low, offset=low)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * power[: len(data)], out=sums[1:])

        def key(at: np.ndarray, size: int, sums=sums, inverse=inverse) -> np.ndarray:
            return _mix((sums[at + size] - sums[at]) * inverse[at])

        own = start - low
        grams = windows + length - GRAM
        least = _mix((sums[own + GRAM : own + GRAM + grams] - sums[own : own + grams]) * inverse[own : own + grams])
        least = (least & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
        width = length - GRAM + 1
        padded = np.full(-(-grams // width) * width, np.uint64(2**64 - 1))
        padded[:grams] = least
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turn = np.flatnonzero(at[1:] != at[:-1]) + 1
        first, last = np.concatenate([[0], turn]), np.concatenate([turn - 1, [windows - 1]])
        more = start + windows + length <= n
        if more and len(first) > 1:  # the last unit may go on in the next slice
            first, last, windows = first[:-1], last[:-1], int(first[-1])
        a = at[first]
        on, upto = np.zeros(len(a), dtype=np.uint64), np.zeros(len(a), dtype=np.uint64)
        local = a + own
        ok = local + half <= len(data)
        on[ok] = key(local[ok], half) ^ np.uint64(0x5851F42D4C957F2D)
        ok = local + GRAM >= half
        upto[ok] = key(local[ok] + GRAM - half, half) ^ np.uint64(0x14057B7EF767814F)
        yield first + start, last + start, a + start, on, upto
        start += windows


def _texts(batches, length: int):
    """Lists of texts of at least ``length`` bytes, few MB each; a text that the task has seen lately is left out."""
    seen: set[bytes] = set()
    for batch in byte_batches(batches, 0, 4 << 20):
        out = []
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            if text is not None and len(text) >= length:
                digest = hashlib.md5(text).digest()
                if digest not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(digest)
                    out.append((digest, text))
        yield out


def _packed(length: int, buckets: int):
    def run(batches):
        for texts in _texts(batches, length):
            found = [k for _, t in texts for u in units(t, length) for k in u[3:]]
            if not found:
                continue
            key, count = np.unique(np.concatenate(found), return_counts=True)
            key = np.concatenate([key, key[count > 1]])
            key = key[key != 0]
            for b, _, _, low in _by_bucket(key, np.array([len(key)]), (key >> np.uint64(32)) % np.uint64(buckets), buckets):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "keys": pa.array([low.tobytes()], pa.binary())})

    return run


def _twice(table: pa.Table) -> pa.Table:
    """Keys of a bucket that occur more than once, as their low bits and the bucket."""
    key = np.sort(_unpacked(table, "keys", np.uint32))
    again = np.unique(key[1:][key[1:] == key[:-1]])
    return pa.table({"key": pa.array(again.astype(np.int64) << 24 | table.column("bucket")[0].as_py(), pa.int64())})


def _short(key: np.ndarray, buckets: int) -> np.ndarray:
    """The form of ``_twice`` of full keys."""
    return ((key & np.uint64(0xFFFFFFFF)) << np.uint64(24) | (key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


_SUFFIX = "lead binary, unit binary, offset int, places binary"


def _rows(found: dict) -> pa.RecordBatch:
    rows = [(*key, b"".join(places)) for key, places in found.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.binary(), pa.int32(), pa.binary()))], names=["lead", "unit", "offset", "places"])


def _suffixes(length: int, buckets: int, repeated):
    """Candidate units, once per batch: leading bytes, bytes, offset of the anchor in them, and places (digest, size, start)."""

    def run(batches):
        table = np.frombuffer(repeated.value, dtype=np.uint8) if repeated else None
        for texts in _texts(batches, length):
            found: dict[tuple, list[bytes]] = {}
            for digest, t in texts:
                size = len(t).to_bytes(8, "little")
                for first, last, anchor, on, upto in units(t, length):
                    near = np.ones(len(first), dtype=bool)
                    if table is not None:
                        near = _passes(table, _short(on, buckets)) & (on != 0) | _passes(table, _short(upto, buckets)) & (upto != 0)
                    for i in np.flatnonzero(near).tolist():
                        lo, a = int(first[i]), int(anchor[i])
                        found.setdefault((t[a : a + GRAM], t[lo : int(last[i]) + length], a - lo), []).append(digest + size + lo.to_bytes(8, "little"))
            if found:
                yield _rows(found)

    return run


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of unsigned words: three-way partition word by word; few rows are sorted plainly."""
    out, todo = [], [(np.arange(len(words)), 0)]
    plain = words.astype(">u8")
    while todo:
        rows, w = todo.pop()
        if w == words.shape[1] or len(rows) < 2:
            out.append(rows)
        elif len(rows) <= PLAIN:
            keys = {i: plain[i, w:].tobytes() for i in rows.tolist()}
            out.append(np.array(sorted(keys, key=keys.__getitem__)))
        else:
            column = words[rows, w]
            pivot = np.partition(column[:: max(1, len(rows) // 9)], min(len(rows), 9) // 2)[min(len(rows), 9) // 2]
            todo += [(rows[column > pivot], w), (rows[column == pivot], w + 1), (rows[column < pivot], w)]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _order(contexts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row of bytes within the sorted rows, and for each rank the common prefix with the rank before it (-1: of
    another group)."""
    k, n = contexts.shape
    words = np.zeros((k, 1 + -(-n // 8)), dtype=np.uint64)
    padded = np.zeros((k, (words.shape[1] - 1) * 8), dtype=np.uint8)
    padded[:, :n] = contexts
    words[:, 0], words[:, 1:] = group, padded.view(">u8")
    order = multikey_quicksort(words)
    differ = contexts[order[1:]] != contexts[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
    common = np.where(group[order[1:]] == group[order[:-1]], common, -1)
    rank = np.empty(k, dtype=np.int64)
    rank[order] = np.arange(k)
    return rank, np.concatenate([[-1], common])


def shared_windows(kinds: list[bytes], offset: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct units (bytes, offset of the anchor, group of equal leading bytes): least and largest offset of the anchor
    in the windows that another unit of the group has too (0, 0: none). Offsets in between need not be shared, but the bytes
    of such windows are covered by the two, since a unit has fewer than ``length`` windows."""
    k, size = len(kinds), np.array([len(x) for x in kinds])
    ahead, back = np.zeros((k, length), dtype=np.uint8), np.zeros((k, length), dtype=np.uint8)
    for i, x in enumerate(kinds):
        o = int(offset[i])
        ahead[i, : len(x) - o] = np.frombuffer(x, dtype=np.uint8, offset=o)
        back[i, :o] = np.frombuffer(x, dtype=np.uint8, count=o)[::-1]
    (rank_a, common_a), (rank_b, common_b) = _order(ahead, group), _order(back, group)
    low, high, room = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64), size - offset
    for p in range(length - GRAM + 1):  # offset of the anchor in the window
        has = np.flatnonzero((offset >= p) & (room >= length - p))
        if len(has) < 2:
            continue
        kind = np.cumsum(common_a < length - p)[rank_a[has]] * (k + 1) + np.cumsum(common_b < p)[rank_b[has]]
        order = np.argsort(kind)
        same = kind[order[1:]] == kind[order[:-1]]
        some = has[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        low[some] = np.where(high[some] == 0, p + 1, low[some])
        high[some] = p + 1
    return low, high


def _spans(places: bytes, lo: int, hi: int):
    for i in range(0, len(places), 32):
        start = int.from_bytes(places[i + 24 : i + 32], "little")
        yield places[i : i + 16], int.from_bytes(places[i + 16 : i + 24], "little"), start + lo, start + hi


_SPAN = "digest binary, n_bytes long, lo long, hi long"


def _span_batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["digest", "n_bytes", "lo", "hi"])


def _compare(length: int):
    """Units sorted by (lead, unit, offset) to spans that repeat."""

    def run(batches):
        kinds: list[tuple] = []  # distinct units not known to repeat as a whole: lead, bytes, offset, places
        spans: list[tuple] = []
        now = places = None  # the unit at hand, and its place as long as it has only one

        def close():
            leads: dict[bytes, int] = {}
            group = np.array([leads.setdefault(x[0], len(leads)) for x in kinds], dtype=np.int64)
            several = np.bincount(group)[group] > 1
            some = [x for x, yes in zip(kinds, several, strict=True) if yes]
            if some:
                low, high = shared_windows([x[1] for x in some], np.array([x[2] for x in some]), group[several], length)
                for x, p, q in zip(some, low.tolist(), high.tolist(), strict=True):
                    if q and x[3]:
                        spans.extend(_spans(x[3], x[2] - q + 1, x[2] - p + 1 + length))
            kinds.clear()

        for batch in batches:
            for lead, unit, offset, where in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (lead, unit, offset) == now:
                    spans.extend(_spans(where, 0, len(unit)))
                    if places:  # the first row of this unit stood alone: it repeats as well
                        spans.extend(_spans(places, 0, len(unit)))
                        places = None
                        kinds[-1] = (*now, b"")
                else:
                    if now and lead != now[0] and len(kinds) > UNITS:
                        close()
                    now, places = (lead, unit, offset), where if len(where) == 32 else None
                    if not places:
                        spans.extend(_spans(where, 0, len(unit)))
                    kinds.append((*now, places or b""))
                if len(spans) > 50_000:
                    yield _span_batch(spans)
                    spans = []
        if kinds:
            close()
        yield _span_batch(spans)

    return run


def _classes(length: int):
    """Units of heavy anchors, per class of offsets that they have windows for: key (lead, class and the bytes that all windows
    of the class share there), the bytes of the class, offset of the anchor in them, places."""

    def run(batches):
        for batch in batches:
            found: dict[tuple, list[bytes]] = {}
            for lead, unit, offset, places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                least = max(0, length - (len(unit) - offset))
                for c in range(least // CLASS, offset // CLASS + 1):
                    lo, hi = offset - min(offset, (c + 1) * CLASS - 1), min(len(unit), offset + length - c * CLASS)
                    core = unit[offset - c * CLASS if c * CLASS <= offset else 0 : offset + length - (c + 1) * CLASS + 1]
                    start = [places[i : i + 24] + (int.from_bytes(places[i + 24 : i + 32], "little") + lo).to_bytes(8, "little") for i in range(0, len(places), 32)]
                    found.setdefault((lead + c.to_bytes(2, "little") + hashlib.blake2b(core, digest_size=16).digest(), unit[lo:hi], offset - lo), []).extend(start)
            if found:
                yield _rows(found)

    return run


def _compare_classes(length: int):
    """Rows sorted by key: every window against the first of its kind under the key, by all its bytes."""

    def run(batches):
        now, firsts, spans = None, {}, []
        for batch in batches:
            for key, unit, offset, places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != now:
                    now, firsts = key, {}
                c, covered = int.from_bytes(key[GRAM : GRAM + 2], "little"), []
                for p in range(c * CLASS, (c + 1) * CLASS):
                    lo = offset - p
                    if lo < 0 or lo + length > len(unit):
                        continue
                    window, alone = unit[lo : lo + length], len(places) == 32
                    if window not in firsts:
                        firsts[window] = (places, lo) if alone else None
                        if alone:
                            continue
                    first = firsts[window]
                    if first:
                        spans.extend(_spans(first[0], first[1], first[1] + length))
                        firsts[window] = None
                    covered.append(lo)
                if covered:  # these windows overlap
                    spans.extend(_spans(places, min(covered), max(covered) + length))
                if len(spans) > 50_000:
                    yield _span_batch(spans)
                    spans = []
        yield _span_batch(spans)

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """digest, n_bytes, lo, hi: byte spans that repeat, by text; they may overlap. ``texts``: one string column. Texts that
    stand in several rows are told apart by the caller."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length(texts.columns[0])), F.lit(0))).first()[0]
    buckets = min(1 << 24, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 45 // BUCKET_KEYS + 1))
    packed = texts.mapInArrow(_packed(length, buckets), "bucket int, keys binary")
    twice = staged(packed.groupBy("bucket").applyInArrow(_twice, "key long"), "twice")
    count = twice.count()
    repeated = spark.sparkContext.broadcast(row_filter(twice, count)) if count <= FILTER_KEYS else None
    freed(twice)
    suffixes = staged(texts.mapInArrow(_suffixes(length, buckets, repeated), _SUFFIX), "suffixes")
    total = suffixes.count()
    most = max(UNITS, min(total // HEAVY_SHARE, HEAVY_UNITS))
    heavy = staged(suffixes.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("lead"), "heavy")
    leads = heavy.count()
    hot = F.broadcast(heavy) if leads <= BROADCAST_ROWS else heavy
    order = ["lead", "unit", "offset"]
    light = suffixes.join(hot, "lead", "left_anti").repartitionByRange("lead").sortWithinPartitions(*order)
    spans = light.select(*order, "places").mapInArrow(_compare(length), _SPAN)
    if leads:
        dealt = suffixes.join(hot, "lead", "left_semi").select(*order, "places").mapInArrow(_classes(length), _SUFFIX)
        dealt = staged(dealt, "classes").repartitionByRange("lead").sortWithinPartitions("lead")
        spans = spans.unionByName(dealt.mapInArrow(_compare_classes(length), _SPAN))
    found = staged(spans.distinct(), "spans")
    freed(suffixes)
    return found


def _runs(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, removed (array of byte spans), kept (the remaining bytes) for every row of ``docs`` (doc_id, text)."""
    src = pick(docs, doc_id="long", text="string")
    spans = repeated_spans(src.select("text"), length)
    per = spans.groupBy(F.struct("digest", "n_bytes").alias("key")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    keyed = src.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    keyed = keyed.withColumn("key", F.struct(F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "n_bytes"))
    rows = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "texts")
    total = max(1, src.count())
    whole = F.when((F.col("_n") > 1) & (F.col("key.n_bytes") >= length), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("key.n_bytes").alias("hi"))))
    table = staged(per.join(rows, "key", "full_outer").select("key", F.coalesce(whole, "spans").alias("spans"), F.coalesce("_n", F.lit(1)).alias("_n")), "by_text")
    freed(rows, spans)
    joined = grouped_join(keyed.select("doc_id", "text", "n_bytes", "key"), table, "key", total)

    def cut(batches):
        for batch in byte_batches(batches, 1):
            removed, kept = [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text, runs = text or b"", _runs(spans or [])
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"lo": a, "hi": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(removed, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "removed", "kept"])

    return joined.select("doc_id", "text", "n_bytes", "spans").mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<lo: long, hi: long>>, kept binary")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (s, r) -> s + r.hi - r.lo)").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
