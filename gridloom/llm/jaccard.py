"""Operator 2: n-gram Jaccard join by vertical partitioning (``jaccard_links``: all links), and its components.

Sets: the distinct word shingles of a text as 64-bit hashes; the hash order is the global n-gram order. Texts with equal
sets form one node. The order is cut into fragments twice:

* Candidates. Two sets that link differ in at most ``d`` n-grams, d = (1 - t) / t times the smaller size. Per size class the
  order is cut into ``d + 1 + slack`` fragments, so two linked sets agree on a whole non-empty fragment (a set with more
  empty fragments than the slack also offers its empty ones). Each set takes part in its own size class and in the one
  below. Fragment keys travel packed by bucket, 32 bits each: keys that agree by chance only cost a comparison.
* Counting. Candidate pairs count their partial overlaps in each of COUNTING fragments separately; the sum per pair decides.

A key shared by up to ALL_PAIRS sets gives all its pairs. Grams that only one candidate set has can be in no overlap; they
are counted range by range (by 32 bits: chance can only make a gram look shared), and pairs and sets whose shared grams
cannot reach the threshold any more are dropped, which is exact; so is the bound that parity bitmaps of the sets give. For
components, a longer list first gives a star to its hub, the set with the least of its own; what is then still in different
components within a list is paired in a second pass, dealt to cells, so no link is lost while copies of one text never meet
in all pairs. Components come from label propagation with pointer jumping over staged edges.

Only one row of a node, and only of nodes that are still wanted, is cut into shingles again; rows that a filter lets pass by
chance repeat what another row says and change nothing.

Cases: null text and text without words have no set, n_shingles 0 and link with nothing (a component each); fewer words than
``size`` give the whole sequence as one shingle; repeated rows share a node; a null id is the smallest of its component only
if it is alone; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import HEAVY_SHARE, freed, pick, staged
from gridloom.llm.exact_dedup import LOWER
from gridloom.llm.tokens import byte_batches

SHINGLE = 5
THRESHOLD = 80
ALL_PAIRS = 8
LIST_CELL = 256
COUNTING = 4
#: Bits per wanted row in the filters that are broadcast; beyond so many rows they are picked by a shuffle join instead.
ROW_BITS = 16
FILTER_ROWS = 8_000_000
BUCKET_KEYS = 1_000_000
RANGE_GRAMS = 2_000_000
_NO_ID = -(2**63)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(size, len(h))
    total = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for i in range(k):
        total += _mix(h[i : len(h) - k + 1 + i] + np.uint64(i)) * _ODD[i % len(_ODD)]
    return np.unique(_mix(total + np.uint64(k)))


def fingerprint(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def size_classes(most: int, percent: int) -> list[int]:
    """Lower bounds of the size classes."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return out


def fragment_keys(found: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the fragments of a set, for its own size class and the class below."""
    n = len(found)
    bounds = size_classes(n, percent)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(found + np.uint64(1)), dtype=np.uint64)])
    keys = []
    for scheme in (own, own - 1):
        if scheme < 0:
            continue
        upper = bounds[scheme] * 100 // percent  # largest size of the class
        differ = upper * (100 - percent) // percent
        slack = 1 + differ // 40 if differ else 0
        parts = differ + 1 + slack
        edges = np.searchsorted(found, (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(np.uint64))
        edges = np.concatenate([[0], edges, [n]])
        empty = edges[1:] == edges[:-1]
        key = _mix((sums[edges[1:]] - sums[edges[:-1]]) ^ _mix(np.arange(parts, dtype=np.uint64) + np.uint64(scheme << 40)))
        keys.append(key if empty.sum() >= parts - differ else key[~empty])
    return np.concatenate(keys)


def _sets(batches, size: int):
    """(doc_id, set) per row, batch by batch."""
    for batch in byte_batches(batches, 1):
        yield batch.column(0), [shingle_set(t, size) for t in batch.column(1).to_pylist()]


def _nodes(size: int):
    def run(batches):
        for ids, sets in _sets(batches, size):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()), pa.array([parity(s) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "bits"])

    return run


def _by_bucket(values: np.ndarray, counts: np.ndarray, bucket: np.ndarray, buckets: int):
    """Per bucket: its number, the rows (places in ``counts``) that have values there, how many each, and the values' low bits."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(bucket, kind="stable")
    values, row, bucket = values[order].astype(np.uint32), row[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=bucket.dtype))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        rows, each = np.unique(row[cut[b] : cut[b + 1]], return_counts=True)
        yield b, rows, each.astype(np.uint32), values[cut[b] : cut[b + 1]]


def _packed_keys(size: int, percent: int, buckets: int):
    def run(batches):
        seen: set[int] = set()
        for _, sets in _sets(batches, size):
            nodes, sizes, keys = [], [], []
            for s in sets:
                if len(s) and (node := fingerprint(s)) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(len(s))
                    keys.append(fragment_keys(s, percent))
            if not nodes:
                continue
            node, n, key = np.array(nodes, dtype=np.int64), np.array(sizes, dtype=np.int32), np.concatenate(keys)
            rows = [(b, x.tobytes(), each.tobytes(), node[at].tobytes(), n[at].tobytes()) for b, at, each, x in _by_bucket(key, np.array([len(k) for k in keys]), (key >> np.uint64(32)) % np.uint64(buckets), buckets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "keys", "counts", "nodes", "sizes"])

    return run


def _unpacked(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype=kind)


def _lists(percent: int):
    """One bucket: all pairs of short lists; members of long lists with their key."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        key, each = _unpacked(table, "keys", np.uint32), _unpacked(table, "counts", np.uint32)
        node, n = np.repeat(_unpacked(table, "nodes", np.int64), each), np.repeat(_unpacked(table, "sizes", np.int32), each)
        often = np.zeros(len(key), dtype=bool)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        often[order[1:][same]] = often[order[:-1][same]] = True
        key, node, n = key[often], node[often], n[often]
        order = np.lexsort((node, n, key))
        key, node, n = key[order], node[order], n[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n = key[fresh], node[fresh], n[fresh]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]]))
        length = np.diff(np.concatenate([start, [len(key)]]))
        rank, of = np.arange(len(key)) - np.repeat(start, length), np.repeat(length, length)
        a, b = [], []
        for gap in range(1, ALL_PAIRS):
            at = np.flatnonzero((of <= ALL_PAIRS) & (rank + gap < of))
            a.append(at)
            b.append(at + gap)
        long = np.flatnonzero(of > ALL_PAIRS)
        a, b = np.concatenate(a), np.concatenate(b)
        fits = 100 * n[a].astype(np.int64) >= percent * n[b].astype(np.int64)
        pairs = np.unique(np.sort(np.stack([node[a[fits]], node[b[fits]]], axis=1), axis=1), axis=0) if fits.any() else np.zeros((0, 2), dtype=np.int64)
        return pa.table({"a": pa.array(np.concatenate([pairs[:, 0], node[long]])), "b": pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(long), pa.int64())]), "key": pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(key[long].astype(np.int64) | bucket << 32, pa.int64())])})

    return run


def _slots(values: np.ndarray, bits: int) -> np.ndarray:
    x = values.astype(np.int64).view(np.uint64)
    return np.stack([(_mix(x * odd) % np.uint64(bits)).astype(np.int64) for odd in _ODD[:4]])


def _passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _slots(values, 8 * len(table))
    return ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def row_filter(values: DataFrame, count: int) -> bytes:
    """Bloom filter of ROW_BITS bits for each of ``count`` (at most FILTER_ROWS) values of a long column, built by slices."""
    slices = 64
    width = -(-ROW_BITS * max(count, 1) // (8 * slices)) * 8
    bits = slices * width

    def fill(batches):
        for batch in batches:
            slot = np.unique(_slots(batch.column(0).to_numpy(zero_copy_only=False), bits))
            cut = np.searchsorted(slot, np.arange(slices + 1, dtype=np.int64) * width)
            some = np.flatnonzero(np.diff(cut)).tolist()
            yield pa.RecordBatch.from_pydict({"slice": pa.array(some, pa.int64()), "slots": pa.array([(slot[cut[i] : cut[i + 1]] - i * width).astype(np.int32).tobytes() for i in some], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        one = np.zeros(width, dtype=bool)
        for blob in table.column("slots").to_pylist():
            one[np.frombuffer(blob, dtype=np.int32)] = True
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.packbits(one).tobytes()], pa.binary())})

    out = np.zeros((slices, width // 8), dtype=np.uint8)
    for row in values.mapInArrow(fill, "slice long, slots binary").groupBy("slice").applyInArrow(merge, "slice long, bits binary").toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.tobytes()


def _rows_of(src: DataFrame, wanted: DataFrame):
    """The rows of ``src`` (doc_id, text) that stand for the nodes of ``wanted`` (node, low; staged), and perhaps more, and a
    broadcast filter of the nodes (None: there are too many)."""
    spark, count = src.sparkSession, wanted.count()
    if count > FILTER_ROWS:
        ids = wanted.select(F.col("low").alias("_low")).distinct()
        return src.join(ids, F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("_low"), "left_semi"), None
    rows, nodes = (spark.sparkContext.broadcast(row_filter(wanted.select(c), count)) for c in ("low", "node"))

    def run(batches):
        table = np.frombuffer(rows.value, dtype=np.uint8)
        for batch in byte_batches(batches, 1):
            yield batch.filter(pa.array(_passes(table, pc.fill_null(batch.column(0), _NO_ID).to_numpy(zero_copy_only=False))))

    return src.mapInArrow(run, "doc_id long, text string"), nodes


def _wanted_sets(batches, size: int, nodes):
    """(node, set) of the rows whose node the filter lets pass, once per node as far as a task remembers, batch by batch."""
    table, seen = np.frombuffer(nodes.value, dtype=np.uint8) if nodes else None, set()
    for _, sets in _sets(batches, size):
        full = [(fingerprint(s), s) for s in sets if len(s)]
        hit = _passes(table, np.array([f for f, _ in full], dtype=np.int64)) if nodes and full else np.ones(len(full), dtype=bool)
        if len(seen) > 200_000:
            seen.clear()
        out = []
        for (node, s), yes in zip(full, hit, strict=True):
            if yes and node not in seen:
                seen.add(node)
                out.append((node, s))
        if out:
            yield out


def _segments(size: int, nodes):
    def run(batches):
        edges = (np.arange(1, COUNTING, dtype=np.float64) / COUNTING * 2.0**64).astype(np.uint64)
        for sets in _wanted_sets(batches, size, nodes):
            rows = []
            for node, s in sets:
                cut = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
                rows += [(node, len(s), g, s[lo:hi].tobytes()) for g, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["node", "n", "fragment", "grams"])

    return run


def _packed_grams(size: int, nodes, ranges: int):
    """Grams of the wanted sets by range of the hash order, packed per batch."""
    width = np.uint64(2**64 // ranges + 1)

    def run(batches):
        for sets in _wanted_sets(batches, size, nodes):
            gram, node = np.concatenate([s for _, s in sets]), np.array([n for n, _ in sets], dtype=np.int64)
            for i, at, each, x in _by_bucket(gram, np.array([len(s) for _, s in sets]), gram // width, ranges):
                yield pa.RecordBatch.from_pydict({"range": pa.array([i], pa.int32()), "grams": pa.array([x.tobytes()], pa.binary()), "counts": pa.array([each.tobytes()], pa.binary()), "nodes": pa.array([node[at].tobytes()], pa.binary())})

    return run


def _unshared(buckets: int):
    """Per node the grams of this range that no other node has, packed by node bucket."""

    def run(table: pa.Table) -> pa.Table:
        gram, node = _unpacked(table, "grams", np.uint32), np.repeat(_unpacked(table, "nodes", np.int64), _unpacked(table, "counts", np.uint32))
        order = np.argsort(gram, kind="stable")
        gram, node = gram[order], node[order]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), dtype=bool), gram[1:] != gram[:-1]]))
        least, most = (f.reduceat(node, start) if len(start) else node for f in (np.minimum, np.maximum))
        found, alone = np.unique(least[least == most], return_counts=True)  # a gram of one node, however often its rows came
        bucket = found % buckets
        order = np.argsort(bucket, kind="stable")
        found, alone, bucket = found[order], alone[order].astype(np.int64), bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"bucket": pa.array(some, pa.int32()), "nodes": pa.array([found[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), "counts": pa.array([alone[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())})

    return run


def _added(table: pa.Table) -> pa.Table:
    """Counts of all ranges, added per node of a bucket."""
    nodes, counts = _unpacked(table, "nodes", np.int64), _unpacked(table, "counts", np.int64)
    found, at = np.unique(nodes, return_inverse=True)
    return pa.table({"node": pa.array(found, pa.int64()), "alone": pa.array(np.bincount(at, weights=counts).astype(np.int64), pa.int64())})


PARITY = 8


def parity(found: np.ndarray) -> list[int]:
    """Parity bitmap of a set: bit i tells whether an odd number of its grams falls to i. Two bitmaps differ in at most as
    many bits as the sets differ in grams."""
    odd = np.bincount((found & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _can_link(x: str, y: str, percent: int):
    """Exact bounds: sizes, grams that some other candidate has too, and bitmaps still allow the threshold."""
    at = lambda side, c: F.col(side + c)
    both = at(x, "n") + at(y, "n")
    differ = sum((F.bit_count(at(x, f"b{i}").bitwiseXOR(at(y, f"b{i}"))) for i in range(PARITY)), F.lit(0))
    return ((100 + percent) * F.least(at(x, "shared"), at(y, "shared")) >= percent * both) & (differ * (100 + percent) <= both * (100 - percent))


def _overlaps(batches):
    """Partial overlap of a pair in one fragment."""
    for batch in batches:
        left, right = (batch.column(i).to_pylist() for i in (5, 6))
        counts = [len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True)) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(counts, pa.int64())], names=["a", "b", "fragment", "na", "nb", "common"])


def verify(src: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b; staged) that link: partial overlaps per fragment, summed. ``reps``: node, low. The result is staged."""
    ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    wanted = staged(ends.join(reps, ends["a"] == reps["node"]).select("node", "low"), "wanted")
    rows, nodes = _rows_of(src, wanted)
    segments = staged(rows.mapInArrow(_segments(size, nodes), "node long, n long, fragment int, grams binary"), "segments")
    one = segments.select(F.col("node").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("gb"))
    other = segments.select(F.col("node").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga"))
    both = pairs.join(one, "b").join(other, ["a", "fragment"]).select("a", "b", "fragment", "na", "nb", "ga", "gb")
    parts = both.mapInArrow(_overlaps, "a long, b long, fragment int, na long, nb long, common long")
    parts = parts.groupBy("a", "b", "fragment").agg(*(F.max(c).alias(c) for c in ("common", "na", "nb")))  # equal where a set came twice
    sums = parts.groupBy("a", "b").agg(F.sum("common").alias("common"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    links = staged(sums.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "links")
    freed(segments, wanted)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for the nodes of ``edges`` (a, b; staged). The result is staged."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    total = max(1, labels.count())
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("m"))
        step = staged(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "m").alias("new"), "root"), "step")
        jump = step.groupBy("new").agg(F.count(F.lit(1)).alias("_n")).join(step.select(F.col("node").alias("new"), F.col("new").alias("up")), "new")
        after = staged(grouped_join(step, jump, "new", total).select("node", F.least("new", "up").alias("new"), "root"), "labels")
        changed = after.filter("new <> root").count()
        freed(step, labels)
        labels = after.select("node", F.col("new").alias("root"))
        labels._staged = after._staged
        if not changed:
            freed(both)
            return labels


def grouped_join(big: DataFrame, small: DataFrame, key: str, total: int) -> DataFrame:
    """Left join of ``small`` (one row per ``key``, with its number of rows in ``big`` as ``_n``): keys with over
    1/HEAVY_SHARE of all rows, fewer than HEAVY_SHARE of them, are broadcast; no other key can fill a task."""
    heavy, light = small.filter(F.col("_n") * HEAVY_SHARE > total), small.filter(F.col("_n") * HEAVY_SHARE <= total)
    marked = big.join(F.broadcast(heavy.select(F.col(key), F.lit(True).alias("_hot"), *(F.col(c).alias(f"_h_{c}") for c in small.columns if c not in (key, "_n")))), key, "left")
    values = [c for c in small.columns if c not in (key, "_n")]
    first = marked.filter("_hot").select(*big.columns, *(F.col(f"_h_{c}").alias(c) for c in values))
    rest = marked.filter("_hot IS NULL").select(*big.columns).join(light.drop("_n"), key, "left").select(*big.columns, *values)
    return first.unionByName(rest)


def _candidates(docs: DataFrame, size: int, percent: int):
    """src, nodes (staged), their rows, reps (node, low: the id of a row that stands for it), the pairs of short lists, the
    members of long ones with their bounds, and a function that keeps the pairs whose bounds reach the threshold."""
    spark = docs.sparkSession
    src = pick(docs, doc_id="long", text="string")
    sets = staged(src.mapInArrow(_nodes(size), "doc_id long, n_shingles long, node long, bits array<long>"), "nodes")
    nodes = sets.select("doc_id", "n_shingles", "node")
    rows, grams = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-grams * 2 * (100 - percent) // percent // BUCKET_KEYS))
    keys = src.mapInArrow(_packed_keys(size, percent, buckets), "bucket int, keys binary, counts binary, nodes binary, sizes binary")
    found = staged(keys.groupBy("bucket").applyInArrow(_lists(percent), "a long, b long, key long"), "lists")
    pairs = staged(found.filter("key IS NULL").select("a", "b").distinct(), "pairs")
    members = found.filter("key IS NOT NULL").select(F.col("a").alias("node"), "key")

    reps = staged(sets.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("low"), F.first("n_shingles").alias("n"), *(F.first(F.col("bits")[i]).alias(f"b{i}") for i in range(PARITY))), "reps")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.select("node")).distinct()
    wanted = staged(reps.join(ends, "node", "left_semi"), "wanted")
    picked, passed = _rows_of(src, wanted.select("node", "low"))
    ranges = max(least, -(-grams // RANGE_GRAMS))
    packed = picked.mapInArrow(_packed_grams(size, passed, ranges), "range int, grams binary, counts binary, nodes binary")
    alone = packed.groupBy("range").applyInArrow(_unshared(max(least, rows // 200_000 + 1)), "bucket int, nodes binary, counts binary").groupBy("bucket").applyInArrow(_added, "node long, alone long")
    stats = wanted.drop("low").join(alone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    stats = staged(stats.filter(100 * F.col("shared") >= percent * F.col("n")), "stats")  # the others link with nothing

    def allowed(pairs: DataFrame) -> DataFrame:
        sa, sb = (stats.select(*(F.col(c).alias(side + c) for c in stats.columns)) for side in ("a_", "b_"))
        both = pairs.join(sa, F.col("a") == F.col("a_node")).join(sb, F.col("b") == F.col("b_node"))
        return both.filter(_can_link("a_", "b_", percent)).select("a", "b")

    long = staged(members.join(stats, "node"), "members")
    freed(found, wanted)
    return src, nodes, rows, reps.select("node", "low"), pairs, long, allowed


def _in_cells(members: DataFrame) -> tuple[DataFrame, DataFrame, object]:
    """Two sides of a list joined with itself: it is dealt to cells of at most about LIST_CELL x LIST_CELL pairs, so none is
    paired in one task. ``members``: key, node and more."""
    cells = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / LIST_CELL).alias("_cells"))
    dealt = members.join(cells, "key").withColumn("_cell", F.pmod(F.xxhash64("node"), F.col("_cells")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cells") - 1))
    x, y = dealt.withColumn("_other", every).alias("x"), dealt.withColumn("_other", every).alias("y")
    return x, y, (F.col("x.key") == F.col("y.key")) & (F.col("x._cell") == F.col("y._other")) & (F.col("x._other") == F.col("y._cell"))


def jaccard_links(docs: DataFrame, size: int = SHINGLE, percent: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The join itself: all links a, b (a < b) between different sets, and doc_id, n_shingles, node for every row of ``docs``.
    Rows with one node link with each other. The pairs of a long list pass the exact bounds before they are verified."""
    src, nodes, _, reps, pairs, members, allowed = _candidates(docs, size, percent)
    x, y, same = _in_cells(members)
    long = x.join(y, same & (F.col("x.node") < F.col("y.node")) & _can_link("x.", "y.", percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    return verify(src, staged(allowed(pairs).unionByName(long).distinct(), "pairs"), reps, size, percent), nodes


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, node, component_id for every row of ``docs`` (doc_id, text)."""
    src, nodes, rows, reps, pairs, members, allowed = _candidates(docs, size, percent)
    hubs = members.groupBy("key").agg(F.min_by("node", F.struct((1 - F.col("shared") / F.col("n")).alias("own"), "node")).alias("hub"))  # the set with the least of its own
    stars = members.join(hubs, "key").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    chosen = staged(allowed(pairs.unionByName(stars).distinct()), "pairs")
    freed(pairs)
    edges = verify(src, chosen, reps, size, percent)
    labels = components(edges)

    # long lists whose sets are not all in one component yet: the pairs between components
    placed = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    left = staged(placed.join(open_keys, "key", "left_semi"), "open")
    if left.take(1):
        x, y, same = _in_cells(left)
        cross = x.join(y, same & (F.col("x.root") < F.col("y.root")) & _can_link("x.", "y.", percent))
        more = cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        more = staged(more.join(chosen, ["a", "b"], "left_anti"), "pairs")
        links = verify(src, more, reps, size, percent)
        if links.take(1):
            edges = edges.unionByName(links)
            freed(labels)
            labels = components(edges)

    per_node = nodes.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("low"))
    rooted = staged(per_node.join(labels, "node", "left").select("node", "_n", "low", F.coalesce("root", "node").alias("root")), "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    by_node = staged(grouped_join(rooted.withColumnRenamed("_n", "_rows"), lowest, "root", max(1, rows)).select("node", "component_id", F.col("_rows").alias("_n")), "by_node")
    freed(left, members, chosen, labels, rooted)
    full, bare = nodes.filter("node IS NOT NULL"), nodes.filter("node IS NULL")
    out = grouped_join(full, by_node, "node", max(1, rows)).select("doc_id", "n_shingles", "node", "component_id")
    return out.unionByName(bare.select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id")))


def one_per_component(docs: DataFrame, size: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component; rows that repeat that id stay together."""
    keep = jaccard_components(docs, size, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    row = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"))
    return row.join(keep, row["_row.doc_id"].cast("long").eqNullSafe(keep["doc_id"]), "left_semi").select("_row.*")


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: list_slice(w, i, i + 3))) END AS g FROM w),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
df AS (SELECT g FROM t GROUP BY g HAVING count(*) > 1),
sizes AS (SELECT doc_id, len(g) AS n FROM s),
u AS (SELECT t.doc_id, t.g, n FROM t JOIN df USING (g) JOIN sizes USING (doc_id)),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, two.b FROM reach JOIN two ON reach.y = two.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, (SELECT min(y) FROM reach WHERE x = s.doc_id) AS component_id FROM s
"""
