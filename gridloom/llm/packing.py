"""Operator 5: pack tokenised documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one tail shorter than a sequence. The tails are the items of a cutting
stock problem over their length histogram (at most SEQUENCE - 1 lengths, whatever the corpus): a linear program over
patterns (multisets of lengths that fit) is solved by the revised simplex method, and an unbounded-knapsack dynamic
program prices new patterns from the duals. Pattern counts are rounded down. Tails are ranked within their length and the
ranks are dealt to the slots of the patterns that fill a sequence exactly; all other tails form one stream in the order of
(length, rank) that is cut every SEQUENCE tokens. So only the very last sequence is padded.

Nothing is sorted globally: a tail's rank is its rank in its partition plus the counts of the partitions before it, and
the plan is a table of a few thousand rows.

Cases: null text is empty, so the document is its end id alone; repeated rows and ids are separate documents; extra
columns are left behind; an empty table gives no pieces.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import lookup_join, pick, staged
from gridloom.llm.tokens import SLICE, binary_array, byte_batches, encoder

SEQUENCE = 1024
END_ID = 0
#: 32 bits, so that pieces can be cut and their checksums taken by SQL functions.
DTYPE = "<u4"
#: Column generation ends when the sequences are within this share of the lower bound.
GAP = 1e-3
STALL = 12
#: What a tail costs that is left to the stream, in shares of a sequence.
LOOSE = 1.02
#: How far prices are drawn from the duals towards length / size.
DRAW = 0.5


def tokenised(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """part, fulls_before, doc_id, doc_tokens, tail, tail_rank (within part and length), full_ids, tail_ids."""

    def run(batches):
        from pyspark import TaskContext

        enc, part = encoder(tokenizer, DTYPE, True), TaskContext.get().partitionId()
        seen, before = np.zeros(size, dtype=np.int64), 0
        for batch in byte_batches(batches, 1, SLICE):
            ids, n = enc.encode_ended(batch.column(1), end_id)
            tail, fulls = n % size, n // size
            order = np.argsort(tail, kind="stable")
            place = np.empty(len(n), dtype=np.int64)
            place[order] = np.arange(len(n)) - np.searchsorted(tail[order], tail[order])
            cut = binary_array(ids, np.stack([n - tail, tail], axis=1).ravel())
            even = np.arange(0, 2 * len(n), 2)
            columns = (np.full(len(n), part, dtype=np.int32), before + np.cumsum(fulls) - fulls, batch.column(0), n, tail.astype(np.int32), seen[tail] + place, cut.take(pa.array(even)), cut.take(pa.array(even + 1)))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["part", "fulls_before", "doc_id", "doc_tokens", "tail", "tail_rank", "full_ids", "tail_ids"])
            before += int(fulls.sum())
            seen += np.bincount(tail, minlength=size)

    kind = "part int, fulls_before long, doc_id long, doc_tokens long, tail int, tail_rank long, full_ids binary, tail_ids binary"
    return pick(docs, doc_id="long", text="string").mapInArrow(run, kind)


def _price(lengths: np.ndarray, worth: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over all capacities: best value per room, and the item that reached it (-1: none)."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(1, size + 1):
        best[room] = best[room - 1]
        k = int(np.searchsorted(lengths, room, side="right"))
        if k:
            gains = best[room - lengths[:k]] + worth[:k]
            j = int(np.argmax(gains))
            if gains[j] > best[room] + 1e-12:
                best[room], last[room] = gains[j], j
    return best, last


def _pattern(lengths: np.ndarray, last: np.ndarray, size: int, first: int) -> dict[int, int]:
    """The best pattern that holds item ``first``: {index: copies}."""
    found, room = defaultdict(int), size - int(lengths[first])
    found[first] = 1
    while room > 0:
        j = int(last[room])
        room -= int(lengths[j]) if j >= 0 else 1
        if j >= 0:
            found[j] += 1
    return dict(found)


def _fill(have: np.ndarray, room: int, least: float) -> dict[int, int] | None:
    """Up to three lengths of ``have`` (amount per length) that add up to ``room``, as plentiful as can be; ``least`` each."""
    if room == 0:
        return {}
    best, found = 0.0, None
    if have[room] >= least:
        best, found = have[room], {room: 1}

    def pair(room: int, have: np.ndarray) -> tuple[float, int]:
        a = np.arange(1, room // 2 + 1)
        amount = np.minimum(have[a], have[room - a])
        if room % 2 == 0 and len(a):
            amount[-1] = have[room // 2] / 2
        i = int(np.argmax(amount)) if len(a) else 0
        return (float(amount[i]), int(a[i])) if len(a) else (0.0, 0)

    amount, a = pair(room, have)
    if amount >= max(least, best * 1.01):
        best, found = amount, ({a: 2} if 2 * a == room else {a: 1, room - a: 1})
    if found is None:
        plenty = np.flatnonzero(have[:room] >= 2 * least)
        for c in plenty[np.argsort(-have[plenty], kind="stable")][:16].tolist():
            left = have.copy()
            left[c] -= least
            amount, a = pair(room - c, left)
            if amount >= least and min(amount, have[c] / 2) > best:
                best, found = min(amount, have[c] / 2), {}
                for x in (a, room - c - a, c):
                    found[x] = found.get(x, 0) + 1
    return found


def _greedy(need: dict[int, float], size: int, whole: bool, waste: int) -> list[tuple[dict[int, int], float, int]]:
    """Patterns for ``need``, from the longest length on: (pattern, uses, a length that is used up). ``whole``: whole uses of
    patterns with at most ``waste`` unfilled tokens; lengths for which there is none are left over."""
    have, out = np.zeros(size + 1), []
    for x, n in need.items():
        have[x] = n
    least = 1.0 if whole else 1e-9
    while len(some := np.flatnonzero(have > (0.5 if whole else 0))):
        longest = int(some[-1])
        found = None
        for w in range(waste + 1):
            for k in range(max(1, -(-(size - w) // longest) - 3), (size - w) // longest + 1):  # at most three more fit the rest
                if have[longest] < k * least:
                    break
                left = have.copy()
                left[longest] = max(0.0, left[longest] / k - 1) if whole else 0.0
                more = _fill(left, size - w - k * longest, least)
                if more is not None:
                    found = {longest: k}
                    for x, n in more.items():
                        found[x] = found.get(x, 0) + n
                    break
            if found and all(have[x] >= n * least for x, n in found.items()):
                break
            found = None
        if found is None:
            if whole:
                have[longest] = 0
                continue
            found = {longest: size // longest}
        uses, last = min((have[x] / n, x) for x, n in found.items())
        uses = float(int(uses + 1e-9)) if whole else uses
        for x, n in found.items():
            have[x] = max(0.0, have[x] - uses * n)
        if not whole:
            have[last] = 0
        out.append((found, uses, last))
    return out


def patterns(histogram: dict[int, int], size: int = SEQUENCE, gap: float = GAP) -> list[tuple[dict[int, int], float]]:
    """The linear program's patterns ({length: copies}, uses). Driver work over at most ``size`` - 1 lengths.

    A tail may be left to the stream at LOOSE times its share of a sequence; these are the first basis. So no price exceeds
    LOOSE * length / size, and prices stay near the duals' final values from the start. A greedy cover enters first; then
    every pricing yields a pattern for each length, and those that pay under the present duals enter. Prices are the duals
    drawn towards length / size, or where these find nothing the duals themselves; it ends within ``gap`` of the lower
    bound, when no pattern pays, or when STALL pricings in a row have saved less than ``gap``."""
    lengths = np.array(sorted(histogram))
    if not len(lengths):
        return []
    need = np.array([histogram[x] for x in lengths.tolist()], dtype=float)
    place, ideal = {x: i for i, x in enumerate(lengths.tolist())}, lengths / size
    basis: list[dict | None] = [None] * len(lengths)
    cost, inverse, uses = LOOSE * ideal, np.eye(len(lengths)), need.copy()
    duals, bound, draw, path = cost.copy(), 0.0, DRAW, []

    def enter(column: dict[int, int]) -> bool:
        nonlocal uses, inverse, duals
        at, copies = np.array(list(column)), np.array(list(column.values()), dtype=float)
        saving = duals[at] @ copies - 1
        if saving <= 1e-7:
            return False
        direction = inverse[:, at] @ copies
        ratio = np.where(direction > 1e-9, uses / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            return False
        uses = np.maximum(0.0, uses - ratio[out] * direction)
        uses[out] = ratio[out]
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        duals = duals - saving * row
        basis[out], cost[out] = column, 1.0
        return True

    for pattern, _, _ in _greedy(histogram, size, False, size // 128):
        enter({place[x]: k for x, k in pattern.items()})
    while True:
        duals = cost @ inverse
        worth = draw * ideal + (1 - draw) * duals
        best, last = _price(lengths, worth, size)
        bound = max(bound, need @ worth / max(1.0, best[size]))
        path.append(float(cost @ uses))
        if path[-1] <= bound * (1 + gap) or (len(path) > STALL and path[-1 - STALL] - path[-1] < gap * path[-1]):
            break
        entered = sum(enter(_pattern(lengths, last, size, first)) for first in range(len(lengths) - 1, -1, -1))
        if not entered and draw == 0:
            break
        draw = DRAW if entered else 0.0
    return [({int(lengths[i]): k for i, k in b.items()}, float(u)) for b, u in zip(basis, uses, strict=True) if b and u > 0]


def slots(histogram: dict[int, int], size: int = SEQUENCE, gap: float = GAP) -> tuple[list[tuple], list[tuple], int, int]:
    """(length, first_rank, end_rank, copies, first_sequence, offset) rows; (length, first_loose_rank, stream_start) rows;
    sequences of patterns; sequences of the stream.

    Uses are rounded down; what that leaves is covered greedily by whole patterns. Patterns may leave size / 128 unfilled."""
    used, table, sequences = defaultdict(int), [], 0

    def assign(pattern: dict[int, int], times: int) -> None:
        nonlocal sequences
        times = min([times, *((histogram[x] - used[x]) // k for x, k in pattern.items())])
        if times <= 0:
            return
        offset = 0
        for x, k in sorted(pattern.items(), reverse=True):
            table.append((x, used[x], used[x] + times * k, k, sequences, offset))
            used[x] += times * k
            offset += x * k
        sequences += times

    for pattern, uses in sorted(patterns(histogram, size, gap), key=lambda p: sorted(p[0].items(), reverse=True)):
        if size - sum(x * k for x, k in pattern.items()) <= size // 128:
            assign(pattern, int(uses + 1e-6))
    for pattern, uses, _ in _greedy({x: n - used[x] for x, n in histogram.items()}, size, True, size // 128):
        assign(pattern, int(uses))
    loose, start = [], 0
    for x in sorted(histogram):
        loose.append((x, used[x], start))
        start += (histogram[x] - used[x]) * x
    return table, loose, sequences, -(-start // size)


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    spark, width = docs.sparkSession, np.dtype(DTYPE).itemsize
    tokens = staged(tokenised(docs, tokenizer, size, end_id), "tokens")
    counts = staged(tokens.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("doc_tokens") / size)).alias("fulls")), "counts")
    histogram = {r["tail"]: r["n"] for r in counts.filter("tail > 0").groupBy("tail").agg(F.sum("n").alias("n")).collect()}  # fewer than ``size`` rows
    table, loose, n_pattern, n_stream = slots(histogram, size)
    slot = spark.createDataFrame(table or [(-1, 0, 0, 1, 0, 0)], "s_len int, s_first long, s_end long, s_copies long, s_seq long, s_off long")
    free = spark.createDataFrame(loose or [(-1, 0, 0)], "f_len int, f_first long, f_start long")
    before = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = staged(counts.filter("tail > 0").select("part", "tail", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")), "ranks")
    parts = counts.groupBy("part").agg(F.sum("fulls").alias("fulls"))
    parts = staged(parts.select("part", (F.coalesce(F.sum("fulls").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + n_pattern + n_stream).alias("_seq0")), "parts")

    whole = lookup_join(tokens.filter(F.col("doc_tokens") >= size).select("part", "fulls_before", "doc_id", "doc_tokens", "full_ids"), parts, "part")
    whole = whole.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("doc_tokens") / size) - 1)))
    full = whole.select("doc_id", (F.col("_k") * size).alias("start"), F.lit(size).cast("long").alias("length"), "doc_tokens", (F.col("_seq0") + F.col("fulls_before") + F.col("_k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.substring("full_ids", (F.col("_k") * size * width + 1).cast("int"), F.lit(size * width)).alias("ids"))

    tails = tokens.filter("tail > 0").select("part", "tail", "tail_rank", "doc_id", "doc_tokens", "tail_ids").join(ranks, ["part", "tail"]).withColumn("_rank", F.col("_base") + F.col("tail_rank"))
    tails = tails.join(F.broadcast(slot), (F.col("tail") == F.col("s_len")) & (F.col("_rank") >= F.col("s_first")) & (F.col("_rank") < F.col("s_end")), "left")
    tails = tails.join(F.broadcast(free), F.col("tail") == F.col("f_len"), "left")
    length, at = F.col("tail").cast("long"), F.col("_rank") - F.col("s_first")
    fixed = F.struct(F.lit(0).cast("long").alias("from"), length.alias("length"), (F.col("s_seq") + F.floor(at / F.col("s_copies"))).alias("seq"), (F.col("s_off") + F.pmod(at, F.col("s_copies")) * length).alias("offset"))
    pos = F.col("f_start") + (F.col("_rank") - F.col("f_first")) * length
    first, room = F.floor(pos / size), size - F.pmod(pos, F.lit(size))
    head = F.struct(F.lit(0).cast("long").alias("from"), F.least(length, room).alias("length"), (n_pattern + first).alias("seq"), F.pmod(pos, F.lit(size)).alias("offset"))
    rest = F.struct(room.alias("from"), (length - room).alias("length"), (n_pattern + first + 1).alias("seq"), F.lit(0).cast("long").alias("offset"))
    pieces = F.when(F.col("s_len").isNotNull(), F.array(fixed)).when(length > room, F.array(head, rest)).otherwise(F.array(head))
    cut = tails.withColumn("_p", F.explode(pieces))
    tail = cut.select("doc_id", (F.col("doc_tokens") - length + F.col("_p.from")).alias("start"), F.col("_p.length").alias("length"), "doc_tokens", F.col("_p.seq").alias("sequence_id"), F.col("_p.offset").alias("offset"), F.substring("tail_ids", (F.col("_p.from") * width + 1).cast("int"), (F.col("_p.length") * width).cast("int")).alias("ids"))
    return full.unionByName(tail)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_pack_sequences(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))
