"""Operator 11: vector codes by product quantisation, fitted with active-entry Lloyd rounds.

Components become integers floor(SCALE * x); a vector is cut into PARTS consecutive parts and each part position has a
codebook of at most ENTRIES entries. A round assigns every part to its nearest entry (squared Euclidean distance, ties to
the lower index) and replaces each used entry by the floored mean of its parts.

Active entries: a part keeps its entry and the exact distance to it. Where that entry did not move in the last update, no
other entry that stayed can have become nearer, so the part is compared with the entries that moved only; where it moved,
the part is compared with all. Ties go to the lower index either way, so codes equal those of a whole scan.

The vectors with their codes and distances are one table per round, written to the shared folder; the table before it is
deleted once its successor exists. Tasks sum the parts of an entry before anything is shuffled, so an update moves at most
PARTS * ENTRIES rows per task and brings as many sums to the driver. Codebooks (PARTS * ENTRIES parts) go out with the task.

Cases: rows whose vector is null or holds null, NaN or infinite components are dropped, and so are vectors of another length
than that of the smallest kept id, empty ones, and components of LIMIT or more (their squares leave 64 bits). A length that
PARTS does not divide is cut as evenly as possible. Null ids come last; rows of one id, in order of their components, are
rows of their own. Fewer rows than ENTRIES make a smaller codebook; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import freed, lookup_join, pick, staged

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LIMIT = float(2**15)
#: Rows that are compared with a codebook at a time.
ROWS = 2048


def bounds(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(i * dim // parts, (i + 1) * dim // parts) for i in range(parts)]


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows; by matrix product where doubles hold every sum exactly."""
    reach = (int(np.abs(x).max(initial=0)) + int(np.abs(entries).max(initial=0))) ** 2 * max(x.shape[1], 1)
    if reach < 2**52:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its distance, all entries compared."""
    d = squared(x, book)
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


def reassign(x: np.ndarray, code: np.ndarray, dist: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries after an update: ``moved`` tells the entries that changed, ``dist`` is exact for those that did not."""
    code, dist = code.copy(), dist.copy()
    active = np.flatnonzero(moved)
    if not len(active):
        return code, dist
    lost = moved[code]
    stay = np.flatnonzero(~lost)
    if len(stay):
        near, d = scan(x[stay], book[active])
        near = active[near]
        better = (d < dist[stay]) | ((d == dist[stay]) & (near < code[stay]))
        code[stay[better]], dist[stay[better]] = near[better], d[better]
    if lost.any():
        code[lost], dist[lost] = scan(x[lost], book)
    return code, dist


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), kind))


_STATE = "vec_id long, label string, x array<int>, code array<int>, dist array<long>"


def _assigning(books: list[np.ndarray], moved: list[np.ndarray] | None, cuts: list[tuple[int, int]]):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = _matrix(batch.column(2), np.int64)
                if moved:
                    old, far = _matrix(batch.column(3), np.int64), _matrix(batch.column(4), np.int64)
                    found = [reassign(x[:, a:b], old[:, p], far[:, p], books[p], moved[p]) for p, (a, b) in enumerate(cuts)]
                else:
                    found = [scan(x[:, a:b], books[p]) for p, (a, b) in enumerate(cuts)]
                code, dist = (np.stack([f[i] for f in found], axis=1) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _lists(code, pa.int32()), _lists(dist, pa.int64())], names=["vec_id", "label", "x", "code", "dist"])

    return run


def _summing(entries: int, cuts: list[tuple[int, int]]):
    """Per task one row for each part and used entry: the number of its parts and their sums."""

    def run(batches):
        n = np.zeros((len(cuts), entries), dtype=np.int64)
        sums = [np.zeros((entries, b - a), dtype=np.int64) for a, b in cuts]
        for batch in batches:
            x, code = _matrix(batch.column(0), np.int64), _matrix(batch.column(1), np.int64)
            for p, (a, b) in enumerate(cuts):
                order = np.argsort(code[:, p], kind="stable")
                used, first = np.unique(code[order, p], return_index=True)
                n[p, used] += np.diff(np.append(first, len(order)))
                if b > a:
                    sums[p][used] += np.add.reduceat(x[order, a:b], first, axis=0)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array([sums[p][e].tolist() for p, e in zip(part, entry, strict=True)], pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    return run


def integers(rows: DataFrame) -> DataFrame:
    """vec_id, label, x: the kept vectors as integers."""
    d = pick(rows, vec_id="long", label="string", embedding="array<double>")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT))
    return d.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).select("vec_id", "label", F.transform("embedding", lambda c: F.floor(c * SCALE).cast("int")).alias("x"))


def fit_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The kept rows (vec_id, label, x, code, dist), staged, and the final codebooks. ``entries`` at most 2^31 / parts."""
    kept = staged(integers(rows), "vectors")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x").alias("n")).first()
    dim = first["n"] if first else 0
    cuts = bounds(dim, parts)
    same = kept.filter(F.size("x") == dim)
    start = [r["x"] for r in same.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()]  # at most ``entries`` rows
    books = [np.array(start, dtype=np.int64).reshape(len(start), dim)[:, a:b] for a, b in cuts]
    state = staged(same.mapInArrow(_assigning(books, None, cuts), _STATE), "codes")
    freed(kept)
    for _ in range(rounds):
        tasks = state.select("x", "code").mapInArrow(_summing(len(start), cuts), "part int, entry int, n long, s array<long>")
        counts = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(max(b - a for a, b in cuts))))
        new = [b.copy() for b in books]
        for r in counts.collect():  # at most parts * entries rows
            a, b = cuts[r["part"]]
            new[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(b - a)]
        moved = [(o != n).any(axis=1) for o, n in zip(books, new, strict=True)]
        books, before = new, state
        state = staged(state.mapInArrow(_assigning(books, moved, cuts), _STATE), "codes")
        freed(before)
    return state, books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    state, books = fit_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    two = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, v: a + v)
    out = state.select("vec_id", "label", two.alias("code"), error.alias("error"))
    per = staged(out.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    return lookup_join(out, per, "label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    dist = "list_dot_product(t.x, t.x) + list_dot_product(b.x, b.x) - 2 * list_dot_product(t.x, b.x)"
    steps = [
        f"""WITH q AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(CAST(c AS DOUBLE) * {SCALE}) AS DOUBLE) FOR c IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
t AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM q, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM t) WHERE e < {ENTRIES})"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, min({{'d': d, 'e': e}}) AS m FROM (SELECT t.vec_id, t.p, b.e, {dist} AS d FROM t JOIN b{k} b USING (p)) GROUP BY vec_id, p)")
        if k < ROUNDS:
            steps.append(f"""u{k} AS MATERIALIZED (SELECT p, e, list(f ORDER BY i) AS x FROM (SELECT t.p, a.m.e AS e, i, floor(sum(t.x[i]) / count(*)) AS f FROM t JOIN a{k} a USING (vec_id, p), LATERAL (SELECT unnest(range(1, len(t.x) + 1)) AS i) GROUP BY ALL) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.x, b.x) AS x FROM b{k} b LEFT JOIN u{k} u ON u.p = b.p AND u.e = b.e)""")
    return (
        ",\n".join(steps)
        + f""",
c AS (SELECT vec_id, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
h AS (SELECT sha256(string_agg([CAST(CAST(y AS BIGINT) AS VARCHAR) FOR y IN x].array_to_string(','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN q USING (vec_id), h"""
    )


ORACLE = _oracle()
