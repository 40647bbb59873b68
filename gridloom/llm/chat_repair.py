r"""Operator 12: conversation structure repair by a cost DP and prefix-doubling path ranking.

Rows are judged in order of their turn: blank, duplicate (role and text seen earlier in the conversation) or truncated. The
cheapest edits are searched that make the role initials read ``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 2, Delete 3
(the only edit of a blank or duplicate row), Insert an empty user or assistant text 2; a truncated row that is not deleted
adds 1. Of equally cheap edits the initials that are least in ASCII order win (``D < I < K < R``).

A node is (row, state) with the states start, after system, after user, after assistant. The DP gives each node its cost to
the end; an arc is optimal if it keeps that cost. Nodes are ranked by the least letter of their optimal arcs and then by
audits of 2, 4, 8 ... letters: the rank over twice the length is the rank of (own rank, rank of the node that the pointer
reaches), and pointers double. Nodes that have ended rank first. A node has at most one arc for a letter, so the rank at
length 1 picks its arc for good; the doubled pointers then list the nodes of the least path, all places at once.

Scale: rows are range-partitioned by (conversation, turn), without their texts, and cut into tiles of TILE rows; so a
conversation of any length is many tasks. A tile's part of a conversation (a segment) folds to a 4 x 4 min-plus matrix; the
costs behind each segment are chained over one row per segment; then each segment ranks its nodes and lists its audit for each
state in which it may be entered. Copies are found by one pre-aggregated count per (conversation, role, SHA-256 of the text)
and a join that adaptive execution may split. The digest of a repaired conversation is one SHA-256 chain: its texts stream
through one task in order, batch by batch, and its audit is one value.

Cases: nulls in role and text count as one space, null turns come first (and as one space in the damage key), null
conversation ids form one conversation; rows with one turn are ordered by role and SHA-256 of the text, repeated rows are
duplicates; roles with another initial than s, u, a cannot be kept; a conversation without rows has zeros, an empty audit and
the hash of nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pick, staged

#: Rows of a tile; a power of two that divides the rows of a partition in monotonically_increasing_id.
TILE = 4096
#: Rows that are folded or ranked at once, but for one longer segment; ranking takes some 1.3 kB a row.
ROWS = 1 << 15
#: Tiles of a partition that ranks them. Their bytes, by which adaptive execution merges partitions, say little of the work.
TILES = 64
SPACES = " \t\n\x0b\x0c\r"
DELETE, RETYPE, INSERT, CUT = 3, 2, 2, 1
#: State after an inserted or reroled turn, by the state before: start, system, user, assistant.
ADDED = np.array([2, 2, 3, 2])
#: State after a kept turn with initial s, u, a or another one; -1: not allowed.
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
LETTERS = "DIKR"
FAR = 1 << 40
#: A row's code is 3 * initial + fault (0 none, 1 truncated, 2 blank or duplicate); END stands behind a conversation's last row.
END = 12


def _transitions() -> np.ndarray:
    """Least cost from (row, state) to (row + 1, state) by code; at END to state 0, which is the end."""
    out = np.full((13, 4, 4), FAR, dtype=np.int64)
    for code in range(12):
        initial, fault = divmod(code, 3)
        for q in range(4):
            out[code, q, q] = DELETE
            if fault < 2:
                out[code, q, ADDED[q]] = min(out[code, q, ADDED[q]], RETYPE + fault * CUT)
                if KEPT[q, initial] >= 0:
                    out[code, q, KEPT[q, initial]] = min(out[code, q, KEPT[q, initial]], fault * CUT)
    out[END, [0, 3], 0] = 0
    for _ in range(3):  # turns inserted before the row
        out = np.minimum(out, INSERT + out[:, ADDED, :])
    return np.minimum(out, FAR)


COSTS = _transitions()


def fold(codes: list[np.ndarray]) -> np.ndarray:
    """Min-plus products of the segments' transitions, all segments in step."""
    order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
    out = np.full((len(codes), 4, 4), FAR, dtype=np.int64)
    out[:, range(4), range(4)] = 0
    for t in range(len(codes[order[0]]) if order else 0):
        while len(codes[order[-1]]) <= t:
            order.pop()
        now = COSTS[[codes[i][t] for i in order]]
        out[order] = np.minimum(FAR, (out[order][:, :, :, None] + now[:, None, :, :]).min(2))
    return out


def _costs_to_go(flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Cost of every node; a segment's positions end with one for what lies behind it."""
    cost = np.zeros((len(flat), 4), dtype=np.int64)
    cost[ends] = ahead
    order = np.argsort(-sizes, kind="stable")
    sizes, ends = sizes[order], ends[order]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        at = ends[: int(np.searchsorted(-sizes, -t, side="left"))] - 1 - t
        cost[at] = (COSTS[flat[at]] + cost[at + 1][:, None, :]).min(2)
    return cost


def least_paths(codes: list[np.ndarray], ahead: np.ndarray) -> list[tuple[list[int], list[str]]]:
    """For each segment, by state at its entry: the state at its exit and the least audit of its optimal arcs. ``ahead``: costs
    behind the segments. Codes may end with END."""
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    flat = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    inside = np.ones(len(flat), dtype=bool)
    inside[ends] = False
    flat[inside] = np.concatenate(codes) if codes else []
    cost = _costs_to_go(flat, ends, sizes, ahead)
    place, state = np.repeat(np.arange(len(flat)), 4), np.tile(np.arange(4), len(flat))
    nodes, after = place * 4 + state, np.minimum(place + 1, len(flat) - 1)
    initial, fault, row = flat[place] // 3, flat[place] % 3, inside[place] & (flat[place] < END)
    own, keeps = cost[place, state], KEPT[state, np.minimum(initial, 3)]
    free = row & (fault < 2)
    arcs = [  # in order of LETTERS: may be taken, cost of the edit, row and state it leads to
        (row, DELETE, after, state),
        (inside[place], INSERT, place, ADDED[state]),
        (free & (keeps >= 0), fault * CUT, after, np.maximum(keeps, 0)),
        (free, RETYPE + fault * CUT, after, ADDED[state]),
    ]
    rank, point = np.zeros(len(nodes), dtype=np.int64), nodes.copy()
    for letter in range(len(LETTERS), 0, -1):  # the least letter is written last
        may, paid, to, then = arcs[letter - 1]
        best = may & (own == paid + cost[to, then])
        rank[best], point[best] = letter, to[best] * 4 + then[best]
    letters, doubled = rank, [point]
    while True:
        pairs = rank * (int(rank.max(initial=0)) + 1) + rank[point]
        if (letters[point] == 0).all():  # every pointer has reached an end: the ranks are those of whole audits
            break
        rank = np.unique(pairs, return_inverse=True)[1]
        point = point[point]
        doubled.append(point)
    first = (ends - sizes)[:, None] * 4 + np.arange(4)
    start = first.ravel()
    length, at = np.zeros(len(start), dtype=np.int64), start.copy()
    for k in range(len(doubled) - 1, -1, -1):
        go = letters[doubled[k][at]] > 0
        at, length = np.where(go, doubled[k][at], at), length + (go.astype(np.int64) << k)
    length += letters[at] > 0
    leave = np.where(letters[at] > 0, doubled[0][at], at) % 4
    whole = np.cumsum(length)
    step = np.arange(int(whole[-1]) if len(whole) else 0) - np.repeat(whole - length, length)
    at = np.repeat(start, length)
    for k, to in enumerate(doubled):
        at = np.where(step >> k & 1, to[at], at)
    text = np.frombuffer(b"?" + LETTERS.encode(), dtype=np.uint8)[letters[at]].tobytes().decode()
    out = []
    for s in range(len(codes)):
        pieces = range(4 * s, 4 * s + 4)
        out.append((leave[4 * s : 4 * s + 4].tolist(), [text[whole[i] - length[i] : whole[i]] for i in pieces]))
    return out


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows of the query, damaged by crc32 of ``conv_id:turn``; dropped ones are ``gone``."""
    d = pick(rows, conv_id="long", turn="long", role="string", text="string").fillna(" ", ["role", "text"])
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = d.withColumn("_k", F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20)
    d = d.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1))))
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_k") == 0).alias("gone"))


def _judged(rows: DataFrame) -> DataFrame:
    """Rows without texts, in order: idx, and code before duplicates are known."""
    last = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    initial = F.element_at(F.array(*(F.lit(i) for i in (0, 1, 2, 3))), F.when(F.startswith("role", F.lit("s")), 1).when(F.startswith("role", F.lit("u")), 2).when(F.startswith("role", F.lit("a")), 3).otherwise(4))
    slim = rows.select("conv_id", "turn", "role", "gone", F.unhex(F.sha2("text", 256)).alias("h"), initial.alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("_tie"))
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h").asc(), F.col("_tie").asc()]
    return staged(slim.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("idx", F.monotonically_increasing_id()).drop("_tie"), "ordered")


def _segments(ordered: DataFrame) -> DataFrame:
    """One row per conversation and tile: codes (a letter per row), numbers of faults, first and last turn, distinct turns."""
    here = ~F.col("gone")
    copies = ordered.filter(here & ~F.col("blank")).groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("h").alias("_h")).agg(F.min("idx").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    d = ordered.join(copies, ordered["conv_id"].eqNullSafe(F.col("_c")) & (ordered["role"] == F.col("_r")) & (ordered["h"] == F.col("_h")), "left")
    dup = ~F.col("blank") & F.coalesce(F.col("idx") > F.col("_first"), F.lit(False))
    cut = ~F.col("blank") & ~dup & F.col("open")
    code = 3 * F.col("initial") + F.when(F.col("blank") | dup, 2).when(cut, 1).otherwise(0)
    d = d.select("conv_id", "idx", F.shiftright("idx", TILE.bit_length() - 1).alias("tile"), here.alias("here"), F.when(here, F.col("turn")).alias("turn"), code.alias("code"), (here & F.col("blank")).alias("blank"), (here & dup).alias("dup"), (here & cut).alias("cut"))
    listed = F.array_sort(F.collect_list(F.when(F.col("here"), F.struct("idx", "code"))))  # at most TILE rows
    per = d.groupBy("tile", "conv_id").agg(listed.alias("rows"), F.count_if("blank").alias("blank"), F.count_if("dup").alias("dup"), F.count_if("cut").alias("cut"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.size(F.collect_set("turn")).cast("long").alias("turns"))
    return per.withColumn("codes", F.array_join(F.transform("rows", lambda r: F.char(r["code"] + 65)), "")).drop("rows")


def _codes(column) -> list[np.ndarray]:
    return [np.frombuffer(c.encode(), dtype=np.uint8).astype(np.int64) - 65 for c in column.to_pylist()]


def _appended(batch: pa.RecordBatch, **more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])


def _pieces(batches):
    """The segments in slices of at most ROWS rows, or of one segment."""
    for batch in batches:
        at, held = 0, 0
        for i, n in enumerate(pc.utf8_length(batch["codes"]).to_pylist()):
            if i > at and held + n + 1 > ROWS:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n + 1
        yield batch.slice(at)


def _folding(batches):
    for batch in _pieces(batches):
        yield _appended(batch, m=pa.array(fold(_codes(batch["codes"])).reshape(-1, 16).tolist(), pa.list_(pa.int64())))


def _chaining(batches):
    """Segments of a conversation, last first: the costs behind each, and what the edits from its start on cost."""
    now, behind = None, None
    for batch in batches:
        ahead, cost, last = [], [], []
        for conv, m in zip(batch["conv_id"].to_pylist(), batch["m"].to_pylist(), strict=True):
            last.append(now != (conv,))
            if last[-1]:
                now, behind = (conv,), COSTS[END, :, 0]
            ahead.append(behind.tolist())
            behind = (np.array(m).reshape(4, 4) + behind).min(1)
            cost.append(int(behind[0]))
        yield _appended(batch, ahead=pa.array(ahead, pa.list_(pa.int64())), cost=pa.array(cost, pa.int64()), last=pa.array(last, pa.bool_()))


def _ranking(batches):
    for batch in _pieces(batches):
        last, ahead = batch["last"].to_pylist(), np.array(batch["ahead"].to_pylist(), dtype=np.int64).reshape(-1, 4)
        codes = [np.append(c, END) if end else c for c, end in zip(_codes(batch["codes"]), last, strict=True)]
        ahead[np.array(last, dtype=bool)] = 0
        found = least_paths(codes, ahead)
        yield _appended(batch, exits=pa.array([f[0] for f in found], pa.list_(pa.int32())), audits=pa.array([f[1] for f in found], pa.list_(pa.string())))


_OUT = {"conv_id": pa.int64(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}


class _Conversation:
    """Gathers a conversation's segments, then applies its audit to its rows as they come."""

    def __init__(self, conv):
        self.conv, self.pieces, self.state, self.initials = conv, [], 0, None
        self.blank = self.dup = self.cut = self.illegal = self.turns = 0
        self.cost, self.lo, self.hi = None, None, None
        self.audit, self.at, self.digest, self.first = None, 0, hashlib.sha256(), True

    def segment(self, s: dict) -> None:
        self.cost = s["cost"] if self.cost is None else self.cost
        self.pieces.append(s["audits"][self.state])
        self.state = s["exits"][self.state]
        self.blank, self.dup, self.cut = self.blank + s["blank"], self.dup + s["dup"], self.cut + s["cut"]
        if s["lo"] is not None:
            self.turns += s["turns"] - (self.hi == s["lo"])
            self.lo, self.hi = s["lo"] if self.lo is None else self.lo, s["hi"]
        for c in s["codes"]:
            initial = "sua?"[(ord(c) - 65) // 3]
            self.illegal += self.initials is not None and self.initials + initial not in ("su", "ua", "au")
            self.initials = initial

    def _say(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def _inserts(self) -> None:
        if self.audit is None:
            self.audit, self.pieces, self.state = "".join(self.pieces), [], 0
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = int(ADDED[self.state]), self.at + 1
            self._say("user" if self.state == 2 else "assistant", "")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.state = int(ADDED[self.state])
            self._say("user" if self.state == 2 else "assistant", text)
        elif letter == "K":
            self.state = int(KEPT[self.state, "sua".index(role[0])])
            self._say(role, text)

    def result(self) -> tuple:
        self._inserts()
        gaps = 0 if self.lo is None else min(self.hi - self.lo + 1 - self.turns, 2**63 - 1)
        return self.conv, gaps, self.blank, self.dup, self.cut, self.illegal, self.cost, self.audit, self.digest.hexdigest()


def _digesting(batches):
    """Per conversation its segments in order, then its rows in order, to one row."""
    now, done = None, []

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(_OUT.values())], names=list(_OUT))
        done.clear()
        return batch

    for batch in batches:
        segs = iter(batch.filter(pc.is_valid(batch["seg"]))["seg"].to_pylist())
        for conv, kind, role, text in zip(batch["conv_id"].to_pylist(), batch["kind"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if now is None or now.conv != conv:
                if now:
                    done.append(now.result())
                now = _Conversation(conv)
            if kind == 0:
                now.segment(next(segs))
            else:
                now.row(role, text)
        yield out()
    if now:
        done.append(now.result())
    yield out()


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, gone): its faults, the least cheapest audit, its cost
    and the digest of what it repairs to."""
    ordered = _judged(rows)
    segs, spark = _segments(ordered), rows.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ordered.count() // (TILES * TILE)))
    kinds = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    folded = segs.mapInArrow(_folding, f"{kinds(segs)}, m array<long>")
    chained = folded.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("tile")).mapInArrow(_chaining, f"{kinds(folded)}, ahead array<long>, cost long, last boolean").drop("m")
    ranked = chained.repartition(partitions, "tile").mapInArrow(_ranking, f"{kinds(chained)}, exits array<int>, audits array<string>")
    info = F.struct(*(c for c in ranked.columns if c not in ("conv_id", "tile", "ahead", "last")))
    none = lambda kind: F.lit(None).cast(kind)
    ahead = ranked.select("conv_id", F.lit(0).alias("kind"), "tile", none("long").alias("turn"), none("string").alias("role"), none("binary").alias("h"), none("string").alias("text"), info.alias("seg"))
    texts = rows.filter(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), none("long").alias("tile"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("h"), "text", F.lit(None).cast(ahead.schema["seg"].dataType).alias("seg"))
    stream = ahead.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "tile", F.col("turn").asc_nulls_first(), "role", "h")
    return stream.select("conv_id", "kind", "role", "text", "seg").mapInArrow(_digesting, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def op12_repair_chats(spark, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _oracle() -> str:
    by_byte = [zlib.crc32(bytes([n ^ 255])) ^ 0xFF000000 for n in range(256)]  # the step of the checksum for one byte
    spaces = " || ".join(f"chr({ord(c)})" for c in SPACES)
    node = lambda cost, audit, rest: f"{{'c': {cost}, 'a': {audit}, 'r': {rest}}}"
    added = lambda cost, letter, to, first=None: node(f"g.g{to}.c + {cost}", f"'{letter}' || g.g{to}.a", f"[{first}] || g.g{to}.r" if first else f"g.g{to}.r")

    def edits(q: int) -> str:
        to = int(ADDED[q])
        role = "user" if to == 2 else "assistant"
        out = [added(3, "D", q), f"CASE WHEN o.fault < 2 THEN {added('2 + o.fault', 'R', to, f"'{role}:' || o.text")} END"]
        out += [f"CASE WHEN o.fault < 2 AND o.initial = '{i}' THEN {added('o.fault', 'K', int(KEPT[q, k]), "o.role || ':' || o.text")} END" for k, i in enumerate("sua") if KEPT[q, k] >= 0]
        return f"list_min([x FOR x IN [{', '.join(out)}] IF x IS NOT NULL])"

    insert = lambda b, roles: node(f"{b}.c + {2 * len(roles)}", f"'{'I' * len(roles)}' || {b}.a", f"[{', '.join(f"'{r}:'" for r in roles)}] || {b}.r")
    front = lambda b: f"list_min([{b}, {insert('b2', ['user'])}, {insert('b3', ['user', 'assistant'])}])"
    counts = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {n}" for c, n in (("gaps", "gaps"), ("blank", "blank"), ("duplicate", "duplicate"), ("truncated", "truncated"), ("illegal", "illegal"), ("p.g0.c", "cost")))
    return f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
k AS (SELECT *, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(substr(key, i, 1)) AS BIGINT) FOR i IN range(1, len(key) + 1)], lambda c, b: xor(c >> 8, {by_byte}[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS k FROM d),
x AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM x),
w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, right(rtrim(text, {spaces}), 1) AS final, substr(role, 1, 1) AS initial FROM n),
o AS MATERIALIZED (SELECT *, CASE WHEN final = '' OR seen > 1 THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM w),
s AS (SELECT conv_id, max(i) AS n, count_if(final = '') AS blank, count_if(final <> '' AND seen > 1) AS duplicate, count_if(fault = 1) AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM o GROUP BY conv_id),
p AS (SELECT conv_id, n AS i, {node("0", "''", "CAST([] AS VARCHAR[])")} AS g0, {node("4", "'II'", "['user:', 'assistant:']")} AS g1, {node("2", "'I'", "['assistant:']")} AS g2, {node("0", "''", "CAST([] AS VARCHAR[])")} AS g3 FROM s
  UNION ALL SELECT conv_id, i - 1, {front("b0")}, {front("b1")}, list_min([b2, {insert("b3", ["assistant"])}]), list_min([b3, {insert("b2", ["user"])}]) FROM (
    SELECT g.conv_id, g.i, {", ".join(f"{edits(q)} AS b{q}" for q in range(4))} FROM p g JOIN o ON o.conv_id IS NOT DISTINCT FROM g.conv_id AND o.i = g.i))
SELECT c.conv_id, {counts}, coalesce(p.g0.a, '') AS audit, sha256(coalesce(array_to_string(p.g0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = 0"""


ORACLE = _oracle()
