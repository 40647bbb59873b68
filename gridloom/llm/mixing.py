"""Operator 1: mix sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) get the weights in turn; together they share ``share`` times all words;
a target stops at ``max_copies`` times its source's words and the excess is shared again by weight (water level).

Sampling: a document of ``size`` words expects ``e = min(max_copies, c * size**length_power)`` copies; ``c`` is solved per
source so that the expected words meet the target, and longer documents are mildly preferred. ``floor(e)`` whole copies
are certain. The fraction ``p`` is the inclusion probability of one more copy: documents are ranked by the Pareto key
``(u / (1 - u)) / (p / (1 - p))`` with ``u`` hashed from the id, and the lowest ranks are taken up to the fixed size that is
left of the target. One finishing document per source, the one nearest to the remaining gap, closes it.

The rank cut is found on counts: words per bucket of the key, twice refined, so no source is ever sorted in one task, and
the whole decision is one small row per source that every document is compared with.

Cases: null and empty texts have size 0 and are never taken; sources are mixture components, one row each on the driver
side of nothing (windows over that table only); rows of one source with the same doc_id share one key and are taken
together; null ids rank as the smallest; an empty table gives an empty mix. Reruns agree: nothing depends on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import lookup_join, n_words, pick, staged

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
LENGTH_POWER = 0.25
SEED = 20_240_611
#: Bits of the key that each refinement resolves.
LEVELS = (10, 20)
NO_ID = -(2**63)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target: one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ws = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ranked.withColumn("_w", F.element_at(ws, (F.pmod(F.col("_r") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * float(max_copies))
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", "_r").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn("_ratio", F.col("_cap") / F.col("_w")).withColumn("_all", F.sum("source_size").over(everything) * share).withColumn("_ws", F.sum("_w").over(everything))
    level = level.withColumn("_lam", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_ws") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    level = level.withColumn("_level", F.min(F.when(F.col("_lam") <= F.col("_ratio"), F.struct("_ratio", "_r", "_lam"))).over(everything)["_lam"])
    return level.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def _rates(sizes: DataFrame, goal: DataFrame, max_copies: int, power: float) -> DataFrame:
    """Per source the rate c. Distinct sizes only: largest first, those at the ceiling drop out until the rest is below it."""
    hist = sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    hist = lookup_join(hist, goal, "source", "inner")
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    before, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    words, pull = F.col("size") * F.col("n"), F.pow(F.col("size"), F.lit(power))
    c = (F.col("target") - F.coalesce(F.sum(words).over(before), F.lit(0)) * float(max_copies)) / F.sum(words * pull).over(rest)
    solved = hist.withColumn("_c", c).filter(F.col("_c") * pull <= max_copies * (1 + 1e-12))
    return solved.groupBy("source").agg(F.max_by("_c", "size").alias("rate"))


def _copies(size: Column, max_copies: int, power: float) -> Column:
    expected = F.least(F.lit(float(max_copies)), F.coalesce(F.col("rate"), F.lit(float(max_copies))) * F.pow(size, F.lit(power)))
    return F.when(size > 0, expected).otherwise(0.0)


def _scored(df: DataFrame, plan: DataFrame, max_copies: int, power: float, seed: int) -> DataFrame:
    """Each document with its certain copies, inclusion probability and Pareto key ``_z`` in (0, 1)."""
    d = lookup_join(df, plan, "source")
    d = d.withColumn("_e", _copies(F.col("size"), max_copies, power))
    d = d.withColumn("_whole", F.floor(F.col("_e") + 1e-9)).withColumn("_p", F.greatest(F.lit(0.0), F.col("_e") - F.col("_whole")))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(2**53)) + 0.5) / float(2**53)
    key = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
    return d.withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_z", F.when(F.col("_p") > 1e-9, key / (1 + key)))


def plan_mix(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, power: float = LENGTH_POWER, seed: int = SEED) -> DataFrame:
    """One row per source: source_size, target, rate, the cut (cut_z, cut_id) in the Pareto order and the finishing id."""
    goal = staged(targets(sizes, weights, share, max_copies), "targets")
    plan = staged(lookup_join(goal, staged(_rates(sizes, goal, max_copies, power), "rates"), "source"), "rates")
    scored = staged(_scored(sizes, plan, max_copies, power, seed).filter("size > 0").select("source", "size", "_id", "_z", "_whole", "target"), "scored")
    left = scored.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("_whole"))).alias("_left"), F.sum(F.when(F.col("_z").isNotNull(), F.col("size")).otherwise(0)).alias("_open"))
    cut = staged(left.withColumn("_below", F.lit(0)).withColumn("_bucket", F.when(F.col("_open") > F.col("_left"), F.lit(0).cast("long"))), "left")
    ranked = scored.filter(F.col("_z").isNotNull())
    bits = 0
    for level in LEVELS:  # each pass narrows the bucket in which the running sum passes what is left
        at = lookup_join(ranked, cut.select("source", F.col("_bucket").alias("_at")), "source", "inner")
        inside = at.filter(F.floor(F.col("_z") * 2**bits) == F.col("_at")) if bits else at.filter(F.col("_at").isNotNull())
        sums = inside.groupBy("source", F.floor(F.col("_z") * 2**level).alias("_b")).agg(F.sum("size").alias("_s"))
        sums = lookup_join(sums, cut, "source", "inner")
        run = sums.withColumn("_run", F.col("_below") + F.sum("_s").over(Window.partitionBy("source").orderBy("_b")))
        hit = run.filter(F.col("_run") > F.col("_left")).groupBy("source").agg(F.min_by(F.struct("_b", (F.col("_run") - F.col("_s")).alias("_under")), "_b").alias("_hit"))
        cut = staged(lookup_join(cut, staged(hit, "hit"), "source").select("source", "_left", "_open", F.coalesce("_hit._under", F.col("_below")).alias("_below"), F.col("_hit._b").alias("_bucket")), "cut")
        bits = level
    at = lookup_join(ranked, cut, "source", "inner").filter(F.floor(F.col("_z") * 2**bits) == F.col("_bucket"))
    run = at.withColumn("_run", F.col("_below") + F.sum("size").over(Window.partitionBy("source").orderBy("_z", "_id"))).filter(F.col("_run") <= F.col("_left"))
    last = staged(run.groupBy("source").agg(F.max(F.struct("_z", "_id", "_run")).alias("_last")), "last")
    cut = staged(
        lookup_join(cut, last, "source").select(
            "source",
            F.coalesce("_last._z", F.when(F.col("_bucket").isNull(), F.lit(2.0)).otherwise(F.col("_bucket") / float(2**bits))).alias("cut_z"),
            F.coalesce("_last._id", F.lit(NO_ID)).alias("cut_id"),
            (F.col("_left") - F.when(F.col("_bucket").isNull(), F.col("_open")).otherwise(F.coalesce("_last._run", F.col("_below")))).alias("_gap"),
        ),
        "cut",
    )
    rest = lookup_join(ranked, cut, "source", "inner").filter(~_taken())
    near = rest.withColumn("_off", F.abs(F.col("size") - F.col("_gap"))).filter(F.col("_off") < F.col("_gap"))
    finish = staged(near.groupBy("source").agg(F.min(F.struct("_off", "_z", "_id")).alias("_f")).select("source", F.col("_f._id").alias("finish_id")), "finish")
    return staged(lookup_join(lookup_join(plan, cut.drop("_gap"), "source"), finish, "source"), "plan")


def _taken() -> Column:
    return F.coalesce(F.col("_z").isNotNull() & ((F.col("_z") < F.col("cut_z")) | ((F.col("_z") == F.col("cut_z")) & (F.col("_id") <= F.col("cut_id")))), F.lit(False))


def apply_mix(docs: DataFrame, plan: DataFrame, max_copies: int = MAX_COPIES, power: float = LENGTH_POWER, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, size and any others) with source_size, target, copies and order_key. A map, no shuffle."""
    d = _scored(docs, plan, max_copies, power, seed)
    more = _taken() | (F.col("_z").isNotNull() & F.coalesce(F.col("_id") == F.col("finish_id"), F.lit(False)))
    return d.withColumn("copies", (F.col("_whole") + more.cast("long")).cast("int")).withColumn("order_key", F.col("_z")).drop("_e", "_whole", "_p", "_id", "_z", "rate", "cut_z", "cut_id", "finish_id")


def sized(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", source="string", text="string").select("doc_id", "source", n_words(F.col("text")).alias("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document its copies in the mix."""
    sizes = staged(sized(docs), "sizes")
    applied = {k: v for k, v in options.items() if k in ("max_copies", "power", "seed")}
    return apply_mix(sizes, plan_mix(sizes, **options), **applied)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    plan = plan_mix(staged(sized(docs), "sizes"), **options)
    applied = {k: v for k, v in options.items() if k in ("max_copies", "power", "seed")}
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"))
    rows = apply_mix(whole, plan, **applied).filter("copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("_row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
