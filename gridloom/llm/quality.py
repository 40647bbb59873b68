"""Operator 9: quality rules whose cutoffs are certified on labelled documents. DataFrame functions only.

Every text gets counts (words, symbols, repeated lines, words in repeated 8-word windows). A hard base rule rejects very
short and very repetitive texts. Soft rules (``RULES``) reject by a ratio; ``LADDER`` is a list, fixed in advance, of steps
with one cutoff per rule, from mild to strict. Per stratum (language) the ladder is walked from its mild end; a step is
taken while the exact binomial tail P(Bin(n, alpha) <= k) <= delta / strata, with k of n labelled good documents rejected
by any rule of the step. So, with probability 1 - delta over all strata together, no stratum loses more than ``alpha`` of
its good documents to the soft rules: within a ladder by fixed-sequence testing, over the strata by Bonferroni. All rules
share one ladder, so a stratum of 85 good labels can certify; one with too few certifies nothing and keeps what passes the
base rule. The SQL sums the tail up to 10 000 rejections and takes Chernoff's bound, which is never smaller, beyond; there a
step between tail and bound is taken here and not in SQL.

Cases: null or empty text has zero words and fails the base rule; null language is a stratum of its own; a document id
that occurs several times is judged row by row; several labels of one id count as good if any says so; null labels are
ignored; an empty table gives an empty result. Windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import GAP, lookup_join, pick, staged

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: rule -> value; a document is rejected when the value is above the cutoff.
RULES: dict[str, str] = {
    "symbols": "n_symbols / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "long_words": "word_chars / n_words",
    "short_words": "-word_chars / n_words",
}
#: Steps from mild to strict: a cutoff per rule.
LADDER: tuple[tuple[float, ...], ...] = (
    (1.0, 0.9, 0.29, 40.0, -1.2),
    (0.7, 0.8, 0.27, 30.0, -1.4),
    (0.5, 0.7, 0.25, 25.0, -1.6),
    (0.4, 0.6, 0.22, 20.0, -1.8),
    (0.3, 0.5, 0.2, 18.0, -2.0),
    (0.25, 0.45, 0.18, 16.0, -2.2),
    (0.2, 0.4, 0.16, 15.0, -2.3),
    (0.15, 0.35, 0.14, 14.0, -2.4),
    (0.1, 0.3, 0.12, 12.0, -2.5),
)
ALPHA = 0.05
DELTA = 0.05
#: Labelled ids that are broadcast to pick the rows for certification; with more of them all rows are measured for it.
LABEL_IDS = 1_000_000


def _pairs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def measure(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang (and ``keep``) with the counts of each whole text. Every array is a column of its own that is used at
    least twice, so that no projection is merged into a lambda body and evaluated once per element."""
    big = 2**30
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("text", text)
    d = d.withColumn("_w", F.filter(F.split("text", GAP), lambda w: w != "")).withColumn("_l", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        *keep,
        "doc_id",
        "lang",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    for k in (1, 2, 4):  # hashes of 2, then 4, then 8 words in a row
        d = d.withColumn(f"_h{2 * k}", _pairs(F.col(f"_h{k}"), F.slice(f"_h{k}", 1 + k, big))).drop(f"_h{k}")
    d = d.withColumn("_h8", F.when(F.col("n_words") > WINDOW, F.slice("_h8", F.lit(1), F.greatest(F.lit(1), F.col("n_words") - WINDOW + 1).cast("int"))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_some", F.size("_h8") > F.size(F.array_distinct("_h8")))
    d = d.withColumn("_s", F.when(F.col("_some"), F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twins = F.filter(F.zip_with("_s", F.slice("_s", 2, big), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    d = d.withColumn("_p", F.when(F.col("_some"), F.sort_array(F.array_distinct(F.flatten(twins)))))
    steps = F.zip_with("_p", F.slice("_p", 2, big), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    d = d.withColumn("n_repeat_words", F.when(F.col("_some"), F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return d.drop("_h8", "_some", "_s", "_p")


def _value(rule: str) -> Column:
    return F.expr(RULES[rule])  # division by zero does not arise: base_failed rows are never put to a rule


def _log_factorial_rest(m: Column) -> Column:
    """ln(m!) - m ln(m) + m: listed below 16, from there on by Stirling's series, whose rest is lost in doubles."""
    import math

    listed = F.array(*(F.lit(math.lgamma(i + 1) - (i * math.log(i) - i if i else 0.0)) for i in range(16)))
    x = F.greatest(m, F.lit(16)).cast("double")
    series = 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(m < 16, F.element_at(listed, (F.least(m, F.lit(15)) + 1).cast("int"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact for all k; 1 when k / n > p, where it could certify nothing.

    The probability of k times the sum of the terms from k downward, each as a share of the first. For k <= n p the j-th is
    at most exp(-j (j - 1) / (2 n p)), so those after sqrt(200 n p) are under e^-100 each and together lost in doubles."""
    share = k / n
    divergence = F.when(k > 0, share * F.log(share / p)).otherwise(0.0) + (1 - share) * F.log((1 - share) / (1 - p))
    first = F.exp(_log_factorial_rest(n) - _log_factorial_rest(k) - _log_factorial_rest(n - k) - n * divergence)
    next_ = lambda a, i: a["t"] * ((k - i) * (1 - p) / ((n - k + i + 1) * p))
    shares = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.least(k, F.ceil(F.sqrt(200 * p * n)) + 2)),
        F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
        lambda a, i: F.struct(next_(a, i).alias("t"), (a["s"] + next_(a, i)).alias("s")),
        lambda a: a["s"],
    )
    return F.when((n <= 0) | (k > n * p), F.lit(1.0)).otherwise(first * shares)


def certify(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: lang, n (good labels), the number of certified steps and, per rule, the cutoff (null: none)."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1")
    held = measured.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    sums = [F.sum(_rejects([F.lit(c) for c in step]).cast("long")).alias(f"_k{j}") for j, step in enumerate(LADDER)]
    out = held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("_strata", F.count(F.lit(1)).over(_everything()))
    oks = [binomial_tail(F.col(f"_k{j}"), F.col("n"), alpha) <= F.lit(delta) / F.col("_strata") for j in range(len(LADDER))]
    out = out.withColumn("steps", F.coalesce(F.array_position(F.array(*oks, F.lit(False)), False) - 1, F.lit(0)).cast("int"))
    cut = [F.when(F.col("steps") > 0, F.element_at(F.array(*(F.lit(step[i]) for step in LADDER)), F.greatest(F.col("steps"), F.lit(1)))).alias(f"cut_{r}") for i, r in enumerate(RULES)]
    return out.select("lang", "n", "steps", *cut)


def _rejects(cutoffs: list[Column]) -> Column:
    found = F.lit(False)
    for rule, cutoff in zip(RULES, cutoffs, strict=True):
        found = found | F.coalesce(_value(rule) > cutoff, F.lit(False))
    return found


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()  # one row per language


def _judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    judged = lookup_join(measured, cuts, "lang")
    failed = F.filter(F.array(*(F.when(~F.col("base_failed") & (_value(r) > F.col(f"cut_{r}")), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    return judged.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("n", "steps", *(f"cut_{r}" for r in RULES))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """All rows of ``docs`` (doc_id, text, lang) with counts, ``base_failed``, ``kept`` and ``failed_rules``."""
    measured = staged(measure(pick(docs, doc_id="long", text="string", lang="string")), "measured")
    return _judged(measured, staged(certify(measured, pick(labels, doc_id="long", quality="int"), alpha, delta), "cutoffs"))


def passing(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. No text is written: the labelled rows are measured for
    the cutoffs, and all rows as they are read."""
    labels, src = pick(labels, doc_id="long", quality="int"), pick(docs, doc_id="long", text="string", lang="string")
    good = staged(labels.filter("quality = 1").select("doc_id").distinct(), "good")
    if good.count() <= LABEL_IDS:
        src = src.join(F.broadcast(good), "doc_id", "left_semi")
    labelled = measure(src).withColumn("_at", F.monotonically_increasing_id())
    cuts = staged(certify(labelled.filter("_at >= 0"), labels, alpha, delta), "cutoffs")
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row")
    whole = docs.select(row, docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    # the row number keeps Catalyst from copying the filter, and with it all of the measuring, below the projections
    numbered = measure(whole, keep=("_row",)).withColumn("_at", F.monotonically_increasing_id())
    return _judged(numbered, cuts).filter(F.col("kept") & (F.col("_at") >= 0)).select("_row.*")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    ladder = " UNION ALL ".join(f"SELECT '{r}' AS rule, {j} AS step, CAST({c} AS DOUBLE) AS cutoff" for j, step in enumerate(LADDER) for r, c in zip(RULES, step, strict=True))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {v.replace('word_chars', 'CAST(word_chars AS DOUBLE)').replace('n_dup_lines', 'CAST(n_dup_lines AS DOUBLE)').replace('n_symbols', 'CAST(n_symbols AS DOUBLE)').replace('n_repeat_words', 'CAST(n_repeat_words AS DOUBLE)')}" for r, v in RULES.items()) + " END"
    p = ALPHA
    return rf"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
win AS (SELECT rid, i, list_slice(w, i, i + 7) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(step) AS n FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS step FROM dup) GROUP BY rid),
m AS (SELECT b.rid, b.doc_id, b.lang, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(b.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(b.text) - length(regexp_replace(b.text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM base b JOIN words USING (rid) LEFT JOIN rep USING (rid)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
ladder AS ({ladder}),
v AS (SELECT rid, lang, doc_id, step, bool_or({value} > cutoff) AS hit FROM (SELECT * FROM j WHERE NOT base_failed), ladder GROUP BY ALL),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
held AS (SELECT lang, step, count(*) AS n, count(*) FILTER (WHERE hit) AS k FROM v WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k > n * {p!r} THEN 1.0
           WHEN k > 10000 THEN exp(-n * (k / n * ln(k / n / {p!r}) + (1 - k / n) * ln((1 - k / n) / (1 - {p!r}))))
           ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) END AS t,
           (SELECT count(*) FROM (SELECT DISTINCT lang FROM held)) AS strata FROM held),
ok AS (SELECT lang, step, bool_and(t <= {DELTA!r} / strata) OVER (PARTITION BY lang ORDER BY step) AS pass FROM tail),
cut AS (SELECT lang, max(step) AS step FROM ok WHERE pass GROUP BY lang),
bad AS (SELECT v.rid FROM v JOIN cut ON v.step = cut.step AND v.lang IS NOT DISTINCT FROM cut.lang WHERE v.hit)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM j
"""


ORACLE = _oracle()
