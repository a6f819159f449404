"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Per document the base features of ``features`` are computed; ``thresholds`` then picks, per
stratum (language) and rule, the strictest cutoff whose false-rejection rate on labelled good
documents is certified: the exact binomial tail ``P(Bin(n, alpha) <= k)`` of the ``k``
rejections seen among ``n`` good documents must not exceed ``delta`` shared out over all
strata and rules (Bonferroni); within a rule the cutoffs are tested from the loosest to the
strictest and testing stops at the first that fails (fixed sequence, no further correction).
``alpha`` is shared over the rules, so that a stratum loses at most ``ALPHA`` of its good
documents to all rules together, with confidence ``1 - DELTA`` over all strata.

Defined results: null text counts as empty (no words, base_failed); a null language is a
stratum of its own; a stratum with too few labels has no certified cutoff, so only the base
rules hold there; repeated rows are each judged, but one trial of the bound; label rows with null doc_id or quality are
ignored; extra columns pass through ``apply`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, durable_table, let, table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rule -> (condition over the base features with cutoff c, cutoffs from loose to strict).
RULES = {
    "symbols": ("1000 * n_symbols > {c} * n_words", (2000, 1000, 500, 300, 200, 150, 100)),
    "dup_lines": ("20 * n_dup_lines > n_words and n_dup_lines > {c}", (40, 20, 10, 6, 4)),
    "repeats": ("1000 * n_repeat_words > {c} * n_words", (480, 450, 400, 350, 300, 250, 200)),
    "long_words": ("1000 * word_chars > {c} * n_words", (30000, 20000, 15000, 12000, 10000, 9000)),
    "short_words": ("1000 * word_chars < {c} * n_words", (1500, 2000, 2500, 3000)),
}
ALPHA, DELTA = 0.02, 0.05
#: Strata that a broadcast join may send to every executor; more are joined by shuffle.
SENT_STRATA = 10_000
BASE_FAILED = "(n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
_WS = "\\x20\\x09-\\x0D"


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice.

    Each window becomes one long, its hash in front of its place; sorted, equal windows are
    neighbours, and the words themselves are compared before two count as equal. The cost is
    n log n in the words of one text, with nothing shuffled."""
    call = F.call_function

    def equal(w: Column, i: Column, j: Column) -> Column:
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def covered(p: Column) -> Column:
        return F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2))))

    def count(w: Column, bits: Column) -> Column:
        keyed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: call("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i))
        place = lambda x: x.bitwiseAND(call("shiftleft", F.lit(1).cast("bigint"), bits) - 1).cast("int")
        code = lambda x: call("shiftrightunsigned", x, bits)

        def run(s: Column) -> Column:
            twin = lambda x, i: F.coalesce((code(F.get(s, i + 1)) == code(x)) & equal(w, place(x), place(F.get(s, i + 1))), F.lit(False))
            pairs = F.transform(s, lambda x, i: F.when(twin(x, i), F.array(place(x), place(F.get(s, i + 1)))))
            return let(F.flatten(F.array_compact(pairs)), covered)

        return let(F.sort_array(keyed), run)

    def run(w: Column) -> Column:
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.length(F.bin(F.size(w))), lambda bits: count(w, bits)))

    return let(words, run)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five base features as long columns (clashing input columns are replaced)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, f"[{_WS}]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{_WS}]"))
    measured = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    return docs.withColumns(
        {
            "__m": measured,
            "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        }
    ).withColumns({"n_words": F.col("__m.n").cast("long"), "n_repeat_words": F.col("__m.r").cast("long")}).drop("__m")


def _names() -> list[tuple[str, int, str, str]]:
    return [(rule, level, condition.format(c=c), f"{rule}_{level}") for rule, (condition, cutoffs) in RULES.items() for level, c in enumerate(cutoffs, 1)]


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly in log space; 1 where k is above the mean (never certified there)."""
    odds = F.log(F.lit(p / (1 - p)))

    def step(acc: Column, i: Column) -> Column:
        def add(t: Column) -> Column:
            top = F.greatest(acc["s"], t)
            return F.struct(t.alias("t"), (top + F.log(F.exp(acc["s"] - top) + F.exp(t - top))).alias("s"))

        return let(acc["t"] + F.log((n - i + 1) / i) + odds, add)

    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("t"), first.alias("s")), step, lambda a: a["s"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(total))


def thresholds(judged: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: ``stratum``, ``n_good`` and per rule the certified level (0: none).

    ``judged`` has doc_id, the stratum and the base features; only good documents (quality 1)
    that pass the base rules are counted, repeated rows of one once, one row of counts per
    stratum after map-side sums."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    held = judged.where(f"not {BASE_FAILED}").select("doc_id", stratum, *BASE).join(good, "doc_id", "left_semi").distinct()
    sums = [F.sum(F.expr(f"cast({c} as long)")).alias(name) for _, _, c, name in _names()]
    counts = held.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n_good"), *sums)
    tests = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.col(name).alias("k")) for rule, level, _, name in _names()]))
    rows = counts.select("stratum", "n_good", tests.alias("t")).select("stratum", "n_good", "t.*")
    p = rows.withColumn("p", binomial_tail(F.col("k"), F.col("n_good"), alpha / len(RULES)))
    n_strata = F.count(F.lit(1)).over(Window.partitionBy("rule", "level"))
    failed = p.withColumn("failed", F.col("p") > F.lit(delta) / (n_strata * len(RULES)))
    first = [(F.coalesce(F.min(F.when(F.col("failed") & (F.col("rule") == r), F.col("level"))), F.lit(len(cutoffs) + 1)) - 1).cast("int").alias(f"{r}_level") for r, (_, cutoffs) in RULES.items()]
    return failed.groupBy("stratum").agg(F.max("n_good").alias("n_good"), *first)


def verdict() -> Column:
    """True where no certified rule rejects; needs the base features and the ``*_level`` columns."""
    rejects = [f"(coalesce({rule}_level, 0) >= {level} and {c})" for rule, level, c, _ in _names()]
    return F.expr(f"not ({BASE_FAILED} or {' or '.join(rejects)})")


def judge(docs: DataFrame, cut: DataFrame, stratum: str = "lang") -> DataFrame:
    """``docs`` (with features) plus ``base_failed`` and ``kept``.

    The strata table is sent out whole only if it was counted and has ``SENT_STRATA`` rows or fewer."""
    levels = [f"{r}_level" for r in RULES]
    cut = durable(cut.select(F.col("stratum").alias("__stratum"), *levels))
    if cut.count() <= SENT_STRATA:
        cut = F.broadcast(cut)
    joined = docs.drop(*levels).join(cut, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    return joined.withColumns({"base_failed": F.expr(BASE_FAILED), "kept": verdict()}).drop("__stratum", *levels)


def apply(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    hidden = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", F.col(stratum).alias("__stratum_of"), "text")
    measured = durable_table(features(hidden).drop("text"))
    cut = thresholds(measured.drop("__row"), labels, "__stratum_of")
    return judge(measured, cut, "__stratum_of").where("kept").select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = durable_table(features(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"))
    cut = thresholds(docs, table(spark, sf_dir, "labels"))
    return judge(docs, cut).select("doc_id", *BASE, "base_failed", "kept")


def oracle() -> str:
    """The same in DuckDB SQL."""
    names, m = _names(), len(RULES)
    a = ALPHA / m
    tail = "case when {k} > n_good * {a} then 1.0 else list_sum(list_transform(range(0, cast({k} + 1 as bigint)), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({a}) + (n_good - i) * ln(1 - {a})))) end"
    level = []
    for r, (_, cutoffs) in RULES.items():
        ok = [f"({tail.format(k=name, a=a)}) <= {DELTA} / (n_strata * {m})" for rule, _, _, name in names if rule == r]
        level.append("case " + " ".join(f"when not coalesce({x}, false) then {i}" for i, x in enumerate(ok)) + f" else {len(cutoffs)} end as {r}_level")
    rejects = " or ".join(f"(coalesce({rule}_level, 0) >= {lv} and {c})" for rule, lv, c, _ in names)
    return f"""
with w as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[{_WS}]+'), lambda x: x <> '') as ws from documents),
g as (select rid, unnest(range(1, cast(greatest(len(ws) - 1, 1) as bigint))) as i, ws from w where len(ws) >= 3),
k as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as win from g),
d as (select rid, i, count(*) over (partition by rid, win) as c from k),
r as (select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from d where c > 1) group by rid),
f as (select doc_id, lang, len(ws) as n_words, length(regexp_replace(t, '[{_WS}]', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]')))
      - coalesce(list_unique(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_WS}]'))), 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words from w left join r using (rid)),
c as (select lang as stratum, count(*) as n_good, {", ".join(f"sum(case when {c} then 1 else 0 end) as {n}" for _, _, c, n in names)}
    from (select distinct * from f) where not {BASE_FAILED} and doc_id in (select doc_id from labels where quality = 1) group by lang),
s as (select stratum, {", ".join(level)} from c cross join (select count(*) as n_strata from c))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
    cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
    {BASE_FAILED} as base_failed, not ({BASE_FAILED} or {rejects}) as kept
from f left join s on f.lang is not distinct from s.stratum"""
