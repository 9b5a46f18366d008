"""Quality rules with risk-controlled thresholds, in built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import write_table

#: Rule -> (numerator, denominator, edges of 100 * numerator / denominator). A rule's bin is the number of edges reached.
RULES = {
    "symbols": ("n_symbols", "n_words", (1, 5, 20, 50, 100)),
    "capitals": ("n_capitals", "word_chars", (5, 10, 20, 40)),
    "bangs": ("n_bangs", "n_words", (1, 5, 20, 50)),
    "same_lines": ("n_dup_lines", "n_lines", (1, 10, 30, 60)),
    "distinct": ("n_distinct", "n_words", (5, 10, 20, 30, 40, 50, 60)),
    "word_length": ("word_chars", "n_words", (350, 400, 450, 600, 700, 800)),
    "repeats": ("n_repeat_words", "n_words", (1, 5, 10, 20, 50)),
}
#: Cutoffs tried on the score (hundredths of a log-odds unit), the accepted share of good documents that a cutoff rejects in a
#: stratum, and the probability that any stratum's share is higher.
CUTOFFS = tuple(range(50, 1050, 50))
RISK, ERROR = 0.05, 0.05
#: Cutoffs of so many strata at most are sent to all executors; more are joined by a shuffle.
BROADCAST_STRATA = 10_000

_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _without(text: Column, chars: str) -> Column:
    """How many of chars the text has."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and what RULES need, a row for
    each row of docs. Words are runs without ASCII white space. Positions of a text's words are sorted by the 64-bit hash of
    their 5-word windows inside the row, and only where some window repeats, so a long text costs n log n and no shuffle.
    Null and empty texts have no words (base_failed); a null stratum is ''; other columns are ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("t"))
    d = d.select("doc_id", "stratum", "t", F.filter(F.split("t", _SPACE), lambda w: w != "").alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike(_WORD)).alias("lines"))
    d = d.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.char_length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        _without(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        _without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _without(F.col("t"), "!").alias("n_bangs"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("w"),
    )
    window = F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(5))))
    d = d.withColumn("h", F.when(F.size("w") >= 5, window).otherwise(F.array().cast("array<bigint>"))).drop("w")
    sorted_windows = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), sorted_windows).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("h")
    met = F.filter("s", lambda x, k: (F.get("s", k - 1)["h"] == x["h"]) | (F.get("s", k + 1)["h"] == x["h"]))
    d = d.withColumn("p", F.sort_array(F.transform(met, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("p", k + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b)
    d = d.withColumn("n_repeat_words", covered.cast("long")).drop("p")
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _bins() -> dict[str, Column]:
    out = {}
    for rule, (num, den, edges) in RULES.items():
        x = F.expr(f"(100 * {num}) div greatest({den}, 1)")
        out[rule] = sum(((x >= e).cast("int") for e in edges), F.lit(0))
    return out


def _half(col: str) -> Column:
    """0: documents that weigh the bins, 1: the holdout that certifies cutoffs."""
    return F.conv(F.substring(F.md5(F.col(col).cast("string")), 1, 8), 16, 10).cast("long") % 2


def _tail(n: Column, k: Column, risk: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, risk), summed in logarithms from its first term; 1 where k is above the mean."""
    step = math.log(risk / (1 - risk))

    def add(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log(n - i + 1) - F.log(i.cast("double")) + step
        top = F.greatest(acc["a"], term)
        return F.struct(term.alias("t"), (top + F.log(F.exp(acc["a"] - top) + F.exp(term - top))).alias("a"))

    first = n * math.log(1 - risk)
    total = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.struct(first.alias("t"), first.alias("a")), add, lambda acc: F.exp(acc["a"]))
    return F.when(k > n * risk, F.lit(1.0)).otherwise(total)


def risk_controlled(features: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """features with score (long), cutoff (long, null where none is certified) and kept.

    labels: doc_id, quality (1 good, 0 bad; the highest where an id has several; null quality is no label). One half of the
    labelled documents weighs the bins of RULES by smoothed log-odds, whose sum is the score. On the other half, the holdout,
    every cutoff of every stratum is a hypothesis: that it rejects more than `risk` of the stratum's good documents. A cutoff is
    certified when the exact binomial probability of as few rejections as were seen is at most error / (strata * cutoffs),
    which is when its Clopper-Pearson bound at that level is at most `risk`. The lowest certified cutoff of a stratum whose
    higher ones are certified, too, rejects the documents that reach it. Strata without enough labels reject by the base alone,
    as do all when there are no labels.

    The weights (a row for each bin of a rule) and cutoffs (a row for each stratum with labels) are all that leaves the
    executors; the weights go into the plan as literals, the cutoffs are joined.
    """
    bins = _bins()
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("good"))
    marked = features.join(known, "doc_id").select("doc_id", "stratum", "good", *(b.alias(r) for r, b in bins.items()), _half("doc_id").alias("half"))
    marked = write_table(marked, "marked")
    cells = marked.where("half = 0").select("good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES))).alias("c"))
    counts = {(r["rule"], r["bin"]): (r["bad"], r["ok"]) for r in cells.groupBy("c.rule", "c.bin").agg(F.sum(1 - F.col("good")).alias("bad"), F.sum("good").alias("ok")).collect()}
    score = F.lit(0)
    for rule, (_, _, edges) in RULES.items():
        n_bad, n_ok = (sum(v[i] for k, v in counts.items() if k[0] == rule) for i in (0, 1))
        for b in range(len(edges) + 1):
            bad, ok = counts.get((rule, b), (0, 0))
            odds = math.log((bad + 1) / (n_bad + len(edges) + 1)) - math.log((ok + 1) / (n_ok + len(edges) + 1))
            score = score + F.when(F.col(f"b_{rule}") == b, F.lit(round(100 * odds))).otherwise(F.lit(0))
    score = score.cast("long")

    held = marked.where("half = 1 and good = 1").withColumnsRenamed({r: f"b_{r}" for r in RULES}).select("stratum", score.alias("score"))
    per = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(F.col("score") >= c).alias(f"k{c}") for c in cutoffs))
    per = per.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(0))))  # before cutoffs multiply the rows
    tests = per.select("stratum", "n", "strata", F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"k{c}").alias("k")) for c in cutoffs))).alias("x"))
    tests = tests.select("stratum", "x.cutoff", (_tail(F.col("n"), F.col("x.k"), risk) <= error / (F.col("strata") * len(cutoffs))).alias("sure"))
    failed = F.max(F.when(~F.col("sure"), F.col("cutoff")))
    chosen = tests.groupBy("stratum").agg(F.min(F.when(F.col("sure"), F.col("cutoff"))).alias("low"), failed.alias("fail"), F.collect_list(F.when(F.col("sure"), F.col("cutoff"))).alias("all"))
    chosen = chosen.select("stratum", F.array_min(F.filter("all", lambda c: F.col("fail").isNull() | (c > F.col("fail")))).cast("long").alias("cutoff"))

    scored = features.select("*", *(b.alias(f"b_{r}") for r, b in bins.items())).withColumn("score", score).drop(*(f"b_{r}" for r in RULES))
    chosen = write_table(chosen, "cutoffs")
    out = scored.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_STRATA else chosen, "stratum", "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("cutoff").isNull() | (F.col("score") < F.col("cutoff"))))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """The features, score, cutoff and kept of every document. Features are computed once and written, as narrow rows.

    Null and empty texts fail the base; rows with repeated or null ids are judged one by one, and a label counts for every row
    of its id (a null id has none); a null stratum is a stratum of its own; an empty table gives no rows; without labels the base
    alone decides; other columns are ignored."""
    return risk_controlled(write_table(quality_features(docs, stratum_col=stratum_col), "features"), labels)
