"""Quality rules learned as a decision list, with Spark expressions only.

Text statistics are row-local array expressions. Sequential covering learns
from labelled rows: a rule grows one threshold at a time by information gain
on two thirds of them, is pruned on the other third, and takes the rows it
covers away before the next rule grows. The list becomes one CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OTHER_SPACE, UPPER, materialize, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Most labelled rows that a list is learned from: those with the smallest hash of their id.
MAX_LABELLED = 20_000
THRESHOLDS, MAX_CONDITIONS, MAX_RULES = 32, 4, 12
#: A rule needs so many covered rows and such a precision on the pruning rows.
MIN_COVERED, MIN_PRECISION = 5, 0.9


def with_text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks (all long).

    A null text counts as empty. Windows of 8 words are compared by a 64-bit
    hash of their words. n_repeat_words counts the words that lie in a window
    found twice or more: hashes are sorted with their places, neighbours with
    equal hashes are repeats, and each repeat adds the words up to the next.
    Columns of df with these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n_chars = F.length(t)
    without = lambda chars: n_chars - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " " + OTHER_SPACE, "")) > 0)
    out = df.withColumns({"__words": words(F.col(text)), "__lines": lines})
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    # The hash of eight words is that of two hashes of four next to each other, and so on down to single words.
    out = out.withColumn("__hash", F.transform("__words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        out = out.withColumn("__hash", F.zip_with("__hash", F.slice("__hash", step + 1, F.greatest(F.size("__hash") - step, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("__hash", F.when(F.col("n_words") >= WINDOW, F.slice("__hash", 1, F.greatest(F.size("__hash") - (WINDOW - 1), F.lit(0)))))
    out = out.withColumn(
        "__sorted",
        F.when(F.size(F.array_distinct("__hash")) < F.size("__hash"), F.array_sort(F.transform("__hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    at = lambda j: F.get("__sorted", j)
    repeats = F.array_sort(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.size("__sorted") - 1), lambda j: (at(j).h.eqNullSafe(at(j + 1).h)) | ((j > 0) & at(j).h.eqNullSafe(at(F.greatest(j - 1, F.lit(0))).h))),
            lambda j: at(j).i,
        )
    )
    out = out.withColumn("__repeats", repeats)
    covered = F.aggregate(
        F.transform("__repeats", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("__repeats", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    out = out.withColumns(
        {
            "word_chars": F.length(F.translate(t, " " + OTHER_SPACE, "")).cast("long"),
            "n_symbols": without(SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_upper": without(UPPER).cast("long"),
            "n_marks": without("!?").cast("long"),
        }
    )
    return out.drop("__words", "__lines", "__hash", "__sorted", "__repeats")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _per(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))


def rule_features() -> dict[str, Column]:
    """The numbers that conditions may test, by name."""
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": _per("word_chars", "n_words"),
        "symbols_per_word": _per("n_symbols", "n_words"),
        "repeat_share": _per("n_repeat_words", "n_words"),
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "upper_share": _per("n_upper", "word_chars"),
        "marks_per_word": _per("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = rule_features()[self.feature]
        return f > self.threshold if self.above else f <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, cuts: dict[str, list[tuple[float, float]]]) -> Column:
    """The rule over rows of bins: a feature's bin is the number of its thresholds that it exceeds."""
    out = F.lit(True)
    for c in rule:
        k = [cut for cut, _ in cuts[c.feature]].index(c.threshold)
        held = F.get("bins", F.lit(list(cuts).index(c.feature)))
        out = out & (held > k if c.above else held <= k)
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (log2((p + 1) / (p + n + 2)) - log2((p0 + 1) / (p0 + n0 + 2)))


def _best_condition(rows: DataFrame, cuts: dict[str, list[tuple[float, float]]], p0: int, n0: int) -> tuple[Condition, int, int] | None:
    """The condition with the largest gain, of equal ones that with the widest gap around it.

    cuts has thresholds with their gaps; all are counted by one grouped aggregation over bins.
    """
    each = rows.select("bad", F.posexplode("bins").alias("f", "b"))
    counts = each.groupBy("f", "b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    best, most = None, (0.0, 0.0)
    for at, (f, cs) in enumerate(cuts.items()):
        for k, (cut, gap) in enumerate(cs):
            hi = [r for r in counts if r["f"] == at and r["b"] > k]
            p, n = sum(r["p"] for r in hi), sum(r["n"] for r in hi)
            for above, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                g = _gain(pp, nn, p0, n0)
                if pp and g > 1e-9 and (round(g, 9), gap) > most:
                    best, most = (Condition(f, above, cut), pp, nn), (round(g, 9), gap)
    return best


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """The rejecting rules, in order, from rows with text statistics, doc_id and `bad` (1: to reject, 0: not).

    Rows whose `bad` is null are not used. No rows, or rows of one kind:
    no rules. What comes to the driver is counts by feature and bin only.
    """
    rows = labelled.where(F.col("bad").isNotNull()).select(
        F.col("bad").cast("int").alias("bad"),
        (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(3)) < 2).alias("grow"),
        *[c.alias("f_" + k) for k, c in rule_features().items()],
    )
    names = list(rule_features())
    probs = [i / (THRESHOLDS - 1) for i in range(THRESHOLDS)]
    rows = materialize(rows, "rule-rows")
    quantiles = rows.groupBy("bad").agg(*[F.percentile_approx("f_" + f, probs, 10_000).alias(f) for f in names]).collect()
    seen = {f: sorted({c for q in quantiles for c in q[f]}) for f in names} if len(quantiles) > 1 else {}
    # Half-way between neighbouring quantiles of both kinds, with the gap as a share of the feature's range.
    cuts = {f: [((a + b) / 2, (b - a) / (v[-1] - v[0])) for a, b in zip(v, v[1:], strict=False)] for f, v in seen.items() if len(v) > 1}
    if not cuts:
        return []
    exceeded = lambda f, cs: F.size(F.filter(F.array(*[F.lit(c) for c, _ in cs]), lambda c: F.col("f_" + f) > c))
    rows = rows.select("bad", "grow", F.array(*[exceeded(f, cs) for f, cs in cuts.items()]).alias("bins")).coalesce(2).persist()
    try:
        rules: list[Rule] = []
        left = rows
        while len(rules) < MAX_RULES:
            grow = left.where("grow")
            p, n = grow.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0))).first()
            rule: Rule = ()
            while p and n and len(rule) < MAX_CONDITIONS and (found := _best_condition(grow.where(_holds(rule, cuts)), cuts, p, n)):
                rule, p, n = rule + (found[0],), found[1], found[2]
            if not rule:
                break
            prefixes = [rule[: k + 1] for k in range(len(rule))]
            sums = [(F.sum(F.when(_holds(r, cuts), F.col("bad")).otherwise(0)), F.sum(F.when(_holds(r, cuts), 1 - F.col("bad")).otherwise(0))) for r in prefixes]
            tested = left.where("NOT grow").agg(*[F.coalesce(c, F.lit(0)) for pair in sums for c in pair]).first()
            scored = [(tested[2 * k], tested[2 * k + 1]) for k in range(len(rule))]
            worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in scored]
            k = max(range(len(rule)), key=lambda i: (worth[i], -i))
            p, n = scored[k]
            if p + n < MIN_COVERED or p < MIN_PRECISION * (p + n):
                break
            rules.append(prefixes[k])
            left = left.where(~_holds(prefixes[k], cuts))
        return rules
    finally:
        rows.unpersist()


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), or 0: one ordered CASE expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for c in rule:
            cond = cond & c.column()
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.lit(0) if out is None else out.otherwise(0)


def learn_from_labels(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules that reject label quality 0, from at most max_labelled labelled documents.

    Of conflicting labels of an id the smaller counts; of documents that share an id, one.
    """
    ids = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    ids = materialize(ids.select(F.col("doc_id").alias("__id"), (1 - F.col("quality")).alias("bad")), "labelled")
    known = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))  # at most max_labelled ids
    # One row an id, so that repeated documents do not exceed the bound: the text with the smallest hash.
    known = known.groupBy("doc_id").agg(F.min("bad").alias("bad"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return learn_rules(materialize(with_text_stats(known).drop("text"), "labelled"))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed, rule (0: none), kept; one row for each row of docs.

    An empty or null text has no words and fails the base test. Repeated
    documents are judged each; labels without a document are not used.
    """
    rules = learn_from_labels(docs, labels)
    out = with_text_stats(docs.select("doc_id", "text")).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that the base test or a learned rule rejects."""
    names = docs.columns
    rules = learn_from_labels(docs, labels)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col("text").alias("text"))
    # A projection with a row number stays below the filter: pushed down, the statistics would be written out at each use.
    judged = with_text_stats(held).select("__row", (~base_failed() & (verdict(rules) == 0)).alias("__good"), F.monotonically_increasing_id().alias("__no"))
    return judged.where("__good AND __no >= 0").select("__row.*")
