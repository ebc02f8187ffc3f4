"""Quality rules: text statistics in Spark SQL and a learned decision list over them.

The list is learned by sequential covering. Thresholds lie between quantiles of each
statistic, tails included, over the labelled rows that are left at each step. A rule grows, one threshold condition at a time by information
gain on two thirds of the rows, is pruned from its end on the other third, and is kept
while it is precise; the rows that it covers leave and the next rule is grown. Every
step is one aggregate over labelled rows that returns a count for each threshold, so
no labelled row comes to the driver. The rules become one ordered CASE expression.

Only DataFrame functions run on the way from documents to verdicts.

Cases: a null or empty text has no words and fails the base rules. Labels that are null
or belong to no document teach nothing; of several labels of one document the lowest
counts. Without labels no rule is learned and the base rules alone decide. Repeated
rows get equal verdicts. Very long texts count whole. Of thresholds that separate alike
the middle one is taken; quantiles are approximate beyond 10,000 distinct values, so
thresholds there may differ a little between runs with other partitions. Columns that
clash with names in use here are kept apart. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm._scratch import Scope, keep

GAPS = r"[\x20\x09-\x0D]+"
NON_GAP = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]+"
#: Words in a window that may repeat.
WINDOW = 5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words covered by windows that occur twice or more in the list of words.

    Hashes of all windows tell at once whether any repeats; only then are the windows
    themselves sorted, so equal ones are neighbours and their places can be merged.
    """
    starts = F.sequence(F.lit(0), n - WINDOW)
    at = lambda i: [F.get(words, i + k) for k in range(WINDOW)]
    hashes = F.transform(starts, lambda i: F.xxhash64(*at(i)))
    windows = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("g"), i.alias("i"))))

    def covered(ordered: Column) -> Column:
        same = lambda x, k: (x["g"] == F.get(ordered, k - 1)["g"]) | (x["g"] == F.get(ordered, k + 1)["g"])
        places = F.array_sort(F.transform(F.filter(ordered, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))
        steps = lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return _let(places, lambda p: F.aggregate(steps(p), F.lit(0).cast("long"), lambda a, x: a + x))

    repeats = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n >= WINDOW, F.when(repeats, _let(windows, covered)).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_marks", "n_lines"]


def counts_of(text_col: str = "text") -> Column:
    """A struct of text statistics, ``COUNTS``, of a whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, GAPS), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_GAP))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    split = F.struct(words.alias("words"), lines.alias("lines"))

    def counts(x: Column) -> Column:
        w, lines = x["words"], x["lines"]
        n = F.size(w)
        values = [
            n, F.length(F.array_join(w, "")), left(SYMBOLS), F.size(lines) - F.size(F.array_distinct(lines)), _repeat_words(w, n),
            F.size(F.array_distinct(w)), left(r"[^\p{Lu}]+"), left(r"[^!?]+"), F.size(lines),
        ]
        return F.struct(*(v.cast("long").alias(c) for v, c in zip(values, COUNTS, strict=True)))

    return _let(split, counts)


def base_failed(c: Column) -> Column:
    """The fixed rules: under 10 words, or over a fifth of the words repeat."""
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def statistics(c: Column) -> dict[str, Column]:
    """What conditions of a rule compare, from the counts; 0 for a text without words."""
    share = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))
    return {
        "mean_word": share("word_chars", "n_words"),
        "symbol_rate": share("n_symbols", "n_words"),
        "dup_line_rate": share("n_dup_lines", "n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"),
        "distinct_rate": share("n_distinct", "n_words"),
        "upper_rate": share("n_upper", "word_chars"),
        "mark_rate": share("n_marks", "n_words"),
        "n_words": c["n_words"].cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    """One comparison of a statistic with a threshold."""

    name: str
    above: bool
    threshold: float

    def column(self, stats: dict[str, Column]) -> Column:
        x = stats[self.name]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule], stats: dict[str, Column]) -> Column:
    """The ordered conditional expression of a decision list: false where a rule holds, else true."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column(stats)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(
    labelled: DataFrame,
    stats: list[str],
    bins: int = 48,
    precise: float = 0.97,
    least: int = 8,
) -> list[Rule]:
    """A decision list from rows of statistics with ``bad`` (boolean) and ``prune`` (boolean).

    A rule must hold for ``least`` bad rows and be right for a share of ``precise`` of what
    it covers, on the growing and, where it has rows, on the pruning part. Rules are grown
    until none is precise; each covers bad rows that no earlier one did.
    """
    tails = [0.5**k / bins for k in range(1, 7)]
    points = sorted({0.0, 1.0, *(i / bins for i in range(1, bins)), *tails, *(1 - x for x in tails)})
    rules: list[Rule] = []
    plain = {s: F.col(s) for s in stats}
    while True:
        open_rows = labelled.where(verdict(rules, plain))
        rule: Rule = ()
        while True:
            rows = open_rows.where(~F.col("prune") & ~verdict([rule], plain) if rule else ~F.col("prune"))
            cuts = _cuts(rows, stats, points)
            candidates = [Condition(s, above, t) for s in stats for t in cuts[s] for above in (True, False)]
            counted = _threshold_counts(rows, stats, cuts)
            p0, n0 = counted["all"]
            if not p0 or (rule and p0 >= precise * (p0 + n0) and n0 == 0):
                break
            if not candidates:
                break
            most = max(_gain(*counted[c], p0, n0) for c in candidates)
            equal = [c for c in candidates if _gain(*counted[c], p0, n0) >= most - 1e-9]
            equal = [c for c in equal if (c.name, c.above) == (equal[0].name, equal[0].above)]
            best = equal[len(equal) // 2]  # between equal thresholds, the widest margin to either side
            if counted[best][0] < least or most <= 1e-9:
                break
            rule = (*rule, best)
            p, n = counted[best]
            if n == 0:
                break
        rule = _pruned(open_rows, rule, plain, precise, least)
        if not rule:
            break
        rules.append(rule)
    return rules


def _cuts(rows: DataFrame, stats: list[str], points: list[float]) -> dict[str, list[float]]:
    """Thresholds between quantiles of each statistic over the rows at hand, their non-zero values and their bad rows."""
    views = lambda s: (f"`{s}`", f"nullif(`{s}`, 0D)", f"if(bad, `{s}`, NULL)")
    at = ", ".join(f"{x!r}D" for x in points)
    quantiles = [F.expr(f"percentile_approx({x}, array({at}), 10000)") for s in stats for x in views(s)]
    found = rows.agg(*(q.alias(f"q{i}") for i, q in enumerate(quantiles))).first()
    seen = [sorted({v for q in found[3 * i : 3 * i + 3] for v in q or []}) for i in range(len(stats))]
    return {s: [(a + b) / 2 for a, b in zip(x, x[1:], strict=False)] for s, x in zip(stats, seen, strict=True)}


def _threshold_counts(rows: DataFrame, stats: list[str], cuts: dict[str, list[float]]) -> dict:
    """(bad, good) rows that each condition holds for, from one histogram per statistic."""

    def place(s: str, low: int, high: int) -> str:
        """How many cuts a value is above, by halving."""
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"if(`{s}` > {cuts[s][mid]!r}D, {place(s, mid + 1, high)}, {place(s, low, mid)})"

    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.expr(place(s, 0, len(cuts[s]))).alias("b")) for k, s in enumerate(stats)))
    hist = rows.select("bad", F.explode(cells).alias("c")).groupBy("c.k", "c.b").agg(
        F.sum(F.col("bad").cast("long")).alias("p"), F.count("*").alias("n")
    )
    by: dict[int, dict[int, tuple[int, int]]] = {}
    for r in hist.collect():  # bins times statistics rows at most
        by.setdefault(r["k"], {})[r["b"]] = (r["p"], r["n"] - r["p"])
    out: dict = {"all": tuple(map(sum, zip(*by.get(0, {0: (0, 0)}).values(), strict=True)))}
    for k, s in enumerate(stats):
        for j, t in enumerate(cuts[s]):
            for above in (True, False):
                held = [v for b, v in by.get(k, {}).items() if (b > j) == above]
                out[Condition(s, above, t)] = (sum(v[0] for v in held), sum(v[1] for v in held))
    return out


def _pruned(open_rows: DataFrame, rule: Rule, plain: dict[str, Column], precise: float, least: int) -> Rule:
    """The start of a rule that does best on the pruning rows, or nothing if none is precise."""
    starts = [rule[:i] for i in range(1, len(rule) + 1)]
    if not starts:
        return ()
    sums = []
    for i, start in enumerate(starts):
        holds = ~verdict([start], plain)
        for part in ("prune", "grow"):
            side = F.col("prune") if part == "prune" else ~F.col("prune")
            sums += [
                F.coalesce(F.sum((holds & side & F.col("bad")).cast("long")), F.lit(0)).alias(f"{part}_p{i}"),
                F.coalesce(F.sum((holds & side & ~F.col("bad")).cast("long")), F.lit(0)).alias(f"{part}_n{i}"),
            ]
    c = open_rows.agg(*sums).first()
    good = []
    for i, start in enumerate(starts):
        p, n, gp, gn = c[f"prune_p{i}"], c[f"prune_n{i}"], c[f"grow_p{i}"], c[f"grow_n{i}"]
        if gp >= least and gp >= precise * (gp + gn) and p >= precise * (p + n):
            good.append(((p + gp) - (n + gn), -i, start))
    return max(good)[2] if good else ()


def fit_rules(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """Rules from the labelled rows of ``counted`` (id, counts); a label of 0 is bad."""
    stats = statistics(F.col("counts"))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    marks = marks.agg((F.min(label_col) == 0).alias("bad"))
    rows = counted.where(~base_failed(F.col("counts"))).join(marks, "doc_id").select(
        "bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune"), *(c.alias(s) for s, c in stats.items())
    )
    with Scope(counted.sparkSession):
        return learn_rules(keep(rows, "quality-labelled"), list(stats))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept) for every row of ``docs``."""
    counted = keep(docs.select(F.col(id_col).alias("doc_id"), counts_of(text_col).alias("counts")), "quality-counts")
    rules = fit_rules(counted, labels, id_col)
    c = F.col("counts")
    return counted.select(
        "doc_id", "counts", base_failed(c).alias("base_failed"), (~base_failed(c) & verdict(rules, statistics(c))).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that neither the base rules nor the learned list reject."""
    # Rows are written with their counts, which are worked out once and serve learning and filtering.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), counts_of(text_col).alias("counts"))
    counted = keep(rows, "quality-rows")
    rules = fit_rules(counted.select("doc_id", "counts"), labels, id_col)
    c = F.col("counts")
    return counted.where(~base_failed(c) & verdict(rules, statistics(c))).select("row.*")


def op3_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of ``judge`` over documents."""
    out = judge(docs, labels)
    return out.select("doc_id", *(f"counts.{c}" for c in COUNTS[:5]), "base_failed", "kept")
