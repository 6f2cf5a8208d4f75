"""Quality rules: a decision list learned by sequential covering (native DataFrame code).

Statistics of all documents are computed once.  Labelled rows are binned at quantiles; each
growing step asks Spark for one histogram (statistic x bin x fold x label, a few thousand rows
at any input size) and the driver adds the threshold with the best information gain.  A rule is
cut back to the prefix that does best on the pruning fold.  Of the best rule that rejects and the best that
keeps, the more precise one there is taken if it is precise enough, and the rows it covers leave
the training set, so a rule is learned for the rows that those before it leave over and their order
matters.  The result is an ordered Spark conditional that keeps what no rule covers.

Bounds: at most ``max_rules`` (8) rules of at most ``max_tests`` (3) tests, thresholds between ``bins`` (64) quantiles,
a precision of ``min_precision`` (0.9) and ``min_support`` (10) labelled rows for a rule.

Defined results: null or empty text: all statistics 0, base_failed true; a table without
labelled rows, or with one class only, learns no rule (every document that passes the base rule
is kept); labels other than 0 and 1 and labels without a document are ignored; repeated rows
are judged one by one; only the id, text and label columns are read, whatever else there is.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import materialize
from larkspur.llm.textstats import with_text_stats


def _per(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def ratios() -> dict[str, Column]:
    """The interpretable statistics that rules may test."""
    return {
        "word_count": F.col("n_words").cast("double"),
        "mean_word_chars": _per("word_chars", "n_words"),
        "symbols_per_word": _per("n_symbols", "n_words"),
        "marks_per_word": _per("n_marks", "n_words"),
        "dup_line_share": _per("n_dup_lines", "n_lines"),
        "repeat_word_share": _per("n_repeat_words", "n_words"),
        "distinct_word_share": _per("n_distinct_words", "n_words"),
        "upper_share": _per("n_upper", "n_chars_all"),
        "digit_share": _per("n_digits", "n_chars_all"),
    }


@dataclass(frozen=True)
class Test:
    """``name <= cut`` or ``name > cut``."""

    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.name) > self.cut if self.above else F.col(self.name) <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """Documents that pass every test are rejected, or kept."""

    tests: tuple[Test, ...]
    precision: float
    support: int
    keeps: bool = False

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """True: keep.  The first rule that covers a row decides."""
        out = None
        for r in self.rules:
            out = F.when(r.column(), r.keeps) if out is None else out.when(r.column(), r.keeps)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join(f"{'keep' if r.keeps else 'reject'} if {' and '.join(map(str, r.tests))}" for r in self.rules) + "\nelse keep"


def _bin(name: str, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col(name)))


def _histogram(rows: DataFrame, names: list[str], keeps: bool) -> dict:
    """counts[name][bin] = [grow bad, grow good, prune bad, prune good]; for a rule that keeps, good is what it looks for."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b_{n}").alias("b")) for i, n in enumerate(names)]))
    counts = rows.select("prune", "bad", pairs.alias("p")).groupBy("p.f", "p.b", "prune", "bad").count().collect()
    out: dict = defaultdict(lambda: defaultdict(lambda: [0, 0, 0, 0]))
    for r in counts:
        out[names[r["f"]]][r["b"]][2 * r["prune"] + (0 if r["bad"] != keeps else 1)] += r["count"]
    return out


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's gain of narrowing (p0 of the class looked for, n0 others) to (p1, n1)."""
    return p1 * (math.log2((p1 + 1) / (p1 + n1 + 2)) - math.log2((p0 + 1) / (p0 + n0 + 2)))


def learn(
    stats: DataFrame,
    label_col: str,
    id_col: str,
    bins: int = 64,
    max_rules: int = 8,
    max_tests: int = 3,
    min_precision: float = 0.9,
    min_support: int = 10,
) -> DecisionList:
    """Learn a list that rejects label 0 and keeps label 1 from ``stats`` (text statistics with labels)."""
    features = ratios()
    names = list(features)
    rows = stats.where(F.col(label_col).isin(0, 1)).select(
        (F.col(label_col) == 0).alias("bad"),
        (F.pmod(F.crc32(F.concat(F.col(id_col).cast("string"), F.lit("-prune"))), F.lit(3)) == 0).cast("int").alias("prune"),
        *[c.alias(n) for n, c in features.items()],
    )
    rows = materialize(rows, "rule-rows")
    probes = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(n, probes, 10_000).alias(n) for n in names]).first()
    values = {n: sorted(set(got[n] or [])) for n in names}
    cuts = {n: [(a + b) / 2 for a, b in zip(v, v[1:])] for n, v in values.items()}  # halfway, as trees cut
    # Bin b of x: the number of cuts below x, so x <= cuts[i] is b <= i.
    binned = rows.select(
        "bad",
        F.coalesce("prune", F.lit(0)).alias("prune"),
        *[_bin(n, cuts[n]).alias(f"b_{n}") for n in names],
    )
    binned = materialize(binned, "rule-bins")
    found = DecisionList()
    left = binned
    while len(found.rules) < max_rules:
        grown = [_grow(left, names, cuts, max_tests, min_precision, min_support, keeps) for keeps in (False, True)]
        grown = [g for g in grown if g is not None]
        if not any(not rule.keeps for rule, _ in grown):
            break  # what is left is kept anyway
        rule, inside = max(grown, key=lambda g: (round(g[0].precision, 3), not g[0].keeps))
        found.rules.append(rule)
        left = left.where(~inside)
    while found.rules and found.rules[-1].keeps:
        found.rules.pop()
    return found


def _grow(left: DataFrame, names: list[str], cuts: dict, max_tests: int, min_precision: float, min_support: int, keeps: bool) -> tuple[Rule, Column] | None:
    tests: list[Test] = []
    conds: list[Column] = []
    tried: list[tuple[float, int, int]] = []  # pruning precision, support, tests used
    rows = left
    while len(tests) < max_tests:
        counts = _histogram(rows, names, keeps)
        best = None
        for k, n in enumerate(names):
            total = [sum(c[j] for c in counts[n].values()) for j in range(4)]
            below = [0, 0, 0, 0]
            for i in range(len(cuts[n])):
                below = [a + b for a, b in zip(below, counts[n].get(i, [0] * 4))]
                for above in (False, True):
                    now = [t - b for t, b in zip(total, below)] if above else below
                    if now[0] + now[2] >= min_support and now[:2] != total[:2]:
                        gain = _gain(total[0], total[1], now[0], now[1])
                        if gain > 0 and (best is None or (gain, -k, -i) > best[0]):
                            best = ((gain, -k, -i), n, i, above, now)
        if best is None:
            break
        _, n, i, above, now = best
        tests.append(Test(n, above, float(cuts[n][i])))
        conds.append(F.col(f"b_{n}") > i if above else F.col(f"b_{n}") <= i)
        tried.append(((now[2] + 1) / (now[2] + now[3] + 2), now[0] + now[2], len(tests)))
        if now[1] == 0:
            break
        rows = rows.where(conds[-1])
    # Prune: the shortest prefix among those with the best precision on the held-back fold.
    if not tried:
        return None
    precision, support, used = max(tried, key=lambda x: (round(x[0], 3), x[1], -x[2]))
    if precision < min_precision:
        return None
    inside = conds[0]
    for c in conds[1:used]:
        inside = inside & c
    return Rule(tuple(tests[:used]), precision, support, keeps), inside


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> tuple[DataFrame, DecisionList]:
    """Statistics, base rule and verdict of every document, and the list learned."""
    stats = materialize(with_text_stats(docs, text_col, [id_col]), "text-stats")
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
    train = stats.join(marks, F.col(id_col) == F.col("__id")).drop("__id")
    found = learn(train, "__label", id_col)
    features = ratios()
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = stats.withColumns(features).withColumn("base_failed", base)
    out = out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(found.verdict()))
    return out.drop(*features), found
