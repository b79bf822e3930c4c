"""Quality rules (native): document statistics as Spark expressions and learned decision lists over them.

The learner is sequential covering: conjunctions of thresholds are grown on one part of labelled statistics by
information gain, pruned on the other part, and emitted in order as one conditional Spark expression.

Defined cases: a null or empty text has no words, all statistics are 0 and the base rules fail it; a null doc_id is
kept as it is; repeated rows are judged one by one; an empty table gives an empty result; with no usable labels the
list is empty and only the base rules decide; further columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WS, settled, stage, table, unit_hash

#: Statistics the learner may test, as expressions over the staged columns.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "letters": "n_letters / greatest(word_chars, 1)",
    "upper": "n_upper / greatest(n_letters, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
}
SAMPLE_ROWS = 20_000


def _bind(value: Column, body) -> Column:
    """Evaluate value once per row and use it many times in body."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the array. Windows are compared by 64-bit hashes."""

    def covered(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def hits(z: Column) -> Column:
            at = F.transform(z, lambda x, i: F.when((F.get(z, i - 1)["k"] == x["k"]) | (F.get(z, i + 1)["k"] == x["k"]), x["i"]))
            at = F.sort_array(F.filter(at, lambda x: x.isNotNull()))
            init = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"))
            return F.aggregate(at, init, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(_bind(ordered, hits))

    keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_bind(keys, covered))


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row of statistics per document; whole texts, one scan, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, WS), "")
    count = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, WS, "")) > 0)
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size(F.filter(w, lambda x: F.length(x) <= 3)).cast("long").alias("n_stops"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    )
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return docs.select(
        *keep,
        _bind(words, of_words).alias("w"),
        _bind(lines, of_lines).alias("l"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        count(r"[^\p{L}]+").alias("n_letters"),
        count(r"[^\p{Lu}]+").alias("n_upper"),
        count(r"[^0-9]+").alias("n_digits"),
    ).select(*keep, "w.*", "l.*", "n_symbols", "n_letters", "n_upper", "n_digits")


class DecisionList:
    """Ordered conjunctions; the first that holds rejects, none keeps."""

    def __init__(self, rules: list[list[tuple[str, str, float]]]):
        self.rules = rules

    def expression(self) -> Column:
        """The number of the first rule that holds (from 1), else null, as one conditional expression."""
        out = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            test = F.lit(True)
            for name, op, cut in rule:
                value = F.expr(FEATURES[name])
                test = test & ((value <= cut) if op == "<=" else (value > cut))
            out = F.when(test, F.lit(i)).otherwise(out)
        return out


def _holds(rule, row) -> bool:
    return all(row[f] <= cut if op == "<=" else row[f] > cut for f, op, cut in rule)


def learn(rows: list[tuple[dict, int]], max_rules: int = 12, max_tests: int = 4, cuts: int = 40, precision: float = 0.9, least: int = 5) -> DecisionList:
    """Sequential covering over (statistics, label) pairs; label 0 is what the rules catch.

    Two thirds grow a rule by FOIL gain, one third prunes it by (p - n) / (p + n). A rule is kept while its precision
    over all rows left is at least `precision` and it catches `least` rows, so clean documents stay.
    """
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    grid = {}
    for f in FEATURES:
        v = sorted({r[0][f] for r in rows})
        grid[f] = sorted({v[int(i * (len(v) - 1) / (cuts - 1))] for i in range(cuts)} if len(v) > cuts else v)
    rules: list = []
    while len(rules) < max_rules:
        rule: list = []
        left = grow
        while len(rule) < max_tests:
            p, n = sum(1 - y for _, y in left), sum(y for _, y in left)
            if not p or not n:
                break
            best, base = (0.0, None), math.log2(p / (p + n))
            for f, at in grid.items():
                val = sorted((r[f], y) for r, y in left)
                i = lp = ln = 0
                for cut in at:
                    while i < len(val) and val[i][0] <= cut:
                        lp, ln, i = lp + 1 - val[i][1], ln + val[i][1], i + 1
                    for op, a, b in (("<=", lp, ln), (">", p - lp, n - ln)):
                        if a and (gain := a * (math.log2(a / (a + b)) - base)) > best[0] + 1e-9:
                            best = (gain, (f, op, cut))
            if best[1] is None:
                break
            rule.append(best[1])
            left = [r for r in left if _holds([best[1]], r[0])]
        if not rule:
            break
        score = lambda x: ((p := sum(1 - y for r, y in prune if _holds(x, r))) - (n := sum(y for r, y in prune if _holds(x, r)))) / (p + n) if any(_holds(x, r) for r, _ in prune) else -1.0
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=score)
        hit = [y for r, y in grow + prune if _holds(rule, r)]
        if len(hit) < least or 1 - sum(hit) / len(hit) < precision:
            break
        rules.append(rule)
        grow, prune = [r for r in grow if not _holds(rule, r[0])], [r for r in prune if not _holds(rule, r[0])]
        if not any(1 - y for _, y in grow):
            break
    return DecisionList(rules)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn from at most about sample_rows labelled rows, chosen by a hash of the id; the rest of the work covers all rows."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).alias("y"))
    share = min(1.0, sample_rows / max(1, known.count()))
    got = stats.join(known.where(unit_hash(id_col, seed=3) < share), id_col)
    rows = got.select(id_col, "y", *[F.expr(e).alias(f) for f, e in FEATURES.items()]).orderBy(F.xxhash64(id_col), id_col, *FEATURES).limit(2 * sample_rows).collect()
    return learn([({f: float(r[f]) for f in FEATURES}, int(r["y"])) for r in rows])


@settled
def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    stats = stage(statistics(table(spark, sf_dir, "documents")), "stats")
    rules = fit(stats, table(spark, sf_dir, "labels"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & rules.expression().isNull()).alias("kept"), rules.expression().alias("rule"),
    )
