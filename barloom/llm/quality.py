"""Quality rules: text statistics, and decision lists learned from labelled statistics. DataFrame operations throughout.

Sequential covering: each rule for "reject" grows one threshold condition at a time by information gain on two thirds of the
labelled rows, is pruned on the other third, and is kept if it is precise on both; the rows that it covers are set aside and the
next rule is learned from the rest. The list comes out as one ordered chain of Spark conditionals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import through_table

#: Labelled rows that a list is learned from, at most (on average: rows are taken by a hash of doc_id).
LABELLED_ROWS = 20_000
#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
BREAKS = "\t\n\x0b\x0c\r "
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20

#: What conditions are about: name and expression over the columns of statistics().
FEATURES = {
    "n_words": "cast(n_words AS double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
BINS = 24
#: Counts of the base rule, and those that only conditions are about.
COUNTS, MORE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), ("n_marks", "n_distinct_words", "n_lines")


def _occurrences(text: Column, characters: str) -> Column:
    """How often one-byte characters occur."""
    counts = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters]
    return sum(counts[1:], counts[0]).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns in keep, and counts over the whole text.

    Null texts count as empty: all counts 0. Repeated rows and null ids give a row each. Narrow: no text is shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)]
    names = [f"kept_{k}" for k in range(len(keep))]
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), *kept, text.alias("t"))
    two = one.select(
        "doc_id",
        *names,
        F.array_remove(F.split("t", r"[ \t-\r]+"), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^ \t-\r]")).alias("lines"),
        (F.length("t") - _occurrences(F.col("t"), BREAKS)).cast("long").alias("word_chars"),
        _occurrences(F.col("t"), SYMBOLS).alias("n_symbols"),
        _occurrences(F.col("t"), "!?").alias("n_marks"),
    )
    three = two.select(
        "doc_id",
        *names,
        "word_chars",
        "n_symbols",
        "n_marks",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice("words", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *[F.get(F.col("words"), i + k) for k in range(1, WINDOW)]),
        ).alias("windows"),
    )
    # places of windows that occur twice or more: neighbours of an equal window once sorted
    ordered = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    four = three.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered))
    same = lambda v, k: F.coalesce(F.get(F.col("ordered"), k)["x"] == v["x"], F.lit(False))
    five = four.withColumn(
        "places",
        F.sort_array(F.transform(F.filter("ordered", lambda v, k: same(v, k - 1) | same(v, k + 1)), lambda v: v["i"])),
    ).drop("windows", "ordered")
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.coalesce(F.get(F.col("places"), k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return five.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(
        "doc_id",
        *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)],
        *COUNTS,
        *MORE_COUNTS,
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    bin: int

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def on_bins(self) -> Column:
        place = F.col(f"bin_{self.feature}")
        return place > self.bin if self.above else place <= self.bin


Rule = tuple[Condition, ...]


def _all(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Statistics of at most about `rows` labelled documents, and whether each is bad (quality 0).

    A document with several labels is bad if any says so; null labels are left out. The label side is bounded by `rows`,
    so it is broadcast.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else known
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = some.join(F.broadcast(sample.select(F.col("doc_id").alias("d"), "bad")), F.col("doc_id") == F.col("d")).drop("d")
    return statistics(joined, keep=("bad",))


def learn(stats: DataFrame, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.98, support: int = 5) -> list[Rule]:
    """An ordered list of rules for "reject" from statistics with a column bad.

    No labelled rows, or rows of one class: an empty list, which rejects nothing. Every step is one aggregation over cells:
    rows of equal binned features, counted once.
    """
    values = stats.select("doc_id", "bad", *[F.expr(e).alias(f) for f, e in FEATURES.items()])
    at = [k / BINS for k in range(1, BINS)]
    rare = [0.002, 0.005, 0.01, 0.02, 0.98, 0.99, 0.995, 0.998]
    asked = F.array(*map(F.lit, sorted({*at, *rare})))
    found = values.agg(*[F.percentile(f, asked).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted({float(x) for x in (found[f] or [])}) for f in FEATURES}

    def binned(f: str) -> Column:
        return sum([(F.col(f) > F.lit(c)).cast("int") for c in cuts[f]], F.lit(0)).alias(f"bin_{f}")

    part = F.when(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0, 1).otherwise(0).alias("held")
    cells = through_table(
        values.select("bad", part, *[binned(f) for f in FEATURES])
        .groupBy("held", *[f"bin_{f}" for f in FEATURES])
        .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        .coalesce(1),
        "quality-cells",
    ).cache()

    def totals(where: Column) -> dict[int, tuple[int, int]]:
        rows = cells.where(where).groupBy("held").agg(F.sum("p"), F.sum("n")).collect()
        got = {r[0]: (r[1], r[2]) for r in rows}
        return {h: got.get(h, (0, 0)) for h in (0, 1)}

    def best(where: Column, p0: int, n0: int) -> Condition | None:
        """The condition of highest gain among rows that satisfy `where`."""
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in FEATURES])).alias("x")
        rows = cells.where(where & (F.col("held") == 0)).select("p", "n", pairs).groupBy("x.f", "x.b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
        start = math.log2(max(p0, 1) / max(p0 + n0, 1)) if p0 else -30.0
        top, choice = 1e-9, None
        for f in FEATURES:
            per_bin = {r["b"]: (r["p"], r["n"]) for r in rows if r["f"] == f}
            p = n = 0
            for b, cut in enumerate(cuts[f]):
                p, n = p + per_bin.get(b, (0, 0))[0], n + per_bin.get(b, (0, 0))[1]
                for above, a, c in ((False, p, n), (True, p0 - p, n0 - n)):
                    if a >= support and (gain := a * (math.log2(a / (a + c)) - start)) > top:
                        top, choice = gain, Condition(f, above, cut, b)
        return choice

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        p0, n0 = totals(left)[0]
        if p0 < support:
            break
        rule: list[Condition] = []
        p, n = p0, n0
        while n and len(rule) < max_conditions and (c := best(left & _all([x.on_bins() for x in rule]), p, n)):
            rule.append(c)
            p, n = totals(left & _all([x.on_bins() for x in rule]))[0]
        if not rule:
            break
        worth = []
        for k in range(1, len(rule) + 1):  # prune: the shortest start of the rule that is best on held-out rows
            got = totals(left & _all([x.on_bins() for x in rule[:k]]))
            (hp, hn), (gp, gn) = got[1], got[0]
            worth.append(((hp - hn) / max(hp + hn, 1), -k, k, (hp + gp) / max(hp + gp + hn + gn, 1), gp + hp))
        _, _, k, exact, covers = max(worth)
        if exact < precision or covers < support:
            k = len(rule)
            exact, covers = worth[-1][3], worth[-1][4]
        if exact < precision or covers < support:
            break
        rules.append(tuple(rule[:k]))
        left = left & ~_all([x.on_bins() for x in rule[:k]])
    cells.unpersist()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True: keep. The first rule that holds rejects."""
    if not rules:
        return F.lit(True)
    chain = F.when(_all([c.column() for c in rules[0]]), F.lit(False))
    for rule in rules[1:]:
        chain = chain.when(_all([c.column() for c in rule]), F.lit(False))
    return chain.otherwise(F.lit(True))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed and kept.

    kept goes through a row number, which is never negative: a filter on it is then not pushed below the statistics, where every
    condition would carry a copy of the expressions that count.
    """
    judged = stats.withColumns({"base_failed": base_failed(), "verdict": verdict(rules)})
    return judged.withColumn("kept", (F.monotonically_increasing_id() >= 0) & ~F.col("base_failed") & F.col("verdict")).drop("verdict")


def quality_rules(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns in keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the counts that
    rules may also use): every document, judged by a list learned from the labels.

    Null and empty texts have no words and fail the base rule. Repeated rows and null ids give a row each. Without labels, or with
    labels of one class, the list is empty and the base rule alone decides. Columns of docs beside those in keep are not read.
    """
    stats = through_table(labelled(docs, labels), "quality-labelled")
    judged = judge(statistics(docs, keep=keep), learn(stats))
    return judged.select("doc_id", *keep, *COUNTS, "base_failed", "kept", *MORE_COUNTS)
