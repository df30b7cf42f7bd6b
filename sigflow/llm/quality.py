"""Text quality rules as ordered Spark conditions: fixed base counts and a learned decision list.

Only DataFrame functions work on the data here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigflow.session import checkpoint, discard

# Fixed values of the base counts.
BLANKS = " \t\n\x0b\x0c\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3

#: Percentiles of each class that become cut points; at most 11 bins for each of the five features.
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted by (64-bit hash, place), so that equal ones are neighbours; the
    places of those with an equal neighbour are sorted again and their union counted.
    """
    n = F.size(words) - WINDOW + 1
    window = lambda i: F.struct(F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))).alias("h"), i.alias("p"))

    def places(s: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["p"]))

    def union(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(p, k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(n < 2, F.lit(0).cast("long")).otherwise(_let(F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), window)), lambda s: _let(places(s), union)))


def base_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every whole text.

    A null text counts as empty; a text may have any number of words. Every row gives
    one result, also rows with a null id and repeated rows. Equal 64-bit hashes of
    three words count as equal words. Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"))
    t = F.col("_text")
    bare = F.btrim(t, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("r")))
    dups = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    flat = rows.select(
        "doc_id",
        F.explode(F.array(counts)).alias("_c"),
        F.char_length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dups.alias("n_dup_lines"),
    )
    return flat.select("doc_id", F.col("_c.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("_c.r").alias("n_repeat_words"))


BASE_FAILED = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.cut!r}D"


@dataclass(frozen=True)
class DecisionList:
    """Rules that reject, tried in order; a text that meets none is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self) -> Column:
        kept = F.when(F.lit(False), F.lit(False))
        for rule in self.rules:
            kept = kept.when(F.expr(" and ".join(f"({c.sql()})" for c in rule)), F.lit(False))
        return kept.otherwise(F.lit(True))


def cover(cells: list[tuple[tuple[int, ...], tuple[int, int, int, int]]], cuts: dict[str, list[float]], *, max_rules: int = 8, max_conditions: int = 3, least_precision: float = 0.9, least_rows: int = 5) -> DecisionList:
    """Sequential covering on counted cells.

    A cell is (bin of each feature, (bad, good) rows to grow on, (bad, good) rows to
    prune on). A rule grows by the condition with the best FOIL gain, is pruned
    from its end while its worth (p - n) / (p + n) on the other rows does not fall,
    and is taken if it is precise enough on all rows; its cells are then removed.
    """
    from math import log2

    names = list(cuts)
    options = [(f, up, k) for f, name in enumerate(names) for k in range(len(cuts[name])) for up in (True, False)]
    meets = lambda bins, o: (bins[o[0]] > o[2]) == o[1]
    left, rules = list(cells), []

    def tally(rows, conds, at):
        hit = [c for b, c in rows if all(meets(b, o) for o in conds)]
        return sum(c[at] for c in hit), sum(c[at + 1] for c in hit)

    while len(rules) < max_rules:
        conds: list = []
        rows = left
        p0, n0 = tally(rows, [], 0)
        while p0 and n0 and len(conds) < max_conditions:
            best = (0.0, None, 0, 0)
            for o in options:
                p = sum(c[0] for b, c in rows if meets(b, o))
                if p:
                    n = sum(c[1] for b, c in rows if meets(b, o))
                    gain = p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))
                    if gain > best[0] + 1e-9:
                        best = (gain, o, p, n)
            if best[1] is None:
                break
            conds.append(best[1])
            rows = [r for r in rows if meets(r[0], best[1])]
            p0, n0 = best[2:]
        worth = lambda k: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*tally(left, conds[:k], 2))
        while len(conds) > 1 and worth(len(conds) - 1) >= worth(len(conds)):
            conds.pop()
        g, q = tally(left, conds, 0), tally(left, conds, 2)
        bad, good = g[0] + q[0], g[1] + q[1]
        if not conds or bad < least_rows or bad < least_precision * (bad + good):
            break
        rules.append(tuple(Condition(names[f], up, cuts[names[f]][k]) for f, up, k in conds))
        left = [r for r in left if not all(meets(r[0], o) for o in conds)]
    return DecisionList(tuple(rules))


#: Bins over the logarithm of a feature in which the values around a percentile are looked up.
BINS = 4096


def exact_percentiles(rows: DataFrame, label: str, features: list[str], at: tuple[float, ...]) -> dict[tuple, list[float]]:
    """(label, feature) -> the percentiles of that label's rows, linear between two values.

    Equal values are counted before they are shuffled. Sums over at most BINS bins of
    each label and feature say in which bins the wanted ranks lie; only the values of
    those bins are then numbered, each bin by itself. Null values have no part.
    """
    long = rows.select(F.col(label).alias("q"), F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in features))).alias("x")).select("q", "x.f", "x.v").where("v is not null")
    size = F.signum("v") * F.log1p(F.abs("v"))
    counted = checkpoint(long.groupBy("q", "f", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("s", size))
    ends = counted.groupBy("q", "f").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("n").alias("total"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int").alias("b")
    binned = counted.join(F.broadcast(ends), ["q", "f"]).select("q", "f", "v", "n", "total", bin_)  # a row a label and feature
    before = Window.partitionBy("q", "f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("q", "f", "b", "total").agg(F.sum("n").alias("m")).withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0)))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(F.lit(p) * (F.col("total") - 1)), F.ceil(F.lit(p) * (F.col("total") - 1))) for p in at))))
    wanted = bins.select("q", "f", "b", "start", "m", F.explode(ranks).alias("rank")).where("rank >= start and rank < start + m")
    inside = Window.partitionBy("q", "f", "b").orderBy("v")
    chosen = binned.join(F.broadcast(wanted.select("q", "f", "b", "start").distinct()), ["q", "f", "b"]).withColumn("last", F.col("start") + F.sum("n").over(inside) - 1)
    found = chosen.join(F.broadcast(wanted.select("q", "f", "b", "rank")), ["q", "f", "b"]).where("rank <= last and rank > last - n").select("q", "f", "rank", "v", "total").collect()
    discard(counted)
    value = {(r.q, r.f, r["rank"]): r.v for r in found}
    total = {(r.q, r.f): r.total for r in found}
    out = {}
    for (q, f), n in total.items():
        place = [(p * (n - 1), int(p * (n - 1))) for p in at]
        out[q, f] = [value[q, f, lo] if x == lo else value[q, f, lo] * (lo + 1 - x) + value[q, f, lo + 1] * (x - lo) for x, lo in place]
    return out


def learn(counts: DataFrame, labels: DataFrame) -> DecisionList:
    """Learn the list from the labelled rows that pass the base rules.

    At most 10 cut points a feature and at most 11**5 counted cells come to the
    driver, however many rows there are. Of two labels under one id the smaller
    counts. Without rows of both labels the list is empty and keeps everything.
    """
    truth = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("_q"))
    rows = counts.where(f"not {BASE_FAILED}").join(truth, "doc_id").select("_q", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("_fold"), *(F.expr(e).alias(f) for f, e in FEATURES.items()))
    points = exact_percentiles(rows, "_q", list(FEATURES), QUANTILES)
    if len({q for q, _ in points}) < 2:
        return DecisionList(())
    cuts = {}
    for f in FEATURES:
        values = sorted({v for (_, g), vs in points.items() if g == f for v in vs})
        cuts[f] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    bins = {f: "+".join(["0", *(f"if({f} > {c!r}D, 1, 0)" for c in cuts[f])]) for f in FEATURES}
    count = lambda q, grow: F.sum(F.expr(f"if(_q = {q} and {'_fold <> 0' if grow else '_fold = 0'}, 1, 0)"))
    cells = rows.groupBy(*(F.expr(e).alias(f) for f, e in bins.items())).agg(count(0, True).alias("_a"), count(1, True).alias("_b"), count(0, False).alias("_c"), count(1, False).alias("_d")).collect()
    return cover(sorted((tuple(r[f] for f in FEATURES), (r._a, r._b, r._c, r._d)) for r in cells), cuts)


def quality_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """All documents with their base counts, ``base_failed`` and ``kept``, and the learned list.

    The counts are written once to the shared checkpoint folder; learning and the
    result both read them there. Null or empty texts have no words and fail the
    base rules. An empty table gives an empty result.
    """
    counts = checkpoint(base_counts(docs))
    rules = learn(counts, labels)
    failed = F.expr(BASE_FAILED)
    return counts.select("*", failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(rules.column()).alias("kept")), rules
