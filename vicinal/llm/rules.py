"""Quality rules: decision lists learned by sequential covering, run as SQL conditions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import WORD, labelled_sample

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), packed_words: int = 1 << 16) -> DataFrame:
    """doc_id, the base statistics and the shares that rules use; null text counts as empty.

    The windows of three words that occur again are found inside the row: the
    64-bit hashes of all windows are sorted with their places, and places whose
    hash equals a neighbour's cover three words each.  Up to ``packed_words``
    words the place stands in the low bits of the hash, so that whole numbers
    are sorted and 48 bits of it or more are compared; longer texts sort pairs
    and compare all 64 bits.  Texts whose windows all differ skip the sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("t")).withColumns({"w": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), "lines": F.filter(F.split("t", "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))})
    length = F.length("t")
    rows = rows.select(
        "doc_id",
        *keep,
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("t", F.lit(r"[!?]")).alias("n_marks"),
        F.regexp_count("t", F.lit(r"[0-9]")).alias("n_digits"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        # w stands here twice, so that the optimizer does not move its expression into the function.
        F.when(F.size("w") >= 4, F.transform(F.slice("w", F.lit(1), F.size("w") - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    again, none = F.size(F.array_distinct("h")) < F.size("h"), F.array().cast("array<bigint>")
    rows = rows.withColumns({"bits": F.length(F.bin(F.size("w"))), "short": F.size("w") <= packed_words}).drop("w")
    packed = F.sort_array(F.transform("h", lambda x, i: F.call_function("shiftleft", x, F.col("bits")).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    no_pairs = F.array().cast("array<struct<x: bigint, i: int>>")
    rows = rows.withColumns({"s": F.when(again & F.col("short"), packed).otherwise(none), "l": F.when(again & ~F.col("short"), pairs).otherwise(no_pairs)}).drop("h")

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(F.call_function("shiftrightunsigned", x, F.col("bits")) == F.call_function("shiftrightunsigned", y, F.col("bits")), F.lit(False))

    def equal(x: Column, y: Column) -> Column:
        return F.coalesce(x["x"] == y["x"], F.lit(False))

    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    short = F.transform(F.filter("s", lambda x, j: same(x, F.get("s", j + 1)) | same(x, F.get("s", j - 1))), lambda x: x.bitwiseAND(place).cast("int"))
    long = F.transform(F.filter("l", lambda x, j: equal(x, F.get("l", j + 1)) | equal(x, F.get("l", j - 1))), lambda x: x["i"])
    rows = rows.withColumn("p", F.sort_array(F.concat(short, long))).drop("s", "l", "bits", "short")
    cover = F.aggregate(F.transform("p", lambda x, j: F.least(F.coalesce(F.get("p", j + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn("n_repeat_words", cover.cast("long")).drop("p")
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return rows.select(
        "doc_id",
        *keep,
        *BASE,
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_symbols") / words).alias("symbol_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_marks") / words).alias("mark_share"),
        (F.col("n_digits") / chars).alias("digit_share"),
        (F.col("n_distinct") / words).alias("distinct_share"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold); its documents are rejected."""

    tests: tuple[tuple[str, str, float], ...]

    def covers(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, op, at in self.tests:
            column = x[:, names.index(name)]
            hit &= column <= at if op == "<=" else column > at
        return hit

    def condition(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.tests:
            out = out & ((F.col(name) <= F.lit(float(at))) if op == "<=" else (F.col(name) > F.lit(float(at))))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {op} {at:.6g}" for n, op, at in self.tests) or "TRUE"


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """An ordered condition: the number of the first rule that covers the row, or -1."""
        out = None
        for k, rule in enumerate(self.rules):
            out = F.when(rule.condition(), F.lit(k)) if out is None else out.when(rule.condition(), F.lit(k))
        return F.lit(-1) if out is None else out.otherwise(F.lit(-1))


def _best_test(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...]) -> tuple[float, tuple[str, str, float] | None]:
    """The test with the highest information gain of first-order learning over the rows given."""
    p0, n0 = bad.sum(), (~bad).sum()
    base = np.log2(p0 / (p0 + n0))
    best, found = 0.0, None
    for c, name in enumerate(names):
        order = np.argsort(x[:, c], kind="stable")
        v, b = x[order, c], bad[order]
        ends = np.flatnonzero(np.diff(v) > 0)
        if not len(ends):
            continue
        p_low, n_low = np.cumsum(b)[ends], np.cumsum(~b)[ends]
        for op, p, n in (("<=", p_low, n_low), (">", p0 - p_low, n0 - n_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, found = float(gain[k]), (name, op, float((v[ends[k]] + v[ends[k] + 1]) / 2))
    return best, found


def learn_list(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = FEATURES, max_rules: int = 16, max_tests: int = 4, precision: float = 0.97, least: int = 10) -> DecisionList:
    """Sequential covering: grow a rule on two thirds of what is left, prune it on the rest, remove what it covers.

    A rule is kept if its precision over both parts is at least ``precision``
    and it covers ``least`` rejected rows or more.
    """
    out, left = DecisionList(), np.ones(len(x), bool)
    prune_part = np.arange(len(x)) % 3 == 2
    while len(out.rules) < max_rules and bad[left].sum() >= least:
        grow, prune = left & ~prune_part, left & prune_part
        rows, tests = np.flatnonzero(grow), []
        while len(tests) < max_tests and bad[rows].any() and not bad[rows].all():
            _, test = _best_test(x[rows], bad[rows], names)
            if test is None:
                break
            tests.append(test)
            rows = rows[Rule((test,)).covers(x[rows], names)]

        def worth(k: int) -> float:
            hit = prune & Rule(tuple(tests[:k])).covers(x, names)
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        if not tests:
            break
        kept = max(range(1, len(tests) + 1), key=lambda k: (round(worth(k), 3), -k))
        rule = Rule(tuple(tests[:kept]))
        hit = left & rule.covers(x, names)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if p < least or p / (p + n) < precision:
            break
        out.rules.append(rule)
        left &= ~hit
    return out


def train_rules(docs: DataFrame, labels: DataFrame, per_grade: int = 4000, seed: int = 8, **options) -> DecisionList:
    """Learn from the statistics of a hash sample of about ``per_grade`` labelled documents of each grade.

    The sample's ids, of bounded number, are broadcast to the documents, so
    that only their statistics are computed and sent to the driver.
    """
    sample = labelled_sample(labels.where("quality is not null and doc_id is not null").select("doc_id", "quality"), "quality", per_grade, "doc_id", seed)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "l_id")), F.col("doc_id") == F.col("l_id"))
    got = text_statistics(chosen, keep=("quality",)).select("doc_id", "quality", "n_repeat_words", *FEATURES).orderBy("doc_id").collect()
    # Documents that fail the base rules never reach the list.
    rows = [r for r in got if r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]]
    if not rows:
        return DecisionList()
    x = np.array([[float(r[f]) for f in FEATURES] for r in rows])
    return learn_list(x, np.array([r["quality"] == 0 for r in rows]), **options)


def apply_rules(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, the number of the rule that rejects (-1: none), and kept.

    Null and empty texts have zeros and fail the base rules; repeated rows are
    judged one by one; other columns of ``docs`` are left out.
    """
    stats = text_statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", rules.verdict())
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("rule") < 0)).alias("kept"), "rule")
