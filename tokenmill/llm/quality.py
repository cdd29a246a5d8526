"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Four ratios of a text are compared with the usual range of its language and source. The ranges come from
quantile sketches: one per language and source, built in one pass and merged upwards to languages and to the
whole corpus, which stand in where a group is too small to tell.

A signal is unusual beyond a fence of ``SPREADS`` interquartile ranges around the quartiles, and also in the outmost
``TAIL`` of the group if it is further from the quartile than the least range. The fence finds outliers where
they are many; the tail finds them where the group itself is so wide that the fence lies beyond all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import SPACE, stage

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30  # percent
SKETCH = 2048  # size parameter of a sketch; the error of a rank is about a thousandth
LEAST_ROWS = 100  # documents from which a group's own sketch counts
SPREADS = 3.0  # interquartile ranges beyond the quartiles that are still usual
TAIL = 0.01  # part of a group at either end that is unusual if it is off the quartile by more than the least range
#: Least range that is assumed for each signal, so that a group of very even texts rejects nothing for a small
#: difference. ``SPREADS`` times the range must stay well inside the values that the base rules let pass.
SIGNALS = {"mean_chars": 0.5, "symbol_share": 0.02, "dup_line_share": 0.06, "repeat_share": 0.05}


def _bound(value: Column, use) -> Column:
    """Evaluates ``value`` once and hands it to ``use`` as a variable."""
    return F.transform(F.array(value), use)[0]


def _repeated(windows: Column) -> Column:
    """Words in windows that occur twice or more; a window is the hash of ``WINDOW`` words."""
    def places(found: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(found, j)["h"] == e["h"], F.lit(False))
        twice = F.filter(found, lambda e, i: same(e, i - 1) | same(e, i + 1))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    found = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _bound(_bound(found, places), covered)).otherwise(0)


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, the counts of whole texts, and the ratios in ``SIGNALS``. Nothing is shuffled."""
    t = docs.select(F.col(id_col).alias("doc_id"), "lang", "source", F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.withColumn("words", F.filter(F.split("t", SPACE + "+"), lambda x: x != ""))
    t = t.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    inner = F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    t = t.withColumn("windows", F.when(F.size("hashes") >= WINDOW, inner).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    chars = F.length(F.translate("t", BLANKS, ""))
    counts = t.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("windows")).cast("long").alias("n_repeat_words"),
    )
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return counts.select(
        "*", (F.col("word_chars") / words).alias("mean_chars"), (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"), (F.col("n_repeat_words") / words).alias("repeat_share"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).alias("base_failed"),
    )


def _merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(s, SKETCH).alias(s) for s in SIGNALS])


def thresholds(counted: DataFrame) -> DataFrame:
    """Per language and source: the least and greatest usual value of each signal.

    Only documents that pass the base rules go into the sketches. A group with fewer than ``LEAST_ROWS`` of them
    takes its language's range, and if that has too few, the corpus'; so does a group with none.
    """
    good = counted.filter("not base_failed")
    sketches = stage(
        good.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(s, SKETCH).alias(s) for s in SIGNALS]),
        "sketches",
    )
    every = counted.select("lang", "source").distinct()
    levels = [(sketches, ["lang", "source"]), (_merged(sketches, ["lang"]), ["lang"]), (_merged(sketches, []), [])]
    out = every
    for i, (level, keys) in enumerate(levels):
        limits = []
        for s, least in SIGNALS.items():
            end, low, high, top = (F.kll_sketch_get_quantile_double(s, F.lit(q)) for q in (TAIL, 0.25, 0.75, 1 - TAIL))
            spread = F.greatest(high - low, F.lit(least)) * SPREADS
            limits.append(F.struct(F.greatest(low - spread, F.least(end, low - least)).alias("low"),
                                   F.least(high + spread, F.greatest(top, high + least)).alias("high")).alias(s))
        level = level.filter((F.col("n") >= LEAST_ROWS) if i < 2 else (F.col("n") > 0))
        level = level.select(*[F.col(k).alias(f"{k}_key") for k in keys], F.struct(*limits).alias(f"level{i}"))
        on = [out[k].eqNullSafe(level[f"{k}_key"]) for k in keys]
        out = out.join(level, on, "left") if keys else out.join(F.broadcast(level), how="left")  # one row
        out = out.drop(*[f"{k}_key" for k in keys])
    return out.select("lang", "source", F.coalesce("level0", "level1", "level2").alias("limits"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, and the rule that rejects (or null).

    A document is kept if it passes the base rules and each of its signals lies in the usual range of its
    language and source; a null language or source is a group like others. A null or empty text has no words
    and fails the base rules. Rows with one id are judged one by one; an empty table gives an empty result;
    columns other than the id, the text, lang and source are not looked at. Quantiles are estimates, so two
    runs may disagree on a text that lies exactly on a limit.
    """
    counted = stage(signals(docs, id_col, text_col), "signals")
    limits = stage(thresholds(counted), "thresholds")
    a, b = counted.alias("a"), limits.alias("b")
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    broken = F.when(F.col("base_failed"), F.lit("base"))
    for s in SIGNALS:
        broken = broken.when((F.col(s) < F.col("limits")[s]["low"]) | (F.col(s) > F.col("limits")[s]["high"]), F.lit(s))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        broken.isNull().alias("kept"), broken.alias("broken_rule"),
    )
