"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression over the whole text and every rule is a
row ``(name, metric, low, high)``; the table compiles into one boolean per rule
and a verdict, without user functions and without a shuffle.

Defined results: a null text counts as empty (no words: the base rule
``min_words`` fails, so the row is not kept); ratios of a text without words or
lines are 0; null ids, repeated ids and clashing extra columns pass through
untouched (each row is judged alone; result columns replace columns of the same
name); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, beside

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
# Frequent function words of the four languages (fixed values).
STOP_WORDS = ["a", "and", "as", "at", "be", "by", "for", "from", "have", "in", "is", "it", "not", "of", "on",
              "or", "that", "the", "this", "to", "was", "with",
              "au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas",
              "pour", "que", "qui", "sur", "un", "une",
              "als", "auch", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "ist", "mit",
              "nicht", "sich", "und", "von", "zu",
              "con", "del", "el", "es", "las", "los", "más", "no", "para", "por", "se", "su", "y"]


@dataclass(frozen=True)
class Rule:
    """Passes when ``low <= metric <= high`` (either bound may be open) or the
    text has fewer than ``from_words`` words."""
    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = [
    Rule("word_count", "n_words", 10),
    Rule("mean_word_length", "mean_word_chars", 2.5, 12.0),
    Rule("symbol_ratio", "symbols_per_word", None, 0.1),
    Rule("duplicate_lines", "dup_line_share", None, 0.5),
    Rule("repeated_windows", "repeat_word_share", None, 0.2),
    Rule("upper_case", "upper_word_share", None, 0.5, 10),
    Rule("exclamations", "exclamations_per_word", None, 0.5),
    Rule("ellipsis_lines", "ellipsis_line_share", None, 0.3, 10),
    Rule("bullet_lines", "bullet_line_share", None, 0.9, 10),
    Rule("letters", "letter_word_share", 0.7, None, 10),
    Rule("stop_words", "stop_word_share", 0.01, None, 50),
]


RESULTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "mean_word_chars",
           "symbols_per_word", "dup_line_share", "repeat_word_share", "upper_word_share", "exclamations_per_word",
           "ellipsis_line_share", "bullet_line_share", "letter_word_share", "stop_word_share",
           "failed_rules", "base_failed", "kept"]


def _repeat_words() -> Column:
    """Words covered by 5-word windows found twice or more: sort the windows that
    recur by place and add up what each covers beyond the one before it."""
    return F.expr("aggregate(_again, named_struct('n', 0L, 'last', -5), "
                  "(a, p) -> named_struct('n', a.n + CAST(least(5, p - a.last) AS BIGINT), 'last', p), a -> a.n)")


def _metrics(d: DataFrame) -> DataFrame:
    """Counts and ratios beside a non-null column ``text``."""
    blanks, length = F.lit(BLANKS), F.length("text")
    d = d.withColumns({
        "_w": F.filter(F.split("text", SPACE), lambda w: w != F.lit("")),
        "_lines": F.filter(F.split("text", "\n"), lambda x: F.btrim(x, blanks) != F.lit("")),
    })
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        "word_chars": F.length(F.translate("text", BLANKS, "")).cast("long"),
        "n_symbols": (length - F.length(F.translate("text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_bang": (length - F.length(F.translate("text", "!", ""))).cast("long"),
        "_upper": F.size(F.filter("_w", lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))),
        "_letters": F.size(F.filter("_w", lambda w: w.rlike(r"\p{L}"))),
        "_stops": F.size(F.filter("_w", lambda w: F.lower(F.btrim(w, F.lit(".,;:!?"))).isin(STOP_WORDS))),
        "_ellipsis": F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)[ \t\r]*$"))),
        "_bullets": F.size(F.filter("_lines", lambda x: x.rlike(r"^[ \t]*[•*\-–]"))),
    })
    d = d.withColumn("_win", F.expr(
        "CASE WHEN size(_h) > 5 THEN transform(sequence(0, size(_h) - 5), "
        "i -> xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4])) ELSE CAST(array() AS array<bigint>) END"))
    d = d.withColumn("_sorted", F.expr(
        "CASE WHEN size(array_distinct(_win)) < size(_win) "
        "THEN sort_array(transform(_win, (h, i) -> named_struct('h', h, 'i', i))) END"))
    d = d.withColumn("_again", F.expr(
        "CASE WHEN _sorted IS NULL THEN CAST(array() AS array<int>) ELSE sort_array(transform("
        "filter(_sorted, (x, k) -> x.h <=> get(_sorted, k - 1).h OR x.h <=> get(_sorted, k + 1).h), x -> x.i)) END"))
    d = d.withColumn("n_repeat_words", _repeat_words())
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.withColumns({
        "mean_word_chars": ratio("word_chars", "n_words"), "symbols_per_word": ratio("n_symbols", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"), "repeat_word_share": ratio("n_repeat_words", "n_words"),
        "upper_word_share": ratio("_upper", "n_words"), "exclamations_per_word": ratio("_bang", "n_words"),
        "ellipsis_line_share": ratio("_ellipsis", "n_lines"), "bullet_line_share": ratio("_bullets", "n_lines"),
        "letter_word_share": ratio("_letters", "n_words"), "stop_word_share": ratio("_stops", "n_words"),
    })


def compile_rules(rules=tuple(RULES)) -> dict[str, Column]:
    """Rule table -> one boolean column per rule (true: the rule passes)."""
    out = {}
    for r in rules:
        m, ok = F.col(r.metric), F.lit(True)
        if r.low is not None:
            ok = ok & (m >= r.low)
        if r.high is not None:
            ok = ok & (m <= r.high)
        out[r.name] = ok | (F.col("n_words") < r.from_words) if r.from_words else ok
    return out


def apply_rules(df: DataFrame, text: str = "text", rules=tuple(RULES)) -> DataFrame:
    """Input columns, metrics, ``failed_rules`` (names in table order),
    ``base_failed`` and the verdict ``kept``.  To filter by the verdict use
    ``quality_filter``: a filter straight on this frame has the optimiser copy every
    metric into the condition, which takes it very long."""
    def step(d: DataFrame) -> DataFrame:
        failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in compile_rules(rules).items()]),
                          lambda x: x.isNotNull())
        base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
        d = _metrics(d).withColumns({"failed_rules": failed, "base_failed": base})
        return d.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return beside(df, text, step, RESULTS)


def quality_filter(df: DataFrame, text: str = "text", rules=tuple(RULES)) -> DataFrame:
    """The rows whose verdict is to keep, with their own columns only."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("input"),
                       F.col(f"`{text}`").alias("text"))
    # the partition number keeps the optimiser from copying every metric into the filter
    judged = apply_rules(packed, "text", rules).withColumn("partition", F.spark_partition_id())
    return judged.where((F.col("partition") >= 0) & F.col("kept")).select("input.*")
