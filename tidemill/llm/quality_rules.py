"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, let

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the and of to in is it that was for with as on by this are at be an or a i "
    "le la les de des et un une que qui en dans est pour pas il elle ne ce on "
    "der die das und ist von mit den ein eine nicht zu auf im ich sie es sich "
    "el los las y que se del no una por con para su al lo es mi"
).split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule when ``metric`` lies outside [low, high] and it has at least ``min_words`` words."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Production thresholds. Ratios are per word character, word or line.
RULES = (
    Rule("n_words", low=20),
    Rule("repeat_word_ratio", high=0.30),
    Rule("mean_word_length", low=2.0, high=14.0),
    Rule("symbol_ratio", high=0.08),
    Rule("dup_line_ratio", high=0.50),
    Rule("stop_word_ratio", low=0.01, min_words=100),
)
#: The rules whose failure alone is reported as ``base_failed``.
BASE = ("n_words", "repeat_word_ratio")


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text, with built-in functions only. Null and empty texts have no words and no
    lines: every count is 0."""
    body = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(body, SPACE_PATTERN), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda s: F.translate(s, SPACES, "") != "")
    trimmed = lambda w: F.translate(F.lower(w), ".,;:!?\"'()", "")
    per_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: trimmed(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    per_lines = let(
        lines,
        lambda s: F.struct(
            F.size(s).cast("long").alias("n_lines"),
            (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        ),
    )
    return F.struct(
        per_words.alias("w"),
        per_lines.alias("l"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def text_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the struct column ``stats``. Columns of the input named like a count do not matter, since all counts are fields
    of one struct; an input column called ``stats`` is replaced."""
    return df.withColumn("stats", statistics(F.col(text)))


def _repeat_words(words: Column) -> Column:
    """Words inside an eight-word window whose words occur in the same order at another place of the text too.

    Windows are sorted by a 64-bit hash of their words next to their position; equal neighbours are repeats. The
    union of their spans is a sum of gaps between sorted starts, each at most the window length.
    """
    n = F.size(words)
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))

    def starts(h: Column) -> Column:
        windows = F.sort_array(
            F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.struct(F.xxhash64(F.slice(h, i, WINDOW)).alias("h"), i.alias("i")))
        )
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        return let(
            windows,
            lambda s: F.sort_array(
                F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"])
            ),
        )

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(hashed(words), lambda h: let(starts(h), covered)))


def metric_columns(stats: Column) -> dict[str, Column]:
    """The metrics a rule can name; a ratio over nothing is 0."""
    w, l = stats["w"], stats["l"]  # noqa: E741
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "n_words": w["n_words"].cast("double"),
        "repeat_word_ratio": ratio(w["n_repeat_words"], w["n_words"]),
        "mean_word_length": ratio(stats["word_chars"], w["n_words"]),
        "symbol_ratio": ratio(stats["n_symbols"], stats["word_chars"]),
        "dup_line_ratio": ratio(l["n_dup_lines"], l["n_lines"]),
        "stop_word_ratio": ratio(w["n_stop_words"], w["n_words"]),
    }


def broken(rule: Rule, stats: Column) -> Column:
    """Whether the document breaks the rule."""
    value = metric_columns(stats)[rule.metric]
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < rule.low)
    if rule.high is not None:
        # Exact at the limit: compare products instead of a rounded quotient.
        num, den = {
            "repeat_word_ratio": (stats["w"]["n_repeat_words"], stats["w"]["n_words"]),
            "symbol_ratio": (stats["n_symbols"], stats["word_chars"]),
            "dup_line_ratio": (stats["l"]["n_dup_lines"], stats["l"]["n_lines"]),
        }.get(rule.metric, (None, None))
        out = out | ((100 * num > round(100 * rule.high) * den) if num is not None else (value > rule.high))
    if rule.min_words:
        out = out & (stats["w"]["n_words"] >= rule.min_words)
    return out


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add ``stats``, ``broken`` (names of the broken rules' metrics) and ``kept``, in one projection.

    Every row of the input, repeated ones too, comes back once. Null or empty texts break ``n_words`` and are not
    kept. An input column named like one of the three is replaced; other columns stay.
    """
    out = text_statistics(df, text)
    names = F.array_compact(F.array(*[F.when(broken(r, F.col("stats")), F.lit(r.metric)) for r in rules])) if rules else F.array().cast("array<string>")
    out = out.withColumn("broken", names)
    return out.withColumn("kept", F.size("broken") == 0)


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of the input that break no rule, with its own columns.

    The counts are bound once inside the predicate; a filter on a column of ``judge`` would repeat them for every rule.
    """

    def good(s: Column) -> Column:
        out = F.lit(True)
        for r in rules:
            out = out & ~broken(r, s)
        return out

    return df.filter(let(statistics(F.col(f"`{text}`")), good))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_EIGHT = " || ' ' || ".join(["x", *[f"lead(x, {k}) OVER o" for k in range(1, WINDOW)]])
#: The statistics and the verdict of RULES as DuckDB SQL over ``documents``.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT r, i, {_EIGHT} AS k FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM k WHERE k IS NOT NULL),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS n FROM g WHERE c > 1),
q AS (SELECT r, sum(least(8, coalesce(n - i, 8))) AS n FROM p GROUP BY r),
s AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(q.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: list_contains([{_STOP}], regexp_replace(lower(x), '[.,;:!?"''()]', '', 'g')))) AS n_stop FROM w LEFT JOIN q ON w.r = q.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 100 * n_symbols > 8 * word_chars OR 100 * n_dup_lines > 50 * n_lines OR (n_words >= 100 AND 100 * n_stop < n_words)) AS kept
FROM s
"""
