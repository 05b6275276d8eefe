"""Quality rules: a table of thresholds compiled into one Spark projection.

Every figure is a DataFrame expression over the whole text, so the rules run
inside the JVM without user functions. A word is a run of characters other than
ASCII white space.

Limit: the stop words are of English, German, French and Spanish alone, so a clean
text in another language (Russian, Polish, Chinese) fails the stop-word rule and isn't
kept. The SQL that defines ``kept`` has the same list.

Defined results: null and empty texts have no words, all figures zero, and fail
the base rules; a ratio over nothing is zero; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the languages at hand.
STOP_WORDS = (
    "the of and to in is was for with that this are be by on as at from it an or not "
    "der die das und ist von mit den dem zu ein eine nicht auf für sich des im auch "
    "de la le les et des un une est que pour dans qui sur par pas au avec du en ne "
    "el los las y una es por con para del se no su lo al como"
)

#: (rule, figure, lowest value, highest value); a bound of None doesn't bind.
THRESHOLDS = (
    ("long enough", "n_words", 20, None),
    ("repeated windows", "repeat_ratio", None, 0.30),
    ("word length", "mean_word_chars", 1.5, 40.0),
    ("symbols", "symbol_ratio", None, 0.50),
    ("repeated lines", "dup_line_ratio", None, 0.50),
    ("bullet lines", "bullet_ratio", None, 0.95),
    ("ellipsis lines", "ellipsis_ratio", None, 0.60),
    ("stop words", "stop_ratio", 0.005, None),
    ("separators", "bar_ratio", None, 0.30),
)
#: The rules that the base figures decide exactly, in whole numbers.
BASE_RULES = ("long enough", "repeated windows")
WINDOW = 8

_WORD_GAP = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _WORD_GAP), lambda w: w != "")


def _is_stop(word: Column) -> Column:
    """Whether a lower-cased word is a stop word, or is one but for what isn't a letter at its ends."""
    stops = list(dict.fromkeys(STOP_WORDS.split()))
    return word.isin(stops) | (word.rlike(r"^[^\p{L}]|[^\p{L}]$") & F.regexp_replace(word, r"^[^\p{L}]+|[^\p{L}]+$", "").isin(stops))


#: Hashes of windows by the hashes of their words; where none occurs twice no window does. (An array that
#: a lambda reads is referred to twice, here and below: else the optimizer would make it anew for each element.)
_HASHES = f"""
case when size(word_hashes) >= {WINDOW} then transform(sequence(1, size(word_hashes) - {WINDOW - 1}), i -> xxhash64(slice(word_hashes, i, {WINDOW}))) end
"""
_HASHES_SORTED = """
case when size(array_distinct(win_hash)) < size(win_hash) then sort_array(transform(win_hash, (h, i) -> struct(h as h, i + 1 as i))) else cast(array() as array<struct<h:bigint,i:int>>) end
"""
#: The windows whose hash occurs twice, by their own words, which decide.
_SORTED = f"""
sort_array(transform(filter(transform(hash_sorted, (x, k) -> case when
    (k > 0 and hash_sorted[k - 1].h = x.h) or (k < size(hash_sorted) - 1 and hash_sorted[k + 1].h = x.h)
  then x.i end), i -> i is not null), i -> struct(array_join(slice(words, i, {WINDOW}), ' ') as w, i as i)))
"""
#: Fold over windows in order of their words: within equal windows places rise, so the places to
#: cover are gathered first and then measured in order.
_REPEATED = """
filter(transform(win_sorted, (x, k) -> case when
    (k > 0 and win_sorted[k - 1].w = x.w) or (k < size(win_sorted) - 1 and win_sorted[k + 1].w = x.w)
  then x.i end), i -> i is not null)
"""
_COVERED = f"""
aggregate(sort_array(repeated), struct(cast(0 as bigint) as n, cast(0 as bigint) as upto),
  (s, i) -> struct(s.n + (i + {WINDOW - 1}) - greatest(s.upto, cast(i - 1 as bigint)) as n, cast(i + {WINDOW - 1} as bigint) as upto),
  s -> s.n)
"""


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the figures that the rules speak of, counts as longs and ratios as doubles."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    base = base.select(
        "id",
        "text",
        _words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, _WORD_GAP, "") != "").alias("lines"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", _WORD_GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^|]+", "")).cast("long").alias("n_bars"),
    )
    base = base.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("word_hashes"),
    )
    for name, made in (("win_hash", _HASHES), ("hash_sorted", _HASHES_SORTED), ("win_sorted", _SORTED), ("repeated", _REPEATED), ("n_repeat_words", _COVERED)):
        base = base.withColumn(name, F.expr(made))
    n_stop = F.size(F.filter(_words(F.lower("text")), _is_stop))
    n_lines = F.size("lines")
    share = lambda part, whole: F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))
    return base.select(
        "id",
        "n_words",
        "word_chars",
        "n_symbols",
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        share(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_ratio"),
        share(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        share(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        share(n_lines - F.size(F.array_distinct("lines")), n_lines).alias("dup_line_ratio"),
        share(F.size(F.filter("lines", lambda x: x.rlike(r"^[ \t]*[-*•]"))), n_lines).alias("bullet_ratio"),
        share(F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[ \t\r]*$"))), n_lines).alias("ellipsis_ratio"),
        share(n_stop, F.col("n_words")).alias("stop_ratio"),
        share(F.col("n_bars"), F.col("n_words")).alias("bar_ratio"),
    )


def verdict(rows: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """``figures`` with ``failed``, the names of the rules that a row breaks, in the table's order."""
    checks = []
    for name, figure, low, high in thresholds:
        if name == "repeated windows" and high is not None:  # in whole numbers, as the base rule says
            bad = F.col("n_repeat_words") * 100 > F.col("n_words") * round(high * 100)
        else:
            bad = F.lit(False)
            if low is not None:
                bad = bad | (F.col(figure) < low)
            if high is not None:
                bad = bad | (F.col(figure) > high)
        checks.append(F.when(bad, F.lit(name)))
    return rows.withColumn("failed", F.filter(F.array(*checks), lambda x: x.isNotNull()))


def rules_report(docs: DataFrame) -> DataFrame:
    """The digest of ``verdict`` per document row."""
    judged = verdict(figures(docs))
    base = F.exists("failed", lambda x: x.isin(*BASE_RULES))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.size("failed") == 0).alias("kept")
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that break a rule; all columns stay as they are."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id"), F.col(text_col).alias("text"))
    judged = verdict(figures(packed, "id", "text")).withColumn("place", F.monotonically_increasing_id())  # no filter is pushed below this
    return judged.where(F.size("failed") == 0).select("id.*")


_STOPS_SQL = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS.split()))
REPORT_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY rid),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words,
         len(l) AS nl,
         len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullet,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS n_dots,
         len(list_filter(w, lambda x: list_contains([{_STOPS_SQL}], regexp_replace(lower(x), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')))) AS n_stop,
         length(regexp_replace(t, '[^|]+', '', 'g')) AS n_bars
  FROM d LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 40 AND n_symbols / n_words <= 0.5
       AND (nl = 0 OR (n_dup_lines / nl <= 0.5 AND n_bullet / nl <= 0.95 AND n_dots / nl <= 0.6))
       AND n_stop / n_words >= 0.005 AND n_bars / n_words <= 0.3 AS kept
FROM b
"""
