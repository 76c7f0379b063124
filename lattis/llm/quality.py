"""Quality rules with adaptive thresholds (DataFrame and SQL functions only).

Every document gets integer measures: symbols and repeated words per 1000 words, repeated lines per 1000 lines, and letters per 100
words. One symbol, one repeated line or one repeated passage of up to WINDOW + 4 words isn't a pattern and doesn't count. For each
language and source the measures are gathered in mergeable quantile sketches: log-linear histograms (exact below 32, then 16 bins a
power of two), which merge by adding counts. A document is rejected when a base rule fails or a measure lies beyond the fence of
its group, ``median + spread * width``. The width is the larger of ``median - p10``, which junk above the median can't move, and
``p90 - median``, which is at most that of the language and of the whole corpus. There is no fixed part: where nearly all documents
of a group measure 0 the fence is 0, where a kind of text usually has more its fence is higher. Groups with fewer than ``least``
rows take the sketch merged over their language, and small languages the sketch of the whole corpus. More junk than clean text in a
group moves its median.

Defined results: null or empty text has no words, fails the base rule and joins no sketch; texts of any length are measured whole; a
measure equal to the fence is kept; null language or source is a group of its own; repeated rows are judged one by one; an empty
table gives no rows; other columns of the input, whatever their names, are ignored (the stage returns them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, sql_words, stored, table

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: measure: numerator, denominator
MEASURES = {
    "symbols": ("1000 * greatest(n_symbols - 1, 0)", "n_words"),
    "dup_lines": ("1000 * greatest(n_dup_lines - 1, 0)", "n_lines"),
    "repeats": (f"1000 * greatest(n_repeat_words - 2 * ({WINDOW} + 4), 0)", "n_words"),
    "word_length": ("100 * word_chars", "n_words"),
}
LEAST_ROWS, SPREAD = 50, 4


def measures(docs: DataFrame) -> DataFrame:
    """docs' columns doc_id, lang, source and text, with the counts of the base rules; text is dropped."""
    hashes = ", ".join(f"get(hw, i + {k})" for k in range(WINDOW))
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
    )
    d = d.withColumn("row_id", F.xxhash64("doc_id", "text", "lang", "source"))
    d = d.withColumn("words", F.expr(sql_words()))
    d = d.withColumn("lines", F.expr(r"filter(split(coalesce(text, ''), '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.select(
        "doc_id", "row_id", "lang", "source",
        F.expr("bigint(size(words))").alias("n_words"),
        F.expr("bigint(length(array_join(words, '')))").alias("word_chars"),
        F.expr("bigint(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '')))").alias("n_symbols"),
        F.expr("bigint(size(lines))").alias("n_lines"),
        F.expr("bigint(size(lines) - size(array_distinct(lines)))").alias("n_dup_lines"),
        F.expr("transform(words, w -> xxhash64(w))").alias("hw"),
    )
    d = d.withColumn("wh", F.expr(f"if(n_words >= {WINDOW}, transform(sequence(0, size(hw) - {WINDOW}), i -> xxhash64({hashes})), array())"))
    d = d.withColumn("found", F.expr("if(size(array_distinct(wh)) < size(wh), array_sort(transform(wh, (h, i) -> struct(h, i))), array())"))
    d = d.withColumn("at", F.expr("array_sort(transform(filter(found, (x, i) -> coalesce(x.h = get(found, i - 1).h, false) or coalesce(x.h = get(found, i + 1).h, false)), x -> x.i))"))
    n = f"aggregate(transform(at, (p, i) -> least({WINDOW}, coalesce(get(at, i + 1) - p, {WINDOW}))), 0, (a, b) -> a + b)"
    return d.withColumn("n_repeat_words", F.expr(f"bigint({n})")).drop("hw", "wh", "found", "at")


def _bin(v: str) -> str:
    """SQL for the bin of a whole number: its lower bound is exact below 32, then within 1/16."""
    return f"if({v} < 32, {v}, shiftleft(shiftright({v}, length(bin({v})) - 5), length(bin({v})) - 5))"


def thresholds(m: DataFrame, least: int = LEAST_ROWS, spread: int = SPREAD) -> DataFrame:
    """The fences of each lang and source: one row (lang, source, f_<measure>...)."""
    cells = ", ".join(f"struct('{k}' as measure, {_bin(f'({a} div {b})')} as bin)" for k, (a, b) in MEASURES.items())
    cells = m.where("n_words > 0").select("lang", "source", F.expr(f"inline(array({cells}))"))
    leaf = cells.groupBy("lang", "source", "measure", "bin").count()
    # sketches merge by adding counts: a language from its sources, the corpus from its languages
    lang = leaf.groupBy("lang", "measure", "bin").agg(F.sum("count").alias("count"))
    every = lang.groupBy("measure", "bin").agg(F.sum("count").alias("count"))

    def fences(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
        by = ", ".join([*keys, "measure"])
        run = sketch.selectExpr("*", f"sum(count) over (partition by {by} order by bin) as run", f"sum(count) over (partition by {by}) as n")
        quantile = [F.min(F.expr(f"if(run * 10 >= n * {tenths}, bin, null)")).alias(name) for name, tenths in (("low", 1), ("mid", 5), ("high", 9))]
        q = run.groupBy(*keys, "measure").agg(F.max("n").alias("n"), *quantile).selectExpr(*keys, "measure", "n", "mid", "mid - low as under", "high - mid as over")
        one = [F.max(F.when(F.col("measure") == k, F.col(c))).alias(f"{tag}_{k}_{c}") for k in MEASURES for c in ("mid", "under", "over")]
        return q.groupBy(*keys).agg(F.max("n").alias(f"{tag}_n"), *one)

    def fence(k: str, tags: str) -> str:
        # the wider sketches bound the upper width, so junk in one group can't raise its own fence
        over = f"least({', '.join(f'{t}_{k}_over' for t in tags)})" if len(tags) > 1 else f"{tags}_{k}_over"
        return f"{tags[0]}_{k}_mid + {spread} * greatest({tags[0]}_{k}_under, {over})"

    out = fences(leaf, ["lang", "source"], "s")
    langs = fences(lang, ["lang"], "l").withColumnRenamed("lang", "l_lang")
    out = out.join(langs, F.col("lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(F.broadcast(fences(every, [], "a")))  # the last is one row
    pick = [F.expr(f"case when s_n >= {least} then {fence(k, 'sla')} when l_n >= {least} then {fence(k, 'la')} else {fence(k, 'a')} end").alias(f"f_{k}") for k in MEASURES]
    return out.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *pick)


def judge(docs: DataFrame, least: int = LEAST_ROWS, spread: int = SPREAD) -> DataFrame:
    """One row per row of docs: its counts, base_failed and kept; row_id joins back to docs."""
    m = stored(measures(docs))
    t = thresholds(m, least, spread)
    j = m.join(t, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    bad = " or ".join(f"coalesce({a} div nullif({b}, 0) > f_{k}, false)" for k, (a, b) in MEASURES.items())
    j = j.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))
    return j.withColumn("kept", F.expr(f"not base_failed and not ({bad})")).drop("g_lang", "g_source", *[f"f_{k}" for k in MEASURES])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    row, key = fresh(docs, "good_row"), fresh(docs, "good_id")
    good = judge(docs).where("kept").select(F.col("row_id").alias(row), F.col("doc_id").alias(key)).distinct()
    mine = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    return docs.join(good, (mine == F.col(row)) & F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left_semi")


_DUCK_BIN = "CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 5)) << (length(bin(v)) - 5) END"


def _duck_fences(src: str, keys: str) -> str:
    part = f"{keys}, measure" if keys else "measure"
    return f"""SELECT {part}, n, mid, mid - low AS under, high - mid AS over FROM (SELECT {part}, max(n) AS n, min(bin) FILTER (run * 10 >= n) AS low,
      min(bin) FILTER (run * 10 >= n * 5) AS mid, min(bin) FILTER (run * 10 >= n * 9) AS high
      FROM (SELECT *, sum(c) OVER (PARTITION BY {part} ORDER BY bin) AS run, sum(c) OVER (PARTITION BY {part}) AS n FROM {src}) GROUP BY {part})"""


ORACLE = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
u AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM w WHERE len(words) >= {WINDOW}),
x AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p:p + {WINDOW - 1}]) AS c FROM u),
r AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM x, range({WINDOW}) t(k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda z: regexp_matches(z, '[^\\x20\\x09-\\x0D]')) AS l FROM w) w LEFT JOIN r USING (doc_id)),
cells AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS measure, CAST({a} AS BIGINT) // {b} AS v FROM m WHERE n_words > 0" for k, (a, b) in MEASURES.items())}),
leaf AS (SELECT lang, source, measure, {_DUCK_BIN} AS bin, count(*) AS c FROM cells GROUP BY ALL),
lg AS (SELECT lang, measure, bin, sum(c) AS c FROM leaf GROUP BY ALL),
ev AS (SELECT measure, bin, sum(c) AS c FROM lg GROUP BY ALL),
fs AS ({_duck_fences("leaf", "lang, source")}), fl AS ({_duck_fences("lg", "lang")}), fe AS ({_duck_fences("ev", "")}),
bad AS (SELECT c.doc_id, bool_or(v > CASE WHEN fs.n >= {LEAST_ROWS} THEN fs.mid + {SPREAD} * greatest(fs.under, least(fs.over, fl.over, fe.over))
    WHEN fl.n >= {LEAST_ROWS} THEN fl.mid + {SPREAD} * greatest(fl.under, least(fl.over, fe.over)) ELSE fe.mid + {SPREAD} * greatest(fe.under, fe.over) END) AS bad
  FROM cells c JOIN fs ON c.measure = fs.measure AND c.lang IS NOT DISTINCT FROM fs.lang AND c.source IS NOT DISTINCT FROM fs.source
  JOIN fl ON c.measure = fl.measure AND c.lang IS NOT DISTINCT FROM fl.lang JOIN fe ON c.measure = fe.measure GROUP BY c.doc_id),
b AS (SELECT m.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad.bad, false) AS kept
FROM b LEFT JOIN bad USING (doc_id)
"""
