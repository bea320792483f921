"""Quality rules with thresholds from quantile sketches per language and source.

Every text's statistics are computed inside its row by array functions. The
statistics of each (language, source) are summarised by KLL sketches, which
merge, so a language's sketch is the merge of its sources'. Fences drawn from
the quantiles replace fixed cutoffs and are joined back to the rows.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweft.llm.runtime import materialize, prepare

# Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
PRIOR_TEXTS = 30  # a group of n texts has the weight n / (n + PRIOR_TEXTS) against the larger group it belongs to
SKETCH_K = 800
# statistic: rank of the tail quantile that fences start from; how many times the
# distance from the median to it they lie beyond it (normal values: 4.6 standard
# deviations or more from the median); and the least room. Of symbols that is so
# many a text of the group's median length, so it follows the group as well: fewer
# may stand in any text by chance. Junk shows in symbols and word lengths and may fill a fifth of a
# source; most texts repeat nothing, so only far ranks tell how much is usual.
STATISTICS = {
    "symbol_rate": (0.8, 4.5, 3.0),
    "dup_line_rate": (0.99, 1.0, 0.01),
    "repeat_rate": (0.99, 2.0, 0.01),
    "mean_chars": (0.8, 4.5, 0.1),
}
LENGTH = "n_words"  # summarised too, for its median
_NOT_BLANK = r"[^\x20\x09-\x0D]"

# One number per 3-word window, its hash above its position; sorted, equal
# windows are neighbours. The position takes the bits the text's length needs,
# so windows found alike are only likely to be; they are compared by whole hashes.
_BITS = "length(bin(size(words)))"
_PACKED = f"""CASE WHEN size(words) < 3 THEN CAST(array() AS array<bigint>) ELSE sort_array(transform(
  sequence(0, size(words) - 3),
  i -> shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), {_BITS}) | i)) END"""
_LIKELY = f"""transform(
  filter(packed, (x, i) ->
    shiftrightunsigned(x, {_BITS}) = shiftrightunsigned(get(packed, i - 1), {_BITS}) OR
    shiftrightunsigned(x, {_BITS}) = shiftrightunsigned(get(packed, i + 1), {_BITS})),
  x -> CAST(x & (shiftleft(1L, {_BITS}) - 1) AS INT))"""
_HASHED = """sort_array(transform(likely, p -> struct(xxhash64(words[p], words[p + 1], words[p + 2]) AS h, p AS p)))"""
_REPEATED = """sort_array(transform(
  filter(hashed, (x, i) -> x.h = get(hashed, i - 1).h OR x.h = get(hashed, i + 1).h), x -> CAST(x.p AS BIGINT)))"""
_COVERED = """aggregate(
  transform(repeated, (p, i) -> least(3L, coalesce(get(repeated, i + 1), p + 3) - p)), 0L, (a, b) -> a + b)"""


def text_statistics(docs: DataFrame) -> DataFrame:
    """`doc_id, lang, source` and counts over every whole text.

    `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words` and
    `n_lines`. A null text has zeros.
    """
    words = F.regexp_extract_all("text", F.lit(f"{_NOT_BLANK}++"), F.lit(0))  # each character is looked at once
    lines = F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(_NOT_BLANK)))
    return (
        docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
        .select("*", words.alias("words"), lines.alias("lines"))
        .withColumn("packed", F.expr(_PACKED))
        .withColumn("likely", F.expr(_LIKELY))
        .withColumn("hashed", F.expr(_HASHED))
        .withColumn("repeated", F.expr(_REPEATED))
        .select(
            "doc_id", "lang", "source",
            F.size("words").cast("bigint").alias("n_words"),
            F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
            F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
            F.expr(_COVERED).alias("n_repeat_words"),
            F.size("lines").cast("bigint").alias("n_lines"),
        )
    )


def _rates(stats: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumns(
        {
            "base_failed": failed,
            "symbol_rate": F.col("n_symbols") / words,
            "dup_line_rate": F.col("n_dup_lines") / lines,
            "repeat_rate": F.col("n_repeat_words") / words,
            "mean_chars": F.col("word_chars") / words,
        }
    )


def _sketched(rows: DataFrame, keys: list[str], merge: bool) -> DataFrame:
    """A sketch of each statistic and the number of texts per group of `keys`."""
    make = F.kll_merge_agg_double if merge else F.kll_sketch_agg_double
    sketches = [make(F.col(name).cast("double") if not merge else name, F.lit(SKETCH_K)).alias(name) for name in [*STATISTICS, LENGTH]]
    return rows.groupBy(*keys).agg(*sketches, (F.sum("n") if merge else F.count(F.lit(1))).alias("n"))


def _quantiles(table: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    def quantile(name: str, q: float) -> Column:
        return F.kll_sketch_get_quantile_double(name, F.lit(q))

    found = [
        F.struct(quantile(n, 1 - tail).alias("low"), quantile(n, 0.5).alias("mid"), quantile(n, tail).alias("high")).alias(prefix + n)
        for n, (tail, _, _) in [*STATISTICS.items(), (LENGTH, (0.8, 0, 0))]
    ]
    return table.select(*[F.col(k).alias(prefix + k) for k in keys], *found, F.col("n").alias(prefix + "n"))


def adaptive_fences(rates: DataFrame) -> DataFrame:
    """`lang, source` and a `low, high` fence per statistic, for every group.

    Drawn from texts the base rule passes. A group's quantiles are blended with
    its language's, and those with all texts', by weights that grow smoothly
    with the number of texts, so no size switches anything. While a group is
    too small to tell, a median that differs from the larger group's widens the
    fences: neither norm is known to hold. Groups are small tables; the
    sketches merge, so no group is gathered anywhere.
    """
    groups = rates.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_all"))
    own = materialize(_sketched(rates.where("NOT base_failed"), ["lang", "source"], merge=False), "sketches")
    by_lang, by_all = _sketched(own, ["lang"], merge=True), _sketched(own, [], merge=True)
    s, g = _quantiles(own, ["lang", "source"], "s_"), _quantiles(by_lang, ["lang"], "g_")
    of_all = _quantiles(by_all, [], "a_").select(F.struct(*["a_" + name for name in [*STATISTICS, LENGTH]])).scalar()
    joined = (
        groups.join(s, F.col("lang").eqNullSafe(F.col("s_lang")) & F.col("source").eqNullSafe(F.col("s_source")), "left")
        .join(g, F.col("lang").eqNullSafe(F.col("g_lang")), "left")
        .withColumn("a", of_all)
    )

    def blended(own: Column, n: Column, outer: Column) -> Column:
        weight = F.coalesce(n / (n + PRIOR_TEXTS), F.lit(0.0))
        apart = weight * (1 - weight) * F.abs(own["mid"] - outer["mid"]) + (1 - weight) * outer["apart"]
        mixed = [F.coalesce(weight * own[q] + (1 - weight) * outer[q], outer[q]).alias(q) for q in ("low", "mid", "high")]
        return F.struct(*mixed, F.coalesce(apart, outer["apart"]).alias("apart"))

    def of_group(name: str) -> Column:
        every = F.col("a")["a_" + name]
        outer = F.struct(*[every[q].alias(q) for q in ("low", "mid", "high")], F.lit(0.0).alias("apart"))
        return blended(F.col("s_" + name), F.col("s_n"), blended(F.col("g_" + name), F.col("g_n"), outer))

    def fence(name: str) -> Column:
        q = of_group(name)
        _, times, least = STATISTICS[name]
        smallest = least / of_group(LENGTH)["mid"] if name == "symbol_rate" else F.lit(least)

        def room(spread: Column) -> Column:
            return F.greatest(times * (spread + q["apart"]), smallest)

        return F.struct(
            (q["low"] - room(q["mid"] - q["low"])).alias("low"), (q["high"] + room(q["high"] - q["mid"])).alias("high")
        ).alias(name)

    return joined.select("lang", "source", *[fence(name) for name in STATISTICS])


def quality_rules(docs: DataFrame) -> DataFrame:
    """`doc_id`, the counts, `base_failed` and `kept` for every row of `documents`.

    A text is kept if it passes the base rule and none of its rates lies
    beyond its group's fences; the mean word length has a lower one too.
    Null and empty texts have no words and fail the base rule. Null languages
    and sources are groups like others, a null doc_id stays null, repeated
    rows each give a row, other columns are ignored, and without any text that
    passes there are no fences to fail.
    """
    prepare(docs.sparkSession)
    rates = _rates(materialize(text_statistics(docs), "statistics"))
    fences = materialize(adaptive_fences(rates), "fences").select(
        F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[F.col(n).alias("f_" + n) for n in STATISTICS]
    )
    inside = F.col("mean_chars") >= F.col("f_mean_chars.low")
    for name in STATISTICS:
        inside = inside & (F.col(name) <= F.col(f"f_{name}.high"))
    joined = rates.join(fences, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
    )
