"""Audit of how the sources of a language diverge in their words.

Each group, the texts of one language and source, gives every term of the
language a share from the term's count. Two groups' divergence is a sum over
all terms, but depends on a term only by its two counts, the term's levels. So
indicator columns, one for each (group, level), are multiplied by their
transpose: the products are the joint tables of levels, whose cells are priced
once and summed. Products are taken block by block over terms and tiles of
groups; they hold whole numbers and are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweft.llm.arrays import Words, letter_table, map_slices
from tripleweft.llm.runtime import materialize, prepare
from tripleweft.session import broadcast_if_small

MIN_DOCS = 3  # documents of the language that a kept term occurs in
TOP_TERMS = 200  # ranks of the report on terms
UNIT = 1_000_000_000  # shares are whole numbers of this size
BLOCK_ENTRIES = 1 << 18  # counts in a block of terms
TILE = 512  # groups on a side of a block's product
STEP_TERMS = 256  # rows of the indicator columns multiplied at once

_LETTERS = letter_table()


def term_counts(docs: DataFrame) -> DataFrame:
    """`lang, source, term, n, docs`: occurrences and documents of each term in each group.

    Terms are runs of letters and characters beyond ASCII, with A-Z in lower
    case. Nulls are read as empty. A group without terms has one row, and every
    group a row, with a null term.
    """
    prepare(docs.sparkSession)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        groups = pa.StructArray.from_arrays([_filled(part.column(c)) for c in ("lang", "source")], ["lang", "source"])
        names = list(dict.fromkeys((g["lang"], g["source"]) for g in groups.to_pylist()))
        number = {name: k for k, name in enumerate(names)}
        of_doc = np.array([number[g["lang"], g["source"]] for g in groups.to_pylist()], np.int64)
        words = Words(part.column("text"), _LETTERS, lower=True)
        numbered = words.numbered()
        code, n_terms = numbered.indices.to_numpy().astype(np.int64), max(len(numbered.dictionary), 1)
        in_doc, n = np.unique(words.doc() * n_terms + code, return_counts=True)
        cell, at = np.unique(of_doc[in_doc // n_terms] * n_terms + in_doc % n_terms, return_inverse=True)
        group = np.concatenate([cell // n_terms, np.arange(len(names))])
        terms = pa.concat_arrays([numbered.dictionary.cast(pa.string()).take(pa.array(cell % n_terms)), pa.nulls(len(names), pa.string())])
        counts = [np.concatenate([np.bincount(at, w, len(cell)).astype(np.int64), np.zeros(len(names), np.int64)]) for w in (n, None)]
        sides = [pa.array([name[i] for name in names], pa.string()).take(pa.array(group)) for i in (0, 1)]
        return pa.record_batch([*sides, terms, *map(pa.array, counts)], ["lang", "source", "term", "n", "docs"])

    schema = "lang string, source string, term string, n bigint, docs bigint"
    counted = docs.select("text", "lang", "source").mapInArrow(map_slices(count), schema)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _filled(column: pa.Array) -> pa.Array:
    return column.cast(pa.string()).fill_null("")


def _share(n: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + n_terms)), exact."""
    parts = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + n_terms).cast("decimal(20,0)"))
    return parts + 1


def _price(p, q):
    """floor((p - q)^2 / q) of whole numbers."""
    return (p - q) * (p - q) // q


def shares(n: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    """`_share` in numpy: three digits at a time, so that 64 bits hold every step."""
    whole, rest = np.zeros(len(n), np.int64), n + 1
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // (total + n_terms), rest % (total + n_terms)
    return whole + 1


def joint_prices(counts: np.ndarray, left: np.ndarray, right: np.ndarray, totals: np.ndarray, n_terms: int, absent: int = 0) -> np.ndarray:
    """The divergence of each group of `left` from each of `right`, over some of the `n_terms` terms.

    `counts` holds a row for every term and a column for every group; `absent`
    more terms have no count in any of them.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    if not out.size:  # a tile that got no group
        return out
    if absent:
        none = np.concatenate([shares(np.zeros(1, np.int64), int(t), n_terms) for t in totals])
        out += absent * _price(none[left][:, None], none[right])
    order = np.argsort(counts.sum(axis=1), kind="stable")  # alike counts together: few levels at once
    for begin in range(0, len(order), STEP_TERMS):
        rows = counts[order[begin : begin + STEP_TERMS]]
        columns, prices, first = [], [], [0]
        for g in right:
            levels, at = np.unique(rows[:, g], return_inverse=True)
            columns.append(at[:, None] == np.arange(len(levels)))
            prices.append(shares(levels, int(totals[g]), n_terms))
            first.append(first[-1] + len(levels))
        ones, q = np.concatenate(columns, axis=1).astype(np.float32), np.concatenate(prices)
        for k, g in enumerate(left):
            levels, at = np.unique(rows[:, g], return_inverse=True)
            own = (at[:, None] == np.arange(len(levels))).astype(np.float32)
            joint = (own.T @ ones).astype(np.int64)  # at most STEP_TERMS in a cell: exact
            p = shares(levels, int(totals[g]), n_terms)[:, None]
            out[k] += np.add.reduceat((joint * _price(p, q)).sum(axis=0), first[:-1])
    return out


def divergence_report(docs: DataFrame) -> DataFrame:
    """`lang, source, part, item, value, rank` of every group.

    `part` is `pair` (`item` another source of the language, `value` the
    divergence from it over all kept terms, all ranks) or `term` (`item` a term
    that the group uses more than its language, the first 200 ranks). Ties go
    to the smaller item in UTF-8. Terms are kept that at least 3 documents of
    the language hold. Null lang, source and text are read as empty; empty
    texts make a group but have no terms; repeated rows are documents of their
    own; a language without kept terms has pairs of value 0; an empty table
    gives no rows; other columns are not read.
    """
    counts = materialize(term_counts(docs), "term-counts")
    by_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    terms = materialize(by_term.where(F.col("docs") >= MIN_DOCS).drop("docs"), "kept-terms")
    entries = materialize(counts.where("term IS NOT NULL").drop("docs").join(terms, ["lang", "term"]), "entries")
    used = entries.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("total").alias("n_lang"))
    groups = counts.where("term IS NULL").select("lang", "source").join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.na.fill(0, ["n_group", "n_terms", "n_lang"]), "groups")
    found = _pairs(entries, terms, groups).unionByName(_terms(entries, groups))
    return found.select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def _terms(entries: DataFrame, groups: DataFrame) -> DataFrame:
    shared = entries.join(broadcast_if_small(groups), ["lang", "source"])
    p, q = _share(F.col("n"), F.col("n_group"), F.col("n_terms")), _share(F.col("total"), F.col("n_lang"), F.col("n_terms"))
    priced = shared.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    return _ranked(priced.select("lang", "source", "item", value.alias("value")), "term").where(F.col("rank") <= TOP_TERMS)


def _pairs(entries: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language; the value is summed over blocks of terms."""
    # terms of alike frequency in one block: their counts fall into few levels
    size = F.floor(F.log2("total")).cast("int")
    classes = entries.groupBy("lang", size.alias("class")).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ENTRIES)).cast("bigint").alias("n_blocks"))
    n_tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("bigint").alias("n_tiles"))
    classes, n_tiles = materialize(classes, "classes"), materialize(n_tiles, "tiles")
    tile = F.pmod(F.xxhash64("source"), F.col("n_tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tiles") - 1))
    # the product of tiles (i, j) reads the columns of both
    sides = F.explode(F.array_distinct(F.array(F.struct(F.col("tile").alias("i"), F.col("other").alias("j")), F.struct(F.col("other").alias("i"), F.col("tile").alias("j")))))

    def to_products(rows: DataFrame) -> DataFrame:
        dealt = rows.join(broadcast_if_small(n_tiles), "lang").withColumn("tile", tile).withColumn("other", other)
        return dealt.withColumn("product", sides).select(*rows.columns, "tile", "product.i", "product.j")


    def in_blocks(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("class", size).join(broadcast_if_small(classes), ["lang", "class"])
        return dealt.withColumn("block", F.pmod(F.xxhash64("term"), F.col("n_blocks")))

    blocks = to_products(in_blocks(entries).select("lang", "class", "block", "source", "term", "n"))
    keys = in_blocks(terms).groupBy("lang", "class", "block").agg(F.count(F.lit(1)).alias("in_block"))
    # a product without terms gives the pairs of languages that keep none
    bare = groups.where("n_terms = 0").select("lang").distinct()
    zero = F.lit(0).cast("bigint")
    keys = keys.unionByName(bare.select("lang", F.lit(-1).alias("class"), zero.alias("block"), zero.alias("in_block")))
    columns = to_products(groups.join(keys, "lang").select("lang", "class", "block", "source", "n_group", "n_terms", "in_block"))
    key = ["lang", "class", "block", "i", "j"]

    def multiply(key: tuple, cells: pa.Table, own: pa.Table) -> pa.Table:
        lang, i, j = key[0].as_py(), key[3].as_py(), key[4].as_py()
        own = own.combine_chunks()
        names, tiles = own["source"].to_pylist(), own["tile"].to_numpy()
        left, right = np.flatnonzero(tiles == i), np.flatnonzero(tiles == j)
        number = {name: k for k, name in enumerate(names)}
        term = cells["term"].combine_chunks().dictionary_encode()
        counts = np.zeros((len(term.dictionary), len(names)), np.int64)
        group = np.array([number[s] for s in cells["source"].to_pylist()], np.int64)
        counts[term.indices.to_numpy(), group] = cells["n"].to_numpy()
        n_terms, absent = int(own["n_terms"][0].as_py()), int(own["in_block"][0].as_py()) - len(counts)
        value = joint_prices(counts, left, right, own["n_group"].to_numpy(), n_terms, absent)
        a, b = np.nonzero(left[:, None] != right)
        rows = [[lang] * len(a), [names[k] for k in left[a]], [names[k] for k in right[b]], value[a, b]]
        return pa.table([pa.array(r, t) for r, t in zip(rows, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "source", "item", "value"])

    products = blocks.groupBy(*key).cogroup(columns.groupBy(*key)).applyInArrow(multiply, "lang string, source string, item string, value bigint")
    return _ranked(products.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


SQL = """WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), cells AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, l.n AS n_lang,
    coalesce((SELECT sum(n) FROM cells c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) AS g LEFT JOIN langs l ON l.lang = g.lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT) // (g.n + g.v) AS BIGINT) AS p,
    1 + CAST(1000000000 * CAST(k.total + 1 AS HUGEINT) // (g.n_lang + g.v) AS BIGINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms
QUALIFY rank <= 200"""
