"""Source divergence audit: how far the terms of sources of a language lie apart.

Terms are counted by (lang, source), before anything is shuffled, and a language
keeps those in enough of its documents. The divergence of two groups is a sum
over all kept terms, of which most occur in few groups, so it is split:

* **Heavy** terms, in at least half of a language's groups, become dense tiles: a
  slice of terms by a pair of blocks of groups. A tile is one numpy matrix, in
  which a group without the term has the probability of a count of 0.
* **Light** terms are sums of three parts. If no group had them, every pair would
  get the value of its two probabilities of 0, times their number. A group that
  has a term ``c`` times changes its value against every group without it by an
  amount that depends on ``c`` alone, so a histogram of counts by group is
  enough. Where both groups of a pair have the term, the posting list of the term
  gives what the two changes have left out.

All parts are whole numbers, so the sums are exact in whatever order they come.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast

# Bytes that are part of a term: letters of ASCII, lower-cased, and all of other characters.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a task counts before it hands them on.
HELD = 250_000
#: Groups to a block, at most; terms to a slice of a dense tile, and counts to a piece of the histograms, on average.
BLOCK, SLICE, PIECE = 256, 1024, 20_000
#: Cells that are computed at once.
CELLS = 1 << 20
UNIT = 1_000_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of rows(lang, source, text as bytes); a group's number of rows has the empty term."""
    sums: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in sums.items():
            names = list(terms)
            pairs = np.array([terms[t] for t in names], np.int64)
            for i in range(0, len(names), 100_000):
                part = names[i : i + 100_000]
                columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pairs[i : i + 100_000, 0]), pa.array(pairs[i : i + 100_000, 1])], ["lang", "source", "term", "n", "docs"])
        sums.clear()

    for batch in batches:
        langs, sources, texts = (batch.column(i) for i in range(3))
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts):
            terms = sums.setdefault((lang, source), {})
            before = len(terms)
            terms.setdefault(b"", [0, 0])[1] += 1
            for term, n in Counter(text.as_py().translate(TERM_BYTES).split()).items():
                if (held := terms.get(term)) is None:
                    terms[term] = [n, 1]
                else:
                    held[0] += n
                    held[1] += 1
            size += len(terms) - before
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) over all rows: occurrences and documents; the empty term has each group's number of rows."""
    kinds = ((lang_col, "lang", "string"), (source_col, "source", "string"), (text_col, "text", "string"))
    rows = docs.select(*[F.coalesce(F.col(c).cast(kind), F.lit("")).alias(name) for c, name, kind in kinds])
    parts = rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    # One shuffle serves the sums by group and the windows over a term's groups.
    return parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), exact; null where no term is kept."""
    below = (total + 2 * kept).cast("decimal(38,0)")
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(28,0)")
    return F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(38,0)"))) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


PARTIAL = "lang string, a int, b int, value long"


def _frame(lang: str, rows: np.ndarray, columns: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    """Partial sums of a block of rows by a block of columns, as pairs (a, b) of group numbers with a < b."""
    a, b = (x.ravel() for x in np.meshgrid(rows, columns, indexing="ij"))
    use = a < b
    return pd.DataFrame({"lang": lang, "a": a[use], "b": b[use], "value": sums.ravel()[use]})


def _dense(key: tuple, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """A dense tile: terms by groups on both sides; cells that no row fills have a count of 0."""
    lang, i, j = key[0], key[1], key[2]
    groups = groups.sort_values("group")
    number, zero = groups["group"].to_numpy(), groups["zero"].to_numpy()
    _, term = np.unique(cells["term"].to_numpy().astype(object), return_inverse=True)
    table = np.repeat(zero[:, None], term.max(initial=-1) + 1, axis=1)
    table[np.searchsorted(number, cells["group"].to_numpy()), term] = cells["p"].to_numpy()
    block = number // BLOCK
    left, right = table[block == i], table[block == j]
    sums = np.zeros((len(left), len(right)), np.int64)
    wide = max(1, CELLS // max(1, right.size))
    for k in range(0, len(left), wide):
        sums[k : k + wide] = _gap(left[k : k + wide, None, :], right[None, :, :]).sum(axis=2)
    return _frame(lang, number[block == i], number[block == j], sums)


def _plain(key: tuple, counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Light terms, as if no two groups shared one: all at a count of 0, changed by a piece of each group's histogram of counts."""
    lang, i, j, piece = key
    groups = groups.sort_values("group")
    number, zero, block = groups["group"].to_numpy(), groups["zero"].to_numpy(), groups["group"].to_numpy() // BLOCK
    rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
    both = _gap(zero[rows][:, None], zero[columns][None, :])
    sums = both * (int(groups["light"].iloc[0]) if piece == 0 and len(groups) else 0)
    at = np.searchsorted(number, counts["group"].to_numpy())
    p, terms = counts["p"].to_numpy(), counts["terms"].to_numpy()
    for side, others in ((rows, columns), (columns, rows)):
        mine = np.flatnonzero(np.isin(at, side))
        wide = max(1, CELLS // max(1, len(others)))
        for k in range(0, len(mine), wide):
            some = mine[k : k + wide]
            change = _gap(p[some][:, None], zero[others][None, :]) - _gap(zero[at[some]][:, None], zero[others][None, :])
            total = np.zeros((len(side), len(others)), np.int64)
            np.add.at(total, np.searchsorted(side, at[some]), change * terms[some][:, None])
            sums += total if side is rows else total.T
    return _frame(lang, number[rows], number[columns], sums)


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Light terms that two groups share, of posting lists by term: what the two changes of _plain have left out."""
    for pdf in batches:
        made = []
        sizes = pdf["groups"].map(len).to_numpy()
        for (lang, n), at in pdf.groupby([pdf["lang"], sizes]).indices.items():
            group, p, zero = (np.stack(pdf[c].iloc[at].to_numpy()) for c in ("groups", "ps", "zeros"))
            a, b = np.triu_indices(n, 1)
            wide = max(1, CELLS // max(1, len(at)))
            for k in range(0, len(a), wide):
                x, y = a[k : k + wide], b[k : k + wide]
                value = _gap(p[:, x], p[:, y]) - _gap(p[:, x], zero[:, y]) - _gap(zero[:, x], p[:, y]) + _gap(zero[:, x], zero[:, y])
                pairs = pd.DataFrame({"a": group[:, x].ravel(), "b": group[:, y].ravel(), "value": value.ravel()})
                made.append(pairs.groupby(["a", "b"], as_index=False)["value"].sum().assign(lang=lang))
        if made:
            yield pd.concat(made)[["lang", "a", "b", "value"]]


def _tiles(rows: DataFrame, *more: str) -> DataFrame:
    """rows(lang, group, blocks) once for each pair of blocks (i, j) of the language that the group's block is in."""
    block = F.floor(F.col("group") / BLOCK).cast("int")
    both = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.withColumns({"i": F.least(block, F.col("other")), "j": F.greatest(block, F.col("other"))}).drop("other")


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least: int = 10,
    top: int = 10,
    small: int = 100_000,
    per_slice: int = SLICE,
    per_piece: int = PIECE,
) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each (lang, source) group.

    Null texts, languages and sources count as empty strings. A term is a run of
    ASCII letters, lower-cased, and characters outside of ASCII; a language keeps
    the terms in at least ``least`` of its rows. Part ``pair`` has a row for each
    other source of the language: the sum over all kept terms of
    floor((p - q)^2 / (p + q)), 0 without kept terms. Part ``term`` has the ``top``
    kept terms of the group that it uses more than its language does. Ranks are
    by falling value, then by item. A language of one source has no pairs, an
    empty table no rows. Repeated rows count as often as they occur.
    """
    scratch = Scratch(docs.sparkSession)
    over = Window.partitionBy("lang", "term")
    counted = term_counts(docs, text_col, lang_col, source_col).withColumns({"in_docs": F.sum("docs").over(over), "in_lang": F.sum("n").over(over), "in_groups": F.count(F.lit(1)).over(over)})
    none = F.col("term") == F.lit(b"")
    counted = scratch.table(counted.filter(none | (F.col("in_docs") >= least)).select("lang", "source", "term", "n", "in_lang", "in_groups"))

    # A row for each group: its number in its language, and the probability of a count of 0.
    by_lang = counted.filter(~none).groupBy("lang", "term").agg(F.max("in_lang").alias("in_lang"), F.max("in_groups").alias("in_groups"))
    by_lang = by_lang.groupBy("lang", "in_groups").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("in_lang"))
    sizes = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    inside = Window.partitionBy("lang")
    groups = sizes.withColumns({"group": F.row_number().over(inside.orderBy("source")) - 1, "sources": F.count(F.lit(1)).over(inside)})
    heavy = 2 * F.col("in_groups") >= F.col("sources")
    langs = by_lang.join(groups.select("lang", "sources").distinct(), "lang").groupBy("lang").agg(
        F.sum("terms").alias("kept"), F.sum("in_lang").alias("lang_total"),
        F.sum(F.when(heavy, 0).otherwise(F.col("terms"))).alias("light"), F.sum(F.when(heavy, F.col("terms")).otherwise(0)).alias("heavy"),
    )
    groups = groups.join(langs, "lang", "left").fillna(0, ["kept", "lang_total", "light", "heavy"])
    groups = scratch.table(
        groups.select(
            "lang", "source", "group", "sources", "total", "kept", "lang_total", "light", "heavy",
            F.coalesce(share(F.lit(0), F.col("total"), F.col("kept")), F.lit(1)).alias("zero"),
            F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("heavy") / per_slice).cast("int").alias("slices"),
        )
    )
    of = bounded_broadcast(groups, small)
    cells = counted.filter(~none).join(of, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    # Part term. Only a task's first ten rows of a group are shuffled.
    q = share(F.col("in_lang"), F.col("lang_total"), F.col("kept"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        cells.withColumn("q", q).filter("n > 0 AND p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    )

    # Part pair. The groups under columns of their own, as cells have them too.
    own = groups.toDF(*groups.columns)
    sliced = cells.filter(heavy).withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    tile = ["lang", "i", "j", "slice"]
    each = _tiles(own.select("lang", "group", "zero", "blocks", "slices").filter("slices > 0")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dense = _tiles(sliced.select("lang", "group", "term", "p", "blocks", "slice")).groupBy(*tile).cogroup(each.groupBy(*tile)).applyInPandas(_dense, PARTIAL)

    counts = scratch.table(cells.filter(~heavy).groupBy("lang", "group", "blocks", "p").agg(F.count(F.lit(1)).alias("terms")))
    pieces = scratch.table(counts.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / per_piece).cast("int").alias("pieces")))
    tile = ["lang", "i", "j", "piece"]
    dealt = counts.join(bounded_broadcast(pieces, small), "lang").withColumn("piece", F.pmod(F.xxhash64("group", "p"), F.col("pieces")).cast("int")).drop("pieces")
    every = own.select("lang", "group", "zero", "blocks", "light").join(bounded_broadcast(pieces.toDF("lang", "pieces"), small), "lang", "left")
    every = every.withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    plain = _tiles(dealt).groupBy(*tile).cogroup(_tiles(every).groupBy(*tile)).applyInPandas(_plain, PARTIAL)

    lists = F.sort_array(F.collect_list(F.struct("group", "p", "zero")))
    postings = cells.filter(~heavy & (F.col("in_groups") > 1)).groupBy("lang", "term").agg(lists.alias("list"))
    postings = postings.select("lang", F.col("list.group").alias("groups"), F.col("list.p").alias("ps"), F.col("list.zero").alias("zeros"))
    sums = dense.unionByName(plain).unionByName(postings.mapInPandas(_shared, PARTIAL)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = scratch.table(sums)
    ends = sums.select("lang", F.col("a").alias("group"), F.col("b").alias("other"), "value").union(sums.select("lang", "b", "a", "value"))
    names = bounded_broadcast(groups.select("lang", "group", "source"), small)
    named = ends.join(names, ["lang", "group"]).join(names.select("lang", F.col("group").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


def oracle_sql(least: int = 10, top: int = 10) -> str:
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {least}
), v AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS kept, sum(n) AS total FROM k GROUP BY lang
), c AS (
  SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ({UNIT} * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.kept) AS p, 1 + ({UNIT} * (k.n + 2)) // (v.total + 2 * v.kept) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r
)
SELECT * FROM o WHERE part = 'pair' OR rank <= {top}
"""
