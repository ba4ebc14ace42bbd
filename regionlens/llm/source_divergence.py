"""How far the sources of a language differ in their words, from each distinct text read once.

1. Collapse. Rows become one row per (lang, text) with the number of copies that each source has. Copies are combined
   before the exchange, so a text that holds a third of all rows crosses it once per task.
2. Count. A distinct text is cut into terms once; its counts are added with the number of copies as weight, its
   documents likewise. Workers add up in memory and hand on a table of bounded size whenever it is full.
3. Compare. Smoothed shares are whole numbers, so all arithmetic is exact. A pair of sources is not compared term by
   term: terms that neither has all add the same value, terms that one of them has depend on their count alone and are
   taken from a histogram of counts, and only terms that both have are looked at one by one.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the terms that at
least `least` of its documents have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionlens.llm.common import ship, slices, written

LEAST = 10
SHOWN = 10
SCALE = 1_000_000_000
#: Counts that a worker holds before it hands them on, and letters of terms.
HELD, HELD_BYTES = 400_000, 16 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8: all other bytes become spaces, and runs between spaces are the terms."""
    return text.encode().translate(_LETTERS).split()


def collapse(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, text, copies: source and number of each) for each distinct text of a language. Null counts as ''."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (text, "text"), (source, "source"))])
    # the digest stands in for the text wherever rows are only counted; the text itself crosses one exchange
    rows = plain.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = rows.groupBy("lang", "digest").agg(F.any_value("text").alias("text"))
    copies = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    copies = copies.groupBy("lang", "digest").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def count_terms(collapsed: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents with the term in each group, added up over all copies."""
    ship(collapsed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def table() -> pa.RecordBatch:
            size = [len(n) for n, _ in held.values()]
            groups = [[g[k] for g, many in zip(held, size) for _ in range(many)] for k in (0, 1)]
            terms = [t for n, _ in held.values() for t in n]
            counts = [c for n, _ in held.values() for c in n.values()]
            docs = [d[t] for n, d in held.values() for t in n]
            arrays = [*(pa.array(g, pa.string()) for g in groups), pa.array(terms, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

        size = letters = 0
        for batch in slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("lang", "text", "copies"))
            for lang, text, copies in zip(*columns):
                terms = terms_of(text)
                counts: Counter | None = None
                for copy in copies:
                    if (lang, copy["source"]) not in held:
                        held[lang, copy["source"]] = (Counter(), Counter())
                    n, docs = held[lang, copy["source"]]
                    before = len(n)
                    if copy["n"] == 1 and len(copies) == 1:
                        n.update(terms)
                        docs.update(set(terms))
                    else:
                        counts = counts or Counter(terms)
                        for term, c in counts.items():
                            n[term] += c * copy["n"]
                            docs[term] += copy["n"]
                    size += len(n) - before
                letters += len(text)
                if size > HELD or letters > HELD_BYTES:
                    yield table()
                    held.clear()
                    size = letters = 0
        if size:
            yield table()

    rows = collapsed.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # dealt out by term: the counts of all its sources meet in the one exchange, so what a language has of it needs no other
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact: decimals up to the division."""
    c, n, v = (F.col(x) if isinstance(x, str) else x for x in (count, total, kept))
    top = (c.cast("decimal(19,0)") + F.lit(2).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    below = n.cast("decimal(19,0)") + v.cast("decimal(17,0)") * F.lit(2).cast("decimal(1,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, below)


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(
    docs: DataFrame, least: int = LEAST, shown: int = SHOWN, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and by which terms.

    Part `pair`: every other source of the language with the summed divergence over all kept terms, largest first.
    Part `term`: the first `shown` kept terms that the source has and has more often than its language, by their divergence.
    Null text, lang and source count as ''. A source without kept terms has even shares; without any kept term in its
    language all pairs are 0. Repeated rows count as documents of their own. Other columns are not read; an empty table gives no rows.
    """
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    counts = count_terms(collapse(docs, text, lang, source))
    of_term = Window.partitionBy("lang", "term")  # a row for each source that has the term
    known = counts.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("all_n"), F.sum("docs").over(of_term).alias("all_docs"))
    kept = written(known.where(F.col("all_docs") >= least).drop("all_docs"), "kept-counts")

    # one row per group: its total, its number of terms, and what holds for its language
    langs = kept.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang")
    langs = langs.agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    zero = F.lit(0).cast("long")
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "present", "v", "all_total"])
    groups = written(groups.withColumn("none", F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v"))).otherwise(0)), "groups")

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    q = share("all_n", "all_total", "v")
    ahead = shares.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = [F.col("value").desc(), F.col("item").asc()]
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    terms = ahead.withColumn("rank", place).where(F.col("rank") <= shown).withColumn("part", F.lit("term"))

    pairs = pair_values(shares.select("lang", "source", "term", "p"), groups)
    pairs = pairs.withColumn("rank", place).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, from the shares of the terms each one has.

    With z for the share of a term that a source lacks, the sum over all terms is that of f(p, z') over the terms of the
    one, of f(z, p') over those of the other and of f(z, z') over the rest; a term of both was then counted by these
    instead of by f(p, p'), which the join of the two sides puts right.
    """
    one = groups.select("lang", "source", F.col("none").alias("z"), F.col("present").alias("m"), "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("y"), F.col("present").alias("k"))
    both = written(one.join(other, "lang").where("source < item"), "source-pairs")  # the rows of the result
    p, y, z = F.col("p"), F.col("y"), F.col("z")

    # shares take few values in a source: as many as its terms have counts
    values = written(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("many")), "share-histogram")
    left = both.select("lang", "source", "item", "y").join(values, ["lang", "source"]).withColumn("f", divergence(p, y) * F.col("many"))
    right = both.select("lang", "source", "item", "z").join(values.withColumnRenamed("source", "item"), ["lang", "item"])
    right = right.withColumn("f", divergence(p, z) * F.col("many"))

    marked = shares.join(groups.select("lang", "source", F.col("none").alias("z")), ["lang", "source"])
    mine = marked.select("lang", "term", "source", "p", "z")
    theirs = marked.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("z").alias("y"))
    met = mine.join(theirs, ["lang", "term"]).where("source < item")
    fix = divergence(p, F.col("r")) - divergence(p, y) - divergence(z, F.col("r")) + divergence(z, y)
    met = met.select("lang", "source", "item", fix.alias("f"))

    keys = ["lang", "source", "item"]
    sums = left.select(*keys, "f").unionByName(right.select(*keys, "f")).unionByName(met).groupBy(*keys).agg(F.sum("f").alias("f"))
    rest = F.when(F.col("v") > 0, divergence(z, y) * (F.col("v") - F.col("m") - F.col("k"))).otherwise(0)
    total = both.join(sums, keys, "left").select(*keys, (F.coalesce("f", F.lit(0)) + rest).cast("long").alias("value"))
    total = written(total, "pair-values")
    return total.unionByName(total.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
terms AS (
    SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM terms GROUP BY lang, source, term),
dense AS (
    SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n
    FROM groups g JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
shares AS (
    SELECT lang, source, term, n, v,
        1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p,
        1 + (CAST(1000000000 AS HUGEINT) * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
    FROM dense JOIN sizes USING (lang)),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
ahead AS (
    SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
    FROM shares WHERE n > 0 AND p > q),
ranked AS (
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM ahead)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
