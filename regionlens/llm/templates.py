"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become templates: numbers, names and units are replaced by typed placeholders, everything else is lower-cased
words. Windows of `WINDOW` template tokens are joined by hash with the windows of the benchmark items, so a question
with other numbers or names still matches. What stood in the placeholders is then compared: along a run of
windows, one value of the item must always meet the same value of the document, and the other way round. Runs that
fail this are mere likeness of form.

- number: digits, with inner points and commas;
- unit: one of `UNITS` behind a number;
- name: a capitalised word that doesn't begin a sentence or a line (all-capital words are plain words).

A document is contaminated by an item if a consistent run covers half of the item's windows, or `LONG_RUN` of them.
Windows of which more than half are placeholders say too little and are not used; items with fewer than `WINDOW` tokens
have no windows and can't be found, and items without id are not searched. Null and empty texts match nothing. Repeated rows and null ids are kept apart by their
text. Empty tables give no rows. Other columns are not read.

The windows of the benchmark are broadcast as long as they are at most `BROADCAST_WINDOWS`, counted before; beyond that both
sides are shuffled by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import free_name, written

WINDOW = 8
#: Windows of a run that count as a leak however long the item is: 13 tokens.
LONG_RUN = 6
#: At about 100 bytes each.
BROADCAST_WINDOWS = 200_000
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons gram grams ounce ounces pound pounds ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents degree degrees mph kmh watt watts volt volts"
).split()
#: Stands before words that begin a sentence or a line, and between values.
MARK = "¤"
_BEGIN = r"(^|[.!?][ \t\r\n]+|\n[ \t\r\n]*)"
_TOKEN = MARK + r"?\p{L}+|\p{N}+(?:[.,]\p{N}+)*|[%€$£°]"


def tokens_of(text: Column) -> Column:
    """The words, numbers and signs of a text, those that begin a sentence or a line behind a mark."""
    marked = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _BEGIN, "$1" + MARK)
    return F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))


def with_template(df: DataFrame, text: str) -> DataFrame:
    """`df` with `canon`, the template tokens, and `slots`, the replaced words (null elsewhere), aligned."""
    units = F.array(*[F.lit(u) for u in (*UNITS, "%", "€", "$", "£", "°")])

    def kind(token: Column, i: Column) -> Column:
        after_number = (i > 0) & F.regexp_like(F.get("tokens", i - 1), F.lit(r"^\p{N}"))
        return (
            F.when(F.regexp_like(token, F.lit(r"^\p{N}")), F.lit("<num>"))
            .when(F.regexp_like(token, F.lit(r"^\p{Lu}\p{Ll}+$")), F.lit("<name>"))
            .when(after_number & F.array_contains(units, F.lower(token)), F.lit("<unit>"))
            .otherwise(F.lower(F.ltrim(token, F.lit(MARK))))
        )

    df = df.withColumn("tokens", tokens_of(F.col(text)))
    df = df.withColumn("canon", F.transform("tokens", kind))
    slots = F.zip_with("tokens", "canon", lambda t, c: F.when(F.startswith(c, F.lit("<")), t))
    return df.withColumn("slots", slots).drop("tokens")


def windows(df: DataFrame, key: str, width: int = WINDOW) -> DataFrame:
    """(key, at, h, held): every window of the template, its hash, and its slots' values in order."""
    n = F.size("canon")
    starts = F.when(n >= width, F.sequence(F.lit(1), n - (width - 1))).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("canon", i, width)).alias("h"), F.array_join(F.slice("slots", i, width), MARK).alias("held"))
    return df.select(key, F.explode(F.transform(starts, one)).alias("w")).select(key, "w.at", "w.h", "w.held")


def values(held: Column) -> Column:
    return F.when(held == "", F.array().cast("array<string>")).otherwise(F.split(held, MARK))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, doc_id, item_id, n_windows, n_item_windows, consistent, exact, contaminated) of documents and items that share windows.

    For a pair, the run (windows at one distance from the item's) with the most windows counts. `key` is the hash of
    a row's id and text.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null").distinct()
    items = windows(with_template(items, "text"), "item_id")
    items = written(items.where(F.size(values(F.col("held"))) * 2 <= WINDOW), "benchmark-windows")
    sizes = items.groupBy("item_id").agg(F.countDistinct("at").alias("n_item_windows"))
    small = items.count() <= BROADCAST_WINDOWS

    rows = docs.select(row_key(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = windows(with_template(rows, "text").withColumn("doc", F.struct("key", "doc_id")), "doc").select("doc.*", "at", "h", "held")
    wanted = items.select("h", "item_id", F.col("at").alias("item_at"), F.col("held").alias("item_held"))
    hits = written(found.join(F.broadcast(wanted) if small else wanted, "h").distinct(), "benchmark-hits")

    run = ["key", "doc_id", "item_id", "distance"]
    hits = hits.withColumn("distance", F.col("at") - F.col("item_at"))
    runs = hits.groupBy(run).agg(F.countDistinct("item_at").alias("n_windows"), F.bool_and(F.col("held") == F.col("item_held")).alias("exact"))
    pairs = hits.withColumns({"own": values(F.col("held")), "theirs": values(F.col("item_held"))}).select(*run, F.explode(F.arrays_zip(F.col("own"), F.col("theirs"))).alias("p")).select(*run, "p.own", "p.theirs").distinct()
    slots = pairs.groupBy(run).agg(F.count("*").alias("pairs"), F.countDistinct("own").alias("own"), F.countDistinct("theirs").alias("theirs"))
    runs = _null_safe(runs, slots, run)
    runs = runs.withColumn("consistent", F.coalesce((F.col("pairs") == F.col("own")) & (F.col("pairs") == F.col("theirs")), F.lit(True)))
    best = F.max_by(F.struct("n_windows", "consistent", "exact"), F.struct(F.col("consistent"), F.col("n_windows"), F.col("exact"), -F.col("distance"))).alias("b")
    pairs = runs.groupBy("key", "doc_id", "item_id").agg(best).join(F.broadcast(sizes) if small else sizes, "item_id")
    enough = (F.col("b.n_windows") * 2 >= F.col("n_item_windows")) | (F.col("b.n_windows") >= LONG_RUN)
    return pairs.select("key", "doc_id", "item_id", "b.n_windows", "n_item_windows", "b.consistent", "b.exact", (F.col("b.consistent") & enough).alias("contaminated"))


def _null_safe(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """A left join that matches null ids with each other."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in columns})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return left.join(right, condition, "left").drop(*[f"_{c}" for c in columns])


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"), F.lit(8))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item_windows, kind) of contaminated documents; `kind`: exact or re-parameterised."""
    kind = F.when(F.col("exact"), F.lit("exact")).otherwise(F.lit("re-parameterised")).alias("kind")
    return matches(docs, benchmark).where("contaminated").select("doc_id", "item_id", "n_windows", "n_item_windows", kind)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that no benchmark item contaminates, with all their columns."""
    own = free_name(docs, "_key")
    gone = written(matches(docs, benchmark, doc_id, text).where("contaminated").select(F.col("key").alias(own)).distinct(), "contaminated")
    return docs.withColumn(own, row_key(doc_id, text)).join(gone, own, "left_anti").select(docs.columns)


#: The same rows in DuckDB: windows are joined as text instead of by hash.
SQL = f"""
WITH texts AS (
  SELECT 'd' AS side, CAST(doc_id AS BIGINT) AS id, text FROM documents
  UNION SELECT 'b', CAST(item_id AS BIGINT), text FROM benchmark
), split AS (
  SELECT side, id, text, regexp_extract_all(regexp_replace(coalesce(text, ''), '{_BEGIN}', '\\1{MARK}', 'g'), '{_TOKEN}') AS tokens FROM texts
), canon AS (
  SELECT side, id, text, tokens, list_transform(tokens, lambda t, i: CASE
    WHEN regexp_matches(t, '^\\p{{N}}') THEN '<num>'
    WHEN regexp_matches(t, '^\\p{{Lu}}\\p{{Ll}}+$') THEN '<name>'
    WHEN i > 1 AND regexp_matches(tokens[i - 1], '^\\p{{N}}') AND lower(t) IN ({", ".join(repr(u) for u in (*UNITS, "%", "€", "$", "£", "°"))}) THEN '<unit>'
    ELSE lower(ltrim(t, '{MARK}')) END) AS canon FROM split
), slots AS (
  SELECT side, id, text, canon, list_transform(tokens, lambda t, i: CASE WHEN canon[i][1] = '<' THEN t END) AS slots FROM canon
), places AS (
  SELECT *, unnest(range(1, len(canon) - {WINDOW - 2})) AS pos FROM slots
), windows AS (
  SELECT side, id, text, pos, array_to_string(canon[pos:pos + {WINDOW - 1}], ' ') AS h, list_filter(slots[pos:pos + {WINDOW - 1}], lambda x: x IS NOT NULL) AS held FROM places
), items AS (
  SELECT id AS item_id, pos AS item_at, h, held AS item_held FROM windows WHERE side = 'b' AND len(held) * 2 <= {WINDOW}
), sizes AS (
  SELECT item_id, count(DISTINCT item_at) AS n_item_windows FROM items GROUP BY item_id
), hits AS (
  SELECT id AS doc_id, text, item_id, pos - item_at AS distance, item_at, held, item_held FROM windows JOIN items USING (h) WHERE side = 'd'
), runs AS (
  SELECT doc_id, text, item_id, distance, count(DISTINCT item_at) AS n_windows, bool_and(held = item_held) AS exact FROM hits GROUP BY ALL
), pairs AS (
  SELECT DISTINCT doc_id, text, item_id, distance, unnest(held) AS own, unnest(item_held) AS theirs FROM hits
), agreed AS (
  SELECT doc_id, text, item_id, distance, count(*) = count(DISTINCT own) AND count(*) = count(DISTINCT theirs) AS agreed FROM pairs GROUP BY ALL
), judged AS (
  SELECT r.*, coalesce(a.agreed, true) AS consistent FROM runs r LEFT JOIN agreed a
    ON r.doc_id IS NOT DISTINCT FROM a.doc_id AND r.text = a.text AND r.item_id IS NOT DISTINCT FROM a.item_id AND r.distance = a.distance
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY consistent DESC, n_windows DESC, exact DESC, distance) AS place FROM judged
)
SELECT doc_id, item_id, n_windows, n_item_windows, CASE WHEN exact THEN 'exact' ELSE 're-parameterised' END AS kind
FROM best JOIN sizes USING (item_id)
WHERE place = 1 AND consistent AND (n_windows * 2 >= n_item_windows OR n_windows >= {LONG_RUN})
"""
