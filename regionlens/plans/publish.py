"""Marts published in versions: one call builds them all, later calls rewrite only what changed.

A run writes tables below `root/<mart>/run=<id>`, those with a year one folder per year, and then one file that lists
which folders make up the new version: `root/manifest/version=<n>`. Readers go by the newest list, so they see the
old version until that single file is in place, and all of the new one from then on. A run that fails leaves folders that
no list names. Folders are never changed once written, so a reader can stay with its version.

A text that is long for a column of a large table is stored once per version: the tables hold its key, and `table` puts the
text back. `keyed` leaves the keys, for filters and groups by that column; `with_texts` puts the texts into what came of them.

Which years changed is found from the input rows: a count and two sums of hashes per year, compared with those of the
last version. Small tables that every year depends on are part of each year's print.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.operators.aggregates import lead_zones, national_demand, national_supply, summarise_entities, summarise_zones
from regionlens.operators.joins import look_up
from regionlens.operators.labels import short_keys
from regionlens.plans import build
from regionlens.session import materialize, passing_tables, shuffles_removed, stepwise
from regionlens.sources.readers import path_exists
from regionlens.sources.writers import write_partitions

MANIFEST = "mart string, part string, run string, print string, columns string"
NO_YEAR = "year=__HIVE_DEFAULT_PARTITION__"
# Below this name the long texts of a column are stored, as `key` and `text`.
TEXTS = "texts_of_"
# Of the rows of a fact that are written before they are printed and stored.
ROW_GROUP_BYTES = 32 << 20


@dataclass(frozen=True)
class Fact:
    """A table by year, made from `rows` of the same year and from small tables that all years depend on.

    `rows` may be a function that writes them and gives them back; it is called when the fact's turn comes.
    """

    rows: DataFrame | Callable[[], DataFrame]
    make: Callable[[DataFrame], DataFrame] = lambda rows: rows
    sides: Sequence[DataFrame] = ()
    sort: Sequence[str] = ()


@dataclass(frozen=True)
class Mart:
    """A table made from other published ones, which `make` takes in this order, and from small tables that are not.

    By year, it needs no more than the rows of the same year of its only source.
    """

    sources: Sequence[str]
    make: Callable[..., DataFrame]
    yearly: bool = False
    sides: Sequence[DataFrame] = ()
    sort: Sequence[str] = ()


def row_print(df: DataFrame) -> list[Column]:
    """Number of rows and two sums of their hashes; unknown values count by their place, the order of rows does not."""
    values = [x for c in df.columns for x in (F.col(c), F.col(c).isNull())]
    hashes = (F.xxhash64(F.lit(seed), *values).cast("decimal(20,0)") for seed in (1, 2))
    return [F.count(F.lit(1)).alias("n"), *(F.sum(h).alias(f"h{i}") for i, h in enumerate(hashes))]


def side_prints(sides: Sequence[DataFrame]) -> str:
    return "/".join(str(tuple(side.agg(*row_print(side)).first())) for side in sides)


def year_prints(fact: Fact) -> dict[str, str]:
    """Print of every year of the rows, under the name of the year's folder. As many as there are years."""
    together = side_prints(fact.sides)
    prints = fact.rows.groupBy("year").agg(*row_print(fact.rows)).collect()
    return {part_name(r["year"]): f"{tuple(r)[1:]}/{together}" for r in prints}


def part_name(year: int | None) -> str:
    return NO_YEAR if year is None else f"year={year}"


def of_parts(parts: Sequence[str]) -> Column:
    """The rows that belong in these folders; reaches the scan of a table stored by year."""
    years = [int(p.removeprefix("year=")) for p in parts if p != NO_YEAR]
    known = F.col("year").isin(years)
    return known | F.col("year").isNull() if NO_YEAR in parts else known


class Published:
    """The tables of one version."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None) -> None:
        """The newest version, or the one asked for; without any there is no table yet."""
        self.spark, self.root, self.version = spark, root.rstrip("/"), 0
        self.rows: list = []
        if not path_exists(spark, f"{self.root}/manifest"):
            return
        lists = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{self.root}/manifest")
        last = version if version is not None else lists.agg(F.max("version")).first()[0]
        if last is not None:
            self.version, self.rows = last, lists.where(F.col("version") == last).collect()  # marts times years

    def manifest(self) -> list[tuple[str, str, str, str]]:
        """(mart, part, run, print) of every folder of a mart."""
        return sorted((r["mart"], r["part"], r["run"], r["print"]) for r in self.rows if r["run"] and not r["mart"].startswith(TEXTS))

    def table(self, name: str, parts: Sequence[str] | None = None) -> DataFrame:
        """A table with all its years, or with some; a filter by year prunes folders."""
        return self.with_texts(self.keyed(name, parts))

    def with_texts(self, df: DataFrame) -> DataFrame:
        """The long texts in place of their keys. Keys of short texts are the texts, and without long ones nothing is joined."""
        for mart in sorted({r["mart"] for r in self.rows if r["mart"].startswith(TEXTS) and r["run"]}):
            column = mart.removeprefix(TEXTS)
            if column in df.columns:
                texts = self.keyed(mart).select(F.col("key").alias("_key"), F.col("text").alias("_text"))
                whole = F.coalesce("_text", column).alias(column)
                df = df.join(texts, F.col(column) == F.col("_key"), "left").select(*[whole if c == column else c for c in df.columns])
        return df

    def keyed(self, name: str, parts: Sequence[str] | None = None) -> DataFrame:
        """The same as it is stored, with keys for long texts; they sort as the texts do, and filters by them reach the scan."""
        own = [r for r in self.rows if r["mart"] == name]
        if not own:
            raise KeyError(f"{name} is not published")
        paths = [
            f"{self.root}/{name}/run={r['run']}/{r['part']}".rstrip("/")
            for r in own if r["run"] and (parts is None or r["part"] in parts)
        ]
        schema = own[0]["columns"]
        if not paths:
            return self.spark.createDataFrame([], schema)
        names = [f.name for f in self.spark.createDataFrame([], schema).schema]
        reader = self.spark.read.schema(f"{schema}, run string").option("basePath", f"{self.root}/{name}")
        return reader.parquet(*paths).select(*names)


def columns_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def publish(
    spark: SparkSession, root: str, facts: Mapping[str, Fact], marts: Mapping[str, Mart], texts: Mapping[str, DataFrame] | None = None
) -> Published:
    """Write what changed since the last version and list the new one; the old version is returned if nothing did.

    `texts`: by column, the `key` and `text` of the long ones; facts and sides come with the keys.

    A folder is written again if its print differs: that of a year's rows, of the source's year, or of all that a whole
    table is made from. The rows of a fact are written once, as the prints and the folders both read them. Marts are made
    in the order given, from tables that are stored by then, so a table is computed once, whatever reads it. Prints don't
    know the functions: after a change of these publish to a new root. Only one caller may publish to a root at a time.
    """
    old, new = Published(spark, root), Published(spark, root, -1)
    new.version = old.version + 1
    run = f"{new.version:06d}-{uuid.uuid4().hex[:8]}"
    before = {(r["mart"], r["part"]): r for r in old.rows}

    def add(name: str, prints: Mapping[str, str], make: Callable[[Sequence[str]], DataFrame], sort: Sequence[str]) -> None:
        redo = [part for part, mark in prints.items() if (name, part) not in before or before[name, part]["print"] != mark]
        if redo or not prints:
            df = make(redo)
            columns, path = columns_of(df), f"{new.root}/{name}/run={run}"
            with shuffles_removed(spark):
                if redo == [""]:
                    df.write.parquet(path)
                elif redo:
                    write_partitions(df, path, "year", sort=sort, find=sort)
        else:
            columns = before[name, next(iter(prints))]["columns"]
        for part, mark in prints.items():
            kept = run if part in redo else before[name, part]["run"]
            new.rows.append({"mart": name, "part": part, "run": kept, "print": mark, "columns": columns})
        if not prints:  # no row in any year: the columns are all there is to know
            new.rows.append({"mart": name, "part": "", "run": "", "print": "", "columns": columns})

    for column, long_texts in (texts or {}).items():
        print_ = side_prints([long_texts.select("key", "text")])
        add(f"{TEXTS}{column}", {} if long_texts.isEmpty() else {"": print_}, lambda _, d=long_texts: d.select("key", "text"), ())
    for name, fact in facts.items():
        with passing_tables(spark):  # the rows go when the fact is stored
            rows = fact.rows() if callable(fact.rows) else materialize(fact.rows, f"{name}-rows", ROW_GROUP_BYTES)
            fact = replace(fact, rows=rows)
            with shuffles_removed(spark):
                prints = year_prints(fact)
            add(name, prints, lambda redo, f=fact: f.make(f.rows.where(of_parts(redo))), fact.sort)
    for name, mart in marts.items():
        made_from = sorted((r["mart"], r["part"], r["print"]) for r in new.rows if r["mart"] in mart.sources and r["run"])
        if mart.yearly:
            add(name, {part: mark for _, part, mark in made_from}, lambda redo, m=mart: m.make(new.keyed(m.sources[0], redo)), mart.sort)
        else:
            mark = hashlib.sha256(f"{made_from}{side_prints(mart.sides)}".encode()).hexdigest()
            add(name, {"": mark}, lambda _, m=mart: m.make(*map(new.keyed, m.sources)), mart.sort)
    rows = [tuple(r[c.split(" ")[0]] for c in MANIFEST.split(", ")) for r in new.rows]
    if sorted(rows) == sorted(tuple(r[c.split(" ")[0]] for c in MANIFEST.split(", ")) for r in old.rows):
        return old
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{new.root}/manifest/version={new.version}")
    return Published(spark, root, new.version)


@dataclass(frozen=True)
class Inputs:
    """The raw tables, in the shapes of `regionlens.sources.schemas`.

    Completions and postings may be functions that write and return them, called when their fact's turn comes.
    """

    crosswalk: DataFrame
    cities: DataFrame
    county_names: DataFrame
    state_codes: DataFrame
    completions: DataFrame | Callable[[], DataFrame]
    postings: DataFrame | Callable[[], DataFrame]
    occupations: DataFrame
    population: DataFrame
    industries: Sequence[str] = field(default_factory=list)


def publish_all(
    spark: SparkSession, root: str, inputs: Inputs, partial_year: int | None = None, max_year: int | None = None
) -> Published:
    """Labels, facts, yearly sums, national tables, summaries, map tables and leaders from the raw tables in one call.

    Facts and marts hold short keys for long zone labels, which name more cities the more a zone has. The joins of a fact are
    written one by one, and what is written on the way is removed.
    """
    with passing_tables(spark):
        return _publish_all(spark, root, inputs, partial_year, max_year)


def _publish_all(spark: SparkSession, root: str, inputs: Inputs, partial_year: int | None, max_year: int | None) -> Published:
    counties = build.county_zones(inputs.crosswalk)
    names = build.zone_names(counties, inputs.cities, inputs.county_names, inputs.state_codes)
    names = materialize(short_keys(names), "zone-names")
    long_names = names.where("_key <> zone").select(F.col("_key").alias("key"), F.col("zone").alias("text"))
    labels = look_up(counties, names.select("zone_code", F.col("_key").alias("zone")), "zone_code").select("county", "zone_code", "zone")
    labels = materialize(labels, "zone-labels")  # both facts and the map need them
    titles = build.occupation_titles(inputs.occupations)

    def in_steps(name: str, rows: DataFrame | Callable[[], DataFrame], *steps: Callable[[DataFrame], DataFrame]) -> Callable[[], DataFrame]:
        return lambda: stepwise(spark, f"{name}-rows", rows if callable(rows) else lambda: rows, *steps, row_group_bytes=ROW_GROUP_BYTES)

    supply = in_steps("supply", inputs.completions, build.renamed_completions, lambda rows: build.zoned_completions(rows, labels))
    demand = in_steps(
        "demand", inputs.postings, lambda rows: build.zoned_postings(rows, labels),
        lambda rows: build.described_postings(rows, inputs.occupations, inputs.industries),
        lambda rows: build.populated_postings(rows, inputs.population),
    )
    facts = {
        "supply": Fact(supply, sort=["entity"]),
        "demand": Fact(demand, lambda own: build.demand_of_rows(own, titles), [titles], ["zone"]),
    }

    def complete(yearly: DataFrame) -> DataFrame:
        return yearly if partial_year is None else yearly.where(F.col("year") != partial_year)

    marts = {
        "awards_by_year": Mart(["supply"], build.yearly_awards, True, sort=["entity"]),
        "map_entities": Mart(["supply"], build.map_supply, True, sort=["entity"]),
        "national_awards": Mart(["awards_by_year"], lambda y: national_supply(y).select("year", "mean_focus", "focus_share")),
        "entities": Mart(["awards_by_year"], lambda y: summarise_entities(y, ["zone", "rural", "tribal"])),
        "postings_by_year": Mart(["demand"], build.yearly_postings, True, sort=["zone"]),
        "zone_years": Mart(["postings_by_year"], build.with_zone_rates, True, sort=["zone"]),
        "national_postings": Mart(["postings_by_year"], national_demand),
        "zones": Mart(["postings_by_year"], summarise_zones),
        "zone_leaders": Mart(["postings_by_year"], lambda y: lead_zones(complete(y))),
        "map_zones": Mart(["postings_by_year"], lambda y: build.zones_on_map(y, labels, inputs.population, max_year), sides=[labels, inputs.population]),
    }
    return publish(spark, root, facts, marts, {"zone": long_names})
