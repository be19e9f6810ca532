"""The crawl as a plan over a table of pages: links, frontier, education and pair edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.functions.text import is_date_title, is_system_title, normalize
from graphloom.operators import edges as E
from graphloom.sources.readers import CrawlConfig
from graphloom.storage import cut


class PageSource(DataSource):
    """Pages by title from an HTTP API, as a Spark data source: one partition per batch of titles.

    Options: titles (separated by |), endpoint (a URL with {title}), timeout, sleep, retries. A page that can't be
    fetched has null html. Nothing is fetched before the scan runs.
    """

    @classmethod
    def name(cls) -> str:
        return "graphloom_pages"

    def schema(self) -> str:
        return "title string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        titles = [t for t in self.options.get("titles", "").split("|") if t]
        return [InputPartition(titles[k : k + 16]) for k in range(0, len(titles), 16)]

    def read(self, partition: InputPartition):
        import time
        import urllib.parse
        import urllib.request

        for title in partition.value:
            html = None
            for _ in range(1 + int(self.options.get("retries", "1"))):
                time.sleep(float(self.options.get("sleep", "0")))
                try:
                    url = self.options["endpoint"].replace("{title}", urllib.parse.quote(title.replace(" ", "_")))
                    with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", "10"))) as page:
                        html = page.read().decode("utf-8", "replace")
                    break
                except OSError:
                    continue
            yield title, html


def register_sources(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def crawl(links: DataFrame, seeds: DataFrame, accepts: DataFrame, config: CrawlConfig | None = None) -> DataFrame:
    """(title, depth, accepted): pages reached from seeds, level by level.

    links: (src, pos, dst); accepts: titles (title) of persons with a university. A page is visited when it is queued;
    of a page's links at most candidate_cap are looked at, by position, and at most per_depth_limit of the new ones are
    queued; levels end when enough pages are accepted. Caps look at what earlier levels visited, so levels are parallel.
    """
    config = config or CrawlConfig()
    near = F.row_number().over(Window.partitionBy("src").orderBy("pos"))
    usable = cut(links.withColumn("near", near).where(F.col("near") <= config.candidate_cap).where(~is_system_title(F.col("dst")) & ~is_date_title(F.col("dst"))).select("src", "near", "dst"), "usable")
    names = accepts.select("title").distinct().withColumn("accepted", F.lit(True))

    def judged(level: DataFrame, depth: int) -> DataFrame:
        rows = level.join(names, "title", "left").select("title", F.lit(depth).alias("depth"), F.coalesce("accepted", F.lit(False)).alias("accepted"))
        return cut(rows, "level")

    level = judged(seeds.select("title").distinct(), 1)
    seen = level
    for depth in range(2, config.max_depth + 1):
        if seen.where("accepted").count() >= config.max_person_nodes:
            break
        steps = usable.join(level.select(F.col("title").alias("src")), "src", "left_semi").join(seen.select(F.col("title").alias("dst")), "dst", "left_anti")
        first = F.row_number().over(Window.partitionBy("src").orderBy("near"))
        queued = steps.withColumn("n", first).where(F.col("n") <= config.per_depth_limit).select(F.col("dst").alias("title")).distinct()
        level = judged(queued, depth)
        if level.limit(1).count() == 0:
            break
        seen = seen.unionByName(level)
    return seen


def pair_tables(alumni: DataFrame) -> dict[str, DataFrame]:
    """edges_shared and edges_same_grad of alumni (person, university, year)."""
    years = alumni.where("year is not null").select("person", "year")
    grad = E.same_value(years, "person", ["year"])
    shared = E.shared(alumni)
    return {
        "edges_shared": shared.select(F.col("p1").alias("src_person"), F.col("p2").alias("dst_person"), F.lit("SHARED_UNI").alias("relation"), "count"),
        "edges_same_grad": grad.select(F.col("p1").alias("src_person"), F.col("p2").alias("dst_person"), F.lit("SAME_GRAD_YEAR").alias("relation"), "year"),
    }


def uncrawled(roots: DataFrame, links: DataFrame, info: DataFrame) -> DataFrame:
    """Roots (title) that aren't both in links (source_title) and in info (title) already."""
    key = normalize(F.col("title"))
    done = links.select(normalize(F.col("source_title")).alias("_k")).intersect(info.select(key.alias("_k")))
    return roots.join(done, key == F.col("_k"), "left_anti")


def candidate_counts(links: DataFrame, roots: DataFrame, person_pages: DataFrame, education: DataFrame) -> DataFrame:
    """One row about the targets of roots: how many there are, are persons, have known education, or have no page of a person."""
    targets = links.join(roots.select(F.col("title").alias("src")), "src", "left_semi").select(F.col("dst").alias("title")).distinct()
    known = person_pages.select("title").distinct().withColumn("person", F.lit(1))
    taught = education.select("title").distinct().withColumn("taught", F.lit(1))
    marked = targets.join(known, "title", "left").join(taught, "title", "left")
    return marked.agg(
        F.count(F.lit(1)).alias("candidates"), F.count("person").alias("persons"), F.count(F.when(F.col("person").isNotNull(), F.col("taught"))).alias("ok_people"),
        F.count(F.when(F.col("person").isNull(), F.lit(1))).alias("rejected"),
    )
