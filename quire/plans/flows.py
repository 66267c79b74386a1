"""Registered queries over groups without a bound, streams, stores and links that run in circles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import collections, elements, links, prefixes, scans, seen, selectors
from quire.plans.catalogue import books
from quire.plans.registry import CH, attempts, failed, long, query, turns
from quire.sources import archives, file_store, landed, sinks
from quire.sources.shared import shared_path
from quire.sources.tables import read_table
from quire.streaming import landing

_ALL = """WITH a AS (SELECT event_id, ts, event_type = 'error' AS f FROM events),
b AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT event_id, CAST(CASE WHEN f THEN sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS BIGINT) AS streak FROM b"""


@query(_ALL)
def streak_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attempts of one site."""
    rows = attempts(spark, sf_dir).withColumn("site", F.lit("one"))
    return collections.streaks(rows, "site", ["ts", "event_id"], failed()).select("event_id", "streak")


@query(f"SELECT event_id, streak FROM ({_ALL}) s WHERE streak >= 3")
def given_up_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir).withColumn("site", F.lit("one"))
    return collections.given_up(rows, "site", ["ts", "event_id"], failed(), 3).select("event_id", "streak")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM events")
def places_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir).withColumn("site", F.lit("one"))
    placed = scans.numbered(rows, ["site"], ["ts", "event_id"])
    return scans.running_sum(placed, ["site"], ["place"], failed().cast("int"), None, "failures").select("event_id", "place", "failures")


@query("SELECT min(page_id) AS page_id, split_part(url, '/', 3) AS host FROM pages GROUP BY 2")
def landed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages as a stream, the first of each host, kept by the stream's own state; the store that it leaves."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", landing.ROCKS)
    pages = landing.read_pages(spark, f"{sf_dir}/page[s].parquet").withColumn("host", F.split_part("url", F.lit("/"), F.lit(3)))  # a pattern may name a file or a folder
    fresh = landing.new_pages(pages.select("page_id", "host"), "host")
    path = shared_path(spark, "landed")
    run = fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", shared_path(spark, "landed-state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("page_id bigint, host string").parquet(path)


# archives and files


def _saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Turns as entries of an archive a conversation, written by tasks; what was written, and the folder."""
    folder = shared_path(spark, "archives")
    files = turns(spark, sf_dir).select(F.concat(F.col("conv_id").cast("string"), F.lit(".cbz")).alias("archive"), F.concat(F.col("index").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"), "index")
    return file_store.save_archives(files, folder, ["index"]), folder


@query("SELECT conv_id || '.cbz' AS archive, CAST(turn AS BIGINT) AS place, (turn + 1) || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS md5 FROM conversations")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written entry by entry, and read back by their directories."""
    entries = file_store.read_archives(spark, _saved(spark, sf_dir)[1])
    return entries.select("archive", "place", "name", long(F.length("content")).alias("n_bytes"), F.md5("content").alias("md5"))


@query("SELECT conv_id || '.cbz' AS archive, (turn + 1) || '.txt' AS name, md5(text) AS md5 FROM conversations WHERE turn IN (0, 2)")
def archive_some_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by name: the condition reaches the source."""
    entries = file_store.read_archives(spark, _saved(spark, sf_dir)[1]).where(F.col("name").isin("1.txt", "3.txt"))
    return entries.select("archive", "name", F.md5("content").alias("md5"))


@query("SELECT conv_id || '.cbz' AS name, count(*) AS n_entries, true AS listed FROM conversations GROUP BY conv_id")
def archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's files as listed, their sizes as written, and how many entries each has."""
    made, folder = _saved(spark, sf_dir)
    found = landed.list_files(spark, folder, "*.cbz").join(made.select("name", "n_bytes"), "name")
    entries = file_store.read_archives(spark, folder).groupBy(F.col("archive").alias("name")).agg(F.count("*").alias("n_entries"))
    return found.join(entries, "name").select("name", "n_entries", (F.col("length") == F.col("n_bytes")).alias("listed"))


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS BIGINT) AS entry_pos, (turn + 1) || '.jpg' AS entry_name, md5(text) AS md5 FROM conversations")
def cbz_in_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives in the order of a list, here the last image first."""
    files = turns(spark, sf_dir).select("conv_id", F.concat(F.col("index").cast("string"), F.lit(".jpg")).alias("name"), F.col("text").cast("binary").alias("content"), (-F.col("index")).alias("at"))
    entries = landed.unzip(archives.build_cbz(files, "conv_id", order="at").select("conv_id", "content"))
    return entries.select("conv_id", long(F.col("entry_pos")).alias("entry_pos"), "entry_name", F.md5("entry_content").alias("md5"))


@query(f"WITH c AS ({CH}) SELECT 'Novel ' || conv_id AS title, list(title ORDER BY index)[1] AS first_title, count(*) AS num_chapters, md5(string_agg(text, '|' ORDER BY index)) AS md5 FROM c GROUP BY conv_id")
def novel_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novel records written as JSON files by tasks, and read back."""
    folder = shared_path(spark, "novels")
    novels = books(spark, sf_dir).select(F.concat("title", F.lit(".json")).alias("name"), F.encode(sinks.novel_json("title", "num_chapters", "chapters"), "UTF-8").alias("content"))
    file_store.save_files(novels, folder)
    chapters = F.array_sort("chapters")
    read = landed.read_novels(spark, folder)
    return read.select("title", chapters[0]["title"].alias("first_title"), "num_chapters", F.md5(F.array_join(F.transform(chapters, lambda c: c["content"]), "|")).alias("md5"))


@query("SELECT event_id, 200 AS status FROM events WHERE event_type <> 'error'")
def answers_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of which each must be there: another status is an error."""
    rows = attempts(spark, sf_dir).where(~failed()).withColumn("status", F.lit(200))
    return rows.select("event_id", collections.require_ok(F.col("status"), F.col("event_id").cast("string")).alias("status"))


# stores, filters, links


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As missing_chapters, most rows without a shuffle."""
    return seen.missing(read_table(spark, sf_dir, "documents").select("doc_id"), read_table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT c_custkey AS id, CASE WHEN n IS NULL THEN c_name ELSE 'ordered ' || n END AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def stored_and_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of customers, in which those with orders are put again."""
    path, schema = shared_path(spark, "store"), "id long, state string"
    seen.upsert_into(read_table(spark, sf_dir, "customer").select(long(F.col("c_custkey")).alias("id"), F.col("c_name").alias("state")), path, ["id"], schema)
    fresh = read_table(spark, sf_dir, "orders").groupBy(long(F.col("o_custkey")).alias("id")).agg(F.concat(F.lit("ordered "), F.count("*").cast("string")).alias("state"))
    seen.upsert_into(fresh, path, ["id"], schema)
    return seen.read_store(spark, path, schema)


@query(
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), l AS (SELECT c_custkey AS url, CASE WHEN c_custkey % 11 <> 5 THEN (c_custkey * c_custkey + 1) % (SELECT n FROM n) END AS next FROM customer),
p AS (SELECT url AS seed, [url] AS path, next, false AS ringed FROM l UNION ALL SELECT seed, list_append(path, p.next), l.next, list_contains(list_append(path, p.next), l.next) FROM p JOIN l ON l.url = p.next WHERE NOT ringed),
f AS (SELECT seed, path, next, list_position(path, next) AS spot FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY len(path) DESC) AS k FROM p) q WHERE k = 1)
SELECT seed AS url, CASE WHEN spot > 0 THEN 'circle' ELSE 'end' END AS ending, CASE WHEN spot > 0 THEN next ELSE path[-1] END AS entry, CAST(CASE WHEN spot > 0 THEN spot - 1 ELSE len(path) - 1 END AS BIGINT) AS hops,
CASE WHEN spot > 0 THEN list_min(path[spot:]) END AS circle, CAST(CASE WHEN spot > 0 THEN len(path) - spot + 1 ELSE 0 END AS BIGINT) AS length FROM f"""
)
def link_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where links between customers end, or in which circle."""
    rows = read_table(spark, sf_dir, "customer").select(long(F.col("c_custkey")).alias("url"))
    n = max(1, rows.count())
    return links.trace(rows.select("url", F.when(F.col("url") % 11 != 5, (F.col("url") * F.col("url") + 1) % n).alias("next")))


@query("WITH b AS (SELECT DISTINCT left(url, 7 + strpos(substr(url, 8), '/')) AS prefix FROM pages WHERE page_id % 3 = 0) SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM b WHERE starts_with(p.url, b.prefix))")
def unblocked_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of no site that a third of the pages come from."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    sites = pages.where("page_id % 3 = 0").select(F.expr("left(url, 7 + instr(substr(url, 8), '/'))").alias("prefix"))
    return prefixes.not_blocked(pages, "url", sites)


@query("WITH t AS (SELECT DISTINCT left(url, k) AS prefix FROM pages, unnest([9, 12, 15, 20, 26]) u(k) WHERE page_id % 2 = 0) SELECT page_id, max(len(prefix)) AS longest FROM pages p LEFT JOIN t ON starts_with(p.url, t.prefix) GROUP BY page_id")
def longest_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    table = pages.where("page_id % 2 = 0").select(F.explode(F.transform(F.array(*[F.lit(k) for k in (9, 12, 15, 20, 26)]), lambda k: F.col("url").substr(F.lit(1), k))).alias("prefix"))
    return prefixes.longest_prefix(pages, "url", table, name="hit").select("page_id", long(F.length("hit")).alias("longest"))


# selectors

#: A name, a selector, and which turns it finds in SQL: n is the turn's place, z the conversation's number of turns, r its role, p the role before.
_SELECTED = [
    ("child", "div > p.user", "r = 'user'"),
    ("next", "p.user + p.assistant", "r = 'assistant' AND p = 'user'"),
    ("later", "p.system ~ p", "s < n"),
    ("ends", "p[data-n$='1']", "n % 10 = 1"),
    ("begins", "section p[data-n^='1']", "n = 1 OR (n BETWEEN 10 AND 19) OR (n BETWEEN 100 AND 199)"),
    ("odd", "p:nth-child(2n+1)", "n % 2 = 1"),
    ("first", "p:first-child", "n = 1"),
    ("last", "p:last-child", "n = z"),
    ("other", "p:not(.user)", "r <> 'user'"),
    ("either", "#turns p.system, #turns > p.user", "r IN ('system', 'user')"),
    ("none", "p > p, p:empty", "false"),
]
_ROWS = """WITH t AS (SELECT conv_id, turn, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS z, role AS r, lag(role) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT *, min(CASE WHEN r = 'system' THEN n END) OVER (PARTITION BY conv_id) AS s FROM t), c AS (SELECT DISTINCT conv_id FROM t)"""


@query(_ROWS + " " + " UNION ALL ".join(f"SELECT conv_id, '{name}' AS kind, coalesce((SELECT string_agg(n, ',' ORDER BY n) FROM q WHERE q.conv_id = c.conv_id AND ({sql})), '') AS found FROM c" for name, _, sql in _SELECTED))
def selected_by_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of turns, and what each selector finds on them."""
    placed = turns(spark, sf_dir).select("conv_id", "index", "role")
    made = collections.assemble(placed, ["conv_id"], ["role"], "index", "turns")
    line = lambda t, i: F.concat(F.lit('<p class="t '), t["role"], F.lit('" data-n="'), (i + 1).cast("string"), F.lit('">x<br></p>'))
    pages = made.select("conv_id", F.concat(F.lit('<section><h2>y</h2><div id="turns" class="w">'), F.array_join(F.transform("turns", line), "\n"), F.lit("</div></section>")).alias("html"))
    parsed = elements.parse(pages)
    found = lambda s: F.array_join(F.transform(selectors.select("elements", s), lambda e: elements.attr(e, "data-n")), ",")
    each = F.array(*[F.struct(F.lit(name).alias("kind"), found(s).alias("found")) for name, s, _ in _SELECTED])
    return parsed.select("conv_id", F.explode(each).alias("o")).select("conv_id", "o.kind", "o.found")
