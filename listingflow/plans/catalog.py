"""A query for each operator over the tables at hand, and its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.functions import guards, html, ids, numbers, security, templates, text, validation
from listingflow.functions.json_repair import records_of, repair_json
from listingflow.operators import batching, dedup, filters, order, registry, report, similarity, stats, terms, verdicts
from listingflow.operators import normalize as norm
from listingflow.plans import pipelines, views
from listingflow.plans.scoring import keyword_scorer
from listingflow.plans.views import table
from listingflow.shared import shared_dir, staged
from listingflow.sources import readers, versions
from listingflow.streaming import registry_state
from listingflow.streaming.machines import Breaker, RateLimiter
from listingflow.streaming.replay import replay

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COMPANIES, TITLES = ["brand#11", "brand#2"], ["red", "steel"]
NOW = 50 * registry.DAY_MS


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


EXCLUDED_SQL = "(lower(company) LIKE '%brand#11%' OR lower(company) LIKE '%brand#2%' OR lower(title) LIKE '%red%' OR lower(title) LIKE '%steel%')"


@query(
    f"WITH {views.LISTINGS_SQL}, {views.REGISTRY_SQL}, kept AS (SELECT * FROM listings l WHERE NOT {EXCLUDED_SQL} AND NOT EXISTS (SELECT 1 FROM registry r WHERE lower(r.company) = lower(l.company) AND lower(r.title) = lower(l.title))), "
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY title, company ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM kept) "
    "SELECT id, title, company, location, postedDate FROM numbered WHERE k = 1"
)
def refine_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term filters, registry, first of each title and company."""
    rows = filters.exclude(views.listings(spark, sf_dir), COMPANIES, TITLES)
    rows = registry.unseen(rows, views.registry(spark, sf_dir))
    return dedup.first_per_key(rows, [F.col("title"), F.col("company")], views.order()).select("id", "title", "company", "location", "postedDate")


@query(
    f"WITH RECURSIVE {views.PARTS_SQL}, numbered AS (SELECT *, lower(title) || '::' || lower(company) AS pair, row_number() OVER (ORDER BY ord) AS n FROM parts), "
    "walk(n, ids, pairs, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT) UNION ALL "
    "SELECT p.n, CASE WHEN list_contains(w.ids, p.id) OR list_contains(w.pairs, p.pair) THEN w.ids ELSE list_append(w.ids, p.id) END, "
    "CASE WHEN list_contains(w.ids, p.id) OR list_contains(w.pairs, p.pair) THEN w.pairs ELSE list_append(w.pairs, p.pair) END, "
    "CASE WHEN list_contains(w.ids, p.id) OR list_contains(w.pairs, p.pair) THEN NULL ELSE p.ord END FROM walk w JOIN numbered p ON p.n = w.n + 1) "
    "SELECT ord, id, title, company FROM walk JOIN parts ON kept = ord"
)
def greedy_dedup(spark, sf_dir):
    rows = views.parts(spark, sf_dir).withColumn("pair", text.pair_key(F.col("title"), F.col("company")))
    return dedup.greedy_two_key(rows, "id", "pair", "ord").select("ord", "id", "title", "company")


@query(
    f"WITH {views.LISTINGS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY title, company ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM listings) SELECT id, title, company FROM numbered WHERE k = 1"
)
def dedup_pairs(spark, sf_dir):
    rows = views.listings(spark, sf_dir)
    return dedup.first_per_key(rows, [F.col("title"), F.col("company")], views.order()).select("id", "title", "company")


def _by_strategy(strategy):
    def run(spark, sf_dir):
        return dedup.first_per_key(views.parts(spark, sf_dir), dedup.strategy_key(strategy), F.col("ord")).select("ord", "id", "title", "company")

    return run


for _strategy, _key in (("url", "title || '_' || company"), ("exact", "title, company, location"), ("fuzzy", "replace(lower(title), ' ', '_') || '_' || replace(lower(company), ' ', '_')")):
    QUERIES[f"dedup_{_strategy}"] = _by_strategy(_strategy)
    ORACLE[f"dedup_{_strategy}"] = f"WITH {views.PARTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY {_key} ORDER BY ord) AS k FROM parts) SELECT ord, id, title, company FROM n WHERE k = 1"


@query("SELECT min(page_id) AS page_id, url FROM pages GROUP BY url")
def dedup_pages(spark, sf_dir):
    return dedup.first_per_key(table(spark, sf_dir, "pages").select("page_id", "url"), [F.col("url")], F.col("page_id"))


@query(f"WITH {views.PARTS_SQL} SELECT ord, title, company FROM parts WHERE NOT {EXCLUDED_SQL}")
def exclude_terms(spark, sf_dir):
    return filters.exclude(views.parts(spark, sf_dir), filters.terms("Brand#11, Brand#2 ,"), filters.terms("Red, STEEL")).select("ord", "title", "company")


@query(f"WITH {views.PARTS_SQL} SELECT ord, title, company FROM parts WHERE NOT lower(title) LIKE '%red%' AND (lower(company) LIKE '%brand#1%' OR lower(company) LIKE '%brand#3%') AND lower(title) LIKE '%e%'")
def include_terms(spark, sf_dir):
    return filters.select_terms(views.parts(spark, sf_dir), in_company=["Brand#1", "brand#3"], in_title=["E"], out_title=["RED"]).select("ord", "title", "company")


@query(f"WITH {views.PARTS_SQL} SELECT ord, CASE WHEN lower(title) LIKE '%red%' THEN 'red' WHEN lower(title) LIKE '%a%' THEN 'a' END AS term FROM parts")
def matching_terms(spark, sf_dir):
    return views.parts(spark, sf_dir).select("ord", filters.matching_term(F.col("title"), ["red", "a"]).alias("term"))


@query(
    "WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{5,}'))) AS w FROM benchmark), t AS (SELECT w, row_number() OVER (ORDER BY length(w) DESC, w) AS place FROM w), "
    "f AS (SELECT doc_id, arg_min(w, place) AS term FROM documents JOIN t ON contains(lower(text), w) GROUP BY doc_id) SELECT doc_id, term FROM documents LEFT JOIN f USING (doc_id)"
)
def listed_terms(spark, sf_dir):
    """The longest word of the benchmark, of five ASCII letters or more, that each document contains."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{5,})"))).alias("w")).select(F.lower("w").alias("term")).distinct()
    listed = order.numbered(words.withColumn("shorter", -F.length("term")), "shorter", "term", name="place")
    return terms.first_term(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", listed).select("doc_id", "term")


@query("SELECT page_id, url FROM pages WHERE length(url) > 0 AND length(html) > 0")
def required_fields(spark, sf_dir):
    return filters.filled(table(spark, sf_dir, "pages"), "url", "html").select("page_id", "url")


_NOT_SEEN = "NOT EXISTS (SELECT 1 FROM registry r WHERE lower(r.company) = lower(l.company) AND lower(r.title) = lower(l.title){})"


@query(f"WITH {views.LISTINGS_SQL}, {views.REGISTRY_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM listings l WHERE {_NOT_SEEN.format('')}")
def registry_anti_join(spark, sf_dir):
    return registry.unseen(views.listings(spark, sf_dir), views.registry(spark, sf_dir)).select(*views.ORDER)


@query(f"WITH {views.PARTS_SQL}, {views.REGISTRY_SQL} SELECT ord, title FROM parts l WHERE {_NOT_SEEN.format(" AND r.listingId <> '7'")}")
def registry_exclude_id(spark, sf_dir):
    return registry.unseen(views.parts(spark, sf_dir), views.registry(spark, sf_dir), exclude_id="7").select("ord", "title")


@query(f"WITH {views.PARTS_SQL}, {views.REGISTRY_SQL} SELECT ord, title FROM parts l WHERE {_NOT_SEEN.format(" AND CAST(50 AS BIGINT) * 86400000 - r.admitTime < 5 * 86400000")}")
def registry_ttl(spark, sf_dir):
    live = registry.expire(views.registry(spark, sf_dir), NOW, 5 * registry.DAY_MS)
    return registry.unseen(views.parts(spark, sf_dir), live).select("ord", "title")


@query(f"WITH {views.REGISTRY_SQL} SELECT count(*) AS total, count(*) FILTER (admitTime + 5 * 86400000 - CAST(50 AS BIGINT) * 86400000 <= 0) AS expired, CAST(greatest(0, min(admitTime + 5 * 86400000 - CAST(50 AS BIGINT) * 86400000)) AS BIGINT) AS next_expiry FROM registry")
def registry_stats(spark, sf_dir):
    return registry.stats(views.registry(spark, sf_dir), NOW, 5 * registry.DAY_MS)


@query(f"WITH {views.REGISTRY_SQL} SELECT listingId, title FROM (SELECT listingId, '  ' || title AS title FROM registry UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name FROM customer) WHERE listingId <> '1'")
def registry_admit_remove(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("listingId"), F.col("c_mktsegment").alias("company"), F.col("c_name").alias("title"))
    return registry.remove(registry.admit(views.registry(spark, sf_dir), new, NOW, cap=1 << 40), "1").select("listingId", "title")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def last_wins(spark, sf_dir):
    return verdicts.last_verdicts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", F.col("turn")).select("conv_id", "turn", "role")


@query("SELECT doc_id, lang, CAST(1.0 AS DOUBLE) AS confidence FROM documents JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max_by(quality, quality * 2 - toxic) = 1) USING (doc_id)")
def verdict_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("isVeryHighlyAligned"), F.lit(1.0).alias("confidence"), (F.col("quality") * 2 - F.col("toxic")).alias("o"))
    return verdicts.join_verdicts(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, "doc_id", F.col("o"))


_HITS = " + ".join(f"CAST(contains(lower(p_name), '{k}') OR contains(lower(p_type), '{k}') AS INTEGER)" for k in verdicts.KEYWORDS)


@query(f"SELECT p_partkey, ({_HITS}) >= 2 AS pass, least(({_HITS}) * 0.3, 1.0)::DOUBLE AS confidence FROM part")
def keyword_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("descriptionText"))
    return keyword_scorer()(rows).select("p_partkey", F.col("verdict.isVeryHighlyAligned").alias("pass"), F.col("verdict.confidence").alias("confidence"))


@query("WITH t AS (SELECT p_name, row_number() OVER (ORDER BY first) - 1 AS pos FROM (SELECT p_name, min(p_partkey) AS first FROM part GROUP BY p_name)) SELECT CAST(pos // 100 AS BIGINT) AS batch, count(*) AS n, string_agg(p_name, chr(10) ORDER BY pos) AS text FROM t GROUP BY 1")
def title_batches(spark, sf_dir):
    titles = verdicts.distinct_titles(table(spark, sf_dir, "part"), F.col("p_partkey"), "p_name")
    return batching.batches(titles, "first", "p_name", 100)


_ROUTED = f"""WITH {views.LISTINGS_SQL}, {views.REGISTRY_SQL}, flagged AS (
  SELECT l.*, NOT {_NOT_SEEN.format('')} AS seen FROM listings l),
firsts AS (SELECT lower(title) AS t, lower(company) AS c, min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS o FROM flagged WHERE NOT seen GROUP BY 1, 2),
routed AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN seen OR (l_orderkey, l_linenumber, l_partkey, l_suppkey) <> o THEN 'dupe'
  WHEN length(descriptionText) = 0 THEN 'no_description' WHEN contains(descriptionText, 'HIGH') THEN 'pass' ELSE 'fail' END AS route
  FROM flagged LEFT JOIN firsts ON lower(title) = t AND lower(company) = c) """


def _routed(spark, sf_dir):
    verdict = F.struct(F.col("descriptionText").contains("HIGH").alias("isVeryHighlyAligned"))
    # written, as it is read once for the firsts, once for ties among them and once for the routes
    rows = staged(views.listings(spark, sf_dir).select(*views.ORDER, "title", "company", "descriptionText"), "judge-listings")
    return verdicts.routes(rows, views.registry(spark, sf_dir), views.order(), verdict)


@query(_ROUTED + "SELECT * FROM routed")
def judge_routes(spark, sf_dir):
    return _routed(spark, sf_dir).select(*views.ORDER, "route")


@query(
    _ROUTED + "SELECT count(*) AS total, count(*) FILTER (route = 'pass') AS passed, count(*) FILTER (route = 'fail') AS failed, count(*) FILTER (route = 'dupe') AS dupes, count(*) FILTER (route = 'no_description') AS no_description, "
    "CAST(CASE WHEN count(*) FILTER (route IN ('pass', 'fail')) > 0 THEN floor(count(*) FILTER (route = 'pass') * 100.0 / count(*) FILTER (route IN ('pass', 'fail')) + 0.5) ELSE 0 END AS BIGINT) AS success_percent FROM routed"
)
def judge_report(spark, sf_dir):
    return verdicts.judge_totals(_routed(spark, sf_dir))


@query("SELECT user_id, max_by(event_type <> 'error', ts) AS ok, count(*) AS attempts, max_by(event_type = 'error', ts) AS fallback FROM events GROUP BY user_id")
def attempt_outcomes(spark, sf_dir):
    rows = views.calls(spark, sf_dir).select("user_id", F.col("ts").alias("attempt"), "ok", F.lit(True).alias("isVeryHighlyAligned"), F.lit(1.0).alias("confidence"), F.lit("failed").alias("error"))
    return verdicts.attempts_outcome(rows, "user_id").select("user_id", "ok", "attempts", F.col("fallbackUsed").alias("fallback"))


@query("SELECT lang, source, CAST(range AS INTEGER) AS page FROM (SELECT DISTINCT lang FROM documents), (SELECT DISTINCT source FROM documents), range(3)")
def search_grid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return verdicts.search_grid(docs.select("lang").distinct(), docs.select("source").distinct(), 3)


@query("WITH d AS (SELECT user_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS page, count(*) AS hits FROM events GROUP BY 1, 2), s AS (SELECT *, min(CASE WHEN hits < 3 THEN page END) OVER (PARTITION BY user_id) AS stop FROM d) SELECT user_id, CAST(page AS INTEGER) AS page, hits FROM s WHERE (stop IS NULL OR page <= stop) AND page < 1000")
def take_while_pages(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("page")).agg(F.count("*").alias("hits"))
    return verdicts.take_while_pages(days, ["user_id"], "page", F.col("hits") < 3)


@query("SELECT CASE event_type WHEN 'error' THEN 'operations.failed' ELSE 'operations.successful' END AS name, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events WHERE event_type IN ('error', 'click') GROUP BY 1")
def run_counters(spark, sf_dir):
    return stats.counters(views.log(spark, sf_dir)).select("name", numbers.half_up(F.col("value"), 2).alias("total"))


@query("SELECT CASE WHEN grouping(event_type) = 1 THEN NULL ELSE 'x.' || event_type END AS name, floor(sum(value) * 100 + 0.5) / 100 AS total, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ROLLUP (event_type)")
def run_timers(spark, sf_dir):
    return stats.timers(views.log(spark, sf_dir)).select("name", numbers.half_up(F.col("total"), 2).alias("total"), "n")


@query("SELECT 'x.view' AS name, min_by(value, ts) AS first, max_by(value, ts) AS last, max(value) AS peak, floor(avg(value) * 10000 + 0.5) / 10000 AS mean FROM events WHERE event_type = 'view'")
def run_gauges(spark, sf_dir):
    return stats.gauges(views.log(spark, sf_dir)).select("name", "first", "last", "peak", numbers.half_up(F.col("mean"), 4).alias("mean"))


@query("SELECT CASE WHEN regexp_matches(x, 'network|connection|timeout') THEN 'network' WHEN regexp_matches(x, 'parsing|json|format') THEN 'parsing' WHEN regexp_matches(x, 'validation|invalid') THEN 'validation' WHEN regexp_matches(x, 'api|rate|limit') THEN 'api' WHEN regexp_matches(x, 'file|disk|io') THEN 'file' ELSE 'other' END AS category, count(*) AS n FROM (SELECT lower(text) AS x FROM conversations) GROUP BY 1")
def error_categories(spark, sf_dir):
    return stats.error_categories(table(spark, sf_dir, "conversations"), "text")


@query("SELECT CASE WHEN contains(x, 'truncated') OR contains(x, 'unexpected end') THEN 'truncation' WHEN contains(x, 'unexpected token') OR contains(x, 'invalid syntax') THEN 'syntax' WHEN contains(x, 'property') OR contains(x, 'object') THEN 'structure' ELSE 'unknown' END AS kind, count(*) AS n FROM (SELECT lower(text) AS x FROM conversations) GROUP BY 1")
def parse_error_kinds(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(text.parse_error_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS calls, floor(10000.0 * count(*) FILTER (event_type <> 'error') / count(*) + 0.5) / 100 AS success_rate, floor(10000.0 * count(*) FILTER (event_type = 'error') / count(*) + 0.5) / 100 AS error_rate, floor(avg(value) * 10000 + 0.5) / 10000 AS mean_duration FROM events")
def final_rates(spark, sf_dir):
    return stats.final_rates(views.calls(spark, sf_dir), F.col("ok"), F.col("value"))


@query("SELECT user_id, floor(avg(CAST(event_type = 'error' AS INTEGER)) * 10000 + 0.5) / 10000 AS error_share, CASE WHEN avg(CAST(event_type = 'error' AS INTEGER)) > 0.5 THEN 'unhealthy' WHEN avg(CAST(event_type = 'error' AS INTEGER)) > 0.2 THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY user_id")
def provider_health(spark, sf_dir):
    rows = views.calls(spark, sf_dir).select(F.col("user_id").alias("provider"), "ok", F.col("value").alias("duration"))
    return stats.provider_health(rows).select(F.col("provider").alias("user_id"), numbers.half_up(F.col("error_share"), 4).alias("error_share"), "status")


@query("SELECT event_id, max(cents) OVER w AS rolling_peak, floor(avg(cents) OVER w * 10000 + 0.5) / 10000 AS rolling_mean FROM (SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def rolling_peak_mean(spark, sf_dir):
    rows = views.calls(spark, sf_dir).withColumn("o", F.struct("ts", "event_id")).withColumn("cents", F.floor(F.col("value") * 100 + 0.5))
    return stats.rolling(rows, ["user_id"], "o", "cents").select("event_id", "rolling_peak", numbers.half_up(F.col("rolling_mean"), 4).alias("rolling_mean"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def last_calls(spark, sf_dir):
    return order.last_rows(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", n=1000)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'error') WHERE k <= 5")
def last_errors(spark, sf_dir):
    rows = views.calls(spark, sf_dir).where("not ok").withColumn("o", F.struct("ts", "event_id"))
    return stats.last_per_key(rows, ["user_id"], "o", 5).select("user_id", "event_id")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 200")
def paginate(spark, sf_dir):
    return order.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", number=2)


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS listingId, p_brand AS company, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 2000 ELSE 1000 END + p_size AS admitTime FROM part WHERE p_partkey % 5 <> 0 OR p_partkey % 3 = 0"
)
def registry_versions(spark, sf_dir):
    """A registry of all parts in four versions: all admitted, some removed, a snapshot, some admitted anew."""
    path = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "part")
    entries = lambda at: p.select(F.col("p_partkey").cast("string").alias("listingId"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"), (F.col("p_size") + at).cast("long").alias("admitTime"), F.lit(None).cast("long").alias("lastProcessed"), "p_partkey")
    versions.commit(spark, path, entries(1000))
    versions.commit(spark, path, removed=entries(0).where("p_partkey % 5 = 0"))
    versions.compact(spark, path)
    versions.commit(spark, path, entries(2000).where("p_partkey % 3 = 0"))
    return versions.read_version(spark, path).select("listingId", "company", "title", "admitTime")


@query(
    "WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) // 1000 AS ms FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ms, CAST(event_id AS VARCHAR)) AS k FROM e) "
    "SELECT CAST(event_id AS VARCHAR) AS listingId, ms AS admitTime FROM f WHERE k = 1 AND NOT (user_id % 10 = 0 AND event_type = 'view')"
)
def admitted_events(spark, sf_dir):
    """The first event of each user and kind, but for views of users that the registry has."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("listingId"), F.concat(F.lit("User "), "user_id").alias("company"), F.col("event_type").alias("title"), F.col("ts").cast("timestamp").alias("ts"), "user_id")
    first = e.agg(F.min(F.unix_millis("ts"))).first()[0]
    known = e.where("user_id % 10 = 0").select(F.col("user_id").cast("string").alias("listingId"), F.upper("company").alias("company"), F.lit("View ").alias("title"), F.lit(first).cast("long").alias("admitTime"), F.lit(None).cast("long").alias("lastProcessed")).distinct()
    return registry_state.admitted(e.drop("user_id"), ttl=1000 * registry.DAY_MS, registry=known).select("listingId", "admitTime")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY ALL LIMIT 250 OFFSET 2000")
def indexed_pages(spark, sf_dir):
    """A page of the order lines from an index of pages."""
    path, keys = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}", views.ORDER
    order.index_pages(table(spark, sf_dir, "lineitem").select(*keys), *keys, path=path)
    return order.indexed_page(spark, *keys, path=path, number=8, size=250)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS place FROM part")
def sorted_places(spark, sf_dir):
    return order.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", name="place").select("p_partkey", "place")


_SIM = "CASE WHEN length(a.{0}) > 0 AND length(b.{0}) > 0 THEN (greatest(length(a.{0}), length(b.{0})) - levenshtein(a.{0}, b.{0})) / greatest(length(a.{0}), length(b.{0})) ELSE 0 END"


def _part_listings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("location"), F.lit("").alias("url"))


@query(
    "WITH r AS (SELECT p_brand AS company, p_name AS title, p_type AS location, min(p_partkey) AS k FROM part GROUP BY ALL), "
    f"s AS (SELECT a.k AS left_key, b.k AS right_key, floor((0.4::DOUBLE * {_SIM.format('title')} + 0.3::DOUBLE * {_SIM.format('company')} + 0.2::DOUBLE * {_SIM.format('location')} + 0.1::DOUBLE) * 100 + 0.5) / 100 AS similarity "
    "FROM r a JOIN r b ON a.k < b.k) SELECT * FROM s WHERE similarity >= 0.9"
)
def similar_listings(spark, sf_dir):
    return similarity.similar_pairs(_part_listings(spark, sf_dir), "p_partkey", least=0.9)


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS member_of FROM part")
def similar_members(spark, sf_dir):
    return similarity.members(_part_listings(spark, sf_dir), "p_partkey")


@query("SELECT c_custkey, trim(lower('  ' || c_name || chr(9) || ' ' || c_mktsegment)) AS raw, regexp_replace(trim(lower('  ' || c_name || chr(9) || ' ' || c_mktsegment)), '[ \\t]+', ' ', 'g') AS norm FROM customer")
def normalize_keys(spark, sf_dir):
    c = F.concat(F.lit("  "), "c_name", F.lit("\t "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", text.trimmed(F.lower(c)).alias("raw"), text.normalize_string(c).alias("norm"))


@query(
    "WITH u AS (SELECT o_orderkey, 'https://jobs.example.com/jobs/view/' || CASE o_orderkey % 4 WHEN 0 THEN 'some-title-' || o_orderkey WHEN 1 THEN '?position=' || o_orderkey WHEN 2 THEN '' || o_orderkey ELSE 'slug/' || o_orderkey || '?position=3' END AS url FROM orders) "
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 4 WHEN 3 THEN CAST(o_orderkey AS VARCHAR) ELSE substr(md5(url), 1, 8) END AS hashed FROM u"
)
def extract_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    tail = F.when(k % 4 == 0, F.concat(F.lit("some-title-"), k)).when(k % 4 == 1, F.concat(F.lit("?position="), k)).when(k % 4 == 2, k.cast("string")).otherwise(F.concat(F.lit("slug/"), k, F.lit("?position=3")))
    url = F.concat(F.lit("https://jobs.example.com/jobs/view/"), tail)
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.id_from_url(url).alias("id"), ids.id_or_hash(url).alias("hashed"))


@query("SELECT page_id, url AS repaired, substr(md5(url), 1, 8) AS id FROM pages")
def repair_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    doubled = F.concat(F.lit("https://www.jobs.example.com"), "url")
    return pages.select("page_id", ids.repair_url(doubled, "jobs.example.com").alias("repaired"), ids.id_or_hash(F.col("url")).alias("id"))


@query("SELECT event_id, CASE WHEN s // 60 > 0 THEN (s // 60) || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || (s % 60) || 's' ELSE '' END WHEN s % 60 = 0 AND ms % 1000 > 0 THEN '0s ' || (ms % 1000) || 'ms' ELSE (s % 60) || 's' END AS duration FROM (SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS ms, CAST(floor(value * 1000) AS BIGINT) // 1000 AS s FROM events)")
def format_durations(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numbers.format_duration(F.floor(F.col("value") * 1000)).alias("duration"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.2f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2f KB', floor(n / 1024 * 100 + 0.5) / 100) ELSE printf('%.2f MB', floor(n / 1048576 * 100 + 0.5) / 100) END AS size FROM (SELECT doc_id, n_chars * 7 AS n FROM documents)")
def format_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", numbers.format_bytes(F.col("n_chars") * 7).alias("size"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "WITH h AS (SELECT doc_id, text, substring(text, 1, 400) AS h FROM documents), e AS (SELECT *, greatest(length(h) - coalesce(nullif(strpos(reverse(h), '.'), 0), 401) , length(h) - coalesce(nullif(strpos(reverse(h), '!'), 0), 401), length(h) - coalesce(nullif(strpos(reverse(h), '?'), 0), 401)) AS e, strpos(reverse(h), ' ') AS s FROM h) "
    "SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN e <= 200 THEN h WHEN e + 1 > 320 THEN substring(h, 1, e + 1) WHEN s > 0 AND 400 - s > 320 THEN substring(h, 1, 400 - s) ELSE h END AS text FROM e"
)
def truncate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_to_tokens(F.col("text"), 100).alias("text"))


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events WHERE event_type = 'error') SELECT event_id, least(1000 * pow(2.0, k), 30000.0)::DOUBLE AS delay, (400 + 7 * k) >= 500 OR (400 + 7 * k) IN (408, 429) AS retryable FROM e")
def retry_schedule(spark, sf_dir):
    """A delay for each failed call of a user, by how many failed before."""
    failed = views.calls(spark, sf_dir).where("not ok").withColumn("o", F.struct("ts", "event_id"))
    k = F.col("k")
    tried = order.numbered_within(failed.select("user_id", "event_id", "o"), ["user_id"], "o", "k")
    return tried.select("event_id", numbers.backoff(k).alias("delay"), numbers.is_retryable(400 + 7 * k).alias("retryable"))


_TIMERS_SQL = "t AS (SELECT 'x.' || event_type AS name, CASE WHEN event_id % 10 = 0 OR value > 3600 THEN NULL ELSE floor(value * 1000) END AS ms FROM events)"


@query(f"WITH {_TIMERS_SQL} SELECT name, coalesce(sum(ms), 0)::DOUBLE AS total, count(ms) AS n, count(*) - count(ms) AS open FROM t GROUP BY ROLLUP (name)")
def paired_timers(spark, sf_dir):
    """A timer for each event that ends after as many seconds as its value; every tenth never ends."""
    return stats.timer_totals(stats.pair_timers(views.timer_log(spark, sf_dir)))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS low, CAST(floor(o_totalprice) AS BIGINT) + 10 AS high FROM orders")
def salaries_from_text(spark, sf_dir):
    p = F.floor("o_totalprice").cast("long")
    s = numbers.text_salary(F.concat(F.lit("Pay: "), p, F.lit(" - "), p + 10, F.lit(" USD")))
    return table(spark, sf_dir, "orders").select("o_orderkey", s["min"].alias("low"), s["max"].alias("high"))


@query("SELECT o_orderkey, floor(o_totalprice)::DOUBLE AS low, -1.0::DOUBLE AS high, 'EUR' AS currency FROM orders")
def salaries_from_cards(spark, sf_dir):
    s = numbers.card_salary(F.concat(F.lit("€"), F.format_number(F.floor("o_totalprice"), 0)))
    return table(spark, sf_dir, "orders").select("o_orderkey", s["min"].alias("low"), s["max"].alias("high"), s["currency"].alias("currency"))


@query("SELECT s_suppkey, CASE WHEN floor(s_acctbal) > 0 THEN 'USD ' || CAST(floor(s_acctbal) AS BIGINT) || ' - ' || (CAST(floor(s_acctbal) AS BIGINT) + 1) ELSE 'Not specified' END || CASE WHEN s_nationkey = 3 THEN ' (Remote OK)' ELSE '' END AS pay FROM supplier")
def compensation_texts(spark, sf_dir):
    low = F.floor("s_acctbal")
    pay = numbers.compensation(F.lit(None).cast("string"), low, low + 1, F.lit("USD"), F.col("s_nationkey") == 3)
    return table(spark, sf_dir, "supplier").select("s_suppkey", pay.alias("pay"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9]', '_', 'g') AS file, regexp_matches(lower(p_name), 'remote|no office location') AS remote FROM part")
def file_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.file_name(F.col("p_name")).alias("file"), text.remote_flag(F.col("p_name")).alias("remote"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '[^A-Za-z0-9_ \\-.,;:!?()\"''\\[\\]{}]', '', 'g'), ' ') AS text FROM documents")
def clean_descriptions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_description(F.col("text")).alias("text"))


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(string_split(p_name, ' ')), lambda x: x IN ('blue', 'green', 'red', 'steel'))), ',') AS tags FROM part")
def stack_tags(spark, sf_dir):
    tags = text.stack_tags(F.col("p_name"), F.lit(""), ["blue", "green", "red", "steel"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(tags), ",").alias("tags"))


_CUT = [p.replace("'", "''") for p in security.REDACTED]


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{_CUT[0]}', '[REDACTED]', 'g'), '{_CUT[1]}', '[REDACTED]', 'g'), '{_CUT[2]}', '[REDACTED]', 'g') AS text FROM documents")
def redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", security.redact(F.col("text")).alias("text"))


_SENSITIVE = r"(?i)(" + "|".join(security.SENSITIVE) + r""")\s*[:=]\s*[''"]?\w+[''"]?"""


@query(f"SELECT doc_id, regexp_matches(text, '{_SENSITIVE}') AS sensitive FROM documents")
def sensitive_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", security.has_sensitive(F.col("text")).alias("sensitive"))


def _any(patterns) -> str:
    return " OR ".join("regexp_matches(html, '" + p.replace("'", "''") + "')" for p in patterns)


@query(f"SELECT page_id, NOT ({_any(security.XSS)}) AS no_script, NOT ({_any(security.COMMAND)}) AS no_command FROM pages")
def screen_pages(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", security.is_clean(h, "xss").alias("no_script"), security.is_clean(h, "command").alias("no_command"))


@query("SELECT c_custkey, substr(c_name, 1, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) AS masked, regexp_matches(c_name, '^[a-zA-Z0-9\\-_]{16,128}$') AS real FROM customer")
def mask_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", security.mask(F.col("c_name")).alias("masked"), security.is_real_key(F.col("c_name")).alias("real"))


@query("WITH c AS (SELECT s_suppkey, s_name, unnest(string_split(s_name, '')) AS x FROM supplier), f AS (SELECT s_suppkey, s_name, x, count(*) AS n FROM c GROUP BY ALL) SELECT s_suppkey, floor(-sum(n / length(s_name) * log2(n / length(s_name))) * 1000 + 0.5) / 1000 AS entropy FROM f GROUP BY s_suppkey")
def name_entropy(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", numbers.half_up(security.entropy(F.col("s_name")), 3).alias("entropy"))


@query(r"""SELECT page_id, path, CASE WHEN contains(path, '..') OR regexp_matches(path, '^/|~(/|$)|\$\{.*\}|%.*%') OR length(name) NOT BETWEEN 1 AND 255
  OR upper(name) IN ('CON', 'PRN', 'AUX', 'NUL') OR regexp_matches(upper(name), '^(COM|LPT)[1-8]$') OR regexp_matches(lower(name), '\.(exe|bat|cmd|com|pif|scr|vbs|js|jar)$') THEN NULL ELSE path END AS safe
FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '../' ELSE '' END || regexp_replace(url, '^[a-z]+://', CASE page_id % 5 WHEN 0 THEN '/' ELSE '' END) || CASE page_id % 7 WHEN 1 THEN '.js' WHEN 2 THEN '/con' WHEN 3 THEN '%2e%' WHEN 4 THEN '/~' ELSE '' END AS path FROM pages))""")
def safe_paths(spark, sf_dir):
    k = F.col("page_id")
    end = F.when(k % 7 == 1, ".js").when(k % 7 == 2, "/con").when(k % 7 == 3, "%2e%").when(k % 7 == 4, "/~").otherwise("")
    path = F.concat(F.when(k % 3 == 0, "../").otherwise(""), F.when(k % 5 == 0, "/").otherwise(""), F.regexp_replace("url", "^[a-z]+://", ""), end)
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", security.safe_path(F.col("path")).alias("safe"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(u, '([?&])token=[^&#]*(&|(#|$))', '\1\3'), '[?&](#|$)', '\1') AS kept, regexp_matches(url, '^(javascript|data|vbscript|file):') = false AS safe
FROM (SELECT *, regexp_extract(url, '^[^#]*') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=' || page_id || CASE page_id % 2 WHEN 0 THEN '&z=1' ELSE '' END || regexp_extract(url, '#.*$') AS u FROM pages)""")
def strip_url_secrets(spark, sf_dir):
    """Pages' own URLs with a secret parameter added, and what is left of them."""
    k = F.col("page_id")
    u = F.concat(F.regexp_extract("url", "^[^#]*", 0), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("token="), k, F.when(k % 2 == 0, "&z=1").otherwise(""), F.regexp_extract("url", "#.*$", 0))
    return table(spark, sf_dir, "pages").select("page_id", security.strip_parameters(u).alias("kept"), security.is_safe_url(F.col("url")).alias("safe"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g'), '[<>\"''&]', '', 'g') AS text FROM documents")
def printable_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", security.printable(F.col("text")).alias("text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def repair_event_props(spark, sf_dir):
    """Properties damaged in four ways and repaired."""
    fixed = _damaged(spark, sf_dir).select("event_id", repair_json(F.col("damaged")).alias("r"))
    return fixed.select("event_id", F.get_json_object("r.json", "$.k").cast("long").alias("k"))


def _damaged(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    damaged = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.regexp_replace("props", r"\}$", ",}")).when(F.col("event_id") % 4 == 2, F.regexp_replace("props", r"\}$", "")).otherwise(F.col("props"))
    return e.withColumn("damaged", damaged)


@query("SELECT user_id, wrapped, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events, (VALUES (true), (false)) AS w(wrapped) GROUP BY ALL")
def concatenated_records(spark, sf_dir):
    """Records written one after another, one around the other's value, and both read back."""
    e = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("{\n  \"id\": 1,\n  \"p\": "), "props", F.lit("\n}\n"), "props").alias("t"))
    rows = e.select("user_id", F.explode(records_of("t")).alias("j")).withColumn("wrapped", F.get_json_object("j", "$.p").isNotNull())
    k = F.coalesce(F.get_json_object("j", "$.p.k"), F.get_json_object("j", "$.k")).cast("long")
    return rows.groupBy("user_id", "wrapped", k.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS n_links FROM pages")
def page_fields(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", html.detail_fields(h, {"title": ("title", "")})["title"].alias("title"), F.size(html.links(h)).cast("long").alias("n_links"))


_CARD_URL = "regexp_replace(url, '[?#].*$', '') || '/jobs/view/t-' || page_id || regexp_extract(url, '[?].*$')"


@query(f"SELECT page_id, CAST(page_id AS VARCHAR) AS id, 'T' || page_id AS title, 'Acme' AS company, 'Rome' AS location, {_CARD_URL} AS url FROM pages")
def search_cards(spark, sf_dir):
    """Cards around every page's own URL; its parameters follow the card's number."""
    k = F.col("page_id").cast("string")
    card = F.concat(
        F.lit('<div class="x base-search-card y"><div><a href="'), F.regexp_replace("url", "[?#].*$", ""), F.lit("/jobs/view/t-"), k, F.regexp_extract("url", "[?].*$", 0), F.lit('"></a><h3 class="base-search-card__title"> T'), k,
        F.lit('</h3><h4 class="base-search-card__subtitle"><a>Acme</a></h4><span class="job-search-card__location">Rome</span></div></div><div class="base-search-card"></div></div>'),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(html.search_cards(card)).alias("c"))
    return rows.select("page_id", "c.*")


@query(
    f"SELECT page_id, CAST(page_id AS VARCHAR) AS id, 'Rome' AS city, {_CARD_URL} AS url, 'https://acme.example.com/' AS companyUrl, CASE WHEN page_id % 2 = 0 THEN 'late.png' ELSE 'now.png' END AS img, '2024-05-06T00:00:00.000Z' AS date, "
    "CASE page_id % 3 WHEN 0 THEN '2024-01-31T00:00:00.000Z' ELSE '2024-05-06T00:00:00.000Z' END AS postedDate, 'Remote Go ' || page_id AS title, 'Acme' AS company, 'Rome' AS location, 'USD' AS salaryCurrency, -1.0::DOUBLE AS salaryMax, "
    "(1000 + page_id)::DOUBLE AS salaryMin, '' AS countryCode, '' AS countryText, '' AS descriptionHtml, true AS remoteOk, 'go' AS stackRequired FROM pages"
)
def card_records(spark, sf_dir):
    """The 18 fields of a card of either layout for every page."""
    k = F.col("page_id").cast("string")
    new = F.col("page_id") % 2 == 0
    c = lambda a, b: F.when(new, a).otherwise(b)
    page = F.concat(
        F.lit("<ul><li><p>no card</p></li><li><div class='base-card' data-entity-urn='urn:li:jobPosting:"), k, F.lit("'><a class='"), c("base-card__full-link", "base-search-card--link"), F.lit("' href='https://www.linkedin.com"), F.regexp_replace("url", "[?#].*$", ""),
        F.lit("/jobs/view/t-"), k, F.regexp_extract("url", "[?].*$", 0), F.lit("'></a><img "), c("data-delayed-url='late.png' src='now.png'", "src='now.png'"), F.lit("><h3 class='"), c("base-search-card__title", "base-main-card__title"), F.lit("'> Remote Go "), k,
        F.lit("</h3><h4 class='"), c("base-search-card__subtitle", "base-main-card__subtitle"), F.lit("'><a href='https://acme.example.com/'>Acme</a></h4><span class='"), c("job-search-card__location", "main-job-card__location"), F.lit("'>Rome</span>"),
        F.when(F.col("page_id") % 3 == 0, F.lit("<time class='job-search-card__listdate--new' datetime='2024-01-31'>x</time>")).otherwise(""), F.lit("<span class='job-search-card__salary-info'>$"), F.format_number(F.col("page_id") + 1000, 0), F.lit("</span></div></li></ul>"),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(html.card_records(page, ["go", "rust"], F.lit("2024-05-06").cast("timestamp"))).alias("c")).select("page_id", "c.*")
    return rows.withColumn("stackRequired", F.array_join("stackRequired", ","))


@query(
    "SELECT page_id, url AS title, 'Acme' AS company, 'Rome' AS location, '' AS postedTime, 'Over ' || page_id AS applicants, CASE page_id % 2 WHEN 0 THEN '$5' ELSE '$6' END AS salaryRange, 'Text ' || page_id AS descriptionText, "
    "CASE page_id % 3 WHEN 0 THEN 'Senior' ELSE '' END AS seniorityLevel, 'Full-time' AS employmentType, '' AS jobFunction, 'Mining' AS industries, 'Remote' AS remoteBox FROM pages"
)
def detail_records(spark, sf_dir):
    """The fields of a detail page for every page; some have no posted time, function or level."""
    k = F.col("page_id").cast("string")
    page = F.concat(
        F.lit('<h1 class="x topcard__title">'), "url", F.lit('</h1><a class="topcard__org-name-link">Acme</a><div class="topcard__flavor-row"><span class="topcard__flavor topcard__flavor--bullet"> Rome </span></div><span class="num-applicants__caption">Over '), k, F.lit("</span>"),
        F.when(F.col("page_id") % 2 == 0, '<div class="compensation__salary">$5</div>').otherwise('<span class="main-job-card__salary-info">$6</span>'),
        F.when(F.col("page_id") % 3 == 0, "<h3> Seniority level </h3> <span> Senior </span>").otherwise(""), F.lit("<h3>Employment type</h3><span>Full-time</span><h3>Industries</h3><span>Mining</span>"),
        F.lit('<div class="description__text--rich"><div class="show-more-less-html__markup"><p>Text <b>'), k, F.lit('</b></p></div></div><span class="tvm__text tvm__text--low-emphasis"><strong>Remote</strong></span>'),
    )
    return table(spark, sf_dir, "pages").select("page_id", html.detail_record(page).alias("d")).select("page_id", "d.*")


@query(
    "SELECT page_id, url AS title, '' AS company, 'Text of ' || url || 'and number ' || page_id || CASE WHEN page_id % 2 = 0 THEN 'Listed' ELSE '' END || 'Last part.' AS descriptionText, "
    "CASE page_id % 3 WHEN 0 THEN 'Senior' ELSE '' END AS seniorityLevel, 'Full-time' AS employmentType FROM pages"
)
def nested_details(spark, sf_dir):
    """Descriptions of blocks within blocks, broken markup around them, and headings in lists."""
    k = F.col("page_id").cast("string")
    page = F.concat(
        F.lit("<html><body><script>var d = '<div class=description__text--rich>';</script><h1 class='topcard__title x'><span>"), "url", F.lit("</span></h1><p>Open<ul><li><h3>Seniority level</h3>"),
        F.when(F.col("page_id") % 3 == 0, "<span>Senior</span>").otherwise(""), F.lit("<li><h3>Employment type</h3><span> Full-time <b>now</b></span></ul><div class='x description__text--rich'><section class='show-more-less-html'><div class='show-more-less-html__markup y'><div><div>Text of "),
        "url", F.lit("</div><p>and number "), k, F.lit("</div>"), F.when(F.col("page_id") % 2 == 0, "<ul><li>List<li>ed</ul>").otherwise("</b>"), F.lit("<div>Last <i>part.</div></div></section><div class='show-more-less-html__markup'>Not this</div></div></body>"),
    )
    d = table(spark, sf_dir, "pages").select("page_id", html.detail_record(page).alias("d"))
    return d.select("page_id", "d.title", "d.company", "d.descriptionText", "d.seniorityLevel", "d.employmentType")


@query("SELECT event_id AS id, user_id, event_type AS type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'a \"}{[' || event_type AS odd FROM events WHERE event_id % 11 <> 0 UNION ALL SELECT event_id + 1000000000, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT), 'a \"}{[' || event_type FROM events WHERE event_id % 11 <> 0")
def record_files(spark, sf_dir):
    """Events written as files of objects one after another, some of them damaged, and as arrays of one line; both read back by byte range."""
    folder = f"{shared_dir(spark)}/record-files-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    record = lambda shift: F.to_json(F.struct((F.col("event_id") + shift).alias("id"), "user_id", F.col("event_type").alias("type"), F.from_json("props", "k long").alias("p"), F.concat(F.lit('a "}{['), "event_type").alias("odd")), {"pretty": "true"})
    good = F.col("event_id") % 11 != 0
    e.select(F.when(good, record(0)).otherwise(F.concat(F.lit('{"id": "'), "event_type"))).write.text(f"{folder}/objects")
    arrays = e.where(good).groupBy(F.floor(F.col("event_id") / 1000)).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.regexp_replace(record(1_000_000_000), r"\n *", "")), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.text(f"{folder}/arrays")
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("p", T.StructType([T.StructField("k", T.LongType())])), T.StructField("odd", T.StringType())])
    return readers.read_records(spark, f"{folder}/*", kind).select("id", "user_id", "type", F.col("p.k").alias("k"), "odd")


@query("SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || 'T00:00:00.000Z' AS at FROM orders")
def utc_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.to_utc_date(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("2024-01-01").cast("timestamp")).alias("at"))


@query(f"WITH {views.LISTINGS_SQL} SELECT count(*) AS total, count(*) FILTER (c) AS by_company, count(*) FILTER (NOT c AND t) AS by_title, count(*) FILTER (NOT c AND NOT t) AS kept FROM (SELECT lower(company) LIKE '%brand#1%' AS c, lower(title) LIKE '%red%' OR lower(title) LIKE '%ring%' AS t FROM listings)")
def filter_passes(spark, sf_dir):
    return filters.filter_passes(views.listings(spark, sf_dir), ["Brand#1"], ["Red", "RING"])[1]


@query("WITH last AS (SELECT *, event_id % 50 AS tokens FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000) SELECT count(*) AS requests, floor(10000.0 * count(*) FILTER (event_type <> 'error') / count(*) + 0.5) / 100 AS success_rate, floor(avg(value) * 10000 + 0.5) / 10000 AS mean_duration, CAST(sum(tokens) AS BIGINT) AS tokens, avg(tokens) AS mean_tokens FROM last")
def last_call_metrics(spark, sf_dir):
    calls = views.calls(spark, sf_dir).select("ts", "event_id", "ok", F.col("value").alias("duration"), (F.col("event_id") % 50).alias("tokens"))
    got = stats.call_metrics(calls, "ts", "event_id")
    return got.withColumn("success_rate", numbers.half_up(F.col("success_rate"), 2)).withColumn("mean_duration", numbers.half_up(F.col("mean_duration"), 4))


@query("SELECT CASE event_id % 4 WHEN 0 THEN 'cleaned' WHEN 1 THEN 'trailing_comma' WHEN 2 THEN 'balanced' ELSE 'direct' END AS way, 'unknown' AS kind, count(*) AS attempts, floor(avg(value) * 10000 + 0.5) / 10000 AS mean_duration FROM events GROUP BY 1")
def parse_metrics(spark, sf_dir):
    rows = _damaged(spark, sf_dir).select(repair_json(F.col("damaged"))["way"].alias("way"), text.parse_error_kind(F.col("event_type")).alias("kind"), F.col("value").alias("duration"))
    return stats.parse_metrics(rows).withColumn("mean_duration", numbers.half_up(F.col("mean_duration"), 4))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(x, 'network|connection|timeout') THEN 'network' WHEN regexp_matches(x, 'parsing|json|format') THEN 'parsing' WHEN regexp_matches(x, 'validation|invalid') THEN 'validation' WHEN regexp_matches(x, 'api|rate|limit') THEN 'api' WHEN regexp_matches(x, 'file|disk|io') THEN 'file' ELSE 'other' END AS category FROM (SELECT *, lower(text) AS x FROM conversations)")
def error_details(spark, sf_dir):
    return stats.categorised(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "category")


@query("SELECT c_custkey, sha256(c_name) AS hashed FROM customer")
def hash_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", security.hash_key(F.col("c_name")).alias("hashed"))


@query("SELECT doc_id, array_to_string(list_concat(list_slice(regexp_extract_all(text, '(?i)(?:api[_-]?key|secret|token)[ \\t\\n\\x0B\\f\\r]*[:=][ \\t\\n\\x0B\\f\\r]*[\"'']?[a-zA-Z0-9_-]{10,}[\"'']?'), 1, 3), list_slice(regexp_extract_all(text, '(?i)(?:sk-|pk-)[a-zA-Z0-9_-]{20,}'), 1, 3)), ' ') AS found FROM documents")
def keys_in_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(security.keys_in(F.col("text")), " ").alias("found"))


@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN length(trim(c_mktsegment)) = 0 THEN 'model is required' END, CASE WHEN NOT regexp_matches(c_name, '^[A-Za-z][A-Za-z0-9+.-]*:[^ ]+$') THEN 'baseUrl is not a URL' END, CASE WHEN NOT c_acctbal / 1000 BETWEEN 0 AND 2 THEN 'temperature is out of range' END, CASE WHEN c_nationkey <= 0 OR c_nationkey > 32000 THEN 'maxTokens is out of range' END], lambda x: x IS NOT NULL), '; ') AS errors FROM customer")
def validate_providers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_name").alias("baseUrl"), F.col("c_name").alias("apiKey"), F.col("c_mktsegment").alias("model"), (F.col("c_acctbal") / 1000).alias("temperature"), F.lit(1.0).alias("topP"), F.col("c_nationkey").alias("maxTokens"), F.lit(300000).alias("timeout"))
    return rows.select("c_custkey", F.array_join(validation.errors(validation.provider_rules()), "; ").alias("errors"))


@query("SELECT c_custkey, CASE WHEN length(k) < 10 OR length(k) > 100 THEN 'key length is out of range' WHEN contains(lower(k), 'test_') OR contains(lower(k), 'demo') THEN 'key seems to be a test key' END AS problem FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Test_' || c_name WHEN 1 THEN left(c_name, 9) WHEN 2 THEN repeat(c_name, 6) ELSE c_name END AS k FROM customer)")
def key_problems(spark, sf_dir):
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    key = F.when(k == 0, F.concat(F.lit("Test_"), n)).when(k == 1, F.substring(n, 1, 9)).when(k == 2, F.repeat(n, F.lit(6))).otherwise(n)
    return table(spark, sf_dir, "customer").select("c_custkey", guards.key_problem(key).alias("problem"))


@query("SELECT page_id, trim(regexp_replace(replace(path, '../', ''), '/+', '/', 'g'), '/') AS path FROM (SELECT page_id, '/../' || regexp_replace(url, '^[a-z]+:', 'x') || '/../y//' AS path FROM pages)")
def inner_paths(spark, sf_dir):
    path = F.concat(F.lit("/../"), F.regexp_replace("url", "^[a-z]+:", "x"), F.lit("/../y//"))
    plain = guards.inner_path(path)
    return table(spark, sf_dir, "pages").select("page_id", guards.insisted(plain, F.when(plain.contains(".."), "path leaves its root")).alias("path"))


@query(r"SELECT doc_id, left(regexp_replace(text, '[<>\x00-\x1F\x7F]', '', 'g'), 1000) AS text, regexp_matches(text, '^[^\s@]+@[^\s@]+\.[^\s@]+$') AS address FROM documents")
def sanitized_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", guards.sanitized(F.col("text")).alias("text"), guards.is_address(F.col("text")).alias("address"))


@query("SELECT event_id, event_id % 2 = 0 AS iso FROM events")
def iso_instants(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", guards.is_iso_instant(at).alias("iso"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def audit_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "type").withColumn("level", F.when(F.col("type") == "error", "high").otherwise("low"))
    return filters.audit_log(rows, kind="error", level="high").select("event_id", "user_id")


@query("SELECT page_id, url FROM pages WHERE html IS NOT NULL")
def read_details(spark, sf_dir):
    return filters.has_details(table(spark, sf_dir, "pages"), "html").select("page_id", "url")


@query("WITH t AS (SELECT p_name, row_number() OVER (ORDER BY first) - 1 AS pos FROM (SELECT p_name, min(p_partkey) AS first FROM part GROUP BY p_name)) SELECT CAST(pos // 20 AS BIGINT) AS batch, string_agg((pos % 20 + 1) || '. ' || p_name, chr(10) ORDER BY pos) AS text FROM t GROUP BY 1")
def numbered_titles(spark, sf_dir):
    return batching.numbered_text(verdicts.distinct_titles(table(spark, sf_dir, "part"), F.col("p_partkey"), "p_name"), "first", "p_name", 20)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 0")
def legacy_answers(spark, sf_dir):
    """Answers wrapped in results with thoughts before them; every third is no such answer and gives none."""
    e = table(spark, sf_dir, "events")
    answer = F.when(F.col("event_id") % 3 == 0, F.lit("sorry")).otherwise(F.concat(F.lit("<thought>a\nb</thought>\n{\"results\": ["), "props", F.lit("]}")))
    return e.select("event_id", F.explode(text.answer_results(answer, "struct<k:bigint>")).alias("r")).select("event_id", "r.k")


@query("SELECT p_partkey, '- [' || p_name || ' at ' || p_brand || '](x/' || p_partkey || ')' AS link FROM part")
def report_links(spark, sf_dir):
    return report.link_list(table(spark, sf_dir, "part"), F.col("p_name"), F.col("p_brand"), F.concat(F.lit("x/"), "p_partkey"), "p_partkey")


@query(
    "WITH m AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events), l(place, metric) AS (VALUES " + ", ".join(f"({k}, '{label}')" for k, (_, label) in enumerate(report.SUMMARY_ROWS)) + ") "
    "SELECT CAST(place AS BIGINT) AS place, metric, CASE metric WHEN 'API Total Calls' THEN n::VARCHAR WHEN 'API Failed Calls' THEN bad::VARCHAR ELSE '0' END AS value FROM l, m "
    "UNION ALL SELECT CAST(34 AS BIGINT), 'Errors - ' || event_type, count(*)::VARCHAR FROM events GROUP BY event_type"
)
def summary_export(spark, sf_dir):
    e = views.calls(spark, sf_dir)
    errors = e.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"))
    return report.summary_rows(e.agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("calls_failed")), errors)


@query("SELECT doc_id, '\"' || replace(text, '\"', '\"\"') || '\",' || lang AS line FROM documents WHERE regexp_matches(text, '[\",\\r\\n]') UNION ALL SELECT doc_id, text || ',' || lang FROM documents WHERE NOT regexp_matches(text, '[\",\\r\\n]')")
def csv_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", report.csv_line("text", "lang").alias("line"))


@query("SELECT conv_id, turn, '# ' || role || ' in ' || conv_id AS prompt FROM conversations")
def render_templates(spark, sf_dir):
    prompt = templates.render("# {{role}} in {{conv_id}}", {"role": F.col("role"), "conv_id": F.col("conv_id")}, double=True)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


@query("SELECT conv_id, turn, role AS first, 'last' AS second FROM conversations")
def split_sections(spark, sf_dir):
    answer = F.concat(F.lit("lead\n# A\n"), "role", F.lit("\n# B\nfirst\n# B\nlast\n"))
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", templates.sections(answer).alias("s"))
    return s.select("conv_id", "turn", F.col("s")["A"].alias("first"), F.col("s")["B"].alias("second"))


@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN length(c_name) > 15 THEN 'title is too long' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' END, CASE WHEN c_acctbal < 0 THEN 'balance is out of range' END], lambda x: x IS NOT NULL), '; ') AS errors FROM customer")
def validate_customers(spark, sf_dir):
    rules = [("title is too long", F.length("c_name") <= 15), ("segment", F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), validation.range_rule("balance", 0, None)]
    rows = table(spark, sf_dir, "customer").withColumn("balance", F.col("c_acctbal"))
    return rows.select("c_custkey", F.array_join(validation.errors(rules), "; ").alias("errors"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT regexp_matches(p_brand, '^[a-zA-Z0-9\\s\\-_&.,]+$') THEN 'company contains invalid characters' END], lambda x: x IS NOT NULL), '; ') AS errors FROM part")
def validate_listings(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("location"), F.col("p_partkey").cast("string").alias("id"))
    return rows.select("p_partkey", F.array_join(validation.errors(validation.listing_rules(rows.columns)), "; ").alias("errors"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, trim(o_orderpriority) AS title, '2024-01-01' AS postedDate, 'unknown' AS source FROM orders")
def normalize_records(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("jobId"), F.lit("").alias("title"), F.concat(F.lit(" "), "o_orderpriority", F.lit("\t")).alias("jobTitle"))
    return norm.normalize(rows, "2024-01-01").select("id", "title", "postedDate", F.col("metadata.source").alias("source"))


@query("SELECT p_partkey, '## ' || p_name || ' at ' || p_brand || chr(10) || '- Compensation: Not specified' || chr(10) || '- Confidence: 60%' || chr(10) || '- Rationale: ' || p_type || chr(10) || '- Link: ' AS section FROM part")
def evaluation_report(spark, sf_dir):
    none = F.lit(None).cast("string")
    pay = numbers.compensation(none, F.lit(-1.0), F.lit(-1.0), none, F.lit(False))
    return report.evaluation_sections(table(spark, sf_dir, "part"), F.col("p_name"), F.col("p_brand"), pay, F.lit(0.6), F.col("p_type"), none, "p_partkey")


@query("WITH s AS (SELECT count(*) AS calls, floor(10000.0 * count(*) FILTER (event_type <> 'error') / count(*) + 0.5) / 100 AS ok FROM events) SELECT 'calls' AS metric, CAST(calls AS VARCHAR) AS value FROM s UNION ALL SELECT 'errors', CAST((SELECT count(*) FROM events WHERE event_type = 'error') AS VARCHAR)")
def stats_export(spark, sf_dir):
    return report.metric_rows(views.calls(spark, sf_dir).agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors")))


@query(f"WITH {views.PARTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY title, company, location ORDER BY ord) > 1 AS dup, {EXCLUDED_SQL} AS bad FROM parts) SELECT count(DISTINCT location) AS files, count(*) AS merged, count(*) FILTER (dup) AS duplicates, count(*) FILTER (bad AND NOT dup) AS filtered, count(*) FILTER (NOT bad AND NOT dup) AS left FROM n")
def pipeline_counts(spark, sf_dir):
    """Files (here locations), merged rows, duplicates, filtered rows and rows left."""
    rows = views.parts(spark, sf_dir)
    firsts = similarity.members(rows, "ord", ("title", "company", "location", "url")).withColumnRenamed("ord", "o")
    joined = rows.join(firsts, F.col("ord") == F.col("o"))
    bad = filters.excluded(F.col("company"), F.col("title"), COMPANIES, TITLES)
    return joined.agg(*stats.pipeline_counts(F.col("location"), F.col("ord"), F.col("ord") != F.col("member_of"), bad))


@query(f"WITH {views.LISTINGS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, postedDate FROM listings ORDER BY postedDate, 1, 2, 3, 4")
def sort_listings(spark, sf_dir):
    return views.listings(spark, sf_dir).select(*views.ORDER, "postedDate").orderBy(F.col("postedDate").asc_nulls_last(), *views.ORDER)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return dedup.first_per_key(rows, [F.col("user_id"), F.col("event_type")], F.struct("ts", "event_id")).select("event_id", "user_id")


@query()
def rate_limit(spark, sf_dir):
    return replay(views.calls(spark, sf_dir), lambda: RateLimiter(3, 86_400_000), "user_id")


@query()
def circuit_breaker(spark, sf_dir):
    return replay(views.calls(spark, sf_dir), lambda: Breaker(threshold=2, reset_ms=43_200_000, closes=3), "user_id")


@query()
def circuit_breaker_by_rate(spark, sf_dir):
    return replay(views.calls(spark, sf_dir), lambda: Breaker(share=0.5, reset_ms=43_200_000), "user_id")


_SCAN = """numbered AS (SELECT *, lower(title) || '::' || lower(company) AS pair, row_number() OVER (ORDER BY ord) AS n FROM {0}),
walk(n, ids, pairs, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT) UNION ALL
  SELECT p.n, CASE WHEN list_contains(w.ids, p.id) OR list_contains(w.pairs, p.pair) THEN w.ids ELSE list_append(w.ids, p.id) END,
    CASE WHEN list_contains(w.ids, p.id) OR list_contains(w.pairs, p.pair) THEN w.pairs ELSE list_append(w.pairs, p.pair) END,
    CASE WHEN list_contains(w.ids, p.id) OR list_contains(w.pairs, p.pair) THEN NULL ELSE p.ord END FROM walk w JOIN numbered p ON p.n = w.n + 1)"""
_SOME_SEEN = "(SELECT 1 FROM registry r WHERE lower(r.company) = lower(l.company) AND lower(r.title) = lower(l.title) AND CAST(r.listingId AS BIGINT) % 50 = 0)"


@query(f"WITH RECURSIVE {views.PARTS_SQL}, {views.REGISTRY_SQL}, live AS (SELECT * FROM parts l WHERE NOT {EXCLUDED_SQL} AND NOT EXISTS {_SOME_SEEN}), {_SCAN.format('live')} SELECT ord, id, title, company FROM walk JOIN parts ON kept = ord")
def refine_pipeline(spark, sf_dir):
    """The whole refine stage: filters, registry and the two-key scan."""
    seen = views.registry(spark, sf_dir).where("cast(listingId as bigint) % 50 = 0")
    kept, _ = pipelines.refine(views.parts(spark, sf_dir), "ord", COMPANIES, TITLES, seen)
    return kept.select("ord", "id", "title", "company")


@query(f"WITH RECURSIVE {views.PARTS_SQL}, {_SCAN.format('parts')} SELECT ord, id, title, company FROM walk JOIN parts ON kept = ord WHERE NOT {EXCLUDED_SQL}")
def refine_sorted(spark, sf_dir):
    """The older way: scan, then filters."""
    return pipelines.refine_sorted(views.parts(spark, sf_dir), "ord", COMPANIES, TITLES).select("ord", "id", "title", "company")


@query("SELECT doc_id, CAST(0.5 AS DOUBLE) AS confidence FROM documents WHERE length(text) >= 1000")
def prefilter_pipeline(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title"), F.col("source").alias("url"))
    longer = F.struct((F.length("title") >= 1000).alias("isVeryHighlyAligned"), F.lit(0.5).alias("confidence"))
    return pipelines.prefilter(rows, lambda df: df.withColumn("verdict", longer), F.col("doc_id")).select("doc_id", "confidence")


_JUDGED = f"""WITH parts AS (SELECT p_partkey AS ord, CASE p_size % 5 WHEN 0 THEN 'Security engineer ' ELSE '' END || p_name AS title, p_brand AS company, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END AS descriptionText FROM part), {views.REGISTRY_SQL},
flagged AS (SELECT l.*, EXISTS (SELECT 1 FROM registry r WHERE lower(r.company) = lower(l.company) AND lower(r.title) = lower(l.title) AND CAST(50 AS BIGINT) * 86400000 - r.admitTime < CAST(30 AS BIGINT) * 86400000) AS seen FROM parts l),
firsts AS (SELECT lower(title) AS t, company AS c, min(ord) AS o FROM flagged WHERE NOT seen GROUP BY 1, 2)
SELECT ord, CASE WHEN seen OR ord <> o THEN 'dupe' WHEN length(descriptionText) = 0 THEN 'no_description' WHEN contains(title, 'engineer') THEN 'pass' ELSE 'fail' END AS route
FROM flagged LEFT JOIN firsts ON lower(title) = t AND company = c"""


@query(_JUDGED)
def judge_pipeline(spark, sf_dir):
    """Parts as listings of which every fifth is for engineers, judged by keywords, all four routes taken."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("ord"), F.concat(F.when(F.col("p_size") % 5 == 0, "Security engineer ").otherwise(""), "p_name").alias("title"), F.col("p_brand").alias("company"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_type")).alias("descriptionText"))
    return pipelines.judge(rows, views.registry(spark, sf_dir), keyword_scorer(), F.col("ord"), NOW).select("ord", "route")
