"""The catalog operators as queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.functions import paths
from assetloom.functions.paths import basename, spaced, stem
from assetloom.functions.predicates import all_of, any_of, contains_text, direct_child, dominant_in, flag_is, in_range, one_of
from assetloom.functions.textures import channels, texture_kind
from assetloom.operators import documents as docs_
from assetloom.operators import files, graph, hierarchy, integrity, scene, show, similarity, textures
from assetloom.plans.query import FLAGS, RANGES, AssetQuery
from assetloom.schema import ASSET_FIELDS, ATTRIBUTE_PREFIX, MASTER
from assetloom.sources import catalog, layers
from assetloom.sources.shared import dealt, join_large

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts, dealt before they become texts and listings: their file is small and may be one task's."""
    return dealt(table(spark, sf, "part"), "p_partkey")


def geography(spark: SparkSession, sf: str) -> DataFrame:
    """Customers below nations below regions: (uid, l1, l2, l3)."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.select(F.col("c_custkey").alias("uid"), F.col("r_name").alias("l1"), F.col("n_name").alias("l2"), F.col("c_mktsegment").alias("l3"))


def joined(array) -> F.Column:
    return F.concat_ws("|", array)


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.03 AND 0.07 AND l_extendedprice BETWEEN 1000 AND 30000""")
def range_filter(spark, sf):
    wanted = [in_range(F.col("l_quantity"), (10, 20)), in_range(F.col("l_discount"), (0.03, 0.07)), in_range(F.col("l_extendedprice"), (1000, 30000))]
    return table(spark, sf, "lineitem").where(all_of(wanted)).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic = 1, false) = false")
def bool_missing_false(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.where(flag_is(F.col("toxic") == 1, False)).select("doc_id", "lang")


@query("SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['red', 'gear'])")
def list_any_match(spark, sf):
    return table(spark, sf, "part").where(any_of(F.split("p_name", " "), ["Red", "gear"])).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE lower(string_split(p_name, ' ')[1]) IN ('red', 'hot')")
def dominant_match(spark, sf):
    return table(spark, sf, "part").where(dominant_in(F.split("p_name", " "), ["RED", "hot"])).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high')")
def exact_match_ci(spark, sf):
    return table(spark, sf, "orders").where(one_of(F.col("o_orderpriority"), ["1-urgent", "2-HIGH"])).select("o_orderkey", "o_orderpriority")


@query("""SELECT DISTINCT c_custkey AS uid FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE lower(r_name) IN ('asia', 'nation_3', 'building') OR lower(n_name) IN ('asia', 'nation_3', 'building') OR lower(c_mktsegment) IN ('asia', 'nation_3', 'building')""")
def category_any_level(spark, sf):
    return hierarchy.in_categories(geography(spark, sf), ["asia", "NATION_3", "building"])


@query("SELECT r_name AS name, string_agg(n_name, '|' ORDER BY n_nationkey) AS members, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def hierarchy_group(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    bridge = nations.select(F.col("r_name").alias("l1"), F.col("n_nationkey").alias("category_pos"), F.lit(0).alias("pos"), F.col("n_name").alias("uid"))
    return hierarchy.by_level(bridge, 1).select("name", joined("uids").alias("members"), F.size("uids").cast("long").alias("n"))


@query("""SELECT r_name AS l1, n_name AS l2, CAST(grouping_id(r_name, n_name) AS BIGINT) AS level, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def hierarchy_rollup(spark, sf):
    return hierarchy.distribution(geography(spark, sf), "l1", "l2")


@query("SELECT c_mktsegment AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def class_counts(spark, sf):
    return hierarchy.counts(geography(spark, sf), 3)


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS BIGINT) AS pos, l_partkey
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def catalog_flatten(spark, sf):
    lines = dealt(table(spark, sf, "lineitem"), "l_orderkey", most=500_000)
    lines = join_large(lines, table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return hierarchy.places(lines, "l_orderkey", "l_linenumber", "l_partkey").select(F.col("l_orderkey").alias("o_orderkey"), "pos", "l_partkey")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("SELECT name FROM (VALUES ('NATION_1'), ('ATLANTIS'), ('nation_2'), ('NATION_24'), ('MU')) AS t(name) EXCEPT SELECT n_name FROM nation")
def unknown_names(spark, sf):
    wanted = spark.createDataFrame([("NATION_1",), ("ATLANTIS",), ("nation_2",), ("NATION_24",), ("MU",)], "name string")
    return hierarchy.unknown_names(wanted, table(spark, sf, "nation").select(F.col("n_name").alias("name")))


@query("SELECT count(*) FILTER (WHERE contains(lower(p_name), 'red w')) AS visible, count(*) AS total FROM part")
def substring_search(spark, sf):
    return hierarchy.search(table(spark, sf, "part"), contains_text(F.col("p_name"), "  Red W "))


def vector(spark, sf, number):
    """One row's vector, as a literal for the scan of all others."""
    return table(spark, sf, "embeddings").where(F.col("vec_id") == number).select("embedding").first()[0]


_COSINE = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {}))"


@query(f"SELECT vec_id, round({_COSINE.format(0)}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def dense_topk(spark, sf):
    return similarity.nearest(table(spark, sf, "embeddings"), vector(spark, sf, 0), 10, key="vec_id")


@query(f"SELECT vec_id, round(({_COSINE.format(0)} + {_COSINE.format(1)}) / 2, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def dual_score_topk(spark, sf):
    scored = table(spark, sf, "embeddings").select("vec_id", similarity.dense_scores(None, [vector(spark, sf, 0), vector(spark, sf, 1)]).alias("score"))
    return similarity.top_k(scored, 10, key="vec_id")


@query(f"SELECT vec_id, label, round({_COSINE.format(0)}, 6) AS score FROM embeddings WHERE label BETWEEN 2 AND 5 ORDER BY score DESC, vec_id LIMIT 10")
def filtered_topk(spark, sf):
    rows = table(spark, sf, "embeddings").where(in_range(F.col("label"), (2, 5)))
    return similarity.top_k(rows.select("vec_id", "label", similarity.dense_scores(rows, [vector(spark, sf, 0)]).alias("score")), 10, key="vec_id")


@query("""WITH t AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+')) AS term FROM part),
f AS (SELECT p_partkey, term, count(*) AS n FROM t WHERE term <> '' GROUP BY ALL),
s AS (SELECT p_partkey, sum(n * CASE term WHEN 'red' THEN 2 WHEN 'widget' THEN 1 WHEN 'economy' THEN 1 ELSE 0 END) AS d, sqrt(sum(CAST(n * n AS DOUBLE))) AS l FROM f GROUP BY p_partkey)
SELECT p_partkey, round(d / (l * sqrt(6.0::DOUBLE)), 6) AS score FROM s ORDER BY score DESC, p_partkey LIMIT 10""")
def tf_topk(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    scored = similarity.text_scores(parts, "red Widget, red economy", "p_partkey", F.concat_ws(" ", "p_name", "p_type"))
    return similarity.clamped_top_k(scored, 10, key="p_partkey")


@query("SELECT DISTINCT p_type AS name FROM part ORDER BY name")
def names_sorted(spark, sf):
    return files.names(table(spark, sf, "part").select(F.col("p_type").alias("name")))


def order_files(spark, sf):
    """Orders as files of customers: (uid, asset_type, path); the type is the status."""
    kind = F.when(F.col("o_orderstatus") == "P", "glb").when(F.col("o_orderstatus") == "F", "thumbnail").otherwise("render")
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("uid"), kind.alias("asset_type")).agg(F.min("o_orderkey").alias("first"))
    return rows.select("uid", "asset_type", F.concat(F.lit("order/"), F.col("first").cast("string")).alias("path"))


@query("SELECT o_custkey AS uid, 'order/' || min(o_orderkey) AS path FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def path_resolve(spark, sf):
    return files.resolve(table(spark, sf, "customer").select(F.col("c_custkey").alias("uid")), order_files(spark, sf), "glb")


@query("""WITH f AS (SELECT o_custkey AS uid, o_orderstatus AS s, min(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT c_custkey AS uid, max(CASE WHEN s = 'P' AND k % 2 = 0 THEN 'order/' || k END) AS glb, max(CASE WHEN s = 'F' AND k % 2 = 0 THEN 'order/' || k END) AS thumbnail
FROM customer LEFT JOIN f ON uid = c_custkey GROUP BY c_custkey""")
def load_wide(spark, sf):
    there = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"))
    return files.load(table(spark, sf, "customer").select(F.col("c_custkey").alias("uid")), order_files(spark, sf), there, ["glb", "thumbnail"])


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT DISTINCT user_id, event_type FROM events WHERE value < 1)
SELECT user_id AS uid, string_agg(CASE WHEN e.event_type IS NULL THEN a.angle || '=' ELSE a.angle || '=' || user_id || '/render_' || a.angle || '.0.jpg' END, '|' ORDER BY a.angle) AS renders
FROM u CROSS JOIN (VALUES (0, 'view'), (90, 'click'), (180, 'error'), (270, 'signup')) AS a(angle, event_type) LEFT JOIN e USING (user_id, event_type) GROUP BY user_id""")
def render_pivot(spark, sf):
    events = table(spark, sf, "events")
    kinds = spark.createDataFrame([(0, "view"), (90, "click"), (180, "error"), (270, "signup")], "angle int, event_type string")
    user = F.col("user_id").cast("string")
    there = events.where("value < 1").select("user_id", "event_type").distinct().join(F.broadcast(kinds), "event_type")
    there = there.select(F.concat(user, F.lit("/render_"), F.col("angle").cast("string"), F.lit(".0.jpg")).alias("path"))
    users = events.select(F.col("user_id").alias("uid")).distinct()
    found = files.renders(users, users.select("uid", F.col("uid").cast("string").alias("folder")), there)
    return found.select("uid", joined(F.transform(F.map_entries("renders"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.coalesce(e["value"], F.lit(""))))).alias("renders"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def wanted_missing(spark, sf):
    from assetloom.sources.transfer import missing

    return missing(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("""SELECT d.doc_id, coalesce(a.quality, b.quality + 10) AS quality FROM documents d
LEFT JOIN labels a ON d.doc_id = a.doc_id AND a.toxic = 1 LEFT JOIN labels b ON d.doc_id = b.doc_id""")
def precedence_merge(spark, sf):
    labels = table(spark, sf, "labels")
    return files.precedence(table(spark, sf, "documents"), labels.where("toxic = 1"), labels.withColumn("quality", F.col("quality") + 10), "doc_id", "quality")


@query("""WITH p AS (SELECT page_id, string_split(regexp_extract(url, '([^/]*)$', 1), '.')[1] AS name FROM pages)
SELECT name, count(*) AS n, min(page_id) AS first_page, string_agg(CAST(page_id AS VARCHAR), '|' ORDER BY page_id) AS pages FROM p GROUP BY name""")
def file_map(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", stem(basename(F.col("url"))).alias("name"))
    grouped = pages.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"), F.sort_array(F.collect_list("page_id")).alias("ids"))
    return grouped.select("name", "n", "first_page", joined(F.transform("ids", lambda i: i.cast("string"))).alias("pages"))


@query("""SELECT o_custkey, arg_min(o_orderkey, (CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END) * 1000000000 + o_orderkey) AS chosen FROM orders GROUP BY o_custkey""")
def prefer_extension(spark, sf):
    path = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(".mdl")).otherwise(F.lit(".txt")))
    grouped = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(path)).alias("paths"))
    return grouped.select("o_custkey", F.substring(files.preferred(F.col("paths"), ".mdl"), 1, 12).cast("long").alias("chosen"))


@query("SELECT CAST(floor((r - 1) / 256) AS BIGINT) AS batch, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) GROUP BY 1")
def batch_256(spark, sf):
    from assetloom.sources.catalog import numbered

    rows = numbered(table(spark, sf, "documents").select("doc_id"), "doc_id").withColumn("batch", F.floor(F.col("pos") / 256).cast("long"))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("""WITH n AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS number, count(*) OVER () AS total FROM documents)
SELECT doc_id, lang, number, total, number > 1 AS has_previous, number < total AS has_next FROM n WHERE number = least(300 + 1, total)""")
def page_nav(spark, sf):
    return files.page(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 300)


@query("SELECT lang, count(*) AS expected, count(l.doc_id) AS present, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (lang)")
def integrity_report(spark, sf):
    return integrity.counted(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id", "lang")


def _expected(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.lit("object").alias("kind"), F.col("lang").alias("subkind"), F.col("doc_id").cast("string").alias("item"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))


@query("SELECT 'object' AS kind, lang AS subkind, CAST(doc_id AS VARCHAR) AS item, 'doc/' || doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def repair_plan(spark, sf):
    there = table(spark, sf, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))
    return integrity.repair_plan(_expected(spark, sf), there)


@query("""SELECT kind, subkind, sum(n)::BIGINT AS expected, sum(p)::BIGINT AS present, sum(n - p)::BIGINT AS missing FROM (SELECT 'object' AS kind, lang AS subkind, 1 AS n, (doc_id IN (SELECT doc_id FROM labels))::INT AS p FROM documents) GROUP BY ROLLUP (kind, subkind)""")
def integrity_totals(spark, sf):
    there = table(spark, sf, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))
    return integrity.report(integrity.status(_expected(spark, sf), there))


@query("""WITH r AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS refs FROM pages),
p AS (SELECT page_id, unnest(refs) AS ref, unnest(range(len(refs))) AS pos FROM r)
SELECT page_id AS name, CAST(min(pos) AS BIGINT) AS pos, ref FROM p GROUP BY page_id, ref""")
def regex_refs(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("name"), F.col("html").alias("value"))
    return textures.references(pages, pattern=r'href="([^"]+)"')


def _part_texture():
    suffix = F.element_at(F.array(*map(F.lit, ["diff", "rough", "ORM", "multi_rough_ao", "mask", "other", "Norm_2k", "platform"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    return F.concat(F.lit("textures/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), suffix, F.lit(".png"))


@query("""WITH t AS (SELECT p_brand, p_partkey, CASE p_partkey % 8 WHEN 0 THEN ['diffuse'] WHEN 1 THEN ['roughness'] WHEN 2 THEN ['roughness', 'ao'] WHEN 3 THEN ['ao'] WHEN 6 THEN ['normal'] WHEN 7 THEN ['roughness', 'ao'] ELSE [] END AS c FROM part),
u AS (SELECT p_brand, p_partkey, unnest(c) AS channel FROM t)
SELECT p_brand, channel, min(p_partkey) AS first_part, count(*) AS n FROM u GROUP BY ALL""")
def classify_refs(spark, sf):
    ref = _part_texture()
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", F.explode(channels(texture_kind(ref), ref)).alias("channel"))
    return rows.groupBy("p_brand", "channel").agg(F.min("p_partkey").alias("first_part"), F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT p_brand, p_partkey, 'm/textures/' || replace(p_name, ' ', '_') || '_' || ['diff', 'rough', 'ORM', 'multi_rough_ao', 'mask', 'other', 'Norm_2k', 'platform'][p_partkey % 8 + 1] || '.png' AS path,
CASE p_partkey % 8 WHEN 0 THEN ['diffuse'] WHEN 1 THEN ['roughness'] WHEN 2 THEN ['roughness', 'ao'] WHEN 3 THEN ['ao'] WHEN 6 THEN ['normal'] WHEN 7 THEN ['roughness', 'ao'] ELSE [] END AS c FROM part),
u AS (SELECT p_brand, min(p_partkey) AS k, path, any_value(c) AS c FROM t WHERE path IN (SELECT path FROM t WHERE p_partkey % 3 = 0) GROUP BY p_brand, path),
v AS (SELECT p_brand, channel, arg_min(path, k) AS path FROM (SELECT p_brand, k, path, unnest(c) AS channel FROM u) GROUP BY ALL),
j AS (SELECT p_brand, '{' || string_agg('"' || channel || '":"http://localhost/' || path || '"', ',' ORDER BY channel) || '}' AS textures FROM v GROUP BY p_brand)
SELECT DISTINCT p.p_brand AS name, coalesce(textures, '{}') AS textures FROM part p LEFT JOIN j ON j.p_brand = p.p_brand""")
def texture_channels(spark, sf):
    """The channels of each brand, by the first part's texture that is there."""
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("pos"), _part_texture().alias("ref"))
    there = parts.where("pos % 3 = 0").select(F.concat(F.lit("m/"), "ref").alias("path"))
    found = textures.fed_channels(parts, parts.select("name"), there, "m", "http://localhost")
    return found.select("name", F.to_json("textures").alias("textures"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).alias("k"))


@query("SELECT event_id AS uid, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def annotation_leaves(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("uid"), F.col("props").alias("annotation"))
    return docs_.annotation_rows(rows)


@query("""WITH u AS (SELECT user_id, min(props) AS annotation FROM events GROUP BY user_id), e AS (SELECT DISTINCT user_id, event_type FROM events WHERE value < 1),
r AS (SELECT user_id, '{' || string_agg('"' || angle || '":' || CASE WHEN e.event_type IS NULL THEN 'null' ELSE '"http://localhost/' || user_id || '/render_' || angle || '.0.jpg"' END, ',' ORDER BY angle) || '}' AS renders
FROM u CROSS JOIN (VALUES (0, 'view'), (90, 'click'), (180, 'error'), (270, 'signup')) AS a(angle, event_type) LEFT JOIN e USING (user_id, event_type) GROUP BY user_id),
o AS (SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS p, min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey)
SELECT row_number() OVER (ORDER BY user_id) - 1 AS pos, '{"uid":' || user_id || ',"annotation":' || to_json(annotation) || ',"glb_url":' || CASE WHEN p % 2 = 0 THEN '"http://localhost/order/' || p || '"' ELSE 'null' END
|| ',"thumbnail_url":' || CASE WHEN f % 2 = 0 THEN '"http://localhost/order/' || f || '"' ELSE 'null' END || ',"render_urls":' || renders || '}' AS item
FROM u JOIN r USING (user_id) JOIN customer ON c_custkey = user_id LEFT JOIN o ON o_custkey = user_id""")
def viewer_document(spark, sf):
    """Annotations and renders of users, files of the customers of the same number: an item for each, in order."""
    events = table(spark, sf, "events")
    kinds = spark.createDataFrame([(0, "view"), (90, "click"), (180, "error"), (270, "signup")], "angle int, event_type string")
    there = events.where("value < 1").select("user_id", "event_type").distinct().join(F.broadcast(kinds), "event_type")
    there = there.select(F.concat(F.col("user_id").cast("string"), F.lit("/render_"), F.col("angle").cast("string"), F.lit(".0.jpg")).alias("path"))
    files_there = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"))
    users = events.groupBy(F.col("user_id").alias("uid")).agg(F.min("props").alias("annotation"))
    asked = users.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("uid")), "uid", "left_semi")
    return show.assets(asked, order_files(spark, sf), files_there.unionAll(there), "http://localhost", "show", users, users.select("uid", F.col("uid").cast("string").alias("folder")))


@query("""WITH a AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'float2' WHEN 1 THEN 'int' WHEN 2 THEN 'string' ELSE 'float2' END AS type,
p_retailprice AS x, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE 950.5 END AS y FROM part)
SELECT p_partkey, CASE WHEN type = 'int' THEN 'float2' ELSE type END AS new_type,
CASE WHEN type = 'string' THEN x ELSE 950.5 END AS new_x, CASE WHEN type = 'string' THEN y ELSE 950.5 END::DOUBLE AS new_y,
CASE WHEN type = 'int' THEN true WHEN type = 'string' THEN false ELSE NOT (abs(x - 950.5) < 1e-9 AND abs(coalesce(y, x) - 950.5) < 1e-9) END AS changed FROM a""")
def vec2_patch(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ["float2", "int", "string", "float2"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", F.lit("l").alias("layer"), F.lit("p").alias("prim"), kind.alias("type"), F.col("p_retailprice").alias("x"), F.when(F.col("p_partkey") % 4 != 3, F.lit(950.5)).alias("y"))
    return scene.patch(rows, override=950.5).select("p_partkey", "new_type", "new_x", "new_y", "changed")


@query("""SELECT p_brand AS layer, count(*) FILTER (WHERE p_size % 3 = 0 OR abs(p_retailprice * 2 - p_retailprice) >= 1e-9) AS fixes FROM part GROUP BY ROLLUP (p_brand)""")
def scene_fixes(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("layer"), F.lit("p").alias("prim"), F.when(F.col("p_size") % 3 == 0, "half").otherwise("float2").alias("type"), F.col("p_retailprice").alias("x"), F.col("p_retailprice").alias("y"))
    return scene.fixes(scene.patch(rows, scale=2.0))


def _tree(spark, sf):
    half = (F.col("p_partkey") / 2).cast("long")
    return table(spark, sf, "part").where("p_partkey >= 2").select(F.col("p_partkey").alias("child"), half.alias("parent"))


@query("""WITH RECURSIVE r(node, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN r ON p_partkey >= 2 AND p_partkey // 2 = node) SELECT node, depth FROM r""")
def reachability(spark, sf):
    tree = _tree(spark, sf)
    start = spark.createDataFrame([(1,)], "node long")
    return graph.reachable(start, tree.select(F.col("parent").alias("src"), F.col("child").alias("dst")))


@query("""WITH RECURSIVE a(node, depth) AS (SELECT unnest([5, 6]::BIGINT[]), 0 UNION ALL SELECT p_partkey, depth + 1 FROM part JOIN a ON p_partkey >= 2 AND p_partkey // 2 = node)
SELECT p.p_partkey AS layer, './n' || (p.p_partkey // 2) || '_new.usd' AS renamed FROM part p WHERE p.p_partkey >= 2 AND p.p_partkey IN (SELECT node FROM a) AND p.p_partkey // 2 IN (SELECT node FROM a)""")
def closure(spark, sf):
    tree = _tree(spark, sf)
    edges = tree.select(F.col("child").alias("src"), F.concat(F.lit("./n"), F.col("parent").cast("string"), F.lit(".usd")).alias("authored"), F.col("parent").alias("dst"))
    changed = graph.affected(spark.createDataFrame([(5,), (6,)], "node long"), edges)
    return graph.rewrites(edges, changed, "_new").select("layer", joined(F.map_values("renames")).alias("renamed"))


@query("SELECT event_type, count(*) FILTER (WHERE value >= 10) AS ok, count(*) FILTER (WHERE NOT coalesce(value >= 10, false)) AS failed FROM events GROUP BY event_type")
def batch_summary(spark, sf):
    return files.outcome(table(spark, sf, "events"), F.col("value") >= 10, ["event_type"])


@query("""WITH l AS (SELECT l_orderkey AS mesh, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem),
n AS (SELECT mesh, count(*) AS n FROM l GROUP BY mesh)
SELECT a.mesh, CAST(0 AS INTEGER) AS face, a.p AS a, b.p AS b, c.p AS c FROM l a JOIN l b ON a.mesh = b.mesh AND a.i = 0 AND b.i >= 1 JOIN l c ON c.mesh = b.mesh AND c.i = b.i + 1""")
def fan_triangles(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("mesh")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    return scene.triangles(lines.select("mesh", F.transform("lines", lambda x: x["l_partkey"]).alias("indices"), F.array(F.size("lines")).alias("counts")))


@query("""SELECT d.doc_id AS uid, CASE WHEN l.quality = 1 THEN 'existing' WHEN d.n_chars > 1000 THEN 'to_do' ELSE 'missing' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def conversion_plan(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.lit("g").alias("glb"), F.col("doc_id").cast("string").alias("usd"), (F.col("n_chars") > 1000).alias("glb_present"))
    done = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("path"))
    return files.conversion_plan(docs, done).select("uid", "status")


# ---- queries that run whole operators of the catalog over tables made of parts

_PARTS_SQL = """a AS (SELECT p_partkey AS uid, p_retailprice AS height, CAST(p_size AS DOUBLE) AS mass, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS movable,
string_split(p_name, ' ') AS materials, [p_type, p_brand] AS affordances, p_type AS surface_finish, p_brand AS l1, p_type AS l2, p_name AS l3 FROM part)"""


def part_assets(spark, sf):
    part = table(spark, sf, "part")
    movable = F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 3 == 1, False)
    return part.select(F.col("p_partkey").alias("uid"), F.col("p_retailprice").alias("height"), F.col("p_size").cast("double").alias("mass"), movable.alias("movable"), F.split("p_name", " ").alias("materials"), F.array("p_type", "p_brand").alias("affordances"), F.col("p_type").alias("surface_finish"))


def part_bridge(spark, sf):
    """Every asset twice in its category."""
    part = table(spark, sf, "part")
    twice = F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")
    return part.select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("l1"), F.col("p_type").alias("l2"), F.col("p_name").alias("l3"), F.col("p_size").alias("category_pos"), twice)


def part_vectors(spark, sf):
    """Of each asset the vector of its number, and as the long one that of the next (missing for the last)."""
    rows = table(spark, sf, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("uid"), F.col("embedding").alias("long"))
    return rows.select(F.col("vec_id").alias("uid"), F.col("embedding").alias("short")).join(after, "uid", "left")


_DOT = "list_inner_product({}::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3))"


@query(f"""WITH {_PARTS_SQL}, f AS (SELECT DISTINCT uid FROM a WHERE lower(l1) IN ('brand#2', 'economy', 'red widget') OR lower(l2) IN ('brand#2', 'economy', 'red widget') OR lower(l3) IN ('brand#2', 'economy', 'red widget'))
SELECT uid, round(({_DOT.format('s.embedding')} + coalesce({_DOT.format('n.embedding')}, 0)) / 2, 6) AS score FROM a SEMI JOIN f USING (uid) JOIN embeddings s ON s.vec_id = uid LEFT JOIN embeddings n ON n.vec_id = uid + 1
WHERE height BETWEEN 900 AND 1500 AND mass BETWEEN 5 AND 45 AND NOT coalesce(movable, false) AND list_has_any([lower(x) FOR x IN affordances], ['economy', 'promo', 'brand#2'])
ORDER BY score DESC, uid LIMIT 10""")
def asset_query(spark, sf):
    found = AssetQuery(part_bridge(spark, sf), part_assets(spark, sf), part_vectors(spark, sf)).in_categories(["BRAND#2", "economy", "Red Widget"])
    found = found.where(height_range=(900, 1500), mass_range=(5, 45), movable=False, affordances=["Economy", "promo", "brand#2"])
    return found.similar_to(vector(spark, sf, 3), 10).uids()


@query(f"WITH {_PARTS_SQL} SELECT uid FROM a, (VALUES (0), (1)) WHERE movable AND lower(materials[1]) IN ('red', 'small') AND lower(surface_finish) = 'economy'")
def asset_query_repeats(spark, sf):
    """Without categories the catalog's repeats are kept."""
    return AssetQuery(part_bridge(spark, sf), part_assets(spark, sf)).where(movable=True, dominant_materials=["Red", "small"], surface_finish=["ECONOMY"]).uids()


@query("SELECT p_partkey AS uid FROM part, (VALUES (0), (1))")
def catalog_order(spark, sf):
    return hierarchy.all_uids(part_bridge(spark, sf))


@query("SELECT p_partkey AS uid, p_retailprice AS height, p_partkey < 50 AS known FROM part WHERE p_partkey < 50 UNION ALL SELECT DISTINCT -1 - p_size, NULL, false FROM part WHERE p_size < 4")
def requested_annotations(spark, sf):
    """A request that names ids twice and ids that aren't there."""
    part = table(spark, sf, "part")
    wanted = part.where("p_partkey < 50").select(F.col("p_partkey").alias("uid")).unionAll(part.where("p_size < 4").select((-1 - F.col("p_size")).cast("long").alias("uid")))
    found = files.annotations(wanted.unionAll(wanted), part_assets(spark, sf))
    return found.select("uid", "height", F.col("height").isNotNull().alias("known"))


_NAME = "replace(p_name, ' ', '_') || '_' || p_partkey"
_MATERIAL_SQL = f"""p AS (SELECT {_NAME} AS name, p_partkey AS k FROM part WHERE p_partkey % 7 <> 6),
f AS (SELECT name, k, 'material_road_mdl/' || name || '.mdl' AS path, 1 AS main FROM p WHERE k % 3 < 2 UNION ALL SELECT name, k, 'material_road_mdl/' || name || '.hash', 1 FROM p WHERE k % 3 > 0
UNION ALL SELECT name, k, 'material_road_thumbnail/' || name || '.jpg', 0 FROM p WHERE k % 2 = 0 UNION ALL SELECT name, k, 'material_road_mdl/textures/' || name || '.png', 2 FROM p),
m AS (SELECT name, list_sort(list(path) FILTER (WHERE main = 1)) AS mains, max(path) FILTER (WHERE main = 0) AS thumbnail FROM f WHERE main < 2 GROUP BY name)"""


def material_files(spark, sf):
    """Paths of a road material for each part: main files, thumbnails, textures."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    k = F.col("k")
    rows = parts(spark, sf).where("p_partkey % 7 <> 6").select(name.alias("name"), F.col("p_partkey").alias("k"))
    path = lambda folder, end: F.concat(F.lit(folder + "/"), "name", F.lit(end))
    paths = F.array_compact(F.array(F.when(k % 3 < 2, path("material_road_mdl", ".mdl")), F.when(k % 3 > 0, path("material_road_mdl", ".hash")), F.when(k % 2 == 0, path("material_road_thumbnail", ".jpg")), path("material_road_mdl/textures", ".png")))
    return rows.select("k", F.explode(paths).alias("path"))


@query(f"WITH {_MATERIAL_SQL} SELECT name, array_to_string(mains, '|') AS mains, thumbnail FROM m")
def material_map(spark, sf):
    return files.material_map(material_files(spark, sf), "road").select("name", joined("main_files").alias("mains"), "thumbnail")


@query(f"""WITH {_MATERIAL_SQL}, w AS (SELECT * FROM m WHERE name LIKE '%red%')
SELECT DISTINCT path FROM (SELECT unnest(mains) AS path FROM w UNION ALL SELECT thumbnail FROM w WHERE thumbnail IS NOT NULL UNION ALL SELECT path FROM f WHERE main = 2)""")
def material_request(spark, sf):
    rows = material_files(spark, sf)
    mapping = files.material_map(rows, "road")
    return files.material_request(mapping, rows, "road", mapping.where("name like '%red%'"))


@query(f"""WITH {_MATERIAL_SQL}, there AS (SELECT path FROM f WHERE k % 5 <> 0)
SELECT name, CASE WHEN main IN (SELECT path FROM there) THEN main END AS main, CASE WHEN thumbnail IN (SELECT path FROM there) THEN thumbnail END AS thumbnail
FROM (SELECT name, thumbnail, coalesce(list_filter(mains, lambda x: x LIKE '%.mdl')[1], mains[1]) AS main FROM m)""")
def load_materials(spark, sf):
    rows = material_files(spark, sf)
    return files.load_materials(files.material_map(rows, "road"), rows.where("k % 5 <> 0"), "road")


def plant_files(spark, sf):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    return parts(spark, sf).select(F.col("p_partkey").alias("k"), name.alias("name"), F.concat(F.lit("collected_trees/"), name, F.lit(".tar.gz")).alias("path"))


def plant_parts(spark, sf):
    """Unpacked files of two plants of three; one of six has no scene file."""
    inside = F.array_compact(F.array(F.lit("/textures/x.png"), F.when(F.col("k") % 6 != 1, F.lit("/b.usd")), F.when(F.col("k") % 4 == 0, F.lit("/a.usdc"))))
    return plant_files(spark, sf).where("k % 3 < 2").select("name", F.explode(inside).alias("end")).select(F.concat(F.lit("collected_trees/"), "name", "end").alias("path"))


_PLANT_SQL = f"p AS (SELECT p_partkey AS k, {_NAME} AS name FROM part)"


@query(f"WITH {_PLANT_SQL} SELECT name, 'collected_trees/' || name || '.tar.gz' AS archive FROM p")
def vegetation_map(spark, sf):
    return files.vegetation_map(plant_files(spark, sf), "tree")


@query(f"""WITH {_PLANT_SQL} SELECT name, CASE WHEN k % 3 < 2 THEN 'collected_trees/' || name END AS folder,
CASE WHEN k % 3 < 2 THEN CASE WHEN k % 4 = 0 THEN 'collected_trees/' || name || '/a.usdc' WHEN k % 6 <> 1 THEN 'collected_trees/' || name || '/b.usd' END END AS usd FROM p""")
def load_vegetation(spark, sf):
    return files.load_vegetation(files.vegetation_map(plant_files(spark, sf), "tree"), plant_parts(spark, sf), "tree")


@query(f"WITH {_PLANT_SQL} SELECT name FROM p WHERE k % 4 <> 1")
def previews_to_make(spark, sf):
    plants = files.vegetation_map(plant_files(spark, sf), "tree")
    done = plant_files(spark, sf).where("k % 4 = 1").select(F.concat(F.lit("collected_trees/"), "name", F.lit("/_preview.glb")).alias("path"))
    return files.without_preview(plants, done, "tree").select("name")


@query("""SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE 'm/t/' || p_partkey || '_albedo.png' END AS diffuse, CASE WHEN p_partkey % 3 = 0 THEN 'm/t/' || p_partkey || '_n.png' END AS normal FROM part""")
def preview_textures(spark, sf):
    k = F.col("p_partkey").cast("string")
    line = lambda parameter, end: F.concat(F.lit(f"{parameter}: texture_2d(\"./t/"), k, F.lit(end + '"),\n'))
    texts = parts(spark, sf).select(F.col("p_partkey").alias("k"), F.concat(line("rough_map", "_r.png"), line("tex_a", "_albedo.png"), line("diffuse_texture", "_late.png"), line("normalmap", "_n.png")).alias("value"))
    path = lambda end: F.concat(F.lit("m/t/"), k, F.lit(end))
    there = parts(spark, sf).select(F.explode(F.array_compact(F.array(path("_r.png"), F.when(F.col("p_partkey") % 4 != 3, path("_albedo.png")), F.when(F.col("p_partkey") % 3 == 0, path("_n.png"))))).alias("path"))
    return textures.preview_textures(texts, there, "m", "k")


@query("""WITH t AS (SELECT o_custkey AS glb, min(o_orderkey) AS uid FROM orders GROUP BY o_custkey)
SELECT uid, CASE WHEN c_acctbal >= 0 THEN 'usd/' || uid END AS usd, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS error FROM customer JOIN t ON glb = c_custkey""")
def conversion_results(spark, sf):
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), F.concat(F.lit("usd/"), F.col("o_orderkey").cast("string")).alias("usd"), F.col("o_custkey").alias("glb"))
    results = table(spark, sf, "customer").select(F.col("c_custkey").alias("glb"), (F.col("c_acctbal") >= 0).alias("ok"), F.col("c_mktsegment").alias("error"))
    return files.conversion_results(tasks, results)


_TASKS_SQL = """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'glb/' || p_partkey END AS glb, 'assets_std_usd_flat/std_' || p_partkey || '/std_' || p_partkey || '.usd' AS usd, p_size, p_brand FROM part),
t AS (SELECT *, CASE WHEN glb IS NULL THEN 'missing' WHEN k % 3 = 0 THEN 'existing' ELSE 'to_do' END AS status FROM p)"""


def conversions(spark, sf):
    """(index, present): a model file for each part, four of five are there; one of three is converted."""
    k = F.col("p_partkey").cast("string")
    part = parts(spark, sf)
    index = part.select(F.col("p_partkey").alias("uid"), F.lit("glb").alias("asset_type"), F.concat(F.lit("glb/"), k).alias("path"))
    done = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("assets_std_usd_flat/std_"), k, F.lit("/std_"), k, F.lit(".usd")).alias("path"))
    return index, index.where("uid % 5 <> 0").select("path").unionAll(done)


@query(_TASKS_SQL + " SELECT k AS uid, glb, usd, status, CASE WHEN status = 'to_do' THEN 'convexHull' END AS collision, CASE WHEN status = 'to_do' THEN true END AS instanceable, CASE WHEN status = 'to_do' THEN 2.5::DOUBLE END AS mass FROM t")
def conversion_tasks(spark, sf):
    index, present = conversions(spark, sf)
    return files.conversion_tasks(index.select("uid"), index, present, "convexHull", True, 2.5)


@query(_TASKS_SQL + """ SELECT k AS uid, CASE WHEN status = 'existing' OR (status = 'to_do' AND p_size % 4 = 0 AND k % 7 <> 0) THEN usd END AS usd,
CASE status WHEN 'missing' THEN 'nothing to convert' WHEN 'to_do' THEN CASE p_size % 4 WHEN 0 THEN CASE WHEN k % 7 = 0 THEN 'no file' END WHEN 3 THEN 'no result' ELSE p_brand END END AS error FROM t""")
def conversion_merge(spark, sf):
    """Of four results one is good (of seven of these one left no file), two are failures, one doesn't come."""
    index, present = conversions(spark, sf)
    tasks = files.conversion_tasks(index.select("uid"), index, present)
    k, part = F.col("p_partkey").cast("string"), parts(spark, sf)
    results = part.where("p_size % 4 <> 3").select(F.concat(F.lit("glb/"), k).alias("glb"), (F.col("p_size") % 4 == 0).alias("ok"), F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("error"))
    made = part.where("p_size % 4 = 0 and p_partkey % 7 <> 0").select(F.concat(F.lit("assets_std_usd_flat/std_"), k, F.lit("/std_"), k, F.lit(".usd")).alias("path"))
    return files.converted(tasks, results, present.unionAll(made))


@query("SELECT count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS complete FROM documents")
def integrity_complete(spark, sf):
    there = table(spark, sf, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"))
    return integrity.complete(integrity.status(_expected(spark, sf), there))


_INTEGRITY_SQL = f"""WITH {_MATERIAL_SQL}, o AS (SELECT p_partkey AS k, t FROM part, (VALUES ('glb'), ('thumbnail')) AS x(t)),
i AS (SELECT 'object' AS kind, t AS subkind, (k % 4 <> 3 AND k % 5 <> 0) AS there FROM o
UNION ALL SELECT 'material', 'road', bool_and(f.k % 5 <> 0) FROM f WHERE main < 2 GROUP BY name
UNION ALL SELECT 'vegetation', 'tree', p_partkey % 3 < 2 FROM part),
r AS (SELECT kind, subkind, count(*) AS expected, count(*) FILTER (WHERE there) AS present, count(*) FILTER (WHERE NOT there) AS missing FROM i GROUP BY ROLLUP (kind, subkind))"""


def whole_status(spark, sf):
    """Objects (an index entry for three of four), materials and vegetation together; a fifth of the files is gone."""
    part = parts(spark, sf)
    uid = F.col("p_partkey").cast("string")
    kinds = F.explode(F.array(F.lit("glb"), F.lit("thumbnail"))).alias("asset_type")
    index = part.where("p_partkey % 4 <> 3").select(uid.alias("uid"), "p_partkey", kinds).select("uid", "p_partkey", "asset_type", F.concat_ws("/", "asset_type", "uid").alias("path"))
    materials = material_files(spark, sf)
    plants = files.vegetation_map(plant_files(spark, sf), "tree")
    expected = integrity.expected_assets(part.select(uid.alias("uid")), index.drop("p_partkey"), ["glb", "thumbnail"])
    expected = expected.unionByName(integrity.expected_materials(files.material_map(materials, "road"), "road")).unionByName(integrity.expected_vegetation(plants, "tree", "collected_trees"))
    there = index.where("p_partkey % 5 <> 0").select("path").unionAll(materials.where("k % 5 <> 0").select("path")).unionAll(plant_parts(spark, sf))
    return integrity.status(expected, there)


@query(_INTEGRITY_SQL + " SELECT * FROM r")
def integrity_whole(spark, sf):
    return integrity.report(whole_status(spark, sf))


@query(_INTEGRITY_SQL + " SELECT coalesce(kind || '/' || subkind, kind || '/*', 'all') || ': ' || present || ' of ' || expected || ', ' || missing || ' missing' AS line FROM r")
def integrity_lines(spark, sf):
    return integrity.lines(integrity.report(whole_status(spark, sf)))


@query("""WITH l AS (SELECT l_orderkey AS mesh, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
f AS (SELECT mesh, i // 3 AS face, i % 3 AS j, p FROM l WHERE i < n // 3 * 3 UNION ALL SELECT mesh, n // 3, i - n // 3 * 3, p FROM l WHERE i >= n // 3 * 3 UNION ALL SELECT mesh, n // 3 + 1, i, p FROM l)
SELECT a.mesh, CAST(a.face AS INTEGER) AS face, a.p AS a, b.p AS b, c.p AS c FROM f a JOIN f b ON a.mesh = b.mesh AND a.face = b.face AND a.j = 0 AND b.j >= 1 JOIN f c ON c.mesh = b.mesh AND c.face = b.face AND c.j = b.j + 1""")
def mesh_triangles(spark, sf):
    """Meshes of several faces: three corners each, then what is left (too few corners), then all corners again."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("mesh")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("p"))
    n = F.size("p")
    counts = F.concat(F.array_repeat(F.lit(3), (n / 3).cast("int")), F.array(n % 3, n))
    return scene.triangles(lines.select("mesh", F.concat("p", "p").alias("indices"), counts.alias("counts")))


@query("""WITH t AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(replace(n, '_', ' ')), '[^a-z0-9]+')) AS term FROM (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_type AS n FROM part)),
f AS (SELECT p_partkey, term, count(*) AS n FROM t WHERE term <> '' GROUP BY ALL),
s AS (SELECT p_partkey, sum(n * CASE term WHEN 'small' THEN 1 WHEN 'ring' THEN 1 ELSE 0 END) AS d, sqrt(sum(CAST(n * n AS DOUBLE))) AS l FROM f GROUP BY p_partkey)
SELECT p_partkey, round(d / (l * sqrt(2.0::DOUBLE)), 6) AS score FROM s ORDER BY score DESC, p_partkey LIMIT 10""")
def names_topk(spark, sf):
    """Names with underscores are scored as words."""
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_type").alias("name"))
    return similarity.clamped_top_k(similarity.text_scores(parts, "small ring", "p_partkey", spaced(F.col("name"))), 10, key="p_partkey")


def _filled(template: str, **values: F.Column) -> F.Column:
    """The template with columns in place of their names in angle brackets."""
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit(f"<{name}>"), value)
    return text


def _layer_name(number: F.Column) -> F.Column:
    return F.concat(F.lit("scenes/s"), number.cast("string"), F.lit("/main.usda"))


_EDGES_TEXT = """#usda 1.0
(
    subLayers = [
        @../../shared/<type>.usdc@ (offset = 10),
        @./sub/n<half>.usd@
    ]
    customLayerData = { asset icon = @icon.png@ string note = "not @this.usd@ {" }
)
def Xform "World" (
    references = @./sub/n<half>.usd@
    prepend payload = [@../s<third>/main.usda@</x>, @@@p<key>.usd@@@]  # no @more.usd@
)
{
    asset inputs:diffuse = @./textures/<key>.png@
    over "Inner" (
        append references = @../s<third>/main.usda@</World>
        delete references = @gone.usd@
        add payload = @add<key>.usd@
    )
    {
    }
}
"""


@query("""SELECT 'scenes/s' || p_partkey || '/main.usda' AS src, kind, operation, a AS authored, CASE WHEN a LIKE './%' THEN 'scenes/s' || p_partkey || a[2:] WHEN a LIKE '../../%' THEN a[7:] WHEN a LIKE '../%' THEN 'scenes' || a[3:] ELSE 'scenes/s' || p_partkey || '/' || a END AS dst
FROM part, LATERAL (VALUES ('sublayer', 'explicit', '../../shared/' || p_type || '.usdc'), ('sublayer', 'explicit', './sub/n' || p_partkey // 2 || '.usd'), ('reference', 'explicit', './sub/n' || p_partkey // 2 || '.usd'),
('payload', 'prepend', '../s' || p_partkey // 3 || '/main.usda'), ('payload', 'prepend', 'p' || p_partkey || '.usd'), ('reference', 'append', '../s' || p_partkey // 3 || '/main.usda'), ('payload', 'add', 'add' || p_partkey || '.usd')) AS t(kind, operation, a)""")
def layer_edges(spark, sf):
    """All kinds of lists; textures, notes, comments and deleted entries are no edges."""
    k = F.col("p_partkey")
    text = _filled(_EDGES_TEXT, type=F.col("p_type"), key=k.cast("string"), half=(k / 2).cast("long").cast("string"), third=(k / 3).cast("long").cast("string"))
    return graph.layer_edges(layers.layer_items(parts(spark, sf).select(_layer_name(k).alias("layer"), text.alias("value"))))


_SCALED_TEXT = """#usda 1.0
(
    subLayers = [@../s<half>/main.usda@]
)
def Xform "World" (
    prepend references = @../s<third>/main.usda@</World>
)
{
    string note = "inputs:texture_scale = 3 } { ä"
    asset inputs:t = @./tex/<key>.png@
    def Scope "Looks"
    {
        def Shader "S"
        {
            custom <kind> inputs:texture_scale = <value> (
                connectability = "interfaceOnly"
            )
        }
        def Shader "T" { token inputs:texture_scale = "<key>" }
    }
}
"""


def scaled_layers(spark, sf):
    """A layer for each part: of five one has a whole number to upgrade, one a pair; of three one has a sublayer, of four one a reference that exists."""
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "int").when(k % 5 == 1, "float2").otherwise("token")
    value = F.when(k % 5 == 0, F.col("p_size").cast("string")).when(k % 5 == 1, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(", 2.5)"))).otherwise('"none"')
    half = F.when(k % 3 == 0, (k / 2).cast("long").cast("string")).otherwise("x")
    third = F.when(k % 4 == 1, (k / 3).cast("long").cast("string")).otherwise("y")
    text = _filled(_SCALED_TEXT, key=k.cast("string"), kind=kind, value=value, half=half, third=third)
    return parts(spark, sf).select(_layer_name(k).alias("layer"), text.alias("value"))


@query("""SELECT 'scenes/s' || p_partkey || '/main.usda' AS layer, '/World/Looks/' || s AS prim, t AS type, CASE WHEN s = 'S' AND p_partkey % 5 < 2 THEN CAST(p_size AS DOUBLE) END AS x, CASE WHEN s = 'S' AND p_partkey % 5 = 1 THEN 2.5::DOUBLE END AS y
FROM part, LATERAL (VALUES ('S', CASE p_partkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'float2' ELSE 'token' END), ('T', 'token')) AS x(s, t)""")
def layer_attributes(spark, sf):
    """Attributes of one name, wherever prims nest; strings that look like them aren't."""
    found = layers.attributes(layers.layer_items(scaled_layers(spark, sf)), scene.SCALE_ATTRIBUTE)
    return found.select("layer", "prim", "type", "x", "y")


_SCALED_SQL = """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size AS v, CASE WHEN p_partkey % 3 = 0 THEN p_partkey // 2 END AS h, CASE WHEN p_partkey % 4 = 1 THEN p_partkey // 3 END AS t FROM part),
a AS (SELECT k FROM p WHERE k % 5 < 2 UNION SELECT p.k FROM p JOIN a ON p.h = a.k OR p.t = a.k),
u AS (SELECT k, v, CASE WHEN h IN (FROM a) THEN h END AS hn, CASE WHEN t IN (FROM a) THEN t END AS tn, coalesce(CAST(h AS VARCHAR), 'x') AS h, coalesce(CAST(t AS VARCHAR), 'y') AS t FROM p),
r AS (SELECT k, 'scenes/s' || k || '/main.usda' AS layer, 'scenes/s' || k || '/main_new.usda' AS target, CAST(k % 5 < 2 AS BIGINT) AS fixed, CASE WHEN hn IS NOT NULL AND tn IS NOT NULL AND hn <> tn THEN 2 ELSE (hn IS NOT NULL OR tn IS NOT NULL)::BIGINT END AS rewrote,
replace(replace(replace(replace(replace({}, '@../s<half>/main.usda@', '@../s' || h || '/main' || CASE WHEN hn IS NULL THEN '' ELSE '_new' END || '.usda@'), '@../s<third>/main.usda@', '@../s' || t || '/main' || CASE WHEN tn IS NULL THEN '' ELSE '_new' END || '.usda@'),
'<kind>', CASE WHEN k % 5 < 2 THEN 'float2' ELSE 'token' END), '<value>', CASE k % 5 WHEN 0 THEN '(' || 2 * v || ', ' || 2 * v || ')' WHEN 1 THEN '(' || 2 * v || ', 5)' ELSE '"none"' END), '<key>', CAST(k AS VARCHAR)) AS value FROM u WHERE k IN (FROM a))""".format(_text(_SCALED_TEXT))


@query(f"{_SCALED_SQL} SELECT layer, target, fixed, rewrote, value FROM r")
def scene_upgrade(spark, sf):
    """New texts of the layers that hold the attribute and of those that lead to one."""
    return scene.upgrade(scaled_layers(spark, sf), suffix="_new", scale=2.0)


@query(f"{_SCALED_SQL} SELECT layer, target, fixed, rewrote FROM r")
def scene_dry_run(spark, sf):
    return scene.upgrade(scaled_layers(spark, sf), suffix="_new", scale=2.0, dry_run=True)


@query("SELECT 'order/' || o_orderkey || '.usd' AS path FROM orders WHERE o_orderstatus = 'F'")
def without_sibling(spark, sf):
    """Files that have no renamed sibling yet."""
    path = F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"))
    rows = table(spark, sf, "orders").select(F.concat(path, F.lit(".usd")).alias("path"), "o_orderstatus")
    done = table(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.concat(path, F.lit("_new.usd")).alias("path"))
    return files.without_sibling(rows, done, "_new").select("path")


@query("""SELECT p_partkey AS uid, k AS path, v AS value FROM part, LATERAL (VALUES ('name', p_name), ('a.size', CAST(p_size AS VARCHAR)), ('a.b.type', p_type), ('a.b.c.list.0', p_brand), ('a.b.c.list.1', '{"x":' || p_partkey || '}'), ('a.b.c.list.2.0.0', 'true'), ('a.b.c.list.2.0.1', NULL), ('tags.0', p_type), ('tags.1', p_name)) AS t(k, v)""")
def nested_leaves(spark, sf):
    """Objects and arrays of arrays are opened; a text that looks like an object stays a text."""
    text = _filled('{"name": "<name>", "a": {"size": <size>, "b": {"type": "<type>", "c": {"list": ["<brand>", "{\\"x\\":<key>}", [[true, null], []], {}]}}}, "tags": ["<type>", "<name>"]}', name=F.col("p_name"), size=F.col("p_size").cast("string"), type=F.col("p_type"), brand=F.col("p_brand"), key=F.col("p_partkey").cast("string"))
    return docs_.annotation_rows(table(spark, sf, "part").select(F.col("p_partkey").alias("uid"), text.alias("annotation")))


@query("""SELECT p_partkey AS uid, rtrim(repeat('k.', CAST(p_partkey % 40 AS INTEGER)), '.') || CASE WHEN p_partkey % 40 = 0 THEN '' ELSE '.' END || 'name' AS path, p_name AS value FROM part
UNION ALL SELECT p_partkey, rtrim(repeat('0.', CAST(p_partkey % 40 + 1 AS INTEGER)), '.'), CAST(p_size AS VARCHAR) FROM part""")
def deep_leaves(spark, sf):
    """Two documents for each part, of as many levels as its number says, up to 40."""
    rows = table(spark, sf, "part")
    depth = (F.col("p_partkey") % 40).cast("int")
    objects = F.concat(F.repeat(F.lit('{"k":'), depth), F.lit('{"name":"'), "p_name", F.lit('"}'), F.repeat(F.lit("}"), depth))
    arrays = F.concat(F.repeat(F.lit("["), depth + 1), F.col("p_size").cast("string"), F.repeat(F.lit("]"), depth + 1))
    return docs_.annotation_rows(rows.select(F.col("p_partkey").alias("uid"), F.explode(F.array(objects, arrays)).alias("annotation")))


@query("""WITH e AS (SELECT DISTINCT user_id AS uid, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 90 WHEN 'error' THEN 180 WHEN 'signup' THEN 270 END AS angle FROM events WHERE value < 1)
SELECT uid, CAST(angle AS INTEGER) AS angle, uid || '/render_' || angle || '.0.jpg' AS path FROM e WHERE angle IS NOT NULL""")
def image_strip(spark, sf):
    events = table(spark, sf, "events")
    kinds = spark.createDataFrame([(0, "view"), (90, "click"), (180, "error"), (270, "signup")], "angle int, event_type string")
    there = events.where("value < 1").select("user_id", "event_type").distinct().join(F.broadcast(kinds), "event_type")
    there = there.select(F.concat(F.col("user_id").cast("string"), F.lit("/render_"), F.col("angle").cast("string"), F.lit(".0.jpg")).alias("path"))
    users = events.select(F.col("user_id").alias("uid")).distinct()
    return docs_.image_strip(files.renders(users, users.select("uid", F.col("uid").cast("string").alias("folder")), there))


@query("""WITH f AS (SELECT o_custkey AS uid, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT c_mktsegment AS segment, c_nationkey AS nation, coalesce(bool_or(k % 2 = 0), false) AS has_thumbnails FROM customer LEFT JOIN f ON uid = c_custkey GROUP BY ALL""")
def any_thumbnails(spark, sf):
    """Which pages (customers of a segment and nation) have a strip of thumbnails?"""
    pages = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return docs_.has_thumbnails(load_wide(spark, sf).join(pages, "uid"), "segment", "nation")


@query("SELECT CAST(floor((r - 1) / 256) AS BIGINT) AS batch, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS r FROM customer)")
def request_batches(spark, sf):
    return files.batches(table(spark, sf, "customer").select("c_custkey"), [F.col("c_custkey").desc()])


@query("""WITH f AS (SELECT o_custkey AS uid, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) SELECT c_custkey AS uid, CASE WHEN k % 2 = 0 THEN 'order/' || k END AS path FROM customer LEFT JOIN f ON uid = c_custkey""")
def load_one(spark, sf):
    there = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"))
    return files.load_one(table(spark, sf, "customer").select(F.col("c_custkey").alias("uid")), order_files(spark, sf), there, "glb")


def kind_files(spark, sf, kind):
    """Paths of a kind's materials, one for each part: main files, thumbnails, and textures where the kind has them."""
    main, thumbs, end, inside = files.MATERIALS[kind]
    k = F.col("k")
    path = lambda folder, end: F.concat(F.lit(folder + "/"), "name", F.lit(end))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    rows = parts(spark, sf).where("p_partkey % 7 <> 6").select(name.alias("name"), F.col("p_partkey").alias("k"))
    paths = [F.when(k % 3 < 2, path(main, "." + end)), F.when(k % 3 > 0, path(main, ".hash")), F.when(k % 2 == 0, path(thumbs, ".jpg"))]
    if inside:
        paths += [F.when(k % 2 == 0, path(f"{main}/{inside}", "_diff.png")), F.when(k % 4 == 1, path(f"{main}/{inside}", "_ORM.png"))]
    return rows.select("k", "name", F.explode(F.array_compact(F.array(*paths))).alias("path"))


def kind_texts(spark, sf, kind):
    """(name, value): a material file for each part, which names three textures."""
    rows = kind_files(spark, sf, kind).select("name").distinct()
    line = lambda end: F.concat(F.lit('t: texture_2d("./textures/'), "name", F.lit(end + '"),\n'))
    return rows.select("name", F.concat(line("_mask.png"), line("_ORM.png"), line("_diff.png")).alias("value"))


def _show_sql(kind):
    main, thumbs, end, inside = files.MATERIALS[kind]
    fed = f"""|| ',"textures":' || CASE WHEN k % 5 <> 0 AND k % 3 < 2 THEN '{{' || concat_ws(',', CASE WHEN k % 4 = 1 THEN '"ao":"http://localhost/{main}/{inside}/' || name || '_ORM.png"' END, CASE WHEN k % 2 = 0 THEN '"diffuse":"http://localhost/{main}/{inside}/' || name || '_diff.png"' END,
CASE WHEN k % 4 = 1 THEN '"roughness":"http://localhost/{main}/{inside}/' || name || '_ORM.png"' END) || '}}' ELSE '{{}}' END""" if inside else ""
    return f"""WITH p AS (SELECT {_NAME} AS name, p_partkey AS k FROM part WHERE p_partkey % 7 <> 6)
SELECT row_number() OVER (ORDER BY name) - 1 AS pos, '{{"name":"' || name || '","url":' || CASE WHEN k % 5 = 0 THEN 'null' ELSE '"http://localhost/{main}/' || name || CASE WHEN k % 3 < 2 THEN '.{end}"' ELSE '.hash"' END END
|| ',"thumbnail_url":' || CASE WHEN k % 5 = 0 OR k % 2 = 1 THEN 'null' ELSE '"http://localhost/{thumbs}/' || name || '.jpg"' END {fed} || '}}' AS item FROM p"""


def _material_show(kind):
    def run(spark, sf):
        listed = kind_files(spark, sf, kind)
        return show.materials(kind, listed, listed.where("k % 5 <> 0"), "http://localhost", kind_texts(spark, sf, kind))

    return run


for _kind in files.MATERIALS:
    QUERIES[f"{_kind}_show"], SQL[f"{_kind}_show"] = _material_show(_kind), _show_sql(_kind)


@query(_show_sql("road") + " WHERE k % 10 = 4 OR k % 10 = 5")
def material_page(spark, sf):
    """A request by names."""
    listed = kind_files(spark, sf, "road")
    asked = listed.where("k % 10 = 4 or k % 10 = 5").select("name")
    return show.materials("road", listed, listed.where("k % 5 <> 0"), "http://localhost", kind_texts(spark, sf, "road"), asked)


def _plants(spark, sf, kind):
    """(listed, present) of a kind: archives, and unpacked files of two plants of three; one of six has no scene, one of four a preview."""
    archives = plant_files(spark, sf).select("k", "name", F.concat(F.lit(files.VEGETATION[kind] + "/"), "name", F.lit(".tar.gz")).alias("path"))
    inside = F.array_compact(F.array(F.lit("/textures/x.png"), F.when(F.col("k") % 6 != 1, F.lit("/b.usd")), F.when(F.col("k") % 4 == 0, F.lit("/a.usdc")), F.when(F.col("k") % 4 == 1, F.lit("/_preview.glb"))))
    unpacked = archives.where("k % 3 < 2").select("k", "name", F.explode(inside).alias("end")).select("k", F.concat(F.lit(files.VEGETATION[kind] + "/"), "name", "end").alias("path"))
    return archives, unpacked


def _plants_sql(kind):
    folder = files.VEGETATION[kind]
    return f"""WITH {_PLANT_SQL} SELECT row_number() OVER (ORDER BY name) - 1 AS pos, '{{"name":"' || name || '","usd":' || CASE WHEN k % 3 = 2 THEN 'null' WHEN k % 4 = 0 THEN '"{folder}/' || name || '/a.usdc"' WHEN k % 6 <> 1 THEN '"{folder}/' || name || '/b.usd"' ELSE 'null' END
|| ',"preview_url":' || CASE WHEN k % 3 < 2 AND k % 4 = 1 THEN '"http://localhost/{folder}/' || name || '/_preview.glb"' ELSE 'null' END || '}}' AS item FROM p"""


def _vegetation_show(kind):
    def run(spark, sf):
        listed, present = _plants(spark, sf, kind)
        return show.vegetation(kind, listed, present, "http://localhost")

    return run


for _kind in files.VEGETATION:
    QUERIES[f"{_kind}_show"], SQL[f"{_kind}_show"] = _vegetation_show(_kind), _plants_sql(_kind)


@query(_plants_sql("tree") + " WHERE k % 10 > 6")
def vegetation_page(spark, sf):
    """A request by names."""
    listed, present = _plants(spark, sf, "tree")
    return show.vegetation("tree", listed, present, "http://localhost", listed.where("k % 10 > 6").select("name"))


_SHOWN_USERS = "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, '{\"uid\":' || c_custkey || "


@query(f"""WITH o AS (SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey)
{_SHOWN_USERS} ',"glb_url":' || CASE WHEN p % 2 = 0 THEN '"http://localhost/order/' || p || '"' ELSE 'null' END || '}}' AS item FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def object_assets(spark, sf):
    there = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"))
    return show.assets(table(spark, sf, "customer").select(F.col("c_custkey").alias("uid")), order_files(spark, sf), there, "http://localhost", "assets")


@query(f"""WITH o AS (SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS p FROM orders GROUP BY o_custkey)
{_SHOWN_USERS} ',"thumbnail_url":' || CASE WHEN p % 2 = 0 THEN '"http://localhost/order/' || p || '"' ELSE 'null' END || '}}' AS item FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def object_thumbnails(spark, sf):
    there = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"))
    return show.assets(table(spark, sf, "customer").select(F.col("c_custkey").alias("uid")), order_files(spark, sf), there, "http://localhost", "thumbnails")


@query(f"""WITH u AS (SELECT user_id, min(props) AS annotation FROM events GROUP BY user_id)
{_SHOWN_USERS} ',"annotation":' || coalesce(CAST(to_json(annotation) AS VARCHAR), 'null') || '}}' AS item FROM customer LEFT JOIN u ON user_id = c_custkey""")
def object_annotations(spark, sf):
    found = table(spark, sf, "events").groupBy(F.col("user_id").alias("uid")).agg(F.min("props").alias("annotation"))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"))
    return show.assets(asked, order_files(spark, sf), asked.select(F.lit("").alias("path")), "http://localhost", "annotations", found)


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT DISTINCT user_id, event_type FROM events WHERE value < 1)
SELECT row_number() OVER (ORDER BY user_id) - 1 AS pos, '{"uid":' || user_id || ',"render_urls":{' || string_agg('"' || angle || '":' || CASE WHEN e.event_type IS NULL THEN 'null' ELSE '"http://localhost/' || user_id || '/render_' || angle || '.0.jpg"' END, ',' ORDER BY angle) || '}}' AS item
FROM u CROSS JOIN (VALUES (0, 'view'), (90, 'click')) AS a(angle, event_type) LEFT JOIN e USING (user_id, event_type) GROUP BY user_id""")
def object_renders(spark, sf):
    """Two of the four angles."""
    events = table(spark, sf, "events")
    kinds = spark.createDataFrame([(0, "view"), (90, "click"), (180, "error"), (270, "signup")], "angle int, event_type string")
    there = events.where("value < 1").select("user_id", "event_type").distinct().join(F.broadcast(kinds), "event_type")
    there = there.select(F.concat(F.col("user_id").cast("string"), F.lit("/render_"), F.col("angle").cast("string"), F.lit(".0.jpg")).alias("path"))
    users = events.select(F.col("user_id").alias("uid")).distinct()
    return show.assets(users, order_files(spark, sf), there, "http://localhost", "renders", folders=users.select("uid", F.col("uid").cast("string").alias("folder")), angles=(0, 90))


# ---- integrity of all eleven kinds, and repair

_KINDS_SQL = """WITH i AS (SELECT kind, subkind, b, a FROM part, LATERAL (SELECT p_partkey AS k) AS x, LATERAL (VALUES ('object', 'annotation', (k % 4 <> 3 AND k % 5 <> 0) OR k % 3 = 0, (k % 4 <> 3 AND k % 5 <> 0) OR k % 3 = 0 OR k % 10 <> 0),
('object', 'glb', k % 4 <> 3 AND k % 5 <> 0, k % 4 <> 3 AND k % 10 <> 0), ('object', 'thumbnail', k % 4 <> 3 AND k % 5 <> 0, k % 4 <> 3 AND k % 10 <> 0), ('object', 'render', k % 4 <> 3 AND k % 5 <> 0, k % 4 <> 3 AND k % 10 <> 0),
('material', 'sky', k % 5 <> 0, k % 10 <> 0), ('material', 'road', k % 5 <> 0, k % 10 <> 0), ('material', 'sidewalk', k % 5 <> 0, k % 10 <> 0), ('material', 'terrain', k % 5 <> 0, k % 10 <> 0),
('vegetation', 'plant', k % 3 < 2, k % 3 < 2 OR k % 10 <> 0), ('vegetation', 'shrub', k % 3 < 2, k % 3 < 2 OR k % 10 <> 0), ('vegetation', 'tree', k % 3 < 2, k % 3 < 2 OR k % 10 <> 0)) AS t(kind, subkind, b, a) WHERE kind <> 'material' OR k % 7 <> 6)"""


def eleven_kinds(spark, sf):
    """(expected, present, stored): everything that should be there, what is, and what a store has; each with the part's number ``k`` where it is a listing."""
    k, uid = F.col("p_partkey"), F.col("p_partkey").cast("string")
    part = parts(spark, sf)
    kinds = F.explode(F.array(*map(F.lit, catalog.ASSET_TYPES)))
    index = part.where("p_partkey % 4 <> 3").select(k.alias("k"), uid.alias("uid"), kinds.alias("asset_type")).withColumn("path", F.concat("asset_type", F.lit("/b/"), "uid", F.when(F.col("asset_type") == "render", ".tar.gz").otherwise(".x")))
    listed = None
    for kind in files.MATERIALS:
        rows = kind_files(spark, sf, kind).select("k", "path")
        listed = rows if listed is None else listed.unionAll(rows)
    plants = [_plants(spark, sf, kind) for kind in files.VEGETATION]
    for archives, _ in plants:
        listed = listed.unionAll(archives.select("k", "path"))
    expected = integrity.expected_objects(part.select(uid.alias("uid")), index, "assets").unionByName(integrity.expected_files(listed))
    flat = part.select(k.alias("k"), F.concat(F.lit("assets/std_"), uid, F.lit(".json")).alias("path"))
    unpacked = F.when(F.col("asset_type") == "render", F.concat(F.lit("render/b/"), "uid", F.lit("/render_0.0.jpg"))).otherwise(F.col("path"))
    materials = listed.where("path like 'material%'")
    present = index.where("k % 5 <> 0").select(unpacked.alias("path")).unionAll(flat.where("k % 3 = 0").select("path")).unionAll(materials.where("k % 5 <> 0").select("path"))
    for _, inside in plants:
        present = present.unionAll(inside.select("path"))
    stored = index.select("k", "path").unionAll(flat).unionAll(listed).where("k % 10 <> 0").select("path")
    return expected, present, stored


@query(_KINDS_SQL + " SELECT kind, subkind, count(*) AS expected, count(*) FILTER (WHERE b) AS present, count(*) FILTER (WHERE NOT b) AS missing FROM i GROUP BY ROLLUP (kind, subkind)")
def integrity_kinds(spark, sf):
    """All eleven kinds: any of an annotation's places, all of a material's files, anything of an unpacked folder."""
    expected, present, _ = eleven_kinds(spark, sf)
    return integrity.report(integrity.status(expected, present))


@query(_KINDS_SQL + " SELECT kind, subkind, count(*) AS expected, count(*) FILTER (WHERE b) AS present, count(*) FILTER (WHERE a AND NOT b) AS repaired, count(*) FILTER (WHERE NOT a) AS missing FROM i GROUP BY ROLLUP (kind, subkind)")
def repair_report(spark, sf):
    """Before and after: what is missing is fetched where the store has it."""
    expected, present, stored = eleven_kinds(spark, sf)
    seen = integrity.judged(expected, present)
    came = join_large(integrity.repair_plan(expected, present, seen).select(F.col("source").alias("path")), stored, "path", "left_semi")
    return integrity.delta(integrity.repaired(expected, present, came, seen))


@query(f"""WITH p AS (SELECT p_partkey AS k, {_NAME} AS name FROM part),
o AS (SELECT 'object' AS kind, t AS subkind, t || '/b/' || k || CASE t WHEN 'render' THEN '.tar.gz' ELSE '.x' END AS path FROM p, (VALUES ('glb'), ('annotation'), ('thumbnail'), ('render')) AS x(t) WHERE k % 4 <> 3 UNION ALL SELECT 'object', 'annotation', 'assets/std_' || k || '.json' FROM p),
m AS (SELECT 'material' AS kind, t AS subkind, CASE j WHEN 2 THEN thumbs ELSE main END || '/' || name || CASE j WHEN 0 THEN e WHEN 1 THEN '.hash' ELSE '.jpg' END AS path FROM p, (VALUES {", ".join(f"('{kind}', '{m}', '{t}', '.{e}')" for kind, (m, t, e, _) in files.MATERIALS.items())}) AS x(t, main, thumbs, e), (VALUES (0), (1), (2)) AS y(j)
WHERE k % 7 <> 6 AND CASE j WHEN 0 THEN k % 3 < 2 WHEN 1 THEN k % 3 > 0 ELSE k % 2 = 0 END),
v AS (SELECT 'vegetation' AS kind, t AS subkind, folder || '/' || name || '.tar.gz' AS path FROM p, (VALUES {", ".join(f"('{kind}', '{folder}')" for kind, folder in files.VEGETATION.items())}) AS x(t, folder))
FROM o UNION ALL FROM m UNION ALL FROM v""")
def whole_request(spark, sf):
    """Everything there is to fetch."""
    return integrity.whole_request(eleven_kinds(spark, sf)[0])


_BOUND_TEXT = """#usda 1.0
def Scope "Looks" {
    def Material "M" {
        def Shader "S" {
            uniform asset info:mdl:sourceAsset = @./mdl/<key>.mdl@
            asset inputs:rough_texture = @./t/<key>_r.png@
            asset inputs:basecolor_map = @./t/<key>_d.png@
            asset inputs:Normal_map = @../shared/n<key>.png@
            asset inputs:diffuse_late = @./t/<key>_r.png@
        }
    }
    def Material "Plain" { token outputs:surface = "x" }
}
"""


@query("""SELECT 's/m' || p_partkey || '.usda' AS layer, '/Looks/M' AS material, CASE WHEN p_partkey % 2 = 0 THEN 's/t/' || p_partkey || '_d.png' WHEN p_partkey % 3 = 0 THEN 's/t/' || p_partkey || '_r.png' WHEN p_partkey % 7 > 1 THEN 's/mdl/x/' || p_partkey || '_albedo.png' END AS diffuse,
CASE WHEN p_partkey % 5 = 0 THEN 'shared/n' || p_partkey || '.png' WHEN p_partkey % 2 = 1 AND p_partkey % 3 > 0 AND p_partkey % 7 > 0 THEN 's/n.png' END AS normal FROM part""")
def bound_textures(spark, sf):
    """What shaders name comes before what their material files name."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    part = parts(spark, sf)
    items = layers.layer_items(part.select(F.concat(F.lit("s/m"), key, F.lit(".usda")).alias("layer"), _filled(_BOUND_TEXT, key=key).alias("value")))
    texts = part.where("p_partkey % 7 > 0").select(F.concat(F.lit("s/mdl/"), key, F.lit(".mdl")).alias("path"), _filled('rough: texture_2d("./x/<key>_r.png"),\nbump_normal: texture_2d("../n.png"),\ntex: texture_2d("x/<key>_albedo.png")', key=key).alias("value"))
    made = lambda when, template: F.when(when, _filled(template, key=key))
    there = F.array_compact(F.array(F.lit("s/n.png"), made(k % 2 == 0, "s/t/<key>_d.png"), made(k % 3 == 0, "s/t/<key>_r.png"), made(k % 5 == 0, "shared/n<key>.png"), made(k % 7 > 0, "s/mdl/<key>.mdl"), made(k % 7 > 1, "s/mdl/x/<key>_albedo.png")))
    return textures.bound_textures(items, texts, part.select(F.explode(there).alias("path")))


def _measures(i: int) -> F.Column:
    return ((F.col("p_partkey") * (7 + i)) % 101).cast("double")


#: Every attribute filter at once. Lists are alternatives, filters hold together.
ALL_FILTERS = (
    {f"{name}_range": (i % 3, 95 + i % 4) for i, name in enumerate(RANGES)}
    | dict(zip(FLAGS, (True, False, False, False, True), strict=True))
    | {"dominant_materials": ["RED", "small", "Hot", "new", "old", "blue"], "dominant_colors": ["Economy", "PROMO", "standard", "small"], "affordances": ["brand#1", "Brand#2", "ECONOMY", "promo", "Standard"], "interactive_parts": ["gear", "Widget", "bolt", "ring", "rod", "x"]}
    | {"surface_hardness": ["H0", "h1"], "surface_finish": ["F0", "f2", "F1"], "asset_composition_type": ["T1", "t0"]}
)


def measured_assets(spark, sf):
    """Assets with all attributes that can be asked for, made of parts."""
    k = F.col("p_partkey")
    flags = [k % 2 == 0, F.when(k % 3 > 0, k % 3 == 1), F.when(k % 5 > 0, k % 5 == 1), k % 7 == 0, k % 11 > 0]
    lists = {"materials": F.split("p_name", " "), "colors": F.split("p_type", " "), "affordances": F.array("p_brand", "p_type"), "interactive_parts": F.reverse(F.split("p_name", " "))}
    texts = {"surface_hardness": F.concat(F.lit("H"), (k % 3).cast("string")), "surface_finish": F.concat(F.lit("F"), (k % 4).cast("string")), "asset_composition_type": F.concat(F.lit("t"), (k % 3).cast("string"))}
    measures = {name: _measures(i) for i, name in enumerate(RANGES)}
    return table(spark, sf, "part").select(k.alias("uid"), *[c.alias(n) for n, c in (measures | dict(zip(FLAGS, flags, strict=True)) | lists | texts).items()])


@query(f"""SELECT DISTINCT p_partkey AS uid FROM part WHERE {" AND ".join(f"(p_partkey * {7 + i}) % 101 BETWEEN {i % 3} AND {95 + i % 4}" for i in range(len(RANGES)))}
AND p_partkey % 2 = 0 AND p_partkey % 3 <> 1 AND p_partkey % 5 <> 1 AND p_partkey % 7 <> 0 AND p_partkey % 11 > 0
AND lower(string_split(p_name, ' ')[1]) IN ('red', 'small', 'hot', 'new', 'old', 'blue') AND lower(string_split(p_type, ' ')[1]) IN ('economy', 'promo', 'standard', 'small')
AND (lower(p_brand) IN ('brand#1', 'brand#2') OR lower(p_type) IN ('economy', 'promo', 'standard')) AND list_has_any(string_split(lower(p_name), ' '), ['gear', 'widget', 'bolt', 'ring', 'rod', 'x'])
AND p_partkey % 3 < 2 AND p_partkey % 4 < 3 AND p_partkey % 3 < 2""")
def asset_query_all_filters(spark, sf):
    """All 26 filters in one query."""
    return AssetQuery(part_bridge(spark, sf), measured_assets(spark, sf)).in_categories([f"brand#{i}" for i in range(1, 56)]).where(**ALL_FILTERS).uids()


# ---- queries over sources: annotation texts, categories, paths, encoders, fetching

_ASSET_TEXT_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS uid, p_name AS description, p_retailprice AS height, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS mass,
CASE WHEN p_partkey % 7 <> 0 THEN p_brand || '|' || p_type END AS materials, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS movable,
CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS shape, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS age FROM part"""


def asset_texts(spark, sf):
    """An annotation text for each part. One mass of five and one list of materials of seven have a wrong type."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    pieces = [
        F.concat(F.lit('"uid": "'), k.cast("string"), F.lit('"')),
        F.concat(F.lit('"description": "'), "p_name", F.lit('"')),
        F.concat(F.lit('"height": '), F.col("p_retailprice").cast("string")),
        F.concat(F.lit('"mass": '), F.when(k % 5 == 0, F.lit('"heavy"')).otherwise(size)),
        F.concat(F.lit('"materials": '), F.when(k % 7 == 0, F.lit('"oak"')).otherwise(F.concat(F.lit('["'), "p_brand", F.lit('", "'), "p_type", F.lit('"]')))),
        F.when(k % 3 == 0, F.lit('"movable": true')).when(k % 3 == 1, F.lit('"movable": false')),
        F.when(k % 3 == 0, F.concat(F.lit('"attribute_shape": "'), "p_brand", F.lit('"'))),
        F.when(k % 2 == 0, F.concat(F.lit('"attribute_age": '), size)),
    ]
    return table(spark, sf, "part").select(F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}")).alias("value"))


@query(_ASSET_TEXT_SQL)
def parsed_assets(spark, sf):
    found = catalog.parse_assets(asset_texts(spark, sf))
    special = [F.col("attributes").getItem(f"{ATTRIBUTE_PREFIX}{n}").alias(n) for n in ("shape", "age")]
    return found.select("uid", "description", "height", "mass", F.when(F.col("materials").isNotNull(), joined("materials")).alias("materials"), "movable", *special)


@query(f"""SELECT field, CASE field WHEN 'mass' THEN (SELECT count(*) FROM part WHERE p_partkey % 5 = 0) WHEN 'materials' THEN (SELECT count(*) FROM part WHERE p_partkey % 7 = 0) ELSE 0 END AS unreadable
FROM (VALUES {", ".join(f"('{n}')" for n, _, _ in ASSET_FIELDS)}) AS f(field)""")
def quality_counts(spark, sf):
    return catalog.quality_counts(asset_texts(spark, sf))


@query("SELECT 'attribute_shape' AS name, count(*) AS n FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'attribute_age', count(*) FROM part WHERE p_partkey % 2 = 0")
def attribute_names(spark, sf):
    return catalog.attribute_names(catalog.parse_assets(asset_texts(spark, sf)))


@query("SELECT count(*) AS number_of_assets, count(DISTINCT r_name) AS number_of_classes_l1, count(DISTINCT n_name) AS number_of_classes_l2, count(DISTINCT c_mktsegment) AS number_of_classes_l3 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def category_statistics(spark, sf):
    return catalog.statistics(geography(spark, sf))


def master_rows(spark, sf):
    """A master annotation for each region: its nations are the leaf categories, each with two assets."""
    k = F.col("n_nationkey").cast("long")
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = [F.col(c).alias(f"class_name_l{i}") for i, c in ((1, "r_name"), (2, "n_name"), (3, "n_name"))]
    leaf = F.struct(*names, *[k.alias(f"class_id_l{i}") for i in (1, 2, 3)], F.array(k.cast("string"), (k + 1).cast("string")).alias("asset_uids"), F.lit(2).cast("long").alias("asset_count"))
    texts = nations.groupBy("r_name").agg(F.to_json(F.struct(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", leaf)))).alias("annotation"))).alias("value"))
    return texts.select(F.from_json("value", MASTER).alias("master")).select("master.*")


@query("""SELECT row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS pos, n_name AS key, r_name AS l1, n_name AS l2, n_name AS l3, CAST(n_nationkey AS BIGINT) AS id_l1, CAST(n_nationkey AS BIGINT) AS id_l2, CAST(n_nationkey AS BIGINT) AS id_l3,
n_nationkey || '|' || (n_nationkey + 1) AS asset_uids, CAST(2 AS BIGINT) AS asset_count FROM nation JOIN region ON n_regionkey = r_regionkey""")
def category_dim(spark, sf):
    found = catalog.category_dim(master_rows(spark, sf))
    longs = {c: F.col(c).cast("long") for c in ("pos", "id_l1", "id_l2", "id_l3", "asset_count")}
    return found.withColumns(longs | {"asset_uids": joined("asset_uids")})


@query("SELECT CAST(n_nationkey + i AS VARCHAR) AS uid, r_name AS l1, n_name AS l2, n_name AS l3, CAST(i AS INTEGER) AS pos FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (0), (1)) AS x(i)")
def category_bridge(spark, sf):
    return catalog.asset_category(catalog.category_dim(master_rows(spark, sf))).select("uid", "l1", "l2", "l3", "pos")


@query("""SELECT p_partkey, p_partkey || '.v1.tar.gz' AS basename, 'props/' || p_brand AS parent, CAST(p_partkey AS VARCHAR) AS stem, p_partkey || '.v1' AS plain, p_brand || '/' || p_partkey || '.v1.tar.gz' AS below,
'props/' || p_brand || '/' || p_partkey || '.v1.tar.gz' AS undotted, 'props/' || p_brand || '/' || p_partkey || '.v1.tar_new.gz' AS renamed, 'http://h/props/' || p_brand || '/' || p_partkey || '.v1.tar.gz' AS url, 'render_' || p_size || '.0.jpg' AS render FROM part""")
def path_strings(spark, sf):
    path, base = F.col("path"), paths.basename(F.col("path"))
    rows = table(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.lit("props/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".v1.tar.gz")).alias("path"))
    found = {"basename": base, "parent": paths.parent(path), "stem": stem(base), "plain": paths.without_archive_suffix(base), "below": paths.below(path, "props"), "undotted": paths.without_leading_dots(F.concat(F.lit("../../"), path)), "renamed": paths.renamed(path, "_new"), "url": paths.url("http://h/", path), "render": paths.render_name(F.col("p_size"))}
    return rows.select("p_partkey", *[c.alias(n) for n, c in found.items()])


def listed_orders(spark, sf):
    """(folder, path) of a file for each order, one of three in a folder below."""
    k = F.col("o_orderkey")
    path = F.concat("o_orderstatus", F.when(k % 3 == 0, "/sub/").otherwise("/"), k.cast("string"), F.when(k % 2 == 0, ".mdl").otherwise(".txt"))
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("folder"), path.alias("path"))


@query("SELECT 'F/' || o_orderkey || '.mdl' AS path FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0")
def direct_children(spark, sf):
    return listed_orders(spark, sf).where(direct_child(F.col("path"), "F", ".mdl")).select("path")


@query("SELECT 'F/sub/' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.mdl' ELSE '.txt' END AS path FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0")
def folder_subtree(spark, sf):
    return catalog.folder_listing(listed_orders(spark, sf), "F/sub").select("path")


@query()
def encoded_topk(spark, sf):
    """Names by the vectors that the shipped encoder gives them; held against brute force by a test."""
    encoders = similarity.Encoders()
    encoders.register("terms", similarity.hashed_terms(64))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("uid"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    (asked,) = similarity.hashed_terms(64)()(["small ring economy"])
    return similarity.nearest(encoders.encode(rows, "terms", "text"), [float(x) for x in asked], 10, vector="vector")


@query("SELECT p_partkey AS node FROM part WHERE p_partkey % 4 <> 2")
def patchable_layers(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ["float2", "int", "string", "float2"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return scene.patchable(table(spark, sf, "part").select(F.col("p_partkey").alias("layer"), kind.alias("type"), F.col("p_retailprice").alias("x")))


@query(_INTEGRITY_SQL + """, n AS (SELECT coalesce(kind || '/' || subkind, kind || '/*', 'all') AS name, expected, present, missing FROM r), w AS (SELECT max(length(name)) AS a, max(length(CAST(expected AS VARCHAR))) AS b FROM n)
SELECT rpad(name, CAST(a AS INTEGER), ' ') || '  ' || lpad(CAST(present AS VARCHAR), CAST(b AS INTEGER), ' ') || ' / ' || rpad(CAST(expected AS VARCHAR), CAST(b AS INTEGER), ' ') || '  ' || CASE WHEN missing = 0 THEN 'OK' ELSE '(' || missing || ' missing)' END AS line FROM n, w""")
def integrity_table(spark, sf):
    return integrity.aligned(integrity.report(whole_status(spark, sf)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
