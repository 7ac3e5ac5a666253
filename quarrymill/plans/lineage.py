"""Queries over canonical records, labels, the catalog, stacks, diffs and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import scalars
from quarrymill.functions.hashing import content_id, sample_order, split_name, split_unit, unit_hash
from quarrymill.operators import canonical, catalog, diffs, labels, sequences, stacks
from quarrymill.plans.registering import registers
from quarrymill.session import table
from quarrymill.streaming.funnel import pending_rows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: SQL fragments that several oracles share.
NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
UNIT32 = "('0x' || substr(sha256({0}), 1, 8))::BIGINT / 4294967296.0"
UNIT64 = "('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"

query = registers(QUERIES, ORACLE_SQL)


@query(f"""
    WITH r AS (SELECT 'rec_' || substr(sha256({NORM}), 1, 20) AS record_id, doc_id, lang, source FROM documents),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY doc_id) AS rn FROM r) WHERE rn = 1),
    s AS (SELECT k.*, {UNIT32.format("'0:' || source")} AS u, l.quality FROM k LEFT JOIN labels l USING (doc_id))
    SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split, lang, count(*) AS records,
           count(quality) AS labelled, coalesce(sum(quality), 0)::BIGINT AS good FROM s GROUP BY 1, 2""")
def dedup_label_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    ids = docs.select(content_id(canonical.canonical_text(F.col("text"))).alias("record_id"), "doc_id", "lang", "source")
    kept = canonical.keep_first(ids, ["record_id"], ["doc_id"])
    split = canonical.assign_split(kept, F.col("source")).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return split.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("records"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"))


@query(f"""SELECT doc_id, 'rec_' || substr(sha256({NORM}), 1, 20) AS record_id FROM documents
    QUALIFY row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) = 1""")
def dedup_keep_first(spark, sf):
    ids = table(spark, sf, "documents").select("doc_id", content_id(canonical.canonical_text(F.col("text"))).alias("record_id"))
    return canonical.keep_first(ids, ["record_id"], ["doc_id"]).select("doc_id", "record_id")


@query(f"""WITH n AS (SELECT CASE WHEN length(text) >= 20 THEN sha256({NORM}) END AS id FROM documents)
    SELECT count(id) AS records, count(DISTINCT id) AS unique_records, count(id) - count(DISTINCT id) AS duplicates,
           count(*) - count(id) AS rejected FROM n""")
def dedup_counts(spark, sf):
    docs = table(spark, sf, "documents").select("text")
    return canonical.dedup_counts(docs, F.sha2(canonical.canonical_text(F.col("text")), 256), F.length("text") >= 20)


@query(f"""
    WITH p AS (SELECT {NORM} AS id, count(*) AS n FROM documents GROUP BY 1),
    f AS (SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL
          SELECT 'source', source, count(*) FROM documents GROUP BY 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value NULLS FIRST) AS rank FROM f)
    SELECT field, value, n, rank::INT AS rank FROM r WHERE rank <= 12 UNION ALL
    SELECT '__identity', 'rows', sum(n)::BIGINT, 0 FROM p UNION ALL SELECT '__identity', 'unique', count(*), 0 FROM p UNION ALL
    SELECT '__identity', 'max_multiplicity', max(n), 0 FROM p""")
def corpus_inventory(spark, sf):
    docs = table(spark, sf, "documents").select("text", "lang", "source")
    return canonical.inventory(docs, F.xxhash64(canonical.canonical_text(F.col("text"))), ["lang", "source"])


@query(f"""SELECT o_custkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split, n
    FROM (SELECT o_custkey, {UNIT32.format("'7:' || o_custkey")} AS u, count(*) AS n FROM orders GROUP BY 1)""")
def split_group_hash(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per.select("o_custkey", split_name(split_unit(7, F.col("o_custkey"))).alias("split"), "n")


@query(f"""
    WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split
               FROM (SELECT *, {UNIT32.format("'7:' || o_custkey")} AS u FROM orders)),
    k AS (SELECT 'o_custkey' AS key, o_custkey AS v, split FROM s UNION ALL SELECT 'o_orderkey', o_orderkey, split FROM s),
    p AS (SELECT key, v, count(DISTINCT split) AS d FROM k GROUP BY 1, 2)
    SELECT key, count(*) AS values, count(*) FILTER (d > 1) AS straddling FROM p GROUP BY 1""")
def split_disjoint_check(spark, sf):
    rows = canonical.assign_split(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), F.col("o_custkey"), 7)
    return canonical.straddling_groups(rows, ["o_custkey", "o_orderkey"])


#: Orders that share a part, transitively, by the least order of each part.
COMPONENTS = """WITH RECURSIVE x AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS k FROM lineitem),
    h AS (SELECT k, min(g) AS least FROM x GROUP BY 1),
    e AS (SELECT g AS a, least AS b FROM x JOIN h USING (k) UNION SELECT least, g FROM x JOIN h USING (k)),
    cc(node, component) USING KEY (node) AS (SELECT DISTINCT g, g FROM x UNION
        (SELECT u.node, min(v.component) FROM recurring.cc u JOIN e ON e.a = u.node JOIN cc v ON v.node = e.b WHERE v.component < u.component GROUP BY 1))"""
LEAKS = COMPONENTS + """, bad AS (SELECT DISTINCT component FROM cc WHERE node % 10 = 0)
    SELECT count(*) AS train_rows, count(*) FILTER (component NOT IN (SELECT component FROM bad)) AS clean_rows FROM lineitem JOIN cc ON node = l_orderkey WHERE l_orderkey % 10 <> 0"""


@query(COMPONENTS + " SELECT node AS l_orderkey, component FROM cc")
def components_min_label(spark, sf):
    return canonical.link_groups(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query(LEAKS)
def leakage_clean(spark, sf):
    return _leakage(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"))


def _leakage(rows: DataFrame) -> DataFrame:
    train, exam = rows.where("l_orderkey % 10 <> 0"), rows.where("l_orderkey % 10 = 0")
    clean = canonical.without_leaks(train, exam, "l_orderkey", "l_partkey")
    return train.agg(F.count(F.lit(1)).alias("train_rows")).crossJoin(clean.agg(F.count(F.lit(1)).alias("clean_rows")))


@query(COMPONENTS + " SELECT component, count(*) AS orders, max(node) AS last FROM cc GROUP BY 1")
def component_sizes(spark, sf):
    comp = canonical.link_groups(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")
    return comp.groupBy("component").agg(F.count(F.lit(1)).alias("orders"), F.max("l_orderkey").alias("last"))


@query(COMPONENTS + " SELECT node AS l_orderkey, component FROM cc")
def components_whole(spark, sf):
    """components_min_label under its former name."""
    return components_min_label(spark, sf)


@query(LEAKS)
def leakage_clean_whole(spark, sf):
    """leakage_clean under its former name."""
    return leakage_clean(spark, sf)


@query("""SELECT d.doc_id, count(l.doc_id) * 2 AS n_labels, max(l.quality)::DOUBLE AS quality, max(l.toxic)::DOUBLE AS toxic
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def label_join_agg(spark, sf):
    long = labels.long_form(table(spark, sf, "labels"), "doc_id", ["quality", "toxic"])
    joined = labels.join_labels(table(spark, sf, "documents").select("doc_id"), long, "doc_id", ["family"], ["value"])
    one = lambda f: F.get(F.filter("labels", lambda x: x["family"] == f), 0)["value"]
    return joined.select("doc_id", F.size("labels").cast("long").alias("n_labels"), one("quality").alias("quality"), one("toxic").alias("toxic"))


@query("SELECT count(*) AS orphans FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id + 3)")
def label_fk_anti(spark, sf):
    shifted = table(spark, sf, "labels").select((F.col("doc_id") + 3).alias("doc_id"))
    return labels.unknown_records(shifted, table(spark, sf, "documents"), "doc_id").agg(F.count(F.lit(1)).alias("orphans"))


@query("""WITH x AS (SELECT doc_id, 'quality' AS f FROM labels WHERE quality = 1 UNION SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)
    SELECT doc_id FROM x GROUP BY 1 HAVING count(DISTINCT f) = 2""")
def required_labels_having(spark, sf):
    long = labels.long_form(table(spark, sf, "labels"), "doc_id", ["quality", "toxic"]).where("value = 1")
    return labels.has_all(long, "doc_id", ["quality", "toxic"])


@query("""SELECT e.label, count(v.vec_id) AS n FROM (SELECT DISTINCT label FROM embeddings) e
    LEFT JOIN embeddings v ON v.label = e.label AND v.vec_id % 5 = 0 GROUP BY 1 HAVING count(v.vec_id) <> 1""")
def target_spec_exactly_one(spark, sf):
    vecs = table(spark, sf, "embeddings").select("vec_id", "label")
    return labels.not_exactly_one(vecs, vecs, "label", F.col("vec_id") % 5 == 0)


@query("""SELECT 'l_returnflag' AS facet, l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL
    SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2""")
def label_provenance(spark, sf):
    return labels.provenance_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
    AND o_totalprice >= 1000 AND o_totalprice <= 200000""")
def filter_conjunction(spark, sf):
    cond = catalog.conjunction({"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_totalprice_min": 1000, "o_totalprice_max": 200000})
    return table(spark, sf, "orders").where(cond).select("o_orderkey", "o_totalprice")


@query("""SELECT event_id FROM events WHERE (props->>'k')::DOUBLE >= 50 AND (props->>'k') <> '87'
    AND lower(event_type) = 'click' AND CASE WHEN event_id % 2 = 0 THEN (props->>'k') = '60' OR (props->>'k') > '7' ELSE (props->>'k')::DOUBLE >= 70.0 END""")
def tag_filter_json(spark, sf):
    """Tags in odd letter case: names match in any, text after a colon too, other text as written, and "60" isn't "60.0"."""
    events, tags = table(spark, sf, "events"), F.from_json("props", "map<string,string>")
    tags = F.map_concat(tags, F.create_map(F.lit("Kind"), F.upper("event_type"), F.lit("Text"), F.concat(F.lit("v"), F.try_element_at(tags, F.lit("k")))))
    even = catalog.tag_filter("K:60", tags) | catalog.tag_filter("text>v7", tags)
    wanted = F.when(F.col("event_id") % 2 == 0, even & ~catalog.tag_filter("k:60.0", tags)).otherwise(catalog.tag_filter("k>=7e1", tags))
    return events.where(catalog.tag_filter("K>=50", tags) & catalog.tag_filter("k!=87", tags) & catalog.tag_filter("KIND:Click", tags) & wanted).select("event_id")


@query("""SELECT 'priority' AS facet, o_orderpriority AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL
    SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL
    SELECT 'segment', c_mktsegment, count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2 UNION ALL
    SELECT 'word', w, count(*) FROM (SELECT DISTINCT o_orderkey, unnest(string_split(lower(o_orderpriority), '-')) AS w
        FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 2""")
def facets_long(spark, sf):
    both = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return catalog.facets(both, {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus"), "segment": F.col("c_mktsegment")}, {"word": F.split(F.lower("o_orderpriority"), "-")})


@query("""SELECT 'l_returnflag' AS facet, l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL
    SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL
    SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2""")
def facets_grouping_sets(spark, sf):
    return catalog.coverage(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN c_acctbal IS NULL THEN 'unlabelled' WHEN v < 1 THEN '0' WHEN v < 100 THEN '1-99'
    WHEN v < 300 THEN '100-299' WHEN v < 900 THEN '300-899' ELSE '900+' END AS bucket
    FROM (SELECT c_acctbal, trunc(abs(c_acctbal))::BIGINT AS v FROM customer)) GROUP BY 1""")
def bucket_abs(spark, sf):
    return table(spark, sf, "customer").groupBy(scalars.magnitude_bucket(F.col("c_acctbal")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_topn(spark, sf):
    return catalog.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, 50)


@query("SELECT o_orderkey FROM orders ORDER BY sha256('3:' || o_orderkey), o_orderkey LIMIT 500")
def arm_fixed_rows(spark, sf):
    return stacks.fixed_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500, 3)


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('4:' || o_orderkey), o_orderkey) AS rn,
    count(*) OVER () AS n FROM orders) WHERE rn <= greatest(1, round_even(0.05 * n, 0))""")
def arm_fraction(spark, sf):
    return stacks.fraction_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.05, 4)


@query("""SELECT o_orderkey, o_orderpriority FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('5:' || o_orderkey), o_orderkey) <= 100""")
def arm_balance(spark, sf):
    return stacks.balanced(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 100, 5)


def _arms(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return [("urgent", orders.where("o_orderpriority = '1-URGENT'")), ("large", orders.where("o_totalprice > 150000")), ("every", orders.where("o_orderkey % 3 = 0"))]


ARMS_SQL = """WITH a AS (SELECT o_orderkey, 'urgent' AS arm, 0 AS arm_order FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL
    SELECT o_orderkey, 'large', 1 FROM orders WHERE o_totalprice > 150000 UNION ALL SELECT o_orderkey, 'every', 2 FROM orders WHERE o_orderkey % 3 = 0)"""


@query(ARMS_SQL + " SELECT o_orderkey, arg_min(arm, arm_order) AS arm, min(arm_order) AS arm_order, count(*) AS in_arms FROM a GROUP BY 1")
def stack_union_first_wins(spark, sf):
    return stacks.stack([(n, d.select("o_orderkey")) for n, d in _arms(spark, sf)], "o_orderkey")


@query(ARMS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY sha256('0:' || o_orderkey), o_orderkey) AS rn FROM a),
    s AS (SELECT * FROM r WHERE rn <= 1000), f AS (SELECT o_orderkey, arg_min(arm, arm_order) AS arm FROM s GROUP BY 1)
    SELECT arm, (SELECT count(*) FROM a WHERE a.arm = x.arm) AS available, (SELECT count(*) FROM s WHERE s.arm = x.arm) AS sampled,
           (SELECT count(*) FROM f WHERE f.arm = x.arm) AS effective FROM (SELECT DISTINCT arm FROM a) x""")
def stack_preview(spark, sf):
    arms = [(n, d, stacks.fixed_rows(d.select("o_orderkey"), "o_orderkey", 1000)) for n, d in _arms(spark, sf)]
    return stacks.preview(arms, "o_orderkey")


def _parts(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    old = part.where("p_partkey % 7 <> 0")
    new = part.where("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 13 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return old, new


PARTS_SQL = """WITH o AS (SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_partkey % 7 <> 0),
    n AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_retailprice FROM part WHERE p_partkey % 11 <> 0)"""


@query(PARTS_SQL + """ SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed'
    WHEN o.p_size IS NOT DISTINCT FROM n.p_size AND o.p_retailprice IS NOT DISTINCT FROM n.p_retailprice THEN 'same' ELSE 'changed' END AS change
    FROM o FULL JOIN n ON o.p_partkey = n.p_partkey) GROUP BY 1""")
def diff_full_outer(spark, sf):
    old, new = _parts(spark, sf)
    return diffs.diff(old, new, ["p_partkey"], ["p_size", "p_retailprice"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(PARTS_SQL + """ , d AS (SELECT o.p_partkey, o.p_size <> n.p_size AS a, o.p_retailprice <> n.p_retailprice AS b FROM o JOIN n USING (p_partkey))
    SELECT 'p_size' AS field, count(*) FILTER (a) AS n, array_to_string((list(p_partkey ORDER BY p_partkey) FILTER (a))[:3], ',') AS examples FROM d
    UNION ALL SELECT 'p_retailprice', count(*) FILTER (b), '' FROM d""")
def triage_compare(spark, sf):
    old, new = _parts(spark, sf)
    return diffs.field_mismatches(old, new, "p_partkey", ["p_size", "p_retailprice"]).withColumn("examples", F.array_join("examples", ","))


@query("""SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed'
    WHEN o.v = n.v THEN 'same' ELSE 'changed' END AS change FROM (SELECT doc_id, family, last(v ORDER BY seq) AS v FROM
    (SELECT doc_id, 'quality' AS family, quality::DOUBLE AS v, 0 AS seq FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE, 0 FROM labels
     UNION ALL SELECT doc_id, 'toxic', 1.0, 1 FROM labels WHERE doc_id % 5 = 0) GROUP BY 1, 2) n
    FULL JOIN (SELECT doc_id, 'quality' AS family, quality::DOUBLE AS v FROM labels WHERE doc_id % 4 <> 0 UNION ALL
     SELECT doc_id, 'toxic', toxic::DOUBLE FROM labels WHERE doc_id % 4 <> 0) o ON o.doc_id = n.doc_id AND o.family = n.family) GROUP BY 1""")
def label_diff(spark, sf):
    base = labels.long_form(table(spark, sf, "labels"), "doc_id", ["quality", "toxic"])
    revised = base.withColumn("seq", F.lit(0)).unionByName(base.where("family = 'toxic' and doc_id % 5 = 0").select("doc_id", "family", F.lit(1.0).alias("value"), F.lit(1).alias("seq")))
    new = labels.latest(revised, ["doc_id", "family"], ["seq"], ["value"])
    return diffs.diff(base.where("doc_id % 4 <> 0"), new, ["doc_id", "family"], ["value"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT change, count(*) AS n FROM (SELECT CASE WHEN c IS NULL THEN 'added' WHEN s IS NULL THEN 'removed' ELSE 'kept' END AS change FROM
    (SELECT DISTINCT c_nationkey AS c FROM customer WHERE c_nationkey % 3 <> 0) FULL JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier) ON c = s) GROUP BY 1""")
def set_except_intersect(spark, sf):
    return diffs.set_changes(table(spark, sf, "customer").where("c_nationkey % 3 <> 0").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("""SELECT (SELECT count(*) FROM (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber <= 4 EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber >= 3)) AS only_left,
    (SELECT count(*) FROM (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber >= 3 EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber <= 4)) AS only_right""")
def determinism_check(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return diffs.same_rows(rows.where("l_linenumber <= 4").drop("l_linenumber"), rows.where("l_linenumber >= 3").drop("l_linenumber"))


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN lag(turn) OVER w IS NULL OR turn <= lag(turn) OVER w THEN 1 ELSE 0 END AS s FROM
    (SELECT conv_id % 7 AS src, conv_id, turn FROM conversations) WINDOW w AS (PARTITION BY src ORDER BY conv_id, turn))
    SELECT conv_id, turn, 'g' || lpad(sum(s) OVER (PARTITION BY conv_id % 7 ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)::VARCHAR, 6, '0') AS session FROM x""")
def session_by_counter(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") % 7).alias("src"))
    return sequences.sessions_by_counter(rows, "src", ["conv_id", "turn"], "turn").select("conv_id", "turn", "session")


@query("""WITH x AS (SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS s
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, (sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM x""")
def session_gap(spark, sf):
    return sequences.sessions_by_gap(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 1800, "event_id").select("event_id", "user_id", "session")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS segment,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END AS position, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE sha256('9:' || o_orderkey) END AS "order"
    FROM orders WHERE o_orderkey % 5 <> 0""")
def universe_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    old = orders.where("o_orderkey % 2 = 0").withColumn("position", F.col("o_orderkey"))
    return sequences.universe_order(old, orders.where("o_orderkey % 5 <> 0"), "o_orderkey", "position", sample_order(9, F.col("o_orderkey")))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders)
    SELECT count(*) AS n FROM x WHERE o_totalprice < previous""")
def nesting_assertion(spark, sf):
    return sequences.monotone(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT event_type, count(*) AS n, count(*) FILTER (u < 0.2) AS held FROM (SELECT event_type, {UNIT64.format("'11:holdout:' || event_id")} AS u FROM events) GROUP BY 1""")
def holdout_hash(spark, sf):
    rows = stacks.holdout(table(spark, sf, "events").select("event_id", "event_type"), "event_id", 0.2, 11)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("holdout").alias("held"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def resume_left_anti(spark, sf):
    return pending_rows(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").where("quality = 1"), "doc_id")


@query("""WITH w AS (SELECT sum(l_quantity) OVER o AS cost, row_number() OVER o AS size, count(*) FILTER (l_quantity IS NULL) OVER o AS gaps FROM lineitem
      WINDOW o AS (ORDER BY sha256('1:' || l_orderkey || '-' || l_linenumber), l_orderkey, l_linenumber, l_quantity NULLS FIRST ROWS UNBOUNDED PRECEDING))
    SELECT size, cost FROM w WHERE gaps = 0 ORDER BY abs(cost - 50000), size LIMIT 1""")
def prefix_budget(spark, sf):
    """Lines of one order and number are several: they come by quantity, and a prefix may end between them."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    key = F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))
    return stacks.nearest_prefix(rows, [sample_order(1, key).alias("h"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")], "l_quantity", 50000.0)


@query("""WITH i AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 37 = 0) SELECT o_orderkey, o_totalprice, (o_orderkey * 7) % 1000 AS position
    FROM orders JOIN i ON k = o_orderkey""")
def exact_id_selection(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    ids = orders.where("o_orderkey % 37 = 0").select("o_orderkey", ((F.col("o_orderkey") * 7) % 1000).alias("position"))
    return stacks.by_exact_ids(orders, "o_orderkey", ids.unionByName(ids.withColumn("position", F.col("position") + 1)))
