"""Queries over the write path and over predicates on records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import positions
from quarrymill.functions.hashing import content_id
from quarrymill.operators import records, selection, stacks
from quarrymill.operators.canonical import canonical_text
from quarrymill.plans.lineage import NORM, UNIT32
from quarrymill.plans.registering import registers
from quarrymill.session import table
from quarrymill.sources.readers import canonical_lines, content_hash, outcome

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

query = registers(QUERIES, ORACLE_SQL)

#: A hash of a group's texts in SQL, as content_hash has it.
HASH = "sha256(concat_ws(',', " + ", ".join(f"sum(('0x' || substr(sha256({{0}}), {1 + 8 * i}, 8))::BIGINT)::HUGEINT::VARCHAR" for i in range(8)) + "))"


def _normalized(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "text", "lang")
    game = F.when(F.col("doc_id") % 11 != 0, F.concat(F.col("lang"), F.floor(F.col("doc_id") / 40).cast("string")))
    rows = docs.withColumn("game", game).select("source", "doc_id", "game", "text")
    return records.normalized(rows, "source", "doc_id", content_id(canonical_text(F.col("text"))), "game", F.length("text") >= 20)


@query(f"""WITH r AS (SELECT doc_id, source, 'rec_' || substr(sha256({NORM}), 1, 20) AS record_id, doc_id % 11 = 0 AS unknown FROM documents WHERE length(text) >= 20),
    k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY source, doc_id) = 1)
    SELECT source, unknown AS group_unknown, count(*) AS n, count(*) FILTER (unknown) AS unknown_groups FROM k GROUP BY 1, 2""")
def normalized_records(spark, sf):
    rows = _normalized(spark, sf)
    return rows.groupBy("source", "group_unknown").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("group").endswith(":UNKNOWN")).alias("unknown_groups"))


@query()
def freeze_splits(spark, sf):
    """The manifest of a dataset frozen from canonical records. Groups are components, so no SQL; tests/ holds it against a union-find."""
    return records.manifest(records.frozen(_normalized(spark, sf), 3, unknown="shared"))


@query(f"""WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {UNIT32.format("'3:' || o_custkey")} AS u FROM orders))
    SELECT split, count(*) AS rows, count(DISTINCT o_custkey) AS groups, {HASH.format("o_orderkey::VARCHAR")} AS ids_hash FROM s GROUP BY 1""")
def freeze_manifest(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("group"), F.lit(False).alias("group_unknown"))
    return records.manifest(records.frozen(rows, 3)).drop("rows_hash")


@query(f"""WITH s AS (SELECT o_custkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {UNIT32.format("'3:' || o_custkey")} AS u FROM orders)),
    c AS (SELECT split, 1 AS n FROM s GROUP BY 1) SELECT split, unnest(['rows', 'ids_hash', 'rows_hash']) AS what FROM c WHERE split = 'train'""")
def verify_dataset(spark, sf):
    """What a dataset with one record of the training split taken away differs in from its manifest."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("group"), F.lit(False).alias("group_unknown"))
    kept = records.frozen(rows, 3)
    gone = kept.where("split = 'train'").agg(F.min("record_id").alias("record_id"))
    return records.verification(kept.join(F.broadcast(gone), "record_id", "left_anti"), records.manifest(kept)).where("what <> 'groups'")


@query("""WITH l AS (SELECT doc_id + CASE WHEN doc_id % 7 = 0 THEN 1000000000 ELSE 0 END AS doc_id, unnest(['quality', 'toxic']) AS family FROM labels UNION ALL SELECT doc_id, 'quality' FROM labels WHERE doc_id % 5 = 0)
    SELECT sum(n)::BIGINT AS rows, (sum(n) FILTER (NOT there))::BIGINT AS unknown, count(*) FILTER (n > 1) AS twice FROM
    (SELECT l.doc_id, family, count(*) AS n, max((d.doc_id IS NOT NULL)::INT) = 1 AS there FROM l LEFT JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, 2)""")
def register_labels_refused(spark, sf):
    """What registering would refuse a label set for."""
    base = table(spark, sf, "labels").select("doc_id")
    moved = base.select(F.when(F.col("doc_id") % 7 == 0, F.col("doc_id") + 1000000000).otherwise(F.col("doc_id")).alias("doc_id"), F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("family"))
    again = base.where("doc_id % 5 = 0").select("doc_id", F.lit("quality").alias("family"))
    return records.registration_report(moved.unionByName(again), table(spark, sf, "documents"), "doc_id", ["doc_id", "family"])


@query("""SELECT l.toxic, count(d.doc_id) AS kept, count(*) - count(d.doc_id) AS dropped FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang <> 'en') d ON d.doc_id = l.doc_id GROUP BY 1""")
def copy_labels(spark, sf):
    return records.copy_report(table(spark, sf, "labels"), table(spark, sf, "documents").where("lang <> 'en'"), "doc_id", "toxic")


@query("""WITH m AS (SELECT o_custkey AS k, string_agg(DISTINCT o_orderpriority, ',') AS x, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)
    SELECT n = 1 AS alone, count(*) AS groups FROM m GROUP BY 1""")
def component_names(spark, sf):
    """How many customers' orders have one priority only, by the names of components: a lone member keeps its own name."""
    pairs = table(spark, sf, "orders").select("o_custkey", "o_orderpriority").distinct()
    rows = pairs.select(F.concat_ws("/", "o_custkey", "o_orderpriority").alias("g"), F.col("o_custkey").alias("k"))
    named = records.component_labels(rows, "g", "k")
    return named.groupBy("label").agg(F.count(F.lit(1)).alias("c")).select((~F.col("label").startswith("xc")).alias("alone")).groupBy("alone").agg(F.count(F.lit(1)).alias("groups"))


@query("""SELECT l_returnflag AS arm, count(*) AS raw, count(o_orderkey) AS joined FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def row_match(spark, sf):
    joined = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("o_orderkey")).join(table(spark, sf, "orders").select("o_orderkey", F.lit(1).alias("there")), "o_orderkey", "left")
    sizes = joined.groupBy(F.col("l_returnflag").alias("arm")).agg(F.count(F.lit(1)).alias("raw"), F.count("there").alias("joined"))
    return records.row_matched(sizes, "raw", "joined")


@query("""SELECT fact, ours, theirs FROM (SELECT unnest(['rows', 'most']) AS fact, unnest([count(*), max(o_orderkey)]) ::VARCHAR AS ours FROM orders) JOIN
    (SELECT unnest(['rows', 'most']) AS fact, unnest([count(*), max(o_orderkey)])::VARCHAR AS theirs FROM orders WHERE o_orderkey % 9 <> 1) USING (fact) WHERE ours IS DISTINCT FROM theirs""")
def universe_attestation(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return records.attestation(orders, {"rows": F.count(F.lit(1)), "most": F.max("o_orderkey")}, orders.where("o_orderkey % 9 <> 1"))


@query("""WITH a AS (SELECT count(*) AS rows, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 25 = 0)) AS clean FROM orders)
    SELECT rows, clean, round_even((rows - clean) / rows, 6) AS share, (rows - clean) / rows > 0.05 AS stop FROM a""")
def leak_stop(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey")
    clean = orders.join(table(spark, sf, "customer").where("c_custkey % 25 = 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    return records.leak_share(orders, clean)


@query("""SELECT count(*) AS "left", count(*) FILTER (o_orderkey % 3 <> 0) AS "right", count(*) FILTER (o_orderkey % 3 = 0) AS differ, count(*) FILTER (o_orderkey % 3 = 0) = 0 AS same FROM orders""")
def ordered_equality(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("position"))
    return records.same_order(a, a.where("o_orderkey % 3 <> 0"), "o_orderkey", "position")


@query(f"""SELECT l_returnflag, count(*) AS n, {HASH.format("l_orderkey || '-' || l_linenumber")} AS h FROM lineitem GROUP BY 1""")
def content_hashes(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("t"))
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), content_hash(F.col("t")).alias("h"))


NATION_LINE = """'{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}'"""


@query("SELECT count(*) AS n, " + HASH.replace("{0}", NATION_LINE) + " AS h FROM nation")
def canonical_rows(spark, sf):
    lines = canonical_lines(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return lines.agg(F.count(F.lit(1)).alias("n"), content_hash(F.col("line")).alias("h"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')""")
def label_exists(spark, sf):
    seen = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("authority"))
    return selection.with_label(table(spark, sf, "customer").select("c_custkey"), seen, "c_custkey", family="1-URGENT", authority="O")


@query("""SELECT source, count(*) AS n FROM documents WHERE list_contains(string_split(lower(text), ' '), 'the') GROUP BY 1""")
def value_membership(spark, sf):
    docs = table(spark, sf, "documents").where(selection.has_value(F.split("text", " "), "THE"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) FILTER (b >= 3) AS at_least, count(*) FILTER (b >= 3 AND f = 'R') AS in_favour, sum(b)::BIGINT AS buckets FROM
    (SELECT CASE WHEN l_linenumber % 2 = 0 THEN floor(l_discount * 100)::INT ELSE 0 END AS b, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS f FROM lineitem)""")
def fact_filter(spark, sf):
    fact = F.create_map(F.lit("discount"), F.struct(F.floor(F.col("l_discount") * 100).cast("int").alias("bucket"), F.col("l_returnflag").alias("favors")))
    none = F.create_map().cast("map<string,struct<bucket:int,favors:string>>")
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, fact).otherwise(none).alias("facts"))
    facts = F.col("facts")
    return rows.agg(F.count_if(selection.fact_at_least(facts, "discount", 3)).alias("at_least"), F.count_if(selection.fact_at_least(facts, "discount", 3, "R")).alias("in_favour"), F.sum(selection.fact_bucket(facts, "discount")).alias("buckets"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F')""")
def membership_filter(spark, sf):
    member = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("split"))
    return selection.members(table(spark, sf, "customer").select("c_custkey"), member, "c_custkey", "5-LOW", "F")


@query("""WITH x AS (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later, o_orderstatus, o_orderpriority FROM orders)
    SELECT o_orderkey, CASE WHEN later IS NOT NULL THEN 'SUPERSEDED' ELSE o_orderstatus END AS state FROM x WHERE lower(o_orderpriority) LIKE '%urgent%'""")
def findings_superseded(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("state"), "o_orderpriority")
    before = selection.supersession(orders, "o_custkey", "o_orderkey", "o_orderkey").where("supersedes is not null").select(F.col("supersedes").alias("o_orderkey"))
    return selection.findings(orders, before, "o_orderkey", text="URGENT").select("o_orderkey", "state")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM'""")
def matrix_state_filter(spark, sf):
    return selection.in_state(table(spark, sf, "orders"), o_orderstatus="P", o_orderpriority="3-MEDIUM", o_custkey=None).select("o_orderkey")


@query("""SELECT count(*) AS n, count(v) FILTER (v BETWEEN 10 AND 90) AS bounded, sum(v) FILTER (v BETWEEN 10 AND 90)::BIGINT AS total, count(*) FILTER (event_type IN ('click', 'view')) AS chosen
    FROM (SELECT event_type, TRY_CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INT) AS v FROM events)""")
def switch_coercion(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.regexp_extract("props", r'"k": (\d+)', 1).alias("raw"))
    v = selection.coerced(F.col("raw"), "int", 10, 90)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("bounded"), F.sum(v).alias("total"), F.count(selection.coerced(F.col("event_type"), "string", choices=["click", "view"])).alias("chosen"))


@query("""SELECT tags, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN l_discount > 0.05 THEN 'deep' END, CASE WHEN l_returnflag = 'R' THEN 'uniform' END, CASE WHEN l_tax = 0 THEN 'audit' END) AS tags FROM lineitem) GROUP BY 1""")
def tag_lists(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_discount") > 0.05).alias("deep"), (F.col("l_returnflag") == "R").alias("uniform"), (F.col("l_tax") == 0).alias("audit"))
    return rows.select(F.array_join(selection.arm_tags(["deep", "uniform", "audit"]), ",").alias("tags")).groupBy("tags").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT user_id, list({'nodeBudget': floor(value)::INT % 3, 'v': value} ORDER BY event_id) AS b, list(event_type ORDER BY event_id) AS t FROM events GROUP BY 1)
    SELECT user_id, list_filter(b, lambda x: x.nodeBudget = 1)[1].v AS v, CASE WHEN list_contains(t, 'click') THEN 'click' END AS family FROM b""")
def array_lookups(spark, sf):
    entry = F.struct("event_id", (F.floor("value").cast("int") % 3).alias("nodeBudget"), F.col("value").alias("v"), F.col("event_type").alias("family"))
    per = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("b"))
    return per.select("user_id", selection.budget_entry(F.col("b"), 1)["v"].alias("v"), selection.first_of_family(F.col("b"), "click")["family"].alias("family"))


@query("""SELECT sum(CASE WHEN status THEN n ELSE 0 END)::BIGINT AS items, count(*) FILTER (status) AS computed, count(*) FILTER (status AND n = 0) AS empty FROM
    (SELECT o_orderstatus = 'O' AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END AS n FROM orders)""")
def computed_collections(spark, sf):
    items = F.when(F.col("o_orderpriority") == "1-URGENT", F.array("o_orderpriority", "o_orderstatus"))
    rows = table(spark, sf, "orders").select(selection.computed_items(F.when(F.col("o_orderstatus") == "O", F.lit("computed")), items).alias("i"))
    return rows.agg(F.coalesce(F.sum(F.when(F.col("i").isNotNull(), F.size("i"))), F.lit(0)).alias("items"), F.count("i").alias("computed"), F.count_if(F.size("i") == 0).alias("empty"))


@query("""SELECT o_orderkey FROM orders ORDER BY o_orderkey::VARCHAR, o_custkey LIMIT 50""")
def catalog_sorts(spark, sf):
    """A page in the catalog's order by a number, which goes by its text. The limit is the page's."""
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").orderBy(*selection.catalog_order("o_orderkey", "o_custkey")).limit(50).select("o_orderkey")


@query("""SELECT count(*) AS n, sum(coalesce(a, b)) AS total, count(*) FILTER (coalesce(a, b) = 0) AS zeros FROM
    (SELECT CASE WHEN quality = 1 THEN toxic::DOUBLE END AS a, quality::DOUBLE AS b FROM labels)""")
def outcomes(spark, sf):
    rows = table(spark, sf, "labels").select(F.when(F.col("quality") == 1, F.col("toxic").cast("double")).alias("a"), F.col("quality").cast("double").alias("b"))
    o = outcome(F.lit(None).cast("double"), F.col("b"), F.col("a"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(o).alias("total"), F.count_if(o == 0).alias("zeros"))


@query("""SELECT count(*) FILTER (r.k IS NULL) AS only_left, count(*) FILTER (l.k IS NULL) AS only_right, count(*) FILTER (r.k IS NULL) = 0 AS right_holds_left, count(*) FILTER (l.k IS NULL) = 0 AS left_holds_right
    FROM (SELECT DISTINCT o_custkey AS k FROM orders) l FULL JOIN (SELECT DISTINCT c_custkey AS k FROM customer) r ON l.k = r.k""")
def set_containment(spark, sf):
    return stacks.containment(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")


def _fen(rows, queens, rooks, knights, pawns, black):
    """A position with so many white queens, rooks, knights and pawns, and black rooks; kings in the corners of the end ranks."""
    rank = lambda piece, n: F.concat(F.repeat(F.lit(piece), n), (8 - n).cast("string"))
    board = F.concat_ws("/", F.lit("k7"), rank("r", black), rank("P", pawns), rank("N", knights), rank("R", rooks), rank("Q", queens), F.lit("8"), F.lit("7K"))
    side, move = F.when(F.col("o_orderkey") % 2 == 0, "w").otherwise("b"), (F.col("o_custkey") % 90 + 1).cast("string")
    return rows.withColumn("fen", F.when(F.col("o_orderkey") % 13 == 0, board).otherwise(F.concat_ws(" ", board, side, F.lit("- - 0"), move)))


@query("""WITH p AS (SELECT o_orderkey, (o_orderkey % 4)::INT AS q, (o_custkey % 5)::INT AS r, (o_orderkey % 7)::INT AS n, (o_custkey % 8)::INT AS p, (o_orderkey % 3)::INT AS b, o_orderkey % 13 = 0 AS bare, o_custkey % 90 + 1 AS move FROM orders),
    m AS (SELECT *, 900 * q + 500 * r + 320 * n + 500 * b AS heavy, 4 * q + 2 * r + n + 2 * b AS units FROM p)
    SELECT o_orderkey, 900 * q + 500 * r + 320 * n + 100 * p - 500 * b AS balance, CASE WHEN heavy >= 5600 THEN 'opening' WHEN heavy < 2600 THEN 'endgame' ELSE 'middlegame' END AS phase,
    CASE WHEN units >= 22 THEN 'opening' WHEN units <= 8 THEN 'endgame' ELSE 'middlegame' END AS unit_phase, 'Q' || q || 'R' || r || 'B0N' || n || 'P' || p || '/q0r' || b || 'b0n0p0' AS signature,
    'Q' || q || 'R' || r || 'm' || n || 'P' || (p // 3) || '-q0r' || b || 'm0p0' AS bucket, CASE WHEN bare THEN 0 ELSE 2 * (move - 1) + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END END AS ply,
    NOT bare AS well_formed, 2 + q + r + n + p + b AS inputs, s.input_sum, s.input_max
    FROM m JOIN (SELECT o_orderkey, sum(i)::BIGINT AS input_sum, max(i)::INT AS input_max FROM (
        SELECT o_orderkey, CASE WHEN black THEN ((x.plane + 6) % 12) * 64 + 8 * x.rank + f ELSE x.plane * 64 + 8 * (7 - x.rank) + f END AS i FROM (
            SELECT o_orderkey, NOT bare AND o_orderkey % 2 = 1 AS black, x, unnest(range(x.at, x.at + x.k)) AS f FROM (
                SELECT *, unnest([{'plane': 11, 'rank': 0, 'at': 0, 'k': 1}, {'plane': 9, 'rank': 1, 'at': 0, 'k': b}, {'plane': 0, 'rank': 2, 'at': 0, 'k': p}, {'plane': 1, 'rank': 3, 'at': 0, 'k': n},
                    {'plane': 3, 'rank': 4, 'at': 0, 'k': r}, {'plane': 4, 'rank': 5, 'at': 0, 'k': q}, {'plane': 5, 'rank': 7, 'at': 7, 'k': 1}]) AS x FROM m))) GROUP BY 1) s USING (o_orderkey)""")
def position_features(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    part = lambda c, k: F.pmod(c, F.lit(k)).cast("int")
    rows = _fen(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), part(key, 4), part(cust, 5), part(key, 7), part(cust, 8), part(key, 3))
    rows = rows.withColumn("board", positions.board("fen"))
    fen, n, inputs = F.col("fen"), F.col("board.counts"), F.col("board.inputs")
    return rows.select(
        "o_orderkey", positions.material_balance(fen, n).alias("balance"), positions.phase(fen, counts=n).alias("phase"), positions.unit_phase(fen, counts=n).alias("unit_phase"),
        positions.signature(fen, n).alias("signature"), positions.material_bucket(fen, n).alias("bucket"), positions.ply(fen).alias("ply"), F.col("board.well_formed").alias("well_formed"), F.size(inputs).alias("inputs"),
        F.aggregate(inputs, F.lit(0).cast("long"), lambda a, x: a + x).alias("input_sum"), F.array_max(inputs).alias("input_max"),
    )
