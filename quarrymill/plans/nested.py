"""Queries over JSON of any shape, made of the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.operators import trees
from quarrymill.plans.registering import registers
from quarrymill.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

query = registers(QUERIES, ORACLE_SQL)

#: An order as a record, in the words of both engines: escaped quotes, timings, forbidden keys in odd letter case, nested lists.
RECORD = """'{"id":"' || o_orderkey || '","status":"say ' || chr(92) || '"pv' || chr(92) || '": ' || (o_custkey % 7) || ' [9]","cost":{"nodes":' || o_custkey || ',"w":[1]},"taxonomy":{"w":[[' || o_custkey || ',true,2.5],{"deep":['
    || (o_orderkey % 5) || ',"8"],"plain":3}],"n":4' || CASE WHEN o_orderkey % 13 = 0 THEN ',"Nodes":[1]' ELSE '' END || '}' || CASE WHEN o_orderkey % 17 = 0 THEN ',"extra":{"bestMove":[]}' ELSE '' END || '}'"""

#: The nodes of RECORD: a row for each, with its path, key and whether it stands in a list.
WALK_SQL = f"""w(id, path, key, v, in_list) AS (
    SELECT o_orderkey, '', NULL::VARCHAR, ({RECORD})::JSON, false FROM orders
    UNION ALL
    SELECT id, CASE WHEN t = 'ARRAY' THEN path || '[' || k || ']' WHEN path = '' THEN k ELSE path || '.' || k END, CASE WHEN t = 'OBJECT' THEN k END,
           CASE WHEN t = 'ARRAY' THEN json_extract(v, '$[' || k || ']') ELSE json_extract(v, '$."' || k || '"') END, t = 'ARRAY'
    FROM (SELECT *, unnest(CASE t WHEN 'OBJECT' THEN json_keys(v) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda x: x::VARCHAR) ELSE [] END) AS k
          FROM (SELECT *, json_type(v) AS t FROM w WHERE @VISITED)))"""


def _records(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(RECORD).alias("json"))


@query(f"""WITH RECURSIVE {WALK_SQL.replace("@VISITED", "key IS NULL OR lower(key) <> 'cost'")}
    SELECT id AS o_orderkey, 'forbidden' AS why, path FROM w WHERE lower(key) IN ('nodes', 'bestmove', 'pv', 'depth')
    UNION ALL SELECT id, 'field', path FROM w WHERE key = path AND key = 'extra'""")
def leak_guard(spark, sf):
    return trees.leaks(_records(spark, sf), "json", "o_orderkey")


@query(f"""WITH RECURSIVE {WALK_SQL.replace("@VISITED", "true")}
    SELECT id AS o_orderkey, count(*) FILTER (in_list AND json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS numbers FROM w GROUP BY 1""")
def numeric_leaf_count(spark, sf):
    return trees.list_numbers(_records(spark, sf), "json", "o_orderkey")


#: Two searches of an order: the second has other timings, now and then another score, line, budget list or no line at all.
def _search(ms: str, cp: str, move: str, nodes: str, more: str, last: str) -> str:
    return f"""'{{"timeMs":' || {ms} || ',"score":{{"cp":' || {cp} || ',"mate":null}},"pv":["e4","' || {move} || '"],"runs":[{{"nodes":[' || o_custkey || ',' || {nodes} || ']}}' || {more} || ']' || {last} || '}}'"""


OURS = _search("(o_orderkey % 9)", "(o_custkey % 300)", "'e5'", "10", "''", "',\"depth\":5'")
THEIRS = _search(
    "(o_orderkey % 8)",
    "(o_custkey % 300 + CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 5 = 1 THEN 1 ELSE 0 END) || '.0'",
    "CASE WHEN o_orderkey % 7 = 0 THEN 'c5' ELSE 'e5' END",
    "CASE WHEN o_orderkey % 3 = 0 THEN '11' ELSE '10' END",
    "CASE WHEN o_orderkey % 11 = 0 THEN ',{}' ELSE '' END",
    "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE ',\"depth\":5' END",
)


@query(f"""WITH RECURSIVE w(id, path, a, b) AS (
        SELECT o_orderkey, 'tier1', ({OURS})::JSON, ({THEIRS})::JSON FROM orders
        UNION ALL
        SELECT id, CASE WHEN t = 'ARRAY' THEN path || '[' || k || ']' ELSE path || '.' || k END,
               coalesce(CASE WHEN t = 'ARRAY' THEN json_extract(a, '$[' || k || ']') ELSE json_extract(a, '$."' || k || '"') END, 'null'::JSON),
               coalesce(CASE WHEN t = 'ARRAY' THEN json_extract(b, '$[' || k || ']') ELSE json_extract(b, '$."' || k || '"') END, 'null'::JSON)
        FROM (SELECT *, unnest(CASE WHEN t = 'OBJECT' THEN list_distinct(json_keys(a) || json_keys(b)) ELSE list_transform(range(json_array_length(a)::BIGINT), lambda x: x::VARCHAR) END) AS k
              FROM (SELECT *, json_type(a) AS t FROM w) WHERE t IN ('OBJECT', 'ARRAY') AND json_type(b) = t AND NOT (t = 'ARRAY' AND json_array_length(a) <> json_array_length(b)))),
    e AS (SELECT *, json_type(a) AS t, json_type(b) AS u, TRY_CAST(a::VARCHAR AS DOUBLE) AS x, TRY_CAST(b::VARCHAR AS DOUBLE) AS y FROM w)
    SELECT id AS o_orderkey, path || '.length(' || json_array_length(a) || '!=' || json_array_length(b) || ')' AS path FROM e WHERE t = 'ARRAY' AND u = 'ARRAY' AND json_array_length(a) <> json_array_length(b)
    UNION ALL
    SELECT id, path FROM e WHERE NOT (t = u AND t IN ('OBJECT', 'ARRAY'))
        AND CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN abs(x - y) > CASE WHEN path = 'tier1.timeMs' THEN 'inf'::DOUBLE WHEN path = 'tier1.score.cp' THEN 2 WHEN path LIKE 'tier1.runs[%].nodes[%]' THEN 0.5 ELSE 0 END
                 ELSE a::VARCHAR <> b::VARCHAR END""")
def parity_paths(spark, sf):
    """Where two searches of a record differ: timings don't count, scores may be 2 apart."""
    both = table(spark, sf, "orders").select("o_orderkey", F.expr(OURS).alias("ours"), F.expr(THEIRS).alias("theirs"))
    return trees.parity(both, "ours", "theirs", {"tier1.timeMs": float("inf"), "tier1.score.cp": 2, "tier1.runs[*].nodes[*]": 0.5}, root="tier1")
