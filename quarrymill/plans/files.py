"""Queries that go through files and table functions: the tables' rows written as lines and read back, and positions as pieces."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions import tables
from quarrymill.operators import selection
from quarrymill.operators.freezing import freeze_arms, freeze_universe
from quarrymill.operators.stripes import PLACE, striped_map
from quarrymill.plans.lineage import UNIT32
from quarrymill.plans.registering import registers
from quarrymill.plans.writing import HASH, _fen
from quarrymill.session import Scratch, range_partitions, table
from quarrymill.sources.readers import read_rows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

query = registers(QUERIES, ORACLE_SQL)


def _read_back(spark, rows, order: str, schema: str):
    """rows as JSON lines in files that follow one another in the order, read with their numbers."""
    path = f"{Scratch(spark).root}/lines"
    rows.repartitionByRange(range_partitions(spark), order).sortWithinPartitions(order).write.json(path)
    return read_rows(spark, path, T.StructType.fromDDL(schema))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders QUALIFY row < 1000""")
def first_by_file_order(spark, sf):
    """The first rows of an import, by their number over its files. The number is the feature."""
    rows = _read_back(spark, table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_orderkey long, o_custkey long")
    return selection.first_rows(rows, "row", 1000).select("o_orderkey", "row")


@query("""WITH s AS (SELECT o_orderstatus AS source, o_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus IN ('F', 'O', 'P'))
    SELECT source, count(*) AS rows, count(DISTINCT CASE WHEN k <= 2000 THEN o_custkey END) AS counted FROM s GROUP BY 1""")
def capped_counting(spark, sf):
    """Each source is an import of its own, counted over its first rows as its files have them."""
    orders, parts = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), []
    for status in ("F", "O", "P"):
        rows = _read_back(spark, orders.where(F.col("o_orderstatus") == status), "o_orderkey", "o_orderkey long, o_custkey long")
        parts.append(rows.select(F.lit(status).alias("source"), "row", "o_custkey"))
    return selection.capped_distinct(parts[0].unionByName(parts[1]).unionByName(parts[2]), "source", "row", F.col("o_custkey"), 2000)


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' '), lambda x: x <> '') AS w FROM conversations)
    SELECT conv_id, turn, unnest(range(1, len(w) + 1))::INT AS ply, unnest(w) AS move, 1.0::DOUBLE AS result FROM w""")
def plies_lateral(spark, sf):
    """Turns written as games, with each half-move a row, by a table function in SQL."""
    tables.register(spark)
    games = table(spark, sf, "conversations")
    game = F.concat(F.lit('[Event "x"]\n[Result "1-0"]\n\n1. '), F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(" {a comment} 1-0"))
    games.select("conv_id", "turn", game.alias("game")).createOrReplaceTempView("__games")
    return spark.sql("SELECT conv_id, turn, ply, move, result FROM __games, LATERAL pgn_plies(game)")


@query("""WITH m AS (SELECT o_orderkey, o_orderkey % 13 <> 0 AND o_orderkey % 2 = 1 AS black, unnest([{'plane': 11, 'rank': 0, 'at': 0, 'k': 1}, {'plane': 9, 'rank': 1, 'at': 0, 'k': (o_orderkey % 3)::INT}, {'plane': 0, 'rank': 2, 'at': 0, 'k': (o_custkey % 8)::INT},
        {'plane': 1, 'rank': 3, 'at': 0, 'k': (o_orderkey % 7)::INT}, {'plane': 3, 'rank': 4, 'at': 0, 'k': (o_custkey % 5)::INT}, {'plane': 4, 'rank': 5, 'at': 0, 'k': (o_orderkey % 4)::INT}, {'plane': 5, 'rank': 7, 'at': 7, 'k': 1}]) AS x FROM orders),
    s AS (SELECT o_orderkey, black, x, unnest(range(x.at, x.at + x.k)) AS f FROM m)
    SELECT o_orderkey, substr('abcdefgh', f + 1, 1) || (8 - x.rank) AS square, substr('PNBRQKpnbrqk', x.plane + 1, 1) AS piece,
        (CASE WHEN black THEN ((x.plane + 6) % 12) * 64 + 8 * x.rank + f ELSE x.plane * 64 + 8 * (7 - x.rank) + f END)::INT AS input FROM s""")
def pieces_lateral(spark, sf):
    """Each piece of each position with its square and its input's index, by a table function in SQL."""
    tables.register(spark)
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    part = lambda c, k: F.pmod(c, F.lit(k)).cast("int")
    rows = _fen(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), part(key, 4), part(cust, 5), part(key, 7), part(cust, 8), part(key, 3))
    rows.select("o_orderkey", "fen").createOrReplaceTempView("__positions")
    return spark.sql("SELECT o_orderkey, square, piece, input FROM __positions, LATERAL fen_pieces(fen)")


@query(f"""WITH s AS (SELECT CASE o_orderkey % 10 WHEN 1 THEN 'PRIORITY' ELSE 'UNIFORM' END AS arm, o_orderkey, 1000 + o_orderkey % 3 AS nodes, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, {UNIT32.format("'5:c' || o_custkey")} AS u FROM orders WHERE o_orderkey % 10 IN (1, 2)))
    SELECT arm, split, count(*) AS rows, sum(nodes)::BIGINT AS nodes, {HASH.format("o_orderkey::VARCHAR")} AS ids_hash FROM s GROUP BY 1, 2""")
def frozen_arms(spark, sf):
    """A universe of all orders and two recorded arms of it, frozen, written, and read back against the universe's splits."""
    orders, key, scratch = table(spark, sf, "orders"), F.col("o_orderkey"), Scratch(spark)
    candidates = orders.select(key.alias("record_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("group"), F.lit(True).alias("train_eligible"))
    deep = orders.select(key.alias("record_id"), (1000 + key % 3).alias("nodes"))
    chosen = orders.where(key % 10 < 3).where(key % 10 > 0).select(F.when(key % 10 == 1, "PRIORITY").otherwise("UNIFORM").alias("arm"), key.alias("record_id"))
    universe = freeze_universe(candidates, deep, chosen, 5, scratch=scratch)
    return freeze_arms(universe, orders.select(key.alias("record_id"), "o_totalprice"), f"{scratch.root}/datasets", 0.01)


@query("""SELECT o_orderkey, o_custkey * 2 AS twice FROM orders""")
def striped_orders(spark, sf):
    """Rows worked on in stripes and given back in their order."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return striped_map(rows, ["o_orderkey"], lambda df: df.select("o_orderkey", (F.col("o_custkey") * 2).alias("twice"), PLACE))
