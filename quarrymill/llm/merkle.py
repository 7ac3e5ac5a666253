"""Merkle fixity audit of record archives.

Records are laid out in archive files the way WARC does it: each has a header and its payload, and starts at an offset
in its file. A record's leaf is the SHA-256 of its bytes; leaves that follow each other by offset are hashed in ranges
of a fixed number, those ranges again, and so on up to a file's root, and the files' roots up to that of the replica.
Two replicas are compared from the top: only the children of nodes that differ are looked at, so an intact file costs
one comparison, and a corrupt record is found after as many steps as the tree has levels.

The trees are DataFrames of nodes (level, file, place, digest). A record's place is its rank by offset in its file,
and a file holds about a fixed number of records, as archives do: rows that are equal more often than that are dealt
out over several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import Scratch

#: Records that a file holds on average, and children of a node.
FILE_RECORDS = 1000
FAN = 16
#: Up to so many rows that are equal more often than a file holds records are told by a broadcast; more by a shuffle.
BROADCAST_ROWS = 200_000


def warc_record(uri: Column, record_id: Column, payload: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """The bytes of a resource record, as UTF-8; a null part counts as empty. The date is that of the archive, as rows have none."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(record_id.cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """Records of ``pages`` laid out in files: file, place, offset, length, record_id, record.

    The file is a hash of the row; within it records are ordered by key, URI and content. Repeated rows are records of
    their own, next to each other, and those of a row that is there more than ``file_records`` times are dealt out over
    as many files as they fill. Ties are rows that are equal throughout, so their order doesn't matter: the layout
    depends on content alone. Null parts count as empty in a record and are ordered first; other columns are left out,
    and an empty table has no files.
    """
    n_files = max(1, -(-pages.count() // file_records))
    rows = pages.select(F.col(key).alias("record_id"), F.col(uri).alias("__uri"), F.col(payload).alias("__payload"), F.xxhash64(key, uri, payload).alias("__h"))
    often = rows.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > file_records).select("__h")
    n_often = often.limit(BROADCAST_ROWS + 1).count()
    if n_often:
        often = F.broadcast(often) if n_often <= BROADCAST_ROWS else often
        # Rows that fill files are counted and numbered, so a task that runs again deals them out alike.
        copies = rows.join(often, "__h", "left_semi").groupBy("record_id", "__uri", "__payload", "__h").agg(F.count(F.lit(1)).alias("__n"))
        copies = copies.withColumn("__part", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / file_records))))
        of_part = F.least(F.lit(file_records), F.col("__n") - F.col("__part") * file_records).cast("int")
        copies = copies.withColumn("__h", F.xxhash64("__h", "__part")).withColumn("__copy", F.explode(F.array_repeat(F.lit(True), of_part)))
        rows = rows.join(often, "__h", "left_anti").unionByName(copies.select("record_id", "__uri", "__payload", "__h"))
    rows = rows.select("record_id", F.pmod("__h", F.lit(n_files)).alias("file"), "__uri", warc_record(F.col("__uri"), F.col("record_id"), F.col("__payload")).alias("record"))
    rows = rows.withColumn("length", F.octet_length("record").cast("long"))
    order = Window.partitionBy("file").orderBy("record_id", "__uri", F.xxhash64("record"), "record")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", (F.row_number().over(order) - 1).alias("place"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "record_id", "record")


def leaves(records: DataFrame) -> DataFrame:
    """The nodes of level 0: file, place, offset, length, record_id, digest."""
    return records.select("file", "place", "offset", "length", "record_id", F.sha2("record", 256).alias("digest"))


def _parents(nodes: DataFrame, fan: int) -> DataFrame:
    """One level up within files: a digest of the children's places, byte ranges and digests, in order."""
    child = F.struct("place", F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest").alias("c"))
    up = nodes.groupBy("file", F.floor(F.col("place") / fan).cast("int").alias("place")).agg(F.array_sort(F.collect_list(child)).alias("children"), F.min("offset").alias("offset"), F.sum("length").alias("length"))
    return up.select("file", "place", "offset", "length", F.sha2(F.array_join(F.transform("children", lambda x: x["c"]), "|"), 256).alias("digest"))


def tree(leaf_nodes: DataFrame, scratch: Scratch, name: str, fan: int = FAN) -> list[DataFrame]:
    """The levels of a replica's trees, written one by one; the last has one node for each file."""
    levels = [scratch.table(leaf_nodes, f"{name}_0")]
    longest = levels[0].agg(F.max("place")).first()[0]
    while longest:
        levels.append(scratch.table(_parents(levels[-1], fan), f"{name}_{len(levels)}"))
        longest //= fan
    return levels


def root(levels: list[DataFrame], files_a_node: int = 1024) -> str:
    """The root over all files: ranges of files are hashed first, so that the last hash is over few."""
    ranges = levels[-1].groupBy(F.floor(F.col("file") / files_a_node).alias("range")).agg(F.array_sort(F.collect_list(F.struct("file", "digest"))).alias("f"))
    ranges = ranges.select("range", F.sha2(F.array_join(F.transform("f", lambda x: x["digest"]), "|"), 256).alias("digest"))
    return ranges.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "digest"))), lambda x: x["digest"]), "|"), 256)).first()[0]


def audit(ours: list[DataFrame], theirs: list[DataFrame], fan: int = FAN) -> DataFrame:
    """Leaves that differ: file, place, offset, length, record_id, ours, theirs (digests; null where there is none).

    Both trees are descended together, by the nodes whose digests differ. A tree that is lower than the other counts
    its root as a node of the levels above.
    """
    height = max(len(ours), len(theirs))
    at = lambda levels, k: levels[min(k, len(levels) - 1)]
    branch = None
    for k in range(height - 1, -1, -1):
        cols = ["offset", "length", "record_id"] if k == 0 else []
        a = at(ours, k).select("file", "place", F.col("digest").alias("ours"), *(F.col(c).alias(f"{c}_a") for c in cols))
        b = at(theirs, k).select("file", "place", F.col("digest").alias("theirs"), *(F.col(c).alias(f"{c}_b") for c in cols))
        if branch is not None:
            a, b = (x.withColumn("above", F.floor(F.col("place") / fan).cast("int")).join(branch, ["file", "above"], "left_semi") for x in (a, b))
        differ = a.join(b, ["file", "place"], "full").where(~F.col("ours").eqNullSafe(F.col("theirs")))
        branch = differ.select("file", F.col("place").alias("above"))
    merged = [F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in ("offset", "length", "record_id")]
    return differ.select("file", "place", *merged, "ours", "theirs")


def fixity_audit(ours: DataFrame, theirs: DataFrame, scratch: Scratch | None = None, fan: int = FAN) -> DataFrame:
    """Compares two replicas (as archive() lays them out) and returns audit()'s rows; none if the roots agree."""
    scratch = scratch or Scratch(ours.sparkSession)
    a, b = tree(leaves(ours), scratch, "ours", fan), tree(leaves(theirs), scratch, "theirs", fan)
    if root(a, 1024) == root(b, 1024):
        return audit(a[:1], b[:1], fan).where("false")
    return audit(a, b, fan)
