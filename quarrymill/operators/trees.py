"""JSON values of any shape, walked as VARIANT: what they hold, and where two of them differ.

A text is parsed once. A walk is a chain of explodes inside the scan's stage: each level replaces a container by itself
and its children, so a record's nodes are made where the record is, without a shuffle. How deep the chain goes is
measured on the table first (``depth_of``), so no value is too deep. Where two values of a record are compared, VARIANT
gives each text its canonical form, and one small function follows both at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A string of JSON, with its escapes.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
WHOLE, PLACE = re.compile(r"-?\d+\Z"), re.compile(r"\[\d+\]")
NUMBERS = "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"


def depth_of(json: Column) -> Column:
    """How deep a JSON text's lists and objects are nested."""
    brackets = F.regexp_replace(F.regexp_replace(json, F.lit("(?s)" + STRING), F.lit("")), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.coalesce(F.aggregate(F.split(brackets, ""), start, step)["most"], F.lit(0))


def deepest(rows: DataFrame, *json: str) -> int:
    """The greatest depth in any of the columns."""
    return max(x or 0 for x in rows.agg(*(F.max(depth_of(F.col(c))) for c in json)).first())


def _fields(value: Column) -> Column:
    """The entries of a VARIANT that is an object; null for any other."""
    return value.try_cast("map<string,variant>")


def _items(value: Column) -> Column:
    """The entries of a VARIANT that is a list; null for any other."""
    return value.try_cast("array<variant>")


def _under(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _at(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit("["), index.cast("string"), F.lit("]"))


def walk(rows: DataFrame, json: str, skip: Sequence[str] = (), depth: int | None = None) -> DataFrame:
    """A row for each node of the JSON text: the other columns, path, key, value, in_list.

    The root has path "" and a null key, as have entries of lists, whose path ends in ``[index]``. value is a VARIANT.
    Nothing below keys named in ``skip`` (in any letter case) is visited. A null text, or one that is no JSON, has no nodes.
    """
    depth = deepest(rows, json) if depth is None else depth
    body = [c for c in rows.columns if c != json]
    skipped = [s.lower() for s in skip]

    def node(path: Column, key: Column, value: Column, in_list: bool, fresh: Column) -> Column:
        return F.struct(path.alias("path"), key.alias("key"), value.alias("value"), F.lit(in_list).alias("in_list"), fresh.alias("fresh"))

    none = F.lit(None).cast("string")
    now = rows.select(*body, F.try_parse_json(json).alias("__v")).where("__v is not null")
    now = now.select(*body, node(F.lit(""), none, F.col("__v"), False, F.lit(True)).alias("__n"))
    for _ in range(depth):
        n = F.col("__n")
        fields = F.transform(F.map_entries(_fields(n["value"])), lambda e: node(_under(n["path"], e["key"]), e["key"], e["value"], False, ~F.lower(e["key"]).isin(skipped) if skipped else F.lit(True)))
        items = F.transform(_items(n["value"]), lambda x, i: node(_at(n["path"], i), none, x, True, F.lit(True)))
        itself = F.array(n.withField("fresh", F.lit(False)))
        below = F.when(n["fresh"], F.coalesce(fields, items))
        now = now.select(*body, F.explode(F.when(below.isNull(), itself).otherwise(F.concat(itself, below))).alias("__n"))
    return now.select(*body, "__n.path", "__n.key", "__n.value", "__n.in_list")


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (JSON's null), NUMBER."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(name.rlike(NUMBERS), "NUMBER").otherwise(name)


def list_numbers(rows: DataFrame, json: str, key: str) -> DataFrame:
    """(key, numbers): how many numbers stand directly in lists of a record's JSON, at any depth; a bare number counts as one.

    These are the serialised parameters of a model: numbers that are an object's fields, booleans, and digits inside
    strings don't count. Records without any, and with a text that is null or no JSON, have 0.
    """
    nodes = walk(rows.select(key, json), json)
    found = nodes.where((F.col("in_list") | (F.col("path") == "")) & (kind_of(F.col("value")) == "NUMBER")).groupBy(key).agg(F.count(F.lit(1)).alias("numbers"))
    return rows.select(key).distinct().join(found, key, "left").select(key, F.coalesce("numbers", F.lit(0)).alias("numbers"))


#: What a static record may hold, and keys that tell of search, outcome or priority, at any depth and in any letter case. Fixed values.
STATIC_FIELDS = (
    "id", "schemaVersion", "stage", "status", "deterministic_geometry", "bounded_tactical_proof", "taxonomy", "uncomputed", "factsErrors", "factsRegistryVersion", "cost",
)
FORBIDDEN = (
    "search_derived", "scorecp", "scorecpstm", "scorecpwhite", "bestmove", "pv", "mate", "nodes", "qnodes", "depth", "iterations", "stabilization", "trajectory", "telemetry",
    "termination", "resultsource", "wallms", "enginesec", "costnodes", "gameoutcome", "outcome", "oracle", "stockfish", "priority", "traineligible",
)


def leaks(rows: DataFrame, json: str, key: str, forbidden: Sequence[str] = FORBIDDEN, allowed: Sequence[str] | None = STATIC_FIELDS) -> DataFrame:
    """(key, why, path) of each place where a record's JSON holds what it must not.

    ``forbidden``: a key of that name, in any letter case and at any depth, but not below a key ``cost``, which holds
    timings. ``field``: a field of the record itself that isn't among ``allowed`` (None allows all). ``malformed``: the
    text is no JSON. A null text holds nothing.
    """
    nodes = walk(rows.select(key, json), json, skip=("cost",)).where("key is not null")
    words = [w.lower() for w in forbidden]
    bad = F.when(F.lower("key").isin(words), F.lit("forbidden"))
    strange = ~F.col("key").isin(list(allowed)) & (F.col("path") == F.col("key")) if allowed is not None else F.lit(False)
    whys = F.array_compact(F.array(bad, F.when(strange, F.lit("field"))))
    found = nodes.select(key, F.explode(whys).alias("why"), "path")
    broken = rows.where(F.col(json).isNotNull() & F.try_parse_json(json).isNull()).select(key, F.lit("malformed").alias("why"), F.lit("").alias("path"))
    return found.unionByName(broken)


def assert_static(rows: DataFrame, json: str, key: str, forbidden: Sequence[str] = FORBIDDEN, allowed: Sequence[str] | None = STATIC_FIELDS) -> None:
    """Raises ValueError with the sorted paths of the first record, by key, that leaks."""
    found = leaks(rows, json, key, forbidden, allowed)
    first = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("why", "path"))).alias("places")).orderBy(F.asc_nulls_last(key)).limit(1).collect()
    if first:
        by = {}
        for place in first[0]["places"]:
            by.setdefault(place["why"], []).append(place["path"])
        raise ValueError(f"record {first[0][key]!r}: " + "; ".join(f"{why}: {paths}" for why, paths in by.items()))


def _differences(tolerances: Mapping[str, float], root: str, depth: int | None) -> Callable[[str, str], list[str]]:
    """From two JSON texts as Spark writes VARIANTs to the paths where they differ, see ``parity``."""
    given = {k: float(v) for k, v in tolerances.items()}

    def number(value: object) -> float | None:
        return float(value[1]) if isinstance(value, tuple) else float(value) if isinstance(value, bool) else None

    def same(path: str, a: object, b: object) -> bool:
        if type(a) is type(b) and a == b:
            return True
        x, y = number(a), number(b)
        if x is None or y is None:
            return False
        most = given.get(path, given.get(PLACE.sub("[*]", path)))
        if most is not None:
            return abs(x - y) <= most
        # Whole numbers with other digits differ, however large they are; others are compared as numbers.
        return not (isinstance(a, tuple) and isinstance(b, tuple) and WHOLE.match(a[1]) and WHOLE.match(b[1])) and abs(x - y) == 0

    def run(ours: str, theirs: str) -> list[str]:
        if ours == theirs:
            return []
        # A number stays the text that it is, in a tuple, which no other value is.
        load = lambda text: json.loads(text, parse_int=lambda n: ("n", n), parse_float=lambda n: ("n", n))
        out, todo = [], [(root, load(ours), load(theirs), 0)]
        while todo:
            path, a, b, level = todo.pop()
            goes_on = depth is None or level < depth
            if goes_on and isinstance(a, dict) and isinstance(b, dict):
                todo += [(f"{path}.{k}" if path else k, a.get(k), b.get(k), level + 1) for k in a.keys() | b.keys()]
            elif goes_on and isinstance(a, list) and isinstance(b, list):
                if len(a) != len(b):
                    out.append(f"{path}.length({len(a)}!={len(b)})")
                else:
                    todo += [(f"{path}[{i}]", x, y, level + 1) for i, (x, y) in enumerate(zip(a, b))]
            elif not same(path, a, b):
                out.append(path or "<root>")
        return out

    return run


def parity(both: DataFrame, left: str, right: str, tolerances: Mapping[str, float] | None = None, accepted: Sequence[str] = (), root: str = "", depth: int | None = None) -> DataFrame:
    """(other columns, path) for each place where two JSON texts of a row differ.

    Objects are compared key by key, where a missing key is null, and lists of equal length place by place; lists of
    other lengths differ as a whole, with the path ``at.length(n!=m)``. ``tolerances`` gives a path the difference that
    two numbers may have, and infinity asks nothing of numbers; in such a path ``[*]`` stands for any place of a list.
    ``accepted`` paths may differ. Paths begin with ``root``; that of whole values is "<root>". Null texts are equal to
    JSON's null; a text that is no JSON differs from all but its like.
    """
    body = [c for c in both.columns if c not in (left, right)]

    def canonical(c: str) -> Column:
        parsed = F.coalesce(F.try_parse_json(c), F.when(F.col(c).isNotNull(), F.to_variant_object(F.struct(F.col(c).alias("__malformed")))), F.try_parse_json(F.lit("null")))
        return F.to_json(parsed)

    differences = F.udf(_differences(tolerances or {}, root, depth), "array<string>", useArrow=True)
    # Equal texts hold no difference, which spares most records the walk.
    some = both.where(~F.col(left).eqNullSafe(F.col(right)))
    out = some.select(*body, F.explode(differences(canonical(left), canonical(right))).alias("path"))
    return out.where(~F.col("path").isin(list(accepted))) if accepted else out


def keyed_parity(ours: DataFrame, theirs: DataFrame, keys: Sequence[str], json: str, missing: str, **options: object) -> DataFrame:
    """``parity`` of the records that ours and theirs share by ``keys``; of those only ours has, the path ``missing``."""
    right = theirs.select(*keys, F.col(json).alias("__theirs"), F.lit(True).alias("__there"))
    both = ours.select(*keys, F.col(json).alias("__ours")).join(right, list(keys), "left")
    found = parity(both.where("__there").drop("__there"), "__ours", "__theirs", **options)
    return found.unionByName(both.where("__there is null").select(*keys, F.lit(missing).alias("path")))
