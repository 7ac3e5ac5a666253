"""Features of chess positions in FEN that need no move generator, as column expressions.

``board`` reads a batch of placements at once, on their bytes; what counts pieces takes its counts where they are given,
and else counts letters itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Centipawn values and the order of pieces in a material signature. Fixed values.
VALUES = {"P": 100, "N": 320, "B": 330, "R": 500, "Q": 900}
ORDER = "QRBNP"
PLANES = "PNBRQKpnbrqk"


def field(fen: Column, k: int) -> Column:
    """The k-th field, null if it is missing."""
    return F.get(F.split(fen, " "), k)


def placement(fen: Column) -> Column:
    return F.substring_index(fen, " ", 1)


def side(fen: Column) -> Column:
    """The side to move; white where the field is missing."""
    return F.when(fen.isNotNull(), F.coalesce(field(fen, 1), F.lit("w")))


def _read(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Counts of each piece, inputs with their offsets, and whether a placement is well formed, of a batch of positions."""
    n, data = len(texts), np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data, ends = data[ends[0] : ends[-1]], ends - ends[0]
    row = np.repeat(np.arange(n), np.diff(ends))
    spaces = np.concatenate([[0], np.cumsum(data == 32)])
    placed = spaces[1:] == spaces[ends[:-1]][row]
    # The side to move is the field after the first space.
    gap = np.minimum(np.searchsorted(spaces, spaces[ends[:-1]] + 1) - 1, len(data))
    padded = np.concatenate([data, [32, 32, 32]]).astype(np.uint8)
    sided = (gap + 1 < ends[1:]) & ((padded[gap + 2] == 32) | (gap + 2 >= ends[1:]))
    letter = np.where(sided, padded[gap + 1], 0)
    black = letter == ord("b")
    d, r = data[placed], row[placed]
    plane, width = PLANE_OF[d], WIDTH_OF[d]
    first = np.searchsorted(r, np.arange(n))
    before = np.concatenate([[0], np.cumsum(width)])
    square = before[:-1] - before[first][r]
    counts = np.bincount((r * 12 + plane)[plane >= 0], minlength=12 * n).reshape(n, 12)
    there = (plane >= 0) & (square < 64)
    plane, square, r = plane[there], square[there], r[there]
    swap = black[r]
    index = np.where(swap, (plane + 6) % 12, plane) * 64 + np.where(swap, square, (7 - square // 8) * 8 + square % 8)
    index = index[np.lexsort((index, r))]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))])
    r, square = row[placed], before[:-1] - before[first][row[placed]]
    slash = d == ord("/")
    nth = np.cumsum(slash)
    nth = nth - np.concatenate([[0], nth])[first][r]
    wrong = np.bincount(r[(slash & (square != 8 * nth)) | (BAD[d] & ~slash)], minlength=n) > 0
    total = np.bincount(r, weights=width, minlength=n)
    fine = ~wrong & (np.bincount(r[slash], minlength=n) == 7) & (total == 64) & (counts[:, 5] == 1) & (counts[:, 11] == 1) & ((letter == ord("w")) | black)
    return counts, index, offsets, fine


PLANE_OF, WIDTH_OF, BAD = np.full(256, -1), np.ones(256, np.int64), np.ones(256, bool)
for _k, _c in enumerate(PLANES):
    PLANE_OF[ord(_c)], BAD[ord(_c)] = _k, False
for _k in range(1, 9):
    WIDTH_OF[ord(str(_k))], BAD[ord(str(_k))] = _k, False
WIDTH_OF[ord("/")] = 0


BOARD = T.StructType([T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("inputs", T.ArrayType(T.IntegerType())), T.StructField("well_formed", T.BooleanType())])


@F.arrow_udf(BOARD)
def board(fen: pa.Array) -> pa.Array:
    """A position's counts of pieces in the order of PLANES, its inputs (see ``active_inputs``) and whether it is well formed; null lists for null."""
    fen = fen.combine_chunks() if isinstance(fen, pa.ChunkedArray) else fen
    none = np.asarray(fen.is_null())
    counts, index, offsets, fine = _read(fen.fill_null("").cast(pa.string()))
    n = len(fen)
    lists = lambda at, of: pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(none, False)), pa.array(of, pa.int32()))
    return pa.StructArray.from_arrays([lists(np.arange(0, 12 * n + 1, 12), counts.ravel()), lists(offsets, index), pa.array(fine & ~none)], ["counts", "inputs", "well_formed"])


def count(fen: Column, piece: str, counts: Column | None = None) -> Column:
    """How often a piece letter stands in the placement."""
    if counts is not None:
        return F.get(counts, PLANES.index(piece))
    board = placement(fen)
    return F.length(board) - F.length(F.translate(board, piece, ""))


def material_balance(fen: Column, counts: Column | None = None) -> Column:
    """White's material less black's, in centipawns."""
    return sum(((count(fen, p, counts) - count(fen, p.lower(), counts)) * v for p, v in VALUES.items()), F.lit(0))


def non_pawn_material(fen: Column, counts: Column | None = None) -> Column:
    return sum(((count(fen, p, counts) + count(fen, p.lower(), counts)) * v for p, v in VALUES.items() if p != "P"), F.lit(0))


def phase(fen: Column, opening: int = 5600, endgame: int = 2600, counts: Column | None = None) -> Column:
    n = non_pawn_material(fen, counts)
    return F.when(n >= opening, "opening").when(n < endgame, "endgame").otherwise("middlegame")


def signature(fen: Column, counts: Column | None = None) -> Column:
    """Both sides' material, as Q1R2B2N2P8/q1r2b2n2p8."""
    part = lambda letters: F.concat(*(x for p in letters for x in (F.lit(p), count(fen, p, counts).cast("string"))))
    return F.concat(part(ORDER), F.lit("/"), part(ORDER.lower()))


def ply(fen: Column) -> Column:
    """Half-moves since the start, from the move number (1 where it is missing or no number) and the side to move."""
    return 2 * (F.coalesce(field(fen, 5).try_cast("int"), F.when(fen.isNotNull(), 1)) - 1) + F.when(side(fen) == "b", 1).otherwise(0)


def four_fields(fen: Column) -> Column:
    """Placement, side, castling rights and en-passant square: the position without its clocks."""
    return F.concat_ws(" ", F.slice(F.split(fen, " "), 1, 4))


def is_well_formed(fen: Column) -> Column:
    """Eight ranks of eight squares, one king a side, a side to move."""
    return board(fen)["well_formed"]


def active_inputs(fen: Column) -> Column:
    """The indices of the 768 piece-square inputs from the side to move's view: plane * 64 + square, squares from a1.

    For black, colours are swapped and ranks mirrored. Letters that are no pieces, and what lies beyond 64 squares, have none.
    """
    return board(fen)["inputs"]


def units(fen: Column, counts: Column | None = None) -> Column:
    """Non-pawn units of both sides: 1 for a minor piece, 2 for a rook, 4 for a queen."""
    return sum(((count(fen, p, counts) + count(fen, p.lower(), counts)) * w for p, w in {"N": 1, "B": 1, "R": 2, "Q": 4}.items()), F.lit(0))


def unit_phase(fen: Column, opening: int = 22, endgame: int = 8, counts: Column | None = None) -> Column:
    """The phase by non-pawn units, as funnel runs tell it."""
    n = units(fen, counts)
    return F.when(n >= opening, "opening").when(n <= endgame, "endgame").otherwise("middlegame")


def material_bucket(fen: Column, counts: Column | None = None) -> Column:
    """Both sides' queens, rooks, minor pieces and thirds of up to eight pawns, as Q1R2m4P2-q1r2m4p2."""
    def part(case) -> Column:
        n = lambda p: count(fen, case(p), counts)
        pawns = F.floor(F.least(F.lit(8), n("P")) / 3)
        return F.concat(F.lit(case("Q")), n("Q").cast("string"), F.lit(case("R")), n("R").cast("string"), F.lit("m"), (n("N") + n("B")).cast("string"), F.lit(case("P")), pawns.cast("string"))

    return F.concat(part(str.upper), F.lit("-"), part(str.lower))
