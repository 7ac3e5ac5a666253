"""Table functions for SQL: a game's plies and a position's pieces, as ``LATERAL pgn_plies(text)`` and ``LATERAL fen_pieces(fen)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="ply int, move string, result double")
class PgnPlies:
    """A row for each half-move of a game's text, with its number from 1 and the game's result for white; none for null."""

    def eval(self, text: str) -> Iterator[tuple]:
        from quarrymill.sources.readers import parse_game

        game = parse_game(text) if text else None
        for ply, move in enumerate(game[5] if game else (), start=1):
            yield ply, move, game[4]


@udtf(returnType="square string, piece string, input int")
class FenPieces:
    """A row for each piece of a position: its square, its letter, and its index among the 768 inputs from the view of the side to move.

    None for null or a placement that isn't eight ranks of eight squares.
    """

    def eval(self, fen: str) -> Iterator[tuple]:
        from quarrymill.functions.positions import PLANES

        parts = (fen or "").split(" ")
        ranks = parts[0].split("/")
        squares = ["".join("." * int(c) if c in "12345678" else c for c in rank) for rank in ranks]
        if len(ranks) != 8 or any(len(s) != 8 or s.strip(PLANES + ".") for s in squares):
            return
        black = len(parts) > 1 and parts[1] == "b"
        for r, rank in enumerate(squares):
            for f, piece in enumerate(rank):
                if piece != ".":
                    seen = piece.swapcase() if black else piece
                    yield "abcdefgh"[f] + str(8 - r), piece, PLANES.index(seen) * 64 + (r if black else 7 - r) * 8 + f


def register(spark: SparkSession) -> list[str]:
    """Registers them with a session; gives back their names."""
    spark.udtf.register("pgn_plies", PgnPlies)
    spark.udtf.register("fen_pieces", FenPieces)
    return ["pgn_plies", "fen_pieces"]
