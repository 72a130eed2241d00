"""Blocked all-pairs work.

Rows are packed into tiles of a few hundred vectors, and tiles are dealt over
blocks on a grid. A task takes one block of either side, computes its pairs of
tiles with NumPy, and only the reduced answer leaves it. So a row is sent to as
many blocks as lie on the other side: a fixed number until blocks are full.
Tiles are hash-made, so their size does not depend on how the data is skewed.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nucleoflow.session import materialize

TILE_ROWS = 256
#: Blocks on a side while they are not full, tiles of a full one, and rows that a pair of blocks holds before it combines them.
SIDE = 8
BLOCK_TILES = 128
HELD_ROWS = 200_000
#: Tiles of a block whose pairs all leave the task.
PAIR_TILES = 4
#: Tiles of a stored partition from which pairs leave one by one.
READ_TILES = 16


def tile_count(df: DataFrame, rows: int = TILE_ROWS) -> int:
    return max(1, math.ceil(df.count() / rows))


def pack(df: DataFrame, key: str, fields: dict[str, Column], tiles: int) -> DataFrame:
    """(tile, key array, one array per field), in key order inside a tile."""
    tile = F.pmod(F.xxhash64(key), F.lit(tiles)).cast("int")
    row = F.struct(F.col(key).alias("k"), *[c.alias(n) for n, c in fields.items()])
    packed = df.select(tile.alias("tile"), row.alias("r")).groupBy("tile").agg(
        F.array_sort(F.collect_list("r")).alias("rows")
    )
    return packed.select(
        "tile",
        F.col("rows.k").alias("k"),
        *[
            F.flatten(f"rows.{n}").alias(n) if _is_array(df, c) else F.col(f"rows.{n}").alias(n)
            for n, c in fields.items()
        ],
    )


def _is_array(df: DataFrame, c: Column) -> bool:
    return df.select(c.alias("x")).dtypes[0][1].startswith("array")


def block_counts(left: int, right: int, most: int = BLOCK_TILES) -> tuple[int, int]:
    """Blocks on each side, for so many tiles: about SIDE x SIDE, the longer side cut finer, none above ``most`` tiles."""

    def side(mine: int, other: int) -> int:
        fair = round(SIDE * math.sqrt(mine / other))
        return max(min(max(fair, 1), mine), math.ceil(mine / most))

    return side(left, right), side(right, left)


def dealt(left: DataFrame, right: DataFrame, left_blocks: int, right_blocks: int, upper_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides (rows with ``tile``) once for each block (i, j) that they are in; with ``upper_only`` i <= j.

    Columns get prefixes ``l_`` and ``r_``, so that the sides may come from one table.
    """
    left = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    i, j = F.pmod("l_tile", F.lit(left_blocks)), F.pmod("r_tile", F.lit(right_blocks))
    first = F.col("i") if upper_only else F.lit(0)
    last = F.col("j") if upper_only else F.lit(left_blocks - 1)
    l = left.withColumn("i", i).withColumn("j", F.explode(F.sequence(first, F.lit(right_blocks - 1))))
    r = right.withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), last)))
    return l, r


def reduce_blocks(
    left: DataFrame,
    right: DataFrame,
    left_tiles: int,
    right_tiles: int,
    kernel: Callable[[tuple], pd.DataFrame | None],
    schema: str,
    upper_only: bool = False,
    combine: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """What ``kernel`` returns for every left tile beside every right tile, as one table.

    With ``upper_only`` both sides are the same table, and each pair of tiles is
    taken once. A task takes a block of left and a block of right tiles, so a
    tile is sent to as many blocks as there are on the other side, not to as
    many tiles. ``kernel`` gets one row with columns ``l_`` and ``r_``;
    ``combine`` reduces what the pairs of one left tile have returned so far;
    without it blocks are small, as every row is held until the block is done.
    """
    lb, rb = block_counts(left_tiles, right_tiles, PAIR_TILES if combine is None else BLOCK_TILES)
    l, r = dealt(left, right, lb, rb, upper_only)
    sides = [f"l_{c}" for c in left.columns], [f"r_{c}" for c in right.columns]
    pair = namedtuple("pair", sides[0] + sides[1])
    empty = pd.DataFrame(columns=[part.split()[0] for part in schema.split(", ")])

    def run(key: tuple, ls: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        rs = list(rs[sides[1]].itertuples(index=False, name=None))
        out = []
        at = sides[0].index("l_tile"), sides[1].index("r_tile")
        for l_row in ls[sides[0]].itertuples(index=False, name=None):
            held, rows = [], 0
            for r_row in rs:
                if upper_only and key[0] == key[1] and l_row[at[0]] > r_row[at[1]]:
                    continue
                found = kernel(pair(*l_row, *r_row))
                if found is None or not len(found):
                    continue
                held.append(found)
                rows += len(found)
                if combine is not None and rows > HELD_ROWS:
                    held = [combine(pd.concat(held))]
                    rows = len(held[0])
            if held:
                whole = pd.concat(held) if len(held) > 1 else held[0]
                out.append(whole if combine is None else combine(whole))
        return pd.concat(out) if out else empty

    return l.groupBy("i", "j").cogroup(r.groupBy("i", "j")).applyInPandas(run, schema)


def every_pair(
    left: DataFrame, right: DataFrame, left_tiles: int, right_tiles: int, kernel: Callable[[tuple], pd.DataFrame | None], schema: str
) -> DataFrame:
    """What ``kernel`` returns for every left tile beside every right tile, where rows are as many as pairs.

    Each side is stored once. A task reads a partition of either side from
    there, and what a pair gives leaves the task before the next: no side is
    copied to blocks, and no block of results is held.
    """
    lb, rb = block_counts(left_tiles, right_tiles, READ_TILES)
    l = materialize(left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).repartition(lb))
    r = materialize(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).repartition(rb))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False, name="pair"):
                found = kernel(row)
                if found is not None and len(found):
                    yield found

    # the size of arrays is guessed too low, so neither side may be sent to all
    return l.hint("shuffle_replicate_nl").crossJoin(r).mapInPandas(run, schema)


def matrix(flat, n: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(n, -1)


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by coordinate differences: no cancellation for close points."""
    out = np.zeros((a.shape[0], b.shape[0]))
    diff = np.empty_like(out)
    left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for x, y in zip(left, right, strict=True):
        np.subtract(x[:, None], y[None, :], out=diff)
        np.multiply(diff, diff, out=diff)
        out += diff
    return np.sqrt(out, out=out)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    an = np.linalg.norm(a, axis=1)
    bn = np.linalg.norm(b, axis=1)
    a = a / np.where(an > 0, an, 1.0)[:, None]
    b = b / np.where(bn > 0, bn, 1.0)[:, None]
    return 1.0 - a @ b.T
