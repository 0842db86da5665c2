"""Planar hexagon lattice as column arithmetic.

Five levels (r6 coarse .. r10 fine), seven children per cell, six neighbours. A cell is a pair
of integers (i, j) on axes 120 degrees apart; its text id is ``res:i:j``. Ids are lattice ids,
not codes of any geocoding library. Parents are integer maps, so a coarser cell never needs the
coordinate again. Two mirrored parent maps alternate, which keeps every second level aligned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from hexlytics import constants as K

FINEST = K.RESOLUTIONS[-1]
ROOT3 = math.sqrt(3.0)


def _nearest(value: Column) -> Column:
    return F.floor(value + F.lit(0.5))


def _lean_right(child_res: int) -> bool:
    """Which of the two mirrored maps joins ``child_res`` to the level above."""
    return child_res in (10, 8)


def parent(i: Column, j: Column, child_res: int) -> tuple[Column, Column]:
    """Cell one level coarser. Sevenths are never halves, so rounding has no ties."""
    if _lean_right(child_res):
        return _nearest((3 * i - j) / 7.0), _nearest((i + 2 * j) / 7.0)
    return _nearest((2 * i + j) / 7.0), _nearest((3 * j - i) / 7.0)


def centre_child(i: Column, j: Column, parent_res: int) -> tuple[Column, Column]:
    """The child whose centre is the parent's centre."""
    if _lean_right(parent_res + 1):
        return 2 * i + j, 3 * j - i
    return 3 * i - j, i + 2 * j


def cell_id(res, i: Column, j: Column) -> Column:
    level = F.lit(res) if isinstance(res, int) else res
    return F.when(i.isNotNull() & j.isNotNull(), F.concat_ws(":", level, i, j))


def id_part(cell: Column, position: int) -> Column:
    """1 = level, 2 = i, 3 = j of a text id."""
    return F.split_part(cell, F.lit(":"), F.lit(position)).cast("bigint")


def inside_cell_box(lat: Column, lon: Column) -> Column:
    return lat.between(*K.CELL_BOX["lat"]) & lon.between(*K.CELL_BOX["lon"])


def radius_km(res: int) -> float:
    return K.FINEST_RADIUS_KM * math.sqrt(7.0) ** (FINEST - res)


def nearest_cell(x: Column, y: Column, radius: float) -> tuple[Column, Column]:
    """Nearest lattice cell of a plane point; null in, null out.

    A point lies in a cell when its three differences of cube coordinates are each within 1 of
    the cell's. Their floors leave three consecutive candidates for three times a coordinate,
    and one of those is a multiple of three.
    """
    across = x / F.lit(radius * ROOT3)
    up = y / F.lit(radius)
    right, left, double = F.floor(across + up), F.floor(across - up), F.floor(across * -2.0)
    return (
        F.floor((right - double + 1) / 3.0),
        -F.floor((left - right + 1) / 3.0),
    )


def locate(df: DataFrame, i: str, j: str, lat: str = "latitude", lon: str = "longitude",
           res: int = FINEST) -> DataFrame:
    """Direct assignment at one level (any level, not by way of parents of the finest)."""
    lat0, lon0 = K.CITY_CENTRE
    ok = inside_cell_box(F.col(lat), F.col(lon))
    plane = df.select(
        *df.columns,
        F.when(ok, (F.col(lon) - F.lit(lon0)) * F.lit(K.KM_PER_LON)).alias("_x"),
        F.when(ok, (F.col(lat) - F.lit(lat0)) * F.lit(K.KM_PER_LAT)).alias("_y"),
    )
    x, y = F.col("_x"), F.col("_y")
    if rotation(res):
        # Every second level is turned against the finest one; undo the turn first.
        cos, sin = math.cos(rotation(res)), math.sin(rotation(res))
        x, y = x * F.lit(cos) + y * F.lit(sin), y * F.lit(cos) - x * F.lit(sin)
    cell_i, cell_j = nearest_cell(x, y, radius_km(res))
    return plane.select(*df.columns, cell_i.alias(i), cell_j.alias(j))


def with_levels(df: DataFrame, i: str = "_i", j: str = "_j") -> DataFrame:
    """Add ``i{r}``/``j{r}`` for every level from the finest pair (``i``, ``j``)."""
    kept = [c for c in df.columns if c not in (i, j)]
    out = df.select(*kept, F.col(i).alias(f"i{FINEST}"), F.col(j).alias(f"j{FINEST}"))
    for res in range(FINEST - 1, K.RESOLUTIONS[0] - 1, -1):
        up_i, up_j = parent(F.col(f"i{res + 1}"), F.col(f"j{res + 1}"), res + 1)
        out = out.select("*", up_i.alias(f"i{res}"), up_j.alias(f"j{res}"))
    return out


def assign_cells(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Text ids ``h3_r6`` .. ``h3_r10``: place once at the finest level, then take parents."""
    kept = [c for c in df.columns if c not in {f"h3_r{r}" for r in K.RESOLUTIONS}]
    placed = with_levels(locate(df.select(*kept), "_i", "_j", lat, lon))
    return placed.select(
        *kept,
        *[
            cell_id(r, F.col(f"i{r}"), F.col(f"j{r}")).alias(f"h3_r{r}")
            for r in K.RESOLUTIONS
        ],
    )


def ring_offsets(k: int) -> list[tuple[int, int]]:
    """All (di, dj) within lattice distance k, the cell itself included."""
    span = range(-k, k + 1)
    return [(a, b) for a in span for b in span if abs(a - b) <= k]


def ring(i: Column, j: Column, k: int) -> Column:
    """Array of the cells within distance k, for ``explode``."""
    return F.array(
        *[
            F.struct((i + F.lit(a)).alias("i"), (j + F.lit(b)).alias("j"))
            for a, b in ring_offsets(k)
        ]
    )


def ring_cells(df: DataFrame, res: str, i: str, j: str, k: int) -> DataFrame:
    """One row per (cell, neighbour) with neighbour columns ``ni``, ``nj``."""
    return df.withColumn("_n", F.explode(ring(F.col(i), F.col(j), k))).select(
        *df.columns, F.col("_n.i").alias("ni"), F.col("_n.j").alias("nj")
    )


def rotation(res: int) -> float:
    """Turn of a level against the finest one, in radians."""
    return -math.atan2(ROOT3, 5.0) if (FINEST - res) % 2 else 0.0


def with_centre(df: DataFrame, res: Column, i: Column, j: Column) -> DataFrame:
    """Add ``lat``, ``lon`` of the cell centre by walking centre children to the finest level."""
    kept = [c for c in df.columns if c not in ("lat", "lon")]
    out = df.select(*kept, res.alias("_r"), i.alias("_ci"), j.alias("_cj"))
    for level in K.RESOLUTIONS[:-1]:
        down_i, down_j = centre_child(F.col("_ci"), F.col("_cj"), level)
        step = F.col("_r") <= F.lit(level)
        out = out.select(
            *kept, "_r",
            F.when(step, down_i).otherwise(F.col("_ci")).alias("_ci"),
            F.when(step, down_j).otherwise(F.col("_cj")).alias("_cj"),
        )
    lat0, lon0 = K.CITY_CENTRE
    x = F.lit(K.FINEST_RADIUS_KM * ROOT3) * (F.col("_ci") - F.col("_cj") / 2.0)
    y = F.lit(1.5 * K.FINEST_RADIUS_KM) * F.col("_cj")
    return out.select(
        *kept,
        (F.lit(lat0) + y / F.lit(K.KM_PER_LAT)).alias("lat"),
        (F.lit(lon0) + x / F.lit(K.KM_PER_LON)).alias("lon"),
    )


def id_centre(df: DataFrame, cell: str) -> DataFrame:
    """``with_centre`` for a text id column."""
    c = F.col(cell)
    return with_centre(df, id_part(c, 1), id_part(c, 2), id_part(c, 3))


def vertices(res: int, lat: Column, lon: Column) -> list[tuple[Column, Column]]:
    """The six corners (lat, lon) of a cell of level ``res`` from its centre."""
    out = []
    for k in range(6):
        angle = math.radians(30 + 60 * k) + rotation(res)
        out.append(
            (
                lat + F.lit(radius_km(res) * math.sin(angle) / K.KM_PER_LAT),
                lon + F.lit(radius_km(res) * math.cos(angle) / K.KM_PER_LON),
            )
        )
    return out


def boundary_points(df: DataFrame, cell: str, res: int) -> DataFrame:
    """One row per corner, first corner repeated at the end: ``vertex``, ``lat``, ``lon``."""
    kept = [c for c in df.columns if c not in ("lat", "lon")]
    corners = vertices(res, F.col("lat"), F.col("lon"))
    points = [
        F.struct(F.lit(n).alias("vertex"), a.alias("lat"), o.alias("lon"))
        for n, (a, o) in enumerate([*corners, corners[0]])
    ]
    return (
        id_centre(df, cell)
        .withColumn("_p", F.explode(F.array(*points)))
        .select(*kept, "_p.vertex", "_p.lat", "_p.lon")
    )


def geojson_features(df: DataFrame, cell: str, res: int, digits: int = 6) -> DataFrame:
    """One GeoJSON feature text per cell, closed ring, longitude first."""
    kept = [c for c in df.columns if c not in ("lat", "lon")]
    fixed = f"decimal({digits + 3},{digits})"
    corners = vertices(res, F.col("lat"), F.col("lon"))
    closed = F.array(
        *[F.array(o.cast(fixed), a.cast(fixed)) for a, o in [*corners, corners[0]]]
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.col(cell).alias("id"),
        F.struct(F.col(cell).alias("h3_id")).alias("properties"),
        F.struct(
            F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates")
        ).alias("geometry"),
    )
    return id_centre(df, cell).select(*kept, F.to_json(feature).alias("feature"))


def feature_collections(df: DataFrame, cell: str, res: int) -> DataFrame:
    """(parent, collection): one FeatureCollection text per parent cell, of at most its seven
    children. ``df`` has each cell once."""
    up_i, up_j = parent(id_part(F.col(cell), 2), id_part(F.col(cell), 3), res)
    features = geojson_features(df.select(cell), cell, res)
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(cell), F.col("feature")))),
        lambda s: s["feature"],
    )
    return features.groupBy(cell_id(res - 1, up_i, up_j).alias("parent")).agg(
        F.concat(
            F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","),
            F.lit("]}"),
        ).alias("collection")
    )
