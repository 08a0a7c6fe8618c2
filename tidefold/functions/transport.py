"""Upwind advection and diffusion on a grid whose Y grows northward and X eastward.

``grid_tendency`` works on one small grid in numpy (last axes Y, X); ``tendency_by_window`` gives the same from a
long table with window functions, and ``tendency_by_tiles`` by joins of cells with their neighbours.
"""

from __future__ import annotations

from enum import IntEnum

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Boundary(IntEnum):
    CLOSED = 0
    OPEN = 1
    PERIODIC = 2


#: Side, axis (from the end), step towards the neighbour.
SIDES = {"east": (-1, 1), "west": (-1, -1), "north": (-2, 1), "south": (-2, -1)}


def neighbour(grid: np.ndarray, side: str, bc: int) -> np.ndarray:
    """Each cell's neighbour on one side; at an edge its own value, or the opposite edge if periodic."""
    axis, step = SIDES[side]
    out = np.roll(grid, -step, axis=axis)
    if bc != Boundary.PERIODIC:
        edge = [slice(None)] * grid.ndim
        edge[axis] = -1 if step > 0 else 0
        out[tuple(edge)] = grid[tuple(edge)]
    return out


def boundary_mask(ny: int, nx: int, side: str, bc: int) -> np.ndarray:
    """Zero where a closed edge lets nothing through, one elsewhere."""
    out = np.ones((ny, nx))
    if bc == Boundary.CLOSED:
        axis, step = SIDES[side]
        out[(slice(None), -1 if step > 0 else 0) if axis == -1 else (-1 if step > 0 else 0, slice(None))] = 0.0
    return out


def grid_tendency(state, u, v, D, dx, dy, face_height, face_width, cell_area, mask, bc_north=0, bc_south=0, bc_east=0, bc_west=0):  # noqa: N803
    codes = {"north": bc_north, "south": bc_south, "east": bc_east, "west": bc_west}
    ny, nx = state.shape[-2:]
    wide = np.broadcast_shapes(state.shape, np.shape(mask), np.shape(u))
    grids = {n: np.broadcast_to(g, wide) for n, g in {"c": state, "u": u, "v": v, "dx": dx, "dy": dy, "mask": mask}.items()}
    spread = np.asarray(D, dtype=float)[..., None, None] if np.ndim(D) and np.shape(D)[-2:] != (ny, nx) else np.asarray(D, dtype=float)
    advected, diffused = np.zeros(wide), np.zeros(wide)
    for side, (axis, step) in SIDES.items():
        bc = int(np.ravel(codes[side])[0])
        flow, size, face = ("u", "dx", face_height) if axis == -1 else ("v", "dy", face_width)
        near = {n: neighbour(np.array(grids[n]), side, bc) for n in ("c", "mask", flow, size)}
        face = face * grids["mask"] * near["mask"] * boundary_mask(ny, nx, side, bc)
        speed = 0.5 * (grids[flow] + near[flow])
        upwind = np.where(speed > 0, grids["c"], near["c"]) if step > 0 else np.where(speed > 0, near["c"], grids["c"])
        slope = step * (near["c"] - grids["c"]) / (0.5 * (grids[size] + near[size]))
        advected += step * speed * upwind * face
        diffused += step * -spread * slope * face
    area = np.where(np.asarray(cell_area) > 0, cell_area, 1.0)
    return -advected / area * grids["mask"], -diffused / area * grids["mask"]


def window_neighbour(column: str, side: str, bc: int, keys: list[str]) -> Column:
    """A cell's neighbour by window functions; ``keys`` hold the grid's other dimensions."""
    axis, step = SIDES[side]
    along, across = ("X", "Y") if axis == -1 else ("Y", "X")
    w = Window.partitionBy(*keys, across).orderBy(along)
    near = F.lead(column).over(w) if step > 0 else F.lag(column).over(w)
    if bc == Boundary.PERIODIC:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        edge = F.first(column).over(whole) if step > 0 else F.last(column).over(whole)
    else:
        edge = F.col(column)
    return F.coalesce(near, edge)


def window_boundary_mask(side: str, bc: int, ny: int, nx: int) -> Column:
    if bc != Boundary.CLOSED:
        return F.lit(1.0)
    axis, step = SIDES[side]
    at, last = (F.col("X"), nx - 1) if axis == -1 else (F.col("Y"), ny - 1)
    return F.when(at == (last if step > 0 else 0), 0.0).otherwise(1.0)


FIELDS = ("c", "u", "v", "dx", "dy", "face_height", "face_width", "cell_area", "mask")


def _rates(wide: DataFrame, D: float, bc: dict[str, int], ny: int, nx: int, keys: list[str]) -> DataFrame:  # noqa: N803
    """Tendencies from a table that has each field and, per side, its neighbour as field_side."""
    c, mask = F.col("c"), F.col("mask")
    advected = diffused = F.lit(0.0)
    for side, (axis, step) in SIDES.items():
        flow, size, face = ("u", "dx", "face_height") if axis == -1 else ("v", "dy", "face_width")
        near = lambda n, side=side: F.col(f"{n}_{side}")
        speed = F.lit(0.5) * (F.col(flow) + near(flow))
        up, down = (c, near("c")) if step > 0 else (near("c"), c)
        open_face = F.col(face) * mask * near("mask") * window_boundary_mask(side, bc[side], ny, nx)
        slope = (near("c") - c) / (F.lit(0.5) * (F.col(size) + near(size))) * F.lit(float(step))
        advected = advected + F.lit(float(step)) * speed * F.when(speed > 0, up).otherwise(down) * open_face
        diffused = diffused + F.lit(float(step)) * F.lit(-float(D)) * slope * open_face
    area = F.when(F.col("cell_area") > 0, F.col("cell_area")).otherwise(1.0)
    return wide.select(*keys, "Y", "X", *FIELDS, (-advected / area * mask).alias("advection_rate"), (-diffused / area * mask).alias("diffusion_rate"))


def tendency_by_window(cells: DataFrame, D: float, bc: dict[str, int], ny: int, nx: int, keys: list[str] | None = None) -> DataFrame:  # noqa: N803
    """One row per cell (keys, Y, X and ``FIELDS``) -> the same with advection_rate and diffusion_rate; two shuffles.

    Cells are unique in (keys, Y, X). A cell that is not there is no neighbour: the next one of its row or column counts as
    such. A null in a field makes the rates of its cell and of its neighbours null. Other columns are dropped.
    """
    keys = list(keys or [])
    need = {s: ("c", "mask", *(("u", "dx") if a == -1 else ("v", "dy"))) for s, (a, _) in SIDES.items()}
    wide = cells
    for side in SIDES:
        wide = wide.withColumns({f"{n}_{side}": window_neighbour(n, side, bc[side], keys) for n in need[side]})
    return _rates(wide, D, bc, ny, nx, keys)


def tendency_by_tiles(
    cells: DataFrame, D: float, bc: dict[str, int], ny: int, nx: int, keys: list[str] | None = None, tile: int = 64  # noqa: N803
) -> DataFrame:
    """The same by one shuffle: cells go to their tile, edge cells also to the tiles beyond as a halo one cell wide.

    A tile is computed with windows inside its partition; grids of any size stay spread over tasks. Nulls and cells that are
    not there count as by windows, as far as the tile reaches.
    """
    keys = list(keys or [])

    def place(at: str, n: int, low: int, high: int) -> Column:
        """Where a cell appears along one axis: itself, and copies beyond the edge (own value, or wrapped)."""
        wrap_low, wrap_high = low == Boundary.PERIODIC, high == Boundary.PERIODIC
        copies = F.array(
            F.struct(F.col(at).alias("to"), F.lit(True).alias("own")),
            F.struct(F.when(F.col(at) == (n - 1 if wrap_low else 0), -1).alias("to"), F.lit(False).alias("own")),
            F.struct(F.when(F.col(at) == (0 if wrap_high else n - 1), n).alias("to"), F.lit(False).alias("own")),
        )
        return F.filter(copies, lambda p: p["to"].isNotNull())

    spread = cells.withColumn("px", F.explode(place("X", nx, bc["west"], bc["east"])))
    spread = spread.withColumn("py", F.explode(place("Y", ny, bc["south"], bc["north"]))).where("px.own or py.own")
    around = F.array_distinct(F.array(*[F.floor((F.col("at") + d) / tile).cast("int") for d in (-1, 0, 1)]))
    for axis in "xy":
        spread = spread.withColumn("at", F.col(f"p{axis}.to")).withColumn(f"t{axis}", F.explode(around)).drop("at")
    spread = spread.select(*keys, "tx", "ty", "X", "Y", *FIELDS, F.col("px.to").alias("gx"), F.col("py.to").alias("gy"))
    wide = spread.repartition(*[F.col(k) for k in keys], F.col("tx"), F.col("ty"))
    for side, (axis, step) in SIDES.items():
        along, across = ("gx", "gy") if axis == -1 else ("gy", "gx")
        w = Window.partitionBy(*keys, "tx", "ty", across).orderBy(along)
        names = ("c", "mask", *(("u", "dx") if axis == -1 else ("v", "dy")))
        wide = wide.withColumns({f"{n}_{side}": (F.lead(n) if step > 0 else F.lag(n)).over(w) for n in names})
    inside = f"gx = X and gy = Y and floor(X / {tile}) = tx and floor(Y / {tile}) = ty"
    return _rates(wide.where(inside), D, bc, ny, nx, keys)
