"""Hulls of point groups, their overlap, and colours by which overlapping groups differ."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost point."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def side(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and np.cross(np.append(out[-1] - out[-2], 0), np.append(q - out[-2], 0))[2] <= 0:
                out.pop()
            out.append(q)
        return out

    lower, upper = side(p), side(p[::-1])
    return np.array(lower[:-1] + upper[:-1])


def centroid(corners: np.ndarray) -> np.ndarray:
    """Centre of area; of a degenerate polygon the mean of its corners."""
    x, y = corners[:, 0], corners[:, 1]
    xn, yn = np.roll(x, -1), np.roll(y, -1)
    cross = x * yn - xn * y
    area = cross.sum() / 2
    if len(corners) < 3 or abs(area) < 1e-12:
        return corners.mean(axis=0)
    return np.array([((x + xn) * cross).sum(), ((y + yn) * cross).sum()]) / (6 * area)


def overlap(a: np.ndarray, b: np.ndarray) -> bool:
    """True unless a line along an edge of one of two convex polygons has them on different sides."""
    for poly in (a, b):
        edges = np.roll(poly, -1, axis=0) - poly
        normals = np.stack([-edges[:, 1], edges[:, 0]], axis=1)
        pa, pb = a @ normals.T, b @ normals.T
        if ((pa.max(axis=0) < pb.min(axis=0)) | (pb.max(axis=0) < pa.min(axis=0))).any():
            return False
    return True


def hulls(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, corner, px, py): hull corners of each group. Hulls of parts come first, so the last step sees corners only."""
    schema = f"`{group}` {dict(df.dtypes)[group]}, corner int, px double, py double"

    def corners(g, pts):
        h = hull(pts)
        return pd.DataFrame({group: [g] * len(h), "corner": range(len(h)), "px": h[:, 0], "py": h[:, 1]})

    def part(batches):
        for pdf in batches:
            for g, rows in pdf.groupby(group):
                yield corners(g, rows[["px", "py"]].to_numpy(float))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return corners(pdf[group].iloc[0], pdf[["px", "py"]].to_numpy(float))

    points = df.selectExpr(f"`{group}`", f"cast(`{x}` as double) as px", f"cast(`{y}` as double) as py").dropna()
    return points.mapInPandas(part, schema).groupBy(group).applyInPandas(whole, schema)


def colours(corners: DataFrame, group: str, palette: int = 10, apart: int = 2) -> DataFrame:
    """(group, colour): groups from left to right, each with the colour nearest to its place that is `apart` from those of
    overlapping groups, or the least used one where there is none. One row a group: meant for as many as a plot can show."""

    def give(pdf: pd.DataFrame) -> pd.DataFrame:
        polys = {g: rows.sort_values("corner")[["px", "py"]].to_numpy() for g, rows in pdf.groupby(group)}
        order = sorted(polys, key=lambda g: (centroid(polys[g])[0], str(g)))
        done: dict = {}
        for i, g in enumerate(order):
            want = round(i * (palette - 1) / max(1, len(order) - 1))
            near = [done[o] for o in done if overlap(polys[g], polys[o])]
            gaps = [min((abs(c - n) for n in near), default=palette) for c in range(palette)]
            for least in range(apart, -1, -1):
                free = [c for c in range(palette) if gaps[c] >= least]
                if free:
                    done[g] = min(free, key=lambda c: (abs(c - want), list(done.values()).count(c), c))
                    break
        return pd.DataFrame({group: list(done), "colour": list(done.values())})

    return corners.groupBy().applyInPandas(give, f"`{group}` {dict(corners.dtypes)[group]}, colour int")
