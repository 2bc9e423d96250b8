"""Directions from delays, and beams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brinewave.functions import kernels

REC = "recording_id"
HALVINGS = 100  # bisection steps on the unit circle: beyond double precision
TINY = 1e-12  # direction components below this are zero, so that their sign does not turn an angle


def _solve_planar(delays: np.ndarray, model: np.ndarray, on_circle: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least-squares (u, v) with u^2 + v^2 <= 1 (or = 1) of model @ (u, v) = delays, row-wise.

    Inside the circle the normal equations give it; on the circle the multiplier,
    counted from the smaller eigenvalue, is bisected along the eigenvectors.
    Returns solutions, squared residuals and which rows lie on the circle.
    """
    values, vectors = np.linalg.eigh(model.T @ model)
    gap = np.array([0.0, values[1] - values[0]])
    g = delays @ model @ vectors
    free = g / values
    solution = free.copy()
    rim = np.ones(len(g), dtype=bool) if on_circle else (free**2).sum(axis=1) > 1
    if rim.any():
        h = g[rim]
        low = np.full(len(h), 0.0 if on_circle else values[0])
        high = np.sqrt((h**2).sum(axis=1)) + values[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(HALVINGS):
                middle = (low + high) / 2
                long = ((h / (middle[:, None] + gap)) ** 2).sum(axis=1) > 1
                low, high = np.where(long, middle, low), np.where(long, high, middle)
            edge = h / (high[:, None] + gap)
        # nothing along the first eigenvector: that component only fills the circle
        flat = h[:, 0] == 0
        edge[flat, 0] = np.sqrt(np.maximum(1 - edge[flat, 1] ** 2, 0))
        solution[rim] = edge / np.sqrt((edge**2).sum(axis=1, keepdims=True))
    solution = solution @ vectors.T
    solution[np.abs(solution) < TINY] = 0.0
    residual = ((delays - solution @ model.T) ** 2).sum(axis=1)
    return solution, residual, rim


def _delay_rows(lists: pa.Array) -> np.ndarray:
    return np.array([r.values.to_numpy(zero_copy_only=False) for r in lists], dtype=float)


def _solver(geometry, fs: float, c: float, ref_channel: int, axis_order: str, on_circle: bool):
    """A column function array<int> -> struct<az, el, residual> for a planar array."""
    rx = np.asarray(geometry, dtype=float)
    sign = -1.0 if axis_order == "xyz" else 1.0
    ref = ref_channel - 1
    model = sign * (rx[:, :2] - rx[ref, :2]) * fs / c

    @F.arrow_udf("struct<az: double, el: double, residual: double>")
    def run(lists: pa.Array) -> pa.Array:
        d = _delay_rows(lists)[:, : len(rx)]
        uv, residual, rim = _solve_planar(d - d[:, [ref]], model, on_circle)
        u, v = uv[:, 0], uv[:, 1]
        rest = np.where(rim, 0.0, np.sqrt(np.maximum(1 - u * u - v * v, 0)))
        if on_circle:  # azimuth only: u = sin, v = cos
            az, el = np.arctan2(u, v), np.zeros(len(u))
        elif axis_order == "xyz":  # x = sin az cos el, y = sin el, z = cos az cos el
            az, el = np.arctan2(u, rest), np.arcsin(np.clip(v, -1, 1))
        else:  # x = sin az cos el, y = cos az cos el, z = sin el
            az, el = np.arctan2(u, v), np.arcsin(rest)
        return pa.StructArray.from_arrays([pa.array(az), pa.array(el), pa.array(residual)], names=["az", "el", "residual"])

    return run


def directions(
    tdoa: DataFrame, geometry, fs: float, c: float = 1540.0, ref_channel: int = 3, cost: str = "azimuth_elevation"
) -> DataFrame:
    """Add az, el and residual: the far-field direction with the least squared delay error.

    cost is 'azimuth_elevation' (front half-space, z ahead), 'azimuth' (in the
    array plane, y ahead) or 'plan' (y ahead, z up). The array must be planar (z = 0).
    """
    if np.any(np.asarray(geometry)[:, 2] != 0):
        return _grid_directions(tdoa, geometry, fs, c, ref_channel)
    order = "xyz" if cost == "azimuth_elevation" else "xzy"
    solve = _solver(geometry, fs, c, ref_channel, order, cost == "azimuth")
    return tdoa.withColumn("_d", solve("delays")).select(*tdoa.columns, "_d.az", "_d.el", "_d.residual")


def _grid_directions(tdoa: DataFrame, geometry, fs, c, ref_channel, step_deg: float = 1.0) -> DataFrame:
    """Arrays that are not planar: best point of a direction grid, then Gauss-Newton steps."""
    rx = np.asarray(geometry, dtype=float)
    ref = ref_channel - 1
    model = -(rx - rx[ref]) * fs / c
    az, el = np.meshgrid(np.radians(np.arange(-180, 180, step_deg)), np.radians(np.arange(-90, 90.1, step_deg)))
    az, el = az.ravel(), el.ravel()

    def vectors(a, e):
        return np.stack([np.sin(a) * np.cos(e), np.sin(e), np.cos(a) * np.cos(e)], axis=-1)

    grid = vectors(az, el) @ model.T
    energy = (grid**2).sum(axis=1)

    @F.arrow_udf("struct<az: double, el: double, residual: double>")
    def run(lists: pa.Array) -> pa.Array:
        d = _delay_rows(lists)[:, : len(rx)]
        d = d - d[:, [ref]]
        best = np.concatenate([(energy - 2 * part @ grid.T).argmin(axis=1) for part in np.array_split(d, len(d) // 256 + 1)])
        a, e = az[best], el[best]
        for _ in range(8):
            miss = d - vectors(a, e) @ model.T
            da = np.stack([np.cos(a) * np.cos(e), 0 * a, -np.sin(a) * np.cos(e)], axis=-1) @ model.T
            de = np.stack([-np.sin(a) * np.sin(e), np.cos(e), -np.cos(a) * np.sin(e)], axis=-1) @ model.T
            saa, see, sae = (da * da).sum(1) + 1e-9, (de * de).sum(1) + 1e-9, (da * de).sum(1)
            ga, ge = (da * miss).sum(1), (de * miss).sum(1)
            det = saa * see - sae * sae
            na, ne = a + (see * ga - sae * ge) / det, e + (saa * ge - sae * ga) / det
            better = ((d - vectors(na, ne) @ model.T) ** 2).sum(1) <= (miss**2).sum(1)
            a, e = np.where(better, na, a), np.where(better, ne, e)
        residual = ((d - vectors(a, e) @ model.T) ** 2).sum(axis=1)
        return pa.StructArray.from_arrays([pa.array(a), pa.array(e), pa.array(residual)], names=["az", "el", "residual"])

    return tdoa.withColumn("_d", run("delays")).select(*tdoa.columns, "_d.az", "_d.el", "_d.residual")


def beam_levels(windows: DataFrame, steering: np.ndarray, fs: float) -> DataFrame:
    """Level (dB, peak to peak) of the delayed sum for each candidate direction, as `levels`.

    `direction` (from 1) and `level_db` are the loudest one, the first on ties.

    steering[channel, direction] holds delays in seconds; a channel is moved by
    -delay * fs samples, half to even, and padded with zeros.
    """
    shifts = np.rint(-np.asarray(steering) * fs).astype(int)

    @F.arrow_udf("struct<levels: array<double>, direction: bigint, level_db: double>")
    def run(samples: pa.Array) -> pa.Array:
        levels = np.full((len(samples), shifts.shape[1]), np.nan)
        for mine, x in kernels.stacked(samples):
            n = x.shape[2]
            for k, by in enumerate(shifts.T):
                total = np.zeros((len(mine), n))
                for j, s in enumerate(by):
                    if abs(s) < n:
                        total[:, max(s, 0) : n + min(s, 0)] += x[:, j, max(-s, 0) : n - max(s, 0)]
                with np.errstate(divide="ignore"):
                    levels[mine, k] = 20 * np.log10(total.max(axis=1) - total.min(axis=1))
        # equal levels differ in their last bits by the order of summation: compare at nine decimals
        best = levels.round(9).argmax(axis=1)
        return pa.StructArray.from_arrays(
            [kernels.lists_from(list(levels)), pa.array(best + 1), pa.array(levels[np.arange(len(best)), best])],
            names=["levels", "direction", "level_db"],
        )

    return windows.select(REC, "det_id", run(F.col("channels.samples")).alias("b")).select(REC, "det_id", "b.*")


def geometry_cost(pings: DataFrame, candidates: list[list[tuple[float, float, float]]], fs: float, c: float, ref_channel: int) -> DataFrame:
    """Squared delay error of every candidate geometry over all pings.

    `pings` needs az, el and delays. A batch gives one vector of costs, and these are added: neither
    a column nor a row of the plan is made for each candidate and ping, whatever their number is.
    """
    rx = np.array(candidates, dtype=float)
    offsets = (rx - rx[:, [ref_channel - 1]]) / c * fs  # [candidate, sensor, axis]
    gram = np.einsum("ksa,ksb->kab", offsets, offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rx))
        for batch in batches:
            az, el = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("az", "el"))
            along = np.stack([np.sin(az) * np.cos(el), np.sin(el), np.cos(az) * np.cos(el)], axis=1)
            late = _delay_rows(batch.column("delays"))[:, : rx.shape[1]]
            late = late - late[:, [ref_channel - 1]]
            # the square of late - offsets . along, summed over pings and sensors: three sums that need no pair of both
            total += (late**2).sum() - 2 * np.einsum("ksa,sa->k", offsets, late.T @ along) + np.einsum("kab,ab->k", gram, along.T @ along)
        yield pa.RecordBatch.from_pydict({"candidate": pa.array(np.arange(len(rx)), pa.int32()), "part": total})

    parts = pings.select("az", "el", "delays").mapInArrow(run, "candidate int, part double")
    return parts.groupBy("candidate").agg(F.sum("part").alias("cost"))
