"""Encoding of one window in place: the same formulas as the column expressions, on arrays, a tile at a time.

What a value decodes to is computed with packing.unpack_window's own arithmetic, so a coded value meets the bound by construction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

from boundwell.config import CODE_MAX, ESCAPE_BYTES, Config
from boundwell.functions import scalar as S
from boundwell.operators import kmeans
from boundwell.operators.cluster import LEAST_SPAN, first_k
from boundwell.operators.packing import narrow, pack_places, pack_window
from boundwell.operators.residual import PLANE_SAMPLE

#: Values that temporary columns are made for at once.
TILE = 1 << 18


def _tiles(n: int) -> Iterator[slice]:
    return (slice(a, min(n, a + TILE)) for a in range(0, n, TILE))


def _logs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log|x| in double precision, 0 where there is none, and where there is none."""
    without = (x == 0) | ~np.isfinite(x)
    return np.log(np.abs(np.where(without, 1, x).astype(float))), without


def _relative(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return np.abs(y - x) / np.maximum(np.abs(x), S.TINY)


def cluster_window(x: np.ndarray, cfg: Config) -> dict:
    """pack_window's arguments and the errors of a window in cluster mode."""
    n = len(x)
    ends = [(u[ok].min(), u[ok].max()) for u, ok in ((u, ~without) for u, without in map(_logs, (x[t] for t in _tiles(n)))) if ok.any()]
    low, high = (min(e[0] for e in ends), max(e[1] for e in ends)) if ends else (0.0, 0.0)
    span = max(high - low, LEAST_SPAN)
    k = first_k(cfg.k_start)
    while k < cfg.max_k and span / k > S.cell_width(cfg.error_bound):
        k *= 2
    width = span / k
    cells = np.empty(n, np.uint32)
    for t in _tiles(n):
        cells[t] = np.clip(np.floor((_logs(x[t])[0] - low) / width), 0, k - 1)
    taken = np.zeros(k, bool)
    taken[cells] = True
    occupied = np.flatnonzero(taken)
    number = np.zeros(k, np.uint32)
    number[occupied] = np.arange(len(occupied))
    book = (low + (occupied + 0.5) * width).astype(np.float32)
    magnitude = np.exp(book.astype(float))
    labels = narrow(np.empty(n, np.uint32), len(book))
    negative, escaped, worst, total = x < 0, [], 0.0, 0.0
    with np.errstate(invalid="ignore", over="ignore"):
        for t in _tiles(n):
            own = number[cells[t]]
            labels[t] = own
            y = (np.where(negative[t], -1.0, 1.0) * magnitude[own]).astype(np.float32)
            error = _relative(y, x[t])
            bad = (x[t] == 0) | ~np.isfinite(x[t]) | ~(error <= cfg.error_bound)
            escaped.append(t.start + np.flatnonzero(bad))
            error[bad] = 0
            worst, total = max(worst, float(error.max())), total + float(error.sum())
    at = np.concatenate(escaped)
    return {"centroids": book.reshape(-1, 1), "labels": labels, "negative": negative, "z": None, "step": 0.0, "outlier_idx": at, "outlier_val": x[at], "tuple_size": 1, "max_error": worst, "mean_error": total / n, "trials": []}


def plane_width(z: np.ndarray) -> int:
    """Byte planes whose entropy and escapes cost least; the smallest of equals. Entropies are taken from a strided sample of the window, overflow from all."""
    some, cost, best = z[:: max(1, len(z) // PLANE_SAMPLE)], 0.0, []
    for p in range(4):
        cost += kmeans.bits_of(np.bincount(((some >> np.uint32(8 * p)) & np.uint32(255)).astype(np.int64), minlength=256)) * len(z) / 8
        best.append((cost + (ESCAPE_BYTES * int((z >> np.uint32(8 * p + 8) != 0).sum()) if p < 3 else 0), p + 1))
    return min(best)[1]


def residual_window(x: np.ndarray, cfg: Config, seed: int) -> dict:
    """The same in residual and vq mode: centroids of the window's own tuples, the last of which is filled up with the last value."""
    size, n = cfg.tuple_size, len(x)
    full = np.concatenate((x, np.repeat(x[-1:], -n % size)))
    log = cfg.mode == "residual" and cfg.error_mode == "relative"
    # Values that can't be predicted take part as 0, so that they don't pull centroids.
    value = _logs(full)[0] if log else np.where(np.isfinite(full), full, 0).astype(float)
    book, labels, trials = kmeans.window_clusters(value.reshape(-1, size), cfg, seed)
    book = book.astype(np.float32)
    search = trials[kmeans.chosen(trials, cfg)]
    # Errors of the search are in the domain of the mode; in the log domain they are told as relative ones.
    told = (lambda e: math.expm1(min(e, 700.0))) if log else float
    common = {"centroids": book, "labels": labels, "tuple_size": size, "trials": [{"k": t.k, "est_bytes": float(t.est_bytes), "max_error": told(t.max_error), "mean_error": told(t.mean_error)} for t in trials], "search_error": told(search.max_error)}
    none = np.zeros(0, np.int64)
    if cfg.mode == "vq":
        error = np.abs(book[labels].reshape(-1)[:n].astype(float) - x)
        error = np.where(np.isnan(error), np.inf, error)
        return common | {"negative": None, "z": None, "step": 0.0, "outlier_idx": none, "outlier_val": x[none], "max_error": float(error.max()), "mean_error": float(error.mean())}
    step = S.step_value(math.log1p(cfg.error_bound) if log else cfg.error_bound, float(np.abs(value).max()))
    z, bad, errors = np.zeros(len(full), np.uint32), np.zeros(len(full), bool), np.zeros(len(full))
    with np.errstate(invalid="ignore", over="ignore"):
        for t in _tiles(len(full)):
            lanes = np.arange(t.start, t.stop)
            pred = book[labels[lanes // size], lanes % size]
            v = value[t] if log else full[t].astype(float)
            q = np.rint((v - pred) / step)
            far = np.isnan(q) | (q < -CODE_MAX) | (q > CODE_MAX - 1)
            whole = np.where(far, 0, q).astype(np.int64)
            y = pred + whole.astype(np.float32) * np.float32(step)
            if log:
                y = (np.where(full[t] < 0, -1.0, 1.0) * np.exp(y.astype(float))).astype(np.float32)
            error = _relative(y, full[t]) if log else np.abs(y.astype(float) - full[t])
            wrong = far | ~(error <= cfg.error_bound) | ((full[t] == 0) if log else False)
            code = np.where(whole >= 0, whole + 1, whole)
            z[t] = np.where(wrong, 0, (code << 1) ^ (code >> 63)).astype(np.uint32)
            bad[t], errors[t] = wrong, np.where(wrong, 0, error)
    width = plane_width(z)
    if width < 4:
        bad |= z >> np.uint32(8 * width) != 0
    z[bad], errors[bad] = 0, 0
    at = np.flatnonzero(bad[:n])
    return common | {"negative": full < 0 if log else None, "z": z, "step": step, "outlier_idx": at, "outlier_val": x[at], "max_error": float(errors[:n].max()), "mean_error": float(errors[:n].mean())}


def encode_window(w: int, places: np.ndarray, x: np.ndarray, cfg: Config) -> dict:
    """The chunk of a window's values; places are kept where they don't simply count from 0."""
    found = cluster_window(x, cfg) if cfg.mode == "cluster" else residual_window(x, cfg, cfg.seed + w)
    told = {c: found.pop(c, None) for c in ("max_error", "mean_error", "search_error", "trials")}
    domain = "absolute" if cfg.mode == "vq" else cfg.error_mode
    return pack_window(w, cfg.mode, domain, n_values=len(x), level=cfg.zstd_level, **found) | told | {"places_blob": pack_places(places, cfg.zstd_level), "window_values": cfg.values_per_window, "error_bound": cfg.error_bound}
