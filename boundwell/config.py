"""Settings of a run."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

#: Largest magnitude of a residual code; one less than a quarter of the 32-bit range, so that zigzag words fit.
CODE_MAX = (1 << 30) - 1
#: Bytes of a value in the working stream.
VALUE_BYTES = 4
#: An escaped value costs its index and itself.
ESCAPE_BYTES = 8
MODES = ("cluster", "residual", "vq")
ERROR_MODES = ("relative", "absolute")
CRITERIA = ("size", "vq")


@dataclass(frozen=True)
class Config:
    """error_bound holds for every value that isn't stored verbatim; window_bytes is the size of a count window in 4-byte values."""

    error_bound: float = 1e-4
    error_mode: str = "relative"
    mode: str = "cluster"
    window_bytes: int = 128 << 20
    tuple_size: int = 2
    k_start: int = 64
    max_k: int = 1 << 24
    k_criterion: str = "size"
    min_k_gain: float = 0.02
    k_patience: int = 2
    kmeans_iters: int = 25
    sample_per_k: int = 64
    sample_min: int = 1 << 18
    sample_max: int = 1 << 22
    zstd_level: int = 3
    seed: int = 0

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.error_mode not in ERROR_MODES or self.k_criterion not in CRITERIA:
            raise ValueError(f"unknown mode in {self}")
        if not self.error_bound > 0:
            raise ValueError("the error bound must be positive")
        if self.mode == "cluster" and self.error_mode != "relative":
            raise ValueError("cluster mode bounds the relative error only")
        if min(self.window_bytes // VALUE_BYTES, self.tuple_size, self.k_start, self.max_k) < 1:
            raise ValueError("window, tuple and cluster counts must be positive")

    @property
    def values_per_window(self) -> int:
        return self.window_bytes // VALUE_BYTES

    def to_dict(self) -> dict:
        return asdict(self)


_UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "T": 1 << 40, "TB": 1 << 40}


def parse_size(text: str) -> int:
    """Bytes of '128MB', '1.5 G', '4096'; units are powers of 1024, an i in them (MiB) is allowed."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*", text)
    unit = found and _UNITS.get(found[2].upper().replace("I", ""))
    if not unit:
        raise ValueError(f"not a size: {text!r}")
    return int(float(found[1]) * unit)


def human(n: float) -> str:
    """A number of bytes for people."""
    for unit in ("B", "KiB", "MiB", "GiB"):
        if abs(n) < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TiB"


def power_label(k: int) -> str:
    """2^n for powers of two, else digits."""
    return f"2^{k.bit_length() - 1}" if k > 0 and k & (k - 1) == 0 else str(k)
