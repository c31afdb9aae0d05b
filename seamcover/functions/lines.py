"""Many lines in one pair of numpy arrays, as Arrow hands them over: no Python object for a vertex."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


@dataclass
class Lines:
    """Line k is ``xy[cuts[k] : cuts[k + 1]]``; a closed one repeats its first point."""

    xy: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, lines: Sequence[np.ndarray]) -> Lines:
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        xy = np.concatenate(lines) if len(lines) else np.zeros((0, 2))
        return cls(np.asarray(xy, float).reshape(-1, 2), np.concatenate([[0], np.cumsum(sizes)]))

    @classmethod
    def from_arrow(cls, column: pa.Array | pa.ChunkedArray) -> Lines:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        cuts = column.offsets.to_numpy().astype(np.int64)
        points = column.values.slice(cuts[0], cuts[-1] - cuts[0])
        xy = np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")], 1).astype(float)
        return cls(xy, cuts - cuts[0])

    def to_arrow(self) -> pa.Array:
        points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(self.xy[:, k])) for k in (0, 1)], names=["x", "y"])
        return pa.ListArray.from_arrays(pa.array(self.cuts.astype(np.int32)), points)

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def __getitem__(self, k: int) -> np.ndarray:
        return self.xy[self.cuts[k] : self.cuts[k + 1]]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.cuts)

    def owners(self) -> np.ndarray:
        """The line of each point."""
        return np.repeat(np.arange(len(self)), self.sizes)

    def closed(self) -> np.ndarray:
        """Lines of over three points that end where they begin."""
        if not len(self.xy):
            return np.zeros(len(self), bool)
        first, last = np.minimum(self.cuts[:-1], len(self.xy) - 1), np.maximum(self.cuts[1:] - 1, 0)
        return (self.sizes > 3) & (self.xy[first] == self.xy[last]).all(1)

    def where(self, chosen: np.ndarray) -> Lines:
        """The lines of a mask."""
        return Lines(self.xy[np.repeat(chosen, self.sizes)], np.concatenate([[0], np.cumsum(self.sizes[chosen])]))

    def points_where(self, kept: np.ndarray) -> Lines:
        """All lines, with the points of a mask."""
        return Lines(self.xy[kept], np.concatenate([[0], np.cumsum(kept)])[self.cuts])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each point by line."""
        out, some = np.zeros((len(self), *values.shape[1:])), self.sizes > 0
        if some.any():
            out[some] = np.add.reduceat(values, self.cuts[:-1][some])
        return out

    def areas2(self) -> np.ndarray:
        """Twice the signed areas of the closed lines, about their first points."""
        p = self.xy - np.repeat(self.xy[np.minimum(self.cuts[:-1], max(len(self.xy) - 1, 0))], self.sizes, 0) if len(self.xy) else self.xy
        cross = np.zeros(len(p))
        if len(p) > 1:
            cross[:-1] = p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]
        if len(self):
            cross[self.cuts[1:][self.sizes > 0] - 1] = 0  # the step to the next line
        return self.sums(cross)


def mixed(chosen: np.ndarray, yes: Lines, no: Lines) -> Lines:
    """Line k of ``yes`` where chosen, else of ``no``; both have as many lines as the mask."""
    sizes = np.where(chosen, yes.sizes, no.sizes)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    shift = np.where(chosen, yes.cuts[:-1], no.cuts[:-1] + len(yes.xy)) - cuts[:-1]
    both = np.concatenate([yes.xy, no.xy])
    return Lines(both[np.arange(cuts[-1]) + np.repeat(shift, sizes)], cuts)
