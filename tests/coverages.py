"""Small coverages with integer coordinates, for tests: polygons as lists of open rings, body on the left."""

from __future__ import annotations

Ring = list[tuple[int, int]]


def square(x0: int, y0: int, x1: int, y1: int) -> Ring:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def hole(ring: Ring) -> Ring:
    return ring[::-1]


def stairs(steps: int = 20, rise: int = 1, run: int = 5, y: int = 20) -> Ring:
    """Vertices of a staircase that goes down and up again, from (0, y)."""
    out = [(0, y)]
    for k in range(steps):
        x, low = out[-1][0] + run, y - rise * ((k + 1) % 2)
        out += [(x, out[-1][1]), (x, low)] if k < steps - 1 else [(x, out[-1][1])]
    return out


def coverages() -> dict[str, dict[int, list[Ring]]]:
    line = stairs()
    return {
        "strip": {1: [square(0, 2, 6, 4)], 2: [square(0, 0, 3, 2)], 3: [square(3, 0, 6, 2)]},
        "grid9": {3 * i + j + 1: [square(10 * i, 10 * j, 10 * i + 10, 10 * j + 10)] for i in range(3) for j in range(3)},
        "island": {
            1: [square(0, 0, 10, 10), hole(square(3, 3, 7, 7))], 2: [square(3, 3, 7, 7)], 3: [square(10, 0, 20, 10)],
            4: [square(20, 0, 30, 10), hole(square(23, 3, 27, 7))],
        },
        "pinch": {1: [square(0, 0, 5, 5), square(5, 5, 10, 10)], 2: [square(5, 0, 10, 5)], 3: [square(0, 5, 5, 10)]},
        "long_shared": {1: [[(0, 50), *line, (100, 50)][::1]], 2: [[(0, 0), (100, 0), *line[::-1]]]},
        "touching_hole": {
            1: [square(0, 0, 40, 40), [(20, 0), (10, 10), (30, 10)]], 2: [square(0, -10, 20, 0)], 3: [square(20, -10, 40, 0)],
            4: [[(20, 0), (20, 10), (10, 10)]], 5: [[(20, 0), (30, 10), (20, 10)]],
        },
    }


def vertices(polygons: dict[int, list[Ring]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (poly_id, ring, seq, x, y)."""
    return [(p, r, s, x, y) for p, rings in polygons.items() for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
