"""Unit conversions as a graph of affine functions."""

from collections import defaultdict
from fractions import Fraction

Affine = tuple[Fraction, Fraction]  # y = factor * x + offset


def then(f: Affine, g: Affine) -> Affine:
    """First f, then g."""
    return f[0] * g[0], f[1] * g[0] + g[1]


def inverse(f: Affine) -> Affine:
    return 1 / f[0], -f[1] / f[0]


class Inconsistent(ValueError):
    """Two ways from one unit to another differ."""


class UnitGraph:
    """Units with known conversions between some of them; conversions between all others are composed."""

    def __init__(self, tolerance: Fraction = Fraction(0)):
        self.edges: dict[str, dict[str, Affine]] = defaultdict(dict)
        self.tolerance = tolerance

    def add(self, source: str, target: str, factor, offset=0) -> "UnitGraph":
        f = Fraction(factor), Fraction(offset)
        if not f[0]:
            raise ValueError(f"no way back from {target} to {source}")
        for a, b, g in ((source, target, f), (target, source, inverse(f))):
            if b in self.edges[a] and not self._same(self.edges[a][b], g):
                raise Inconsistent(f"{a} to {b}")
            self.edges[a][b] = g
        return self

    def _same(self, f: Affine, g: Affine) -> bool:
        return all(abs(x - y) <= self.tolerance * max(abs(x), 1) for x, y in zip(f, g))

    def to(self, target: str) -> dict[str, Affine]:
        """The shortest composition from every unit that reaches target; breadth first, so with the fewest steps.
        Raises Inconsistent if any edge among the reached units closes a cycle that isn't the identity."""
        found: dict[str, Affine] = {target: (Fraction(1), Fraction(0))}
        queue = [target]
        for at in queue:
            for unit, f in sorted(self.edges[at].items()):
                if unit not in found:
                    found[unit] = then(inverse(f), found[at])
                    queue.append(unit)
        for a in found:
            for b, f in self.edges[a].items():
                if not self._same(then(f, found[b]), found[a]):
                    raise Inconsistent(f"a cycle through {a} and {b}")
        return found
