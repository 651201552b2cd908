"""Cover trees over a block of integer points, and exact nearest-entry search for whole subtrees by the triangle inequality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Nodes of at most so many points are compared point by point.
LEAF = 12


@dataclass
class CoverTree:
    """Points in depth-first order, so a node's subtree is a slice; nodes in breadth-first order, so siblings are a slice.

    A node is centred on one of its points. Its children are centred on points (its own centre first) more than a scale apart and hold the
    points within that scale, where the scale is a power of two below the node's radius. radius is the exact largest distance
    from the centre. total[i] is the sum of the first i points, so a subtree's sum is a difference of two rows.
    """

    points: np.ndarray
    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray
    total: np.ndarray

    @staticmethod
    def build(points: np.ndarray) -> CoverTree:
        points = points.astype(np.int64)
        order = np.arange(len(points))
        nodes: list[list] = []  # start, end, centre, radius, first child, children

        def add(lo: int, hi: int, middle: int, square: np.ndarray) -> None:
            nodes.append([lo, hi, middle, float(np.sqrt(square.max())) * (1 + 1e-12), 0, 0])

        if len(points):
            add(0, len(points), 0, squares(points, points[0]))
        at = 0
        while at < len(nodes):
            lo, hi, middle, radius, *_ = nodes[at]
            if hi - lo > LEAF and radius > 0:
                mine = order[lo:hi]
                inside, own = points[mine], points[middle]
                nearest, best, centres = np.zeros(hi - lo, np.int64), squares(inside, own), [middle]
                scale = 2.0 ** (np.ceil(np.log2(best.max()) / 2) - 1)
                scale /= 1 + (scale * scale >= best.max())  # below the radius, so that a node is always split
                while True:  # farthest point first: centres stay more than a scale apart
                    far = int(best.argmax())
                    if best[far] <= scale * scale:
                        break
                    found = squares(inside, inside[far])
                    closer = found < best
                    nearest[closer], best[closer] = len(centres), found[closer]
                    centres.append(int(mine[far]))
                place = np.argsort(nearest, kind="stable")
                order[lo:hi], best = mine[place], best[place]
                bounds = lo + np.concatenate([[0], np.cumsum(np.bincount(nearest, minlength=len(centres)))])
                nodes[at][4:] = len(nodes), len(centres)
                for i, new in enumerate(centres):
                    add(int(bounds[i]), int(bounds[i + 1]), new, best[bounds[i] - lo:bounds[i + 1] - lo])
            at += 1
        back = np.empty(len(points), np.int64)
        back[order] = np.arange(len(points))
        table = list(zip(*nodes)) or [[]] * 6
        start, end, middle, radius, child, children = (np.array(c, float if i == 3 else np.int64) for i, c in enumerate(table))
        return CoverTree.of(points[order], order, start, end, back[middle], radius, child, children)

    @staticmethod
    def of(points, *rest) -> CoverTree:
        return CoverTree(points, *rest, np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)]))

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry of each point in tree order, points per entry, sums per entry, number of points compared singly).

        The nearest entry by squared distance, ties to the lower index. A subtree of radius r takes entry e whole if every other entry is more
        than 2 r farther from its centre; entries that cannot win are dropped on the way down.
        """
        codes = np.zeros(len(self.points), np.int64)
        counts, sums = np.zeros(len(entries), np.int64), np.zeros((len(entries), self.points.shape[1]), np.int64)
        nodes = np.zeros(min(1, len(self.start)), np.int64)
        open_ = np.ones((len(nodes), len(entries)), bool)
        single = 0
        while len(nodes):
            square = cross_squares(self.points[self.centre[nodes]], entries)
            distance = np.where(open_, np.sqrt(square), np.inf)
            best = np.where(open_, square, np.iinfo(np.int64).max).argmin(axis=1)
            least, reach = distance[np.arange(len(nodes)), best], 2 * self.radius[nodes]
            # Rounding of the roots can only keep an entry that exact arithmetic would drop.
            limit = (least + reach) * (1 + 1e-9) + 1e-9
            open_ &= distance <= limit[:, None]
            sure = (open_.sum(axis=1) == 1) | (reach == 0)
            lo, hi = self.start[nodes[sure]], self.end[nodes[sure]]
            np.add.at(counts, best[sure], hi - lo)
            np.add.at(sums, best[sure], self.total[hi] - self.total[lo])
            codes[slices(lo, hi)] = np.repeat(best[sure], hi - lo)
            leaf = ~sure & (self.children[nodes] == 0)
            lo, hi = self.start[nodes[leaf]], self.end[nodes[leaf]]
            rows = slices(lo, hi)
            if len(rows):
                square = cross_squares(self.points[rows], entries)
                square[~np.repeat(open_[leaf], hi - lo, axis=0)] = np.iinfo(np.int64).max
                codes[rows] = square.argmin(axis=1)
                np.add.at(counts, codes[rows], 1)
                np.add.at(sums, codes[rows], self.points[rows])
                single += len(rows)
            down = ~sure & ~leaf
            many = self.children[nodes[down]]
            first = self.child[nodes[down]]
            open_ = np.repeat(open_[down], many, axis=0)
            nodes = slices(first, first + many)
        return codes, counts, sums, single


def slices(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one after the other."""
    n = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())


def squares(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    gap = points - one
    return np.einsum("ij,ij->i", gap, gap)


def cross_squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    gap = points[:, None, :] - entries[None, :, :]
    return np.einsum("ijk,ijk->ij", gap, gap)
