"""A tree of count vectors with which pairs of similar sets are found.

The members of a set are dealt to groups by their hash; the counts per group are a point.
Two sets share at most the sum of the coordinate minima of their points.  A node holds the
coordinate maxima and the smallest size below it, so the same sum over two nodes bounds what
any pair of sets below them shares; a pair of nodes that stays under what the threshold asks
for is left out as a whole.

The join is meant for linking: members that are linked already need no further pair.  A node
whose members are all in one class is marked so, and two nodes of one class are skipped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF = 24
#: Groups by size of a set: the bound tells sets apart while groups hold a few members each.
#: Each number divides the next, so a finer point folds to a coarser one.
SIZES, GROUPS = (0, 1200, 6000), (256, 1024, 4096)


def groups_for(n: int) -> int:
    return GROUPS[sum(n >= s for s in SIZES) - 1]


def point(hashes: np.ndarray) -> bytes:
    """Counts per group as bytes, or as 32-bit numbers where a group is that full."""
    groups = groups_for(len(hashes))
    counts = np.bincount(((hashes >> np.uint64(7)) % np.uint64(groups)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8 if counts.max() < 256 else "<u4").tobytes()


def unpacked(raw: bytes, n: int, groups: int) -> np.ndarray:
    """The point of a set of size n in no more groups than it was counted in."""
    own = groups_for(n)
    counts = np.frombuffer(raw, np.uint8 if len(raw) == own else "<u4")
    return counts.reshape(own // groups, groups).sum(axis=0, dtype=np.uint32)


class Part:
    """Some of the positions of a union-find, numbered anew."""

    def __init__(self, classes, rows: np.ndarray):
        self.classes, self.rows = classes, rows.tolist()

    def find(self, i: int) -> int:
        return self.classes.find(self.rows[i])

    def union(self, i: int, j: int) -> bool:
        return self.classes.union(self.rows[i], self.rows[j])


def link_sets(raw: list[bytes], sizes: np.ndarray, percent: int, classes, verify: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links among sets of all sizes: a tree for each number of groups.

    A tree takes the sets of its own sizes and those larger ones that may still link with
    them, folded to its number of groups; every pair that may link meets in some tree.
    """
    out: list[tuple[int, int]] = []
    for k, groups in enumerate(GROUPS):
        high = SIZES[k + 1] if k + 1 < len(SIZES) else None
        mine = (sizes >= SIZES[k]) & ((sizes < high) if high else True)
        if not mine.any():
            continue
        rows = np.flatnonzero((sizes >= SIZES[k]) & ((percent * sizes <= 100 * high) if high else True))
        if len(rows) < 2:
            continue
        points = np.stack([unpacked(raw[i], int(sizes[i]), groups) for i in rows.tolist()])
        points = points.astype(np.uint16) if points.max() < 65_536 else points
        check = None if verify is None else (lambda p, q, rows=rows: verify(int(rows[p]), int(rows[q])))
        out += [(int(rows[p]), int(rows[q])) for p, q in link(points, sizes[rows], percent, Part(classes, rows), check)]
    return out


def needed(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Smallest overlap with which sets of sizes a and b are similar enough, rounded up."""
    return -(-(percent * (a + b)) // (100 + percent))


class Classes:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


class Node:
    __slots__ = ("rows", "kids", "top", "least", "one")

    def __init__(self, rows: np.ndarray, points: np.ndarray, sizes: np.ndarray):
        self.rows, self.kids, self.one = rows, (), None
        self.top, self.least = points[rows].max(axis=0).astype(np.int64), int(sizes[rows].min())


def build(points: np.ndarray, sizes: np.ndarray) -> Node:
    """Bulk load: halve at the median of the coordinate that varies most, down to leaves."""
    root = Node(np.arange(len(sizes)), points, sizes)
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.rows) > LEAF:
            inside = points[node.rows]
            some = inside[:: max(1, len(inside) // 512)].astype(np.float32)  # picks a coordinate only
            by = np.argsort(inside[:, int(some.var(axis=0).argmax())], kind="stable")
            half = len(by) // 2
            node.kids = tuple(Node(node.rows[part], points, sizes) for part in (by[:half], by[half:]))
            todo += node.kids
    return root


def link(points: np.ndarray, sizes: np.ndarray, percent: int, classes: Classes, verify: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links that join all members which a chain of similar pairs joins.

    verify decides on a pair that passes the bound; without it the bound alone decides.
    """
    out: list[tuple[int, int]] = []

    def uniform(node: Node) -> bool:
        if node.one is None:
            if node.kids:
                if all(uniform(k) for k in node.kids) and classes.find(node.kids[0].one) == classes.find(node.kids[1].one):
                    node.one = node.kids[0].one
            elif len({classes.find(i) for i in node.rows.tolist()}) == 1:
                node.one = int(node.rows[0])
        return node.one is not None

    def leaves(x: Node, y: Node) -> None:
        a, b = points[x.rows], points[y.rows]
        most = np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2, dtype=np.int64)
        ok = most >= needed(sizes[x.rows][:, None], sizes[y.rows][None, :], percent)
        if x is y:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        for k in np.argsort(-most[i, j], kind="stable").tolist():
            p, q = int(x.rows[i[k]]), int(y.rows[j[k]])
            if classes.find(p) != classes.find(q) and (verify is None or verify(p, q)):
                classes.union(p, q)
                out.append((p, q))

    # depth first; a node is joined with itself before it is joined with others
    todo: list[tuple[Node, Node]] = [(root := build(points, sizes), root)]
    while todo:
        x, y = todo.pop()
        if x is not y:
            if uniform(x) and uniform(y) and classes.find(x.one) == classes.find(y.one):
                continue
            if int(np.minimum(x.top, y.top).sum()) < needed(x.least, y.least, percent):
                continue
            if not x.kids and not y.kids:
                leaves(x, y)
            elif x.kids and (not y.kids or len(x.rows) >= len(y.rows)):
                todo += [(k, y) for k in x.kids]
            else:
                todo += [(x, k) for k in y.kids]
        elif not x.kids:
            leaves(x, x)
        else:
            todo += [(x.kids[0], x.kids[1]), (x.kids[1], x.kids[1]), (x.kids[0], x.kids[0])]
    return out
