"""Small numpy helpers that run inside tasks on one bounded block or block pair."""

from __future__ import annotations

import numpy as np

NO_PARENT = np.iinfo(np.int64).max


def sum_rows(table: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Column sums taken row after row, so they equal a plain running sum bit for bit.

    Wide tables are reduced along the outer axis, which numpy does in order; for
    narrow ones it may regroup the sum, so those are added explicitly.
    """
    if table.shape[1] > 8:
        return np.add.reduce(table, axis=0, out=out)
    out[:] = 0.0
    for row in table:
        out += row
    return out


def distances(xt: np.ndarray, y: np.ndarray, buf: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Euclidean distances of the columns of ``xt`` to the point ``y``."""
    np.subtract(xt, y[:, None], out=buf)
    np.multiply(buf, buf, out=buf)
    return np.sqrt(sum_rows(buf, out), out=out)


def distance_rows(x: np.ndarray, y: np.ndarray):
    """Yield, point by point of ``x``, the distances to all points of ``y``.

    The yielded array is reused: one row of the tile is alive at a time.
    """
    yt = np.ascontiguousarray(y.T)
    buf, out = np.empty_like(yt), np.empty(len(y))
    for point in x:
        yield distances(yt, point, buf, out)


def before(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether edge {a,b} precedes edge {c,d} of the same weight."""
    low1, high1 = np.minimum(a, b), np.maximum(a, b)
    low2, high2 = np.minimum(c, d), np.maximum(c, d)
    return (low1 < low2) | ((low1 == low2) & (high1 < high2))


class Side:
    """Points of one side of a tile, each with its lightest edge out of its component."""

    def __init__(self, table: np.ndarray, rows: np.ndarray, cols: np.ndarray):
        self.table, self.rows, self.cols = table, rows, cols
        self.weight = np.full(len(rows), np.inf)
        self.to = rows.copy()

    def refresh(self, label: np.ndarray) -> None:
        """Look again for the rows whose lightest edge ends in their own component."""
        stale = np.flatnonzero(label[self.rows] == label[self.to])
        part = self.table[stale]
        part[label[self.rows[stale]][:, None] == label[self.cols][None, :]] = np.inf
        # Columns are in id order, so of equal weights the first is the least edge.
        k = part.argmin(axis=1)
        self.weight[stale] = part[np.arange(len(stale)), k]
        self.to[stale] = self.cols[k]


# Pairs from which on a tile is screened.
SCREENED = 2048
# Edges per point that a screening takes up at a time, and how often it does.
SCREENED_EDGES, SCREENINGS = 6, 4
# Pairs measured at a time.
MEASURED = 1024


class Screen:
    """Squared distances of a tile by one matrix product, off by at most ``slack``.

    It only chooses the pairs to be measured; no result is taken from it.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, kind: str = "f4"):
        centre, dim = x.mean(axis=0), x.shape[1]
        a, b = x - centre, y - centre
        norm_a, norm_b = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        top, far = max(norm_a.max(), norm_b.max()), max(np.abs(x).max(), np.abs(y).max())
        self.top = top
        self.kind = kind if 1e-20 < top < 1e30 else "f8"
        unit, least = np.finfo(self.kind).eps, np.finfo(self.kind).tiny
        lost = np.finfo("f8").eps * far * np.sqrt(dim * top)
        self.slack = 16.0 * (dim + 4) * (unit * top + lost + least)
        left = np.empty((len(a), dim + 2), self.kind)
        left[:, :dim], left[:, dim], left[:, dim + 1] = -2 * a, norm_a, 1
        right = np.empty((len(b), dim + 2), self.kind)
        right[:, :dim], right[:, dim], right[:, dim + 1] = b, 1, norm_b
        self.table = left @ right.T

    def above(self, bound):
        """``bound`` in the type of the table, not rounded down."""
        return np.nextafter(np.asarray(bound).astype(self.kind), np.asarray(np.inf, self.kind))


def measured(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the listed pairs, bit for bit those of :func:`distances`."""
    out = np.empty(len(i))
    for start in range(0, len(i), MEASURED):
        part = slice(start, start + MEASURED)
        gap = x[i[part]] - y[j[part]]
        np.multiply(gap, gap, out=gap)
        sum_rows(np.ascontiguousarray(gap.T), out[part])
    return np.sqrt(out, out=out)


def _apart(label_a: np.ndarray, label_b: np.ndarray, same: bool):
    """Parts ``(rows, columns)`` of a tile that hold all its pairs of different labels: those
    with an end outside the most common label."""
    names, counts = np.unique(label_a if same else np.concatenate([label_a, label_b]), return_counts=True)
    common = names[counts.argmax()]
    out_a, out_b = np.flatnonzero(label_a != common), np.flatnonzero(label_b != common)
    parts = [(out_a, np.arange(len(label_b)))]
    if not same:
        parts.append((np.flatnonzero(label_a == common), out_b))
    return [(r, c) for r, c in parts if len(r) and len(c)]


def _screened(ids: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool, radius: float):
    """Components, tree edges found, and whether these are all, by screenings of the tile.

    Each takes up the lightest pairs between components, up to a length chosen from some of
    the pairs, and measures them. They hold every edge of up to that length.
    """
    n, shift = len(ids), 0 if same else len(x)
    label, found, kind = np.arange(n), [], "f4"
    screen = Screen(x, y, kind)
    for turn in range(SCREENINGS):
        label_a, label_b = label[: len(x)], label[shift:]
        parts = [(None, None)] if not turn else _apart(label_a, label_b, same)
        tables = []
        for r, c in parts:
            table = screen.table
            if r is not None:
                table = table[r] if len(c) == len(y) else table[np.ix_(r, c)]
                table[label_a[r][:, None] == label_b[c][None, :]] = np.inf
            tables.append(table)
        total, most = sum(t.size for t in tables), SCREENED_EDGES * n
        if not total:
            return label, found, True
        limit = radius
        if total > 4 * most:
            sample = np.concatenate([t.ravel()[:: max(1, total >> 16) | 1] for t in tables])
            k = min(len(sample) - 1, int(len(sample) * (most / total)))
            limit = min(radius, float(np.sqrt(max(np.partition(sample, k)[k], 0.0))))
        if np.isfinite(limit) and screen.slack > 0.01 * limit * limit and screen.kind == "f4":
            screen = Screen(x, y, "f8")
            continue
        bound = screen.above(limit * limit * (1 + 1e-12) + screen.slack)
        hits = [t < np.inf if np.isinf(limit) else t <= bound for t in tables]
        if sum(int(np.count_nonzero(h)) for h in hits) > max(4 * most, total // 4):
            return label, found, False
        ends = []
        for (r, c), h in zip(parts, hits):
            i, j = np.divmod(np.flatnonzero(h), h.shape[1])
            ends.append((i, j) if r is None else (r[i], c[j]))
        i, j = (np.concatenate(e) for e in zip(*ends))
        if same:
            once = (i < j) if not turn else (i < j) | ~np.isin(j, parts[0][0])
            i, j = i[once], j[once]
        weight = measured(x, y, i, j)
        light = weight <= limit
        i, j, weight = i[light], j[light] + shift, weight[light]
        low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        kept = forest(label[i], label[j], weight, low, high)
        found.append((low[kept], high[kept], weight[kept]))
        label = _joined(label, label[i[kept]], label[j[kept]])
        if limit >= radius or (label == label[0]).all():
            return label, found, True
    return label, found, False


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after uniting the listed pairs of them; the smallest one stays."""
    to = np.arange(len(label))
    while True:
        la, lb = to[a], to[b]
        apart = la != lb
        if not apart.any():
            return to[label]
        la, lb = la[apart], lb[apart]
        np.minimum.at(to, np.maximum(la, lb), np.minimum(la, lb))
        to = compress(to)


def spanning_tree(left, right=None, radius: float = np.inf):
    """Minimum spanning tree of one block, or of all edges between two blocks.

    ``left`` and ``right`` are ``(ids, coords)`` in id order. With ``radius`` only the edges
    of up to that length are sure to be there. Tiles are screened; where that leaves too
    many pairs, Boruvka rounds over the distance table of the tile finish the tree, which
    the bound on blocks keeps at some tens of MB. Ties go by ``(weight, smaller id, larger id)``.
    """
    ids = left[0] if right is None else np.concatenate([left[0], right[0]])
    x, y = left[1], left[1] if right is None else right[1]
    n, m = len(ids), len(left[0])
    every = np.arange(n)
    label, found = every, []
    if len(x) * len(y) >= SCREENED and x.shape[1]:
        label, found, done = _screened(ids, x, y, right is None, radius)
        if done:
            return _once(found, len(np.unique(ids)) < n)
    table = np.empty((m, m if right is None else n - m))
    for i, row in enumerate(distance_rows(x, y)):
        table[i] = row
    if right is None:
        sides = [Side(table, every, every)]
    else:
        sides = [
            Side(table, every[:m], every[m:]),
            Side(np.ascontiguousarray(table.T), every[m:], every[:m]),
        ]
    while table.size:
        for side in sides:
            side.refresh(label)
        u, v, weight = (
            np.concatenate([getattr(s, name) for s in sides]) for name in ("rows", "to", "weight")
        )
        out = np.isfinite(weight)
        if not out.any():
            break
        u, v, weight = u[out], v[out], weight[out]
        low, high = np.minimum(ids[u], ids[v]), np.maximum(ids[u], ids[v])
        order = np.lexsort((high, low, weight))
        names, first = np.unique(label[u][order], return_index=True)
        pick = order[first]
        found.append((low[pick], high[pick], weight[pick]))
        label = unite(label, names, label[v[pick]])
    # Two components may have chosen the same edge.
    return _once(found, True)


# Most points on a side of tiles that are solved together, and bytes of their tables.
TOGETHER, TOGETHER_BYTES = 256, 16 << 20


def spanning_trees(pairs):
    """``(pair, left, right, weight)``: the trees of all listed tiles, one after the other.

    Each pair is two sides ``(ids, coords)`` as in :func:`spanning_tree`, or a block and None.
    Small tiles are solved together by Prim's steps, so that a numpy call does one step of
    many tiles. Distances in these are off by at most a slack; a tile where that leaves
    another tree possible, as ties do, is solved by :func:`spanning_tree`.
    """
    sides = {id(side): side for pair in pairs for side in pair if side is not None}
    small = [
        p for p, (a, b) in enumerate(pairs) if b is not None and 0 < len(a[0]) <= TOGETHER and 0 < len(b[0]) <= TOGETHER
    ]
    dims = {side[1].shape[1] for side in sides.values()}
    ids = [side[0] for side in sides.values()]
    batch, found = None, []
    # Edges of repeated ids are told apart by nothing; such tiles are left to the tree of one.
    if len(small) > 1 and dims != {0} and len(dims) == 1 and len(np.unique(np.concatenate(ids))) == sum(map(len, ids)):
        batch = Batch([pairs[p] for p in small])
    alone = set(range(len(pairs)))
    if batch is not None and batch.slack is not None:
        for start in range(0, len(small), batch.tiles):
            tiles = np.array(small[start : start + batch.tiles])
            sure, tile, *edges = batch.trees([pairs[p] for p in tiles])
            found.append((tiles[tile], *edges))
            alone.difference_update(tiles[sure].tolist())
            if 2 * np.count_nonzero(sure) < len(sure):
                # Full of ties: the other tiles are tried in vain.
                break
    for p in sorted(alone):
        a, b, weight = spanning_tree(*pairs[p])
        found.append((np.full(len(a), p), a, b, weight))
    if not found:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)
    return tuple(np.concatenate(column) for column in zip(*found))


class Batch:
    """Trees of many small tiles between blocks, all with their steps at the same time."""

    def __init__(self, pairs):
        sides = {id(side): side for pair in pairs for side in pair}
        self.at = {name: b for b, name in enumerate(sides)}
        sides = list(sides.values())
        self.sizes = np.array([len(side[0]) for side in sides])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate([side[0] for side in sides])
        self.coords = np.concatenate([side[1] for side in sides])
        rows, dim = self.coords.shape
        # Rows of whole words of eight flags.
        self.width = width = -(-int(self.sizes.max()) // 8) * 8
        self.tiles = max(1, TOGETHER_BYTES // (8 * width * width))
        centred = self.coords - self.coords.mean(axis=0)
        norm = np.einsum("ij,ij->i", centred, centred)
        top, far = norm.max(), np.abs(self.coords).max()
        self.slack = None
        if not 1e-20 < top < 1e30:
            return
        unit, least = np.finfo("f8").eps, np.finfo("f4").tiny
        # As in Screen; doubled, as two lengths are compared, and again for their roots.
        self.slack = 4 * 16.0 * (dim + 4) * (unit * top + unit * far * np.sqrt(dim * top) + least)
        # What is missing up to the width is infinitely far.
        self.low = np.zeros((len(sides), width, dim + 2))
        self.high = np.zeros((len(sides), dim + 2, width))
        self.low[:, :, dim], self.low[:, :, dim + 1] = np.inf, 1
        self.high[:, dim], self.high[:, dim + 1] = 1, np.inf
        for b, (start, n) in enumerate(zip(self.first, self.sizes)):
            x, square = centred[start : start + n], norm[start : start + n]
            self.low[b, :n, :dim], self.low[b, :n, dim] = -2 * x, square
            self.high[b, :dim, :n], self.high[b, dim + 1, :n] = x.T, square

    def trees(self, pairs):
        """Which tiles are sure, and the tile, ends and weight of the edges of these."""
        count, width = len(pairs), self.width
        low = np.array([self.at[id(a)] for a, _ in pairs])
        high = np.array([self.at[id(b)] for _, b in pairs])
        table, found = np.empty((count, 2 * width, width), "f4"), np.empty((width, width))
        for t in range(count):
            np.matmul(self.low[low[t]], self.high[high[t]], out=found)
            # Positive numbers are ordered as their bits are.
            np.maximum(found, np.finfo("f4").tiny, out=found)
            table[t, :width] = found
            table[t, width:] = table[t, :width].T
        table = table.reshape(-1, width)
        node, other, length, sure = self.steps(table, count, int((self.sizes[low] + self.sizes[high]).max()) - 1)
        of_low = node < width
        i = np.where(of_low, node, other) + self.first[low][:, None]
        j = np.where(of_low, other, node - width) + self.first[high][:, None]
        tile, step = np.nonzero((length < np.inf) & sure[:, None])
        i, j = i[tile, step], j[tile, step]
        weight = measured(self.coords, self.coords, i, j)
        order = np.lexsort((weight, tile))
        i, j = self.ids[i[order]], self.ids[j[order]]
        return sure, tile[order], np.minimum(i, j), np.maximum(i, j), weight[order]

    def steps(self, table: np.ndarray, count: int, steps: int):
        """Per tile, the nodes in the order they join its tree, by which other end and how far.

        Two nodes of a tree are joined by a path whose longest edge is the longest taken
        since the first of them joined. A tile is sure if no other edge is about that short.
        """
        width, every = self.width, np.arange(count)
        # A joined node is -1: below every length, and above all by its bits.
        gap = np.full((count, 2 * width), np.inf, "f4")
        gap[:, width:] = table[:: 2 * width]
        gap[:, 0] = -1
        bits, halves = gap.view("u4"), gap.reshape(-1, width)
        # The longest edge since, with slack; not a number before a node has joined.
        path = np.full((count, 2 * width), np.nan, "f4")
        path[:, 0] = 0
        paths = path.reshape(-1, width)
        node, other = (np.empty((steps, count), "i8") for _ in range(2))
        length, flags = np.empty((steps, count), "f4"), np.empty((steps, count), "u8")
        # Twice what lengths lose in four bytes, and again.
        rounded, slack = np.float32(1 + 2.0**-21), np.float32(self.slack)
        for step in range(steps):
            k = bits.argmin(axis=1)
            near = gap[every, k]
            np.maximum(path, (near * rounded + slack)[:, None], out=path)
            row = table.take(2 * width * every + k, axis=0)
            half = 2 * every + (k < width)
            short = row <= paths.take(half, axis=0)
            node[step], other[step], length[step] = k, short.argmax(axis=1), near
            np.add.reduce(short.view("u8"), axis=1, out=flags[step])
            gap[every, k] = -1
            path[every, k] = 0
            halves[half] = np.minimum(row, halves.take(half, axis=0))
        # A flag is a byte, so one alone is a power of 256; there are less than 256 words.
        one = (flags & (flags - np.uint64(1)) == 0) & (flags & np.uint64(0x0101010101010101) != 0)
        return node.T, other.T, length.T, (one | ~(length < np.inf)).all(axis=0)


def _once(found: list, repeated: bool):
    """The edges found; where some may be ``repeated``, as those of repeated ids are, once each."""
    if not found:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)
    low, high, weight = (np.concatenate(part) for part in zip(*found))
    if not repeated:
        return low, high, weight
    _, once = np.unique(np.stack([low, high]), axis=1, return_index=True)
    return low[once], high[once], weight[once]


def unite(label: np.ndarray, names: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Follow each component's chosen neighbour and relabel by the roots.

    Under a total order only two components that chose each other form a cycle; the
    smaller of them becomes the root.
    """
    to = np.arange(len(label))
    to[names] = chosen
    mutual = to[to] == np.arange(len(label))
    to = np.where(mutual, np.minimum(to, np.arange(len(label))), to)
    return compress(to)[label]


def compress(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def component_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return nodes, nodes[label]
        la, lb = la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        label = compress(label)


def forest(u, v, weight, left, right) -> np.ndarray:
    """Indices of the minimum spanning forest of edges ``u - v``.

    ``left`` and ``right`` name the edges in the tie order; they differ from ``u``
    and ``v`` when the endpoints are already contracted components.
    """
    order = np.lexsort((right, left, weight))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)][order], at[len(u) :][order]
    rank = np.arange(len(order))
    label = np.arange(len(nodes))
    kept = []
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, rank, la, lb = a[apart], b[apart], rank[apart], la[apart], lb[apart]
        lightest = np.full(len(nodes), len(order))
        np.minimum.at(lightest, la, rank)
        np.minimum.at(lightest, lb, rank)
        chosen = np.flatnonzero((lightest[la] == rank) | (lightest[lb] == rank))
        kept.append(rank[chosen])
        to = np.arange(len(nodes))
        mine = lightest[la] == rank
        to[la[mine]] = lb[mine]
        mine = lightest[lb] == rank
        to[lb[mine]] = la[mine]
        label = unite(label, np.arange(len(nodes)), to)
    return np.sort(order[np.concatenate(kept)]) if kept else np.empty(0, dtype=np.int64)


def merge_steps(a, size_a, b, size_b, step, base: int):
    """Join clusters along edges already in rank order.

    Returns the two cluster ids merged at each step, smaller id first, and the size
    of the result. A cluster formed at step ``t`` has id ``base + t``.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    sizes = np.empty(len(nodes), dtype=np.int64)
    sizes[at] = np.concatenate([size_a, size_b])
    parent, cluster, size = list(range(len(nodes))), nodes.tolist(), sizes.tolist()
    ends = list(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), step.tolist()))
    first, second, total = [], [], []

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y, t in ends:
        x, y = root(x), root(y)
        first.append(min(cluster[x], cluster[y]))
        second.append(max(cluster[x], cluster[y]))
        if size[x] < size[y]:
            x, y = y, x
        parent[y] = x
        size[x] += size[y]
        cluster[x] = base + t
        total.append(size[x])
    return first, second, total


def distance_table(left, right) -> np.ndarray:
    """All distances of a tile; the bound on blocks keeps it at some tens of MB."""
    table = np.empty((len(left), len(right)))
    for i, row in enumerate(left.distance_rows(right)):
        table[i] = row
    return table


def outgoing(left, right=None) -> dict[str, np.ndarray]:
    """Lightest edge of a tile leaving each component, by ``(weight, left, right)``."""
    same = right is None
    other = left if same else right
    mine, theirs = left.extra["component"], other.extra["component"]
    parts = _apart(mine, theirs, same) if len(left) and len(other) else []
    found = None
    if left.sparse is None and left.coords.shape[1] and sum(len(r) * len(c) for r, c in parts) >= SCREENED:
        found = _screened_outgoing(left, other, parts)
    if found is None:
        found = [_lightest_of(left, other, r, c) for r, c in parts]
    i, j, weight = (np.concatenate([f[k] for f in found]) if found else np.empty(0, "i8") for k in range(3))
    low, high = np.minimum(left.ids[i], other.ids[j]), np.maximum(left.ids[i], other.ids[j])
    node, to = np.concatenate([mine[i], theirs[j]]), np.concatenate([theirs[j], mine[i]])
    columns = node, to, np.tile(low, 2), np.tile(high, 2), np.tile(weight, 2).astype("f8")
    return lightest_per_node(dict(zip(("node", "to", "left", "right", "weight"), columns)))


def _lightest_of(left, other, rows: np.ndarray, cols: np.ndarray):
    """``(row, column, weight)`` of the lightest edges of each row and column of a part, to
    other components."""
    table = distance_table(left, other)[np.ix_(rows, cols)]
    table[left.extra["component"][rows][:, None] == other.extra["component"][cols][None, :]] = np.inf
    light = (table == table.min(axis=1)[:, None]) | (table == table.min(axis=0)[None, :])
    i, j = np.nonzero(light & np.isfinite(table))
    return rows[i], cols[j], table[i, j]


def _screened_outgoing(left, other, parts):
    """:func:`_lightest_of` for all parts, of the pairs that a screening leaves; None if too many."""
    for kind in ("f4", "f8"):
        screen = Screen(left.coords, other.coords, kind)
        found = []
        for rows, cols in parts:
            table = screen.table[rows] if len(cols) == len(other) else screen.table[np.ix_(rows, cols)]
            table[left.extra["component"][rows][:, None] == other.extra["component"][cols][None, :]] = np.inf
            by_row, by_col = (screen.above(table.min(axis=k).astype("f8") + 2 * screen.slack) for k in (1, 0))
            light = (table <= by_row[:, None]) | (table <= by_col[None, :])
            light &= table < np.inf
            if np.count_nonzero(light) > max(16 * sum(table.shape), table.size // 4):
                break
            i, j = np.nonzero(light)
            i, j = rows[i], cols[j]
            found.append((i, j, measured(left.coords, other.coords, i, j)))
        else:
            return found
        if screen.kind == "f8":
            break
    return None


def lightest_per_node(edges) -> dict[str, np.ndarray]:
    """The first row of each ``node`` by ``(weight, left, right)``."""
    order = np.lexsort((edges["right"], edges["left"], edges["weight"], edges["node"]))
    node = edges["node"][order]
    first = order[np.flatnonzero(np.diff(node, prepend=node[:1] - 1))]
    return {name: column[first] for name, column in edges.items()}


# Sparse rows whose distances are formed at a time.
SPARSE_ROWS = 128


def sparse_distance_rows(x, y):
    """Like ``distance_rows`` for sparse rows ``(starts, columns, values)``.

    Uses the norms of the rows and, for rows that share columns, their dot products;
    the shared entries of the tile are found by one sorted match on the column.
    """
    (x_start, x_col, x_val), (y_start, y_col, y_val) = x, y
    x_row = np.repeat(np.arange(len(x_start) - 1), np.diff(x_start))
    y_row = np.repeat(np.arange(len(y_start) - 1), np.diff(y_start))
    x_norm = np.bincount(x_row, x_val * x_val, len(x_start) - 1)
    y_norm = np.bincount(y_row, y_val * y_val, len(y_start) - 1)
    order = np.argsort(y_col, kind="stable")
    y_col, y_val, y_row = y_col[order], y_val[order], y_row[order]
    first = np.searchsorted(y_col, x_col, "left")
    count = np.searchsorted(y_col, x_col, "right") - first
    for low in range(0, len(x_start) - 1, SPARSE_ROWS):
        high = min(low + SPARSE_ROWS, len(x_start) - 1)
        square = x_norm[low:high, None] + y_norm[None, :]
        entries = np.arange(x_start[low], x_start[high])
        hits = count[entries]
        mine = np.repeat(entries, hits)
        theirs = np.arange(len(mine)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(first[entries], hits)
        # In the order of the entries, whatever they share.
        np.subtract.at(square, (x_row[mine] - low, y_row[theirs]), 2 * (x_val[mine] * y_val[theirs]))
        yield from np.sqrt(np.maximum(square, 0.0, out=square), out=square)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of the runs of equal values in a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, values[starts]


def pair_summary(left, right) -> dict[str, np.ndarray]:
    """Number, extremes and sum of the distances of a tile, each pair once."""
    count, low, high, total = 0, np.inf, -np.inf, 0.0
    other = left if right is None else right
    if right is None:
        for i, row in enumerate(left.distance_rows(other)):
            row = row[i + 1 :]
            if len(row):
                count += len(row)
                low, high, total = min(low, row.min()), max(high, row.max()), total + row.sum()
    elif len(left) and len(right):
        table = distance_table(left, right)
        count, low, high = table.size, table.min(), table.max()
        total = np.add.accumulate(table.sum(axis=1))[-1]
    if not count:
        return {name: np.empty(0) for name in ("pairs", "shortest", "longest", "total")}
    found = {"pairs": count, "shortest": low, "longest": high, "total": total}
    return {name: np.array([value]) for name, value in found.items()}


# Bytes of distances that are summed up together.
SUMMARY_BYTES = 8 << 20


def pair_summaries(pairs) -> dict[str, np.ndarray]:
    """:func:`pair_summary` of all listed pairs of blocks, ``pair`` tells of which.

    In many dimensions one matrix product takes a block with several others. What is nearest
    or farthest within the error of that, and all near pairs, are measured.
    """
    found, at = [], 0
    sides = {}
    while at < len(pairs):
        left, several = pairs[at][0], [at]
        rows, cols = len(left), 0 if pairs[at][1] is None else len(pairs[at][1])
        for k in range(at + 1, len(pairs)):
            if not cols or pairs[k][0] is not left or pairs[k][1] is None:
                break
            cols += len(pairs[k][1])
            if 8 * rows * cols > SUMMARY_BYTES:
                break
            several.append(k)
        got = _summaries_of_products(left, [pairs[k][1] for k in several], sides)
        if got is None:
            for k in several:
                one = pair_summary(*pairs[k])
                found.append({"pair": np.full(len(one["pairs"]), k), **one})
        else:
            found.append({"pair": np.array(several), **got})
        at = several[-1] + 1
    return {name: np.concatenate([f[name] for f in found]) for name in ("pair", "pairs", "shortest", "longest", "total")}


def _summaries_of_products(left, others, sides: dict):
    """Facts of the pairs of a block with others; None if they are to be measured one by one.
    ``sides`` keeps what is known of a block, by its place in memory."""
    if others[0] is None or left.sparse is not None or left.coords.shape[1] <= MEASURED_DIMENSIONS:
        return None
    if not len(left) or not all(map(len, others)):
        return None
    if not sides:
        sides["centre"] = left.coords.mean(axis=0)
    for block in (left, *others):
        if id(block) not in sides:
            a = block.coords - sides["centre"]
            norm = np.einsum("ij,ij->i", a, a)
            sides[id(block)] = a, norm, norm.max(), np.abs(block.coords).max()
    a, norm, *_ = sides[id(left)]
    known = [sides[id(block)] for block in others]
    top, far = (max(sides[id(block)][k] for block in (left, *others)) for k in (2, 3))
    if not 1e-6 * far * far < top < 1e200:
        return None
    dim, counts = a.shape[1], np.array([len(block) for block in others])
    x, y = np.ones((len(a), dim + 2)), np.ones((counts.sum(), dim + 2))
    np.multiply(a, -2.0, out=x[:, :dim])
    x[:, dim] = norm
    np.concatenate([k[0] for k in known], out=y[:, :dim])
    y[:, dim + 1] = np.concatenate([k[1] for k in known])
    table = x @ y.T
    unit = np.finfo("f8").eps
    error = 16.0 * (dim + 4) * unit * (top + far * np.sqrt(dim * top)) / np.sqrt(FAR_APART * top)
    coords, near = np.concatenate([block.coords for block in others]), None
    if table.min() < FAR_APART * top:
        near = np.nonzero(table < FAR_APART * top)
        if len(near[0]) > table.size // 4:
            return None
        np.maximum(table, 0.0, out=table)
    np.sqrt(table, out=table)
    if near is not None:
        table[near] = measured(left.coords, coords, *near)
    starts = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), counts)
    ends = []
    for fold, sign in ((np.minimum, 1.0), (np.maximum, -1.0)):
        by_col = fold.reduce(table, axis=0)
        # Entries that may be the first of their pair of blocks.
        bound = fold.reduceat(by_col, starts) + sign * 2 * error
        cols = np.flatnonzero(sign * by_col <= sign * bound[of])
        i, j = np.nonzero((sign * table[:, cols] <= sign * bound[of[cols]]).T)[::-1]
        if len(i) > table.size // 4:
            return None
        exact = measured(left.coords, coords, i, cols[j])
        ends.append(fold.reduceat(exact, runs(of[cols[j]])[0]))
    total = np.add.reduceat(np.add.reduce(table, axis=0), starts)
    return {"pairs": counts * len(left), "shortest": ends[0], "longest": ends[1], "total": total}


def silhouette_sums(left, right) -> dict[str, np.ndarray]:
    """Distance sums of a tile's points to the clusters on the other side.

    Extra columns: ``label``, ``copies`` (points folded into a row) and ``size`` of the
    cluster. Per point there is one row for its own cluster, with ``best`` the smallest
    mean distance to a cluster that lies wholly in the other block, and one row for
    each other cluster that lies only partly in it, with ``inside``, the points of it that
    were measured. Blocks hold runs of clusters, so at most two of those exist.
    """
    sides = [left] if right is None else [left, right]
    data = []
    for side in sides:
        order = np.argsort(side.extra["label"], kind="stable")
        starts, names = runs(side.extra["label"][order])
        copies = side.extra["copies"].astype("f8")
        inside = np.add.reduceat(copies[order], starts)
        data.append((order, starts, names, copies, inside, side.extra["size"][order][starts]))
    other = left if right is None else right
    order, starts, names, copies = data[-1][:4]
    towards = np.empty((len(left), len(names)))
    back = np.zeros((len(data[0][2]), len(other))) if right is not None else None
    at = np.searchsorted(data[0][2], left.extra["label"])
    for i, row in enumerate(left.distance_rows(other)):
        towards[i] = np.add.reduceat((row * copies)[order], starts)
        if back is not None:
            back[at[i]] += row * data[0][3][i]
    found = [_silhouette_rows(left, towards, data[-1])]
    if back is not None:
        found.append(_silhouette_rows(right, back.T, data[0]))
    return {name: np.concatenate([f[name] for f in found]) for name in found[0]}


def _silhouette_rows(side, sums: np.ndarray, clusters) -> dict[str, np.ndarray]:
    names, inside, size = clusters[2], clusters[4], clusters[5]
    label = side.extra["label"]
    mine = label[:, None] == names[None, :]
    whole = inside == size
    means = np.where(mine | ~whole, np.inf, sums / size)
    found = {
        "id": [side.ids],
        "label": [label],
        "own": [np.ones(len(side), dtype=bool)],
        "size": [side.extra["size"]],
        "total": [np.where(mine, sums, 0.0).sum(axis=1)],
        "best": [means.min(axis=1)],
        "copies": [side.extra["copies"]],
        "inside": [np.zeros(len(side), dtype=np.int64)],
    }
    for k in np.flatnonzero(~whole):
        rest = ~mine[:, k]
        n = int(rest.sum())
        found["id"].append(side.ids[rest])
        found["label"].append(np.full(n, names[k]))
        found["own"].append(np.zeros(n, dtype=bool))
        found["size"].append(np.full(n, size[k]))
        found["total"].append(sums[rest, k])
        found["best"].append(np.full(n, np.inf))
        found["copies"].append(np.zeros(n, dtype=np.int64))
        found["inside"].append(np.full(n, inside[k], dtype=np.int64))
    return {name: np.concatenate(parts) for name, parts in found.items()}


def united_sums(rows) -> dict[str, np.ndarray]:
    """Rows of :func:`silhouette_sums` of several tiles, one per point and label."""
    order = np.lexsort((rows["label"], rows["id"]))
    id, label = rows["id"][order], rows["label"][order]
    start = np.flatnonzero((np.diff(id, prepend=id[:1] - 1) != 0) | (np.diff(label, prepend=label[:1] - 1) != 0))
    fold = {"total": np.add, "inside": np.add, "best": np.minimum}
    return {
        name: fold.get(name, np.maximum).reduceat(column[order], start) if len(start) else column
        for name, column in rows.items()
    }


def centre_squares(clusters, points):
    """Yield, for each of ``points``, its mean squared distance to the points of each cluster.

    A cluster is its centre with ``spread``, the mean squared distance to it.
    """
    for row in points.distance_rows(clusters):
        yield row * row + clusters.extra["spread"]


def squared_scores(clusters, points) -> dict[str, np.ndarray]:
    """Mean squared distance of each point to the others of its cluster (-1: not in the tile)
    and the least one to another cluster."""
    own, best = np.full(len(points), -1.0), np.full(len(points), np.inf)
    at = np.searchsorted(clusters.ids, points.extra["label"])
    here = at < len(clusters)
    here[here] = clusters.ids[at[here]] == points.extra["label"][here]
    for i, row in enumerate(centre_squares(clusters, points)):
        if here[i]:
            size = clusters.extra["size"][at[i]]
            own[i] = row[at[i]] * size / max(size - 1, 1)
            row[at[i]] = np.inf
        best[i] = row.min(initial=np.inf)
    return {"id": points.ids, "own": own, "best": best, "size": points.extra["size"]}


def best_scores(rows) -> dict[str, np.ndarray]:
    """Rows of :func:`squared_scores` of several tiles, one per point."""
    order = np.argsort(rows["id"], kind="stable")
    start = np.flatnonzero(np.diff(rows["id"][order], prepend=rows["id"][order][:1] - 1))
    fold = {"best": np.minimum}
    return {
        name: fold.get(name, np.maximum).reduceat(column[order], start) if len(start) else column
        for name, column in rows.items()
    }


def open_clusters(clusters, points, slack: float) -> dict[str, np.ndarray]:
    """``(block, label)``: clusters that may be the nearest of some point of a block.

    No mean distance to a cluster is below the distance to its centre, and the nearest
    one's isn't above ``bound`` of the point.
    """
    near = np.zeros(len(clusters), dtype=bool)
    for i, row in enumerate(points.distance_rows(clusters)):
        near |= row * slack <= points.extra["bound"][i]
    label = clusters.ids[near]
    return {"block": np.full(len(label), points.extra["place"][0]), "label": label}


# Linkage methods (fixed names): how distances of points combine to one of clusters.
METHODS = ("single", "complete", "average", "weighted", "ward")


def linkage_value(method: str, found, size_a, spread_a, size_b, spread_b):
    """Height at which two clusters merge, from their complete linkage.

    ``found`` is the least or greatest distance, or the weighted mean of the distances
    (of their squares for Ward, whose ``spread`` is the mean squared distance of a
    cluster's points to its centre).
    """
    if method != "ward":
        return found
    gap = np.maximum(found - spread_a - spread_b, 0.0)
    return np.sqrt(2.0 * size_a * size_b / (size_a + size_b) * gap)


# How the distances of two clusters' points combine (others: they are added up), and of none.
FOLDS = {"single": np.minimum, "complete": np.maximum}
NONE_FOUND = {"single": np.inf, "complete": -np.inf}
# Dimensions up to which distances are measured coordinate by coordinate, and squared
# distances, as part of the largest squared norm, from which on a product gives them.
MEASURED_DIMENSIONS, FAR_APART = 8, 1e-3


class Members:
    """The rows of a block in the order of their clusters.

    ``starts`` and ``counts`` are the runs of rows, ``names`` and the facts those of the clusters;
    ``whole`` tells which have all their members in the block.
    """

    def __init__(self, block, rows: np.ndarray | None = None):
        names = block.extra["cluster"]
        rows = np.argsort(names, kind="stable") if rows is None else rows
        self.block, self.rows, self.dense = block, rows, block.sparse is None
        self.starts, self.names = runs(names[rows])
        self.counts = np.diff(np.append(self.starts, len(rows)))
        pick = rows[self.starts]
        self.facts = {name: block.extra[name][pick] for name in ("members", "size", "spread")}
        self.whole = self.counts == self.facts["members"]
        self.share = block.extra["share"][rows]
        self.coords = block.coords[rows] if self.dense else None
        self.sparse = None if self.dense else sparse_rows(block.sparse, rows)

    def __len__(self) -> int:
        return len(self.rows)

    def only(self, clusters: np.ndarray) -> Members:
        """The rows of some clusters, given as a mask."""
        return self if clusters.all() else Members(self.block, self.rows[np.repeat(clusters, self.counts)])

    def distance_rows(self, other: Members):
        if self.dense:
            return distance_rows(self.coords, other.coords)
        return sparse_distance_rows(self.sparse, other.sparse)


def sparse_rows(sparse, rows: np.ndarray):
    """The listed ones of sparse rows ``(starts, columns, values)``."""
    starts, cols, vals = sparse
    counts = np.diff(starts)[rows]
    ends = np.cumsum(counts)
    at = np.arange(counts.sum()) + np.repeat(starts[rows] - (ends - counts), counts)
    return np.concatenate([[0], ends]).astype("i8"), cols[at], vals[at]


def point_distances(left, right) -> np.ndarray:
    """All distances of a tile. In many dimensions they come from one matrix product, right
    to far more bits than linkages are compared by; those of near points are measured."""
    if left.sparse is not None:
        return distance_table(left, right)
    if left.coords.shape[1] <= MEASURED_DIMENSIONS or len(left) * len(right) < SCREENED:
        # Row by row of the side that has fewer.
        return distance_table(left, right) if len(left) <= len(right) else distance_table(right, left).T.copy()
    x, y = left.coords, right.coords
    centre, dim = x.mean(axis=0), x.shape[1]
    a, b = np.ones((len(x), dim + 2)), np.ones((len(y), dim + 2))
    np.subtract(x, centre, out=a[:, :dim])
    np.subtract(y, centre, out=b[:, :dim])
    norm_a, norm_b = (np.einsum("ij,ij->i", z[:, :dim], z[:, :dim]) for z in (a, b))
    top, far = max(norm_a.max(), norm_b.max()), max(np.abs(x).max(), np.abs(y).max())
    # Norms far below the coordinates, or too large, have lost their bits.
    if not 1e-6 * far * far < top < 1e200:
        return distance_table(left, right)
    a[:, :dim] *= -2.0
    a[:, dim], b[:, dim + 1] = norm_a, norm_b
    table = a @ b.T
    if table.min() < FAR_APART * top:
        near = table < FAR_APART * top
        if np.count_nonzero(near) > table.size // 4:
            return distance_table(left, right)
        i, j = np.nonzero(near)
        np.sqrt(np.maximum(table, 0.0, out=table), out=table)
        table[i, j] = measured(x, y, i, j)
        return table
    return np.sqrt(table, out=table)


# Rows of a cluster that are added to those of others at a time, before its rest is by itself.
LAYERS = 8


def folded_rows(fold, table: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``fold`` of the runs of rows, whole rows at a time."""
    if len(starts) == len(table):
        return table
    out = table[starts]
    for k in range(1, min(int(counts.max()), LAYERS)):
        more = np.flatnonzero(counts > k)
        out[more] = fold(out[more], table[starts[more] + k])
    for i in np.flatnonzero(counts > LAYERS):
        out[i] = fold(out[i], fold.reduce(table[starts[i] + LAYERS : starts[i] + counts[i]], axis=0))
    return out


def folded_members(method: str, table: np.ndarray, a: Members, b: Members) -> np.ndarray:
    """The distances of the rows of ``a`` and ``b`` (for Ward squared) as those of their clusters.
    ``table`` is used up."""
    fold = FOLDS.get(method, np.add)
    if fold is np.add:
        for share, axis in ((a.share[:, None], a), (b.share[None, :], b)):
            # The share of a single member is one.
            if len(axis.starts) < len(axis) or not axis.whole.all():
                table *= share.astype(table.dtype)
    table = folded_rows(fold, table, a.starts, a.counts)
    return table if len(b.starts) == len(b) else fold.reduceat(table, b.starts, axis=1)


def cluster_linkages(method: str, a: Members, b: Members) -> np.ndarray:
    """Linkage of every cluster of one side with every cluster of the other."""
    table = point_distances(a, b)
    if method == "ward":
        np.multiply(table, table, out=table)
    return folded_members(method, table, a, b)


# Bits of a linkage that count when linkages are compared: sums of distances depend on
# their order in the last few bits only.
STEADY_BITS = 32


def steady(x: np.ndarray) -> np.ndarray:
    """``x`` rounded to ``STEADY_BITS`` significant bits."""
    bits, drop = np.ascontiguousarray(x, "f8").view("i8"), 53 - STEADY_BITS
    # Half to even, as ``rint`` does; infinities stay.
    rounded = bits >> drop
    rounded &= 1
    rounded += bits
    rounded += (1 << (drop - 1)) - 1
    rounded &= -(1 << drop)
    return rounded.view("f8").reshape(np.shape(x))


def linkage_tile(method: str, left, right) -> dict[str, np.ndarray]:
    """Candidate merges of a tile.

    ``node`` and ``to`` are cluster names. For two clusters that lie wholly in the tile
    the linkage is final, and only each cluster's best ones are kept (``settled``). A cluster
    spread over blocks gives partial linkages.
    """
    same = right is None
    a = Members(left)
    b = a if same else Members(right)
    # Rows of clusters that are spread over blocks, which need the whole table.
    rest_a, rest_b = (int(x.counts[~x.whole].sum()) for x in (a, b))
    found = None
    if rest_a * len(b) + rest_b * len(a) <= len(a) * len(b) // 2:
        found = _screened_linkages(method, a, b, same)
    if found is not None:
        none, every = np.zeros_like(a.whole), np.ones_like(b.whole)
        out = [*found, *(
            _partial(method, a, b, of_a, of_b, same)
            for of_a, of_b in ((~a.whole, every), (a.whole if rest_b else none, ~b.whole))
        )]
    else:
        out = _whole_linkages(method, a, b, same)
    rows, cols, value, settled, turned = (
        np.concatenate([np.broadcast_to(o[k], len(o[0])) for o in out]) for k in range(5)
    )
    ends = [(x.names[at], x.facts["size"][at], x.facts["spread"][at]) for x, at in ((a, rows), (b, cols))]
    first = [np.where(turned, y, x) for x, y in zip(*ends)]
    second = [np.where(turned, x, y) for x, y in zip(*ends)]
    return {
        "node": first[0], "node_size": first[1], "node_spread": first[2],
        "to": second[0], "to_size": second[1], "to_spread": second[2],
        "value": value, "settled": settled,
    }


def _facts_of(a: Members, b: Members, kind: str = "f8"):
    """Sizes and spreads of the rows and columns of a table of linkages."""
    return (x.facts[name].astype(kind)[at] for x, at in ((a, np.s_[:, None]), (b, np.s_[None, :])) for name in ("size", "spread"))


def _unsettle(ranked: np.ndarray, a: Members, b: Members) -> None:
    """Leave out clusters spread over blocks, and each with itself."""
    ranked[~a.whole] = np.inf
    ranked[:, ~b.whole] = np.inf
    # Names ascend, so a name is at most once on each side.
    mine = np.isin(a.names, b.names, assume_unique=True).nonzero()[0]
    ranked[mine, np.searchsorted(b.names, a.names[mine])] = np.inf


def _whole_linkages(method: str, a: Members, b: Members, same: bool):
    """``(rows, columns, linkages, settled, turned)``: the best linkages, and all partial ones, from
    the table of all."""
    table = cluster_linkages(method, a, b)
    value = linkage_value(method, table, *_facts_of(a, b))
    ranked = steady(value)
    _unsettle(ranked, a, b)
    out = [_best_of(ranked, value, by_row) for by_row in ((True, False) if not same else (True,))]
    for of_a, of_b in ((~a.whole, np.ones_like(b.whole)), (a.whole, ~b.whole)):
        at = _apart_from(a, b, of_a, of_b, same)
        out.append((*at, table[at], False, False))
    return out


def _apart_from(a: Members, b: Members, of_a: np.ndarray, of_b: np.ndarray, same: bool):
    """Pairs of different ones of the given clusters; of a block with itself, once each."""
    rows, cols = (x.ravel() for x in np.meshgrid(*map(np.flatnonzero, (of_a, of_b)), indexing="ij"))
    apart = a.names[rows] < b.names[cols] if same else a.names[rows] != b.names[cols]
    return rows[apart], cols[apart]


def _partial(method: str, a: Members, b: Members, of_a: np.ndarray, of_b: np.ndarray, same: bool):
    """Partial linkages of the given clusters."""
    if not of_a.any() or not of_b.any():
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0), False, False
    table = cluster_linkages(method, a.only(of_a), b.only(of_b))
    rows, cols = _apart_from(a, b, of_a, of_b, same)
    return rows, cols, table[np.cumsum(of_a)[rows] - 1, np.cumsum(of_b)[cols] - 1], False, False


# More than the part by which linkages of equal steady bits differ.
TIED = 2.0 ** (2 - STEADY_BITS)


class SparseSquares:
    """Squared distances of sparse rows: sums of two norms, less twice the product of those that
    share columns."""

    def __init__(self, x, y):
        (x_start, x_col, x_val), (y_start, y_col, y_val) = x, y
        n, m = len(x_start) - 1, len(y_start) - 1
        x_row, y_row = (np.repeat(np.arange(len(s) - 1), np.diff(s)) for s in (x_start, y_start))
        self.norms = np.bincount(x_row, x_val * x_val, n), np.bincount(y_row, y_val * y_val, m)
        order = np.argsort(y_col, kind="stable")
        first = np.searchsorted(y_col[order], x_col, "left")
        hits = np.searchsorted(y_col[order], x_col, "right") - first
        mine = np.repeat(np.arange(len(x_col)), hits)
        theirs = order[np.arange(len(mine)) + np.repeat(first - (np.cumsum(hits) - hits), hits)]
        self.at, of = np.unique(x_row[mine] * m + y_row[theirs], return_inverse=True)
        self.less = np.bincount(of, 2 * (x_val[mine] * y_val[theirs]), len(self.at))
        self.columns = m

    def table(self, kind: str):
        """All of them, by how much they may be off, and a bound on their norms."""
        a, b = self.norms
        top = max(a.max(), b.max())
        kind = kind if 1e-20 < top < 1e30 else "f8"
        table = a.astype(kind)[:, None] + b.astype(kind)[None, :]
        table.reshape(-1)[self.at] -= self.less.astype(kind)
        return table, 16.0 * (np.finfo(kind).eps * top + np.finfo(kind).tiny), top

    def measured(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of the listed pairs."""
        square, flat = self.norms[0][i] + self.norms[1][j], i * self.columns + j
        if len(self.at):
            k = np.minimum(np.searchsorted(self.at, flat), len(self.at) - 1)
            square -= np.where(self.at[k] == flat, self.less[k], 0.0)
        return np.sqrt(np.maximum(square, 0.0, out=square), out=square)


def _screened_linkages(method: str, a: Members, b: Members, same: bool):
    """The best settled linkages of each row and column, as :func:`_whole_linkages` has them, of
    the pairs that a table of four or eight bytes leaves; None if too many."""
    if len(a) * len(b) < SCREENED or (a.dense and a.coords.shape[1] <= MEASURED_DIMENSIONS):
        return None
    squares = None if a.dense else SparseSquares(a.sparse, b.sparse)
    for kind in ("f4", "f8"):
        if a.dense:
            screen = Screen(a.coords, b.coords, kind)
            table, error, top = screen.table, screen.slack, screen.top
        else:
            table, error, top = squares.table(kind)
        kind = table.dtype
        most = 4.0 * top
        if same:
            np.fill_diagonal(table, np.inf)
        least = float(table.min())
        if method != "ward":
            if least <= 0:
                np.maximum(table, 0, out=table)
            np.sqrt(table, out=table)
            error = error / np.sqrt(least) if least > error else np.sqrt(2 * error)
            most = np.sqrt(most)
        # Every sum is off by a bit per addend.
        error += (int(a.counts.max()) + int(b.counts.max()) + 8) * np.finfo(kind).eps * (most + error)
        table = folded_members(method, table, a, b)
        if method == "ward":
            error += 4 * np.finfo(kind).eps * float(a.facts["spread"].max() + b.facts["spread"].max())
            low, high = (linkage_value(method, table + kind.type(off), *_facts_of(a, b, kind)) for off in (-error, error))
            _unsettle(high, a, b)
            off, part = 0.0, 1 + 32 * np.finfo(kind).eps + TIED
        else:
            low = high = table
            off, part = 2 * error, 1 + TIED
        _unsettle(low, a, b)
        bounds = []
        for axis in (1, 0):
            bound = high.min(axis=axis).astype("f8") * part + off
            bounds.append(np.nextafter(bound.astype(kind), kind.type(np.inf)))
        light = low <= bounds[0][:, None]
        if not same:
            light |= low <= bounds[1][None, :]
        light &= low < np.inf
        if np.count_nonzero(light) > max(16 * sum(light.shape), light.size // 4):
            continue
        i, j = np.divmod(np.flatnonzero(light), light.shape[1])
        pairs = a.counts[i] * b.counts[j]
        if pairs.sum() > len(a) * len(b) // 4:
            return None
        by_row, by_col = low[i, j] <= bounds[0][i], low[i, j] <= bounds[1][j]
        # The rows of all these pairs of clusters.
        ends = np.cumsum(pairs)
        within = np.arange(pairs.sum()) - np.repeat(ends - pairs, pairs)
        width = np.repeat(b.counts[j], pairs)
        rows, cols = np.repeat(a.starts[i], pairs) + within // width, np.repeat(b.starts[j], pairs) + within % width
        apart = measured(a.coords, b.coords, rows, cols) if a.dense else squares.measured(rows, cols)
        fold = FOLDS.get(method, np.add)
        if fold is np.add:
            if method == "ward":
                apart *= apart
            apart *= a.share[rows]
            apart *= b.share[cols]
        value = fold.reduceat(apart, ends - pairs) if len(i) else np.empty(0)
        facts = [x.facts[name][at] for x, at in ((a, i), (b, j)) for name in ("size", "spread")]
        value = linkage_value(method, value, *facts)
        found = [(i[by_row], j[by_row], value[by_row], True, False)]
        return found if same else [*found, (i[by_col], j[by_col], value[by_col], True, True)]
    return None


def _best_of(ranked, value, by_row: bool):
    # Among equal values the pair with the smallest (lower name, higher name) wins.
    # Names ascend, so for one cluster that is simply the smallest other name.
    axis = 1 if by_row else 0
    pick = ranked.argmin(axis=axis) if ranked.size else np.empty(0, "i8")
    every = np.arange(len(pick))
    low = ranked[every, pick] if by_row else ranked[pick, every]
    has = np.flatnonzero(np.isfinite(low))
    pick = pick[has]
    if by_row:
        return has, pick, value[has, pick], True, False
    return pick, has, value[pick, has], True, True


# What a task that merges many clusters knows of each.
FACTS = np.dtype(
    [("name", "i8"), ("uid", "i8"), ("members", "i8"), ("size", "i8"), ("spread", "f8"), ("top", "f8")]
)


def linkage_block(method: str, left, right) -> dict[str, np.ndarray]:
    """All linkages of a tile, whole or partial, as one row of buffers."""
    a = Members(left)
    b = a if right is None else Members(right)
    facts = np.empty(len(a.names) if right is None else 0, FACTS)
    if right is None:
        facts["name"] = a.names
        for name in FACTS.names[1:]:
            facts[name] = left.extra[name][a.rows[a.starts]]
    found = {"rows": a.names, "cols": b.names, "found": cluster_linkages(method, a, b), "facts": facts}
    return {name: np.array([column.tobytes()], dtype=object) for name, column in found.items()}


def linkage_matrix(method: str, tiles) -> tuple[np.ndarray, np.ndarray]:
    """Facts of all clusters by name, and their linkages, from the tiles ``(rows, cols, found,
    facts)`` of :func:`linkage_block`."""
    facts = np.concatenate([np.frombuffer(t[3], FACTS) for t in tiles])
    facts = facts[np.unique(facts["name"], return_index=True)[1]]
    fold = FOLDS.get(method, np.add)
    total = np.full((len(facts), len(facts)), NONE_FOUND.get(method, 0.0))
    for rows, cols, found, own in tiles:
        a, b = (np.searchsorted(facts["name"], np.frombuffer(x, "i8")) for x in (rows, cols))
        found = np.frombuffer(found, "f8").reshape(len(a), len(b))
        # Blocks hold runs of clusters.
        a, b = slice(a[0], a[-1] + 1), slice(b[0], b[-1] + 1)
        for at, part in (((a, b), found), ((b, a), found.T)):
            total[at] = fold(total[at], part)
            if len(own):
                # A block with itself has both directions.
                break
    size, spread = facts["size"].astype("f8"), facts["spread"]
    value = linkage_value(method, total, size[:, None], spread[:, None], size[None, :], spread[None, :])
    np.fill_diagonal(value, np.inf)
    return facts, value


def best_candidates(rows) -> dict[str, np.ndarray]:
    """The best settled candidate of each ``node`` of several tiles, and all partial ones."""
    settled = np.flatnonzero(rows["settled"])
    node = rows["node"][settled]
    order = np.lexsort((rows["to"][settled], steady(rows["value"][settled]), node))
    first = order[np.flatnonzero(np.diff(node[order], prepend=node[order][:1] - 1))]
    keep = np.concatenate([settled[first], np.flatnonzero(~rows["settled"])])
    return {name: column[keep] for name, column in rows.items()}


def merge_matrix(method: str, names, sizes, pairs_a, pairs_b, values):
    """Merge a bounded number of clusters to one, nearest pair first.

    Returns per merge: the two names, the height and the size. A merged cluster keeps
    the smaller name. Linkages are compared by their steady bits, updated and given in full.
    """
    table = np.full((len(names), len(names)), np.inf)
    a, b = np.searchsorted(names, pairs_a), np.searchsorted(names, pairs_b)
    table[a, b] = table[b, a] = values
    return [(names[i], names[j], height, size) for i, j, height, size in merge_table(method, sizes, table)]


# Places of a table of linkages from which on the empty half of it is left out.
EMPTIED = 256


def merge_table(method: str, sizes, table: np.ndarray, below: float = np.inf):
    """Yield the merges of linkages below ``below``, nearest pair first: the two places, the
    height and the size. The cluster stays at the smaller place. ``table`` is used up.

    A linkage never falls, so what a cluster was nearest to bounds it; it looks again only
    when that bound is the least of all.
    """
    k = len(sizes)
    size, live = sizes.astype("f8"), np.ones(k, dtype=bool)
    nearest, low, stale = np.zeros(k, "i8"), np.full(k, np.inf), np.zeros(k, dtype=bool)
    for start in range(0, k, 256):
        part = steady(table[start : start + 256])
        nearest[start : start + 256] = part.argmin(axis=1)
        low[start : start + 256] = part.min(axis=1)
    left, place = k - 1, np.arange(k)
    while left > 0:
        if left < len(live) // 2 and len(live) > EMPTIED:
            # Half of the places are empty; those left keep their order.
            keep = np.flatnonzero(live)
            now = np.cumsum(live) - 1
            table = table[np.ix_(keep, keep)]
            size, nearest, low, stale, place, live = (x[keep] for x in (size, nearest, low, stale, place, live))
            nearest = np.maximum(now[nearest], 0)
        i = int(low.argmin())
        # Without a bound all merge, those whose linkage is no number first.
        if below < np.inf and not low[i] < below:
            return
        if stale[i]:
            row = steady(table[i])
            row[~live] = np.inf
            nearest[i] = row.argmin()
            low[i], stale[i] = row[nearest[i]], False
            continue
        j = int(nearest[i])
        i, j = min(i, j), max(i, j)
        height, si, sj = table[i, j], size[i], size[j]
        if method == "single":
            row = np.minimum(table[i], table[j])
        elif method == "complete":
            row = np.maximum(table[i], table[j])
        elif method == "average":
            row = (si * table[i] + sj * table[j]) / (si + sj)
        elif method == "weighted":
            row = (table[i] + table[j]) / 2
        else:
            square = (si + size) * table[i] ** 2 + (sj + size) * table[j] ** 2 - size * height**2
            row = np.sqrt(np.maximum(square, 0.0) / (si + sj + size))
        live[j], left = False, left - 1
        row[~live] = np.inf
        row[i] = np.inf
        table[i], table[:, i] = row, row
        size[i] = si + sj
        yield int(place[i]), int(place[j]), height, int(si + sj)
        row = steady(row)
        stale |= live & ((nearest == i) | (nearest == j))
        # Of equal linkages the first counts.
        nearest[live & ~stale & (row == low) & (i < nearest)] = i
        closer = live & (row < low)
        nearest[closer], low[closer], stale[closer] = i, row[closer], False
        low[j] = np.inf
        nearest[i] = row.argmin()
        low[i], stale[i] = row[nearest[i]], False


def grown_tree(ids: np.ndarray, metric):
    """Minimum spanning tree under ``metric(i, rest)``, distances from row i to rows."""
    rest = np.arange(len(ids))
    weight, parent = np.full(len(ids), np.inf), np.full(len(ids), NO_PARENT)
    at, edges = 0, []
    while True:
        rest = rest[rest != at]
        if not rest.size:
            break
        found = metric(at, rest)
        mine = np.full(rest.size, ids[at])
        better = (found < weight[rest]) | (
            (found == weight[rest]) & before(mine, ids[rest], parent[rest], ids[rest])
        )
        weight[rest[better]], parent[rest[better]] = found[better], ids[at]
        low, high = np.minimum(ids[rest], parent[rest]), np.maximum(ids[rest], parent[rest])
        k = np.lexsort((high, low, weight[rest]))[0]
        at = rest[k]
        edges.append((low[k], high[k], weight[at]))
    found = np.array(edges, dtype=[("l", "i8"), ("r", "i8"), ("w", "f8")])
    return found["l"], found["r"], found["w"]


def gap_to_box(coords: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distance of every point to the box around the points of ``other``."""
    low, high = other.min(axis=0), other.max(axis=0)
    gap = np.maximum(0.0, np.maximum(low - coords, coords - high))
    return np.sqrt((gap * gap).sum(axis=1))


def close_pairs(left, right, radius: float, slack: float):
    """Parts of two blocks between which every edge up to ``radius`` can be found.

    Each is ``(ids, coords)`` twice. Points farther than the radius from the other block
    are left out. So are, where ``component`` is known, the edges within the most common
    component: they close cycles of shorter edges.
    """
    parts = []
    for side, other in ((left, right), (right, left)):
        near = gap_to_box(side.coords, other.coords) * slack <= radius
        component = side.extra["component"][near] if "component" in side.extra else None
        parts.append((side.ids[near], side.coords[near], component))
    (ids_a, a, of_a), (ids_b, b, of_b) = parts
    if of_a is None or not len(ids_a) or not len(ids_b):
        return [((ids_a, a), (ids_b, b))]
    names, counts = np.unique(np.concatenate([of_a, of_b]), return_counts=True)
    common = names[counts.argmax()]
    out_a, out_b = of_a != common, of_b != common
    return [
        ((ids_a[out_a], a[out_a]), (ids_b, b)),
        ((ids_a[~out_a], a[~out_a]), (ids_b[out_b], b[out_b])),
    ]
