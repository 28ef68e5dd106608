"""Guide trees: Newick text, and the tree algebra that plans an alignment.

Trees are metadata (one node for each sequence), so they live on the driver;
`to_rows` gives the parent-pointer table that the DataFrame operators take.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field


@dataclass(eq=False)
class Node:
    name: str
    length: float = 1.0
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None
    is_leaf: bool = False
    group: int = -1

    def add(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def walk(self) -> Iterator[Node]:
        """Post-order, without recursion."""
        stack = [(self, False)]
        while stack:
            node, done = stack.pop()
            if done or not node.children:
                yield node
            else:
                stack.append((node, True))
                stack.extend((c, False) for c in reversed(node.children))

    def leaves(self) -> list[Node]:
        return [n for n in self.walk() if n.is_leaf]


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        c = text[at]
        if c == "'":
            end = at + 1
            name = ""
            while True:
                close = text.index("'", end)
                name += text[end:close]
                if text[close + 1 : close + 2] != "'":
                    break
                name, end = name + "'", close + 2
            yield "name", name
            at = close + 1
        elif c in "(),:;":
            yield c, c
            at += 1
        elif c.isspace():
            at += 1
        else:
            end = at
            while end < len(text) and text[end] not in "(),:;'":
                end += 1
            yield "name", text[at:end].strip()
            at = end


def parse(text: str) -> Node:
    """A rooted tree from the first line of Newick text.

    Inner labels are ignored and inner nodes numbered in pre-order; repeated leaf
    names get a suffix. Lengths are repaired: all 1 if none is positive, else
    zeros become the smallest positive one; the root has 0.
    """
    line = next((x for x in text.splitlines() if x.strip()), "")
    seen: dict[str, int] = {}
    count = 0

    def inner() -> Node:
        nonlocal count
        count += 1
        return Node(f"node_{count}", 0.0)

    root, node, label_ok, after = None, None, True, ""
    here: Node | None = None
    for kind, value in _tokens(line):
        if kind == "(":
            new = inner()
            if here is None:
                if root is not None:
                    raise ValueError("unbalanced parentheses in the tree")
                root = new
            else:
                here.add(new)
            here, node, label_ok = new, None, True
        elif kind == "name":
            if after == ":":
                node.length = float(value)
            elif label_ok:
                k = seen.get(value, 0)
                seen[value] = k + 1
                node = Node(f"{value}_dup_{k}" if k else value, 0.0, is_leaf=True)
                if here is None:
                    root = node
                else:
                    here.add(node)
                label_ok = False
        elif kind in ",)":
            if here is None:
                raise ValueError("unbalanced parentheses in the tree")
            label_ok = kind == ","
            if kind == ")":
                node, here = here, here.parent
                label_ok = False
        after = kind
    if root is None or here is not None:
        raise ValueError("unbalanced parentheses in the tree")
    repair_lengths(root)
    return root


def repair_lengths(root: Node) -> None:
    rest = [n for n in root.walk() if n is not root]
    least = min((n.length for n in rest if n.length > 0), default=None)
    for n in rest:
        if n.length <= 0:
            n.length = 1.0 if least is None else least
    root.length = 0.0


def write(root: Node) -> str:
    """Newick text with six decimals, no inner labels, and quotes where a name needs them."""

    def name(text: str) -> str:
        return "'" + text.replace("'", "''") + "'" if any(c in text for c in "(),:;' ") else text

    made: dict[int, str] = {}
    for n in root.walk():
        text = name(n.name) if not n.children else "(" + ",".join(made.pop(id(c)) for c in n.children) + ")"
        made[id(n)] = text if n is root else f"{text}:{n.length:.6f}"
    return made[id(root)] + ";"


def to_rows(root: Node) -> list[tuple]:
    """(node_id, parent_id, child_ord, branch_length, level, group_id, num_leaves, weight, is_leaf) of each node."""
    leaves, raw, level = {}, {}, {id(root): 1}
    for n in root.walk():
        leaves[id(n)] = 1 if n.is_leaf else sum(leaves[id(c)] for c in n.children)
    order = [root]
    for n in order:
        raw[id(n)] = raw.get(id(n.parent), 0.0) + n.length / max(1, leaves[id(n)])
        for c in n.children:
            level[id(c)] = level[id(n)] + 1
            order.append(c)
    most = max((raw[id(n)] for n in order if n.is_leaf), default=0.0)
    place = {id(c): k for n in order for k, c in enumerate(n.children)}
    return [
        (n.name, n.parent.name if n.parent else None, place.get(id(n), 0), n.length, level[id(n)], n.group, leaves[id(n)], (raw[id(n)] / most if most else 1.0) if n.is_leaf else None, n.is_leaf)
        for n in order
    ]


def star(names: Iterable[str]) -> Node:
    root = Node("node_1", 0.0)
    for name in names:
        root.add(Node(name, 1.0, is_leaf=True))
    return root


def copy(root: Node, keep=lambda node: True) -> Node:
    """A copy of the nodes below root that keep() holds, each below its nearest kept ancestor."""
    new = {id(root): Node(root.name, root.length, is_leaf=root.is_leaf, group=root.group)}
    order = [root]
    for n in order:
        for c in n.children:
            if keep(c):
                new[id(c)] = Node(c.name, c.length, is_leaf=c.is_leaf, group=c.group)
                new[id(n)].add(new[id(c)])
                order.append(c)
    return new[id(root)]


def prune(root: Node, names: set[str]) -> Node:
    """Only leaves of the names; unary chains collapse and their lengths add up; the root stays."""
    kept = set()
    for n in root.walk():
        if (n.is_leaf and n.name in names) or any(id(c) in kept for c in n.children):
            kept.add(id(n))
    if id(root) not in kept:
        raise ValueError("no leaf of the tree is left")
    new = copy(root, lambda n: id(n) in kept)
    for n in [x for x in new.walk() if x is not new and len(x.children) == 1]:
        child = n.children[0]
        child.length += n.length
        child.parent = n.parent
        n.parent.children[n.parent.children.index(n)] = child
    return new


def binarize(root: Node) -> Node:
    """Each polytomy becomes rounds of neighbouring pairs below new nodes of length 0; inner unary nodes are spliced out."""
    new = copy(root)
    count = sum(1 for _ in new.walk())
    for n in list(new.walk()):
        children = list(n.children)
        while len(children) > 2:
            paired = []
            for k in range(0, len(children) - 1, 2):
                count += 1
                node = Node(f"node_b{count}", 0.0, group=n.group)
                node.add(children[k])
                node.add(children[k + 1])
                paired.append(node)
            children = paired + (children[-1:] if len(children) % 2 else [])
        n.children = []
        for c in children:
            n.add(c)
        if len(children) == 1 and n.parent is not None:
            children[0].length += n.length
            children[0].parent = n.parent
            n.parent.children[n.parent.children.index(n)] = children[0]
    return new


def reroot(root: Node) -> Node:
    """Binarized and hung from the middle of its longest path, counted in edges; names break ties."""
    tree = binarize(root)
    near: dict[int, list[tuple[Node, float]]] = {id(n): [] for n in tree.walk()}
    for n in tree.walk():
        for c in n.children:
            near[id(n)].append((c, c.length))
            near[id(c)].append((n, c.length))

    def far(start: Node) -> list[Node]:
        before: dict[int, Node | None] = {id(start): None}
        layer, last = [start], start
        while layer:
            last = min(layer, key=lambda n: n.name)
            following = []
            for n in sorted(layer, key=lambda n: n.name):
                for other, _ in near[id(n)]:
                    if id(other) not in before:
                        before[id(other)] = n
                        following.append(other)
            layer = following
        path = [last]
        while before[id(path[-1])] is not None:
            path.append(before[id(path[-1])])
        return path

    leaves = tree.leaves()
    if len(leaves) < 3:
        return tree
    path = far(far(min(leaves, key=lambda n: n.name))[0])
    top = path[len(path) // 2]
    if top is tree or top.is_leaf:
        return tree
    fresh = Node(top.name, 0.0)
    stack = [(top, None, fresh)]
    while stack:
        old, came, new = stack.pop()
        for other, length in near[id(old)]:
            if other is not came:
                child = Node(other.name, length, is_leaf=other.is_leaf, group=other.group)
                new.add(child)
                stack.append((other, old, child))
    fresh.name, old_root = tree.name, next((n for n in fresh.walk() if n.name == tree.name and n is not fresh), None)
    if old_root is not None:
        old_root.name = top.name
    return binarize(fresh)


def partition(root: Node, most: int) -> dict[int, Node]:
    """Cut at the inner node whose leaf count is nearest half of its part's, until no part has more than `most` leaves.

    Sets each node's group; returns the parts' roots. A part whose best cut is
    its own root stays as it is.
    """
    for n in root.walk():
        n.group = 0
    roots, work = {0: root}, [0]
    while work:
        g = work.pop()
        inside = [n for n in roots[g].walk() if n.group == g]
        count: dict[int, int] = {}
        for n in inside:
            count[id(n)] = 1 if n.is_leaf else sum(count.get(id(c), 0) for c in n.children if c.group == g)
        total = count[id(roots[g])]
        if total <= most:
            continue
        cut = min((n for n in inside if not n.is_leaf and count[id(n)]), key=lambda n: abs(total / 2 - count[id(n)]))
        if cut is roots[g]:
            continue
        new = max(roots) + 1
        for n in cut.walk():
            if n.group == g:
                n.group = new
        roots[new] = cut
        work += [new, g]
    return roots


def contract(root: Node, roots: dict[int, Node]) -> Node:
    """The tree of the parts: each part's root below the part that it was cut from."""
    nodes = {g: Node(n.name, n.length, group=g) for g, n in roots.items()}
    for g, n in roots.items():
        if n.parent is not None:
            nodes[n.parent.group].add(nodes[g])
    return nodes[root.group]


def schedule(root: Node) -> list[tuple[int, int, str, str]]:
    """(level, order in the level, reference, query) of each pair: children (0, 1), (2, 3), ... until one is left, who stands for the node."""
    ready: dict[int, tuple[str, int]] = {}
    pairs: dict[int, list[tuple[str, str]]] = {}
    for n in root.walk():
        if n.is_leaf:
            ready[id(n)] = (n.name, -1)
            continue
        line = [ready[id(c)] for c in n.children if id(c) in ready]
        while len(line) > 1:
            paired = []
            for k in range(0, len(line) - 1, 2):
                (a, x), (b, y) = line[k], line[k + 1]
                level = max(x, y) + 1
                pairs.setdefault(level, []).append((a, b))
                paired.append((a, level))
            line = paired + (line[-1:] if len(line) % 2 else [])
        if line:
            ready[id(n)] = line[0]
    return [(level, k, a, b) for level in sorted(pairs) for k, (a, b) in enumerate(pairs[level])]


def part_schedule(tree: Node) -> list[list[tuple[int, int]]]:
    """Levels of (group, group it takes in) over a tree of parts: children into their parent, one at a time, as early as both are ready."""
    ready: dict[int, int] = {}
    levels: list[list[tuple[int, int]]] = []
    for n in tree.walk():
        at = 0
        for c in sorted(n.children, key=lambda c: (ready[id(c)], c.group)):
            at = max(at, ready[id(c)])
            while len(levels) <= at:
                levels.append([])
            levels[at].append((n.group, c.group))
            at += 1
        ready[id(n)] = at
    return levels


def upgma(names: list[str], distance) -> Node:
    """A rooted tree of average linkage from a square matrix of distances; the first pair of equals joins first."""
    import numpy as np

    if not names:
        raise ValueError("no names for a tree")
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    nodes: list[Node | None] = [Node(n, 0.0, is_leaf=True) for n in names]
    size, height = np.ones(len(names)), np.zeros(len(names))
    for k in range(1, len(names)):
        i, j = divmod(int(d.argmin()), len(names))
        i, j = min(i, j), max(i, j)
        at = d[i, j] / 2
        joined = Node(f"node_u{k}", 0.0)
        for x in (i, j):
            nodes[x].length = max(at - height[x], 0.0)
            joined.add(nodes[x])
        mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        mean[i] = np.inf
        d[i], d[:, i] = mean, mean
        d[j], d[:, j] = np.inf, np.inf
        nodes[i], nodes[j], size[i], height[i] = joined, None, size[i] + size[j], at
    root = next(n for n in nodes if n is not None)
    repair_lengths(root)
    return root
