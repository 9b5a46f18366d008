"""A prefix tree of globally ordered sets, searched for sets of high Jaccard similarity."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np


class _Node:
    __slots__ = ("part", "kids", "ends", "deepest", "small", "large", "group")

    def __init__(self, part: np.ndarray):
        self.part = part  # tokens on the way from the parent
        self.kids: dict[int, _Node] = {}
        self.ends: list[tuple[int, int, int]] = []  # (name, full size, group) of the sets that end here
        self.deepest = 0  # most tokens below, part included
        self.small, self.large = 1 << 60, 0  # sizes of the sets below
        self.group: int | None = None  # that of all sets below, if they are known to have one


class Trie:
    """Sets are ascending arrays of tokens. A set's size may count more tokens than its array has: those are in no other set.

    Sets may have groups, which a caller merges: group_of(g) is what g has become. A search that has a group of its own then leaves
    subtrees whose sets are all in it."""

    def __init__(self, share: int = 80, group_of: Callable[[int], int] | None = None):
        self.root, self.share, self.group_of = _Node(np.zeros(0, np.uint64)), share, group_of or (lambda g: g)

    def add(self, name: int, tokens: np.ndarray, size: int, group: int = 0) -> None:
        node, at, first = self.root, 0, not self.root.kids and not self.root.ends
        while True:
            if first:
                node.group = group
            elif node.group is not None and self.group_of(node.group) != self.group_of(group):
                node.group = None
            node.deepest = max(node.deepest, len(tokens) - at + len(node.part))
            node.small, node.large = min(node.small, size), max(node.large, size)
            if at == len(tokens):
                node.ends.append((name, size, group))
                return
            kid = node.kids.get(int(tokens[at]))
            if kid is None:
                kid = node.kids[int(tokens[at])] = _Node(tokens[at:])
                first = True
            else:
                m = min(len(kid.part), len(tokens) - at)
                differ = np.flatnonzero(kid.part[:m] != tokens[at : at + m])
                m = int(differ[0]) if len(differ) else m
                if m < len(kid.part):  # split
                    top = _Node(kid.part[:m])
                    top.deepest, top.small, top.large, top.group = kid.deepest, kid.small, kid.large, kid.group
                    kid.deepest -= m
                    kid.part = kid.part[m:]
                    top.kids[int(kid.part[0])] = kid
                    node.kids[int(tokens[at])] = kid = top
            at += len(kid.part)
            node = kid

    def _refresh(self, node: _Node) -> None:
        """Merged groups below a node may have become one."""
        found = None
        for g in (*(k.group for k in node.kids.values()), *(e[2] for e in node.ends)):
            if g is None or (found is not None and self.group_of(g) != found):
                return
            found = self.group_of(g)
        node.group = found

    def similar(self, tokens: np.ndarray, size: int, own: int | None = None) -> Iterator[tuple[int, int]]:
        """(name, overlap) of the sets with share * |union| <= 100 * |intersection|; with own (a group), of sets of other groups. The
        overlap of a path counts for all sets below it; a subtree is left when the tokens that remain on both sides can't make up
        what its smallest set needs, or when its sets are all in own."""
        ordered = tokens.tolist()
        mine, least, most = set(ordered), -(-self.share * size // 100), size * 100 // self.share
        need = lambda other: -(-self.share * (size + other) // (100 + self.share))
        mixed: list[_Node] = []
        todo = [(self.root, 0)]
        while todo:
            node, overlap = todo.pop()
            if node.large < least or node.small > most:
                continue
            if own is not None:
                if node.group is None:
                    mixed.append(node)
                elif self.group_of(node.group) == self.group_of(own):
                    continue
            if len(node.part):
                bound = min(len(ordered) - bisect_right(ordered, int(node.part[0]) - 1), node.deepest)
                if overlap + bound < need(max(node.small, least)):
                    continue
                overlap += sum(map(mine.__contains__, node.part.tolist()))
            for name, other, group in node.ends:
                if overlap >= need(other) and (own is None or self.group_of(group) != self.group_of(own)):
                    yield name, overlap
            todo += [(k, overlap) for k in node.kids.values()]
        for node in reversed(mixed):
            self._refresh(node)
