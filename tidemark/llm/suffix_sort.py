"""Deep-shallow sorting of suffixes: multikey quicksort first, then blind tries."""

from __future__ import annotations

import numpy as np

#: Bytes that the first phase sorts by, a multiple of 8.
SHALLOW = 24


class BlindTrie:
    """Strings of one length in order, by the bytes at which they part.

    An inner node holds a place and a child for each byte there; what lies
    between places is not stored. A string goes down by those bytes alone, is
    compared once with the leaf it meets, and is put in where the two differ.
    """

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, key: bytes, item: int) -> None:
        if self.root is None:
            self.root = [key, [item]]
            return
        node = self.root
        while type(node[0]) is int:
            node = node[1].get(key[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == key:
            node[1].append(item)
            return
        differ = int.from_bytes(other, "big") ^ int.from_bytes(key, "big")
        place = len(key) - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while type(node[0]) is int and node[0] < place:
            above, node = node, node[1][key[node[0]]]
        leaf = [key, [item]]
        if type(node[0]) is int and node[0] == place:
            node[1][key[place]] = leaf
            return
        branch = [place, {other[place]: node, key[place]: leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][key[above[0]]] = branch

    def groups(self) -> list[list[int]]:
        """The items in order, equal strings together."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if type(node[0]) is int:
                todo += [node[1][x] for x in sorted(node[1], reverse=True)]
            else:
                out.append(node[1])
        return out


def deep_shallow_order(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the ``length``-byte strings at ``starts``, and where each differs from the one before it.

    The first phase takes eight bytes as a key: groups equal so far are
    partitioned by the next key, and members that stand alone are done. At
    SHALLOW bytes each group left, whose strings have a long common prefix, is
    ordered by a blind trie over the rest.
    """
    n = len(starts)
    order = np.arange(n)
    new = np.zeros(n, bool)
    new[:1] = True
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    keys = np.ndarray((len(text) + 1,), ">u8", padded, 0, (1,))
    left = np.arange(n)
    group = np.zeros(n, np.int64)
    depth = 0
    while len(left) and depth < min(SHALLOW, length):
        key = keys[starts[order[left]] + depth].astype(np.uint64)
        if length - depth < 8:
            key >>= np.uint64(8 * (8 - length + depth))
        by = np.lexsort((key, group)) if depth else np.argsort(key, kind="quicksort")
        order[left] = order[left][by]
        key, group = key[by], group[by]
        parted = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        new[left[parted]] = True
        alone = parted & np.concatenate([parted[1:], [True]])
        group = np.cumsum(parted)[~alone]
        left = left[~alone]
        depth += 8
    if len(left) and depth < length:
        raw = text.tobytes()
        bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        at = starts[order[left]].tolist()
        items = order[left].tolist()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            trie = BlindTrie()
            for k in range(a, b):
                trie.insert(raw[at[k] + depth : at[k] + length], items[k])
            place = left[a]
            for equal in trie.groups():
                order[place : place + len(equal)] = equal
                new[place] = True
                place += len(equal)
    return order, new
