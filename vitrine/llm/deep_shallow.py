"""Deep-shallow sorting: order strings that share long beginnings."""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort compares as one letter, and letters it goes down; then tries take over.
LETTER, SHALLOW = 8, 1


def _blind_trie(members: list[int], strings: list[bytes]) -> list[int]:
    """The members in order of their strings, which are all of one length.

    A blind (Patricia) trie holds the offsets at which its strings part, not the strings: a new string
    runs down by the bytes at these offsets only, is compared with the one leaf it meets, and
    branches off where they differ. Equal strings share a leaf.
    """
    size = len(strings[members[0]])
    numbers = {m: int.from_bytes(strings[m], "big") for m in members}
    # a node is (offset, children by byte), a leaf a list of members
    root: tuple | list = [members[0]]
    for new in members[1:]:
        string = strings[new]
        node = root
        while type(node) is tuple:
            offset, kids = node
            node = kids.get(string[offset]) or next(iter(kids.values()))
        differ = numbers[new] ^ numbers[node[0]]
        if not differ:
            node.append(new)
            continue
        parting = size - (differ.bit_length() + 7) // 8
        other = strings[node[0]][parting]
        above, node = None, root
        while type(node) is tuple and node[0] < parting:
            above, node = node, node[1][string[node[0]]]
        if type(node) is tuple and node[0] == parting:
            node[1][string[parting]] = [new]
            continue
        branch = (parting, {other: node, string[parting]: [new]})
        if above is None:
            root = branch
        else:
            above[1][string[above[0]]] = branch
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if type(node) is tuple:
            kids = node[1]
            stack.extend(kids[byte] for byte in sorted(kids, reverse=True))
        else:
            out.extend(node)
    return out


def order(members: list[int], strings: list[bytes], depth: int = 0) -> list[int]:
    """The members sorted by their strings, which are of one length and agree up to `depth`.

    Multikey quicksort splits them in three by the letter at the depth (less, equal, greater);
    groups that are still equal after the shallow depth go to a blind trie.
    """
    limit = depth + LETTER * SHALLOW
    out: list[int] = []
    stack = [(members, depth)]
    while stack:
        group, at = stack.pop()
        if len(group) == 1:
            out.append(group[0])
            continue
        if at >= limit:
            out.extend(_blind_trie(group, strings))
            continue
        upto = at + LETTER
        ends = (strings[group[0]][at:upto], strings[group[len(group) // 2]][at:upto], strings[group[-1]][at:upto])
        pivot = sorted(ends)[1]
        less, equal, greater = [], [], []
        for member in group:
            letter = strings[member][at:upto]
            (equal if letter == pivot else less if letter < pivot else greater).append(member)
        if greater:
            stack.append((greater, at))
        stack.append((equal, upto))
        if less:
            stack.append((less, at))
    return out


def suffix_array(keys: np.ndarray, letters: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted by key and letters, and how many letters each row of that order
    shares with the row before it; -1 where the key changes.

    `letters` has a row of bytes for each string; strings of one key agree up to `depth`.
    """
    by_key = np.argsort(keys, kind="stable")
    changes = np.flatnonzero(np.diff(keys[by_key])) + 1
    starts = np.concatenate([[0], changes])
    ends = np.concatenate([changes, [len(keys)]])
    found = by_key.copy()
    whole, size = letters.tobytes(), letters.shape[1]
    many = ends - starts > 1
    for start, end in zip(starts[many].tolist(), ends[many].tolist()):
        rows = by_key[start:end].tolist()
        strings = [whole[row * size : (row + 1) * size] for row in rows]
        found[start:end] = [rows[i] for i in order(list(range(len(rows))), strings, depth)]
    ordered = letters[found]
    differ = np.ones((len(keys), size + 1), dtype=bool)
    differ[1:, :size] = ordered[1:] != ordered[:-1]
    differ[:1] = False
    differ[:1, 0] = True
    common = differ.argmax(axis=1)
    common[starts] = -1
    return found, common
