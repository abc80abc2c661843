"""Plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash


def simhash(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    runs = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near(prints, bits):
    prints = sorted(set(prints))
    return [
        (a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= bits
    ]


def classes(rows, bits=3):
    """{(id, text): least id of its class} of rows (id, text)."""
    prints = {row: simhash(row[1]) for row in rows}
    of = components(set(prints.values()), near(prints.values(), bits))
    least = {}
    for row, mark in prints.items():
        if row[0] is not None:
            least[of[mark]] = min(least.get(of[mark], row[0]), row[0])
    return {row: least.get(of[mark]) for row, mark in prints.items()}


def first_fit(sizes, capacity):
    room, where = [], {}
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        for bin_, left in enumerate(room):
            if left >= sizes[item]:
                break
        else:
            bin_ = len(room)
            room.append(capacity)
        where[item] = (bin_, capacity - room[bin_])
        room[bin_] -= sizes[item]
    return where


def fill(sizes, weights, share, epochs):
    """Targets by raising one level in tiny steps would be slow: clamp the worst, again and again."""
    clamped = set()
    while True:
        free = [s for s in sizes if s not in clamped]
        if not free:
            return {s: float(epochs * sizes[s]) for s in sizes}
        rest = share * sum(sizes.values()) - sum(epochs * sizes[s] for s in clamped)
        level = rest / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level > epochs * sizes[s]]
        if not over:
            return {
                s: float(epochs * sizes[s]) if s in clamped else weights[s] * level for s in sizes
            }
        clamped.add(min(over, key=lambda s: epochs * sizes[s] / weights[s]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def license_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def places(found, phrase):
    phrase = phrase.split()
    n = len(phrase)
    return [i for i in range(len(found) - n + 1) if found[i : i + n] == phrase]


def dot_rows(vectors, query):
    return np.asarray(vectors, dtype=float) @ np.asarray(query, dtype=float)


def number(value):
    """A null id is greater than all others."""
    return 2**63 - 1 if value is None else value


def removed_passages(rows, length=50):
    """(id, bytes, removed, spans, digest of what stays) by looking at every string."""
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            first[window] = min(first.get(window, 2**63 - 1), number(doc))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < number(doc):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        left = bytes(x for x, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def merkle(rows, group, leaf, order, fanout=3):
    """{index of a row: (subroot, root, siblings level by level as (before, after))}."""
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def tree(leaves):
        level, under, ways = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
        while len(level) > 1:
            up, up_under = [], []
            for at in range(0, len(level), fanout):
                run = level[at : at + fanout]
                for k in range(len(run)):
                    for i in under[at + k]:
                        ways[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
                up.append(digest("".join(run)))
                up_under.append(sum(under[at : at + fanout], []))
            level, under = up, up_under
        return level[0], ways

    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[group(row)].append(i)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, out = [], {}
    for name in names:
        members = sorted(groups[name], key=lambda i: order(rows[i]))
        subroot, ways = tree([leaf(rows[i]) for i in members])
        subroots.append(subroot)
        out.update({i: (subroot, way) for i, way in zip(members, ways)})
    if not names:
        return {}
    root, above = tree(subroots)
    place = {name: k for k, name in enumerate(names)}
    return {i: (s, root, way + above[place[group(rows[i])]]) for i, (s, way) in out.items()}


def aligned(rows, one, two):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest); `one` and `two` give (ids, bytes)."""
    found, count = [], Counter()
    for doc, text in rows:
        groups, n_a, n_b = [], 0, 0
        if text:
            a, b = one(text), two(text)
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                n_a, n_b = len(a), len(b)
                ends = []
                for side in (a, b):
                    at, here = 0, []
                    for _, piece in side:
                        at += len(piece)
                        here.append(at)
                    ends.append(here)
                shared = set(ends[0]) & set(ends[1])
                cut = []
                for side, at in zip((a, b), ends):
                    runs = [[]]
                    for (i, _), end in zip(side, at):
                        runs[-1].append(i)
                        if end in shared:
                            runs.append([])
                    cut.append(runs[:-1])
                groups = [list(pair) for pair in zip(*cut)]
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        count.update(links.keys())
        found.append((doc, n_a, n_b, groups, links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc, n_a, n_b, groups, links in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        out.append(
            (
                doc,
                n_a,
                n_b,
                len(groups),
                sum(links.values()),
                sum(n for pair, n in links.items() if count[pair] == best[pair[0]]),
                sum(n * count[pair] for pair, n in links.items()),
                hashlib.sha256(text.encode()).hexdigest() if n_a else "",
            )
        )
    return out
