"""Front-coded sorted runs and their merge by an LCP-aware loser tree."""

from __future__ import annotations

import pickle

import zstandard


def lcp(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the longest common prefix, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    while True:
        to = min(at + 64, n)
        x, y = a[at:to], b[at:to]
        if x != y:
            return to - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7 >> 3)
        at = to


def front_code(ordered: list[bytes]) -> tuple[list[int], list[int], bytes]:
    """For sorted strings: what each shares with the one before, its length, and the rests joined."""
    shared, rests, before = [], [], b""
    for s in ordered:
        n = lcp(before, s)
        shared.append(n)
        rests.append(s[n:])
        before = s
    return shared, [len(s) for s in ordered], b"".join(rests)


def front_decode(coded: tuple[list[int], list[int], bytes]) -> tuple[list[bytes], list[int]]:
    shared, lengths, rests = coded
    out, before, at = [], b"", 0
    for n, length in zip(shared, lengths):
        to = at + length - n
        before = before[:n] + rests[at:to]
        out.append(before)
        at = to
    return out, shared


def pack(run, level: int = 1) -> bytes:
    """A run for the exchange."""
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(run, protocol=5))


def unpack(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs, each of strings and of what each shares with the one before.

    Returns (run, position) in order, and what each string shares with the one
    before it in the merged order. Each leaf of the tournament knows how much
    its head shares with the last winner. The head that shares more is the
    smaller one, whatever follows; only where both share the same length are
    bytes compared, from that length on. So no known prefix is compared again.
    """
    k = len(runs)
    if k == 0:
        return [], []
    strings, shares = [r[0] for r in runs], [r[1] for r in runs]
    sizes = [len(s) for s in strings]
    place = [0] * k
    heads = [s[0] if s else b"" for s in strings]
    known = [0 if n else -1 for n in sizes]  # -1: no head left
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known length becomes what it shares with the winner."""
        la, lb = known[a], known[b]
        if la > lb:
            return a, b
        if lb > la:
            return b, a
        if la < 0:
            return a, b
        x, y = heads[a], heads[b]
        n = lcp(x, y, la)
        if n == len(x):
            first = n < len(y) or a < b
        else:
            first = n < len(y) and x[n] < y[n]
        if first:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winner = -1
    for leaf in range(k):
        at, node = leaf, (k + leaf) >> 1
        while node:
            if tree[node] < 0:
                tree[node] = at
                at = -1
                break
            at, tree[node] = play(at, tree[node])
            node >>= 1
        if at >= 0:
            winner = at
    order, shared = [], []
    while known[winner] >= 0:
        p = place[winner]
        order.append((winner, p))
        shared.append(known[winner])
        place[winner] = p = p + 1
        if p < sizes[winner]:
            heads[winner], known[winner] = strings[winner][p], shares[winner][p]
        else:
            known[winner] = -1
        node = (k + winner) >> 1
        while node:
            other = tree[node]
            la, lb = known[winner], known[other]
            if lb > la:
                tree[node], winner = winner, other
            elif la == lb and la >= 0:
                winner, tree[node] = play(winner, other)
            node >>= 1
    return order, shared
