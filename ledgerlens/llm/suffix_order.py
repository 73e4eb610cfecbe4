"""Suffix arrays by linear grouping.

Suffixes are grouped by their Lyndon prefix.  Groups are taken in descending order; each suffix of a
group finds the nearest suffix before it in a smaller group (its previous-smaller pointer), and the
suffixes pointed at are split off their groups, those with more pointers further up.  When all groups
are done, one pass over the order emits each suffix at the front of its group, following the
pointers.  There is no recursion and no renaming of the text.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Order of the suffixes of ``text``, a sequence of whole numbers; empty for an empty text."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # A virtual end that is smaller than every symbol takes place n.
    size = n + 1
    order = sorted(range(n), key=text.__getitem__)
    order.insert(0, n)
    place = [0] * size
    group = [0] * size  # the first place of a suffix's group
    length = [0] * size  # by first place
    start, last = 0, -1
    for at, s in enumerate(order):
        symbol = text[s] if s < n else -1
        if at and symbol != last:
            start = at
        last = symbol
        place[s] = at
        group[s] = start
        length[start] += 1
    before = [-1] * size
    end = size - 1
    while end > 0:
        first = group[order[end]]
        counts: dict[int, int] = {}
        for s in sorted(order[first : end + 1]):
            p = s - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if counts:
            by_count: dict[int, list[int]] = {}
            for p, c in counts.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                touched = set()
                for p in by_count[c]:
                    g = group[p]
                    length[g] -= 1
                    to = g + length[g]
                    other, at = order[to], place[p]
                    order[at], order[to] = other, p
                    place[other], place[p] = at, to
                    touched.add(g)
                moved: dict[int, int] = {}
                for p in by_count[c]:
                    moved[group[p]] = moved.get(group[p], 0) + 1
                for p in by_count[c]:
                    g = group[p]
                    # The part split off begins where the rest of its group ends.
                    group[p] = g + length[g]
                for g, m in moved.items():
                    if length[g]:
                        length[g + length[g]] = m
                    else:
                        length[g] = m
        end = first - 1
    front = list(range(size))
    emitted = [False] * size
    out = [-1] * size
    out[0] = n
    emitted[n] = True
    for at in range(size):
        s = out[at] - 1
        while s >= 0 and not emitted[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            emitted[s] = True
            s = before[s]
    return out[1:]
