"""Linear suffix sorting by Lyndon grouping.

Suffixes are put in groups by their Lyndon prefix, the longest Lyndon word that they begin with. Groups are processed from
the highest to the lowest. The previous smaller pointer of a member leads to the nearest suffix before it whose group is
lower; that parent's word goes on with the member's word, so parents move to a group just above the one they are in, and the
higher the more members in a row they have. When all groups are processed, they are in order, and one pass over the result
from its start places the suffixes of each group: behind every suffix that is known, the suffix before it and its chain of
previous smaller suffixes take the next places of their groups. No suffixes are renamed and nothing recurs.
"""

from __future__ import annotations


def _ranked(text: list[int]) -> tuple[list[int], int]:
    """The place of each symbol in the alphabet, and its size; a table of marks where the symbols are dense, else a sort of the alphabet."""
    low, high = min(text), max(text)
    if high - low <= 4 * len(text) + 512:
        used = bytearray(high - low + 1)
        for s in text:
            used[s - low] = 1
        place, size = [0] * len(used), 0
        for at, mark in enumerate(used):
            place[at] = size
            size += mark
        return [place[s - low] for s in text], size
    ids = {symbol: g for g, symbol in enumerate(sorted(set(text)))}
    return [ids[s] for s in text], len(ids)


def _groups(text: list[int]) -> tuple[list[int], list[int]]:
    """(group rank of each suffix, previous smaller suffix); text ends with its unique smallest symbol.

    Members of a group are in ascending order from the start: the previous smaller suffixes of a group's members never go
    back, so parents are met, and appended to their new group, in ascending order.
    """
    n = len(text)
    group_of, size = _ranked(text)
    members: list[list[int]] = [[] for _ in range(size)]
    for i, g in enumerate(group_of):
        members[g].append(i)
    below: list[int] = list(range(-1, size - 1))
    above: list[int] = [*range(1, size), -1]
    prev = [-1] * n
    done = bytearray(n)
    live = [len(m) for m in members]
    order: list[int] = []

    def raised(old: int) -> int:
        """A new group just above an old one."""
        new, up = len(members), above[old]
        members.append([])
        live.append(0)
        above.append(up)
        below.append(old)
        above[old] = new
        if up >= 0:
            below[up] = new
        return new

    current = size - 1
    while current >= 0:
        own = members[current] = [i for i in members[current] if group_of[i] == current]
        order.append(current)
        if len(own) == 1:
            i = own[0]
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            done[i] = 1
            if j >= 0 and live[old := group_of[j]] > 1:
                live[old] -= 1
                group_of[j] = new = raised(old)
                members[new].append(j)
                live[new] = 1
            current = below[current]
            continue
        runs: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            if j >= 0 and group_of[j] == current:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                runs[j] = runs.get(j, 0) + 1
        for i in own:
            done[i] = 1
        # parents by how many members they have in a row; the lowest count is dealt last and lands directly above its old group
        most = max(runs.values(), default=0)
        ranks: list[list[int]] = [[] for _ in range(most)]
        for parent, count in runs.items():
            ranks[most - count].append(parent)
        for parents in ranks:
            moved: dict[int, int] = {}
            for parent in parents:
                old = group_of[parent]
                new = moved.get(old, -1)
                if new < 0:
                    if live[old] == 1:  # alone in its group, it is above what it has left behind there
                        continue
                    new = moved[old] = raised(old)
                members[new].append(parent)
                live[old] -= 1
                live[new] += 1
                group_of[parent] = new
        current = below[current]
    rank = [0] * len(members)
    for k, g in enumerate(reversed(order)):
        rank[g] = k
    return [rank[g] for g in group_of], prev


def suffix_array(symbols: list[int]) -> list[int]:
    """The starts of all suffixes of a list of integers in lexicographic order."""
    if not symbols:
        return []
    text = [*symbols, min(symbols) - 1]
    group, prev = _groups(text)
    n = len(text)
    start = [0] * (max(group) + 2)
    for g in group:
        start[g + 1] += 1
    for g in range(len(start) - 1):
        start[g + 1] += start[g]
    order, placed = [-1] * n, [False] * n
    order[0], placed[n - 1] = n - 1, True
    start[group[n - 1]] += 1
    for k in range(n):
        i = order[k] - 1
        while i >= 0 and not placed[i]:
            order[start[group[i]]] = i
            start[group[i]] += 1
            placed[i] = True
            i = prev[i]
    return order[1:]
