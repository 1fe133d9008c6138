"""Linear-time suffix sorting by Lyndon groups (the two phases of Baier's 2016 construction)."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (integers >= 0) in ascending order; a suffix sorts before its extensions.

    Phase 1 groups suffixes by their longest Lyndon prefix: groups are taken in descending
    order; each member finds the nearest earlier suffix in a lower group, whose own prefix
    thereby grows by the group's, once for each member that found it. Phase 2 emits: a
    suffix takes the next place of its group once the suffix behind its Lyndon prefix has been
    placed, along the same pointers. Nothing is renamed and no subproblem is solved.

    Linear in the text and its largest symbol: the first groups come from counting symbols; a search passes
    only suffixes that no later search meets again, as these jump over them, and stops at a member of its own
    group, whose pointer it shares; counts of finds sum to the group's size, so that sorting the distinct ones is linear, too.
    """
    end = len(text)
    n = end + 1  # the empty suffix is the least one and a group of its own
    first = [0] * (max(text, default=-1) + 2)
    for symbol in text:
        first[symbol + 1] += 1
    first[0] = 1
    for symbol in range(1, len(first)):
        first[symbol] += first[symbol - 1]
    array, start, size, place = [end] * n, [0] * n, [0] * n, [0] * n
    filled = first[:]
    size[0] = 1
    for i, symbol in enumerate(text):
        at, k = first[symbol], filled[symbol]
        filled[symbol] += 1
        array[k], start[i], place[i] = i, at, k
        size[at] += 1

    previous, known = [-1] * n, bytearray(n)
    top = n
    while top > 0:
        low = start[array[top - 1]]
        members = array[low:top]
        for i in members:
            j = i - 1
            while j >= 0 and start[j] > low:
                j = previous[j]
            previous[i] = j  # a member of this very group, for now, or the pointer sought
        found: dict[int, int] = {}
        for i in members:
            chain = []
            j = i
            while j >= 0 and start[j] == low and not known[j]:
                chain.append(j)
                j = previous[j]
            if j >= 0 and start[j] == low:
                j = previous[j]
            for k in chain:
                previous[k] = j
                known[k] = 1
            j = previous[i]
            if j >= 0:
                found[j] = found.get(j, 0) + 1
        top = low
        if not found:
            continue
        if len(found) == 1:
            steps = [list(found)]
        else:
            by_count: dict[int, list[int]] = {}
            for j, c in found.items():
                by_count.setdefault(c, []).append(j)
            steps = [by_count[c] for c in sorted(by_count, reverse=True)]
        for members in steps:  # those that grew most go last in what is left of their group
            for j in members:
                g = start[j]
                size[g] -= 1
                last, here = g + size[g], place[j]
                other = array[last]
                array[last], array[here] = j, other
                place[j], place[other] = last, here
            moved = [(j, start[j] + size[start[j]]) for j in members]
            for j, new in moved:
                start[j] = new
                size[new] += 1

    out, free, placed = [0] * n, start[:], bytearray(n)
    following = list(range(n))
    out[0], placed[end] = end, 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = free[i]
            out[following[g]] = i
            following[g] += 1
            placed[i] = 1
            i = previous[i]
    return out[1:]
