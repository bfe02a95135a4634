"""Plain versions that the tests compare with."""

import re

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def jaccard_groups(rows, words, percent):
    """Smallest id that links lead to, of every id."""
    sets = {}
    for i, text in rows:
        run = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        n = min(words, len(run))
        sets[i] = {tuple(run[k : k + n]) for k in range(len(run) - n + 1)} if n else set()
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least
