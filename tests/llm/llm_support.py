"""Plain versions shared by tests."""

import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_shingles(text, n=5):
    w = ALNUM.findall((text or "").translate(LOWER))
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def plain_groups(texts, threshold=0.8):
    """A group number and the number of links for each text."""
    sets = [plain_shingles(t) for t in texts]
    group = list(range(len(texts)))
    links = [0] * len(texts)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    return group, links
