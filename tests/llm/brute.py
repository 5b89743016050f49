"""Plain versions of the operators, for a few hundred rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5):
    own = words((text or "").lower())
    if not own:
        return Counter()
    return Counter(tuple(own[k : k + width]) for k in range(max(1, len(own) - width + 1)))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _sharing(bags):
    """Pairs of keys that share an element."""
    having = defaultdict(list)
    for key, bag in bags.items():
        for element in bag:
            having[element].append(key)
    pairs = set()
    for keys in having.values():
        keys = sorted(keys)
        pairs.update((a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
    return pairs


def near_components(texts, threshold=0.8):
    """Smallest id of the near-duplicate class of each id."""
    bags = {i: shingles(t) for i, t in texts.items()}
    links = []
    for a, b in _sharing(bags):
        common = sum((bags[a] & bags[b]).values())
        union = sum(bags[a].values()) + sum(bags[b].values()) - common
        if common >= threshold * union:
            links.append((a, b))
    return components(bags, links)


def dedup_lines(texts, threshold=0.8):
    """(text without later lines, removed lines, links of all lines) of each id, in order of ids."""
    first, sets = {}, {}
    for i in sorted(texts):
        for k, line in enumerate((texts[i] or "").split("\n")):
            key = tuple(words(line.lower()))
            if key and key not in first:
                first[key] = (i, k)
                sets[key] = set(shingles(line))
    links, later = Counter(), set()
    order = {key: n for n, key in enumerate(first)}
    for a, b in _sharing({order[key]: own for key, own in sets.items()}):
        x, y = list(first)[a], list(first)[b]
        common = len(sets[x] & sets[y])
        if common >= threshold * (len(sets[x]) + len(sets[y]) - common) - 1e-12:
            links[x] += 1
            links[y] += 1
            later.add(y)
    out = {}
    for i, text in texts.items():
        stay, gone, linked = [], 0, 0
        for k, line in enumerate((text or "").split("\n")):
            key = tuple(words(line.lower()))
            linked += links[key]
            if not key or (first[key] == (i, k) and key not in later):
                stay.append(line)
            else:
                gone += 1
        out[i] = ("\n".join(stay), gone, linked)
    return out


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    own = words(text)
    windows = [tuple(own[k : k + 3]) for k in range(len(own) - 2)]
    met = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if met[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n, repeated = len(own), len(covered)
    return (
        n, sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n,
    )
