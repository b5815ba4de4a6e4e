"""Plain-Python models that the operators of the subpackage are compared with."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")


def components(nodes, links):
    above = {n: n for n in nodes}

    def root(n):
        while above[n] != n:
            above[n] = above[above[n]]
            n = above[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        above[b] = a
    return {n: root(n) for n in nodes}


def shingles(text):
    words = WORD.findall(lowered(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def jaccard(rows):
    """{doc_id: (n_shingles, component_id)} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    links = []
    for a, s in sets.items():
        met = {}
        for x in s:
            for b in where[x]:
                if b > a:
                    met[b] = met.get(b, 0) + 1
        links += [(a, b) for b, n in met.items() if 100 * n >= 75 * (len(s) + len(sets[b]) - n)]
    found = components(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def secret_spans(text):
    """Strong spans as kind:start:end, by start and kind."""
    text = text or ""
    word = "|".join(re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    found = []
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, (name, pattern, least) in enumerate([("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)], 1):
        found += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [s for _, _, s in sorted(found)]


def mix(rows):
    """Ids as often as the mix takes them, by reshare rounds and a sort by hash."""
    import hashlib

    sized = [(i, len(WORD.findall(t or "")), s) for i, t, s in rows]
    names = sorted({s for _, _, s in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, x in sized if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(size.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * size[s]}
        for s in over or free:
            target[s] = 2.0 * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = []
    for s in names:
        own = sorted((hashlib.md5(str("" if i is None else i).encode()).hexdigest(), n, i) for i, n, x in sized if x == s)
        whole = int(target[s] // size[s]) if size[s] else 0
        wanted, upto = target[s] - whole * size[s], 0
        for _, n, i in own:
            extra = wanted > 0 and (upto + n < wanted or (upto < wanted and upto + n - wanted <= wanted - upto))
            upto += n
            taken += [i] * (whole + extra)
    return taken
