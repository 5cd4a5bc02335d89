"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
KINDS = ("assign", "access", "hex")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def components(rows, k=5, percent=80):
    """doc_id -> (n_shingles, component_id); one text per doc_id."""
    sets, parent = {}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = defaultdict(list)
    for i, text in rows:
        ws = spaced(text)
        sets[i] = {tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))} if ws else set()
        common = Counter(j for s in sets[i] for j in places[s])
        for s in sets[i]:
            places[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    spelled = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
    return [sum(k == j for _, k, _ in found) for j in range(3)], hashlib.sha256(spelled.encode()).hexdigest(), spelled
