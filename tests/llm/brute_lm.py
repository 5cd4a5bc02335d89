"""A plain modified Kneser-Ney bigram model, for comparison."""

import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
END, BEGIN = object(), object()


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


def _discounts(counts):
    n = Counter(counts)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
    out = [0]
    for k in (1, 2, 3):
        out.append(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) if n[k] else out[-1])
    return out


def scores(rows, folds=10):
    """doc_id -> (n_tokens, n_known, train_tokens, base, score)."""
    train = [tokens(t) for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % folds]
    c, pair = Counter(), Counter()
    for ts in train:
        c.update(ts)
        pair.update(zip([BEGIN, *ts[:-1]], ts, strict=True))
    total, vocabulary = sum(c.values()), len(c)
    types, uses, by_count = Counter(), Counter(), defaultdict(Counter)
    for (v, w), n in pair.items():
        types[w] += 1
        uses[v] += n
        by_count[v][min(n, 3)] += 1
    d, e = _discounts(types.values()), _discounts(pair.values())
    t = Counter(min(n, 3) for n in types.values())
    spare = sum(d[k] * t[k] for k in (1, 2, 3)) / (vocabulary + 1)
    all_types = sum(types.values())

    def single(w):
        n = types[w]
        return (max(n - d[min(n, 3)], 0) + spare) / all_types if all_types else 1 / (vocabulary + 1)

    def probability(v, w):
        if not uses[v]:
            return single(w)
        n = pair[v, w]
        mass = sum(e[k] * by_count[v][k] for k in (1, 2, 3))
        return (max(n - e[min(n, 3)], 0) + mass * single(w)) / uses[v]

    out = {}
    for i, text in rows:
        ts = tokens(text)
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in ts)
        full = sum(math.log10(probability(v, w)) for v, w in zip([BEGIN, *ts[:-1]], ts, strict=True))
        out[i] = (len(ts), sum(c[w] > 0 for w in ts), total, base, full)
    return out
