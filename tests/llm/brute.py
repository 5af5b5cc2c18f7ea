"""Plain one-machine versions of the operators' contracts, for tests on small tables."""

import hashlib
import re
import zlib
from collections import Counter

_UPPER = {c: c + 32 for c in range(65, 91)}


def fold(text):
    return (text or "").translate(_UPPER)


def tokens(rows, path, end=0):
    """op6: rows of (doc_id, start, n_tokens, crc)."""
    import numpy as np
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def contamination(rows, items, size=10):
    """op7: {doc_id: (n_words, n_hit, n_items, sha256, contaminated)}."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    where = {}
    for item_id, text in items:
        w = word.findall(fold(text))
        for k in range(max(0, len(w) - size) + 1 if w else 0):
            where.setdefault(tuple(w[k : k + size]), set()).add(item_id)
    sizes = {len(x) for x in where}
    out = {}
    for doc_id, text in rows:
        w = word.findall(fold(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in where:
                    hit.update(range(k, k + n))
                    found |= where[x]
        ids = sorted(str(x) for x in found if x is not None)
        out[doc_id] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def shingles(text, n=4):
    w = re.findall("[^\x20\x09-\x0d]+", fold(text))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def components(rows, n=4, percent=85):
    """op8: {doc_id: (n_shingles, component_id)} by an inverted index over all shingles."""
    sets = [(d, shingles(t, n)) for d, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    lists = {}
    for k, (_, s) in enumerate(sets):
        common = Counter(j for x in s for j in lists.get(x, ()))
        for j, i in common.items():
            if 100 * i >= percent * (len(s) + len(sets[j][1]) - i):
                up[root(j)] = root(k)
        for x in s:
            lists.setdefault(x, []).append(k)
    least = {}
    for k, (d, _) in enumerate(sets):
        least[root(k)] = min(d, least.get(root(k), d))
    return {d: (len(s), least[root(k)]) for k, (d, s) in enumerate(sets)}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text):
    """op9: base spans in digest order."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "") if ok(m.group())]
