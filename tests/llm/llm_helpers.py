import hashlib
import re
from collections import defaultdict

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text.translate(LOWER))


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def shingled(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_force(by_id):
    """doc_id to (class, links, copies)."""
    copies = defaultdict(list)
    for d, t in by_id.items():
        copies[t].append(d)
    sets = {t: shingled(t) for t in copies}
    linked = {t: [u for u in sets if u != t and sets[t] and sets[u] and 5 * len(sets[t] & sets[u]) >= 4 * len(sets[t] | sets[u])] for t in sets}
    out = {}
    for t in sets:
        seen, todo = {t}, [t]
        while todo:
            todo += [u for u in linked[todo.pop()] if u not in seen and not seen.add(u)]
        for d in copies[t]:
            out[d] = (min(min(copies[u]) for u in seen), len(linked[t]), len(copies[t]))
    return out


def fill(sizes, weights, most):
    caps = {s: most * n for s, n in sizes.items()}
    total, out, free = sum(sizes.values()), {}, set(sizes)
    while True:
        share = (total - sum(out.values())) / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if share * weights[s] > caps[s]}
        if not over:
            return out | {s: share * weights[s] for s in free}
        out |= {s: caps[s] for s in over}
        free -= over


def contamination(text, items):
    """(words, hit words, items, sha256 of the items, contaminated) of a text, by comparing every window."""
    w, hit, found = words(text), set(), set()
    for i, x in items:
        x = words(x or "")
        n = min(10, len(x))
        wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
        at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in wins] if wins else []
        hit |= {k + j for k in at for j in range(n)}
        found |= {str(i)} if at else set()
    return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
