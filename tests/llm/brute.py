"""Plain versions of what the operators must return."""

import collections


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(texts):
    """[(doc_id, n, component)] by comparing all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    seen = collections.Counter()
    for at in where.values():
        for i, a in enumerate(at):
            for b in at[i + 1 :]:
                seen[a, b] += 1
    for (a, b), both in seen.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            top[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(texts, sets))]
