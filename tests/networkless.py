"""Heaviest clique by plain recursion, smallest ids on ties."""


def heaviest(weights, edges):
    adj = {n: set() for n in weights}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    best = [0, []]

    def grow(chosen, w, cands):
        if w > best[0] or (w == best[0] and chosen < best[1]):
            best[:] = [w, chosen]
        for i, n in enumerate(cands):
            grow([*chosen, n], w + weights[n], [m for m in cands[i + 1:] if m in adj[n]])

    grow([], 0, sorted(weights))
    return best[1]
