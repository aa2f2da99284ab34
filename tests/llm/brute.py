"""Plain Python versions of the operators' rules, for comparison on small inputs."""

import hashlib
import re

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
IDENT = re.compile(r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""")
KEY40 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+]*://[^\x20\x09-\x0D"'<>]+""")
KINDS = ("assign", "access", "hex", "ident", "short", "key40", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "access": "id", "ident": "id", "short": "secret", "key40": "secret", "endpoint": "endpoint"}


def secrets(text, scope=400):
    """(base spans, all spans) as sorted (start, kind index, end)."""
    text = text or ""
    base, weak = [], []
    for m in ASSIGN.finditer(text):
        (base if len(m[2]) >= 8 else weak).append((m.start(), 0 if len(m[2]) >= 8 else 4, m.end()))
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    weak += [(m.start(), 3, m.end()) for m in IDENT.finditer(text)]
    weak += [(m.start(), 5, m.end()) for m in KEY40.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])]
    weak += [(m.start(), 6, m.end()) for m in ENDPOINT.finditer(text)]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    parts = base + weak
    kept = []
    for w in weak:
        wanted = {"secret": ("id", "endpoint")}.get(ROLE[KINDS[w[1]]], ("secret",))
        if any(ROLE[KINDS[p[1]]] in wanted and p[0] <= w[2] + scope and p[2] >= w[0] - scope for p in parts):
            kept.append(w)
    return sorted(base), sorted(base + kept)


def span_text(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def exact_classes(rows):
    """(doc_id, text) rows with distinct ids -> {doc_id: (keep_id, group_size, kept, sha)}."""
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], sha(k)) for k, g in groups.items() for _, i in g}


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def union(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def near_components(rows):
    """(doc_id, text) rows -> {doc_id: (n_shingles, component_id)}, all pairs compared."""
    sets = [(i, shingles(t)) for i, t in rows]
    pairs = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    pairs.append((i, j))
    low = union(pairs)
    return {i: (len(s), low.get(i, i)) for i, s in sets}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(3, 1, 2), share=1.5):
    """{source: words} -> {source: target}, resharing the excess until none is left."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(w[s] for s in free)
        full = [s for s in free if left * w[s] / total > 2 * sizes[s]]
        if not full:
            return out | {s: left * w[s] / total for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in full)
        free = [s for s in free if s not in full]
    return out
