"""Plain-Python references of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, bench, size=8, least=2):
    wins = {}
    for item, text in bench:
        w = words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = wins.get(tuple(w[i : i + n]))
                if got:
                    hit.update(range(i, i + n))
                    items |= got
        named = sorted(str(x) for x in items if x is not None)
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), len(named) >= least))
    return out


def nearly(docs, bench, size=8, slop=4):
    """(doc_id, n_near): items of which a window's two rarest words stand at most ``slop`` words off their distance."""
    split = [(d, words(t)) for d, t in docs]
    count = {}
    for _, w in split:
        for x in w:
            count[x] = count.get(x, 0) + 1
    wins = set()
    for item, text in bench:
        w = words(text)
        wins |= {(item, tuple(w[i : i + size])) for i in range(max(1, len(w) - size + 1)) if w}
    out = []
    for doc, w in split:
        places, items = {}, set()
        for i, x in enumerate(w):
            places.setdefault(x, []).append(i)
        for item, win in wins:
            if item is None or item in items:
                continue
            rare = sorted(range(len(win)), key=lambda o: (count.get(win[o], 0), o))[:2]
            a, b = ([p - o for p in places.get(win[o], ())] for o in (rare[0], rare[-1]))
            if any(abs(x - y) <= slop for x in a for y in b):
                items.add(item)
        out.append((doc, len(items)))
    return out


def secret_spans(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    for rank, kind, regex, least in ((1, "access", "AKIA[A-Z0-9]+", 16), (2, "hex", "[0-9a-f]+", 32)):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(regex, text) if len(m[0]) >= least]
    return sorted(found)


def secret_row(doc, text):
    s = secret_spans(text)
    line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
    return (doc, *(sum(x[1] == i for x in s) for i in range(3)), hashlib.sha256(line.encode()).hexdigest())


def fingerprint(text, width=3):
    low = (text or "").translate(LOWER)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(docs, radius=3):
    fps = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and top(i) != top(j):
                parent[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return [(d, f"{fps[i]:016x}", low.get(top(i))) for i, (d, _) in enumerate(docs)]


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def without_repeats(docs, length=100):
    """Rows (doc_id, n_bytes, n_removed, n_spans, sha256), by first places of all windows."""
    first = {}
    for d, text in docs:
        x = (text or "").encode()
        for i in range(len(x) - length + 1):
            w, here = x[i : i + length], (d, i)
            if here < first.get(w, (here[0], here[1] + 1)):
                first[w] = here
    out = []
    for d, text in docs:
        x = (text or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if first[x[i : i + length]] < (d, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def licenses(docs, model, templates, marks, grams_of, least=0.75, sure=0.5, reach=2):
    """Rows (doc_id, n_paragraphs, n_licensed, families, spans)."""
    import math

    def judged(text):
        have = set(grams_of(text))
        z = list(model.bias)
        for g in have:
            for i, w in enumerate(model.weights.get(g, ())):
                z[i] += w
        z = [x / model.temperature for x in z]
        best = max(range(len(z)), key=lambda i: z[i])
        family = model.families[best]
        share = max((sum(g in have for g in t) / len(t) for f, _, t in templates if f == family), default=0.0)
        fine = family != "unknown" and 1 / sum(math.exp(x - z[best]) for x in z) >= sure and share >= least
        return family if fine else None

    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        marked = [bool(re.search(marks, x.lower())) for x in lines]
        near = [bool(re.search(r"[^ \t\n\x0b\f\r]", x)) and any(marked[max(0, i - reach) : i + reach + 1]) for i, x in enumerate(lines)]
        found = [(i, i, f) for i, x in enumerate(lines) if marked[i] and near[i] and (f := judged(x))]
        single, i = {a for a, _, _ in found}, 0
        while i < len(lines):
            j = i
            while j < len(lines) and near[j]:
                j += 1
            if j - i > 1 and not single & set(range(i, j)) and (f := judged(" ".join(lines[i:j]))):
                found.append((i, j - 1, f))
            i = max(j, i + 1)
        runs = sum(bool(re.search(r"[^ \t\n\x0b\f\r]", x)) for x in re.split(r"\n[ \t\n\x0b\f\r]*\n", text or ""))
        out.append((doc, runs, len(found), ",".join(sorted({f for _, _, f in found})), ",".join(f"{a}-{b}:{f}" for a, b, f in sorted(found))))
    return out
