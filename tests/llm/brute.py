"""Plain readings of the contracts, one document or pair at a time."""

import hashlib
import re

import numpy as np
import xxhash


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def pii_row(text):
    spans = base_spans(text)
    counts = tuple(sum(s[2] == k for s in spans) for k in BASE)
    return counts + (sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)),)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_row(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def simhash_components(rows):
    """{doc_id: (hex, component)} of [(doc_id, text)]."""
    fps = {d: simhash(t) for d, t in rows}
    distinct = np.array(sorted(set(fps.values())), dtype=np.uint64)
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, x in enumerate(distinct):
        diff = distinct ^ x
        ones = np.unpackbits(diff.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
        for j in np.flatnonzero(ones <= 2):
            parent[find(int(j))] = find(i)
    at = {int(x): i for i, x in enumerate(distinct)}
    first = {}
    for d, f in fps.items():
        r = find(at[f])
        first[r] = min(first.get(r, d), d)
    return {d: (f"{f:016x}", first[find(at[f])]) for d, f in fps.items()}


def similar_components(rows):
    """{doc_id: component} of [(doc_id, text)]: near fingerprints, or a Jaccard similarity of 0.8 on five-word shingles."""
    groups = {d: c for d, (_, c) in simhash_components(rows).items()}
    parent = {c: c for c in groups.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets, by_shingle = {}, {}
    for d, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        sets[d] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
        common = {}
        for x in sets[d]:
            for e in by_shingle.setdefault(x, []):
                common[e] = common.get(e, 0) + 1
            by_shingle[x].append(d)
        for e, n in common.items():
            if n >= 0.8 * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(groups[d]), find(groups[e])
                parent[max(a, b)] = min(a, b)
    return {d: find(c) for d, c in groups.items()}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def contamination_rows(docs, items, window=10):
    windows = {}
    for item, text in items:
        ws = item_words(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1) if n else ():
            windows.setdefault(tuple(ws[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        ws = item_words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                w = windows.get(tuple(ws[i : i + n]))
                if w:
                    hit.update(range(i, i + n))
                    found |= w
        names = sorted(map(str, found))
        out[d] = (len(ws), len(hit), len(names), sha(",".join(names)), bool(hit))
    return out


def chat_row(turns):
    """turns: [(role, text)]."""
    said = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said)


def repeated_paragraphs(rows, width=5, similar=0.8, passage=50):
    """Rows (doc_id, start, end, n_words, class_doc_id, class_start, removed) of [(doc_id, text)], by all pairs that share a shingle."""
    units, of_text = [], {}
    for uid, (doc_id, text) in enumerate(rows):
        at = n = 0
        for line in (text or "").split("\n"):
            ws = tuple(item_words(line))
            if len(ws) >= width:
                node = of_text.setdefault(ws, len(of_text))
                units.append((uid, doc_id, n, at, at + len(line), len(ws), node))
                n += 1
            at += len(line) + 1
    sets = [{ws[i : i + width] for i in range(len(ws) - width + 1)} for ws in of_text]
    by_shingle = {}
    for node, own in enumerate(sets):
        for x in own:
            by_shingle.setdefault(x, []).append(node)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for node, own in enumerate(sets):
        for other in {o for x in own for o in by_shingle[x] if o > node}:
            both = len(own & sets[other])
            if both >= similar * (len(own) + len(sets[other]) - both) - 1e-9:
                parent[find(node)] = find(other)
    classes = {}
    for u in units:
        classes.setdefault(find(u[6]), []).append(u)
    first = {c: min(us, key=lambda u: (u[1] is None, u[1] or 0, u[0], u[2])) for c, us in classes.items() if len({u[0] for u in us}) > 1}
    out, run = [], []

    def close():
        if sum(u[5] for u in run) >= passage:
            for u in run:
                f = first[find(u[6])]
                out.append((u[1], u[3], u[4], u[5], f[1], f[3], (u[0], u[2]) != (f[0], f[2])))
        run.clear()

    for u in units:
        if find(u[6]) not in first or (run and (run[-1][0], run[-1][2] + 1) != (u[0], u[2])):
            close()
        if find(u[6]) in first:
            run.append(u)
    close()
    return out
