"""Plain versions of the operators, for small tables."""

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict


def repeats(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def similar(rows):
    sets = {doc: shingles(text) for doc, text in rows}
    least, where = {d: d for d in sets}, defaultdict(list)

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for doc, s in sets.items():
        both = Counter(o for x in s for o in where[x])
        for x in s:
            where[x].append(doc)
        for other, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[other]) - n) and (a := root(doc)) != (b := root(other)):
                least[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def edited(rows):
    rows = sorted((d, t or "") for d, t in rows)
    out = {}
    for i, (doc, text) in enumerate(rows):
        after, q = rows[(i + 1) % len(rows)][1], len(text) // 4
        out[doc] = (len(text), hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest())
    return out


def canonical(text):
    """NFKC, full case folding, NFKC, and white space (as Unicode has it: Python's own also counts \\x1c to \\x1f) folded."""
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ", t).strip(" ")


def likeness(rows):
    """Whether each text's canonical form is that of its edited text, and of the next document."""
    rows = sorted((d, t or "") for d, t in rows)
    out = {}
    for i, (doc, text) in enumerate(rows):
        after, q = rows[(i + 1) % len(rows)][1], len(text) // 4
        out[doc] = tuple(float(canonical(text) == canonical(x)) for x in (text[: len(text) - q] + after[:q], after))
    return out


BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n]
    return [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def cut_lines(rows, least=40, documents=5):
    """rows of (doc_id, text): the kept text, lines and dropped lines of each, in their order."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held, out = defaultdict(set), []
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(float("-inf") if doc is None else doc)
    often = {k: max(d) for k, d in held.items() if len(k) >= least and len(d) >= documents}
    for doc, text in rows:
        lines, own = (text or "").split("\n"), float("-inf") if doc is None else doc
        kept = [x for x in lines if own >= often.get(key(x), float("-inf"))]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def codes(rows, parts=16, entries=64, rounds=2):
    """rows of (vec_id, vector, label) that take part, all of one size: (code, error, label_error) of each, and the digest."""
    import math

    cuts = [[[math.floor(256 * x) for x in v[i * len(v) // parts : (i + 1) * len(v) // parts]] for i in range(parts)] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, cuts[i]))[:entries]
    books = [[cuts[i][p] for i in order] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((distance(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            met = defaultdict(list)
            for c in cuts:
                met[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(met[k]) for x in zip(*met[k], strict=True)] if k in met else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cuts]
    errors, by_label = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [("".join(f"{k:02x}" for _, k in f), e, by_label[r[2]]) for f, e, r in zip(found, errors, rows, strict=True)], sha


def manifest(rows, fanout=16):
    """rows of (doc_id, source, lang, n_chars, text): leaf, subroot, root, proof, folded root and verified of each."""
    import zlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    item = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(item, r)))

    def climb(nodes):
        """The root, and for each node what stands before and after it on each level."""
        paths, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, w in enumerate(where):
                a, b = w // fanout * fanout, min((w // fanout + 1) * fanout, len(nodes))
                paths[i].append(("".join(nodes[a:w]), "".join(nodes[w + 1 : b])))
            nodes = [sha("".join(nodes[a : a + fanout])) for a in range(0, len(nodes), fanout)]
            where = [w // fanout for w in where]
        return nodes[0], paths

    sources = defaultdict(list)
    for r in rows:
        sources[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    root, tops = climb([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, doc, own, r), path in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            node = own
            if doc is not None and r[0] is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for before, after in path + top:
                node = sha(before + node + after)
            out.append((r[0], own, trees[s][0], root, sha("".join(x for p in path + top for x in p)), node, node == root))
    return out
