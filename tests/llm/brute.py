"""What the operators must give, worked out plainly, one row at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def listed(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.A)
        if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]


def luhn(digits):
    twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
    return sum(twice) % 10 == 0


def personal(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
              if all(int(part) <= 255 for part in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    return found + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                    if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    t = text or ""
    found = words(t)
    lines = [line for line in t.split("\n") if WORD.search(line)]
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in t),
            len(lines) - len(set(lines)), len(covered))


def shingles(text):
    found = words((text or "").translate(LOWER))
    if len(found) < 5:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i:i + 5]) for i in range(len(found) - 4))


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard_components(rows):
    """Of (doc_id, text) rows; a repeated id is one document."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    pairs = []
    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                pairs.append((a, b))
    return components(pairs, {i for i, _ in sets})


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """source to target, sharing the excess again until none is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > most * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in rest}
        for s in over:
            full[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


def apportion(weights, seats):
    """Seats by highest quotients weight / (2 k + 1), ties to the first."""
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max(weights, key=lambda n: (weights[n] / (2 * got[n] + 1), -n))
        got[best] += 1
    return got


def warc_rows(pages):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of (page_id, html) rows."""
    digests = defaultdict(list)
    for page_id, html in pages:
        digests[sha(html or "")].append(page_id)
    out = []
    for page_id, html in pages:
        data, digest = (html or "").encode(), sha(html or "")
        known = [i for i in digests[digest] if i is not None]
        first = min(known) if known else None
        revisit = len(data) >= 100 and page_id != first
        out.append((page_id, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 5 * counts[w]}
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def manifest(rows):
    """Of rows (doc_id, source, lang, n_chars, text)."""
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append(row)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in by_lang[v]]) for v in langs]
    top = tree([t[-1][0] for t in trees])
    out = []
    for number, lang in enumerate(langs):
        for place, row in enumerate(by_lang[lang]):
            doc_id, text = row[0], row[4]
            if zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 0 and text is not None:
                text = text.translate(LOWER)
            fold, proof = leaf((*row[:4], text)), []
            for levels, at in ((trees[number], place), (top, number)):
                for nodes in levels[:-1]:
                    first = at - at % 8
                    left, right = nodes[first:at], nodes[at + 1:first + 8]
                    proof += left + right
                    fold, at = sha("".join([*left, fold, *right])), at // 8
            out.append((doc_id, leaf(row), trees[number][-1][0], top[-1][0], sha("".join(proof)), fold, fold == top[-1][0]))
    return out
