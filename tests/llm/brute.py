"""Plain Python versions of the operators' contracts."""

import collections
import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def suffix_dedup(docs, window=100):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256); documents in order of id."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            if w in seen:
                gone[k : k + window] = [True] * window
            seen.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def window_dedup(docs, window=35):
    all_ = {i: words(t) for i, t in docs}
    n = collections.Counter(tuple(w[k : k + window]) for w in all_.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in all_.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_dedup(docs, percent=85):
    """doc_id -> (n_shingles, component, kept), over all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = [False] * len(w)
    for k in range(len(w) - 7):
        if n[tuple(w[k : k + 8])] > 1:
            cover[k : k + 8] = [True] * 8
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), sum(cover)


def contamination(docs, items, window=12, least=10):
    """{(doc_id, item_id): most equal words on an alignment that counts}, over all alignments."""
    out = {}
    for d, t in docs:
        dw = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        for i, it in items:
            iw = re.findall(r"[^\x20\x09-\x0D]+", (it or "").lower())
            if len(iw) < 5:  # a short item must be the whole document
                if iw and iw == dw:
                    out[d, i] = len(iw)
                continue
            for off in range(-len(iw) + 1, len(dw)):
                same = [dw[off + q] == iw[q] for q in range(max(0, -off), min(len(iw), len(dw) - off))]
                if len(iw) >= window:
                    good = any(sum(same[k : k + window]) >= least for k in range(len(same) - window + 1))
                else:
                    good = len(same) == len(iw) and all(same)
                if good:
                    out[d, i] = max(out.get((d, i), 0), sum(same))
    return out


SPANS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, r, ok) in enumerate(SPANS) for m in r.finditer(text or "") if ok(m)]
    return [f"{SPANS[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


LONG_CHARACTERS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def token_spans(text, n_tokens):
    """Spans of random strings without digests and UUIDs, character by character; ``n_tokens`` counts a string's tokens."""
    t = text or ""
    base = [tuple(map(int, s.split(":")[1:])) for s in base_spans(t)]
    out, k = [], 0
    while k < len(t):
        if t[k] not in LONG_CHARACTERS:
            k += 1
            continue
        a = k
        while k < len(t) and t[k] in LONG_CHARACTERS:
            k += 1
        s = t[a:k]
        if len(s) < 20 or any(x < k and a < y for x, y in base) or not any(c.isalpha() for c in s):
            continue
        digits = any(c.isdigit() for c in s)
        if not digits and any(c in "_-/" for c in s):
            continue
        if len(s) / sum(n_tokens(s[i : i + 256]) for i in range(0, len(s), 256)) < (2.0 if digits else 1.8):
            out.append(f"token:{a}:{k}")
    return out
