"""Plain versions of the operators, one document after another, to compare results with."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = {c: c + 32 for c in range(0x41, 0x5B)}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def alnum_words(text):
    return WORD.findall((text or "").translate(A_TO_Z))


def contamination(docs, items, window=13):
    windows = defaultdict(set)
    for item_id, text in items:
        words = alnum_words(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[i : i + window])].add(item_id)
    lengths = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        words, hit, found = alnum_words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if owners := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        out[doc_id] = (len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(words))
    return out


def spaced_repeats(docs, length=20):
    """doc_id: (n_words, n_removed, kept_sha256); docs in ascending identifier order."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        words, gone = SPACED.findall(text or ""), set()
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            if key in seen:
                gone.update(range(i, i + length))
            seen.add(key)
        out[doc_id] = (len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def byte_repeats(docs, length=50):
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256); docs in ascending identifier order."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        own = [data[i : i + length] for i in range(len(data) - length + 1)]
        gone = bytearray(len(data))
        for i, w in enumerate(own):
            if w in seen:
                gone[i : i + length] = b"\x01" * length
        seen.update(own)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def shingles(text, n=5):
    words = alnum_words(text)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(docs, n=5, threshold=0.8):
    """doc_id: (class_id, n_links), from all pairs."""
    sets = {d: shingles(t, n) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    both = defaultdict(int)
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                both[a, b] += 1
    parent, links = {d: d for d in sets}, dict.fromkeys(sets, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), k in both.items():
        if k >= threshold * (len(sets[a]) + len(sets[b]) - k) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (root(d), links[d]) for d in sets}


def attribute(tokens, sections):
    """Tokens by section: the one with most of its characters, the earliest on a tie; a character belongs to the section that starts last."""
    counts = defaultdict(int)
    for a, b in tokens:
        votes = defaultdict(int)
        for c in range(a, b):
            own = [k for k, (x, y) in enumerate(sections) if x <= c < y]
            if own:
                votes[max(own, key=lambda k: (sections[k][0], k))] += 1
        counts[min(votes, key=lambda k: (-votes[k], k)) if votes else -1] += 1
    return counts
