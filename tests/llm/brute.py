"""Plain, slow versions of what the operators promise, over `(doc_id, text)` rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return BLANKS.findall(text or "")


def substring_dedup(rows, window: int = 50) -> dict:
    first: dict[tuple, int] = {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), doc_id)
    out = {}
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def secrets(text: str | None) -> tuple:
    text, found = text or "", []
    kinds = (
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    )
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        hits = [m for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in hits]
    spans = [s for _, _, s in sorted(found)]
    counts = Counter(s.split(":")[0] for s in spans)
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(",".join(spans).encode()).hexdigest(), spans


def shingle_set(text: str | None) -> frozenset:
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_duplicates(rows) -> dict:
    sets = {doc_id: shingle_set(text) for doc_id, text in rows}
    holders = defaultdict(list)
    for doc_id, own in sets.items():
        for s in own:
            holders[s].append(doc_id)
    parent = {doc_id: doc_id for doc_id in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, own in sets.items():
        shared = Counter(b for s in own for b in holders[s] if b > a)
        for b, n in shared.items():
            if 100 * n >= 75 * (len(own) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(own), root(d), root(d) == d) for d, own in sets.items()}


def contained(docs, items, threshold: float = 0.75) -> set:
    out = set()
    queries = [(k, shingle_set(t)) for k, t in items]
    for doc_id, text in docs:
        own = shingle_set(text)
        out |= {(doc_id, k) for k, s in queries if s and len(s & own) >= threshold * len(s)}
    return out


def warc(pages) -> dict:
    largest: dict[str, int] = {}
    for page_id, html in pages:
        if len((html or "").encode()) >= 1000:
            largest[html] = max(page_id, largest.get(html, page_id))
    out = {}
    for page_id, html in pages:
        body = (html or "").encode()
        to = largest.get(html, page_id)
        out[page_id] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if to != page_id else "response", to if to != page_id else None)
    return out


def licenses(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    places = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(repeated), failed
