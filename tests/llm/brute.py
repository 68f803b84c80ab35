"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import xxhash


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_vectors(rows, threshold=0.9):
    """{id: (n_links, component)} of [(id, list or None)] with distinct ids."""
    def ok(v):
        return (v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v))

    groups = defaultdict(list)
    for i, v in rows:
        if ok(v):
            groups[len(v)].append((i, np.array(v, float)))
    links, edges = defaultdict(int), []
    for members in groups.values():
        ids = np.array([i for i, _ in members])
        x = np.stack([v / np.abs(v).max() for _, v in members])
        u = x / np.linalg.norm(x, axis=1)[:, None]
        for at in range(0, len(u), 1000):
            a, b = np.nonzero(u[at:at + 1000] @ u.T >= threshold)
            for p, q in zip(ids[a + at].tolist(), ids[b].tolist()):
                if p != q:
                    links[p] += 1
                    edges.append((p, q))
    found = components([i for i, _ in rows], edges)
    return {i: (links[i], found[i]) for i, _ in rows}


def fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, width=3, distance=3):
    """{id: (fingerprint hex, component)} of [(id, text)] with distinct ids."""
    prints = {i: fingerprint(t, width) for i, t in rows}
    by_print = defaultdict(list)
    for i, p in prints.items():
        by_print[p].append(i)
    keys = list(by_print)
    values = np.array(keys, np.uint64)
    edges = []
    for k, p in enumerate(keys):
        edges += [(by_print[p][0], i) for i in by_print[p][1:]]
        near = np.flatnonzero(np.bitwise_count(values ^ np.uint64(p)) <= distance)
        edges += [(by_print[p][0], by_print[keys[j]][0]) for j in near if j > k]
    found = components(list(prints), edges)
    return {i: (f"{p:016x}", found[i]) for i, p in prints.items()}


def top_k(rows, k=20, every=20):
    """[(query, rank, id, score)] of [(id, vector)] with distinct ids."""
    ok = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows
          if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % every == 0:
            scored = sorted((-int(x @ y), i) for i, y in ok if i != q and len(x) == len(y))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


def dedup_lines(rows, min_words=5):
    """{id: text} of [(id, text)]: every line in a run of min_words words that occurs earlier is gone."""
    docs = [(i, t.split("\n")) for i, t in sorted((r for r in rows if r[1] is not None))]
    gone = defaultdict(set)
    seen = set()  # runs of lines, by content, from earlier starting places
    for i, lines in docs:
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(re.findall(r"[^\x20\x09-\x0D]+", lines[b]))
                run = tuple(lines[a:b + 1])
                if run not in seen:
                    seen.update(tuple(lines[a:c + 1]) for c in range(b, len(lines)))
                    break
                if words >= min_words:
                    gone[i].update(range(a, b + 1))
    out = {i: t for i, t in rows if t is None}
    out.update({i: "\n".join(x for n, x in enumerate(lines) if n not in gone[i]) for i, lines in docs})
    return out


def mix_targets(sizes, weights, share=1.5, most=2.0):
    """{source: target} of {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, clamped = share * sum(sizes.values()), set()
    while True:
        left = [s for s in order if s not in clamped]
        if not left:
            return {s: most * sizes[s] for s in order}
        level = (total - sum(most * sizes[s] for s in clamped)) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in clamped else weight[s] * level for s in order}
        clamped |= over


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def matching_rule(host, path, rules):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def crc(data):
    return None if data is None else zlib.crc32(data)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def collocations(rows, min_count=10, cover=50, top=2000):
    """[(lang, rank, phrase, a, l, r, n, score)] of [(lang, text)]."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in found.items():
            if len(p) == 2 and any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= cover * a for q, b in found.items()):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return out


def exact_groups(rows):
    """[(id, keep_id, group_size, sha256)] of [(id, text)], in their order."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in ((i, lower(t)) for i, t in rows)]


def plant(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic_runs(words, min_length=24, min_periods=3):
    """[(start, length, period)] by start, then period: every lag is scanned over all words."""
    found, (_, x) = {}, np.unique(np.array(words, object).astype(str), return_inverse=True) if words else (None, np.zeros(0))
    for q in range(1, len(x) // min_periods + 1):
        same = np.concatenate([[0], x[:-q] == x[q:], [0]]).astype(np.int8)
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b + q - a >= max(min_length, min_periods * q):
                found.setdefault((a, b + q - a), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def run_digests(doc_id, text):
    """The row of op13_periodic_runs."""
    words = plant(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = periodic_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
