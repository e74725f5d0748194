"""A plain model of the search, over Python lists."""

import re
from collections import Counter, defaultdict

M64 = (1 << 64) - 1
UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁІӘҒҚҢӨҰҮҺ"
LOW = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяёіәғқңөұүһ"


def normalize(s):
    s = s.translate(str.maketrans(UP, LOW))
    return " ".join(re.findall("[a-z0-9Ѐ-ԯ]+", s))


def tokens(s):
    return [t for t in s.split(" ") if t]


def fnv(token):
    h = 1469598103934665603
    for b in token.encode():
        h = (h ^ b) * 1099511628211 & M64
    return h


def combined(hashes):
    h = 0x9E3779B97F4A7C15
    for t in hashes:
        h ^= (t + 0x9E3779B97F4A7C15 + (h << 6) + (h >> 2)) & M64
        h &= M64
    return h


def simhash(hashes):
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def search(segments, query, o):
    """segments: {name: [(did, doc_id, tokens)]} in order; [(doc_id, segment, matched, C, spans)] best first."""
    q = defaultdict(list)
    for i in range(len(query) - 8):
        q[tuple(query[i : i + 9])].append(i)
    total = sum(map(len, q.values()))
    best = {}
    for order, (name, docs) in enumerate(segments.items()):
        posts = defaultdict(list)
        for did, _, t in docs:
            for i in range(len(t) - 8):
                posts[tuple(t[i : i + 9])].append((did, i))
        use = {h for h in q if h in posts and len(posts[h]) <= o.max_postings_per_hash}
        hits = Counter(did for h in use for did, _ in posts[h])
        chosen = sorted((d for d in hits if hits[d] >= o.min_hits), key=lambda d: (-hits[d], d))[: o.candidates_topn]
        found = []
        for did, doc_id, t in docs:
            if did not in chosen:
                continue
            lines = defaultdict(set)
            for h in use:
                for d, p in posts[h]:
                    if d == did:
                        for i in q[h]:
                            lines[p - i].add(i)
            runs = []
            for delta, places in lines.items():
                run = []
                for i in [*sorted(places), None]:
                    if run and (i is None or i - run[-1] > 1 + o.span_gap):
                        if run[-1] - run[0] + 1 >= o.span_min_len:
                            runs.append((-(run[-1] - run[0] + 1), run[0], delta))
                        run = []
                    run.append(i)
            runs = sorted(runs)[: o.max_spans_per_doc]
            if runs:
                matched = -sum(r[0] for r in runs)
                cq, cd = min(1, matched / total), min(1, matched / (len(t) - 8))
                c = 100 * min(1, max(0, o.alpha * cq + (1 - o.alpha) * cd))
                found.append((c, did, doc_id, name, matched, [(s, s - n - 1, s + d, s - n - 1 + d, -n) for n, s, d in runs]))
        for r, (c, _, doc_id, name, matched, runs) in enumerate(sorted(found, key=lambda f: (-f[0], f[1]))[: o.topk]):
            if doc_id not in best or (-c, order, r) < best[doc_id][0]:
                best[doc_id] = ((-c, order, r), (doc_id, name, matched, c, runs))
    return sorted((v[1] for v in best.values()), key=lambda v: (-v[3], v[0]))[: o.topk]
