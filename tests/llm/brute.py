"""Plain-Python statements of the contracts, for small tables."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near_duplicates(docs, size=4, percent=80):
    sets = {}
    for i, t in docs:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((kind, m.start(), m.end()))
    return out


def quality_base(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = {}
    for i in range(len(w) - 4):
        count[tuple(w[i : i + 5])] = count.get(tuple(w[i : i + 5]), 0) + 1
    marked = {i + k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked), n < 10 or 100 * len(marked) > 20 * n


def source_targets(sizes, weights=(1, 2, 3), most=3.0):
    """sizes: source -> words. Shares of all words by weight; a source over `most` times its size stops there, the excess is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped = {}
    while True:
        rest = {s for s in order if s not in stopped}
        left = sum(sizes.values()) - sum(stopped.values())
        share = {s: left * w[s] / sum(w[r] for r in rest) for s in rest}
        over = {s for s in rest if share[s] > most * sizes[s]}
        if not over:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in over}


def best_states(features, emit, move):
    """The best path of two states by dynamic programming over whole tables; content (1) where two paths score the same."""
    n = len(features)
    if not n:
        return []
    gain = [float(f @ emit) for f in features]
    score, back = [[0.0, gain[0]]], []
    for g in gain[1:]:
        a, b = score[-1]
        options = [[a + move[0][s], b + move[1][s]] for s in (0, 1)]
        back.append([int(o[1] >= o[0]) for o in options])
        score.append([max(options[0]), max(options[1]) + g])
    states = [int(score[-1][1] >= score[-1][0])]
    for step in reversed(back):
        states.append(step[states[-1]])
    return states[::-1]


def repeats(docs, depth=20):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = words(t)
        gone = set()
        for k in range(len(w) - depth + 1):
            path = tuple(w[k : k + depth])
            if path in seen:
                gone.update(range(k, k + depth))
            seen.add(path)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def vectors(rows, threshold=0.95):
    good = {i: np.asarray(v, float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, float))}
    ids = sorted(good)
    u = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    ok = u @ u.T >= threshold
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(ok, 1)), strict=True)]
    comp = components([i for i, _ in rows], links)
    n = dict(zip(ids, (ok.sum(axis=1) - 1).tolist(), strict=True))
    return {i: (n.get(i, 0), comp[i], comp[i] == i) for i, _ in rows}


def encoded(docs, tok, end=None):
    out, start = {}, 0
    for i, t in sorted(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        ids = ids + ([end] if end is not None else [])
        raw = np.array(ids, "<u4").tobytes()
        out[i] = (start, len(ids), zlib.crc32(raw), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        start += len(ids)
    return out


def rebuilt_conversations(rows, group=100, heads=6):
    """conv_id -> its rebuilt turns, as (role, text), from rows (conv_id, turn, role, text)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest() + len(text).to_bytes(4, "big")
            own.setdefault(conv, []).append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(np.fmod(c, group))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def prefix_trie(rows):
    """(conv_id, depth) -> (parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    members = {}
    rebuilt = rebuilt_conversations(rows)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = {}
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out[min(cs), len(p)] = (parent, len(cs), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def failed_filters(docs):
    """Letters of the filters that each row of (doc_id, text) fails."""
    low = {}
    for i, t in docs:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    out = []
    for i, t in docs:
        t = t or ""
        w = words(t)
        tests = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > low[t],
        }
        out.append({k for k, v in tests.items() if v})
    return out


def filter_interactions(docs, labels):
    """(part, order, step) -> the seven counts, from docs (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    fails = failed_filters([(i, t) for i, t, _ in docs])
    out = {}
    for part in {lang or "" for *_, lang in docs}:
        own = [(i, f) for (i, _, lang), f in zip(docs, fails, strict=True) if (lang or "") == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                here, stay = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                out[part, "".join(order), k + 1] = [
                    len(stay), len(here), sum(x in f for _, f in own) - len(here), sum(f == {x} for _, f in own),
                    sum(i in good for i, _ in here), sum(i in toxic for i, _ in here),
                ]
                removed_in_all[x] += len(here)
                left = stay
        for (p, order, k), v in out.items():
            if p == part:
                v.append(removed_in_all[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}
