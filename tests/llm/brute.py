"""Plain restatements of the operators' contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def base_scores(rows):
    train, out = Counter(), {}
    for doc_id, text in rows:
        if crc(doc_id, 5) != 1:
            train.update([*words(low(text)), None])
    n, v = sum(train.values()), len(train)
    for doc_id, text in rows:
        tokens = [*words(low(text)), None]
        out[doc_id] = (crc(doc_id, 5) == 1, len(tokens), sum(train[t] > 0 for t in tokens), n, sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
    return out


def _covered(rows, window):
    """rows: (doc_id, sequence). For each row, which units lie in a window that starts in a smaller doc_id too."""
    lowest = {}
    for doc_id, seq in rows:
        if doc_id is not None:
            for i in range(len(seq) - window + 1):
                w = seq[i : i + window]
                lowest[w] = min(lowest.get(w, doc_id), doc_id)
    for doc_id, seq in rows:
        gone = bytearray(len(seq))
        if doc_id is not None:
            for i in range(len(seq) - window + 1):
                if lowest[seq[i : i + window]] < doc_id:
                    gone[i : i + window] = b"\x01" * window
        yield doc_id, seq, gone


def windows(rows, window=13):
    return Counter((d, len(s), sum(g), sha(" ".join(w for w, x in zip(s, g) if not x))) for d, s, g in _covered([(d, tuple(words(t))) for d, t in rows], window))


def suffixes(rows, window=50):
    return Counter((d, len(s), sum(g), len(re.findall(rb"\x01+", bytes(g))), sha(bytes(b for b, x in zip(s, g) if not x))) for d, s, g in _covered([(d, (t or "").encode()) for d, t in rows], window))


def lines(rows, min_chars=20, min_docs=3):
    key = lambda line: low(line.strip(SPACES))
    holders = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                holders[key(line)].add(d)
    out = Counter()
    for d, t in rows:
        all_ = (t or "").split("\n")
        keep = [x for x in all_ if d is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == d]
        out[d, len(all_), len(all_) - len(keep), sha("\n".join(keep))] += 1
    return out


def shingles(text, n=5):
    w = words(low(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def closure(nodes, links):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def jaccard(rows, percent=80):
    sets = {d: shingles(t) for d, t in rows}
    ids, links = sorted(sets), []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
    names = closure(ids, links)
    return {d: (len(sets[d]), names[d]) for d in ids}


def edit_in(item, text):
    """Smallest edit distance of item to any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def conversations(rows):
    """conv_id -> what op12 returns, from (conv_id, turn, role, text, dropped)."""
    by = defaultdict(list)
    for conv_id, turn, role, text, dropped in rows:
        by[conv_id] += [] if dropped else [(turn, role, text)]
    out = {}
    for conv_id, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0], r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()) if r[0] is not None else (False, 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            end = text.rstrip(SPACES)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        ends = {"": True, "s": False, "u": False, "a": True}
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}
        best = {}

        def rest(i, last, inserts=2):
            """Cheapest (cost, edits, rows) from row i on, after a row with the initial last."""
            if (i, last, inserts) not in best:
                ways = []
                if i == len(own) and ends[last]:
                    ways.append((0, "", []))
                if inserts:
                    for to in set(follow[last]) - {"s"}:
                        c, e, r = rest(i, to, inserts - 1)
                        ways.append((c + 5, "I" + e, [{"u": "user:", "a": "assistant:"}[to], *r]))
                if i < len(own):
                    _, role, text = own[i]
                    c, e, r = rest(i + 1, last)
                    ways.append((c + 2, "D" + e, r))
                    if faults[i] in ("", "truncated"):
                        extra = 5 * (faults[i] == "truncated")
                        for to, name in (("u", "user"), ("a", "assistant")):
                            if to in follow[last]:
                                c, e, r = rest(i + 1, to)
                                ways.append((c + 1 + extra, "R" + e, [f"{name}:{text}", *r]))
                        if role[:1] and role[:1] in follow[last]:
                            c, e, r = rest(i + 1, role[:1])
                            ways.append((c + extra, "K" + e, [f"{role}:{text}", *r]))
                best[i, last, inserts] = min(ways, key=lambda w: w[:2]) if ways else (10**9, "", [])
            return best[i, last, inserts]

        cost, audit, fixed = rest(0, "")
        n = Counter(faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv_id] = (gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(fixed)), fixed)
    return out
