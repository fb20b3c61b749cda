"""Plain Python versions of the segment rules, for comparison."""

import functools
import re


def norm(text):
    return " ".join(re.sub(r"[^\w\s]", " ", (text or "").lower()).split())


def distance(a, b):
    @functools.lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    return d(len(a), len(b))


def similarity(a, b):
    a, b = norm(a), norm(b)
    if a == b:
        return 1.0
    return 0.0 if not a or not b else 1 - distance(a, b) / max(len(a), len(b))


def ratio(x, y):
    shared = min(x["end"], y["end"]) - max(x["start"], y["start"])
    return max(0.0, shared) / max(0.001, x["end"] - x["start"], y["end"] - y["start"])


def spoken(x):
    label = (x.get("speaker") or "").strip().upper()
    return label if re.fullmatch(r"SPEAKER_\d+", label) else None


def score(x, y):
    t, o, a, b = similarity(x["text"], y["text"]), ratio(x, y), spoken(x), spoken(y)
    if max(t, o) < 0.45 or (a and b and a != b):
        return 0.0
    return min(1.0, 0.7 * t + 0.3 * o + (0.15 if a and b else 0.0))


def path(scores):
    """Best total and its path, by trying everything; ties as the operator breaks them."""

    @functools.lru_cache(None)
    def best(i, j):
        if not i or not j:
            return 0.0, ()
        up, left, s = best(i - 1, j), best(i, j - 1), scores[i - 1][j - 1]
        corner = best(i - 1, j - 1)
        if s > 0 and corner[0] + s >= max(up[0], left[0]):
            return corner[0] + s, (*corner[1], (i - 1, j - 1))
        return left if left[0] > up[0] else up

    return list(best(len(scores), len(scores[0]))[1]) if scores and scores[0] else []


def resolve(previous, current, low, high):
    if not previous or not current:
        return previous or current
    middle, taken = low + (high - low) / 2, []
    pairs = path([[score(p, c) for c in current] for p in previous])
    for i, j in pairs:
        p, at = previous[i], (previous[i]["start"] + previous[i]["end"]) / 2
        same = norm(p["text"]) == norm(current[j]["text"])
        taken.append(p if at < middle or (same and at == middle) else current[j])
    taken += [p for i, p in enumerate(previous) if i not in {i for i, _ in pairs}]
    taken += [c for j, c in enumerate(current) if j not in {j for _, j in pairs}]
    kept = []
    for x in sorted(taken, key=lambda s: (s["start"], s["end"])):
        if not kept or score(kept[-1], x) < 0.9:
            kept.append(x)
    return kept


def emit(chunks, overlap):
    """Texts that each chunk emits, with a running tail, and what is left at the end."""
    tail, out = [], []
    for c in chunks:
        segs, now = c["segments"], []
        head_end, tail_start = min(c["chunk_end"], c["chunk_start"] + overlap), max(c["chunk_start"], c["chunk_end"] - overlap)
        had = bool(tail)
        if had:
            now += resolve(tail, [s for s in segs if s["start"] < head_end], c["chunk_start"], head_end)
        else:
            now += [s for s in segs if s["end"] <= max(c["chunk_end"] - overlap, 0)]
        if c["is_last"]:
            now += [s for s in segs if (s["start"] >= head_end if had else s["end"] > max(c["chunk_end"] - overlap, 0))]
            tail = []
        else:
            if had:
                now += [s for s in segs if s["start"] >= head_end and s["end"] <= tail_start]
            tail = [s for s in segs if s["end"] > tail_start]
        out.append(now)
    return out, tail


def more(a, b):
    a, b = norm(a), norm(b)
    return bool(b) and len(a) > len(b) and similarity(a[: len(b)], b) >= 0.85


def merge(previous, current, low, high):
    if not previous or not current:
        return previous or current
    po, co = [s for s in previous if s["end"] > low], [s for s in current if s["start"] < high]
    middle = lambda s: (s["start"] + s["end"]) / 2
    scores = [[score(p, c) for c in co] for p in po]
    gone_p, gone_c = [], []
    for i, j in path(scores):
        p, c = po[i], co[j]
        newer = more(c["text"], p["text"]) or (not more(p["text"], c["text"]) and max(0, middle(c) - low) > max(0, high - middle(p)))
        (gone_p if newer and scores[i][j] >= 0.55 else gone_c).append((p if newer and scores[i][j] >= 0.55 else c))
    has = lambda s, gone: any(s is g for g in gone)
    gone_c += [c for j, c in enumerate(co) if any(scores[i][j] >= 0.82 and not has(p, gone_p) for i, p in enumerate(po))]
    kept = [p for p in previous if not has(p, gone_p)] + [c for c in current if not has(c, gone_c)]
    return sorted(kept, key=lambda s: (s["start"], s["end"]))
