"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import heapq
import math
import re
import zlib

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_counts(text: str | None) -> tuple:
    text = text or ""
    w = WORDS.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = collections.Counter(grams)
    repeat = len({j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)})
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            repeat, len(w) < 50 or 100 * repeat > 50 * len(w))


def simhash(text: str | None) -> int:
    w = WORDS.findall(lower(text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(points: list[int], radius: int = 3) -> list[int]:
    """For each place, the smallest place reachable over links of at most ``radius`` bits."""
    up = list(range(len(points)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i
    p = np.array(points, np.uint64)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= radius):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(points))]


def license_base(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    at = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"),
                                           ("general public license", "gpl"))
          for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in at})))


def nearest(ids: np.ndarray, vectors: np.ndarray, query: int, k: int) -> list[tuple[int, float]]:
    d = np.sqrt(((vectors - vectors[query]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
       "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _holds(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        d = [int(c) for c in reversed(digits)]
        return 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def pii_spans(text: str | None) -> list[str]:
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PII.items())
             for m in re.finditer(p, text or "") if _holds(k, m.group())]
    return [s for _, _, s in sorted(found)]


def sha(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(rows):
    """rows: (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or 0), r[2].encode(), r[3].encode()))


def repair(rows):
    """Shortest edits of one damaged conversation by best-first search over whole audits."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        core = text.strip(SPACE)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else
                      "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[:1] for _, _, r, _ in rows]
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, made, kept = heapq.heappop(queue)
        state = made[-1:] if made else ""
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            break
        if (i, state, ) in done:
            continue
        done.add((i, state))
        due = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        heapq.heappush(queue, (cost + 2, audit + "I", i, made + due, kept + (f"{name}:",)))
        if i < len(rows):
            role, text, f = rows[i][2], rows[i][3], faults[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, made, kept))
            if f not in ("blank", "duplicate"):
                extra = f == "truncated"
                heapq.heappush(queue, (cost + 2 + extra, audit + "R", i + 1, made + due, kept + (f"{name}:{text}",)))
                if role[:1] == due or (role[:1] == "s" and not made):
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, made + role[:1], kept + (f"{role}:{text}",)))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(kept).encode()).hexdigest())


def repaired_all(rows):
    bad = damage(rows)
    return [(c, *repair([r for r in bad if r[0] == c])) for c in {r[0] for r in rows}]


def hard_negatives(rows, n_positives=5, k=3):
    """rows: (vec_id, vector, label)."""
    ok = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(ok):
        if i % 50:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), j, b, m) for b, (j, w, m) in enumerate(ok)
                        if b != a and len(w) == len(v))
        for s, j, _, _ in [r for r in ranked if r[3] == label][:n_positives]:
            fits = [(-t, n) for t, n, _, m in ranked if m != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, r + 1, n, -s, t) for r, (t, n) in enumerate(fits[:k])]
    return out


def remove_repeated(rows, length):
    """rows: (doc_id, text). By counting every string."""
    bodies = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(b[i:i + length] for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out
