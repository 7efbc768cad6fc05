"""Plain versions of what the operators must give, and a small corpus with every kind of difficult row."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def corpus(seed: int = 5, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts of two languages' words, near and exact copies, shared passages, junk; and the edge cases."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "anti", "tion", "here", "Thon", "edre", "é", "élan", "Über", "x"] + ["".join(rng.choice("abcdeilnorstué") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(80))
    made: list[str] = []
    for _ in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) + "." for _ in range(rng.randint(1, 8))]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), passage)
        text = "\n".join(lines)
        if made and rng.random() < 0.3:
            w = rng.choice(made).split(" ")
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        made.append(text)
    rows: list[tuple[int | None, str | None]] = list(enumerate(made))
    rows += [rows[3], rows[3], (1000, made[3]), (None, made[3]), (None, None), (1001, None), (1002, ""), (1003, " \t\n\x0b "), (1004, "One"), (1005, "one  TWO"), (1006, "a b\x1fc d\x00e")]
    rows += [(1007, "tick tock " * 3000), (1008, " ".join(rng.choice(vocabulary) for _ in range(9000))), (1009, "x" * 50_000), (1010, "tick tock " * 3000), (4, "another text under a number that is taken " * 9)]
    return rows


def op4(rows):
    def fingerprint(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for (doc, _), f in zip(rows, fps):
        if doc is not None:
            least[find(f)] = min(least.get(find(f), doc), doc)
    return [(doc, f"{f:016x}", least.get(find(f))) for (doc, _), f in zip(rows, fps)]


def near_copies(rows, shingle=5):
    """One (doc_id, text) of each group of texts linked by a Jaccard similarity of at least 0.8."""
    rows = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or {tuple(w)} - {()})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return [rows[g] for g in sorted(set(group))]


def op7(rows, window=50):
    first: dict[tuple, int] = {}
    for doc, text in rows:
        if doc is not None:
            w = words(text)
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def op8(text):
    w = words(text)
    n = len(w)
    count = Counter(zip(w, w[1:], w[2:]))
    twice = {k for i in range(n - 2) if count[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice), n < 50 or 100 * len(twice) > 50 * n


def op9(rows, min_words=1, near_words=5):
    """Rows come in the order of doc_id; rows of one doc_id with one text are one document."""

    def near(x, y):
        if abs(len(x) - len(y)) > 1:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) <= 1
        x, y = sorted((x, y), key=len)
        return any(x == y[:k] + y[k + 1 :] for k in range(len(y)))

    seen: list[tuple[tuple, list[bytes]]] = []
    done: dict = {}
    for doc, text in sorted({r for r in rows if None not in r}):
        for k, line in enumerate(text.split("\n")):
            w = line.encode().lower().split()
            if len(w) >= min_words:
                seen.append(((doc, k), w))
    seen.sort(key=lambda x: x[0])
    for i, (at, w) in enumerate(seen):
        for before, v in seen[:i]:
            if before < at and (v == w or min(len(v), len(w)) >= near_words and near(v, w)):
                done.setdefault((at, tuple(w)), True)
                break
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, 0, 0, None))
            continue
        lines = text.split("\n")
        kept = [x for k, x in enumerate(lines) if doc is None or ((doc, k), tuple(x.encode().lower().split())) not in done]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def op10(rows, benchmark, n=10):
    norm = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    get = lambda t: norm.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple, set] = {}
    for item, text in benchmark:
        w = get(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add("" if item is None else str(item))
    lengths = sorted({len(k) for k in windows})
    out = []
    for doc, text in rows:
        w, hit, items = get(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if found := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def base_secrets(text):
    out = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, e, k in sorted(out)]


def base_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        if 16 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in double) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def op8_kept(rows):
    """Which documents the label model keeps: its rules and its expectation-maximisation, in numpy over documents instead of patterns."""
    import numpy as np

    votes, base = [], []
    for _, text in rows:
        t, w = text or "", words(text)
        n, chars, symbols, dup, repeat, failed = op8(text)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        closed = sum(x.rstrip(" ")[-1:] in tuple('.!?:"”»…)') for x in lines)
        letterless = sum(not any(c.isascii() and c.isalpha() or ord(c) >= 128 for c in x) for x in w)
        upper = len(re.findall("[A-ZÀ-ÖØ-Þ]", t))
        rules = [
            (symbols >= 0.3 * n, symbols <= 0.05 * n), (chars < 3 * n or chars > 7.5 * n, 3.8 * n <= chars <= 6.8 * n), (letterless > 0.2 * n, letterless <= 0.05 * n), (closed < 0.3 * len(lines), closed >= 0.7 * len(lines)),
            (dup > 0.4 * len(lines), dup <= 0.1 * len(lines)), (repeat > 0.3 * n, repeat <= 0.1 * n), (upper > 0.5 * chars, upper <= 0.2 * chars),
        ]
        votes.append([2 if bad else 1 if good else 0 for bad, good in rules])
        base.append(not failed)
    v, ok = np.array(votes), np.array(base)
    if not ok.any():
        return [False] * len(rows)
    x = v[ok]
    bad = np.where((x == 2).any(axis=1), 0.9, 0.05)

    def odds(y):
        total = np.full(len(y), np.log((bad.sum() + 1) / ((1 - bad).sum() + 9)))
        for j in range(x.shape[1]):
            as_bad = np.array([2.0, 4.0, 2.0]) + [(bad * (x[:, j] == k)).sum() for k in range(3)]
            as_good = np.array([2.0, 8.0, 0.5]) + [((1 - bad) * (x[:, j] == k)).sum() for k in range(3)]
            total += np.log(as_bad / as_bad.sum())[y[:, j]] - np.log(as_good / as_good.sum())[y[:, j]]
        return total

    for _ in range(299):
        bad = 1 / (1 + np.exp(np.clip(odds(x), -500, 500) * -1))
    return (ok & (odds(v) <= 0)).tolist()
