"""Plain versions of the corpus operators, and small tables with everything that may go wrong."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LAST = 2**63 - 1
COLUMNS = "doc_id bigint, text string, id string, copy int, rest string, found string, n double, a string, w int, keep string"


def odd_rows():
    """Documents with nulls, empty and long texts, repeats and ties."""
    line = "The same line stands in many documents of this table."
    long = " ".join(f"word{k % 997}" for k in range(6000))
    rows = [(i, f"{line}\nown words of {i} and more of {i * 7}\n  {line.upper()} ") for i in range(12)]
    rows += [(20, None), (21, ""), (22, " \n\t "), (23, long), (24, long + " tail"), (None, "no id at all"), (None, line), (3, rows[3][1])]
    rows += [(30, "x" * 30_000), (31, "a b c"), (32, "A  b\nC"), (33, "\x85nel nbsp em \x1cfs")]
    return rows


def table(spark, rows):
    """``rows`` of (doc_id, text) with further columns whose names the operators might use themselves."""
    full = [(i, t, "x", 1, None, "f", 0.5, None, 2, "k") for i, t in rows]
    return spark.createDataFrame(full, COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def blank_split(text):
    return [w.decode() for w in (text or "").encode().split()]


def ascii_lower(text):
    return (text or "").encode().lower().decode()


def key(doc_id):
    return LAST if doc_id is None else doc_id


def line_dedup(rows, min_docs=10, keep_first=False):
    places = defaultdict(set)
    norm = lambda line: line.encode().strip().lower()
    order = sorted({(i is not None, i if i is not None else 0, t or "") for i, t in rows})
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            places[norm(line)].add(i)
    for has, i, t in order:
        for k, line in enumerate(t.split("\n")):
            first.setdefault(norm(line), (i if has else None, k))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [bool(norm(x)) and len(places[norm(x)]) >= min_docs and not (keep_first and first[norm(x)] == (i, k)) for k, x in enumerate(lines)]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


def drop_repeats(rows, window):
    least, texts = {}, [blank_split(t) for _, t in rows]
    for (i, _), w in zip(rows, texts):
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, LAST), key(i))
    out = []
    for (i, _), w in zip(rows, texts):
        hit = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < key(i):
                hit |= set(range(k, k + window))
        out.append((i, len(w), len(hit), " ".join(x for j, x in enumerate(w) if j not in hit)))
    return out


def near(rows, words=4, similarity=85):
    sets = []
    for _, t in rows:
        w = blank_split(ascii_lower(t))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= similarity * (len(sets[x]) + len(sets[y]) - both):
                parent[root(x)] = root(y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), LAST), key(i))
    named = lambda k: None if least[root(k)] == LAST else least[root(k)]
    return [(i, len(sets[k]), named(k) if sets[k] else i) for k, (i, _) in enumerate(rows)]


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(rows, items, window=13):
    windows = defaultdict(set)
    for name, t in items:
        w = ITEM_WORD.findall(ascii_lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(str(name))
    sizes, out = {len(w) for w in windows}, []
    for i, t in rows:
        w, hit, found = ITEM_WORD.findall(ascii_lower(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    found |= names
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            found = m.group()
            digits = re.sub("[^0-9]", "", found)
            if kind == "ip" and any(int(p) > 255 for p in found.split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def counts(text):
    text = text or ""
    w = blank_split(text)
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if blank_split(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed
