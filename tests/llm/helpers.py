"""Tables for the tests of reachlab.llm, and brute-force versions of its operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, extra: str = ""):
    """Documents from (doc_id, text[, lang, source]); ``extra`` adds clashing columns, null."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a",
             None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCUMENT)
    for name in extra.split():
        from pyspark.sql import functions as F
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = words(fold(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_groups(docs: dict) -> dict:
    """doc_id -> (set size, component) by comparing every pair that shares a shingle."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    both = Counter((min(a, b), max(a, b)) for m in by.values() for k, a in enumerate(m) for b in m[k + 1:])
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in docs}


def quality_base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    n_dup, seen = 0, set()
    for x in lines:
        n_dup += x in seen
        seen.add(x)
    return dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(c in "#*$%&|<>" for c in text or ""),
                n_dup_lines=n_dup, n_repeat_words=len(covered),
                base_failed=len(w) < 50 or 100 * len(covered) > 50 * len(w))


def line_windows(docs: list) -> dict:
    """(doc_id, text) -> text without the lines of later windows; first by (doc_id, place)."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        lines = text.split("\n")
        at = [i for i, x in enumerate(lines) if words(x)]
        gone = set()
        for k in range(len(at) - 2):
            key = tuple(lines[i] for i in at[k:k + 3])
            if key in seen:
                gone.update(at[k:k + 3])
            seen.add(key)
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def water_fill(sizes: dict) -> dict:
    """source -> target; sources by code point, null last, weigh 1, 2, 3, repeating."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over
