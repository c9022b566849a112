"""Plain-Python forms of the matching rules, for comparison on small tables."""

from __future__ import annotations

from collections import Counter, defaultdict
from math import sqrt

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())


def clean(s):
    return s.replace(" ", "").replace("　", "")


def stored(s, market):
    return clean(s) if market == "Japan" else s.replace(" ", "")


def hard(keywords, log):
    """(theme_pos, kw_pos, id, relevance) of every substring hit."""
    out = []
    for theme_pos, _, market, kw_pos, keyword in keywords:
        wanted = clean(keyword)
        if not wanted:
            continue
        for row_id, query, _, _, _, log_market in log:
            if market == log_market and wanted.translate(FOLD) in stored(query, market).translate(FOLD):
                whole = len(clean(query))
                value = len(wanted) / max(whole, len(wanted)) if whole else 0.0
                out.append((theme_pos, kw_pos, row_id, round(value, 9)))
    return sorted(out)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def grams(s):
    text = "  " + clean(s) + " "
    return Counter(text[i : i + 3] for i in range(len(text) - 2))


def gram_near(keywords, log, k, floor):
    """(theme_pos, kw_pos, id, similarity) of the k nearest rows at or above the floor."""
    out = []
    for theme_pos, _, market, kw_pos, keyword in keywords:
        if not clean(keyword):
            continue
        left = grams(keyword)
        scored = []
        for row_id, query, _, _, _, log_market in log:
            if market != log_market:
                continue
            right = grams(query)
            dot = sum(c * right[g] for g, c in left.items())
            norms = sum(c * c for c in left.values()) * sum(c * c for c in right.values())
            sim = round(dot / sqrt(norms), 9)
            if dot and sim >= floor:
                scored.append((-sim, row_id))
        out += [(theme_pos, kw_pos, i, -s) for s, i in sorted(scored)[:k]]
    return sorted(out)


def merge(hits):
    """Merged rows of hit dicts, visited in keyword order with substring hits first."""
    rows = {}
    order = {"hard": 0, "vector": 1}
    for h in sorted(hits, key=lambda h: (h["theme_pos"], h["kw_pos"], order[h["method"]], h["id"])):
        row = rows.setdefault(
            (h["theme_pos"], h["normalized_query"]),
            {"hard": 0, "vector": 0, "relevance": 0.0, "keyword": h["keyword"]},
        )
        if len(h["keyword"]) < len(row["keyword"]):
            row["keyword"] = h["keyword"]
        row[h["method"]] = 2 if h["method"] == "hard" else 1
        row["relevance"] = max(row["relevance"], h["relevance"])
    first = defaultdict(lambda: (float("inf"), None))
    for h in hits:
        key = (h["theme_pos"], h["normalized_query"])
        first[key] = min(first[key], (h["id"], h["SRPV"]))
    return {
        k: (v["hard"] + v["vector"], round(v["relevance"], 9), v["keyword"], first[k][1])
        for k, v in rows.items()
    }
