"""Plain-Python versions of operators, written from their descriptions, to compare results with."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

from gneiss.llm import licences, lines


def drop_templates(texts):
    """The texts without recurring lines."""
    variable = re.compile(r'(?<!\S)(?=\S*[\d@"])\S+', re.ASCII)

    def form(line):
        out = variable.sub("<*>", line)
        return re.sub(r"\s+", " ", out, flags=re.ASCII).strip(" ") if re.search(r"  |[\t\f\r\x0b]", out) else out.strip(" ")

    split = {t: [(line, form(line) if re.search(r"\S", line, re.ASCII) else None) for line in t.split("\n")] for t in {t for t in texts if t is not None}}
    where, leaves = defaultdict(set), defaultdict(set)
    for t, rows in split.items():
        for _, f in rows:
            if f is not None:
                where[f].add(t)
                if len(tokens := f.split(" ")) >= lines.MIN_TOKENS:
                    leaves[len(tokens), *tokens[: lines.LEAD]].add(f)
    general = defaultdict(set)
    for members in leaves.values():
        if len(members) < lines.MIN_TEXTS:
            continue
        seen = Counter((i, tok) for f in members for i, tok in enumerate(f.split(" ")))
        for f in members:
            tokens = f.split(" ")
            kept = [tok if seen[i, tok] >= lines.MIN_TEXTS else "<*>" for i, tok in enumerate(tokens)]
            n = sum(seen[i, tok] >= lines.MIN_TEXTS for i, tok in enumerate(tokens))
            if n < len(tokens) and n >= len(tokens) * lines.KEPT:
                general[" ".join(kept)].add(f)
    bad = {f for f, at in where.items() if len(at) >= lines.MIN_TEXTS}
    for members in general.values():
        if len(set().union(*(where[f] for f in members))) >= lines.MIN_TEXTS:
            bad |= members
    return [None if t is None else "\n".join(line for line, f in split[t] if f is None or f not in bad) for t in texts]


def licence_of(text, notices, full):
    """(licence, score, file) of a text, every unit compared with every template."""

    def vectors(templates):
        templates = sorted(templates)
        counts = [Counter(licences.words(t)) for _, t in templates]
        df = Counter(w for c in counts for w in c)
        idf = defaultdict(lambda: math.log(1.0 + len(templates)) + 1, {w: math.log((1.0 + len(templates)) / (n + 1)) + 1 for w, n in df.items()})
        weigh = lambda c: {w: (math.log(n) + 1) * idf[w] for w, n in c.items()}
        return [(name, weigh(c)) for (name, _), c in zip(templates, counts, strict=True)], weigh

    units = text.split("\n") + [p for p in re.split(r"\n[ \t\n\x0b\f\r]*\n", text) if "\n" in p] + [text]
    found = []
    for k, unit in enumerate(units):
        for templates, least, from_line in ((notices, licences.HEADER, True), (full, licences.FULL, False)):
            if not from_line and k < text.count("\n") + 1:
                continue
            rows, weigh = templates
            v = weigh(Counter(licences.words(unit)))
            norm = math.sqrt(sum(x * x for x in v.values()))
            best = (0.0, "")
            for name, t in rows:
                cos = round(sum(x * t.get(w, 0.0) for w, x in v.items()) / (norm * math.sqrt(sum(x * x for x in t.values()))), 6) if norm else 0.0
                if cos > best[0] + 1e-9:
                    best = (cos, name)
            if best[0] >= least:
                found.append((best[1] != "proprietary", k == len(units) - 1, best[0], -k, best[1]))
    return None if not found else (max(found)[4], max(found)[2], any(f[1] for f in found)), vectors


def scan(rows):
    """rid -> (licence, how, from_path) of rows(rid, path, text)."""
    vectors = licence_of("", ([], lambda c: {}), ([], lambda c: {}))[1]
    notices, full = vectors(licences.TEMPLATES), vectors(licences.full_texts())
    own = {rid: licence_of(text or "", notices, full)[0] for rid, _, text in rows}
    of_dir = {}
    parent = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""
    for rid, path, _ in rows:
        if path is not None and own[rid] and own[rid][2]:
            of_dir[parent(path)] = min(of_dir.get(parent(path), (9, "", "")), (-own[rid][1], path, own[rid][0]))
    out = {}
    for rid, path, _ in rows:
        if own[rid]:
            out[rid] = (own[rid][0], "file" if own[rid][2] else "header", None)
            continue
        out[rid], d = (None, "none", None), None if path is None else parent(path)
        while d is not None:
            if d in of_dir:
                out[rid] = (of_dir[d][2], "inherited", of_dir[d][1])
                break
            d = None if d == "" else parent(d)
    return out


def trigram_counts(text):
    """Counts of hashed trigrams, one character at a time."""
    from gneiss.llm.langid import FEATURES

    cps = [ord(c) if unicodedata.category(c)[0] in "LM" else 32 for c in (text or "").lower()]
    x = [c for i, c in enumerate(cps) if c != 32 or i == 0 or cps[i - 1] != 32]
    mask, out = 2**32 - 1, Counter()
    for i, c in enumerate(x):
        if c != 32:
            before, after = x[i - 1] if i else 32, x[i + 1] if i + 1 < len(x) else 32
            h = (((before * 2654435761 + c) & mask) * 2246822519 + after) & mask
            h = h * 3266489917 & mask
            h ^= h >> 15
            h = h * 2654435761 & mask
            out[h >> (32 - FEATURES.bit_length() + 1)] += 1
    return out, any(unicodedata.category(c)[0] == "L" for c in (text or "").lower())


def predict(model, text):
    """(label, score, rejected) by plain sums."""
    counts, letters = trigram_counts(text)
    if not letters or not model.labels:
        return "und", 0.0, True
    w = {k: (math.log(n) + 1) * float(model.idf[k]) for k, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    cos = [sum(x * float(c[k]) for k, x in w.items()) / norm for c in model.centroids]
    best = max(range(len(cos)), key=lambda i: (round(cos[i], 5), -i))
    chance = sum(w.values()) / norm * float(model.centroids[best].mean())
    return model.labels[model.owner[best]], min(max(cos[best], 0.0), 1.0), 1 - (cos[best] - chance) > model.radius[best]
