"""Plain Python models of stages, without Spark, for tests to compare with."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from tessera.llm import quality, secrets
from tessera.llm.regression import fit_logistic


def grams(text):
    """Buckets of a text's byte trigrams and of its words' repeats, one by one."""
    data, out = b" " + (text or "").encode() + b" ", []
    for x, y, z in zip(data, data[1:], data[2:]):
        out.append((x * 0x9E3779B1 + y * 0x85EBCA6B + z * 0xC2B2AE35) % (1 << 32) >> (32 - quality.BITS))
    words = (text or "").encode().split()
    for k, w in enumerate(words):
        out.append(quality.GRAMS + next((lag for lag in (1, 2, 3) if k >= lag and words[k - lag] == w), 0))
    return out


def resampled(listed, marks):
    """``(id, text, weight, key)`` of the rows that importance resampling draws; ``marks`` are (id, quality)."""
    part = lambda i: zlib.crc32(str(i).encode()) % 4
    texts = {}
    for i, t in listed:
        texts[i] = min(t or "", texts.get(i, t) or "")
    target, raw = Counter(), Counter(b for _, t in listed for b in grams(t))
    for i, q in marks:
        if q == 1 and i in texts and part(i) != 3:
            target.update(grams(texts[i]))
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + quality.PRIOR) / (n * share + quality.PRIOR)) for b, n in raw.items()}
    weigh = lambda t: sum(ratio[b] for b in grams(t))
    curved = [(math.asinh(weigh(texts[i])), float(q)) for i, q in sorted(marks) if i in texts and part(i) == 3]
    curve = fit_logistic(np.array([[x] for x, _ in curved]), np.array([q for _, q in curved]))
    seed, rows = xxhash.xxh64_intdigest((quality.SEED).to_bytes(4, "little"), 42), []
    for i, t in listed:
        h = seed if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed)
        u = ((h - (1 << 64) if h >> 63 else h) % (1 << 52) + 0.5) / (1 << 52)
        w = weigh(t)
        rows.append((i, t, w, w - math.log(-math.log(u))))
    rows.sort(key=lambda r: -r[3])
    k = round(sum(1 / (1 + math.exp(-(curve[0] * math.asinh(w) + curve[1]))) for _, _, w, _ in rows))
    return [r for r in rows if r[3] >= rows[k - 1][3] - 1e-9]


def first_of_near_copies(listed, least=0.8):
    """The ids that stay, one of each group of texts linked by the Jaccard index of five-word shingles; ids are unique."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for _, t in listed]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(listed)))
    for a in range(len(listed)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-9 and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    least_id = {}
    for (i, _), x in zip(listed, label):
        least_id[x] = min(i, least_id.get(x, i))
    return set(least_id.values())


def masked(text):
    """The text with base secrets and random strings, letters-only ones too, replaced."""
    if text is None:
        return None
    word = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    spans = [m.span() for m in re.finditer(word + "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    weights, n, at = secrets.model(), len(secrets.ALPHABET), secrets.ALPHABET.index
    base = list(spans)
    for m in re.finditer("[A-Za-z0-9+/_-]{16,}", text):
        ratio = sum(weights[at(a) * n + at(b)] for a, b in zip(m[0], m[0][1:]))
        each = secrets.LEAST_EACH if re.search("[0-9]", m[0]) else secrets.LETTERS_EACH
        if re.search("[A-Za-z]", m[0]) and ratio >= max(secrets.LEAST_TOTAL, len(m[0]) * each) and not any(a < m.end() and m.start() < b for a, b in base):
            spans.append(m.span())
    out, done = "", 0
    for a, b in sorted(spans):
        if a >= done:
            out += text[done:a] + "<secret>"
        done = max(done, b)
    return out + text[done:]
