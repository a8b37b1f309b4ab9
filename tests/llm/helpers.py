"""Corpora with planted cases and plain Python versions of the operators."""

import hashlib
import random
import re
from collections import defaultdict

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state people too good world".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile("[^\\x20\\x09-\\x0D]+")
ALNUM = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ß", "é"]) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text): prose, near and exact copies, shared passages, odd white space, nulls, empty and short texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([3, 20, 80, 200])) for _ in range(n)]
    passage, line = prose(rng, 90), prose(rng, 12)
    for i in range(0, n, 4):
        words = texts[i].split()
        at = rng.randrange(len(words) + 1)
        texts[i] = " ".join(words[:at] + passage.split()[rng.randrange(20) :] + words[at:])
    for i in range(1, n, 5):
        texts[i] = line + " " + texts[i] + "\n" + line
    for i in range(2, n, 6):
        words = texts[rng.randrange(n)].split()
        for _ in range(1 + len(words) // 60):
            words[rng.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    for i in range(3, n, 9):
        texts[i] = texts[rng.randrange(n)]
    texts[5:5] = [None, "", "   \n\t ", "One", "one", "ONE  two\tthree", None, "one two three", " x y", texts[0].upper(), "   " + texts[0].replace(" ", "\t "), passage + " " + passage, (line + " ") * 30]
    return list(enumerate(texts))


def frame(spark, rows, parts=3):
    """A documents table of (doc_id, text)."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    words = SPACE.findall(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def near(rows, k, percent):
    """{doc_id: (n_shingles, component_id, kept)} by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def word_repeats(rows, span=50):
    """{doc_id: (n_words, n_removed, sha, kept text)}"""
    first, out = {}, {}
    texts = {i: SPACE.findall(t or "") for i, t in rows}
    for i in sorted(texts):
        for s in range(len(texts[i]) - span + 1):
            first.setdefault(tuple(texts[i][s : s + span]), i)
    for i, words in texts.items():
        gone = set()
        for s in range(len(words) - span + 1):
            if first[tuple(words[s : s + span])] < i:
                gone.update(range(s, s + span))
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def byte_repeats(rows, span=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)}"""
    first, out = {}, {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(texts):
        for s in range(len(texts[i]) - span + 1):
            first.setdefault(texts[i][s : s + span], i)
    for i, raw in texts.items():
        gone = bytearray(len(raw) + 1)
        for s in range(len(raw) - span + 1):
            if first[raw[s : s + span]] < i:
                gone[s : s + span] = b"\1" * span
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(raw)))
        kept = bytes(b for j, b in enumerate(raw) if not gone[j])
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def contamination(rows, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)}"""
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(lower(text))
        n = min(window, len(words))
        for s in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[s : s + n])].add(item)
    sizes, out = {len(w) for w in windows}, {}
    for i, text in rows:
        words, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in sizes:
            for s in range(len(words) - n + 1):
                if at := windows.get(tuple(words[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= at
        names = ",".join(sorted(map(str, found)))
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out
