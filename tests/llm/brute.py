"""Plain Python versions of the operators, and the small awkward table they are tried on."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, label int, h double, key string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def fold(doc_id, modulus):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % modulus


def awkward(spark, long_words=30_000):
    """Nulls, empties, ties, repeated rows, a very long text, and extra columns whose names the operators use themselves."""
    passage = " ".join(f"word{i} thing{i * 7 % 13}" for i in range(40))
    rows = [
        (1, "", "en"), (2, None, "en"), (3, "   \n\t ", None), (4, passage, "en"), (5, passage, None), (5, passage, None),
        (6, passage + " tail end of it", "en"), (7, "short one", "en"), (8, "short one", "en"), (9, "x", "en"), (None, passage, "en"),
        (10, "a " * long_words, "en"), (11, " ".join(f"w{i * i % 9973}" for i in range(long_words)), "en"), (12, "é" * 300, "fr"),
        (13, "Mail bob@example.com, call +1 (555) 123-4567 or 10.0.0.256 and 10.0.0.25; card 4111 1111 1111 1111 not 4111111111111112", "en"),
        (14, "ids <|endoftext|> here  don't\r\n stop ▁▁ 日本語 🙂", "en"), (15, "!!! 123 ???", None), (16, "0" * 5000 + "@" + "1." * 500, None),
    ]
    return spark.createDataFrame([(i, t, g, "src", None, "x", k, 0.5, "k") for k, (i, t, g) in enumerate(rows)], SCHEMA)


def repeats(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} for distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone, new = bytearray(len(raw)), []
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            if s in seen:
                gone[i:i + length] = b"\1" * length
            else:
                seen.add(s)
                new.append(s)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out[doc_id] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def shingles(text, width=5):
    w = re.findall("[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(sets, percent):
    """{key: smallest key reachable}, links by shared shingles."""
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where = defaultdict(list)
    for k in sorted(sets):
        both = Counter(j for s in sets[k] for j in where[s])
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                a, b = sorted((find(j), find(k)))
                root[b] = a
        for s in sets[k]:
            where[s].append(k)
    return {k: find(k) for k in sets}


def contamination(text, items, width=10):
    words = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for name, item in items:
        w = words(item)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i:i + width])].add(str(name))
    w = words(text)
    hit, found = [0] * len(w), set()
    for size in {len(k) for k in windows}:
        for i in range(len(w) - size + 1):
            if tuple(w[i:i + size]) in windows:
                found |= windows[tuple(w[i:i + size])]
                hit[i:i + size] = [1] * size
    return len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0


PERSONAL = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def personal(text):
    """Base spans as (start, rank, stop, kind), in order."""
    out = []
    for rank, (kind, pattern) in enumerate(PERSONAL):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(d) <= 19 and total % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)
