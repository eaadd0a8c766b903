"""Plain single-machine versions of the operators, to hold results against.

Each takes rows (dicts of documents) and gives {doc_id: result} or rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[sha(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode())].append(r)
    out = []
    for digest, group in groups.items():
        keep = min(group, key=lambda r: (-len(r["text"] or ""), r["doc_id"]))
        for r in group:
            out.append((r["doc_id"], keep["doc_id"], len(group), r is keep, digest))
    return out


def substrings(rows, width=35):
    docs = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in rows]
    seen = Counter(tuple(w[i : i + width]) for _, w in docs for i in range(len(w) - width + 1))
    out = {}
    for doc_id, w in docs:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out[doc_id] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    return out


def suffixes(rows, width=100):
    docs = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in rows), key=lambda d: d[0])
    first, out = set(), {}
    for doc_id, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            s = hash(b[i : i + width]), b[i : i + 8], b[i + width - 8 : i + width]
            if s in first:
                gone[i : i + width] = b"\x01" * width
            first.add(s)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc_id] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def another(h, k):
    """The k-th further 64-bit hash made of a hash."""
    if not k:
        return h
    mask = (1 << 64) - 1
    h = (h + k * 0x9E3779B97F4A7C15) & mask
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & mask
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & mask
    return h ^ h >> 31


def simhash(text, width=4, k=0):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [another(xxhash.xxh64(s.encode(), seed=42).intdigest(), k) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows, distance=4, width=4, words=1):
    """{doc_id: (fingerprint, component)}, all pairs compared."""
    fps = [(r["doc_id"], sum(simhash(r["text"], width, k) << 64 * (words - 1 - k) for k in range(words))) for r in rows]
    root = {d: d for d, _ in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= distance:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (f"{x:0{16 * words}x}", find(d)) for d, x in fps}


def near_copies(rows):
    """The groups of the pipeline's stage: five words, 128 bits, 23 of them."""
    return near(rows, 23, 5, 2)


def quality_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def template_rejects(rows, share=0.1, least=20, words_left=50, share_left=0.3):
    """Ids that the line rule rejects."""
    hosts, lines = defaultdict(set), defaultdict(set)
    norm = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()
    first = {}
    for r in rows:
        hosts[r["source"]].add(r["text"] or "")
        for line in (r["text"] or "").split("\n"):
            if WORD.search(line):
                k = r["source"], norm(line)
                lines[k].add(r["text"] or "")
                first[k] = min(first.get(k, r["doc_id"]), r["doc_id"])
    out = set()
    for r in rows:
        total = gone = 0
        for line in (r["text"] or "").split("\n"):
            n = len(WORD.findall(line))
            total += n
            k = r["source"], norm(line)
            if n and len(lines[k]) > max(least, share * len(hosts[r["source"]])) and first[k] != r["doc_id"]:
                gone += n
        if gone and total - gone < words_left and total - gone < share_left * total:
            out.add(r["doc_id"])
    return out


def check_packing(rows, pieces, encode, capacity=2048):
    """Every id in exactly one piece, right digests, gapless sequences; the share of padding."""
    ids = {r["doc_id"]: [*encode(r["text"] or ""), 1] for r in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[d])
            part = ids[d][at : at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += p["length"]
        assert at == len(ids[d])
    padding = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(total, 1)
