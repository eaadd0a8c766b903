"""Exact repeated windows over a corpus, shared by the two repeat removers.

A window is ``width`` consecutive units (words or bytes) of one document. The
windows of a document are cut into runs that share a minimiser: the leftmost
smallest hash among the m-grams of a window. Equal windows have equal minimisers
at the same place, so a run travels to its minimiser's bucket as one packed
string (a run of n windows is n + width - 1 units long) and no window is missed.

1. ``anchors``: (document, minimiser hash, first window, place of the minimiser,
   number of windows).
2. A hash that occurs once in the corpus has no repeated window; those runs, the
   great majority, never travel as text.
3. ``packed_runs``: the remaining runs are cut out of their texts. Each task sorts
   them and combines equal ones before anything is sent, so a passage in a third
   of all documents leaves a task once. Sorted runs are front-coded: an entry
   holds the length it shares with the entry before it and the rest.
4. Runs are sent to ranges of hashes, as many as keep a range at ``RANGE_BYTES``,
   and merged there.
5. Within a hash, ``rule`` says which windows count and how they are found. "any":
   the same window starts anywhere else; a run is packed as its text, its windows
   are sorted and neighbours counted. "earlier": it also starts earlier (smaller
   id, or same document before); a run is packed as the suffix that starts at its
   minimiser, then what stands before that, backwards. A window that reaches back
   a places from the minimiser is the same in two runs if their suffixes share
   width - a places or more, which the merge has told, and their backward texts a.
6. Hashes of more than ``HOT`` runs do not go to one task: after the combining
   in (3) their windows are grouped by content in the DataFrame engine.

Rows with the same id and text are one document here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize
from .words import map_arrow, text_or_empty

#: Runs of one minimiser that a task compares by itself.
HOT = 50_000
#: Packed bytes that a task holds before it writes a sorted run.
RUN_BYTES = 24_000_000
#: Packed bytes of a range that is merged at once.
RANGE_BYTES = 4_000_000
NULL_ID = -(1 << 63)
#: A run is one long: its first window, where its minimiser stands from there, and how many windows it has.
RUN = 8
#: Suffixes of one minimiser that are compared pair by pair; more are labelled level by level.
PAIRWISE = 24
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Units:
    """What a text is made of; positions count units."""

    def __init__(self, width: int, gram: int):
        if not gram <= width < gram + (1 << RUN) - 1 or width >= 1 << RUN or gram & (gram - 1):
            raise ValueError("gram must be a power of two, at most the width, and the width below 256")
        self.width, self.gram = width, gram

    def split(self, text: str):
        raise NotImplementedError

    def hashes(self, units) -> np.ndarray:
        raise NotImplementedError

    def pack(self, units, first: int, at: int, n: int) -> bytes:
        """The run of n windows from the first on, whose minimiser stands ``at`` places from there."""
        raise NotImplementedError

    def windows(self, packed: bytes) -> list[bytes]:
        raise NotImplementedError

    def count(self, packed: bytes) -> int:
        """How many windows a packed string has."""
        raise NotImplementedError


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_word_hash = _WordHash()


class Words(Units):
    def split(self, text: str) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").split()

    def hashes(self, units: list[bytes]) -> np.ndarray:
        return np.fromiter([_word_hash[w] for w in units], np.uint64, len(units))

    def pack(self, units: list[bytes], first: int, at: int, n: int) -> bytes:
        return b" ".join(units[first : first + n + self.width - 1])

    def windows(self, packed: bytes) -> list[bytes]:
        words = packed.split(b" ")
        return [b" ".join(words[i : i + self.width]) for i in range(len(words) - self.width + 1)]

    def count(self, packed: bytes) -> int:
        return packed.count(b" ") + 2 - self.width


@lru_cache(maxsize=1)
def _byte_hashes() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)


class Bytes(Units):
    def split(self, text: str) -> bytes:
        return text.encode("utf-8", "surrogatepass")

    def hashes(self, units: bytes) -> np.ndarray:
        return _byte_hashes()[np.frombuffer(units, np.uint8)]

    def pack(self, units: bytes, first: int, at: int, n: int) -> bytes:
        """The suffix from the minimiser on, what stands before it backwards, and the suffix's length."""
        suffix = units[first + at : first + n + self.width - 1]
        return suffix + units[first : first + at][::-1] + bytes([len(suffix)])

    def windows(self, packed: bytes) -> list[bytes]:
        text = packed[packed[-1] : -1][::-1] + packed[: packed[-1]]
        return [text[i : i + self.width] for i in range(len(text) - self.width + 1)]

    def count(self, packed: bytes) -> int:
        return len(packed) - self.width


def _gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` (a power of two) units, by doubling."""
    size, factor = 1, _MULTIPLY
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * factor + h[size:]
            factor = factor * factor + np.uint64(2)
            size *= 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


PLACE = 20


def _leftmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of w hashes, where its smallest stands.

    The place takes the low bits of the hash, so one running minimum finds both;
    of equal hashes the leftmost is smallest. Which gram wins depends on the
    window's content alone, wherever it stands. At most 2**PLACE hashes.
    """
    mask = np.uint64((1 << PLACE) - 1)
    least, size = (h & ~mask) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: size - w], least[w - size :])
    return (least & mask).astype(np.int64)


def placed_runs_of(units: Units, text: str, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows, place of the minimiser from the first window) of
    each run of a text, long texts in blocks."""
    parts = units.split(text)
    total = len(parts) - units.width + 1
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(total, 0), block):
        stop = min(at + block, total)
        grams = _gram_hashes(units.hashes(parts[at : stop + units.width - 1]), units.gram)
        anchor = _leftmost_least(grams, units.width - units.gram + 1)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        out.append((grams[anchor[first]].view(np.int64), first + at, np.diff(np.append(first, len(anchor))), anchor[first] - first))
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def runs_of(units: Units, text: str, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each run of a text."""
    return placed_runs_of(units, text, block)[:3]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text): the names under which rows are found again; a null id has a value of its own."""
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), text_or_empty(text_col).alias("text"))
    return named.select("id", F.xxhash64("text").alias("key"), "text")


def anchors(rows: DataFrame, units: Units) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids, keys, texts = batch.columns
            held, size = [], 0
            for i in range(batch.num_rows):
                h, first, n, place = placed_runs_of(units, texts[i].as_py())
                if len(h):
                    held.append((np.full(len(h), ids[i].as_py(), np.int64), np.full(len(h), keys[i].as_py(), np.int64), h, (first << RUN | place) << RUN | n))
                    size += len(h)
                if size > 100_000 or held and i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["id", "key", "hash", "run"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["id", "key", "hash", "run"])

    return rows.mapInArrow(run, "id long, key long, hash long, run long")


def shared_length(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are not looked at again."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    step = 8
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def front_code(entries: list[tuple]) -> bytes:
    """Sorted entries (string, id, key, first, multi) as one front-coded run."""
    shared, rest, before = [], [], b""
    for e in entries:
        n = shared_length(before, e[0])
        shared.append(n)
        rest.append(e[0][n:])
        before = e[0]
    head = np.array([(e[1], e[2], e[3], e[4]) for e in entries], np.int64)
    sizes = np.array([shared, [len(r) for r in rest]], np.uint32)
    return zstandard.compress(len(entries).to_bytes(4, "little") + head.tobytes() + sizes.tobytes() + b"".join(rest), 1)


class RunReader:
    """Reads a front-coded run; ``shared`` is what the string has in common with the one before."""

    def __init__(self, packed: bytes):
        blob = zstandard.decompress(packed)
        n = int.from_bytes(blob[:4], "little")
        self.head = np.frombuffer(blob, np.int64, 4 * n, 4).reshape(n, 4)
        self.sizes = np.frombuffer(blob, np.uint32, 2 * n, 4 + 32 * n).reshape(2, n).tolist()
        self.blob, self.at, self.i, self.n, self.string = blob, 4 + 40 * n, -1, n, b""

    def advance(self) -> bool:
        self.i += 1
        if self.i >= self.n:
            return False
        self.shared, size = self.sizes[0][self.i], self.sizes[1][self.i]
        self.string = self.string[: self.shared] + self.blob[self.at : self.at + size]
        self.at += size
        return True

    def meta(self) -> list[int]:
        return self.head[self.i].tolist()


def loser_tree_merge(blobs: list[bytes]) -> Iterator[tuple[bytes, list[int], int]]:
    """(string, meta, length shared with the string before) over all runs, sorted.

    A loser tree whose nodes hold, with each loser, the length that it shares
    with the winner that beat it. That winner is the last output whenever the
    loser is met again, so of two candidates the one that shares more with the
    last output is the smaller, and only candidates that share the same length
    are compared, from there on: no known prefix is looked at twice.
    """
    runs = [RunReader(b) for b in blobs]
    live = [r.advance() for r in runs]
    width = 1
    while width < len(runs):
        width *= 2
    loser: list[int] = [-1] * width
    common = [0] * len(runs)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets what the loser shares with the winner."""
        if a < 0 or not live[a]:
            return b, a
        if b < 0 or not live[b]:
            return a, b
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        x, y = runs[a].string, runs[b].string
        n = shared_length(x, y, common[a])
        less = len(x) <= len(y) if n == min(len(x), len(y)) else x[n] < y[n]
        if less:
            common[b] = n
            return a, b
        common[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= width:
            return node - width if node - width < len(runs) else -1
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    champion = build(1)
    while champion >= 0 and live[champion]:
        run = runs[champion]
        yield run.string, run.meta(), common[champion]
        live[champion] = run.advance()
        if live[champion]:
            common[champion] = run.shared
        node = (champion + width) // 2
        while node:
            champion, loser[node] = play(champion, loser[node])
            node //= 2


def sort_merge(blobs: list[bytes]) -> Iterator[tuple[bytes, list[int], int]]:
    """The same by one sort of all entries."""
    entries = []
    for b in blobs:
        r = RunReader(b)
        while r.advance():
            entries.append((r.string, r.meta()))
    entries.sort(key=lambda e: e[0])
    before = b""
    for string, meta in entries:
        yield string, meta, len(string) if string == before else 0
        before = string


RUN_SCHEMA = "kind int, target long, id long, key long, first long, stop long, blob binary"


def _span(id_: int, key: int, first: int, stop: int) -> dict:
    return {"kind": 0, "target": 0, "id": id_, "key": key, "first": first, "stop": stop, "blob": None}


def _range_of(string: bytes, bits: int) -> int:
    return int.from_bytes(string[:8], "big") >> (64 - bits)


def packed_runs(suspects: DataFrame, units: Units, rule: str, bits: int) -> DataFrame:
    """From (id, key, text, marks): kind 0, windows settled in this task; kind 1, a
    front-coded sorted run for a range of hashes; kind 2, a window of a hot hash."""

    def flush(held: dict[bytes, list]) -> Iterator[dict]:
        order = sorted(held)
        at = 0
        while at < len(order):
            target = _range_of(order[at], bits)
            stop = at
            chosen = []
            while stop < len(order) and _range_of(order[stop], bits) == target:
                s = order[stop]
                e = held[s]
                if e[4]:
                    for j, w in enumerate(units.windows(s[8:])):
                        yield {"kind": 2, "target": 0, "id": e[0], "key": e[1], "first": e[2] + j, "stop": e[3], "blob": w}
                else:
                    chosen.append((s, *e[:4]))
                stop += 1
            if chosen:
                yield {"kind": 1, "target": target, "id": 0, "key": 0, "first": 0, "stop": 0, "blob": front_code(chosen)}
            at = stop

    def rows(it: Iterator[dict]) -> Iterator[dict]:
        held: dict[bytes, list] = {}
        size = 0
        for r in it:
            parts = units.split(r["text"])
            for m in r["marks"]:
                first, place, n = m["run"] >> 2 * RUN, m["run"] >> RUN & (1 << RUN) - 1, m["run"] & (1 << RUN) - 1
                s = (m["hash"] + (1 << 63)).to_bytes(8, "big") + units.pack(parts, first, place, n)
                e = held.get(s)
                if e is None:
                    held[s] = [r["id"], r["key"], first, 0, m["hot"]]
                    size += len(s) + 200
                elif rule == "any":
                    if not e[3]:
                        yield _span(e[0], e[1], e[2], e[2] + n)
                        e[3] = 1
                    yield _span(r["id"], r["key"], first, first + n)
                elif (r["id"], first) < (e[0], e[2]):
                    yield _span(e[0], e[1], e[2], e[2] + n)
                    e[:3] = r["id"], r["key"], first
                else:
                    yield _span(r["id"], r["key"], first, first + n)
            if size > RUN_BYTES:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    return map_arrow(suspects, rows, RUN_SCHEMA, flush=2048)


def _spans_of(id_: int, key: int, first: int, places: list[int]) -> Iterator[dict]:
    """Spans of the windows at these places (sorted) of a run."""
    start = end = places[0]
    for j in places[1:]:
        if j > end + 1:
            yield _span(id_, key, first + start, first + end + 1)
            start = j
        end = max(end, j)
    yield _span(id_, key, first + start, first + end + 1)


def counted_windows(group: list[list], units: Units) -> Iterator[dict]:
    """The windows of one hash that are found twice or more. group: [string, shared,
    id, key, first, multi], one for each task's copy of each string, equal strings
    adjacent; multi: its task has told all its windows already."""
    distinct: list[list] = []
    at = 0
    while at < len(group):
        stop = at + 1
        while stop < len(group) and group[stop][0] == group[at][0]:
            stop += 1
        string, _, id_, key, first, multi = group[at]
        if stop > at + 1:
            n = units.count(string)
            for e in group[at:stop]:
                if not e[5]:
                    yield _span(e[2], e[3], e[4], e[4] + n)
            multi = True
        distinct.append([string, id_, key, first, multi])
        at = stop
    if len(distinct) < 2:
        return
    windows = sorted((w, d, j) for d, e in enumerate(distinct) for j, w in enumerate(units.windows(e[0])))
    hit: dict[int, list[int]] = {}
    for i, (w, d, j) in enumerate(windows):
        if i and windows[i - 1][0] == w or i + 1 < len(windows) and windows[i + 1][0] == w:
            hit.setdefault(d, []).append(j)
    for d, places in hit.items():
        _, id_, key, first, multi = distinct[d]
        if not multi:
            yield from _spans_of(id_, key, first, sorted(places))


def earlier_windows(group: list[list], units: Units, pairwise: int = PAIRWISE) -> Iterator[dict]:
    """The windows of one hash that also start earlier. group: [string, shared, id, key,
    first, _] in the order of the strings; shared: bytes in common with the string
    before, as the merge knows them."""
    width = units.width
    # [bytes shared with the one before, suffix length, backward text, id, key, first]
    distinct: list[list] = []
    for string, shared, id_, key, first, _ in group:
        if distinct and shared == len(string) == distinct[-1][6]:
            n, e = units.count(string), distinct[-1]
            if (id_, first) < (e[3], e[5]):
                yield _span(e[3], e[4], e[5], e[5] + n)
                e[3:6] = id_, key, first
            else:
                yield _span(id_, key, first, first + n)
        else:
            distinct.append([shared, string[-1], string[string[-1] : -1], id_, key, first, len(string)])
    if len(distinct) < 2:
        return
    found = _by_pairs(distinct, width) if len(distinct) <= pairwise else _by_levels(distinct, width)
    for i, backs in found.items():
        _, _, back, id_, key, first, _ = distinct[i]
        yield from _spans_of(id_, key, first, sorted(len(back) - a for a in backs))


def _by_pairs(distinct: list[list], width: int) -> dict[int, set[int]]:
    """For each suffix, how far back its windows reach that an earlier one has too.

    What two suffixes share is the least that neighbours between them share.
    """
    out: dict[int, set[int]] = {}
    for i, (_, size, back, id_, _, first, _) in enumerate(distinct):
        common = size
        for j in range(i + 1, len(distinct)):
            shared, size2, back2, id2, _, first2, _ = distinct[j]
            common = min(common, shared)
            reach = min(len(back), len(back2))
            if width - common > max(len(back), reach):
                break
            least = width - min(common, size2)
            if least <= reach:
                most = min(reach, shared_length(back, back2))
                if least <= most:
                    out.setdefault(j if (id_, first) < (id2, first2) else i, set()).update(range(least, most + 1))
    return out


def _by_levels(distinct: list[list], width: int) -> dict[int, set[int]]:
    """The same for many suffixes. At each reach, runs of neighbours that share enough
    forward get one label and runs that share enough backward another; windows are
    the same if both labels are."""
    m = len(distinct)
    size = np.array([e[1] for e in distinct])
    back = np.array([len(e[2]) for e in distinct])
    forward = np.array([e[0] for e in distinct])
    order = sorted(range(m), key=lambda i: distinct[i][2])
    backward = np.array([0, *(shared_length(distinct[a][2], distinct[b][2]) for a, b in zip(order, order[1:]))])
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    when = np.empty(m, np.int64)
    when[sorted(range(m), key=lambda i: (distinct[i][3], distinct[i][5]))] = np.arange(m)
    out: dict[int, set[int]] = {}
    for a in range(int(back.max()) + 1):
        have = np.flatnonzero((back >= a) & (size >= width - a))
        if len(have) < 2:
            continue
        label = np.cumsum(forward < width - a)[have] * (m + 1) + np.cumsum(backward < a)[place[have]]
        by = np.lexsort((when[have], label))
        later = have[by[1:][label[by][1:] == label[by][:-1]]]
        for i in later.tolist():
            out.setdefault(i, set()).add(a)
    return out


def merged_spans(runs: DataFrame, units: Units, rule: str, merge) -> DataFrame:
    """Merge each range's runs and settle its hashes."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    decide = counted_windows if rule == "any" else earlier_windows

    def settle(blobs: list[bytes]) -> Iterator[dict]:
        group: list[list] = []
        now = b""
        for string, meta, shared in merge(blobs):
            if string[:8] != now:
                if len(group) > 1:
                    yield from decide(group, units)
                group, now = [], string[:8]
            group.append([string[8:], max(0, shared - 8), *meta])
        if len(group) > 1:
            yield from decide(group, units)

    def rows(it: Iterator[dict]) -> Iterator[dict]:
        target, blobs = None, []
        for r in it:
            if r["target"] != target:
                if blobs:
                    yield from settle(blobs)
                target, blobs = r["target"], []
            blobs.append(r["blob"])
        if blobs:
            yield from settle(blobs)

    dealt = runs.filter("kind = 1").select("target", "blob").repartition(parts, "target").sortWithinPartitions("target")
    return map_arrow(dealt, rows, RUN_SCHEMA)


def hot_spans(runs: DataFrame, rule: str) -> DataFrame:
    """Windows of hot hashes, grouped by content; partial sums come first and a
    join that has one key in many rows may be split."""
    windows = runs.filter("kind = 2").select("blob", "id", "key", "first", F.col("stop").alias("multi"))
    least = windows.groupBy("blob").agg(F.min(F.struct("id", "first")).alias("least"), (F.count(F.lit(1)) + F.max("multi")).alias("times"))
    # written first: a join of two plain shuffles may be split where one window is in many rows
    least = materialize(least.filter("times > 1"), "hot-windows")
    joined = windows.join(least.hint("merge"), "blob")
    if rule == "earlier":
        joined = joined.filter((F.col("id") != F.col("least.id")) | (F.col("first") != F.col("least.first")))
    return joined.select("id", "key", "first", (F.col("first") + 1).alias("stop"))


def repeated_spans(rows: DataFrame, units: Units, rule: str, merge=sort_merge, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): for documents with repeated windows, arrays of their spans
    [first, stop) of window starts, and the texts of all suspects, as
    (id, key, spans) and (id, key, text)."""
    all_runs = materialize(anchors(rows, units), "anchors")
    # each of these is written by itself: a finished shuffle then leaves the disk, and the
    # join reads two plain shuffles, so that a hash in many runs may be split
    twice = materialize(all_runs.groupBy("hash").count().filter("count > 1").select("hash", (F.col("count") > hot).alias("hot")), "twice")
    doubtful = materialize(all_runs.join(twice.hint("merge"), "hash"), "doubtful")
    discard(all_runs)
    suspects = doubtful.groupBy("id", "key").agg(F.collect_set(F.struct("hash", "run", "hot")).alias("marks"))
    texts = rows.join(suspects.hint("merge"), ["id", "key"]).dropDuplicates(["id", "key"])
    texts = materialize(texts.select("id", "key", "text", "marks"), "suspects")
    discard(doubtful)
    total = texts.agg(F.sum(F.size("marks"))).first()[0] or 0
    bits = max(2, (total * 200 // RANGE_BYTES).bit_length())
    any_hot = not twice.filter("hot").isEmpty()
    runs = materialize(packed_runs(texts, units, rule, bits), "runs")
    spans = runs.filter("kind = 0").select("id", "key", "first", "stop")
    spans = spans.union(merged_spans(runs, units, rule, merge).select("id", "key", "first", "stop"))
    if any_hot:
        spans = spans.union(hot_spans(runs, rule))
    spans = spans.groupBy("id", "key").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    spans = materialize(spans, "spans")
    discard(runs)
    return spans, texts.select("id", "key", "text")


def covered(spans: list[dict], width: int) -> list[tuple[int, int]]:
    """Maximal runs of units that repeated windows cover."""
    out: list[list[int]] = []
    for first, stop in sorted((s["first"], s["stop"] + width - 1) for s in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [(a, b) for a, b in out]
