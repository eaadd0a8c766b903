"""Byte-level BPE, compiled for counting and for ids.

The tokenizer file is a parameter; it is read where it is installed and never
copied. Text is cut into pieces by the vocabulary's pattern, a regular language,
and pieces are spelled by a deterministic transducer over bytes.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush
from functools import lru_cache

import numpy as np
import regex
import tiktoken
import xxhash

#: The byte-level pre-tokenizer's pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 400_000
NO_MERGE = (1 << 60, -1)


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class Vocabulary:
    """Tokens as bytes, merge ranks by pair of ids, and the special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without a normalizer or prefix space is needed")
        back = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if not (x["single_word"] or x["lstrip"] or x["rstrip"])}
        if len(self.special) != len(spec["added_tokens"]):
            raise ValueError("special tokens that strip or need word borders are not handled")
        self.ids = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.of = {i: t for t, i in self.ids.items()}
        self.byte = [self.ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def plain(self) -> bool:
        """Whether merging by the id of what comes out is the same as by the merge list.

        It is if ids grow along the list, no token comes out of two merges, and
        each token's own bytes spell just that token: then two neighbours whose
        bytes are a token's can only be the two of its merge, since inside a
        token's bytes the merges go as they do when it stands alone.
        """
        made = [new for _, new in self.merges.values()]
        return all(a < b for a, b in zip(made, made[1:])) and all(self.spell(t) == [i] for t, i in self.ids.items())

    def spell(self, piece: bytes) -> list[int]:
        """The ids of a piece: of all pairs that may merge, the lowest rank first, leftmost first.

        Short pieces are scanned for each merge; for long ones a heap of
        candidate merges over a linked list keeps the cost at n log n.
        """
        n = len(piece)
        ids = [self.byte[b] for b in piece]
        if n < 2:
            return ids
        merges = self.merges
        if n <= 24:
            ranks = [merges.get(p, NO_MERGE) for p in zip(ids, ids[1:])]
            while ranks:
                best = min(ranks)
                if best is NO_MERGE:
                    break
                i = ranks.index(best)
                ids[i : i + 2] = [best[1]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = merges.get((ids[i], ids[i + 1]), NO_MERGE)
                if i:
                    ranks[i - 1] = merges.get((ids[i - 1], ids[i]), NO_MERGE)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, a, b, new = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]


class Transducer:
    """The vocabulary's merges as a deterministic transducer over bytes.

    The ids of a text's prefix are those of a shorter prefix and one more token;
    which one is settled by the tokens that end here and whose neighbour they may
    follow (two tokens may be neighbours if spelling them together gives them
    back). A token that ends later can begin no earlier than the longest suffix
    read so far that starts some token. So a state is that suffix with, for each
    of its positions, the last token of the prefix ending there and its count
    against the count here. There are finitely many; those that texts reach are
    compiled when first met. A transition is annotated with the tokens that it
    adds (which may be negative: letters merge) and with the last token.
    """

    STATES = 600_000

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.starts = {t[:i] for t in vocab.ids for i in range(len(t))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple[bytes, tuple]] = []
        self.next: list[dict[int, tuple[int, int, int]]] = []
        self._state(b"", ((-1, 0),))

    def _state(self, window: bytes, before: tuple) -> int:
        key = (window, before)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
        return self.number[key]

    def _fit(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = self.vocab.spell(self.vocab.of[a] + self.vocab.of[b]) == [a, b]
        return self.fits[key]

    def step(self, state: int, byte: int) -> tuple[int, int, int]:
        """Compile one transition: (next state, tokens added, last token)."""
        window, before = self.states[state]
        text, ids = window + bytes([byte]), self.vocab.ids
        for at in range(len(text)):
            token = ids.get(text[at:])
            if token is not None and (before[at][0] < 0 or self._fit(before[at][0], token)):
                break
        added = before[at][1] + 1
        reached = (*((t, c - added) for t, c in before), (token, 0))
        cut = 0
        while text[cut:] not in self.starts:
            cut += 1
        out = (self._state(text[cut:], reached[cut:]), added, token)
        self.next[state][byte] = out
        return out

    def room(self) -> None:
        """Drop the compiled states if there are too many; numbers of states given out before are void then."""
        if len(self.states) > self.STATES:
            self.clear()

    def run(self, piece: bytes, state: int = 0) -> tuple[int, int]:
        """(state reached, tokens added) of reading a piece, or the rest of one, from a state."""
        total, table = 0, self.next
        for b in piece:
            state, added, _ = table[state].get(b) or self.step(state, b)
            total += added
        return state, total

    def key(self, state: int) -> str:
        """A name of a state that is the same in every process."""
        return xxhash.xxh3_128_hexdigest(repr(self.states[state]).encode())

    def count(self, piece: bytes) -> int:
        self.room()
        return self.run(piece)[1]

    def spell(self, piece: bytes) -> list[int]:
        self.room()
        state, last, table = 0, [], self.next
        for b in piece:
            state, _, token = table[state].get(b) or self.step(state, b)
            last.append(token)
        out, at, of = [], len(piece), self.vocab.of
        while at:
            out.append(last[at - 1])
            at -= len(of[last[at - 1]])
        return out[::-1]


#: Between a character that isn't white space and one that is, a piece always ends.
BORDER = regex.compile(r"\S(?=\s)")
BLOCK = 1 << 20
SHORT = 1 << 15


def blocks(text: str, size: int = BLOCK):
    """Cut a text at sure piece borders into blocks of about ``size`` characters."""
    at = 0
    while len(text) - at > size:
        m = BORDER.search(text, at + size)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


class _Spelled(dict):
    """Ids of the pieces met so far, as little-endian 32-bit bytes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        out = np.array(self.vocab.spell(piece.encode("utf-8", "replace")), "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = out
        return out


class _Counted(dict):
    """Token counts of the pieces met so far."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, piece: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self.machine.count(piece.encode("utf-8", "replace"))
        if len(piece) < 64:
            self[piece] = out
        return out


class Encoder:
    """Texts to ids or counts, as the library gives them without added special tokens."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.machine = Transducer(self.vocab)
        self.find = regex.compile(PIECES).findall
        self.special = sorted(self.vocab.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.compiled = None
        if self.vocab.plain():
            self.compiled = tiktoken.Encoding("compiled", pat_str=PIECES, mergeable_ranks=self.vocab.ids, special_tokens={})
        self.spelled, self.counted = _Spelled(self.vocab), _Counted(self.machine)
        self.marks = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")

    def _parts(self, text: str, size: int = BLOCK):
        """(special string or None, text) in order."""
        for block in blocks(text, size):
            if any(m in block for m in self.special):
                for i, part in enumerate(self.split(block)):
                    yield (part, "") if i % 2 else (None, part)
            else:
                yield None, block

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit bytes.

        A vocabulary that allows it (see ``plain``) is run by compiled code; a
        part without any border for long, which that code does not take well,
        is spelled here.
        """
        spelled, out = self.spelled, []
        for mark, part in self._parts(text, SHORT):
            if mark:
                out.append(self.vocab.special[mark].to_bytes(4, "little"))
            elif self.compiled and len(part) <= 2 * SHORT:
                out.append(self.compiled.encode_to_numpy(part, disallowed_special=()).astype("<u4", copy=False).tobytes())
            else:
                out += [spelled[p] for p in self.find(part)]
        return b"".join(out)

    def count(self, text: str) -> int:
        counted = self.counted
        return sum(1 if mark else sum([counted[p] for p in self.find(part)]) for mark, part in self._parts(text))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
