"""Token counts by a compiled finite-state tokenizer and composed chunk maps.

A long text is cut into chunks, which are spread over the tasks and read each on
its own. What a chunk does to the tokenizer is its state map: from a state at its
entry to the state at its exit and the tokens counted between, as the transducer's
transitions tell. Cuts are put where little is open. At a sure border of two
pieces only the start state can stand, whatever came before. Inside an unbroken
run, of letters say, the open piece goes on, and the state is the transducer's; a
map then has a line for each state that reading the text before the cut leads to,
from 16 beginnings, since a transducer forgets where it began but for its phase.
Maps hold names of states and numbers, never text. They compose associatively, so
a document's maps are combined in a tree of bounded groups. Should a state arise
for which a map has no line, the document is counted in one piece instead.

Defined cases: null text counts as empty, with 0 bytes and 0 tokens; repeated
rows are counted each; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, table
from .tokens import BORDER, Encoder, default_file, encoder
from .words import map_arrow, text_or_empty

CHUNK = 1 << 16
LIMIT = 512
#: Characters on both sides of a chunk's end in which its cut is looked for.
MARGIN = 4096
#: Maps combined in one row.
GROUP = 32
PHASES = 16
LOOK_BACK = 512
SHORTEST_RUN = 32
START = ""
NO_CUT = "?"

#: Where a piece ends for sure whatever stands further off (white space joins what follows, an apostrophe letters).
CHANGE = regex.compile(r"\p{L}(?=\P{L})|\p{N}(?=\P{N})|[^\s\p{L}\p{N}'](?=[\s\p{L}\p{N}])|'(?=[\s\p{N}])")
RUN = regex.compile(r"(\p{L}+)|(\p{N}+)|(\s+)|([^\s\p{L}\p{N}]+)")

#: (state at entry, state at exit, tokens)
Line = tuple[str, str, int]


def cut(machine: Encoder, around: str, middle: int) -> tuple[int, bool] | None:
    """(place, inside a run) of the cut at or after the middle of the text around a chunk's end.

    It depends on nothing but that text, so both chunks find the same one. None if there is no good place.
    """
    slack = max(SHORTEST_RUN, *map(len, machine.special)) if machine.special else SHORTEST_RUN
    end = len(around) - slack
    marks = [m.span() for m in machine.marks.finditer(around, overlapped=True)]
    free = lambda at: not any(a < at < b for a, b in marks)
    for border in (BORDER, CHANGE):
        for m in border.finditer(around, middle):
            if m.end() >= end:
                break
            if free(m.end()):
                return m.end(), False
    for _, at in marks:
        if middle <= at < end and free(at):
            return at, False
    runs = [m.span() for m in RUN.finditer(around, middle, max(end, middle))]
    start, stop = max(runs, key=lambda r: r[1] - r[0], default=(0, 0))
    at = (start + stop) // 2
    return (at, True) if stop - start >= SHORTEST_RUN and free(at) else None


def open_piece(machine: Encoder, text: str) -> tuple[int, str]:
    """(tokens of all pieces but the last, the last piece), for a text that ends inside a run."""
    *before, (mark, part) = machine._parts(text)
    pieces = machine.find(part)
    return sum(1 if m else sum(machine.counted[x] for x in machine.find(p)) for m, p in before) + sum(machine.counted[x] for x in pieces[:-1]), pieces[-1]


def rest_of_piece(machine: Encoder, text: str) -> int:
    """How many characters of a text that begins inside a run still belong to the open piece."""
    m = RUN.match(text)
    end = m.end()
    mark = machine.marks.search(text)
    if mark and mark.start() <= end:
        return mark.start()
    # the last white space before something else goes with that
    return end - 1 if m.lastindex == 3 and end < len(text) else end


def state_map(machine: Encoder, part: str, begin: int, chunk: int, last: bool) -> list[Line]:
    """The lines of one chunk's map; ``part`` is the chunk from ``begin`` on with the margins beside it."""
    margin, spell = min(MARGIN, chunk), machine.machine
    at, inside = 0, False
    if begin:
        found = cut(machine, part[begin - margin : begin + margin], margin)
        if not found:
            return []
        at, inside = begin - margin + found[0], found[1]
    stop, leave = len(part), None
    if not last:
        leave = cut(machine, part[begin + chunk - margin : begin + chunk + margin], margin)
        stop = begin + chunk - margin + leave[0] if leave else begin + chunk
    text = part[at:stop]
    done = rest_of_piece(machine, text) if inside else 0
    open_at_exit = leave is not None and leave[1]
    through = inside and done == len(text)

    exit_key, tokens = START, 0
    if not through:
        if open_at_exit:
            tokens, piece = open_piece(machine, text[done:])
            spell.room()
            state, added = spell.run(piece.encode())
            exit_key, tokens = spell.key(state), tokens + added
        else:
            tokens = machine.count(text[done:])
    if not last and leave is None:
        exit_key = NO_CUT
    if not inside:
        return [(START, exit_key, tokens)]
    lines: dict[str, Line] = {}
    going_on = text[:done].encode()
    for phase in range(PHASES):
        before = part[max(at - LOOK_BACK, 0) + phase : at]
        piece = open_piece(machine, before)[1]
        spell.room()
        state, _ = spell.run(piece.encode())
        entry = spell.key(state)
        if entry not in lines:
            state, added = spell.run(going_on, state)
            lines[entry] = (entry, spell.key(state) if through and open_at_exit else exit_key, tokens + added)
    return list(lines.values())


def parts(text: str, chunk: int) -> Iterator[dict]:
    """The chunks of a text with their margins; the last is one to two chunks long."""
    margin, n = min(MARGIN, chunk), max(1, len(text) // chunk)
    for no in range(n):
        start = max(no * chunk - margin, 0)
        stop = (no + 1) * chunk + margin if no + 1 < n else len(text)
        yield {"no": no, "begin": no * chunk - start, "last": no + 1 == n, "part": text[start:stop]}


def compose(a: list[Line], b: list[Line]) -> list[Line]:
    """The map of two adjacent chunks: what enters the second is what leaves the first."""
    to = {entry: (exit_, n) for entry, exit_, n in b}
    return [(entry, to[via][0], n + to[via][1]) for entry, via, n in a if via in to]


def _composed(maps: Column) -> Column:
    """compose() over an array of (no, lines) in order, as an expression."""

    def join(done: Column, step: Column) -> Column:
        found = lambda x: F.get(F.filter(step["lines"], lambda y: y["entry"] == x["exit"]), F.lit(0))
        both = F.transform(done, lambda x: F.struct(x["entry"].alias("entry"), found(x)["exit"].alias("exit"), (x["tokens"] + found(x)["tokens"]).alias("tokens")))
        return F.filter(both, lambda x: x["exit"].isNotNull())

    return F.aggregate(F.slice(maps, F.lit(2), F.greatest(F.size(maps) - 1, F.lit(0))), F.get(maps, F.lit(0))["lines"], join)


_LINES = "array<struct<entry:string,exit:string,tokens:bigint>>"


def _long_counts(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens of documents of more than one chunk (doc_id, n_bytes, text)."""
    rows = docs.select("doc_id", "n_bytes", "text", F.monotonically_increasing_id().alias("row"), F.sha2("text", 256).alias("digest"))

    def spread(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            for p in parts(r["text"], chunk):
                yield {k: r[k] for k in ("doc_id", "n_bytes", "row", "digest")} | p

    def mapped(rows: Iterator[dict]) -> Iterator[dict]:
        machine = encoder(path)
        for r in rows:
            lines = state_map(machine, r["part"], r["begin"], chunk, r["last"])
            yield {k: r[k] for k in ("doc_id", "n_bytes", "row", "digest", "no")} | {"lines": [dict(zip(("entry", "exit", "tokens"), x)) for x in lines]}

    key = "doc_id long, n_bytes long, row long, digest string, no int"
    chunks = map_arrow(rows, spread, f"{key}, begin int, last boolean, part string").repartition(F.col("row"), F.col("no"))
    maps = map_arrow(chunks, mapped, f"{key}, lines {_LINES}")
    size = GROUP
    while True:  # a text is below 2^31 characters, which bounds the levels
        in_group = F.floor(F.col("no") / GROUP).cast("int") if size * chunk < 1 << 31 else F.lit(0)
        maps = maps.groupBy("doc_id", "n_bytes", "row", "digest", in_group.alias("no2")).agg(F.sort_array(F.collect_list(F.struct("no", "lines"))).alias("maps"))
        maps = maps.select("doc_id", "n_bytes", "row", "digest", F.col("no2").alias("no"), _composed(F.col("maps")).alias("lines"))
        if size * chunk >= 1 << 31:
            break
        size *= GROUP
    total = F.get(F.filter("lines", lambda x: (x["entry"] == START) & (x["exit"] == START)), F.lit(0))["tokens"]
    out = materialize(maps.select("doc_id", "n_bytes", "digest", total.alias("n_tokens")), "long-counts")
    open_ = out.filter("n_tokens is null")
    if open_.isEmpty():
        return out.drop("digest")

    def whole(rows: Iterator[dict]) -> Iterator[dict]:
        machine = encoder(path)
        for r in rows:
            yield {"digest": r["digest"], "n_tokens": machine.count(r["text"])}

    texts = rows.join(open_.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    again = materialize(map_arrow(texts.select("digest", "text"), whole, "digest string, n_tokens long"), "long-counts-whole")
    return out.filter("n_tokens is not null").drop("digest").union(open_.drop("n_tokens").join(again, "digest").select("doc_id", "n_bytes", "n_tokens"))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    A document of one chunk is read from the start state to its end where it is.
    The chunks of longer ones are shuffled, so that many tasks read them.
    """
    path = tokenizer or default_file()
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    docs = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def read(rows: Iterator[dict]) -> Iterator[dict]:
        machine = encoder(path)
        for r in rows:
            yield {"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "n_tokens": machine.count(r["text"])}

    short = map_arrow(docs.filter(F.length("text") <= chunk), read, "doc_id long, n_bytes long, n_tokens long")
    both = short.union(_long_counts(docs.filter(F.length("text") > chunk), path, chunk))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
