"""Linking a batch of query addresses to a base of addresses.

Blocking is on the fields that carry a hard veto, compared null-safely, so no
pair that could match is lost: via type, via number, cross number and the
plate's number. With a plate tolerance, a small one puts a query under each
plate within reach (an equi-join again), a large one joins on the face and keeps
the band as a condition of the join. The summary of a large one joins on all that a
match has equal and counts what it compares by plates, so its pairs are never kept.

The base is parsed once (``block_base``), and may be written bucketed by its
block (``write_base``); a join of batches of queries then does not move it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import settled
from ..vocab import BIS_FIELDS, HARD_FIELDS, PENALTIES, SOFT_FIELDS, THRESHOLD, TOLERANCE
from .compare import checked_threshold, checked_tolerance, comparisons, match_parsed, opaque, reaches, rounded, score, vetoed
from .parse import parse

FACE = ("via_type", "via_number", "cross_number")
#: Above this many plates within reach, a query is not copied for each.
WINDOW = 64


def checked_cap(value: object) -> int | None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
        raise ValueError(f"max_block_scan debe ser un entero >= 1 o None: {value!r}")
    return value


def keys(p: Column) -> dict[str, Column]:
    return {f"k_{f}": p[f] for f in FACE} | {"k_plate": p["plate_num"]}


def block_base(base: DataFrame, id_col: str, address_col: str, order_col: str | None = None) -> DataFrame:
    """(record_id, ordinal, parsed, keys) of the addresses that parse."""
    own = base.select(F.col(id_col).alias("record_id"), F.col(address_col).alias("address"), F.col(order_col or id_col).alias("ordinal"))
    parsed = parse(own, "address", "base").filter("base.parse_ok")
    return parsed.withColumns(keys(F.col("base"))).drop("address")


def write_base(blocked: DataFrame, table: str, buckets: int) -> None:
    """Persist a blocked base under its face, so later links read it where it lies."""
    blocked.write.mode("overwrite").bucketBy(buckets, "k_via_type", "k_via_number", "k_cross_number").sortBy("k_via_type", "k_via_number", "k_cross_number").saveAsTable(table)


def _same_face(q: DataFrame, b: DataFrame) -> Column:
    same = q["k_via_type"].eqNullSafe(b["k_via_type"])
    for f in FACE[1:]:
        same &= q[f"k_{f}"].eqNullSafe(b[f"k_{f}"])
    return same


def _capped(base: DataFrame, cap: int | None) -> DataFrame:
    """The base with ``truncated``; of each block its first ``cap`` rows."""
    if cap is None:
        return base.withColumn("truncated", F.lit(False))
    block = Window.partitionBy(*[f"k_{f}" for f in FACE], "k_plate")
    base = base.withColumn("block_rank", F.row_number().over(block.orderBy("ordinal"))).withColumn("block_size", F.count(F.lit(1)).over(block))
    return base.filter(F.col("block_rank") <= cap).withColumn("truncated", F.col("block_size") > cap).drop("block_rank", "block_size")


def candidates(queries: DataFrame, base: DataFrame, tolerance: int = TOLERANCE, max_block_scan: int | None = None, how: str = "inner") -> DataFrame:
    """Pairs of a query and a record of its block (query_id, query, record_id, ordinal, base, truncated).

    With how="left" queries that meet no record come too, with a null base.
    """
    tolerance, cap = checked_tolerance(tolerance), checked_cap(max_block_scan)
    q, base = queries.withColumns(keys(F.col("query"))), _capped(base, cap)
    b = base.withColumnsRenamed({k: f"b_{k}" for k in base.columns if k.startswith("k_")})
    face = F.lit(True)
    for f in FACE:
        face &= q[f"k_{f}"].eqNullSafe(b[f"b_k_{f}"])
    if tolerance == 0:
        on = face & q["k_plate"].eqNullSafe(b["b_k_plate"])
    elif 2 * tolerance + 1 <= WINDOW:
        reach = F.when(F.col("k_plate").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.greatest(F.col("k_plate") - tolerance, F.lit(0)), F.col("k_plate") + tolerance))
        q = q.withColumn("k_reach", F.explode(reach))
        face = F.lit(True)
        for f in FACE:
            face &= q[f"k_{f}"].eqNullSafe(b[f"b_k_{f}"])
        on = face & q["k_reach"].eqNullSafe(b["b_k_plate"])
    else:
        both_null = q["k_plate"].isNull() & b["b_k_plate"].isNull()
        near = F.abs(q["k_plate"].cast("long") - b["b_k_plate"]) <= tolerance
        on = face & (both_null | F.coalesce(near, F.lit(False)))
    return q.join(b, on, how).select("query_id", "query", "record_id", "ordinal", "base", "truncated")


def parse_queries(queries: DataFrame, id_col: str, address_col: str) -> DataFrame:
    return parse(queries.select(F.col(id_col).alias("query_id"), F.col(address_col).alias("address")), "address", "query").drop("address")


def scored(pairs: DataFrame, threshold: float = THRESHOLD, tolerance: int = TOLERANCE) -> DataFrame:
    """Pairs with score and is_match; fields, reason and warnings are left to those that are shown."""
    x, y = F.col("query"), F.col("base")
    out = pairs.withColumns({"score": settled(score(x, y, tolerance)), "veto": vetoed(x, y, tolerance)})
    return out.withColumn("is_match", ~F.col("veto") & (F.col("score") >= checked_threshold(threshold))).drop("veto")


def link(queries: DataFrame, base: DataFrame, threshold: float = THRESHOLD, tolerance: int = TOLERANCE, max_block_scan: int | None = None) -> DataFrame:
    """Ranked links, one row per query and record that matches: query_id, record_id, score, rank.

    queries: from parse_queries; base: from block_base. A record's best score
    counts, and of equal scores its first address.
    """
    pairs = scored(candidates(queries, base, tolerance, max_block_scan), threshold, tolerance)
    hits = pairs.filter("is_match").select("query_id", "record_id", "score", "ordinal", "base")
    # least by the negated score and then the ordinal, which may be of any type that has an order
    best = hits.groupBy("query_id", "record_id").agg(F.min_by(F.struct("score", "base"), F.struct((-F.col("score")).alias("s"), "ordinal")).alias("x"))
    ranked = best.select("query_id", "record_id", "x.score", F.col("x.base").alias("base"))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "record_id")))


def link_summary(queries: DataFrame, base: DataFrame, threshold: float = THRESHOLD, tolerance: int = TOLERANCE, max_block_scan: int | None = None) -> DataFrame:
    """One row per query: what was compared and what was found.

    query_id, parse_ok, n_compared (all scored records, also those below the
    threshold), n_candidates, best_id, best_score, ambiguous (the second score
    equals the first), alternatives, near_ambiguous, truncated, reason.
    """
    if 2 * checked_tolerance(tolerance) + 1 > WINDOW:
        return _shown(_wide_summary(queries, _capped(base, checked_cap(max_block_scan)), checked_threshold(threshold), tolerance, max_block_scan is not None))
    pairs = scored(candidates(queries, base, tolerance, max_block_scan, "left"), threshold, tolerance)
    # one shuffle by query serves the three aggregates; nothing is parsed or joined again
    rows = pairs.select(
        "query_id", F.col("query.parse_ok").alias("ok"), F.array_join("query.notes", ", ").alias("notes"), "record_id",
        F.col("base").isNotNull().cast("long").alias("met"), F.when(F.col("is_match"), F.col("score")).alias("score"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    ).repartition("query_id")
    per_record = rows.groupBy("query_id", "record_id").agg(F.max("ok").alias("ok"), F.max("notes").alias("notes"), F.sum("met").alias("met"), F.max("score").alias("score"), F.max("truncated").alias("truncated"))
    by_score = per_record.groupBy("query_id", "score").agg(
        F.max("ok").alias("ok"), F.max("notes").alias("notes"), F.sum("met").alias("met"), F.count(F.lit(1)).alias("records"), F.min("record_id").alias("first_id"), F.max("truncated").alias("truncated"))
    hit = F.col("score").isNotNull()
    best = F.max(F.when(hit, F.struct("score", "records", "first_id")))
    out = by_score.groupBy("query_id").agg(
        F.max("ok").alias("parse_ok"), F.max("notes").alias("notes"), F.sum("met").alias("n_compared"), F.coalesce(F.sum(F.when(hit, F.col("records"))), F.lit(0)).alias("n"), best.alias("best"), F.max("truncated").alias("truncated"))
    return _shown(out)


def _shown(out: DataFrame) -> DataFrame:
    n = F.col("n")
    reason = F.when(~F.col("parse_ok"), F.concat(F.lit("consulta no canónica ("), F.col("notes"), F.lit(")"))).when(n == 0, "sin candidatos sobre el umbral").otherwise("")
    return out.select(
        "query_id", "parse_ok", "n_compared", n.alias("n_candidates"), F.col("best.first_id").alias("best_id"), F.col("best.score").alias("best_score"),
        F.coalesce(F.col("best.records") > 1, F.lit(False)).alias("ambiguous"), F.greatest(n - 1, F.lit(0)).alias("alternatives"), (n > 1).alias("near_ambiguous"), "truncated", reason.alias("reason"),
    )


def equal_in_matches(threshold: float) -> tuple[str, ...]:
    """Fields that are equal, or missing on both sides, in every match of the threshold:
    those with a veto, and the others if their least penalty alone is too much."""
    least = 1 - min(PENALTIES["one_sided"], PENALTIES["conflict"])
    return (*HARD_FIELDS, "plate_letter", *(() if round(least, 4) >= threshold else (*SOFT_FIELDS, *BIS_FIELDS)))


def _joined(p: dict[str, Column] | Column, fields: tuple[str, ...]) -> Column:
    """Fields as one text; they hold letters, digits and slashes only."""
    return F.array_join(F.array(*[p[f].cast("string") for f in fields]), "\x1f", "\x1e")


def _wide_summary(queries: DataFrame, base: DataFrame, threshold: float, tolerance: int, capped: bool) -> DataFrame:
    """What ``link_summary`` tells, for many plates within reach, without keeping pairs.

    Records compared are counted by face and plate. Matches come from a join on all
    that a match has equal, and are summed up where they are joined. Only a match of a
    query or record id that occurs more than once is kept until its id is met again.
    """
    fields = (*HARD_FIELDS, *SOFT_FIELDS, *BIS_FIELDS, "cross_type", "plate", "plate_num", "plate_letter", "complement")
    equal = equal_in_matches(threshold)
    own, reached = F.col("query"), F.col("base")
    told = F.col("ok")
    # what a chunk says is told once a row, and not once a pair
    chunks = lambda p: F.when(F.size(p["complement"]) > 0, F.array(F.to_json(p["complement"]))).otherwise(F.array().cast("array<string>"))
    side = lambda p, mark, names: [*[(chunks(p) if f == "complement" else p[f]).alias(mark + f) for f in names], opaque(p["complement"]).alias(f"{mark}opaque")]
    q = queries.select("query_id", own["parse_ok"].alias("ok"), F.array_join(own["notes"], ", ").alias("notes"), *side(own, "q_", fields))
    x = {f: F.col(f"q_{f}") for f in (*fields, "opaque")}
    # a text that does not parse meets nothing; such queries are spread
    alone = F.concat(F.lit("\x1d"), F.xxhash64("query_id").cast("string"))
    q = q.withColumns({"face": F.when(told, _joined(x, FACE)).otherwise(alone), "block": F.when(told, _joined(x, equal)).otherwise(alone)})

    plates = base.select(_joined(reached, FACE).alias("face"), reached["plate_num"].alias("plate"), "truncated").groupBy("face", "plate").agg(F.count(F.lit(1)).alias("n"), F.max("truncated").alias("cut"))
    plates = plates.groupBy("face").agg(F.collect_list(F.struct("plate", "n", "cut")).alias("plates"))
    within = lambda plate, other: (plate.isNull() & other.isNull()) | F.coalesce(F.abs(plate.cast("long") - other) <= tolerance, F.lit(False))
    near = F.filter("plates", lambda c: within(x["plate_num"], c["plate"]))
    met = F.aggregate(near, F.lit(0).cast("long"), lambda n, c: n + c["n"])
    cut = F.coalesce(F.exists(near, lambda c: c["cut"]), F.lit(False)) if capped else F.lit(False)
    q = q.join(plates, "face", "left").withColumns({"met": F.coalesce(met, F.lit(0)), "truncated": cut}).drop("plates", "face")
    one = Window.partitionBy("query_id")
    q = q.withColumns({"met": F.sum("met").over(one), "truncated": F.max("truncated").over(one), "all_ok": F.max("ok").over(one), "notes": F.max("notes").over(one), "once": F.count(F.lit(1)).over(one) == 1})

    varying = [f for f in fields if f not in equal]
    b = base.select("record_id", _joined(reached, equal).alias("block"), *side(reached, "b_", varying))
    b = b.withColumn("only", F.count(F.lit(1)).over(Window.partitionBy("record_id")) == 1)
    # equal fields are taken from the query, so that nothing is left to compare
    a, y = x | {"parse_ok": told}, x | {f: F.col(f"b_{f}") for f in (*varying, "opaque")} | {"parse_ok": F.lit(True)}
    p, r = x["complement"], y["complement"]
    may = within(x["plate_num"], y["plate_num"]) & ((F.size(p) == 0) | (F.size(r) == 0) | (p == r))
    rows = q.join(b.withColumnRenamed("block", "b_block"), (F.col("block") == F.col("b_block")) & may, "left")
    # each step by itself, so that the code of none is too long to be compiled
    left = [c for c in comparisons(a, y, tolerance) if c.field not in equal]
    for c in left:
        rows = rows.withColumns({f"{k}_{c.field}": settled(v) for k, v in (("no", c.veto), ("cost", c.penalty)) if v is not None})
    vetoes, kept = [F.col(f"no_{c.field}") for c in left if c.veto is not None], [F.lit(1.0) - F.col(f"cost_{c.field}") for c in left if c.penalty is not None]
    rows = rows.withColumn("product", settled(F.when(F.col("only").isNotNull() & ~reduce(lambda u, v: u | v, vetoes), reduce(lambda u, v: u * v, kept, F.lit(1.0)))))
    product = F.col("product")
    rows = rows.withColumn("product", settled(F.when(reaches(product, threshold), product)))
    many = product.isNotNull() & ~(F.col("once") & F.col("only"))
    rows = rows.select("block", "query_id", F.col("all_ok").alias("parse_ok"), "notes", "met", "truncated", settled(many).alias("many"), "product", "record_id")
    rows = rows.withColumn("again", F.when(F.col("many"), F.col("record_id")))

    query = ["query_id", "parse_ok", "notes", "met", "truncated"]
    best = [F.max("score").alias("score"), F.max_by("records", "score").alias("records"), F.max_by("first_id", "score").alias("first_id")]
    # no shuffle: what is joined by block lies there
    by_product = rows.groupBy("block", *query, "many", "again", "product").agg(F.count("product").alias("records"), F.min("record_id").alias("first_id"))
    by_score = by_product.withColumn("score", rounded(F.col("product"))).groupBy("block", *query, "many", "again", "score").agg(F.sum("records").alias("records"), F.min("first_id").alias("first_id"))
    by_block = by_score.groupBy("block", *query, "many", "again").agg(F.sum("records").alias("n"), *best).drop("block")
    by_block = by_block.withColumns({c: F.when(F.col("many"), 1).otherwise(F.col(c)) for c in ("n", "records")}).repartition("query_id")
    by_unit = by_block.groupBy(*query, "many", "again").agg(F.when(F.col("many"), F.max("n")).otherwise(F.sum("n")).alias("n"), *best)
    by_score = by_unit.groupBy(*query, "score").agg(F.sum("n").alias("n"), F.sum("records").alias("records"), F.min("first_id").alias("first_id"))
    out = by_score.groupBy(*query).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *best)
    return out.select("query_id", "parse_ok", "notes", F.col("met").alias("n_compared"), "n", F.when(F.col("score").isNotNull(), F.struct("score", "records", "first_id")).alias("best"), "truncated")


def explain_links(queries: DataFrame, links: DataFrame, threshold: float = THRESHOLD, tolerance: int = TOLERANCE) -> DataFrame:
    """Fields, warnings and reason for chosen links (say, those of the first ranks)."""
    joined = links.join(queries, "query_id")
    return match_parsed(joined.drop("score"), "query", "base", threshold, tolerance)


def index_stats(base: DataFrame, id_col: str, address_col: str) -> DataFrame:
    """One row: distinct records, blocks, rejected addresses, largest block.

    One parse and one shuffle: each address counts once under its block and once
    under its record.
    """
    parsed = parse(base.select(F.col(id_col).alias("record_id"), F.col(address_col).alias("address")), "address", "p")
    block = [F.col(k) for k in keys(F.col("p"))]
    keyed = parsed.withColumns(keys(F.col("p"))).select("record_id", F.col("p.parse_ok").alias("ok"), *block)
    counted = keyed.groupingSets([[F.col("ok"), F.col("record_id")], [F.col("ok"), *block]], "ok", "record_id", *block).agg(F.count(F.lit(1)).alias("n"), F.grouping("record_id").alias("is_block"))
    one, ok = F.col("is_block") == 0, F.col("ok")
    return counted.agg(
        F.count_if(ok & one & F.col("record_id").isNotNull()).alias("records"), F.count_if(ok & ~one).alias("blocks"),
        F.coalesce(F.max(F.when(ok & ~one, F.col("n"))), F.lit(0)).alias("max_block_size"), F.coalesce(F.sum(F.when(~ok & ~one, F.col("n"))), F.lit(0)).alias("rejected"))
