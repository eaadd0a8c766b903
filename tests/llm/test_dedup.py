import os
import random
import subprocess
import sys

import brute
import pytest

from streetlink.llm.components import components
from streetlink.llm.exact_dedup import DigestIndex, drop_exact_copies, exact_dedup_report
from streetlink.llm.repeats import Bytes, Words, earlier_windows, front_code, loser_tree_merge, placed_runs_of, runs_of, sort_merge
from streetlink.llm.simhash import ball_links, distance_for, drop_near_copies, fingerprint, near_links, plan, segments_for, simhash_components
from streetlink.llm.substring_dedup import remove_repeated_words
from streetlink.llm.suffix_dedup import remove_repeated_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, row string"


def corpus(seed=1, n=60):
    """Null, empty, blank and long texts, copies, near copies, shared passages, ties."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", " \t\n", "a", "a b", "A B C D", "a b c d", "x " * 300, passage, "ab" * 200]
    for _ in range(n):
        t = "\n".join(" ".join(word() for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 12)))
        texts += [t] * rnd.choice([1, 1, 2])
        if rnd.random() < 0.4:
            texts.append(t + " " + passage + " " + word())
        if rnd.random() < 0.4:
            texts.append(t.replace("a", "b", 1))
        if rnd.random() < 0.2:
            texts.append(t.replace(" ", "  "))
    rnd.shuffle(texts)
    return [dict(doc_id=i, text=t, lang=None, source=rnd.choice(["s1", "s2", None]), n_chars=len(t or ""), key="k", id=7, row="r") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars", "key", "id", "row")) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_exact_report(spark, rows):
    got = exact_dedup_report(frame(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.exact(rows))


def test_exact_index_persists(spark, rows):
    index = DigestIndex(spark)
    first = {r.doc_id for r in exact_dedup_report(frame(spark, rows[:70]), index).filter("kept").collect()}
    again = exact_dedup_report(frame(spark, rows), index).collect()
    old = {brute.sha(b"")} | {r.text_sha256 for r in again if r.keep_id in first}
    assert not any(r.kept for r in again if r.text_sha256 in old and r.keep_id in first)
    assert index.read().count() == len({r.text_sha256 for r in again})


def test_exact_index_is_reopened_by_its_path(spark, rows, tmp_path):
    """A second application, with another catalog and another number of partitions, sees what the first one wrote."""
    path = f"file://{tmp_path}/index"
    script = """
import sys
from pyspark.sql import SparkSession
from streetlink.llm.exact_dedup import DigestIndex, exact_dedup_report
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.sql.warehouse.dir", sys.argv[2]).getOrCreate()
docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
assert {(r.doc_id, r.kept) for r in exact_dedup_report(docs, DigestIndex(spark, sys.argv[1])).collect()} == {(1, True), (2, True)}
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", script, path, f"{tmp_path}/warehouse"], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root})
    index = DigestIndex(spark, path, buckets=7)
    assert index.buckets == 3
    docs = spark.createDataFrame([(1, "AB"), (3, "d"), (4, "ab"), (5, "c ")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup_report(docs, index).collect()}
    assert got == {1: (1, True), 3: (3, True), 4: (1, False), 5: (2, False)}
    assert sorted(r.keep_id for r in index.read().collect()) == [1, 1, 2, 3]
    index.close()
    with pytest.raises(ValueError):
        os.makedirs(f"{tmp_path}/other/rows")
        DigestIndex(spark, f"file://{tmp_path}/other")


def test_exact_batch_can_be_retried(spark, rows, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}/index")
    exact_dedup_report(frame(spark, rows[:40]), index, batch="one").collect()
    # a try of the second batch that got half of its rows in
    index.append(frame(spark, rows[40:70]), batch="two")
    want = None
    for _ in range(2):
        got = sorted(map(tuple, exact_dedup_report(frame(spark, rows[40:]), index, batch="two").select("doc_id", "keep_id", "kept").collect()))
        assert want in (None, got)
        want = got
    digests = index.read().select("digest")
    assert digests.count() == digests.distinct().count() == len({x[4] for x in brute.exact(rows)})
    kept = {r[0] for r in got if r[2]}
    old = {x[4] for x in brute.exact(rows[:40])}
    assert kept and len(kept) == len({x[4] for x in brute.exact(rows)} - old)
    index.close()


def test_exact_index_is_joined_in_its_buckets(spark, rows, tmp_path):
    index = DigestIndex(spark, f"file://{tmp_path}/index")
    index.append(frame(spark, rows[:40]))
    batch = frame(spark, rows).selectExpr("unhex(sha2(text, 256)) as d").distinct()
    plan = batch.join(index.read().select("digest").hint("merge"), batch.d == index.read().digest, "left_anti")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "LeftAnti" in plan and "SortMergeJoin" in plan
    scan = plan[plan.index("FileScan parquet") :]
    assert "Bucketed: true" in scan
    index.close()


def test_the_longer_spelling_of_an_id_stays(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a  b", "y"), (1, "ab", "z"), (2, "a  b", "w")], "doc_id long, text string, source string")
    assert [tuple(r) for r in drop_exact_copies(docs).collect()] == [(1, "a  b", "y")]
    tied = spark.createDataFrame([(1, "a b", "x"), (1, "a\tb", "y"), (1, "ab ", "z")], "doc_id long, text string, source string")
    assert {tuple(drop_exact_copies(tied.repartition(n)).collect()[0]) for n in (1, 2, 3)}.__len__() == 1


def test_exact_repeated_rows(spark, rows):
    twice = frame(spark, rows[:20] + rows[:20])
    kept = exact_dedup_report(twice).filter("kept")
    assert kept.count() == kept.select("text_sha256").distinct().count()
    out = drop_exact_copies(twice)
    assert out.columns == frame(spark, rows).columns
    assert out.count() == kept.count()


def test_substrings(spark, rows):
    want = brute.substrings(rows)
    for hot in (50_000, 1):  # with 1, every bucket takes the way of hot ones
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_words(frame(spark, rows), hot=hot).collect()}
        assert got == want
    assert sum(v[1] for v in want.values()) > 500


def test_suffixes(spark, rows):
    want = brute.suffixes(rows)
    for hot in (50_000, 1):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_bytes(frame(spark, rows), hot=hot).collect()}
        assert got == want
    assert sum(v[1] for v in want.values()) > 500


def test_removed_text_can_be_had(spark, rows):
    for r in remove_repeated_bytes(frame(spark, rows), with_bytes=True).collect():
        assert brute.sha(bytes(r.kept_bytes)) == r.kept_sha256
    for r in remove_repeated_words(frame(spark, rows), with_text=True).collect():
        assert brute.sha(r.kept_text.encode()) == r.kept_sha256


@pytest.mark.parametrize("units", [Words(35, 8), Bytes(100, 32)])
def test_runs_cover_every_window_once(units):
    rnd = random.Random(2)
    for text in ("x " * 400, " ".join(rnd.choice("ab") for _ in range(900)), "".join(rnd.choice("abc ") for _ in range(5000))):
        n = len(units.split(text)) - units.width + 1
        whole = runs_of(units, text)
        cut = runs_of(units, text, block=97)
        for _, first, count in (whole, cut):
            assert [x for f, c in zip(first.tolist(), count.tolist()) for x in range(f, f + c)] == list(range(max(n, 0)))
        at = {f + j: h for h, f, c in zip(*(x.tolist() for x in whole)) for j in range(c)}
        assert all(at[f + j] == h for h, f, c in zip(*(x.tolist() for x in cut)) for j in range(c))


def test_merges_agree():
    rnd = random.Random(3)
    blobs, every = [], []
    for run in range(7):
        strings = sorted({bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(rnd.randint(1, 60))})
        blobs.append(front_code([(s, run, 0, i, 0) for i, s in enumerate(strings)]))
        every += [(s, run) for s in strings]
    for merge in (loser_tree_merge, sort_merge):
        got = list(merge(blobs))
        assert [g[0] for g in got] == sorted(s for s, _ in every)
        assert sorted((g[0], g[1][0]) for g in got) == sorted(every)
    before = b""
    for s, _, shared in loser_tree_merge(blobs):
        assert shared == len(os.path.commonprefix([s, before]))
        before = s


def test_the_shared_lengths_decide_repeats():
    """Suffixes through the merge, by pairs and by levels, against every window looked up."""
    rnd = random.Random(11)
    units = Bytes(40, 8)
    made = 0
    for trial in range(60):
        some = bytes(rnd.choice(b"ab") for _ in range(rnd.choice([60, 90, 200])))
        texts = []
        for _ in range(rnd.randint(2, 9)):
            t = bytearray(some[rnd.randint(0, 9) :] + some[: rnd.randint(0, 30)])
            for _ in range(rnd.randint(0, 2)):
                t[rnd.randrange(len(t))] = rnd.choice(b"abc")
            texts.append(bytes(t))
        seen, want = set(), set()
        for d, t in enumerate(texts):
            for i in range(len(t) - 39):
                if t[i : i + 40] in seen:
                    want.add((d, i))
                seen.add(t[i : i + 40])
        groups = {}
        for d, t in enumerate(texts):
            for h, first, n, place in zip(*(x.tolist() for x in placed_runs_of(units, t.decode()))):
                groups.setdefault(h, []).append((units.pack(t, first, place, n), d, 0, first, 0))
        for pairwise in (10**9, 0):
            got = set()
            for entries in groups.values():
                rnd.shuffle(entries)
                blobs = [front_code(sorted(entries[k::3])) for k in range(3) if entries[k::3]]
                group = [[s, shared, *meta] for s, meta, shared in loser_tree_merge(blobs)]
                for x in earlier_windows(group, units, pairwise):
                    got |= {(x["id"], j) for j in range(x["first"], x["stop"])}
            assert got == want
        made += len(want)
    assert made > 1000


def test_simhash(spark, rows):
    want = brute.near(rows)
    for bucket in (16384, 3):  # with 3, most buckets take the way of crowded ones
        got = {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash_components(frame(spark, rows), bucket=bucket).collect()}
        assert got == want
    assert len({v[1] for v in want.values()}) < len(rows)


def test_fingerprint_cases():
    assert fingerprint(None) == fingerprint("") == fingerprint(" \n") == 0
    assert fingerprint("A b C") == fingerprint("a  B c") != 0
    text = " ".join(str(i % 977) for i in range(70_000))
    assert fingerprint(text) == brute.simhash(text)


def test_links_at_exactly_the_distance(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        fps.add(x)
        for d in (1, 4, 5):
            fps.add(x ^ sum(1 << b for b in rnd.sample(range(64), d)))
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    want = {frozenset((signed(a), signed(b))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4}
    for links in (near_links(df), near_links(df, bucket=1), ball_links(df)):
        got = {frozenset((r.u, r.v)) for r in links.collect()}
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in map(tuple, got))
        for pair in want:  # each link's ends are connected
            group, grown = {min(pair)}, True
            while grown:
                more = {x for e in got if e & group for x in e} - group
                group |= more
                grown = bool(more)
            assert pair <= group


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_drop_near_copies_keeps_one_of_each_group(spark, rows):
    want = {v[1] for v in brute.near_copies(rows).values()}
    out = drop_near_copies(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def edited(rnd, words, n):
    """The text with n words in a row replaced."""
    at = rnd.randrange(len(words) - n)
    return " ".join(words[:at] + [f"new{rnd.random()}" for _ in range(n)] + words[at + n :])


def test_near_copies_are_found_at_the_similarity(spark):
    """Texts of which 0.8 of the five-word shingles are shared, and unrelated ones."""
    rnd = random.Random(21)
    texts, similar = [], []
    for _ in range(120):
        words = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        new = edited(rnd, words, rnd.randint(1, 16))
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, new.split())]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            similar.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), new]
    rows = [dict(doc_id=i, text=t, lang=None, source=None, n_chars=len(t), key="k", id=7, row="r") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in simhash_components(frame(spark, rows), distance=distance_for(0.8, 128), width=5, words=2).collect()}
    assert got == {d: c for d, (_, c) in brute.near_copies(rows).items()}
    assert len(similar) > 80 and sum(got[a] == got[b] for a, b in similar) >= 0.95 * len(similar)
    assert all(c in (d, d - d % 2) for d, c in got.items())


def test_crowded_buckets_of_near_copies(spark):
    """A group larger than a task may compare, with links that only far members have."""
    rnd = random.Random(22)
    base = [f"w{i}" for i in range(100)]
    words = list(base)
    texts = [" ".join(base)]
    for i in range(60):  # a chain that drifts away from the first
        words[rnd.randrange(100)] = f"x{i}"
        texts.append(" ".join(words))
        texts.append(edited(rnd, base, 1))
    rows = [dict(doc_id=i, text=t, lang=None, source=None, n_chars=len(t), key="k", id=7, row="r") for i, t in enumerate(texts)]
    want = brute.near_copies(rows)
    for bucket in (8, 40):
        got = {r.doc_id: r.component_id for r in simhash_components(frame(spark, rows), distance=23, bucket=bucket, width=5, words=2).collect()}
        assert got == {d: c for d, (_, c) in want.items()}


def test_balls_meet_at_every_distance():
    """Whatever the plan, two fingerprints within the distance share a bucket where one of them stands."""
    rnd = random.Random(23)
    for words, m, distance in ((1, 4, 4), (1, 3, 4), (1, 2, 4), (2, 8, 23), (2, 6, 23), (2, 4, 7)):
        segs = plan(m, distance, 64 * words)
        assert sum(bits for _, bits, _ in segs) == 64 * words and len(segs) == m
        for _ in range(300):
            differ = sum(1 << b for b in rnd.sample(range(64 * words), rnd.randint(0, distance)))
            gaps = [((differ >> shift) & (1 << bits) - 1).bit_count() for shift, bits, _ in segs]
            assert any(r >= 0 and g <= r // 2 + (r - r // 2) for g, (_, _, r) in zip(gaps, segs))
    assert [segments_for(n, 23, 128) for n in (10, 1 << 20, 1 << 25, 1 << 40)] == [8, 8, 6, 4]


@pytest.mark.parametrize("make", [exact_dedup_report, drop_exact_copies, remove_repeated_words, remove_repeated_bytes, simhash_components, drop_near_copies])
def test_empty_table_and_null_ids(spark, rows, make):
    assert make(frame(spark, []).coalesce(1)).count() == 0
    assert make(frame(spark, [r | {"doc_id": None} for r in rows[:12]])).count() > 0
