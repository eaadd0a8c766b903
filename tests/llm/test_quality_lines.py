from test_dedup import frame

from streetlink.llm.quality import keep_good, quality_verdicts

TEMPLATE = "Shared   line of one template"


def doc(i, text, source="s"):
    return dict(doc_id=i, text=text, lang=None, source=source, n_chars=len(text or ""), key="k", id=7, row="r")


def own(i, n=60):
    return " ".join(f"w{i}x{j}" for j in range(n))


def templated(n=30):
    """Documents of a host whose second line is a template; the first keeps it."""
    return [doc(i, f"{own(i)}\n{TEMPLATE if i % 2 else TEMPLATE.lower()}\n\n{own(i + 1000)}\n") for i in range(n)]


def test_kept_texts_lose_their_template_lines(spark):
    rows = templated() + [doc(500, f"{own(500)}\n{TEMPLATE}", "other"), doc(501, None), doc(502, own(502), None)]
    want = {r["doc_id"]: r["text"] if r["doc_id"] in (0, 500, 502) else f"{own(r['doc_id'])}\n\n{own(r['doc_id'] + 1000)}\n" for r in rows if r["doc_id"] != 501}
    out = keep_good(frame(spark, rows))
    assert out.schema == frame(spark, rows).schema
    got = out.collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)
    verdicts = quality_verdicts(frame(spark, rows), with_text=True).collect()
    assert {r.doc_id: r.kept_text for r in verdicts} == want | {501: None}


def test_repeated_rows_do_not_multiply_template_words(spark):
    line = " ".join(["template"] + [f"t{j}" for j in range(23)])
    rows = [doc(i, f"{line}\n{own(i, 36)}") for i in range(30)]
    rows += [dict(rows[5]), dict(rows[7]), dict(rows[7])] + [doc(None, f"{line}\n{own(99)}\n{line}") for _ in range(6)]
    got = quality_verdicts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.removed_words, r.kept) for r in got} == {(i, 24 if i else 0, True) for i in range(30)} | {(None, 48, True)}
    assert keep_good(frame(spark, rows)).count() == len(rows)


def test_the_limit_does_not_grow_in_proportion(spark):
    rows = [doc(i, f"{own(i)}\n{'in a few of them ' if i < 70 else f'line {i}'}\n{'in fewer' if i < 40 else ''}") for i in range(800)]
    got = {r.doc_id: r.removed_words for r in quality_verdicts(frame(spark, rows)).collect()}
    assert got == {i: 5 if 0 < i < 70 else 0 for i in range(800)}  # the limit is 40
