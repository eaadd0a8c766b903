import random

import pytest

from streetlink.llm.html_extract import extract_main_text, line_blocks, main_text

BODY = "".join(f"<p>{f'long enough words of paragraph {i} ' * 10}</p>" for i in range(15))
CLOSING = f"<p>{'closing words of the article ' * 20}</p>"
ADVERT = "<div class='ad'><p>buy one</p><p>buy two</p><p>buy three</p><p>buy four</p></div>"
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(5)) + "</ul>"


def words(html):
    return " ".join(main_text(html).split())


@pytest.mark.parametrize("end", [CLOSING, "<p>The end.</p>", f"<section><p>The end.</p></section>{ADVERT}<div>Really.</div>"])
def test_text_after_an_insertion_is_kept(end):
    page = f"<div class='menu'><a href=/>home</a></div><div id='text'>{BODY}{ADVERT}{end}</div><div class='footer'>us</div>"
    assert words(page) == words(f"<article>{BODY}{end}</article>")


def test_text_after_a_link_list_is_kept():
    assert words(f"<div id='text'>{BODY}{LINKS}<p>The end.</p></div>").endswith("The end.")


def test_a_light_part_elsewhere_is_kept_unless_it_is_links():
    teasers = "<div>" + "".join(f"<p><a href=/{i}>a teaser that is a link {i}</a> and a few words then</p>" for i in range(9)) + "</div>"
    page = f"<div><div id='one'>{BODY}</div>{ADVERT}<div id='two'>{CLOSING}</div></div>"
    assert words(page) == words(f"<article>{BODY}{CLOSING}</article>")
    assert words(f"<div id='one'>{BODY}</div>{ADVERT}{teasers}") == words(f"<article>{BODY}</article>")


def test_a_short_article_is_not_empty():
    assert words("<div class='menu'>home</div><div id='text'><h1>Head</h1><p>A short one.</p></div>") == "Head A short one."


def test_marked_teasers_do_not_hide_the_body():
    cards = "".join(f"<article class='card'><h3><a href=/{i}>teaser {i}</a></h3><p>some words of teaser {i}</p></article>" for i in range(6))
    body = words(f"<div>{BODY}</div>")
    assert body in words(f"<div class='post-body'>{BODY}{ADVERT}<p>The end.</p></div>{cards}")
    assert "The end." in words(f"{cards}<div class='post-body'>{BODY}{ADVERT}<p>The end.</p></div>")
    # the mark wins where it holds the article, and where it holds several
    assert words(f"<article>{BODY}</article><div>{'words beside the article ' * 20}</div>") == body
    assert words(f"<article>{BODY}</article><article>{BODY}</article>") == f"{body} {body}"


def test_names_of_wrappers_and_paragraphs_do_not_hide_text():
    body = words(f"<article>{BODY}</article>")
    for name in ("class='content comments-open'", "id='main-menu-page'", "class='no-sidebar'", "class='search-results'"):
        assert words(f"<div {name}><article>{BODY}</article></div>") == body
        assert words(f"<div {name}>{BODY}</div>") == body
    for name in ("class='notice-period'", "id='legal-basis'"):
        assert words(f"<article>{BODY}<p {name}>Of the law.</p></article>") == f"{body} Of the law."
    for name in ("class='ad-slot-2'", "class='siteFooter'", "id='comment-17'", "class='share-buttons'", "class='cookie-consent-bar'", "id='site-menu'"):
        assert words(f"<div {name}><p>{'words of something else ' * 9}</p></div><article>{BODY}</article>") == body
        assert words(f"<article>{BODY}<div {name}><p>{'words of something else ' * 9}</p></div></article>") == body


def test_a_page_that_is_boilerplate_by_name_only():
    assert words(f"<div id='search'>{BODY}</div>") == words(f"<article>{BODY}</article>")
    assert words("<div class='menu'><a href=/>home</a></div>") == words(f"<nav>{BODY}</nav>") == ""


def test_four_adverts_and_short_parts():
    parts = [f"<p>{f'part {i} of the article ' * 12}</p>" for i in range(5)] + ["<p>The end.</p>"]
    for wrap in ("article", "div", "main"):
        page = f"<{wrap}><h1>T</h1><p>By me.</p><p>Now.</p>{ADVERT.join(parts)}</{wrap}>"
        assert words(page) == words(f"<article><h1>T</h1><p>By me.</p><p>Now.</p>{''.join(parts)}</article>")
    assert words(f"<article><p>Very short.</p></article><div id='text'>{BODY}</div>").endswith(words(f"<article>{BODY}</article>"))


def slow_blocks(lengths, surge, window=3):
    """The rule as stated, line by line: a span starts at a line of text whose window
    surges, goes on while windows have any text, and ends with its last line of text."""
    total = lambda i: sum(lengths[i : i + window])
    kept, inside, spans = [], False, []
    for i in range(len(lengths)):
        inside = total(i) > 0 if inside else lengths[i] > 0 and total(i) >= surge
        kept.append(inside)
    for i, k in enumerate(kept):
        if k and (not i or not kept[i - 1]):
            stop = i
            while stop < len(kept) and kept[stop]:
                stop += 1
            spans.append((i, max(j for j in range(i, stop) if lengths[j]) + 1))
    return spans


def test_surges_and_dives_against_the_plain_rule():
    rnd = random.Random(3)
    for _ in range(3000):
        lengths = [rnd.choice([0, 0, 0, 5, 30, 60, 100]) for _ in range(rnd.randint(0, 25))]
        surge = rnd.choice([1, 60, 80, 130])
        assert line_blocks(lengths, surge) == slow_blocks(lengths, surge)


def test_pages_as_a_table(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x", 5), (1, "u", f"<article>{BODY}</article>", "x", 5), (None, None, None, None, None), (2, "v", "", "y", 6), (3, "w", "<p>" + "very long page " * 200_000, "z", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(extract_main_text(pages.repartition(2)).collect(), key=str)
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(main_text(rows[0][2]))), (1, len(main_text(rows[0][2]))), (2, 0), (3, 15 * 200_000 - 1)]
    assert extract_main_text(pages.limit(0)).count() == 0
