"""Main text by tag-path ratios: what decides, odd markup, depth."""

import time

import pytest

from lobspark.llm import html

P = "A long paragraph with words, commas, and so on. It goes on for a while, as articles do."


def page(body):
    return f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav>{body}<footer>&copy; 2024, all rights reserved.</footer></body></html>"


KEPT = {
    "apostrophe in an unquoted value": (f"<article><p title=it's>{P}</p></article>", [P]),
    "names inside an article only weigh": (f'<article><h1>T</h1><p>{P}</p><section id="search-engines"><p>{P}</p></section><div class="share-price"><p>{P}</p></div><div class="legal analysis"><p>{P}</p></div></article>', ["T", P, P, P, P]),
    "a form around the page": (f"<form><article><h1>T</h1><p>{P}</p></article></form>", ["T", P]),
    "a wrapper with a bad name": (f'<div class="content-sidebar-wrap"><div class="entry-header"><h1>Head</h1></div><div class="text"><p>{P}</p><p>{P}</p></div><div class="sidebar"><p>{P}</p></div><div class="comments"><p>{P}</p></div></div>', ["Head", P, P]),
    "linked headline and references": (f'<article><h1><a href=x>Head</a></h1><div class="byline">By X</div><p>{P}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div class="comments-area"><article class="comment">{P}</article></div></article>', ["Head", "By X", P, "One", "Two"]),
    "sibling articles": (f'<main><article class="a"><p>{P}</p></article><article class="b"><p>{P}</p></article></main>', [P, P]),
    "an empty comment": (f"<!--><article><p>{P}</p></article><!-- x -->", [P]),
}


LONG = f"<p>{P} {P}</p><p>{P}</p>"
KEPT |= {
    "items with ids": (f'<article>{LONG}<ul>{"".join(f"<li id=i{k}>Item {k}</li>" for k in range(14))}</ul>{LONG}</article>', [f"{P} {P}", P, *[f"Item {k}" for k in range(14)], f"{P} {P}", P]),
    "rows with ids": (f'<div class="text"><h1>T</h1>{LONG}<table>{"".join(f"<tr id=r{k} class=odd{k}><td class=c{k}>Cell {k}</td></tr>" for k in range(10))}</table>{LONG}</div>', ["T", f"{P} {P}", P, *[f"Cell {k}" for k in range(10)], f"{P} {P}", P]),
    "code with a comment": (f'<article>{LONG}<pre>x = 1 <span class="comment"># set x</span></pre></article>', [f"{P} {P}", P, "x = 1 # set x"]),
    "words named like bars": (f"<article>{LONG}<p>Press <span class='menu'>File</span>, then <span class='login'>Log in</span>.</p></article>", [f"{P} {P}", P, "Press File, then Log in."]),
    "references in a plain div": (f'<div class="text"><h1>T</h1>{LONG}<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul></div>', ["T", f"{P} {P}", P, "One", "Two", "Three"]),
}


def test_plain_divs_are_told_apart_by_what_they_hold():
    body = f'<div><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></div><div>Buy now.</div><div><h1>Head</h1><p>{P * 5}</p><p>Short.</p></div><div>&copy; 2024, all rights reserved.</div>'
    assert html.content(f"<body>{body}</body>") == ["Head", P * 5, "Short."]


@pytest.mark.parametrize("name", KEPT)
def test_kept(name):
    body, want = KEPT[name]
    assert html.content(page(body)) == want


def test_the_threshold_decides():
    body = f'<div id="x"><div class="text"><h1>Head</h1><p>{P}</p><p>{P}</p><div class="advert"><p>Buy now, pay later.</p></div><div><a href=1>More</a> <a href=2>Stories</a></div></div></div>'
    assert html.content(page(body)) == ["Head", P, P]
    assert len(html.content(page(body), least=0.0)) > 3


def test_without_any_name_or_mark():
    body = f"<div><a href=1>Start</a> <a href=2>News</a></div><div><h1>Head</h1><p>{P * 4}</p><p>Short.</p></div>"
    assert html.content(f"<body>{body}</body>") == ["Head", P * 4, "Short."]


@pytest.mark.parametrize("text", ["<div>x" * 20_000, "<div>" * 20_000 + "x" + "</i>" * 20_000, "<b><i>" * 20_000 + "</u></b>" * 20_000, "<p><span>" * 20_000])
def test_deep_pages_take_linear_time(text):
    start = time.perf_counter()
    html.content(text)
    assert time.perf_counter() - start < 3  # a second or less where nothing else runs


def test_repeated_rows_nulls_and_empty_table(spark):
    data = [(1, "u", page(f"<article><p>{P}</p></article>"))] * 2 + [(None, None, None), (2, "v", "")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extracted(df).collect()) == [(0, "", 0), (1, P, len(P)), (1, P, len(P)), (2, "", 0)]
    assert html.extracted(df.where("false")).count() == 0
