"""Pages without article or main: the region holds every section, and links of the text stay."""

from __future__ import annotations

import time

import numpy as np

from obsmill.llm import html_text
from obsmill.llm.html_text import main_text

LONG = "A sentence of the article goes on for a while here. " * 6


def test_sibling_sections_stay():
    p = LONG.strip()
    html = f"<html><body><div id=content><div><p>{p}</p><p>{p}</p></div><div><p>Twenty letters here.</p></div></div></body></html>"
    assert main_text(html) == f"{p}\n{p}\nTwenty letters here."
    assert main_text(html.replace("<html><body>", "").replace("</body></html>", "")) == f"{p}\n{p}\nTwenty letters here."


def test_only_menus_of_links_go():
    p = LONG.strip()
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Section {k}</a></li>" for k in range(5)) + "</ul>"
    refs = ["On the banding of long passages in text, 1998", "A second paper with a rather long title", "The third paper of the reference list"]
    listed = "<ol>" + "".join(f"<li><a href=x>{r}</a></li>" for r in refs) + "</ol>"
    html = f"<body><div id=content>{menu}<h2><a href=y>Linked heading</a></h2><p>{p}</p><p>{p}</p>{listed}</div></body>"
    assert main_text(html) == "\n".join(["Linked heading", p, p, *refs])


SOUP = """<html><body><div class=head><b>The Daily Paper</b></div><div><a href=1>News</a> <a href=2>Sport</a></div>
<div><h2>A heading</h2><p>{0}</p><p>Short one.</p><p>{0}</p></div><div class=x><span>Imprint</span> <span>Contact</span> <span>Terms</span></div></body></html>"""


def test_clusters_select_the_region(monkeypatch):
    p = LONG.strip()
    html = SOUP.format(p)
    assert main_text(html) == "\n".join(["A heading", p, "Short one.", p])
    monkeypatch.setattr(html_text, "chosen", lambda lines: [True] * len(lines))
    assert main_text(html).startswith("The Daily Paper") and main_text(html).endswith("Terms")


def test_parts_of_the_body_between_votes():
    p = LONG.strip()
    html = f"<body><div>Site</div><p>{p}</p><div>In between.</div><p>{p}</p><p>{p}</p><div><i>a</i><i>b</i><i>c</i><i>d</i></div></body>"
    assert main_text(html) == "\n".join([p, "In between.", p, p])


def test_smoothing_and_clusters_by_hand():
    r = html_text.smooth(np.array([0.0, 0, 9, 0, 0]), 0.5)
    w = np.exp(-2.0 * np.arange(3) ** 2)
    assert np.allclose(r, [9 * w[2] / (1 + w[1] + w[2]), 9 * w[1] / (1 + 2 * w[1] + w[2]), 9 / (1 + 2 * w[1] + 2 * w[2]), 9 * w[1] / (1 + 2 * w[1] + w[2]), 9 * w[2] / (1 + w[1] + w[2])])
    assert html_text.threshold(np.array([1.0, 2, 3, 20, 22])) == 11.5 and html_text.threshold(np.array([4.0])) == 4.0


def test_what_is_aside_stays_out_of_lines():
    p = LONG.strip()
    assert main_text(f"<article><p>{p}<span class=share>Share</span> Last words.</p><p>{p}</p></article>").replace(p, "P") == "P\nLast words.\nP"


def test_deep_and_broken_pages_take_linear_time():
    began = time.time()
    n = 60_000
    for html in ("<div>a" * n, "</b>" * n + "x", "<p>" * n + "x", "<p><div>" + "<i><p>a" * n, "<table>" + "<tr><td>a" * n, "<b>" * n + "</i>" * n):
        assert main_text(html) is not None
    assert time.time() - began < 60


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x", "y", "z")], "page_id long, url string, html string, text string, k0 string, n_chars string")
    assert [tuple(r) for r in html_text.extract_pages(df).collect()] == [(1, "u", "a", 1)]
