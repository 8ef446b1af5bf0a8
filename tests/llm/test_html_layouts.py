"""Pages in layouts of all kinds, told to the extractor in no way: the article comes out, and never an empty text."""

import itertools

import numpy as np
import pytest

from skein.llm import html_text

P = [
    "The ferry left the harbour at six, long before the fog had lifted from the water.",
    "Nobody spoke much, and the engine, which was older than the captain, kept its slow beat.",
    "By noon the islands came into view, low and grey, with a line of surf along their western side.",
    "We landed, paid, and walked up the hill to the only house that had its lamps lit.",
]
ART = "".join(f"<p>{x}</p>" for x in P)
TEXT = "\n".join(P)
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = "<footer>&copy; 2020 Someone, all rights kept</footer>"

WHOLE = {
    "plain div": f"<body>{NAV}<div>{ART}</div>{FOOT}</body>",
    "bare body": f"<body>{ART}</body>",
    "bare body between": f"<body>{NAV}{ART}{FOOT}</body>",
    "two divs": f"<body><div><div>{ART}</div></div></body>",
    "three divs": f"<body>{NAV}<div><div><div>{ART}</div></div></div>{FOOT}</body>",
    "section": f"<body><section>{ART}</section></body>",
    "section between": f"<body>{NAV}<section>{ART}</section>{FOOT}</body>",
    "table cell": f"<body>{NAV}<table><tr><td>{ART}</td></tr></table></body>",
    "related-work": f'<body>{NAV}<article class="related-work">{ART}</article>{FOOT}</body>',
    "comments-open": f'<body>{NAV}<main class="single-column comments-open">{ART}</main>{FOOT}</body>',
    "data-id": f'<body>{NAV}<article data-id="comments-7">{ART}</article>{FOOT}</body>',
    "data-role": f'<body>{NAV}<article data-role="sidebar">{ART}</article>{FOOT}</body>',
    "data-test-id": f'<body>{NAV}<article data-test-id="related-post">{ART}</article>{FOOT}</body>',
    "main data-id": f'<body>{NAV}<main data-id="comments-7">{ART}</main>{FOOT}</body>',
    "div data-id": f'<body>{NAV}<div class="content" data-id="comments-7">{ART}</div>{FOOT}</body>',
    "data-class": f'<body>{NAV}<div data-class="ad">{ART}</div>{FOOT}</body>',
    "body class": f'<body class="has-sidebar comments-open footer-dark"><article>{ART}</article>{FOOT}</body>',
    "single quotes": f"<body>{NAV}<div class='post'>{ART}</div>{FOOT}</body>",
    "unquoted": f"<body>{NAV}<div class=entry id=x>{ART}</div>{FOOT}</body>",
    "no ends": f"<body>{NAV}<div>" + "".join(f"<p>{x}" for x in P),
    "main in div": f"<body>{NAV}<div><main>{ART}</main></div>{FOOT}</body>",
    "article in section": f"<body><section><article>{ART}</article></section>{FOOT}</body>",
    "comments behind": f'<body>{NAV}<article>{ART}</article><div class="comments"><p>Nice one, thank you for it.</p></div>{FOOT}</body>',
    "sidebar behind": f'<body><div>{ART}</div><aside class="sidebar"><h3>More</h3><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></aside></body>',
    "cookie before": f'<body><div class="cookie-banner"><p>We use cookies, please agree.</p><button>ok</button></div><article>{ART}</article></body>',
    "upper case": f"<BODY><DIV CLASS=Content>{ART}</DIV></BODY>".replace("<p>", "<P>").replace("</p>", "</P>"),
    "review-article": f'<body>{NAV}<div class="review-article">{ART}</div>{FOOT}</body>',
    "links at the top": f'<body><div><a href="/">Home</a> <a href="/n">News</a></div><div>{ART}</div></body>',
    "one paragraph": f"<p>{' '.join(P)}</p>",
    "plain text": " ".join(P),
    "text in body": f"<html><body>{' '.join(P)}</body></html>",
    "main and odd class": f'<body><main class="legal-text">{ART}</main></body>',
    "wrapper": f'<body>{NAV}<div id="page"><div class="wrapper"><div>{ART}</div></div></div>{FOOT}</body>',
    "form behind": f"<body><article>{ART}</article><form><p>Write to us</p><input name=q></form></body>",
}


def text(html):
    page = html_text.Page(html)
    return html_text.main_text(page, html_text.trained().log_odds(page.features()))


def test_layouts():
    assert len(WHOLE) >= 30
    wrong = [k for k, html in WHOLE.items() if text(html) not in (TEXT, " ".join(P))]
    assert len(wrong) <= 2, wrong
    assert not [k for k, html in WHOLE.items() if not text(html)]


def test_headings_stay_with_their_paragraphs():
    for html in (f"<body><h1>The ferry</h1>{ART}{ART}</body>", f"<body>{NAV}<div><h1>The ferry</h1>{ART}</div>{FOOT}</body>", f"<body>{NAV}<section><h2>The ferry</h2>{ART}</section></body>"):
        assert text(html).startswith("The ferry\n" + TEXT)


@pytest.mark.parametrize("tag", ["div", "section", "article", "main", "td", "span", "center"])
@pytest.mark.parametrize("name", ["", "comments", "ad", "sidebar", "x", "related-work", "footer"])
def test_prose_never_gives_an_empty_text(tag, name):
    got = text(f'<body><{tag} class="{name}">{ART}</{tag}></body>')
    assert got and (P[1] in got or name in ("comments", "ad", "sidebar", "footer"))  # a page of comments alone may lose some


def test_pages_without_prose_stay_empty():
    assert text(f"<body>{NAV}{FOOT}</body>") == ""
    assert text(f"<body>{NAV}<footer>{ART}</footer></body>") == ""


def test_attributes_are_whole_names():
    page = html_text.Page('<div data-id="ad" xclass="nav" class = "story" ID=\'comments\' data-x=1 hidden><p id=a>t</p></div>')
    assert page.kinds[1] == [1, 0, 0, 0, 1, 0, 0] and page.hidden[1] == 1
    assert html_text.Page('<div data-hidden="1" aria-hidden="false"><p>t</p></div>').hidden[1] == 0


def test_decoding_against_all_labellings():
    """On small trees the decoder finds the best of all labellings without a contradiction."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        page = html_text.Page("")
        page.tag, page.parent = ["div"] * n, [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        odds = rng.normal(0, 3, n)
        gain = lambda label: sum(-np.logaddexp(0, -o) if x else -np.logaddexp(0, o) for x, o in zip(label, odds))
        legal = [x for x in itertools.product([False, True], repeat=n) if all(not x[k] or x[page.parent[k]] for k in range(1, n))]
        assert gain(page._decode(odds)) == pytest.approx(max(map(gain, legal)))
