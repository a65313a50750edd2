"""Pages of odd shape: none raises, none is lost, none takes long."""

import random
import time

import pytest

from quarrylog.llm import extract

LONG = "This is a long paragraph of text, with commas and words enough to be read as an article of its own."
SHORT = [f"Short paragraph number {i}, which is text." for i in range(6)]
TEXT = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
WHOLE = f"Title\n{LONG}\n{LONG}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><div class="story">' + "".join(f'<div class="story-widget"><p>{s}</p></div>' for s in SHORT), "\n".join(SHORT)),
        ("<body>" + "".join(f'<div class="related-story"><p>{s}</p></div>' for s in SHORT), "\n".join(SHORT)),
        (f"<html><head><title>x</title><style>a</style><body>{TEXT}", WHOLE),
        (f"<html><head><title>x</title>{TEXT}", WHOLE),
        *((f"<body><h1>Title</h1><{n}>press<p>{LONG}</p><p>{LONG}</p>", WHOLE) for n in ("button", "select", "noscript", "template", "object")),
        (f"<body><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><textarea>open to the end<p>{LONG}", WHOLE),
        (f"<body><form id=page><input type=hidden><div>{TEXT}</div></form></body>", WHOLE),
        (f"<body><div>{TEXT}</div><form><label>name</label><p>{LONG}</p></form></body>", WHOLE),
        (f"<body><aside>{TEXT}", WHOLE),
        (f"<body><aside>{LONG}</aside><div>{TEXT}</div>", WHOLE),
        (f"<body><p>{LONG}<svg><svg>in</svg>still in</svg></p><p>{LONG}</p>", f"{LONG}\n{LONG}"),
        ("<body><h1><a href=x>Only a title</a></h1></body>", "Only a title"),
        (f"<body><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>", f"{LONG} x=1"),
    ],
)
def test_no_text_is_lost(page, text):
    assert extract.main_text(page) == text


def test_tag_soups_neither_raise_nor_take_long():
    rng = random.Random(1)
    tags = "div p span a b article main aside nav form header footer section ul li table tr td h1 h2 svg math button select textarea script style head body title noscript".split()
    classes = ["", "story-widget", "nav", "comments", "related-story", "content", "ad", "market-share"]
    for _ in range(2000):
        parts = []
        for _ in range(rng.randrange(1, 120)):
            r, tag = rng.random(), rng.choice(tags)
            open_ = f'<{tag} class="{rng.choice(classes)}">'
            parts.append(open_ if r < 0.4 else f"</{tag}>" if r < 0.6 else LONG[: rng.randrange(99)] if r < 0.95 else rng.choice(["<", "&amp;", "<!--", "</", '<a href="x']))
        began = time.perf_counter()
        assert isinstance(extract.main_text("".join(parts)), str)
        assert time.perf_counter() - began < 1


@pytest.mark.parametrize(
    "page",
    [
        "<body>" + "".join(f'<div class="story-widget">text {i} of the nested page' for i in range(5000)), "<body>" + "<button>x" * 20000 + f"<p>{LONG}", "<body>" + "<aside>x <article>" * 3000, "<body>" + "<form>x" * 5000,
        "<body>" + "<svg>" * 5000 + "</svg>" * 5000, "<p>" * 20000 + LONG,
    ],
)
def test_deep_pages_take_no_second(page):
    began = time.perf_counter()
    extract.main_text(page)
    assert time.perf_counter() - began < 1
