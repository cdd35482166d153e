"""Labelled pages for the block tagger: site plans filled with words by a seeded rule.

A plan is written as lines ``label | opening tags | kind | closing tags``. ``main``
blocks are the article; every other block is not. Kinds say what text stands in
a block. Plans differ in their tags, class names and order, as sites do.
"""

from __future__ import annotations

import random

MAIN, OTHER = 1, 0

# The plans. "*" before a label repeats the line some times.
PLANS = (
    """
    o|<nav><ul>||
    *o|<li><a href="/x">|word|</a></li>
    o|</ul></nav>||
    o|<div class="ad">|line|</div>
    m|<article><h1>|title|</h1>
    *m|<p>|para|</p>
    o|</article><footer>|legal|</footer>
    """,
    """
    o|<header><h2>|title|</h2><p>|line|</p></header>
    *o|<nav><a href="#">|word|</a></nav>
    m|<main><h1>|title|</h1>
    *m|<p><b>|para|</b></p>
    *m|<ul><li>|line|</li></ul>
    *m|<blockquote><p>|para|</p></blockquote>
    o|</main><aside class="sidebar"><h3>|word|</h3>
    *o|<p>|line|</p>
    *o|<ul><li><a href="/r">|line|</a></li></ul>
    o|</aside><footer><p>|legal|</p></footer>
    """,
    """
    o|<div id="top" class="masthead"><span>|word|</span></div>
    *o|<div class="menu"><a href="/m">|word|</a></div>
    o|<div class="breadcrumb"><a href="/">|word|</a></div>
    m|<div id="content"><h1>|title|</h1>
    *m|<div class="entry"><p>|para|</p></div>
    m|<h2>|title|</h2>
    *m|<p>|para|</p>
    o|</div><div class="share"><a href="/s">|word|</a></div>
    o|<div id="comments"><h3>|word|</h3>
    *o|<div class="comment"><p>|para|</p></div>
    o|</div><div class="footer"><p>|legal|</p></div>
    """,
    """
    o|<div class="cookie-notice" role="dialog"><p>|line|</p><div><a href="#">|word|</a></div></div>
    o|<header role="banner"><a href="/">|word|</a></header>
    *o|<ul role="navigation"><li><a href="/n">|word|</a></li></ul>
    m|<div class="post"><h1>|title|</h1>
    *m|<p>|para|</p>
    m|<table><tr><td>|line|</td></tr></table>
    *m|<p>|para|</p>
    o|</div><form action="/subscribe"><label>|line|</label><p>|line|</p></form>
    *o|<section class="related"><h4>|title|</h4><p>|line|</p></section>
    o|<section class="comments"><p>|para|</p><p>|para|</p></section>
    o|<footer role="contentinfo"><p>|legal|</p></footer>
    """,
    """
    o|<div class="alert notice">|line|</div>
    o|<div class="sponsored promo"><p>|para|</p></div>
    m|<section class="story"><h1>|title|</h1>
    *m|<p>|para|</p>
    o|<div class="advert"><p>|line|</p></div>
    *m|<p>|para|</p>
    m|<pre>|line|</pre>
    o|</section><div class="widget"><h4>|word|</h4><ul><li><a href="/w">|line|</a></li></ul></div>
    *o|<div class="reply"><p>|para|</p></div>
    o|<p class="copyright">|legal|</p>
    """,
    """
    *m|<p>|para|</p>
    m|<p>|line|</p>
    """,
    """
    o|<nav><ul><li><a href="/">|word|</a></li><li><a href="/b">|word|</a></li></ul></nav>
    m|<article><header><h1>|title|</h1></header>
    *m|<section><h2>|title|</h2><p>|para|</p></section>
    *m|<p>|line|</p>
    m|<figure><figcaption>|line|</figcaption></figure>
    o|<aside><p>|para|</p></aside>
    *m|<p>|para|</p>
    o|<section id="comments"><article class="comment"><p>|para|</p></article></section>
    o|</article><footer><ul><li><a href="/c">|word|</a></li></ul><p>|legal|</p></footer>
    """,
)


def _words(draw: random.Random, n: int) -> str:
    letters = ("a", "e", "i", "o", "u", "an", "er", "in", "on", "th", "st", "re", "nd")
    return " ".join("".join(draw.choices(letters, k=draw.randint(1, 4))) for _ in range(n))


def _fill(draw: random.Random, kind: str) -> str:
    if kind == "word":
        return _words(draw, draw.randint(1, 2))
    if kind == "title":
        return _words(draw, draw.randint(2, 12)).capitalize()
    if kind == "line":
        return _words(draw, draw.randint(1, 14)).capitalize() + draw.choice((".", ".", "", "!"))
    if kind == "legal":
        return f"© {draw.randint(1990, 2030)} {_words(draw, draw.randint(1, 8))}"
    sentences = (_words(draw, draw.randint(1, 25)).capitalize() + "." for _ in range(draw.choice((1, 1, 2, 4, 8))))
    return " ".join(sentences)


def labelled_pages(count: int = 210, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(block text, label)]) of each page, the same for the same arguments."""
    draw = random.Random(seed)
    out = []
    for number in range(count):
        html, blocks = ["<!DOCTYPE html><html><head><title>x</title></head><body>"], []
        for line in PLANS[number % len(PLANS)].strip().splitlines():
            fields = line.strip().split("|")
            label, again = (fields[0][1:], draw.randint(0, 7)) if fields[0].startswith("*") else (fields[0], 1)
            for _ in range(again):
                for at in range(1, len(fields) - 1, 2):
                    html.append(fields[at])
                    if fields[at + 1]:
                        text = _fill(draw, fields[at + 1])
                        html.append(text)
                        blocks.append((text, MAIN if label == "m" else OTHER))
                html.append(fields[-1])
        out.append(("".join(html) + "</body></html>", blocks))
    return out
