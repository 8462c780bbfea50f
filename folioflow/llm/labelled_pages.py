"""Labelled pages of several make-ups, to train the page model on: data-label="1" marks content, "0" what is not."""

from __future__ import annotations

import random

# Each line is a page's body: {h} a heading, {p} paragraphs, {s} a short sentence, {l} a list of links, {w} a word or two, {c} comments.
_BODIES = """
<header class="site-header"><h1>{w}</h1><nav>{l}</nav></header><main data-label="1"><h1>{h}</h1>{p}{p}</main><aside class="sidebar"><h3>{w}</h3>{l}<p>{s}</p></aside><footer><p>© 2020 {s}</p>{l}</footer>
<div id="top-menu">{l}</div><div id="content"><div class="post" data-label="1"><h2>{h}</h2>{p}</div><div class="comments"><h3>{w}</h3>{c}</div></div><div id="footer">{s}</div>
<div class="cookie-notice"><p>{s} {s}</p><button>{w}</button></div><nav class="navbar">{l}</nav><article data-label="1"><h1>{h}</h1>{p}<aside class="related" data-label="0"><h4>{w}</h4>{l}</aside>{p}</article><section id="comments">{c}<form><label>{w}</label><textarea></textarea><button>{w}</button></form></section>
<table><tr><td class="menu">{l}</td><td class="main-text" data-label="1"><h1>{h}</h1>{p}</td><td class="ads"><p>{s}</p></td></tr></table><div class="copyright">© {w}</div>
<div class="wrapper"><div class="masthead"><p>{w}</p></div><div class="story-body" data-label="1"><h1>{h}</h1>{p}<ul><li>{s}</li><li>{s}</li></ul><blockquote><p>{s} {s}</p></blockquote>{p}</div><div class="advertisement"><p>{s} {s}</p></div><div class="newsletter"><p>{s}</p><form><input><button>{w}</button></form></div></div>
<nav><ul><li><a href="/">{w}</a></li></ul></nav><div class="ad">{s}</div><article data-label="1"><h1>{h}</h1>{p}</article><div class="ad">{s} {s}</div><footer>© {w} · {w}</footer>
<div role="navigation">{l}</div><div role="main" data-label="1"><h1>{h}</h1>{p}<h2>{h}</h2>{p}<table><tr><th>{w}</th><th>{w}</th></tr><tr><td>{w}</td><td>{s}</td></tr></table></div><div role="complementary"><h3>{w}</h3><p>{s}</p>{l}</div><div role="contentinfo"><p>{s}</p></div>
<header><p>{w}</p><form class="search"><input><button>{w}</button></form></header><section class="entry-content" data-label="1"><h1>{h}</h1>{p}<pre>{s}</pre><ol><li>{s}</li><li>{s}</li></ol></section><section class="social-share">{l}</section><div class="alert">{s}</div><footer>{l}<p>{s}</p></footer>
<div class="page"><p class="notice">{s}</p><h1 data-label="1">{h}</h1><div data-label="1">{p}</div><div class="related-posts"><h3>{w}</h3>{l}</div><div id="respond"><h3>{w}</h3>{c}</div></div>
<article data-label="1"><h1>{h}</h1>{p}<footer data-label="0"><p>{s}</p></footer><section class="comments" data-label="0"><h2>{w}</h2>{c}</section><form data-label="0"><p>{s}</p><button>{w}</button></form><div class="ad" data-label="0"><p>{s}</p></div><nav data-label="0">{l}</nav></article>
<div class="sidebar"><p>{s}</p><p>{s} {s}</p>{l}</div><main data-label="1"><article><h1>{h}</h1>{p}<div class="notice" data-label="0"><p>{s} {s}</p></div>{p}<div class="comment" data-label="0"><p>{s} {s}</p></div></article></main><aside><p>{s} {s}</p></aside><footer><p>{s} {s}</p></footer>
<nav>{l}</nav><article data-label="1"><h1>{h}</h1>{p}<ul><li>{w}</li><li>{w}</li><li>{w}</li></ul>{p}<figure><img><figcaption>{s}</figcaption></figure>{p}<ol><li>{w}</li><li>{s}</li></ol></article><div class="author-bio"><p>{s} {s}</p></div><footer><p>{s}</p></footer>
<div class="header"><h2>{w}</h2>{l}</div><div class="content" data-label="1"><h1>{h}</h1>{p}<figure><figcaption>{w}</figcaption></figure>{p}<pre>{w} {s}</pre><dl><dt>{w}</dt><dd>{s}</dd></dl><ul><li>{w}</li><li>{w}</li></ul>{p}<div class="author-box" data-label="0"><h4>{w}</h4><p>{s} {s} {s}</p></div></div><div class="sidebar">{l}<p>{s}</p></div>
<main data-label="1"><header data-label="0"><p>{s}</p>{l}</header><article><h1>{h}</h1>{p}{p}</article><div class="ads" data-label="0">{s} {s}</div></main><dialog class="modal"><p>{s} {s}</p></dialog>
""".strip().split("\n")


def labelled_pages(times: int = 6, seed: int = 7) -> list[str]:
    """Each body, several times with other words."""
    rng = random.Random(seed)
    syllables = "ka ro min tel su par den vo lis gra chu ban".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(least: int = 5, most: int = 18) -> str:
        words = [word() for _ in range(rng.randint(least, most))]
        return " ".join(x + "," * (rng.random() < 0.1) for x in words).capitalize().rstrip(",") + "."

    def paragraphs() -> str:
        return "".join(f"<p>{' '.join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 7))))}</p>" for _ in range(rng.randint(1, 5)))

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 4)))}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"

    def comments() -> str:
        return "".join(f'<div class="comment"><p>{sentence()} {sentence()}</p></div>' for _ in range(rng.randint(1, 3)))

    makers = {"{h}": lambda: " ".join(word() for _ in range(rng.randint(3, 9))).capitalize(), "{p}": paragraphs, "{s}": sentence, "{l}": links, "{w}": lambda: " ".join(word() for _ in range(rng.randint(1, 2))), "{c}": comments}
    pages = []
    for body in _BODIES * times:
        for mark, make in makers.items():
            while mark in body:
                body = body.replace(mark, make(), 1)
        pages.append(f"<html><head><title>{word()}</title></head><body>{body}</body></html>")
    return pages
