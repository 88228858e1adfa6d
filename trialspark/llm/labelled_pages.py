"""Labelled pages to learn from: layouts written and labelled by hand, filled with
invented words. Sentences of the main text begin with MARK, which the reader takes out.

A layout's ``{...}`` are filled anew for each page: T title, P paragraph, PP some ``p``,
LI some items, B a sentence of the frame, S a few words of it, A some links as items,
C some readers' comments; ``{role:name}`` a class name for a role.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

MARK = ""

# Names that sites give to the parts of a page.
NAMES = {
    "main": "content main post entry article story body text post-content entry-content article-body page-content main-content mainContent blog-post",
    "menu": "menu nav navigation navbar main-menu topnav nav-links navMenu site-nav topbar links",
    "head": "header head site-header masthead banner-top top logo brand page-header",
    "foot": "footer foot site-footer bottom copyright colophon page-footer legal",
    "side": "sidebar side aside secondary widget widgets right-col rail column-right sideBar",
    "ad": "ad ads advert advertisement adsbox ad-slot sponsored sponsor promo banner adsense commercial",
    "note": "notice cookie-notice cookie cookies gdpr consent alert alert-info warning disclaimer popup modal overlay announcement banner-notice privacy-notice",
    "com": "comments comment commentlist comment-list comment-section discussion replies responses reader-comments disqus",
    "form": "form newsletter signup subscribe search search-form login contact-form newsletter-signup",
    "rel": "related recommended more-stories see-also read-more popular trending related-posts",
    "share": "share social sharing share-buttons social-links tools toolbar",
    "path": "breadcrumb breadcrumbs pagination pager tags tag-list page-nav toc",
}

LAYOUTS = [
    '<html><body><nav><ul>{A}</ul></nav><div class="{ad}">{B}</div><article><h1>{T}</h1>{PP}</article><footer>&copy; {S} {B}</footer></body></html>',
    '<body><header><div class="logo">{S}</div><nav><ul>{A}</ul></nav></header><main><article><h1>{T}</h1>{PP}</article></main><aside><h3>{S}</h3><ul>{A}</ul></aside><footer><p>{B}</p></footer></body>',
    '<body><div id="{head}"><h1>{S}</h1></div><div id="{menu}"><ul>{A}</ul></div><div id="{main}"><h2>{T}</h2>{PP}</div><div id="{side}"><h3>{S}</h3><p>{B}</p><ul>{A}</ul></div><div id="{foot}">{B}</div></body>',
    '<body><div class="container"><div class="row"><div class="col-8 {main}"><h1>{T}</h1>{PP}</div><div class="col-4 {side}"><div class="widget"><h4>{S}</h4><ul>{A}</ul></div><div class="widget"><p>{B}</p></div></div></div></div></body>',
    '<body><header>{S}</header><article><h1>{T}</h1>{PP}</article><section class="{com}"><h3>{S}</h3>{C}</section><footer>{B}</footer></body>',
    '<body><nav>{S}</nav><article class="{main}"><h1>{T}</h1>{PP}<div class="{com}"><h3>{S}</h3>{C}</div></article><footer>{S}</footer></body>',
    '<body><div class="{note}"><p>{B}</p><a href="#">{S}</a></div><header><a href="/">{S}</a></header><main><h1>{T}</h1>{PP}</main><footer><ul>{A}</ul><p>{B}</p></footer></body>',
    '<body><nav><ul>{A}</ul></nav><article><h1>{T}</h1>{PP}<form class="{form}"><p>{B}</p><label>{S}</label><input name="q"></form>{PP}</article><footer>{B}</footer></body>',
    '<body><header><ul class="{menu}">{A}</ul></header><article><h1>{T}</h1>{PP}<aside class="{rel}"><h3>{S}</h3><ul>{A}</ul></aside>{PP}</article><footer>{B}</footer></body>',
    '<body><table><tr><td class="{menu}"><ul>{A}</ul></td><td class="{main}"><h2>{T}</h2>{PP}</td><td class="{side}"><p>{B}</p></td></tr></table><div class="{foot}"><p>{S}</p></div></body>',
    '<body><nav><ul>{A}</ul></nav><main><h1>{T}</h1><section><h2>{T}</h2>{PP}<ul>{LI}</ul></section><section><h2>{T}</h2><ol>{LI}</ol>{PP}</section></main><footer>{B}</footer></body>',
    '<body><div class="{head}">{S}</div><div class="post"><h1 class="post-title">{T}</h1><div class="{main}">{PP}</div><div class="{share}"><a href="#">{S}</a> <a href="#">{S}</a></div></div><ol class="{com}">{CLI}</ol><div class="{foot}">{B}</div></body>',
    '<body><div class="{menu}"><a href="/">{S}</a> | <a href="/">{S}</a> | <a href="/">{S}</a></div><h1>{T}</h1>{PP}<hr><div class="{foot}">{S}</div></body>',
    '<body><header>{S}<nav><ul>{A}</ul></nav></header><article><h1>{T}</h1>{PP}<blockquote><p>{P}</p></blockquote><h2>{T}</h2><pre>{P}</pre><figure><img src="x.png"><figcaption>{T}</figcaption></figure>{PP}</article><footer>{S}</footer></body>',
    '<body><nav><ul>{A}</ul></nav><article><h1>{T}</h1>{PP}<div class="{ad}">{B}</div>{PP}<div class="{ad}"><a href="#">{B}</a></div>{PP}</article><div class="{ad}">{S}</div><footer>{B}</footer></body>',
    '<body><div role="alert" class="{note}">{B}</div><div role="navigation"><ul>{A}</ul></div><div role="main"><h1>{T}</h1>{PP}</div><div role="complementary">{B}</div><div role="contentinfo">{B}</div></body>',
    '<body><header>{S}</header><nav class="{path}"><a href="/">{S}</a> &rsaquo; <a href="/">{S}</a></nav><main><h1>{T}</h1>{PP}<ul class="{path}">{A}</ul></main><div class="{path}"><a href="/">{S}</a></div><footer>{B}</footer></body>',
    '<body><form id="aspnetForm"><div id="{menu}"><ul>{A}</ul></div><div id="{main}"><h1>{T}</h1>{PP}</div><div id="{foot}">{B}</div></form></body>',
    '<body><nav>{S}</nav><article><header><h1>{T}</h1></header>{PP}<footer class="{share}"><a href="#">{S}</a></footer></article><section id="{com}">{C}</section><footer>{B}</footer></body>',
    '<body><div class="{note}" role="dialog"><h2>{S}</h2><p>{B}</p><p>{B}</p></div><div class="page"><div class="{main}"><h1>{T}</h1>{PP}</div><div class="{side}"><h2>{S}</h2><p>{B}</p><ul>{A}</ul></div></div></body>',
    '<body><div class="{head}"><h1>{S}</h1><p>{S}</p></div><div class="{main}">{P}<br><br>{P}<br>{P}</div><div class="{foot}">{S}</div></body>',
    '<body><nav><ul>{A}</ul></nav><main><h1>{T}</h1><dl><dt>{T}</dt><dd>{P}</dd><dt>{T}</dt><dd>{P}</dd></dl><table><tr><th>{T}</th><th>{T}</th></tr><tr><td>{P}</td><td>{P}</td></tr></table>{PP}</main><footer>{B}</footer></body>',
    '<body><div class="{menu}">{S}</div><div class="{ad}">{B}</div><div class="wrapper"><div class="inner"><div class="{main}"><h1>{T}</h1>{PP}<div class="{form}"><p>{B}</p></div>{PP}<div class="{rel}"><h4>{S}</h4><p><a href="#">{S}</a></p><p><a href="#">{S}</a></p></div></div></div></div><div class="{foot}"><p>{B}</p></div></body>',
    '<body><header>{S}</header><article><h1>{T}</h1>{PP}</article><div class="{com}"><h2>{S}</h2><ul><li><p>{B}</p><p>{B}</p></li><li><p>{B}</p></li></ul><form><p>{S}</p></form></div><aside class="{side}"><p>{B}</p></aside></body>',
    '<body><header><h2>{S}</h2><nav><ul>{A}</ul></nav></header><div class="{note}">{B}</div><article><h1>{T}</h1>{PP}<div class="{note}"><p>{B}</p></div></article><aside><p>{B}</p><p>{B}</p></aside><footer><p>&copy; {S}</p></footer></body>',
    '<body><nav><ul>{A}</ul></nav><div><h1>{T}</h1>{PP}</div><section class="{com}"><article class="comment"><p>{B}</p></article><article class="comment"><p>{B}</p></article></section><footer>{B}</footer></body>',
]

SLOT = re.compile(r"\{(\w+)\}")


def _words(rng: random.Random, least: int, most: int) -> str:
    n = int(least * (most / least) ** rng.random() + 0.5)
    return " ".join("".join(rng.choice(("ba", "en", "to", "ri", "sal", "um", "ve", "ok")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentences(rng: random.Random, least: int, most: int) -> str:
    words = _words(rng, least, most).capitalize().split(" ")
    for i in range(6, len(words) - 3, 9):
        words[i - 1], words[i] = words[i - 1] + ".", words[i].capitalize()
    return " ".join(words) + rng.choice(("", ".", ".", ".", ".", ".", "!"))


def _fill(rng: random.Random, slot: str) -> str:
    if slot in NAMES:
        return rng.choice(NAMES[slot].split())
    if slot == "T":
        return MARK + _words(rng, 2, 12).capitalize() + rng.choice(("", "", "."))
    if slot == "P":
        return MARK + _sentences(rng, 1, rng.choice((6, 40, 250)))
    if slot == "PP":
        marks = ("<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p><b>{}<br>", "<p>{} <a href='#'>ba en</a>.</p>")
        return "".join(rng.choices(marks, (12, 2, 1, 1, 1))[0].format(_fill(rng, "P")) for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 12))))
    if slot == "LI":
        return "".join(f"<li>{MARK}{_sentences(rng, 2, 30)}</li>" for _ in range(rng.randint(2, 6)))
    if slot == "A":
        return "".join(f'<li><a href="/{i}">{_words(rng, 1, 3)}</a></li>' for i in range(rng.randint(1, 9)))
    if slot in ("C", "CLI"):
        form = rng.choice(('<div class="comment"><p>{}</p></div>', "<p>{}</p>", '<div class="comment"><b>{}</b><p>{}</p></div>')) if slot == "C" else "<li>{}</li>"
        return "".join(form.replace("{}", _sentences(rng, 3, 60)) for _ in range(rng.randint(1, 5)))
    return _words(rng, 1, 4) if slot == "S" else _sentences(rng, 3, 40)


def pages(of_each: int, seed: int = 11) -> Iterator[str]:
    """``of_each`` pages of every layout."""
    rng = random.Random(seed)
    for layout in LAYOUTS:
        for _ in range(of_each):
            yield SLOT.sub(lambda m: _fill(rng, m[1]), layout)
