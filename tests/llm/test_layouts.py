"""Main text of pages laid out as different systems lay them out, written by hand: exact text, and no page comes back empty."""

import pytest

from tracelode.llm import html_text

TITLE = "How the harbour got its second lighthouse"
ONE = "The first lighthouse was built in 1843, after three ships had been lost on the reef within a single winter, and it served for sixty years."
TWO = "When the channel was moved, its light no longer showed the safe way in, and the pilots asked the town for a second one on the northern pier."
THREE = "It took eleven years, two engineers and a good deal of argument before that one was lit. Today both of them still stand, one with a lamp and one without."
MAIN = "\n".join((TITLE, ONE, TWO, THREE))
BODY = f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
ALL = f"<h1>{TITLE}</h1>{BODY}"
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>'

LAYOUTS = {
    "bare article": f"<html><body><article>{ALL}</article></body></html>",
    "body with a sidebar": f'<body class="has-sidebar"><nav>{MENU}</nav><article>{ALL}</article><aside><h3>More</h3>{MENU}</aside></body>',
    "body without a sidebar": f'<body class="single no-sidebar"><nav>{MENU}</nav><article>{ALL}</article></body>',
    "body with open comments": f'<body class="comments-open"><main><article>{ALL}</article></main><footer>© 2021 The Harbour Post</footer></body>',
    "body with scripts ready": f'<body class="navigation-ready js-enabled"><div id="content">{ALL}</div></body>',
    "article with comments": f'<article class="post has-comments">{ALL}</article><div id="comments"><h2>2 comments</h2><p>What a fine story this is, thank you.</p><p>I was there.</p></div>',
    "page in a form": f'<form id="aspnetForm" method="post" action="default.aspx"><input type="hidden" name="v" value="x"><div id="menu">{MENU}</div><div id="content">{ALL}</div><div id="footer">All rights reserved</div></form>',
    "article in a form": f'<form id="f"><article>{ALL}</article></form>',
    "reader view": f'<div id="readerContent">{ALL}</div>',
    "reader body": f'<body id="reader"><header><a href="/">The Harbour Post</a></header><main>{ALL}</main></body>',
    "blog theme": f'<body class="post-template-default single single-post postid-12 logged-out"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Harbour blog</a></p><nav id="site-navigation" class="main-navigation">{MENU}</nav></header><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-12" class="post-12 post type-post status-publish hentry"><header class="entry-header"><h1 class="entry-title">{TITLE}</h1></header><div class="entry-content">{BODY}</div></article></main></div><aside id="secondary" class="widget-area"><section class="widget widget_search"><form class="search-form"><label>Search for:</label><input></form></section></aside></div><footer id="colophon" class="site-footer">Proudly made here</footer></body>',
    "documentation": f'<div class="wy-grid-for-nav"><nav class="wy-nav-side"><div class="wy-menu">{MENU}</div></nav><section class="wy-nav-content-wrap"><div class="rst-content"><div role="navigation"><ul class="wy-breadcrumbs"><li><a href="/">Docs</a></li></ul></div><div role="main" class="document"><section>{ALL}</section></div></div></section></div>',
    "encyclopedia": f'<div id="mw-navigation">{MENU}</div><div id="content" class="mw-body" role="main"><h1 id="firstHeading">{TITLE}</h1><div id="bodyContent"><div id="mw-content-text">{BODY}</div></div></div><div id="footer"><ul><li>This page was last edited in May.</li></ul></div>',
    "tables for layout": f'<table width="100%"><tr><td class="menu" width="150">{MENU}</td><td><h1>{TITLE}</h1>{BODY}</td></tr></table>',
    "news site": f'<div class="top-nav">{MENU}</div><div class="ad-banner">Advertisement</div><article class="story"><h1 class="headline">{TITLE}</h1><div class="story-body">{BODY}</div><div class="social-share"><a href="#">Share</a> <a href="#">Tweet</a></div></article><div class="related-stories"><h3>Related</h3>{MENU}</div>',
    "cookie notice first": f'<div class="cookie-consent"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><main>{ALL}</main>',
    "newsletter after": f'<main><article>{ALL}</article></main><div class="newsletter-signup"><p>Get our stories by mail every week.</p><form><input><button>Sign up</button></form></div>',
    "section by section": f'<main><h1>{TITLE}</h1><section><p>{ONE}</p></section><section><p>{TWO}</p></section><section><p>{THREE}</p></section></main>',
    "wrapper with a side": f'<div id="page" class="sidebar-right"><div class="inner"><article>{ALL}</article><div class="sidebar"><h3>Popular</h3>{MENU}</div></div></div>',
    "with-sidebar": f'<div class="layout with-sidebar"><main>{ALL}</main><aside>{MENU}</aside></div>',
    "old capitals": f"<HTML><BODY BGCOLOR=white><TABLE><TR><TD><H1>{TITLE}</H1><P>{ONE}<P>{TWO}<P>{THREE}</TD></TR></TABLE></BODY></HTML>",
    "unclosed paragraphs": f"<body><nav>{MENU}</nav><article><h1>{TITLE}</h1><p>{ONE}<p>{TWO}<p>{THREE}</article></body>",
    "single page app": f'<div id="root"><div class="App"><header class="App-header"><nav class="navbar">{MENU}</nav></header><div class="page-content"><h1>{TITLE}</h1>{BODY}</div></div></div>',
    "camel case names": f'<div class="siteHeader">{MENU}</div><div class="articleBody">{ALL}</div><div class="siteFooter">Imprint</div>',
    "letters in links": f'<article><h1>{TITLE}</h1><p>{ONE[:40]}<a href="/x">{ONE[40:60]}</a>{ONE[60:]}</p><p>{TWO}</p><p>{THREE}</p></article>',
    "print version": f'<body class="print"><div class="printable">{ALL}</div></body>',
    "tabs on the root": f'<body class="tabs-enabled search-visible"><div class="content">{ALL}</div></body>',
    "popup closed": f'<body class="modal-closed"><article>{ALL}</article><div class="modal popup"><p>Join us today.</p></div></body>',
    "share on the article": f'<article class="with-share">{ALL}</article>',
    "story in a form of two levels": f'<form method="post"><div class="page"><div class="header">The Harbour Post</div><div class="main-column"><article class="story">{ALL}</article></div></div></form>',
    "header in the article": f"<article><header><h1>{TITLE}</h1></header>{BODY}<footer><p>Filed under: history</p></footer></article>",
}


@pytest.fixture(scope="module")
def field():
    return html_text.Field().train()


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(field, name):
    assert field.extract(LAYOUTS[name]) == MAIN


def test_words_of_names():
    named = lambda a: set(html_text._named(a))
    assert named('class="has-sidebar no-comments is-form comments-open"') == set()
    assert named('id="readerContent"') == {"comment", "main"} and named('class="inside outsider formal"') == set()
    assert named('class="sidebar"') == {"side"} and named("class=comment-list") == {"comment"} and named('class="AdBox"') >= {"ad"}


def test_a_long_discussion_is_no_frame(field):
    said = "".join(f'<div class="comment"><p>{ONE} {TWO}</p></div>' for _ in range(30))
    page = f'<body><article>{ALL}</article><section id="comments" class="comments-area">{said}</section></body>'
    assert field.extract(page) == MAIN
