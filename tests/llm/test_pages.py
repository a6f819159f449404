"""Pages of layouts that the labeller was not trained on, every block labelled by hand (1: main text)."""

import time

from tidemark.llm import html_text

PAGES = {
    "news": """<!doctype html><html><head><title>Bridge</title><style>p{}</style></head><body><div id="top-strip"><a href="/">The Daily Ledger</a></div>
<div role="navigation"><a href=1>World</a> <a href=2>Politics</a> <a href=3>Sport</a></div>
<div class="story-body"><h1>Old bridge reopens after two years</h1><p class="byline">By A. Writer, 3 May</p>
<p>The stone bridge over the river reopened on Monday after repairs that took two years and cost four million.</p>
<p>Engineers replaced the deck and strengthened the piers, which had been damaged by floods in the spring of the year before.</p>
<p>"We are glad to have it back," said a resident who crosses it every day on the way to work.</p></div>
<div class="most-read"><h3>Most read</h3><ol><li><a href=4>Storm warning issued</a><li><a href=5>Team wins again</a></ol></div>
<div id="foot">© The Daily Ledger. All rights reserved.</div></body></html>""",
    "table": """<html><body bgcolor=white><table width=100%><tr><td colspan=2><a href=/>Home</a> | <a href=/faq>FAQ</a> | <a href=/mail>Contact</a></td></tr>
<tr><td width=120><a href=1>Archive</a><br><a href=2>Links</a></td><td><h2>Notes on keeping bees</h2>
<p>Bees need water close to the hive in summer, and a shallow dish with stones will do for a small colony.</p>
<p>In autumn the entrance is made narrower, so that wasps find it harder to get in and rob the stores.</p></td></tr>
<tr><td colspan=2><font size=1>Copyright 2001. Last updated in June.</font></td></tr></table></body></html>""",
    "wiki": """<html><body><div id="mw-head"><ul><li><a>Log in</a><li><a>Create account</a></ul></div><div id="mw-panel"><ul><li><a>Main page</a><li><a>Random page</a></ul></div>
<div id="bodyContent" class="content"><h1>Granite</h1><p>Granite is a coarse-grained rock composed mostly of quartz, alkali feldspar, and plagioclase.</p>
<p>It forms from magma with a high content of silica that slowly cools and solidifies underground.</p><h2>Uses</h2>
<ul><li>Paving stones and kerbs in many towns of Europe.</li><li>Worktops, since it resists heat and scratches well.</li></ul></div>
<div id="footer"><ul><li>This page was last edited in May.<li><a>Privacy policy</a><li><a>About</a></ul></div></body></html>""",
    "docs": """<html><body><header><a>Project</a><form><input><button>Search</button></form></header><div class="layout"><nav class="toc"><ul><li><a>Install</a></li><li><a>Usage</a></li></ul></nav>
<main><h1>Usage</h1><p>Call the function with a path and it returns the parsed document as a tree of nodes.</p><pre>tree = parse("file.txt")</pre>
<p>Errors are raised with the line on which they were found, so that editors can jump to it.</p></main></div><footer><p>Built with a generator</p></footer></body></html>""",
    "blog": """<html><body><div class="cookie-bar">We use cookies. <a>Accept</a></div><div class="hentry"><h2 class="entry-title">A week without a phone</h2>
<div class="entry-content"><p>It started as a bet with my sister, who thought that I would not last until Wednesday.</p><p>The first two days were the hardest, because every queue and every lift seemed endless.</p>
<div class="share-buttons"><a>Tweet</a> <a>Like</a></div><p>By Friday I had read two books and slept better than in months.</p></div></div>
<div id="comments"><h3>2 comments</h3><ol><li><p>Great post, thank you for sharing it with us!</p></li><li><p>I could never do that, I need mine for work.</p></li></ol></div>
<div class="widget"><h4>Subscribe</h4><p>Get new posts by mail</p></div></body></html>""",
    "recipe": """<html><body><section class="promo"><p>Save 20% on pans today</p></section><article itemscope><h1>Lentil soup</h1><p>A warming soup for cold evenings that takes half an hour and one pot.</p>
<h2>Ingredients</h2><ul><li>200 g of red lentils</li><li>1 onion, chopped fine</li></ul><h2>Method</h2><ol><li>Soften the onion in oil over a low heat for ten minutes.</li><li>Add the lentils and a litre of stock, and simmer until soft.</li></ol></article>
<aside><h3>You may also like</h3><ul><li><a>Tomato soup</a></li></ul></aside></body></html>""",
    "forum": """<html><body><div class=navbar><a>Board index</a> <a>Members</a></div><div class=post-text><p>The pump makes a grinding noise when it starts in the morning, but it goes away after a minute or so.</p>
<p>I have cleaned the filter and checked the oil, and both look fine to me, so what else could cause it?</p></div><div class=copyright>Powered by a board</div></body></html>""",
    "plain": """<html><body><h1>Minutes of the meeting</h1><p>The chair opened the meeting at seven and welcomed the new members.<p>The accounts for the year were presented and approved without a vote against.<p>The next meeting will be held in the autumn, on a date to be announced.</body></html>""",
}
#: The blocks that are not main text, by how they begin.
OTHER = """The Daily Ledger|World Politics|By A. Writer|Most read|Storm warning|Team wins|© The Daily|Home | FAQ|Archive Links|Copyright 2001|Log in|Create account|Main page|Random page|This page was last|Privacy policy|About|
Project|Install|Built with|We use cookies|Tweet Like|2 comments|Great post|I could never|Subscribe|Get new posts|Save 20%|You may also|Tomato soup|Board index|Powered by""".replace("\n", "").replace("Home | FAQ", "Home").split("|")


def test_foreign_pages():
    model = html_text.trained()
    pages = [html_text.blocks(p) for p in PAGES.values()]
    right = wrong = missed = 0
    for page, z in zip(pages, model.logits(pages), strict=True):
        for (text, _, _), x in zip(page, z, strict=True):
            main = not text.startswith(tuple(OTHER))
            right, wrong, missed = right + (main and x > 0), wrong + (not main and x > 0), missed + (main and x <= 0)
    assert 2 * right / (2 * right + wrong + missed) >= 0.85, (right, wrong, missed)


def test_hostile_pages_take_linear_time():
    for unit in ("<a ", "<div>", "<div>x", "<b><p>x", '<a "', "<!--", "<", "<i></div>", "<ul><li>x"):
        began = time.time()
        html_text.blocks(unit * (1_000_000 // len(unit)))
        assert time.time() - began < 10, unit


def test_hidden_elements_end_with_their_parent():
    texts = [b[0] for b in html_text.blocks("<p>a<svg/>b<svg><text>no</text></svg>c<button>x</button>d</p><div><select><option>no</div><p>e &amp;&nbsp; f<title-bar>g</title-bar>")]
    assert texts == ["abcd", "e & fg"]


def test_pages_of_every_kind(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, PAGES["news"], "u"), (3, PAGES["news"], "u"), (None, "<p>" + "word " * 200_000, "u")]
    d = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html_text.extract(d).collect()
    assert len(got) == 5 and html_text.extract(d.limit(0)).count() == 0
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3].startswith("Old bridge reopens") and "Ledger" not in by[3]
    assert set(html_text.extract(d).columns) == {"page_id", "html", "text"}
