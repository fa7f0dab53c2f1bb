"""Labelled pages that the block classifier learns from.

Blocks inside an element marked ``data-main`` are content. The attribute is
read here only; the extraction doesn't know it.
"""

SENTENCE = "The council met on Tuesday and agreed to repair the old bridge before the winter comes."
OTHER = "Engineers said the work would take about six weeks, and cost less than last year."
QUOTE = "\"We waited long for this,\" said the mayor."

MENU = "<ul><li><a href=1>Home</a></li><li><a href=2>World news</a></li><li><a href=3>Local</a></li><li><a href=4>About us</a></li></ul>"
LINKS = "<h3>More stories</h3><ul><li><a href=1>Five bridges you have to see this summer</a></li><li><a href=2>What the budget means for you.</a></li></ul>"
SAID = "<div class=author>Anna</div><p>I drive there each day and I am glad that they do this at last.</p><p>Me too!</p>"

PAGES = [
    f"<nav>{MENU}</nav><article data-main><h1>Old bridge to be repaired</h1><p>{SENTENCE}</p><p>{OTHER}</p><p>{QUOTE}</p></article><footer><p>Copyright by the paper. All rights reserved, as they are each year.</p></footer>",
    f"<div id=header><a href=/>The Paper</a></div><div class=menu>{MENU}</div><div class=content data-main><h1>Bridge</h1><p>{SENTENCE}</p><p>Yes.</p><p>{OTHER} {SENTENCE}</p></div><div class=sidebar>{LINKS}</div><div id=footer>Imprint</div>",
    f"<div class=top-bar>Call us today: 555 1234</div><div class=cookie-banner><p>We use cookies so that this site works well for you, and you may refuse them.</p><a href=x>Accept</a></div><main data-main><h2>Notes</h2><p>{OTHER}</p><ul><li>The deck is replaced first.</li><li>Cars must turn</li></ul><p>{SENTENCE}</p></main><aside>{LINKS}</aside>",
    f"<div class=wrap><div data-main><p>{SENTENCE} {OTHER}</p><p>{OTHER} {SENTENCE}</p><blockquote>{QUOTE}</blockquote><p>Short one.</p></div><div>{MENU}</div><div class=ad>Buy two cars and pay for one, only today!</div></div>",
    f"<article data-main><header><h1>Bridge</h1></header><p>{SENTENCE}</p><p>See <a href=m>the map</a> for more.</p><p>{OTHER}</p></article><section id=comments><h2>3 comments</h2>{SAID}{SAID}</section><form><label>Mail</label><button>Send</button><p>Tell us what you think of it, and we will answer soon.</p></form>",
    f"<div class=post><div class=entry-content data-main><h2>Why</h2><p>{SENTENCE}</p><pre>load = 4 * span</pre><p>{OTHER}</p></div><div class=post-share>Share this on the networks that you like.</div><div class=related-posts>{LINKS}</div><div class=comment-list>{SAID}</div></div>",
    f"<section class='story search-result' data-main><h1>Bridge</h1><p>{SENTENCE}</p><p>{OTHER}</p><p>{SENTENCE}</p></section><div class=newsletter-signup><p>Get the news by mail each morning. It costs nothing and you can leave at any time.</p></div><div class=pagination><a href=2>Next</a> <a href=3>Last</a></div>",
    f"<div class='story banner-image' data-main><p>{SENTENCE}</p><p>{OTHER} {OTHER}</p></div><div class=promo><h3>Offer</h3><p>Read for one coin a month, and stop whenever you want.</p></div><div role=navigation>{MENU}</div><div role=contentinfo><p>The paper has been printed here since 1901.</p></div>",
    f"<table><tr><td>{MENU}</td><td data-main><p>{SENTENCE}</p><p>{OTHER}</p><p>It rains.</p></td></tr></table><center><a href=1>Contact</a> | <a href=2>Terms</a></center>",
    f"<div><a href=1>Home</a> &gt; <a href=2>News</a></div><h1 data-main>Bridge is closed</h1><div data-main><p>{SENTENCE}</p><h2>What comes next</h2><p>{OTHER}</p><p>{QUOTE}</p></div><p><a href=1>Terms</a> <a href=2>Contact</a> <a href=3>Jobs</a></p>",
    f"<article data-main><h1>Bridge</h1><p>{SENTENCE}</p></article><article><aside>{LINKS}<p>{SENTENCE}</p></aside><footer><h2>About</h2><p>{OTHER}</p></footer><nav>{MENU}</nav></article>",
    f"<form><div class=nav>{MENU}</div><div data-main><h1>Bridge</h1><p>{SENTENCE}</p><p>{OTHER}</p><p>{SENTENCE}</p></div><form><label>Name</label><p>Tell us your name, and we will write to you.</p><button>Go</button></form></form>",
    f"<div class=main data-main><h1>Bridge</h1><p>{SENTENCE}</p><p>{OTHER}</p><p>{SENTENCE}</p></div><div class=social-icons><p>Follow us</p></div><div class=share-buttons>Tell a friend about it.</div><div class=sponsored-brand><p>Tyres of the best kind, for each car.</p></div><div class=footer-legalese>All prices are given with taxes.</div>",
    f"<div class=notice><p>This site moves to a new home on Friday, and some pages may be slow.</p></div><section data-main><h2>Bridge</h2><p>{SENTENCE}</p><div>{OTHER}</div><p>So it is.</p></section><div id=disqus><h3>What readers say</h3>{SAID}</div><footer><h3>Our paper</h3><p>{SENTENCE}</p></footer>",
]
