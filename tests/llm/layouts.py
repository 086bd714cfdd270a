"""Page layouts written by hand, apart from the made training pages. Guillemets mark the article's blocks, one pair a block."""

HEAD = "<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>A title – Some site</title><script>window.x={a:'<p>'}</script></head>"

LAYOUTS = {
    "wordpress": HEAD + """<body class="home single"><a class="skip-link" href="#content">Skip to content</a><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">The Garden Log</a></p></div><nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/about">About</a></li></ul></nav></header><main id="primary" class="site-main"><article id="post-12" class="post type-post"><h1 class="entry-title">«Planting garlic in autumn»</h1><div class="entry-content"><p>«Garlic wants cold weather before it splits into cloves.»</p><p>«Plant it <em>pointed end up</em>, two inches deep.»</p><ul><li>«Loosen the soil.»</li><li>«Mulch with straw.»</li></ul></div></article><section id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>I tried this and it works well.</p></li></ol></section></main><aside id="secondary" class="widget-area"><section class="widget"><h2>Recent Posts</h2><ul><li><a href="/1">Leeks</a></li></ul></section></aside><footer id="colophon"><div class="site-info">Proudly powered by software</div></footer></body></html>""",
    "bare": "<h1>«My trip»</h1><p>«We left at dawn and drove north for six hours.»<p>«The lake was frozen.»",
    "plain body": "<html><body><p>«Nothing here but a single paragraph of text, which is the whole page.»</p></body></html>",
    "news": HEAD + """<body><div class="top-bar"><a href=/login>Log in</a> <a href=/sub>Subscribe</a></div><div class="ad-slot">Advertisement</div><nav class="sections"><a href=/w>World</a> <a href=/b>Business</a> <a href=/s>Sports</a></nav><article class="story"><h1>«Harbour bridge to close for a month»</h1><div class="byline">By A. Writer</div><p>«The city will close the harbour bridge from Monday, officials said.»</p><p>«Traffic will be sent through the tunnel.»</p><div class="ad">Buy a new car today.</div><p>«Repairs were put off twice last year.»</p></article><div class="related"><h3>More on this</h3><ul><li><a href=/1>Tunnel reopens after flood</a></li><li><a href=/2>Mayor on roads</a></li></ul></div><footer><p>© 2020 The Paper</p></footer></body></html>""",
    "wiki": HEAD + """<body><div id="mw-navigation" class="nav"><ul><li><a href=/m>Main page</a></li><li><a href=/r>Random</a></li></ul></div><div id="content"><h1 id="firstHeading">«Basalt»</h1><div id="bodyContent"><p>«<b>Basalt</b> is a dark volcanic rock that forms when lava cools fast.»</p><h2>«Uses»</h2><p>«It is used in construction and as cobblestones.»</p></div></div><div id="footer"><ul><li>This page was last edited in May.</li></ul></div></body></html>""",
    "docs": HEAD + """<body><div class="sidebar" role="navigation"><h3>Contents</h3><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div><div class="body" role="main"><h1>«Getting started»</h1><p>«Install the tool with the package manager of your system.»</p><pre>«run setup --all»</pre><h2>«Configuration»</h2><p>«Options are read from a file in the working directory.»</p></div><div class="footer">Copyright 2019, The authors.</div></body></html>""",
    "table layout": """<html><body bgcolor=white><table width=100%><tr><td class=menu><a href=a.htm>Home</a><br><a href=b.htm>Links</a></td><td class=content><h2>«The old mill»</h2><p>«The mill was built by two brothers and burned down after a storm.»<p>«Its walls are still standing.»</td></tr></table><div class=footer>Copyright by the society</div></body></html>""",
    "main only": HEAD + """<body><header><nav><a href=/>Home</a> <a href=/c>Contact</a></nav></header><main><h1>«Notes on sleep»</h1><p>«Sleep comes in cycles of about ninety minutes.»</p><blockquote>«Rest is not idleness.»</blockquote><p>«Older people wake more often.»</p></main><footer><p>All rights reserved.</p></footer></body></html>""",
    "cookie bar first": HEAD + """<body><div id="cookie-consent" class="banner">We use cookies to improve your visit. <button>Accept</button></div><article><h1>«A short guide to knots»</h1><p>«The bowline makes a loop that doesn't slip.»</p><p>«Pull both ends to set it.»</p></article></body></html>""",
    "newsletter inside": HEAD + """<body><article><h1>«Bread with rye»</h1><p>«Rye flour holds more water than wheat flour does.»</p><form class="newsletter" action="/s"><p>Get recipes by mail</p><input type=email><button>Sign up</button></form><p>«Bake it at high heat for an hour.»</p></article></body></html>""",
    "share buttons": HEAD + """<body><main><article><h1>«Why rivers bend»</h1><ul class="share-buttons"><li><a href=#>Share</a></li><li><a href=#>Tweet</a></li></ul><p>«Water flows faster on the outside of a curve, and it cuts into the bank.»</p><p>«On the inside sand is left behind.»</p></article></main></body></html>""",
    "comments as articles": HEAD + """<body><article class="post"><h1>«Fixing a bicycle chain»</h1><p>«Turn the bicycle over and find the broken link.»</p></article><div class="comments"><article class="comment"><p>Thanks, this saved my ride home.</p></article><article class="comment"><p>You forgot to say which tool to use.</p></article></div></body></html>""",
    "breadcrumb": HEAD + """<body><div class="breadcrumb"><a href=/>Home</a> &gt; <a href=/h>Health</a></div><div class="content"><h1>«Drinking water»</h1><p>«Most adults need about two litres a day.»</p><p>«More when it is hot.»</p></div><div class="tags"><a href=/t/1>water</a> <a href=/t/2>health</a></div></body></html>""",
    "unclosed head": "<html><head><title>x</title><meta name=a content=b><h1>«Ferry times»</h1><p>«The ferry leaves every hour from the east pier until nine.»",
    "script with end in string": HEAD + """<body><script>var a = "<!-- "; document.write("<p class='");</script><article><h1>«Owls»</h1><p>«Owls turn their heads because their eyes can't move.»</p></article></body></html>""",
    "sections": HEAD + """<body><div class="wrapper"><section class="hero"><h2>Welcome to our blog</h2></section><section class="post-content"><h1>«Learning to swim late»</h1><p>«I was forty when I first put my head under water.»</p><p>«The teacher laughed, but kindly.»</p></section><section class="widget"><h3>Popular</h3><ul><li><a href=/1>Ten pools</a></li><li><a href=/2>Goggles</a></li></ul></section></div></body></html>""",
    "no classes": "<html><body><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><article><h1>«Salt»</h1><p>«Salt was once so dear that soldiers were paid in it.»<p>«Today it is spread on roads.»</article><aside><p>Find us on the map</p></aside><footer><p>Imprint</p></footer></body></html>",
    "entities": "<article><h1>«Fish &amp; chips»</h1><p>«It costs &pound;5 &ndash; or less &mdash; in caf&eacute;s.»</p></article><footer>&copy; The shop</footer>",
    "hidden menu": HEAD + """<body><div class="mobile-menu" style="display:none"><a href=/>Home</a><a href=/x>Shop</a></div><div id="main-content"><h1>«Winter tyres»</h1><p>«Change them when it is colder than seven degrees in the morning.»</p></div></body></html>""",
    "definition list": HEAD + """<body><nav><a href=/>Start</a></nav><article><h1>«Terms»</h1><dl><dt>«Keel»</dt><dd>«The lowest beam of a ship, along its whole length.»</dd><dt>«Stern»</dt><dd>«The back of a ship.»</dd></dl></article></body></html>""",
    "data table": HEAD + """<body><main><h1>«Rainfall»</h1><p>«The table has the rain of three towns in millimetres.»</p><table><tr><th>«Town»</th><th>«Rain»</th></tr><tr><td>«North»</td><td>«812»</td></tr></table></main><footer>Contact us</footer></body></html>""",
    "paywall": HEAD + """<body><article><h1>«The price of copper»</h1><p>«Copper rose for the fifth week as mines in the south closed.»</p></article><div class="paywall"><p>Subscribe to read more stories like this.</p><a href=/s>See offers</a></div></body></html>""",
    "author box": HEAD + """<body><article><h1>«Letters from a lighthouse»</h1><p>«The light must be lit before the sun is down, whatever the weather.»</p></article><div class="author-bio"><p>Jo lives on an island with two dogs.</p></div></body></html>""",
    "german": """<html lang=de><body><header><a href=/>Startseite</a></header><main><h1>«Über das Wandern»</h1><p>«Wer früh aufbricht, hat den Weg für sich allein.»</p><p>«Gute Schuhe sind wichtiger als ein teurer Rucksack.»</p></main><footer><a href=/i>Impressum</a></footer></body></html>""",
    "figure": HEAD + """<body><article><h1>«A new species of frog»</h1><figure><img src=f.jpg><figcaption>«The frog is no longer than a thumbnail.»</figcaption></figure><p>«It was found in a valley that had never been mapped.»</p></article><div class="sidebar"><h4>Trending</h4><ul><li><a href=/1>Bats</a></li><li><a href=/2>Newts</a></li></ul></div></body></html>""",
    "pager": HEAD + """<body><article><h1>«Part two of the story»</h1><p>«In the morning the snow had covered the tracks.»</p></article><div class="pagination"><a href=/1>Previous</a> <a href=/3>Next</a></div></body></html>""",
    "noscript": HEAD + """<body><noscript>Please turn on scripts to see this site.</noscript><article><h1>«Tin»</h1><p>«Tin melts at a low heat and was used for plates.»</p></article></body></html>""",
    "login": HEAD + """<body><header><form id="login"><label>Name <input></label><button>Sign in</button></form></header><article><h1>«Making ink»</h1><p>«Oak galls give a black ink that lasts for centuries.»</p><p>«Add iron and gum.»</p></article></body></html>""",
    "related inside": HEAD + """<body><article><h1>«On kites»</h1><p>«A kite needs a tail only if it is flat.»</p><aside class="related"><h4>Read also</h4><ul><li><a href=/1>On balloons</a></li></ul></aside><p>«Silk flies better than paper.»</p></article></body></html>""",
    "medium": HEAD + """<body><div id="root"><nav><a href=/>Open app</a><a href=/s>Sign in</a></nav><article><section><h1>«What I learned from failing»</h1><p>«Last year my company closed, and I was relieved.»</p><h3>«Ask early»</h3><p>«I asked for help when it was too late.»</p></section></article><footer><p>Follow me for more</p></footer></div></body></html>""",
    "promo": HEAD + """<body><main class="content"><h1>«Cleaning a cast iron pan»</h1><p>«Never put it in the dishwasher, and dry it at once.»</p><div class="promo-box"><p>Our shop has pans from 20 euros.</p></div><p>«Rub it with oil while it is warm.»</p></main></body></html>""",
    "social footer": HEAD + """<body><article><h1>«Bees in the city»</h1><p>«There are more flowers in parks than in fields.»</p></article><div class="social-links"><a href=/f>Facebook</a> <a href=/t>Twitter</a></div><div class="copyright">© 2018 City Bees</div></body></html>""",
}


def page_and_blocks(layout: str) -> tuple[str, list[str]]:
    """The page without the marks, and the texts that are marked."""
    import html
    import re

    marked = re.findall("«(.*?)»", layout, re.S)
    return re.sub("[«»]", "", layout), [" ".join(html.unescape(re.sub("<[^>]*>", "", m)).split()) for m in marked]
