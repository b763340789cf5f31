"""Small pages of our own making with their main text marked: what the weights of ``maintext`` are learned from.

A page is a list of pieces in order, (MAIN or REST, html).  Tags that only wrap the main text belong to REST.
"""

MAIN, REST = True, False

PROSE = (
    "The harbour was quiet when the ferry came in, and nobody on the pier had slept. Crates stood in rows under a grey canvas, waiting for a crane that the "
    "company had promised since spring. An engineer walked along the rails and counted the bolts that were missing."
)
MORE = "Two years later the same committee met again. It found that repairs had cost less than the meetings about them, and closed the file without a vote."
SHORT = "Nothing else was decided that day."

LINKS = '<ul><li><a href="/">Home</a></li><li><a href="/world">World</a></li><li><a href="/sport">Sport</a></li><li><a href="/about">About us</a></li></ul>'
FORM = '<form action="/s"><label>Search</label><input name="q"><select><option>All</option><option>Titles</option></select><button>Go</button></form>'
REMARKS = '<div class="comment"><b>Ann</b><p>I was there and it was not quiet at all, thank you.</p></div><div class="comment"><b>Bo</b><p>Second this, the crane came later.</p><a href="#r">Reply</a></div>'

#: names that pages give to what is not their main text
FURNITURE = (
    "ad ads adbox advert advertisement alert author banner bio breadcrumb breadcrumbs byline callout comment comments complementary consent contentinfo cookie copyright cta "
    "dateline disclaimer discussion disqus feedback footer header legal login logo masthead menu modal nav navbar navigation newsletter notice overlay pager pagination "
    "paywall popup promo recommended related replies reply responses search share sidebar signup social sponsor sponsored subscribe tags teaser toc toolbar topbar tracking widget"
).split()
BOXES = "".join(f'<div class="{name}"><p>{SHORT}</p></div>' for name in FURNITURE)

PAGES = [
    [
        (REST, f'<html><head><title>Harbour</title></head><body><header class="site-header"><a href="/"><img src="l.png"></a><p>Daily news for everyone</p></header><nav class="menu">{LINKS}</nav><main><article class="post">'),
        (MAIN, f"<h1>The harbour at dawn</h1><p>{PROSE}</p><p>{MORE}</p>"),
        (REST, '<aside class="related"><h3>Read next</h3><ul><li><a href="/1">Ten piers to see</a></li><li><a href="/2">A crane at last</a></li></ul></aside>'),
        (MAIN, f"<h2>After the vote</h2><p>{PROSE}</p><p>{SHORT}</p>"),
        (REST, f'</article></main><section id="comments" class="comments"><h2>Comments</h2>{REMARKS}</section><footer class="site-footer"><p>&copy; Daily news. All rights reserved.</p>{LINKS}</footer></body></html>'),
    ],
    [
        (REST, f'<body><div id="header"><div class="logo">Harbour Review</div><div class="search">{FORM}</div></div><div id="nav" class="navigation">{LINKS}</div><div class="breadcrumb breadcrumbs"><a href="/">Home</a> / <a href="/p">Ports</a></div><div id="content" class="content">'),
        (MAIN, f"<h1>Missing bolts</h1><p>{MORE}</p><blockquote><p>{PROSE}</p></blockquote><p>{PROSE}</p><p>{MORE}</p>"),
        (REST, f'</div><div id="sidebar" class="sidebar widget"><h3>Popular</h3>{LINKS}<div class="newsletter subscribe"><p>Get our letter every week.</p>{FORM}</div></div><div id="footer" class="footer"><p>Contact, imprint and privacy. Copyright by the owners.</p></div></body>'),
    ],
    [
        (REST, f'<body><div class="cookie cookie-notice consent banner"><p>We use cookies to make this site better. By going on you agree to all of them.</p><button>Accept</button></div><div class="top-bar topbar"><a href="/in">Log in</a><a href="/up">Sign up</a></div><nav>{LINKS}</nav><div class="ad advert advertisement"><p>Buy two cranes, pay for one. This week only.</p></div><article>'),
        (MAIN, f"<h1>What was promised</h1><p>{PROSE}</p>"),
        (REST, '<div class="ads ad-slot sponsored promo"><p>Ropes at half price from the best makers in town.</p></div>'),
        (MAIN, f"<p>{MORE}</p><ul><li>Bolts for the rails</li><li>Canvas for the crates</li></ul><p>{PROSE}</p>"),
        (REST, f'<div class="share social share-buttons"><a href="#f">Share</a> <a href="#t">Post it</a></div></article><div class="comments-area comment-list">{REMARKS}</div><footer><small>&copy; 2020 Harbour people</small></footer></body>'),
    ],
    [
        (REST, f'<body><table class="layout"><tr><td class="menu leftmenu">{LINKS}</td><td class="text body-text">'),
        (MAIN, f"<h2>A file is closed</h2><p>{MORE}</p><p>{PROSE}</p><p>{PROSE}</p>"),
        (REST, f'</td><td class="right rightcol"><div class="adbox banner">Visit the island</div>{FORM}</td></tr></table><p class="copyright legal">Copyright 1999 by nobody in particular.</p></body>'),
    ],
    [
        (REST, f'<body class="single"><div class="wrapper container"><div class="masthead header"><h2>Tide tables weekly</h2></div><div class="nav-wrap navbar">{LINKS}</div><div class="main main-content" role="main"><div class="entry entry-content article-body post-content story" itemprop="articleBody">'),
        (MAIN, f"<p>{PROSE}</p><p>{MORE}</p><pre>row 1 row 2 row 3</pre><p>{PROSE}</p><table><tr><th>Year</th><th>Bolts</th></tr><tr><td>1901</td><td>12</td></tr></table><p>{SHORT}</p>"),
        (REST, f'</div><div class="tags meta post-meta">Filed under <a href="/t">tides</a>, <a href="/b">bolts</a></div><div class="author-box author bio"><p>Kim writes about water and has done so for years.</p></div><div class="related-posts recommended more"><h4>You may like</h4>{LINKS}</div></div><aside class="widget-area"><p>Follow us and win a boat.</p>{LINKS}</aside></div></body>'),
    ],
    [
        (REST, f'<body><header role="banner"><h1>Quay</h1>{FORM}</header><div role="navigation">{LINKS}</div><div class="alert notice warning" role="alert"><p>This site will be down on Sunday from six to nine for repairs.</p></div><main id="main">'),
        (MAIN, f"<h1>Counting rails</h1><p>{PROSE}</p><h2>Why it took so long</h2><p>{MORE}</p><p>{PROSE}</p><ol><li>{SHORT}</li><li>{MORE}</li></ol>"),
        (REST, f'</main><section class="discussion responses replies"><h3>Discussion</h3><article class="comment reply"><p>What a long story about a few rails, but well told.</p></article><article class="comment reply"><p>My father was that engineer and he never slept.</p></article>{FORM}</section><div role="complementary" class="sidebar">{LINKS}<p>Our sponsors pay for this page.</p></div><footer role="contentinfo"><p>Imprint. Terms of use. Privacy.</p></footer></body>'),
    ],
    [
        (REST, f'<body><div><a href="/">Quay notes</a> <a href="/a">Archive</a> <a href="/m">Mail</a></div><div>'),
        (MAIN, f"<h1>One quiet night</h1><p>{PROSE} {MORE}</p><p>{MORE} <a href='/f'>The file</a> can be read by <b>anyone</b>.</p><p>{PROSE}</p>"),
        (REST, f'</div><div>{LINKS}</div><div><p><a href="/p">Older</a> <a href="/n">Newer</a></p></div></body>'),
    ],
    [
        (REST, f'<body><div class="modal popup overlay"><h3>Join the club</h3><p>Subscribe today and read every page for a year.</p>{FORM}</div><ul class="toolbar menu-main"><li><a href="/">Start</a></li><li><a href="/k">Shop</a></li></ul><article class="article"><header class="article-header"><p class="byline dateline meta">By Kim, 3 May</p></header>'),
        (MAIN, f"<p>{PROSE}</p><figure><img src='c.jpg'><figcaption>The crane in May</figcaption></figure><p>{MORE}</p><p>{PROSE}</p>"),
        (REST, f'<nav class="toc pagination pager"><a href="?p=1">1</a> <a href="?p=2">2</a></nav><div class="paywall callout cta"><p>Want to read more? Become a member now.</p></div><footer class="article-footer"><p>Corrections are welcome at the desk.</p></footer></article><div id="disqus" class="feedback">{REMARKS}</div><div class="bottom disclaimer"><p>All prices without tax and subject to change.</p></div></body>'),
    ],
    [
        (REST, f'<body class="site page"><div class="site-wrap wrap"><div class="top-bar">{LINKS}</div><section class="page-area top"><div class="row box left-col right-col"><div class="text-list">'),
        (MAIN, f'<h1>Bolts and rails</h1><section class="section top"><h3>Where they went</h3><p>{PROSE} <b>{MORE}</b></p><ul class="list"><li>{PROSE}</li><li>{MORE}</li><li>{PROSE}</li></ul></section><section><h4>Who knew</h4><p><b>{MORE}</b></p><p>{PROSE}</p><small>{MORE}</small></section>'),
        (REST, f'</div></div></section><div class="site-info"><p>Made by hand.</p>{LINKS}</div></div></body>'),
    ],
    [
        (REST, f'<body><nav>{LINKS}</nav><div id="page" class="main-area more-posts"><section id="story"><div class="bottom-box table-wrap">'),
        (MAIN, f'<h2>What the rails cost</h2><ul><li>{MORE}</li><li><b>{SHORT}</b> {PROSE}</li></ul><h3>The first year</h3><p>{PROSE}</p><h4>The second year</h4><p>{MORE} <a href="/x">{SHORT}</a></p><h3>The end</h3><ul><li>{PROSE}</li><li>{MORE}</li></ul><dl><dt>Bolt</dt><dd>{MORE}</dd></dl><p>{PROSE}</p>'),
        (REST, f'</div></section></div><div class="ad"><table><tr><td>Text of a sponsor in a table body, with one <b>bold</b> word.</td></tr></table></div><div class="notice"><blockquote>Read this notice before you post.</blockquote><ol><li>Be kind.</li></ol></div><div class="comments"><p>{MORE}</p><ul><li>{SHORT}</li></ul></div></body>'),
    ],
    [
        (REST, f'<body class="page site"><div class="page-wrap table row"><div class="top row"><section class="section left col box"><h3>Latest</h3><h4>All of it</h4><ul class="list"><li><small>{SHORT}</small></li></ul><dl><dt>Open</dt><dd>At nine</dd></dl><table class="table"><tr><td class="text">{SHORT}</td></tr></table></section></div><article class="story">'),
        (MAIN, f'<h1>Nine bolts</h1><p>{PROSE}</p><section class="box"><h3>The tenth</h3><p>{MORE}</p><table class="table"><tr><td>Bolts</td><td>nine</td></tr></table></section><div class="row"><div class="left col"><p>{PROSE}</p></div><div class="right col"><p>{MORE}</p></div></div><ol class="list"><li>{PROSE}</li></ol>'),
        (REST, f'</article><section class="bottom right area more list"><h3>More posts</h3><h4>Text and body</h4><ul><li>{SHORT}</li><li>{SHORT}</li></ul><ol><li><b>{SHORT}</b></li></ol><blockquote>{SHORT}</blockquote></section><div class="bottom-row body"><h2>Site</h2><p>{SHORT}</p></div></div></body>'),
    ],
    [
        (REST, f'<body><div class="table row top"><section class="box right col area"><h3>Partners</h3><p>{SHORT}</p>{LINKS}</section></div><div class="post"><div class="content">'),
        (MAIN, f'<h1>Low tide</h1><section><h2>Mud</h2><p>{PROSE}</p><h3>Stones</h3><ul><li>{MORE}</li></ul></section><section><h3>Ropes</h3><h4>Short ones</h4><p>{PROSE}</p><dl><dt>Rope</dt><dd>{MORE}</dd></dl></section>'),
        (REST, f'</div></div><section class="left box list text"><h4>Elsewhere</h4><dl><dt>Now</dt><dd>{SHORT}</dd></dl><table class="table"><tr><td>{SHORT}</td></tr></table></section></body>'),
    ],
    [
        (REST, f'<body><main><div class="post-body text">'),
        (MAIN, f'<h1>Everything at once</h1><p>{PROSE}</p>'),
        (REST, f'{FORM}<nav>{LINKS}</nav><button>Save</button><aside><p>{SHORT}</p></aside>'),
        (MAIN, f'<h3>Again</h3><p>{MORE}</p><p>{PROSE}</p><div class="image caption"><p>{SHORT}</p></div><p>{PROSE}</p>'),
        (REST, f'<select><option>One</option></select><label>Your name</label><footer>{SHORT}</footer><header>{SHORT}</header>{FORM}'),
        (MAIN, f'<p>{PROSE}</p><p>{MORE}</p>'),
        (REST, f'</div></main><div class="site row">{LINKS}</div></body>'),
    ],
    [
        (REST, f'<body><form>{SHORT}</form><article class="text">'),
        (MAIN, f'<h2>The crane</h2><p>{PROSE}</p><p>{MORE}</p>'),
        (REST, f'{FORM}<button>Print</button><footer><p>{SHORT}</p></footer><aside>{SHORT}</aside><label>Rate this</label><select><option>Five</option></select>'),
        (MAIN, f'<p>{PROSE}</p><ul><li>{MORE}</li></ul>'),
        (REST, f'</article><article class="reply comment"><p>{SHORT}</p></article></body>'),
    ],
    [
        (REST, f'<body><div class="body layout"><p>{SHORT}</p></div><div class="page wrapper container">{LINKS}</div><div class="wrap table image caption">{SHORT}</div><div class="site-content top bottom info row col"><div class="post entry"><article class="content body">'),
        (MAIN, f'<h1>Tides</h1><p>{PROSE}</p><p>{MORE}</p><p>{PROSE}</p>'),
        (REST, f'</article></div></div><div class="post-comment">{SHORT}</div><main class="search"><p>{SHORT}</p></main></body>'),
    ],
    [(REST, f"<body>{BOXES}<main>"), (MAIN, f"<h1>Boxes before</h1><p>{PROSE}</p><p>{MORE}</p>"), (REST, "</main></body>")],
    [(REST, "<body><article>"), (MAIN, f"<h1>Boxes after</h1><p>{PROSE}</p><p>{MORE}</p>"), (REST, f"</article>{BOXES}</body>")],
    [(REST, '<body><div class="entry text">'), (MAIN, f"<p>{PROSE}</p><p>{MORE}</p>"), (REST, f'{BOXES}'), (MAIN, f"<p>{PROSE}</p><p>{MORE}</p>"), (REST, "</div></body>")],
]
