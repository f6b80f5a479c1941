"""Thirty pages of unlike layouts, written by hand; what stands in [[ ]] is the article's text, a block each."""

H, P = "[[Bridge reopens after repairs]]", "<p>[[The old bridge over the river was opened again on Monday, after two years of work on its piers.]]</p>"
Q = "<p>[[Traffic will be allowed in both directions, the council said, but lorries have to wait until May.]]</p>"
R = "<p>[[Costs rose from four to nine million, mainly since the piers stood on older wood than the drawings showed.]]</p>"
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li></ul>"
FOOT = "© 2024 Town News | <a href='/t'>Terms</a>"
SAID = "<p>Great to hear, thanks for the report!</p><p>About time, I had to drive round for two years.</p>"

LAYOUTS = [
    f"<body class='has-sidebar'><nav>{MENU}</nav><article><h1>{H}</h1>{P}{Q}</article><footer>{FOOT}</footer>",
    f"<body class='nav-open'><nav>{MENU}</nav><article><h1>{H}</h1>{P}{Q}</article><footer>{FOOT}</footer>",
    f"<body class='single comments-open'><article><h1>{H}</h1>{P}{R}</article><div id='comments'>{SAID}</div>",
    f"<body><div id=nav>{MENU}</div><article class='post share-post'><h1>{H}</h1>{P}{Q}</article>",
    f"<body><div class='layout no-sidebar'><div class=post><h1>{H}</h1>{P}{Q}{R}</div></div><div class=footer>{FOOT}</div>",
    f"<body class=nav-open><article class='has-sidebar share-post'><h1>{H}</h1>{P}</article>",
    f"<article><h1>{H}</h1>{P}{Q}<section class='user-reviews'><h3>Reviews</h3>{SAID}</section></article>",
    f"<article><h1>{H}</h1>{P}{Q}<section id=disqus_thread>{SAID}</section></article><footer>{FOOT}</footer>",
    f"<article><h1>{H}</h1>{P}<ul><li>[[A map of the town]]<li>[[Good shoes]]<li>[[A warm coat]]</ul></article>",
    f"<article><h1>{H}</h1>{P}<table><tr><th>[[Year]]<th>[[Piers]]<tr><td>[[2022]]<td>[[3]]<tr><td>[[2023]]<td>[[5]]</table></article>",
    f"<article><h1>{H}</h1>{P}<p>[[Repeat it twice.]]</p><p>[[Repeat it twice.]]</p>{Q}</article><footer>{FOOT}</footer>",
    f"<main><div class=breadcrumbs><a href=/>Home</a> » <a href=/n>News</a></div><article><h1>{H}</h1>{P}{R}</article></main><aside><h4>Most read</h4>{MENU}</aside>",
    f"<div class='wrapper'><div class='header'><a href=/>Town News</a></div><div class='content'><h1>{H}</h1>{P}{Q}</div><div class='sidebar'>{MENU}</div></div>",
    f"<table><tr><td>{MENU}</td><td><h1>{H}</h1>{P}{Q}{R}</td></tr></table>",
    f"<form id=page><div id=menu>{MENU}</div><div id=body><h1>{H}</h1>{P}{Q}{R}</div><div id=footer>{FOOT}</div></form>",
    f"<body><article><header><h1>{H}</h1></header>{P}{Q}</article><div class='cookie-notice'>We use cookies. <a href=/c>Accept</a></div>",
    f"<article><div class='entry-header'><h1>{H}</h1></div><div class='entry-content'>{P}{Q}</div><div class='share'><a href=/f>Share this</a></div></article>",
    f"<div class=container><div class=row><div class='col story'><h2>{H}</h2>{P}{Q}<blockquote>[[We are glad that it is done, said the mayor.]]</blockquote>{R}</div></div></div><div class='newsletter'><p>Get our news by mail every day.</p></div>",
    f"<main class='has-sidebar'><h1>{H}</h1>{P}{Q}<aside class=related><h4>Related</h4>{MENU}</aside></main>",
    f"<div class=ad><p>Buy new tyres, now at half the price.</p></div><div class=text><h1>{H}</h1>{P}{Q}{R}</div>",
    f"<aside><article class=teaser><a href=/x>Market moves to the square</a></article></aside><article><h1>{H}</h1>{P}{Q}</article>",
    f"<article><h1>{H}</h1>{P}{Q}</article><section id=comments><article class=comment>{SAID}</article><article class=comment>{SAID}</article></section>",
    f"<div class='post'><h1>{H}</h1>{P}{Q}{R}</div><ol class='comment-list'><li><p>Great to hear, thanks for the report!</p></ol>",
    f"<header><h2><a href=/>Town News</a></h2></header><div role=main><h1>{H}</h1>{P}{Q}{R}</div><footer>{FOOT}</footer>",
    f"<article><h1>{H}</h1>{P}<pre>[[piers: 5]]</pre><dl><dt>[[Length]]<dd>[[90 metres]]</dl>{Q}</article>",
    f"<div class=page><h1>{H}</h1>{P}<ol><li>[[Close the bridge for all traffic at night.]]</li><li>[[Lift the deck and set new piers.]]</li></ol>{Q}</div><div class=menu>{MENU}</div>",
    f"<section><section><h1>{H}</h1>{P}{Q}{R}</section><section class='social'><a href=/a>Follow us</a></section></section>",
    f"<div class='site is-menu-open'><nav>{MENU}</nav><div class=inner><h1>{H}</h1>{P}{Q}{R}</div></div>",
    f"<body><article><h1>{H}</h1><figure><img src=b.jpg><figcaption>[[The bridge on Monday.]]</figcaption></figure>{P}{Q}</article><dialog>Please log in first.</dialog>",
    f"<div id=modal-root><div id=app><nav>{MENU}</nav><main id=content><h1>{H}</h1>{P}{Q}</main><footer>{FOOT}</footer></div></div>",
]


def written(layout: str) -> tuple[str, list[str]]:
    """The page, and its article's blocks."""
    texts, rest = [], layout
    while "[[" in rest:
        text, rest = rest.split("[[", 1)[1].split("]]", 1)
        texts.append(text)
    return layout.replace("[[", "").replace("]]", ""), texts
