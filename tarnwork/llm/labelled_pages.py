"""Small labelled pages for the extraction model. Elements with the attribute ``keep`` hold the article.

Fixed values, written for this purpose: layouts in which the article is marked by semantic elements, by class or id
names, or only by its text, next to the menus, notices, adverts, forms and comments that surround articles.
"""

LONG = "The committee met on Tuesday to discuss the new bridge, which had been planned for years. Several members asked how the cost could be reduced. No decision was reached."
MORE = "Work begins in the spring, when the river is low, and should be finished within two years. Until then, traffic will use the old road."
SHORT = "It rained."
LINKS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Weather", "About us", "Contact"))
FORM = '<form action="/s"><label>Name</label><input name="n"><button>Send</button></form>'

PAGES = [
    f"<html><body><header><h2>The Daily Post</h2><nav><ul>{LINKS}</ul></nav></header><article keep><h1>Bridge plans</h1><p>{LONG}</p><p>{SHORT}</p><p>{MORE}</p></article><aside><h3>Related</h3><ul>{LINKS}</ul></aside><footer>&copy; 2020 The Daily Post. All rights reserved.</footer></body></html>",
    f'<html><body><div id="header"><a href="/">The Daily Post</a></div><div class="menu"><ul>{LINKS}</ul></div><div id="content" keep><h1>Bridge</h1><p>{LONG}</p><ul><li>{SHORT}</li><li>{MORE}</li></ul><blockquote>{SHORT}</blockquote></div><div class="sidebar"><p>{SHORT} Read more news from the region.</p><ul>{LINKS}</ul></div><div id="footer"><p>Imprint. Terms of use. All rights reserved.</p></div></body></html>',
    f'<html><body><nav>{LINKS}</nav><main keep><h1>Bridge</h1><p>{MORE}</p><h2>Cost</h2><p>{LONG}</p><table><tr><td>{SHORT}</td><td>12</td></tr></table><pre>x = 1</pre></main><section class="comments"><h3>Comments</h3><div class="comment"><p>{LONG}</p></div><div class="comment"><p>I agree with this, well said.</p></div></section>{FORM}<footer><p>{SHORT}</p></footer></body></html>',
    f'<html><body><div class="cookie-notice"><p>We use cookies to improve our site. By continuing you accept them.</p></div><div class="top-bar">{LINKS}</div><div class="post" keep><div class="entry-title" keep><h1>Bridge</h1></div><div class="entry-content" keep><p>{LONG}</p><div>{MORE}</div><p>{SHORT}</p></div></div><div id="comments"><ol><li><p>{MORE}</p></li><li><p>First!</p></li></ol></div><div class="newsletter"><p>Subscribe to our newsletter and never miss a story.</p>{FORM}</div></body></html>',
    f'<html><body><div class="ad"><p>Buy two bicycles and get one free, only this week.</p></div><article keep><header keep><h1>Bridge</h1></header><section keep><h2>Plans</h2><p>{LONG}</p></section><div class="ad"><p>Sponsored: {MORE}</p></div><section keep><p>{MORE}</p><figure><figcaption>{SHORT}</figcaption></figure></section><div class="share-buttons"><a href="#">Tweet</a> <a href="#">Share</a></div></article><div class="related-posts"><h4>You may also like</h4><p><a href="#">{SHORT}</a></p></div></body></html>',
    f"<html><body><p><a href=/>Home</a> | <a href=/n>News</a> | <a href=/a>About</a></p><h1 keep>Bridge</h1><p keep>{LONG}</p><p keep>{MORE}</p><p keep>{SHORT}</p><hr><address>Webmaster, Copyright 2001</address></body></html>",
    f'<html><body><div role="banner"><h1>The Daily Post</h1></div><div role="navigation"><ul>{LINKS}</ul></div><div role="main" keep><h2>Bridge</h2><p>{SHORT}</p><p>{LONG}</p><ol><li>{MORE}</li><li>{SHORT}</li></ol></div><div role="complementary"><p>{MORE}</p></div><div role="contentinfo"><p>Terms</p></div></body></html>',
    f'<html><body><div class="wrapper"><div class="banner-ad">{SHORT} Click here for offers.</div><div class="breadcrumb"><a href=#>News</a> &gt; <a href=#>Local</a></div><div class="article-body" keep><p>{SHORT}</p><p>{LONG}</p><p>{MORE}</p><dl><dt>Cost</dt><dd>{SHORT}</dd></dl></div><div class="author-bio widget"><p>{SHORT} Follow the author for more.</p></div><div class="pagination"><a href=#>1</a> <a href=#>2</a></div></div><div class="modal popup"><p>Sign up now and save ten percent on your first order.</p></div></body></html>',
    f'<html><body><header>{LINKS}</header><article keep><h1>Bridge</h1><p>{LONG}</p><aside class="pullquote-promo"><p>{MORE}</p></aside><p>{MORE}</p><nav><a href=#>Next page</a></nav><footer><p>Filed under local news.</p></footer></article><section id="responses" class="reader-comments"><article class="comment"><p>{LONG}</p></article><article class="comment"><p>{SHORT}</p></article></section></body></html>',
    f"<html><body keep>{LONG} {MORE}</body></html>",
    f"<html><body keep>{LONG} {SHORT} <b>{MORE}</b> {LONG}<hr>{MORE}</body></html>",
    f"<html><body><p keep>{LONG}</p></body></html>",
    f"<html><body><p keep>{SHORT}</p><p keep>{MORE}</p></body></html>",
    f"<html><body><div keep><h1>Bridge</h1><div>{LONG}</div><div>{MORE}</div></div></body></html>",
    f'<html><body><div keep><h1>Bridge</h1><div>{MORE}</div></div><div class="comments"><div class="comment"><p>{LONG}</p></div><p>{SHORT}</p></div></body></html>',
    f'<html><body><article keep><h1>Bridge</h1><p>{LONG}</p><form><p>Your mail</p><p>{SHORT}</p></form><p>{MORE}</p><div class="advert">{MORE}</div><p>{SHORT}</p><div class="comments"><p>{LONG}</p><p>{SHORT}</p></div></article></body></html>',
    f'<html><body><article keep><h1>Bridge</h1><p>{MORE}</p><div class="ads"><p>{LONG}</p></div><div class="notice"><p>{SHORT}</p></div><p>{LONG}</p><ul><li>{SHORT}</li><li>x</li></ul><section class="related"><h3>More</h3><ul>{LINKS}</ul></section></article><div class="ad">{LONG}</div></body></html>',
    f'<html><body><main keep><article><h1>Bridge</h1><p>{LONG}</p><div class="sidebar"><p>{MORE}</p></div><p>{SHORT}</p></article></main><div id="side"><p>{LONG}</p></div><div class="notice">{MORE}</div></body></html>',
    f'<html><body><table><tr><td><ul>{LINKS}</ul></td><td keep><h1>Bridge</h1><p>{LONG}</p><p>{MORE}</p></td></tr></table><div class="footer">{SHORT}</div></body></html>',
]
