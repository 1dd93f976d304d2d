"""Small hand-labelled layouts that train the page model; ``data-main`` marks main text."""

LONG = "Most of the work went into the northern stretch of the wall, where frost had loosened the stones, and the crew took nearly two summers to finish it. They kept the old courses wherever they could."
MID = "The river was low that year, and the mill stood still until the rains came back in autumn."
SHORT = "A quiet end to the season"

_LINKS = "".join(f'<li><a href="/{x}">{x.title()}</a></li>' for x in ("home", "news", "sport", "culture", "about us"))
_SIDE = f'<h3>Most read</h3><ul><li><a href="/a">{SHORT}</a></li><li><a href="/b">How the mill was saved</a></li></ul><p>Get the weekly letter.</p>'
_BODY = f"<h1 data-main>{SHORT}</h1><p data-main>{LONG}</p><p data-main>{MID} {LONG}</p><h2 data-main>What came next</h2><p data-main>{MID}</p><ul data-main><li>Stones from the quarry</li><li>{MID}</li></ul><blockquote data-main><p>{MID}</p></blockquote><p data-main>Read <a href='/x'>the full report</a> by the trust, published in May.</p>"
_PLAIN = f"<h1 data-main>{SHORT}</h1><p data-main>{MID}</p>"
_TALK = f"<h2>Comments (3)</h2><div class='comment'><b>Anna</b><p>{MID}</p></div><div class='comment'><b>Tom</b><p>I do not agree with this at all, {LONG}</p></div>"
_RIGHTS = "&copy; 2023 The Valley Paper. All rights reserved."
_COOKIE = "We use cookies to give you the best experience. By using this site, you agree to our policy."

PAGES = [
    f"<html><head><title>t</title></head><body><nav><ul>{_LINKS}</ul></nav><div class='ad'>Buy two, get one free at our store, today only.</div><article>{_BODY}</article><footer>{_RIGHTS}</footer></body></html>",
    f"<html><body><header><a href='/'>The Valley Paper</a><p>{SHORT}</p></header><nav>{_LINKS}</nav><main><article>{_PLAIN}</article></main><aside>{_SIDE}</aside><footer><p>{_RIGHTS} {MID}</p></footer></body></html>",
    f"<html><body><div id='header'><h1>The Valley Paper</h1></div><div id='nav'><ul>{_LINKS}</ul></div><div id='content'><div class='post'>{_BODY}</div></div><div id='sidebar'>{_SIDE}</div><div id='footer'>{_RIGHTS}</div></body></html>",
    f"<html><body><div class='cookie-notice'>{_COOKIE}</div><div class='navbar'>{_LINKS}</div><div class='main-content'><div class='entry'>{_BODY}</div><div class='share'><a href='#'>Tweet</a> <a href='#'>Share</a></div><div class='comments'>{_TALK}</div></div><div class='widget'>{_SIDE}</div><div class='footer'>{_RIGHTS}</div></body></html>",
    f"<html><body><nav>{_LINKS}</nav><article>{_PLAIN}<aside><p>Related: {MID}</p></aside><p data-main>{LONG}</p><section class='comments'>{_TALK}</section></article><footer>{_RIGHTS}</footer></body></html>",
    f"<html><body><div class='banner'><p>{MID}</p></div><main>{_BODY}<form><p>Sign up for our letter: {MID}</p><label>Your name</label></form></main><div class='sponsored'><p>{LONG}</p></div><footer>{_RIGHTS}<ul>{_LINKS}</ul></footer></body></html>",
    f"<html><body><div><div><ul>{_LINKS}</ul></div><div>{_BODY}</div><div><p>{_RIGHTS}</p></div></div></body></html>",
    f"<html><body><table><tr><td><ul>{_LINKS}</ul></td><td>{_BODY}</td></tr></table><p>{_RIGHTS}</p></body></html>",
    f"<html><body><header><h1>Valley</h1><nav>{_LINKS}</nav></header><div role='main'><h1 data-main>{SHORT}</h1><p data-main>{MID}</p><pre data-main>make all</pre><table data-main><tr><td>Stone</td><td>12</td></tr></table><div class='related'>{_SIDE}</div></div><div class='newsletter'><p>{MID}</p></div><footer>{_RIGHTS}</footer></body></html>",
    f"<html><body><div class='notice'><p>{_COOKIE}</p></div><div class='breadcrumb'><a href='/'>Home</a> / News</div><article class='story'><header><h1 data-main>{SHORT}</h1></header><p data-main>{LONG}</p><div class='ad'>{MID}</div><p data-main>{MID}</p></article><div class='comment-list'>{_TALK}</div><footer>{_RIGHTS}</footer></body></html>",
    f"<html><body data-main>{LONG} {MID}</body></html>",
    f"<html><body data-main>{MID}<br><br>{LONG}<br><br>{MID} <a href='/n'>next part</a></body></html>",
    f"<p data-main>{MID}</p><p data-main>{LONG}</p>",
    f"<html><body><div class='legal'><p>{_RIGHTS}</p></div><main><div class='legal-guide' data-main><h1>{SHORT}</h1><p>{LONG}</p><p>{MID}</p></div></main></body></html>",
    f"<html><body><nav>{_LINKS}</nav><main><section data-main><h2>{SHORT}</h2><p>{MID}</p></section><section data-main class='side-note'><p>{LONG}</p></section><div class='legal' data-main><p>{LONG}</p><p>{MID}</p></div><section class='related'><h3>More</h3>{_SIDE}</section></main><footer><a href='/i'>Imprint</a> <a href='/p'>Privacy</a></footer></body></html>",
    f"<html><body><div class='top'><a href='/'>Home</a></div><div class='wrap'><h2 data-main>{SHORT}</h2><dl data-main><dt>Stone</dt><dd>{MID}</dd><dt>Mortar</dt><dd>{LONG}</dd></dl><form class='search'><p>{SHORT}</p></form></div><div class='bottom'><p>{_RIGHTS}</p></div></body></html>",
    f"<html><body><div id='page'><div class='post-content'><h1 data-main>{SHORT}</h1><div data-main>{LONG}</div><div data-main>{MID}</div></div><div class='author-box social'><p>Follow us: {SHORT}</p></div><div class='respond'><h3>Leave a reply</h3><p>{MID}</p></div></div><div class='alert'><p>{_COOKIE}</p></div></body></html>",
    f"<html><body><article><h1 data-main>{SHORT}</h1><p data-main>{SHORT}.</p><figure data-main><figcaption>{MID}</figcaption></figure><p data-main>Yes.</p><aside class='promo'><p>{LONG}</p></aside></article><section id='discussion'>{_TALK}</section></body></html>",
]
