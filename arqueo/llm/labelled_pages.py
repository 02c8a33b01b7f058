"""Labelled pages to train the extraction on: HTML in which the main text carries a `data-main` attribute.

They are put together from small hand-written parts (kinds of articles, kinds of everything else, places to put
them), so that one page shows a few of many combinations.
"""

ARTICLES = (  # ways to wrap the main text; {0} is title and body
    "<article data-main>{0}</article>",
    "<main data-main><article>{0}</article></main>",
    '<main id="content" data-main>{0}</main>',
    '<div class="post-content" data-main>{0}</div>',
    '<div id="page"><div class="entry-content" data-main>{0}</div></div>',
    '<div class="container"><section class="article-body" data-main>{0}</section></div>',
    '<div><div data-main>{0}</div></div>',
)
SENTENCE = "This is a sentence of the story, and it goes on for quite a while before it ends."
BODIES = (
    f"<h1>A title of some words</h1><p>{SENTENCE} {SENTENCE}</p><p>{SENTENCE}</p>",
    f"<h1>Another title</h1><p><b>{SENTENCE}<br><p>{SENTENCE} {SENTENCE} {SENTENCE}</p><p>Short.</p><p>{SENTENCE}</p>",
    f'<header><h1>A headline</h1><p>By the author of the story</p></header><p>{SENTENCE} <a href="/x">a link</a> {SENTENCE}</p>'
    f"<h2>A part</h2><p>{SENTENCE}</p><ul><li>One thing to know.</li><li>Another thing to know.</li></ul><p>{SENTENCE}</p>",
    f"<h1>Title</h1>{SENTENCE} {SENTENCE}<blockquote><p>{SENTENCE}</p></blockquote><p>{SENTENCE}</p><pre>a = b + c</pre>",
    f"<h1>With a figure</h1><p>{SENTENCE}</p><figure><img src='x'><figcaption>What the picture shows.</figcaption></figure>"
    f"<p>{SENTENCE}</p><table><tr><th>Name</th><th>Value</th></tr><tr><td>One</td><td>1</td></tr></table><p>Sh.</p>",
    "<p>Only one line.</p>",
    f"<h1>Short title</h1><div><p>{SENTENCE}</p><p>Of the.</p><ol><li>{SENTENCE}</li><li>Then.</li></ol></div>",
)
LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">news</a></li></ul>'
BEFORE = (  # above the main text
    f"<nav>{LINKS}</nav>",
    f"<header><div class='logo'><a href='/'>The Site</a></div><nav>{LINKS}</nav></header>",
    f"<div class='menu' role='navigation'>{LINKS}</div>",
    "<header id='header'><h1>The Name of the Site</h1><p>News for everyone, every day of the week.</p></header>",
    "<div class='ad'>Buy this thing now for less than you think. It is good.</div>",
    "<div class='cookie-notice'><p>We use cookies to make this site better for you.</p><button>Accept</button></div>",
    "<div class='breadcrumb'><a href='/'>Home</a> &gt; <a href='/n'>News</a></div>",
    "<div role='banner' class='banner'><p>A great offer is waiting for you today.</p></div>",
    "<form action='/s'><label>Search</label><input name='q'><button>Go</button></form>",
    "<div class='notice alert'>Please note that the office is closed today.</div>",
)
AFTER = (  # below the main text
    "<footer>&copy; 2020 The Site &middot; All rights reserved.</footer>",
    f"<footer><p>{SENTENCE}</p>{LINKS}</footer>",
    f"<aside><h3>Related stories</h3>{LINKS}</aside>",
    f"<aside class='sidebar'><p>{SENTENCE}</p></aside>",
    "<div class='sidebar widget'><h3>Popular</h3><p>What all the others read this week.</p></div>",
    f"<section class='comments' id='comments'><h3>Comments</h3><div class='comment'><p>{SENTENCE}</p></div><div class='comment'><p>I agree with that.</p></div></section>",
    f"<div id='disqus_thread' class='comment-list'><ul><li class='reply'><p>{SENTENCE} {SENTENCE}</p></li><li><p>No.</p></li></ul></div>",
    "<div class='share social'><a href='/t'>Share</a> <a href='/f'>Like</a></div>",
    "<div class='newsletter subscribe'><form><p>Sign up for our letter to get the news.</p><input><button>Subscribe</button></form></div>",
    f"<div class='advert sponsored promo'><p>{SENTENCE}</p></div>",
    "<div id='footer' class='copyright legal'>Terms of use. Privacy policy. Contact us.</div>",
    f"<div class='related pagination'>{LINKS}</div>",
)
INSIDE = (  # in the middle of the main text
    "", "",
    "<aside data-other><p>Read also another story of ours.</p></aside>",
    f"<div class='ad advertisement' data-other><p>{SENTENCE}</p></div>",
    "<div class='share' data-other><a href='/t'>Share this</a></div>",
    "<nav data-other><ul><li><a href='#1'>Part one</a></li><li><a href='#2'>Part two</a></li></ul></nav>",
    "<form data-other><p>Get the letter.</p><input><button>Send</button></form>",
    f"<section class='comments' data-other><p>{SENTENCE}</p><p>Nice.</p></section>",
    "<footer data-other><p>Filed under news. Tags: one, two.</p></footer>",
)


def labelled_pages() -> list[str]:
    """Pages in which every part meets several others. `data-main` marks the main text, `data-other` what is not, inside it."""
    pages = []
    for i in range(len(BEFORE) * len(AFTER)):
        article, body, inside = ARTICLES[i % len(ARTICLES)], BODIES[(i + i // len(ARTICLES)) % len(BODIES)], INSIDE[i * 2 % len(INSIDE)]
        cut = body.rfind("<p>")
        main = article.format(body[:cut] + inside + body[cut:] if i % 2 else body + inside)
        first, second = BEFORE[i % len(BEFORE)], BEFORE[(i * 3 + 1) % len(BEFORE)]
        third, fourth = AFTER[i // len(BEFORE)], AFTER[(i * 5 + 2) % len(AFTER)]
        pages.append(f"<html><head><title>T</title></head><body>{first}{second if i % 3 else ''}{main}{third}{fourth if i % 4 else ''}</body></html>")
    return pages
