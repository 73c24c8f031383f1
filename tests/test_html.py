"""Text of HTML fragments and feeds, on hand-written literals."""

import pytest

from quillspark.errors import EngineError
from quillspark.sources.files import feed_items, stop_words
from quillspark.sources.html import fragment_text, page_content


# Each case is made from a rule of the text walk: what it is about, markup, text.
RULES = [
    ("blocks stand on lines of their own", "one<section>two</section>three<footer>four</footer>", "one\ntwo\nthree\nfour"),
    ("inline elements don't part words", "tu<i>li</i>p <span>bed</span><code>s</code>", "tulip beds"),
    ("line breaks and rules", "north<hr>south<br/>west<br><hr>east", "north\nsouth\nwest\neast"),
    ("pictures are a space", "oak<img alt=x>elm", "oak elm"),
    ("cells are parted by a space, rows by a line", "<table><tr><th>h1</th><th>h2</th></tr><tr><td>v1</td><td>v2</td></tr></table>", "h1 h2\nv1 v2"),
    ("ends that may be left out", "<ol><li>first<li>second<li>third</ol><dl><dt>term<dd>meaning</dl>", "first\nsecond\nthird\nterm\nmeaning"),
    ("white space collapses, whatever it is", "  wide\u2003gap\t\n and\u00a0more  ", "wide gap and more"),
    ("a line beats a space", "up <div> down </div> side", "up\ndown\nside"),
    ("preformatted text keeps its space but the first line feed", "<pre>\r\n if x:\r\n   y</pre>", " if x:\n   y"),
    ("references are read once", "5 &gt; 3 &#x26; &quot;q&quot; &amp;lt; &eacute;", '5 > 3 & "q" &lt; é'),
    ("what isn't shown is a space", "be<style>i{}</style>fore<iframe>frame</iframe>after<object>o</object>end", "be fore after end"),
    ("hidden by attribute, with any value", "<p hidden>gone</p><b hidden=until-found>too</b>here", "here"),
    ("looks alone hide nothing", '<em style="visibility:hidden" class=hidden>still here</em>', "still here"),
    ("comments are nothing", "black<!-- white -->bird", "blackbird"),
    ("other scripts", "<h2>Привет</h2><blockquote>שלום 🙂</blockquote>", "Привет\nשלום 🙂"),
    ("nothing but space", "<div> <br>\n</div>\u3000", ""), ("an empty element", "<ul><li></li></ul>", ""), ("nothing", "", ""),
]


@pytest.mark.parametrize(("rule", "html", "text"), RULES, ids=[r[0] for r in RULES])
def test_fragment(rule, html, text):
    assert fragment_text(html)[0] == text


def test_recovered():
    assert [fragment_text(x)[1] for x in ("<ul><li>fine<li>fine</ul>", "stray</section>", "<div>open", "<em>crossed<b></em></b>", "<section/>")] == [False, True, True, True, True]


def test_page():
    html = "<html><head><title>T</title><link rel=canonical href='http://u'></head><body><nav>menu</nav><main><h1>Head</h1><p>Body<script>x</script></p></main><footer>f</footer></body></html>"
    assert page_content(html) == ("Head", "http://u", "Head\nBody")


FEED = """<?xml version="1.0"?><rss version="2.0" xmlns:c="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>x</title>
<item><title> One </title><link>u1</link><dc:creator>ann</dc:creator><c:encoded><![CDATA[<p>A<b>b</b></p>]]></c:encoded></item>
<item><title>Two</title><description>&lt;p&gt;fallback&lt;/p&gt;</description></item>
<item><title>Empty</title><description>&lt;p&gt;&lt;/p&gt;</description></item>
<item><title>a</title><title>b</title><description>t</description></item></channel></rss>"""


def test_feed():
    rows = feed_items("dir/feed.xml", FEED.encode())
    assert [(r[1], r[2]) for r in rows] == [(0, "success"), (1, "warning"), (2, "no_text"), (3, "rejected")]
    assert rows[0][3]["content"] == "Ab" and rows[0][3]["author"] == "ann" and rows[0][3]["title"] == "One"
    assert [i["code"] for i in rows[1][4]] == ["missing_metadata"] and rows[1][3]["url"] is None


@pytest.mark.parametrize("bad", ["<rss version='2.0'><channel>", "<!DOCTYPE x><rss version='2.0'><channel/></rss>", "<rss version='1.0'><channel/></rss>", "<rss version='2.0'/>", "<rss version='2.0'><channel/><channel/></rss>"])
def test_feed_failures(bad):
    assert feed_items("f.xml", bad.encode())[0][2] == "failed"


def test_feed_without_items():
    assert feed_items("f.xml", b"<rss version='2.0'><channel/></rss>")[0][2] == "no_text"


def test_stop_words():
    assert stop_words(["﻿The", "", "the", " A ", "#x"]) == {"the", "a", "#x"}
    with pytest.raises(EngineError, match="stopwords.entry"):
        stop_words(["two words"])
