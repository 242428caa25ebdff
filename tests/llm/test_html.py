"""Pages of varied layout with their exact texts; adversarial nesting in linear time."""

import time

import pytest

from protolith.llm import html as op8

P = "Real text of the article is here, and it is quite long."
Q = "A second paragraph follows, with more words in it than the first had."
R = "The third one closes the story. It has two sentences."
H = "A headline about it"
LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">Sport</a></li></ul>'
PAGES = [
 (f"<body><article><p>{P}</p></article></body>", P),
 (f"<html><head><title>T</title><body><article><p>{P}</p><p>{Q}</p></article>", f"{P} {Q}"),
 (f"<body><article><p>{P}</p></article><div class=\"comments\"><p>Nice one, I liked it a lot.</p></div></body>", P),
 (f"<main>{P}</main>", P),
 (f"<main><p>{P}</p></main>", P),
 (f"<body><p>{P}</p></body>", P),
 (f"<p>{P}</p><p>{Q}</p><p>{R}</p>", f"{P} {Q} {R}"),
 (f"<body><h1>{H}</h1><p>{P}</p><p>{Q}</p></body>", f"{H} {P} {Q}"),
 (f"<body><nav>{LINKS}</nav><h1>{H}</h1><p>{P}</p><p>{Q}</p><footer>&copy; 2020 The Paper</footer></body>", f"{H} {P} {Q}"),
 (f"<body><div id=nav>{LINKS}</div><div id=content><h2>{H}</h2><p>{P}</p><p>{R}</p></div><div id=footer>Contact us at the office. All rights reserved.</div></body>", f"{H} {P} {R}"),
 (f"<table><tr><td class=menu>{LINKS}</td><td><h1>{H}</h1><p>{P}</p><p>{Q}</p></td></tr></table>", f"{H} {P} {Q}"),
 (f"<table width=100%><tr><td colspan=2><a href=/>Site</a></td></tr><tr><td>{LINKS}</td><td class=content><p>{P}</p><p>{Q}</p></td></tr></table>", f"{P} {Q}"),
 (f"<article><h1>{H}</h1><p>{P}</p><aside><p>Also read this other piece.</p></aside><p>{Q}</p></article>", f"{H} {P} {Q}"),
 (f"<article><h1>{H}</h1><p>{P}</p><div class=\"ad-slot\"><p>Buy one today and get two.</p></div><p>{Q}</p></article>", f"{H} {P} {Q}"),
 (f"<article><p>{P}</p><form action=/s><label>Mail</label><input><button>Subscribe</button></form><p>{Q}</p></article>", f"{P} {Q}"),
 (f"<div class=\"post-body\"><p>{P}</p><ul><li>First point of it</li><li>Second point of it</li></ul><p>{Q}</p></div>", f"{P} First point of it Second point of it {Q}"),
 (f"<div class=wrapper><header><a href=/>Site</a><nav>{LINKS}</nav></header><section class=story><h1>{H}</h1><p>{P}</p><blockquote>{R}</blockquote></section><footer><p>About us and our terms.</p></footer></div>", f"{H} {P} {R}"),
 (f"<body><div class=cookie-banner><p>We use cookies to improve the site.</p><button>Accept</button></div><main><h1>{H}</h1><p>{P}</p></main></body>", f"{H} {P}"),
 (f"<body><main><article><h1>{H}</h1><p>{P}</p></article><section id=comments><h2>Comments</h2><div class=comment><p>I do not agree with any of it.</p></div><div class=comment><p>Me neither, but it reads well enough.</p></div></section></main></body>", f"{H} {P}"),
 (f"<body><div class=\"sidebar\"><h3>Popular</h3>{LINKS}</div><div class=\"main\"><p>{P}</p><p>{Q}</p><p>{R}</p></div></body>", f"{P} {Q} {R}"),
 (f"<body><div><div><div><p>{P}</p><p>{Q}</p></div></div></div></body>", f"{P} {Q}"),
 (f"<body><div>{P}</div><div>{Q}</div></body>", f"{P} {Q}"),
 (f"<body>{P}<br><br>{Q}</body>", f"{P} {Q}"),
 (f"<article><h1>{H}</h1><h2>Part one</h2><p>{P}</p><h2>Part two</h2><p>{Q}</p><pre>x = 1; y = 2</pre></article>", f"{H} Part one {P} Part two {Q} x = 1; y = 2"),
 (f"<article><p>{P}</p><figure><img src=x><figcaption>The house in question, last year.</figcaption></figure><p>{Q}</p></article>", f"{P} The house in question, last year. {Q}"),
 (f"<article><p>{P}</p><table><tr><th>Year</th><th>Count</th></tr><tr><td>2001</td><td>15</td></tr></table><p>{Q}</p></article>", f"{P} Year Count 2001 15 {Q}"),
 (f"<body><nav>{LINKS}</nav><article><h1>{H}</h1><p>{P}</p><div class=share><a href=x>Share</a> <a href=y>Tweet</a></div></article><div class=related><h3>More</h3>{LINKS}</div></body>", f"{H} {P}"),
 (f"<body><article><p>See <a href=/x>the earlier report on this matter</a>, which said so. {P}</p></article></body>", f"See the earlier report on this matter, which said so. {P}"),
 (f"<ARTICLE><H1>{H}</H1><P>{P}<P>{Q}</ARTICLE><FOOTER>Some words at the foot.</FOOTER>", f"{H} {P} {Q}"),
 (f"<body><article><p>Yes.</p><p>{P}</p><p>No.</p></article></body>", f"Yes. {P} No."),
 (f"<body><section><h1>{H}</h1><p>{P}</p></section><section class=newsletter><p>Subscribe to the newsletter for more.</p></section></body>", f"{H} {P}"),
 (f"<div role=navigation>{LINKS}</div><div role=main><p>{P}</p><p>{Q}</p></div><div role=contentinfo>Imprint and privacy</div>", f"{P} {Q}"),
 (f"<body><div class=topbar><span>Welcome</span> <a href=/in>Log in</a></div><div class=entry-content><h1>{H}</h1>{P}<p>{Q}</p></div></body>", f"{H} {P} {Q}"),
 (f"<article><p>{P}</p><svg><text>no</text></svg><p>{Q}</p><noscript>Turn it on</noscript></article>", f"{P} {Q}"),
 (f"<body><article><p>{P} {P} {P} {P} They share the terms and search for a reply, in comments as in a newsletter.</p></article><footer>{P} &copy; Us</footer></body>", f"{P} {P} {P} {P} They share the terms and search for a reply, in comments as in a newsletter."),
 (f"<body><dl><dt>Word</dt><dd>{P}</dd><dt>Other word</dt><dd>{Q}</dd></dl></body>", f"Word {P} Other word {Q}"),
 (f"<body><div class=header>Daily Paper</div><div class=text><p>{P}</p><p>{Q}</p></div><div class=bottom>&copy; 2021 Daily Paper</div></body>", f"{P} {Q}"),
]

A = "The council voted on Tuesday to rebuild the old bridge across the river."
B = "Work should begin in March and take about two years, officials said."
C = "Residents have asked for it since 1998."
N = '<div><a href="/1">World</a> | <a href="/2">Business</a> | <a href="/3">Opinion</a></div>'
HELD = [
 (f"<html><body>{N}<div class=article><h1>Bridge to be rebuilt</h1><p>{A}</p><p>{B}</p></div></body></html>", f"Bridge to be rebuilt {A} {B}"),
 (f"<body><article><section><h2>News</h2><p>{A}</p></section><section><h2>Plans</h2><p>{B}</p></section></article></body>", f"News {A} Plans {B}"),
 (f"<body><div class=container><div class=row><div class=\"col main-column\"><h1>Bridge</h1><p>{A}<p>{B}<p>{C}</div><div class=\"col sidebar\"><p>Sign up here today.</p></div></div></div></body>", f"Bridge {A} {B} {C}"),
 (f"<body><nav class=breadcrumb><a href=/>Home</a> &gt; <a href=/n>News</a></nav><article><h1>Bridge</h1><p>{A}</p></article></body>", f"Bridge {A}"),
 (f"<body><article class=post><h1>Bridge</h1><p>{A}</p><ol><li>{B}</li><li>{C}</li></ol></article><div class=\"comment-list\"><div class=comment><span>Bob</span><p>Good news at last, I think so.</p></div></div></body>", f"Bridge {A} {B} {C}"),
 (f"<article><p>{A}</p><div class=advertisement><p>Cheap flights from 99 now.</p></div><p>{B}</p><p>{C}</p></article>", f"{A} {B} {C}"),
 (f"<body><div class=modal><p>Please log in to read on.</p></div><div class=story><p>{A}</p><p>{B}</p></div></body>", f"{A} {B}"),
 (f"<body><p>{A}</p><hr><p>{B}</p><p>{C}</p><footer><a href=/t>Terms</a> <a href=/p>Privacy</a></footer></body>", f"{A} {B} {C}"),
 (f"<main><h1>Bridge</h1><p>{A}</p><p>{B}</p></main><aside><h4>Trending</h4><p>Ten things to do this week.</p></aside>", f"Bridge {A} {B}"),
 (f"<body><header><h1>The Daily</h1></header><main><h1>Bridge</h1><p>{A}</p></main><footer><p>Printed in town.</p></footer></body>", f"Bridge {A}"),
 (f"<body><div id=page><div id=main><h2>Bridge</h2>{A}<p>{B}</p></div></div></body>", f"Bridge {A} {B}"),
 (f"<article><h1>Bridge</h1><p><em>{A}</em></p><p>{B} <a href=/x>More</a></p><form><p>Your mail</p></form></article>", f"Bridge {A} {B} More"),
 (f"<body><div class=social-share><a href=#>Share</a></div><article><p>{A}</p><p>{B}</p></article><section class=related-articles><h3>Related</h3><ul><li><a href=/1>Old tunnel closed</a></li></ul></section></body>", f"{A} {B}"),
 (f"<article><p>{A}</p><p>{C}</p><iframe src=x>no frames</iframe><p>{B}</p></article>", f"{A} {C} {B}"),
 (f"<body><div><p>{A}</p></div><div><p>{B}</p></div></body>", f"{A} {B}"),
]


@pytest.fixture(scope="module")
def field():
    return op8.default_field()


@pytest.mark.parametrize("page,want", PAGES + HELD)
def test_varied_layouts(field, page, want):
    assert field.extract(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 20_000 + "</span></li></section>" * 20_000,
        "<li><ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000,
        "".join(f"<div class=c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}>" for k in range(20_000)) + "x",
    ],
)
def test_nesting_costs_linear_time(field, page):
    began = time.time()
    field.extract(page)
    assert time.time() - began < 1


def test_features_read_the_whole_block():
    say = lambda text: op8.text_features(((), text, 0, "p"))
    assert "sign:True" in say("word " * 5000 + "©") and "sign:False" in say("word " * 5000)
    long = say("word " * 500 + "cookie privacy " * 500)
    assert [f for f in long if f.startswith("cues:")] == [f for f in say("word cookie privacy word cookie privacy") if f.startswith("cues:")]
