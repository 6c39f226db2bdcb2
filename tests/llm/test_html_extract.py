"""Wrappers: alignment, folding, and the main text of pages made from templates of many kinds."""

import html
import random

import cases
import pytest

from spectrafold.llm import html_extract as he

SCHEMA = "page_id long, url string, html string, host string, salt int, wrapper string, text string"


def sentences(rng, n):
    return [" ".join(cases.prose(rng.random(), rng.randint(4, 30)).split()).capitalize() + "." for _ in range(n)]


def shop(rng, blocks):
    """Semantic elements, a notice, a sidebar and readers' comments."""
    body = "".join(f"<h2>{html.escape(b)}</h2>" if len(b) < 40 else f"<p>{html.escape(b)}" for b in blocks)
    comments = "".join(f"<div class='comment'><p>{html.escape(c)}</p></div>" for c in sentences(rng, rng.randint(0, 5)))
    related = "".join(f"<li><a href=x>{c}</a>" for c in sentences(rng, rng.randint(1, 4)))
    return (f"<!doctype html><html><head><title>t</title><script>if (a<b) x='<p>no</p>'</script></head><body class='has-sidebar'>"
            f"<header><h1>The shop</h1></header><div id='cookie-notice'><p>We use cookies, do you mind?</p></div><nav><ul>{related}</ul></nav>"
            f"<main><article class='post'>{body}<div class=ad>Buy now</div><form><label>Mail</label><input name=q></form></article>"
            f"<section id=comments>{comments}</section></main><aside><p>{'Side words. ' * 40}</p></aside><footer>(c) us</footer></body></html>")


def plain(rng, blocks):
    """No element or name says where the text is; menu and legal lines are the same on all pages."""
    body = "".join(f"<p>{html.escape(b).replace(' ', chr(10), 1)}</p>" for b in blocks)
    menu = "".join(f"<td><a href=/{i}>Place {i}</a></td>" for i in range(6))
    return (f"<html><body><table><tr>{menu}</tr></table><div><p>All pages of this host say so in a rather long line of law.</p>"
            f"</div><div><div>{body}</div></div><div>Written by nobody in particular, as always.</div></body>")


def named(rng, blocks):
    """Only a class name stands for the text, tags are left open, an inline advert interrupts a sentence."""
    body = "".join(f"<p><b>{html.escape(b)} <span class=advert>Now <span>cheaper</span></span> end" for b in blocks)
    links = "".join(f"<li><a href=/{i}>{s}</a>" for i, s in enumerate(sentences(rng, rng.randint(1, 6))))
    return f"<body><div class=top><ul>{links}</ul></div><div class='entry'>{body}</div><div role=contentinfo>{'legal ' * 300}</div>"


def made(kind, host, n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        blocks = sentences(rng, rng.randint(1, 9))
        blocks[0] += " a < b & c > d é"
        want = [f"{b} end" for b in blocks] if kind is named else blocks
        rows.append((f"http://{host}/{i}", kind(rng, blocks), "\n\n".join(" ".join(w.split()) for w in want)))
    return rows


@pytest.fixture(scope="module")
def planted(spark):
    rows = made(shop, "shop.example", 40, 1) + made(plain, "plain.example", 40, 2) + made(named, "named.example", 40, 3) + made(shop, "one.example", 1, 4)
    random.Random(5).shuffle(rows)
    pages = spark.createDataFrame([(i, u, h, "h", 1, "w", "t") for i, (u, h, _) in enumerate(rows)], SCHEMA).repartition(5)
    return rows, {r["page_id"]: r["text"] for r in he.main_texts(pages).collect()}


def test_planted_templates(planted):
    rows, got = planted
    wrong = [(u, want, got[i]) for i, (u, _, want) in enumerate(rows) if got[i] != want]
    assert not wrong, (len(wrong), wrong[0])


def accepts(items, stream):
    """Whether a stream of items is of a wrapper's language, by trying every way."""
    seen = set()

    def way(i, j):
        if (i, j) in seen:
            return False
        seen.add((i, j))
        if i == len(items):
            return j == len(stream)
        item = items[i]
        if item[1] & he.OPTIONAL and way(i + 1, j):
            return True
        if item[0] == "()":
            ends = {j}
            while ends:
                new = set()
                for e in ends:
                    new |= {k for k in range(e + 1, len(stream) + 1) if accepts(item[2], stream[e:k])}
                if any(way(i + 1, e) for e in new):
                    return True
                ends = new - {j} if item[1] & he.REPEATED else set()
            return False
        k = j
        while k < len(stream) and stream[k][0] == item[0] and (item[0] == "#" or accepts(item[2], stream[k][2])):
            k += 1
            if way(i + 1, k):
                return True
            if not item[1] & he.REPEATED:
                break
        return False

    return way(0, 0)


def unfolded(node):
    return [[k.key, 0, unfolded(k)] if isinstance(k, he.Node) else ["#", 0, []] for k in node.kids]


def test_wrappers_accept_their_pages():
    pages = ["<ul><li>a<li>b</ul><p>x", "<ul><li>a</ul><h2>h</h2><p>x<p>y", "<p>x<h2>h</h2>", "<h2>a</h2><p>b<h2>c</h2><p>d<p>e<h2>f</h2><p>g",
             "<ul></ul><h2>a</h2><p>b"]
    wrapper = None
    for page in pages:
        own = he.stream(he.parse(page))
        assert accepts(own, unfolded(he.parse(page)))
        wrapper = own if wrapper is None else he.align(wrapper, own)
    for page in pages:
        assert accepts(wrapper, unfolded(he.parse(page))), page


def test_squares_fold():
    own = he.stream(he.parse("<h2>a</h2><p>b<p>c<h2>d</h2><p>e<h2>f</h2><p>g"))
    assert [i[0] for i in own] == ["()"] and own[0][1] & he.REPEATED
    assert [i[0] for i in own[0][2]] == ["h2", "p"] and own[0][2][1][1] & he.REPEATED


def test_odd_pages(spark):
    long = "<article>" + "".join(f"<p>word{i} <i>x</i>" for i in range(30_000)) + "</article>"
    pages = [None, "", "   ", "text alone", "<", "<p", "<p>a<", "</p></div>", "<!-- open", "<script>x", "<article></article>", long, "<p>a &lt;b&gt; &amp;amp; &#233;&nbsp;c</p>",
             "<div " * 2000, "<div>" * 300 + "deep" + "</div>" * 300, "<p title=\"don't\">kept</p><a href='x>y</a>"]
    rows = [(i, None if i % 2 else f"http://h{i}.example", p, None, None, None, None) for i, p in enumerate(pages)] + [(None, None, None, None, None, None, None)] * 2
    got = he.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(t is not None for t in text.values())
    assert text[0] == text[1] == text[2] == text[8] == text[9] == text[10] == text[None] == ""
    assert text[3] == "text alone" and text[12] == "a <b> &amp; é c" and text[14] == "deep"
    assert text[11] == "\n\n".join(f"word{i} x" for i in range(30_000))


def test_no_pages(spark):
    assert he.main_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hosts_handed_on_early(spark, planted, monkeypatch):
    """The same texts when wrappers are handed on and joined in many parts, and without a broadcast."""
    rows, got = planted
    monkeypatch.setattr(he, "HOSTS", 1)
    monkeypatch.setattr(he, "BROADCAST", -1)
    pages = spark.createDataFrame([(i, u, h, "h", 1, "w", "t") for i, (u, h, _) in enumerate(rows)], SCHEMA).repartition(11)
    assert {r["page_id"]: r["text"] for r in he.main_texts(pages).collect()} == got
