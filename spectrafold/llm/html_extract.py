"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of opening tags, texts and closing tags, nested by the usual rules for tags left open. Adjacent
squares of one shape fold to repeated groups. Streams of one host are then aligned one after the other: where they
agree, elements merge and texts meet in one slot; a mismatch is resolved by an iterator (a repeated group takes in
another instance), else by skipping the fewer elements on one side, which become optional. The wrapper's slots keep
how many texts met there, how much of them was link text, and whether all of them were the same.

Tasks align the pages they read and hand on one wrapper a host (hosts are handed on early when many are
open); these are aligned again by salted host and then by host, in a fixed order, so a host with a third of all
pages is neither collected nor shuffled as pages. Wrappers grow with the template, not with the pages. They
go back to the pages by a broadcast if their counted size is small, else by a join that may be split where a
host is hot.

A page is read along its host's wrapper. Elements for menus, notices, adverts, forms, comments and the like, slots
that say the same on all pages of a host and groups that are mostly links are no main text; of what is left, the
element that stands for an article (by tag, role or name, else by holding most of the text) with most text on
the page is taken.

Results for odd input: a null or empty html, or one without main text, gives an empty text; pages with no host in
their url form one host; repeated rows are repeated pages; a null page_id is kept; an empty table gives an empty
result; other columns are ignored; nothing is cut from long pages.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .registry import query, table

HOSTS = 500  # wrappers a task holds before it hands them on
SALTS = 32
PERIOD = 32  # elements of a square, at most
SAME = 3  # pages whose slot says the same before that counts
BROADCAST = 32 << 20  # bytes of wrappers that may be broadcast
REPEATED, OPTIONAL = 1, 2

# fixed values: names of the markup language and usual names of page parts
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
             "sub sup time tt u var br wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed".split())
NEVER = set("head script style noscript template iframe svg math canvas object nav aside footer form button select textarea "
            "dialog menu title audio video".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
               "section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = set("ul ol dl table html body article section div main aside nav td th select".split())
NOISE = set("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies "
            "consent gdpr notice notices notification alert alerts popup modal overlay newsletter subscribe subscription signup sidebar menu "
            "menubar nav navbar navigation breadcrumb breadcrumbs footer share sharing social related recommended recommendations "
            "comment comments commentlist disqus reply replies respond login search pagination pager toolbar widget widgets skip hidden "
            "topbar masthead copyright disclaimer toc teaser teasers".split())
OWN_NOISE = set("comment comments reply ad ads advert sponsored promo related teaser teasers".split())  # also on article and main
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BODY_NAMES = set("article post entry story content articlebody maincontent posting blogpost main text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)"
                    r"(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?=[\s=/]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+")
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    """An element: its tag, its key among siblings, what its names say, children (nodes and texts)."""

    __slots__ = ("tag", "key", "noise", "tier", "kids")

    def __init__(self, tag: str, key: str, noise: bool, tier: int):
        self.tag, self.key, self.noise, self.tier, self.kids = tag, key, noise, tier, []


class Text:
    __slots__ = ("parts", "links")

    def __init__(self):
        self.parts, self.links = [], 0

    def string(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


_NAMES: dict[tuple[str, str], tuple[str, bool, int]] = {}


def _described(tag: str, attributes: str) -> tuple[str, bool, int]:
    """Key of an element, whether its names exclude it, and how surely it is an article (1 most, 0 not)."""
    known = _NAMES.get((tag, attributes))
    if known:
        return known
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = [n for n in f"{found.get('class', '')} {found.get('id', '')}".split() if n]
    words = {w.lower() for n in names if not re.match(r"(?:has|with|no|is)[-_]", n) for w in _SPLIT.findall(n)}
    words |= {"".join(_NAME.findall(n.lower())) for n in names}
    role = found.get("role", "").lower()
    noise = (tag in NEVER or role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
             or bool(re.search(r"display\s*:\s*none", found.get("style", ""))))
    if tag in ("article", "main"):
        noise = noise or bool(words & OWN_NOISE)
    elif tag not in ("html", "body"):
        noise = noise or bool(words & NOISE)
    if tag == "article" or found.get("itemprop", "").lower() == "articlebody":
        tier = 1
    elif tag == "main" or role == "main":
        tier = 2
    else:
        tier = 3 if tag not in INLINE and tag not in ("html", "body") and words & BODY_NAMES else 0
    key = tag + "".join(sorted({"." + "-".join(_NAME.findall(n.lower())) for n in names}))
    if len(_NAMES) < 50_000:
        _NAMES[tag, attributes] = (key, noise, tier)
    return key, noise, tier


def parse(page: str) -> Node:
    """The elements of a page; inline elements are part of the text around them unless their names exclude them."""
    root = Node("html", "html", False, 0)
    stack: list[Node | str] = [root]  # open elements; open inline tags as names
    blocks = [root]
    text: Text | None = None
    links = 0
    at, size = 0, len(page)

    def pop_to(k: int) -> None:
        nonlocal text, links
        for gone in stack[k:]:
            if isinstance(gone, Node):
                blocks.pop()
                text = None
            elif gone == "a":
                links -= 1
        del stack[k:]

    while at < size:
        m = _TOKEN.search(page, at)
        piece = page[at:m.start()] if m else page[at:]
        if piece:
            if text is None:
                if not piece.isspace():
                    text = Text()
                    blocks[-1].kids.append(text)
            if text is not None:
                text.parts.append(piece)
                if links:
                    text.links += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # a closing tag closes what stands open within its element
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k] if isinstance(stack[k], str) else stack[k].tag
                if name == tag:
                    pop_to(k)
                    break
                if tag in INLINE and not isinstance(stack[k], str):
                    break
            continue
        attributes = m[3] if m[3] is not None else m[4] or ""
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "html":
            continue
        key, noise, tier = _described(tag, attributes)
        if tag in INLINE and not noise:
            if tag in ("br", "wbr", "img"):
                if text is not None and tag != "wbr":
                    text.parts.append(" ")
            elif not attributes.endswith("/"):
                stack.append(tag)
                links += tag == "a"
            continue
        inline = tag in INLINE
        if not inline:
            shut = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            if shut:
                for k in range(len(stack) - 1, 0, -1):
                    if isinstance(stack[k], Node):
                        if stack[k].tag in shut:
                            pop_to(k)
                            if stack[-1] is not root and isinstance(stack[-1], Node) and stack[-1].tag in shut and tag not in ("li", "dt", "dd"):
                                continue
                            break
                        if stack[k].tag in SCOPE:
                            break
        if tag in VOID:
            if tag == "hr":
                text = None
            continue
        node = Node(tag, key, noise, tier)
        blocks[-1].kids.append(node)
        if attributes.endswith("/") and tag in ("svg", "path"):
            text = None
            continue
        held = text
        blocks.append(node)
        stack.append(node)
        text = None
        if inline:  # an excluded inline element does not cut the text around it
            depth, end = 1, at
            for n in _TOKEN.finditer(page, at):
                if n[2] and n[2].lower() == tag:
                    depth += -1 if n[1] else 1
                    if not depth:
                        end = n.end()
                        break
            if not depth:
                stack.pop()
                blocks.pop()
                blocks[-1].kids.pop()
                at, text = end, held
    return root


# -- wrappers ----------------------------------------------------------------------------
# an item is [key, flags, body]; a slot is ["#", flags, [texts, characters, link characters, digest or None]];
# a group of several elements that repeats has the key "()"

GENERIC = set("div section td span table tbody tr center".split())


def _tag(item: list) -> str:
    return item[0].split(".", 1)[0]


def _shape(item: list) -> str:
    """What two items must have in common to stand in one place."""
    if item[0] == "#":
        return "#"
    if item[0] == "()":
        return "(" + " ".join(_shape(i) for i in item[2]) + ")"
    if _tag(item) in GENERIC:
        return item[0] + "(" + " ".join(sorted({i[0] for i in item[2]})) + ")"
    return item[0]


def fold(items: list) -> list:
    """Adjacent squares as repeated items."""
    period = 1
    while period <= min(PERIOD, len(items) // 2):
        shapes = [_shape(i) for i in items]
        out, k, changed = [], 0, False
        while k < len(items):
            n = 1
            while shapes[k + n * period:k + (n + 1) * period] == shapes[k:k + period] and k + (n + 1) * period <= len(items):
                n += 1
            if n > 1:
                body = items[k:k + period]
                for t in range(1, n):
                    body = align(body, items[k + t * period:k + (t + 1) * period])
                out.append([body[0][0], body[0][1] | REPEATED, body[0][2]] if len(body) == 1 else ["()", REPEATED, body])
                k += n * period
                changed = True
            else:
                out.append(items[k])
                k += 1
        items = out
        period = 1 if changed and period > 1 else period + 1
    return items


def _alike(x: list, y: list) -> bool:
    if x[0] != y[0]:
        return False
    if x[0] == "()":
        return _shape(x[2][0]) == _shape(y[2][0])
    if x[0] != "#" and _tag(x) in GENERIC and "." not in x[0]:
        a, b = {i[0] for i in x[2]}, {i[0] for i in y[2]}
        return not a or not b or 2 * len(a & b) >= min(len(a), len(b))
    return True


def _merged(x: list, y: list) -> list:
    flags = x[1] | y[1]
    if x[0] != "#":
        return [x[0], flags, align(x[2], y[2])]
    (n, chars, links, same), (m, more, other, text) = x[2], y[2]
    return ["#", flags, [n + m, chars + more, links + other, same if same == text else None]]


def _instance(group: list, items: list, at: int) -> int:
    """How many items from ``at`` on are an instance of a repeated group, 0 if none."""
    k = at
    for item in group[2]:
        if k < len(items) and _alike(item, items[k]):
            k += 1
        elif not item[1] & OPTIONAL:
            return 0
    return k - at


def _optional(item: list) -> list:
    return [item[0], item[1] | OPTIONAL, item[2]]


def align(a: list, b: list) -> list:
    """The wrapper of two streams."""
    out: list = []
    i = j = 0
    while i < len(a) and j < len(b):
        if _alike(a[i], b[j]):
            out.append(_merged(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        # an iterator takes in instances of its body
        if a[i][0] == "()" and (n := _instance(a[i], b, j)):
            out.append(["()", a[i][1], align(a[i][2], b[j:j + n])])
            i, j = i + 1, j + n
            continue
        if b[j][0] == "()" and (n := _instance(b[j], a, i)):
            out.append(["()", b[j][1], align(a[i:i + n], b[j][2])])
            i, j = i + n, j + 1
            continue
        # the side on which fewer items have to be skipped has them as optional
        for d in range(1, max(len(a) - i, len(b) - j)):
            if j + d < len(b) and _alike(a[i], b[j + d]):
                out += [_optional(x) for x in b[j:j + d]]
                j += d
                break
            if i + d < len(a) and _alike(a[i + d], b[j]):
                out += [_optional(x) for x in a[i:i + d]]
                i += d
                break
        else:
            out += [_optional(a[i]), _optional(b[j])]
            i, j = i + 1, j + 1
    return out + [_optional(x) for x in a[i:]] + [_optional(x) for x in b[j:]]


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:12]


def stream(node: Node) -> list:
    """A page's elements as items, squares folded; excluded elements keep only their key."""
    items = []
    for kid in node.kids:
        if isinstance(kid, Node):
            items.append([kid.key + ("!" if kid.noise else "") + (f"^{kid.tier}" if kid.tier and not kid.noise else ""), 0, [] if kid.noise else stream(kid)])
        else:
            text = kid.string()
            if text:
                items.append(["#", 0, [1, len(text), min(len(text), kid.links), _digest(text)]])
    return fold(items)


# -- from wrappers to rules --------------------------------------------------------------

def _weigh(items: list, within: bool) -> float:
    """Marks slots that are no main text and sums the characters of the others, in place.

    A marked slot's flags become the digest of the text it always has, or "a" where it is mostly links.

    ``within``: inside an element that stands for an article, where equal or linked texts count as well.
    """
    total = 0.0
    for item in items:
        if item[0] == "#":
            texts, chars, links, same = item[2][:4]
            dull = "" if within else same if same is not None and texts >= SAME else "a" if 2 * links > chars else ""
            if dull:
                item[1] = dull
            item[2] = 0 if dull else chars - links
            total += item[2]
        else:
            own = _weigh(item[2], within or "^1" in item[0])
            item.append(own)
            total += own
    return total


def rules(wrapper: list) -> list:
    """A wrapper for reading pages: slots are marked, and an element that holds most text is named where none stands for an article."""
    whole = _weigh(wrapper, False)
    items, best = wrapper, None
    while whole > 0:
        heavy = next((i for i in items if i[0] != "#" and "!" not in i[0] and i[3] >= 0.6 * whole), None)
        # a group that repeats is text within its parent
        if heavy is None or heavy[0] == "()" or heavy[1] & REPEATED or not any(i[0] != "#" for i in heavy[2]):
            break
        best, items, whole = heavy, heavy[2], heavy[3]
    if best is not None and not re.search(r"\^[123]", best[0]):
        best[0] += "^4"
    return _plain(wrapper)


def _plain(items: list) -> list:
    return [[i[0], i[1]] if i[0] == "#" else [i[0], i[1], _plain(i[2])] for i in items]


def _flat(items: list) -> list[list]:
    """Items in order, groups opened."""
    out: list = []
    for item in items:
        if item[0] == "()":
            out += _flat(item[2])
        else:
            out.append(item)
    return out


def _fits(kid: Node, item: list) -> bool:
    """Whether an element without names has the children of a wrapper's element."""
    a = {k.key if isinstance(k, Node) else "#" for k in kid.kids}
    b = {re.split(r"[!^]", i[0])[0] for i in _flat(item[2])}
    return not a or not b or 2 * len(a & b) >= min(len(a), len(b))


def _read(node: Node, items: list, containers: list, open_: list) -> None:
    """Adds the page's texts to the containers they lie in, following the wrapper's items."""
    flat, at = _flat(items), 0
    by_key: dict[str, list[int]] = {}
    for k, item in enumerate(flat):
        by_key.setdefault(re.sub(r"\^4$", "", item[0]), []).append(k)
    for kid in node.kids:
        if isinstance(kid, Node):
            if kid.noise or (kid.tag == "header" and not any(t in (1, 2) for t, _ in open_)):
                continue
            key = kid.key + (f"^{kid.tier}" if kid.tier else "")
        else:
            key = "#"
        places = by_key.get(key, ())
        if len(places) > 1 and key in GENERIC:
            places = [p for p in places if _fits(kid, flat[p])] or places
        k = next((p for p in places if p >= at), places[0] if places else None)
        item = None
        if k is not None:
            item = flat[k]
            at = k if isinstance(item[1], int) and item[1] & REPEATED else k + 1
        if key == "#":
            text = kid.string()
            if text:
                mark = item[1] if item is not None and isinstance(item[1], str) and not any(t == 1 for t, _ in open_) else ""
                dull = 2 * kid.links > len(text) if mark == "a" else bool(mark) and mark == _digest(text)
                for _, found in open_:
                    if not dull:
                        found.append(text)
            continue
        tier = kid.tier or (4 if item is not None and item[0].endswith("^4") else 0)
        if tier:
            mine: list = []
            containers.append((tier, mine))
            open_.append((tier, mine))
        _read(kid, item[2] if item is not None else [], containers, open_)
        if tier:
            open_.pop()


def main_text(page: str | None, wrapper: list) -> str:
    """Blocks of the main text, joined by an empty line."""
    if not page:
        return ""
    containers: list = [(5, [])]
    _read(parse(page), wrapper, containers, [containers[0]])
    texts = [(t, sum(map(len, b)), b) for t, b in containers if b]
    if not texts:
        return ""
    tier = min(t for t, _, _ in texts)
    return "\n\n".join(max((x for x in texts if x[0] == tier), key=lambda x: x[1])[2])


# -- tables ------------------------------------------------------------------------------

def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _given_out(held: dict[str, list], salt: int) -> pa.RecordBatch:
    names = sorted(held)
    return pa.RecordBatch.from_pydict({"host": names, "salt": [salt] * len(names), "wrapper": [json.dumps(held[n], separators=(",", ":")) for n in names]},
                                      schema=pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())]))


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    salt = (context.partitionId() if context else 0) % SALTS
    held: dict[str, list] = {}
    for batch in batches:
        for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if not page:
                continue
            own = stream(parse(page))
            held[name] = align(held[name], own) if name in held else own
            if len(held) > HOSTS:
                yield _given_out(held, salt)
                held = {}
    if held:
        yield _given_out(held, salt)


def _joined(last: bool):
    def run(batches):
        key, now = None, None
        for batch in batches:
            out: dict[str, list] = {}
            for name, salt, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "wrapper"))):
                own = json.loads(wrapper)
                if (name, salt) == key:
                    now = align(now, own)
                else:
                    if key is not None:
                        out[key[0]] = rules(now) if last else now
                        if len(out) >= HOSTS:
                            yield _given_out(out, 0)
                            out = {}
                    key, now = (name, salt), own
            if out:
                yield _given_out(out, 0)
        if key is not None:
            yield _given_out({key[0]: rules(now) if last else now}, 0)

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """host, salt (0), wrapper: the marked wrapper of each host, as JSON."""
    schema = "host string, salt int, wrapper string"
    own = pages.select(host().alias("host"), "html").mapInArrow(_inferred, schema)
    once = own.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(_joined(False), schema)
    return once.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_joined(True), schema)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    known = durable(wrappers(pages)).select(F.col("host").alias("_host"), "wrapper")
    size = known.agg(F.sum(F.length("wrapper") + F.length("_host"))).first()[0] or 0
    known = F.broadcast(known) if size <= BROADCAST else known
    rows = pages.select("page_id", "url", "html", host().alias("_host")).join(known, "_host", "left")
    schema = rows.select("page_id", "url").schema.add("text", "string")

    def run(batches):
        cache: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, name, wrapper in zip(*(batch.column(c).to_pylist() for c in ("html", "_host", "wrapper"))):
                if name not in cache:
                    if len(cache) > HOSTS:
                        cache.clear()
                    cache[name] = json.loads(wrapper) if wrapper else []
                texts.append(main_text(page, cache[name]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.select("page_id", "url", "html", "_host", "wrapper").mapInArrow(run, schema)


# the given pages have one article each, in headings and paragraphs
_SQL = r"""
WITH inner_html AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
blocks AS (SELECT page_id, url, unnest(regexp_split_to_array(a, '</?(?:p|h1)>')) AS b, generate_subscripts(regexp_split_to_array(a, '</?(?:p|h1)>'), 1) AS k FROM inner_html),
bare AS (SELECT page_id, url, k, regexp_replace(regexp_replace(b, '<br>', ' ', 'g'), '</?b>', '', 'g') AS b FROM blocks),
clean AS (
  SELECT page_id, url, k, trim(regexp_replace(replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''),
    '&#39;', ''''), '&amp;', '&'), '[\x20\x09-\x0D]+', ' ', 'g')) AS b FROM bare)
SELECT page_id, url, coalesce(string_agg(b, chr(10) || chr(10) ORDER BY k) FILTER (b <> ''), '') AS text,
       CAST(length(coalesce(string_agg(b, chr(10) || chr(10) ORDER BY k) FILTER (b <> ''), '')) AS BIGINT) AS n_chars
FROM clean GROUP BY page_id, url
"""


@query("op12_html_extract", _SQL)
def html_extract(spark, folder):
    """The main text of all pages."""
    return main_texts(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))
