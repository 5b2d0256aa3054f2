"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page's token stream (block tags and texts) is read as a tree. A wrapper is such a tree whose parts may be optional or
repeated and whose texts may be slots. Aligning a wrapper with the next page resolves each mismatch: different texts
become a slot, a part that only one side has becomes optional, and equal neighbours (or equal runs of up to four parts)
become one repeated group. There is no union, so a wrapper stays as small as the host's template. Each task folds its
own pages into one wrapper per host; those partial wrappers meet in two steps, by host and salt and then by host.

The wrapper's slots say which of its parts is the article: of the parts that tags or names offer, those whose text
varies from page to page, else the part with most text in slots. A page is then aligned with the wrapper, part by part,
through optional parts and repeated groups; its text is what stands in the article's parts, also where it is the same on
every page, less the parts inside that are named as menus, notices, adverts, forms, comments and the like. A name never
leaves out a part that holds most of the article, nor anything around the article.

Parts more than MAX_DEPTH deep belong to the part at that depth, so that no page is too deep; their text stays.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_clashes, small_arrow_batches, table, written

#: Tags by their part in the page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg select option datalist canvas video audio".split())
BLOCK = set(
    """html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody
    tfoot tr caption figure figcaption nav header footer aside form fieldset address details summary hr center
    hgroup search menu dialog""".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
SCOPE = set("ul ol dl table menu html body article section div".split())
CELL = set("td th br".split())
OUT_TAGS = set("head nav footer aside form fieldset dialog menu search button".split())
OUT_WORDS = set(
    """ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr
    notice notices alert popup modal overlay newsletter subscribe subscription signup menu nav navbar navigation
    breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social footer comment comments
    respond disqus pagination pager toolbar skip login search masthead topbar""".split()
)
MAIN_WORDS = set("article post entry story content main articlebody".split())
#: Partial wrappers of a host meet in this many groups first.
SALTS = 64
#: Wrappers are broadcast up to this many bytes in all; beyond it pages and wrappers are joined by a shuffle.
BROADCAST_BYTES = 64 << 20

#: Words that make a class tell a state and not a part: "has-sidebar", "cookie-enabled".
STATE_FIRST = set("has no not with without is show hide hides use uses js".split())
STATE_LAST = set("enabled disabled active inactive open opened closed visible hidden on off ready loaded left right".split())
#: Depth of a wrapper; cells of a table of two sequences of parts that are aligned exactly.
MAX_DEPTH, MAX_CELLS = 100, 250_000

_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# A node is [key, optional, repeated, text, chars, link_chars, children]; text is None (none), a string that all pages
# share, or "*" (a slot). Children are nodes.
KEY, OPTIONAL, REPEATED, TEXT, CHARS, LINKS, CHILDREN = range(7)


def _key(tag: str, attributes: str) -> str:
    """Tag and the words of its class, id and role, without what may number single pages or tell a state."""
    words: set[str] = set()
    if "=" in attributes:
        for _, value in _ATTR.findall(attributes):
            for name in value.strip("\"'").split():
                parts = [w.lower() for w in _PARTS.findall(name)]
                if len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
                    continue
                words.update(w for w in parts if len(w) > 1)
    return " ".join([tag, *sorted(words)])


class _Tags:
    """The end of each tag: the first > outside quotes. Once there is none before the page ends, the first > at all, so
    that a page with a quote too many is read once and not once for each tag."""

    def __init__(self, page: str):
        self.page, self.loose = page, False
        self.last = {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        page, start = self.page, at
        while not self.loose:
            end = page.find(">", at)
            if end < 0:
                break
            quote = min((i for i in (page.find(q, at, end) for q in self.last) if i >= 0), default=-1)
            if quote < 0:
                return end
            if self.last[page[quote]] <= quote:  # never closed: a sign like any other
                at = quote + 1
                continue
            at = page.index(page[quote], quote + 1) + 1
        self.loose = True
        return page.find(">", start)


def parse(page: str | None) -> tuple[list, list[tuple[list, str]]]:
    """The page's tree, and its blocks of text in page order as (the part they stand in, text)."""
    page = page or ""
    root = ["", False, False, None, 0, 0, []]
    stack: list[list] = [root]
    tags = [""]
    opened: Counter[str] = Counter()
    blocks: list[tuple[list, str]] = []
    text: list[str] = []
    link = linked = 0
    ends = _Tags(page)

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                node = stack[-1]
                node[TEXT] = words if node[TEXT] in (None, words) else "*"
                node[CHARS] += len(words)
                node[LINKS] += min(linked, len(words))
                blocks.append((node, words))
        linked = 0

    def close(to: int) -> None:
        flush()
        opened.subtract(tags[to:])
        del stack[to:], tags[to:]

    def innermost(tag: str) -> int:
        at = len(tags) - 1
        while tags[at] != tag:
            at -= 1
        return at

    at = 0
    while True:
        found = _OPEN.search(page, at)
        if found and found[2]:
            end_of_tag = ends.end(found.end())
            if end_of_tag < 0:  # no tag ends any more: the rest is text
                found = None
        chunk = page[at : found.start()] if found else page[at:]
        if chunk:
            text.append(chunk)
            linked += len(chunk) if link else 0
        if not found:
            break
        if not found[2]:
            at = found.end()
            continue
        tag, end, attributes = found[2].lower(), bool(found[1]), page[found.end() : end_of_tag]
        at = end_of_tag + 1
        if tag in RAW:
            if not end and not attributes.endswith("/"):
                behind = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = behind.end() if behind else len(page)
            continue
        if tag == "a":
            link = 0 if end else 1
        elif tag in CELL:
            text.append(" ")
        elif tag in BLOCK or tag in OUT_TAGS:
            if end:
                if opened[tag] > 0:
                    close(innermost(tag))
                else:
                    flush()
                continue
            if opened["p"] > 0 and tag != "button":
                close(innermost("p"))
            for i in range(len(tags) - 1, 0, -1) if tag in CLOSES else ():
                if tags[i] in CLOSES[tag]:
                    close(i)
                    break
                if tags[i] in SCOPE:
                    break
            flush()
            link = 0
            if tag not in VOID:
                if len(stack) <= MAX_DEPTH:
                    node = [_key(tag, attributes), False, False, None, 0, 0, []]
                    stack[-1][CHILDREN].append(node)
                else:
                    node = stack[-1]
                stack.append(node)
                tags.append(tag)
                opened[tag] += 1
    close(1)
    return root, blocks


def _same(a: list[list], b: list[list]) -> bool:
    return [x[KEY] for x in a] == [x[KEY] for x in b]


def fold(node: list) -> list:
    """Turn equal neighbours, and equal runs of up to four parts, into one repeated group, from the leaves up."""
    children: list[list] = []
    for child in node[CHILDREN]:
        children.append(fold(child))
        for size in range(1, 5):
            if len(children) >= 2 * size and _same(children[-size:], children[-2 * size : -size]):
                for earlier, later in zip(children[-2 * size : -size], children[-size:], strict=True):
                    earlier[:] = merge(earlier, later, same_page=True)
                    earlier[REPEATED] = True
                del children[-size:]
                break
    node[CHILDREN] = children
    return node


def merge(a: list, b: list, same_page: bool = False) -> list:
    """One wrapper for what either of two wrappers with the same key stands for."""
    text = a[TEXT] if a[TEXT] == b[TEXT] or b[TEXT] is None else b[TEXT] if a[TEXT] is None else "*"
    return [a[KEY], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], text, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], align(a[CHILDREN], b[CHILDREN])]


def _pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; of very long sequences, of one that takes each key at its next place."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    middle: list[tuple[int, int]] = []
    if len(x) * len(y) > MAX_CELLS:
        places: dict[str, list[int]] = {}
        for j, key in enumerate(y):
            places.setdefault(key, []).append(j)
        at = 0
        for i, key in enumerate(x):
            later = places.get(key, [])
            k = bisect_left(later, at)
            if k < len(later):
                middle.append((head + i, head + later[k]))
                at = later[k] + 1
    elif x and y:
        length = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                length[i][j] = length[i + 1][j + 1] + 1 if x[i] == y[j] else max(length[i + 1][j], length[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                middle.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif length[i + 1][j] >= length[i][j + 1]:
                i += 1
            else:
                j += 1
    return [*((k, k) for k in range(head)), *middle, *((len(a) - k, len(b) - k) for k in range(tail, 0, -1))]


def align(a: list[list], b: list[list]) -> list[list]:
    """Align two sequences of parts by a common subsequence of keys; what has no partner is optional."""
    out: list[list] = []

    def add(part: list) -> None:
        if out and out[-1][KEY] == part[KEY]:  # an optional part beside an equal one: a repeated group
            out[-1] = merge(out[-1], part)
            out[-1][REPEATED] = True
        else:
            out.append(part)

    def alone(part: list) -> None:
        add([*part[:OPTIONAL], True, *part[OPTIONAL + 1 :]])

    i = j = 0
    for x, y in [*_pairs([n[KEY] for n in a], [n[KEY] for n in b]), (len(a), len(b))]:
        for part in (*a[i:x], *b[j:y]):
            alone(part)
        if x < len(a):
            add(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression, for people to read."""
    inner = ("#" if node[TEXT] else "") + "".join(map(expression, node[CHILDREN]))
    group = f"<{node[KEY]}>{inner}</>" if node[KEY] else inner
    return f"({group}){'*' if node[OPTIONAL] and node[REPEATED] else '+' if node[REPEATED] else '?'}" if node[OPTIONAL] or node[REPEATED] else group


def left_out(key: str) -> bool:
    tag, *words = key.split(" ")
    return tag in OUT_TAGS or bool(OUT_WORDS.intersection(words)) and tag not in ("html", "body")


def _variable(node: list) -> int:
    """Characters outside links of a part's own slot."""
    return max(0, node[CHARS] - node[LINKS]) if node[TEXT] == "*" else 0


def mark_article(wrapper: list) -> list:
    """Append to each part of a wrapper what it is: 1 the article begins here, -1 left out, 0 as the part around it.

    Candidates are article tags, else main tags, else parts named like an article, in each case at first those that no
    name of their own or around them leaves out, and then the others; else the part whose own blocks vary most. Of a
    host's candidates those whose text varies count, if there are any."""
    order: list[tuple[list, bool, bool]] = []  # part, left out by a name, left out by a tag (its own or one around it)
    stack = [(wrapper, False, False)]
    while stack:
        node, named, out = stack.pop()
        tag = node[KEY].split(" ")[0]
        out = out or tag in OUT_TAGS
        named = named or bool(node[KEY]) and left_out(node[KEY])
        order.append((node, named, out))
        stack += [(c, named, out) for c in reversed(node[CHILDREN])]
    variable: dict[int, int] = {}
    plain: dict[int, int] = {}
    for node, _, _ in reversed(order):  # children come before their parents here
        kept = [c for c in node[CHILDREN] if not left_out(c[KEY])]
        variable[id(node)] = _variable(node) + sum(variable[id(c)] for c in node[CHILDREN])
        plain[id(node)] = max(0, node[CHARS] - node[LINKS]) + sum(plain[id(c)] for c in kept)
    tiers: dict[tuple[bool, int], list[list]] = {}
    for node, named, out in order:
        tag, *words = node[KEY].split(" ")
        if tag == "article":
            tier = 0
        elif tag == "main" or tag in ("div", "section") and "main" in words:
            tier = 1
        elif tag in ("div", "section") and MAIN_WORDS.intersection(words):
            tier = 2
        else:
            continue
        if not out and plain[id(node)] + variable[id(node)] > 0:
            tiers.setdefault((named, tier), []).append(node)
    regions: list[list] = []
    for rank in sorted(tiers):
        regions = [n for n in tiers[rank] if variable[id(n)]] or tiers[rank]
        break
    if not regions:
        own = lambda n: (sum(map(_variable, [n, *n[CHILDREN]])), max(0, n[CHARS] - n[LINKS]) + sum(c[CHARS] - c[LINKS] for c in n[CHILDREN] if not left_out(c[KEY])))
        regions = [max([n for n, named, _ in order if not named] or [wrapper], key=own)]
    chosen = {id(n) for n in regions}
    whole = {False: plain, True: variable}
    stack = [(wrapper, 0, False)]
    while stack:
        node, around, varies = stack.pop()
        mark = 0
        if id(node) in chosen:
            mark, varies = 1, variable[id(node)] > 0
            around = max(around, whole[varies][id(node)])
        elif around and left_out(node[KEY]) and (node[KEY].split(" ")[0] in OUT_TAGS or 2 * whole[varies][id(node)] <= around):
            mark = -1
        node.append(mark)
        stack += [(c, around, varies) for c in node[CHILDREN]]
    return wrapper


def extract(page: str | None, wrapper: list) -> str:
    """The text of a page's blocks in the article's parts of a marked wrapper. A page that has none of them is its own."""
    root, blocks = parse(page)
    for marked in (wrapper, None):
        if marked is None:
            marked = mark_article(fold(parse(page)[0]))
        inside: dict[int, bool] = {}
        stack: list[tuple[list, list | None, bool]] = [(root, marked, False)]
        while stack:
            node, partner, kept = stack.pop()
            if partner is not None:
                kept = partner[-1] > 0 or kept and partner[-1] == 0
            else:
                kept = kept and not left_out(node[KEY])
            inside[id(node)] = kept
            places: dict[str, list[int]] = {}
            for k, part in enumerate(partner[CHILDREN] if partner is not None else ()):
                places.setdefault(part[KEY], []).append(k)
            at = 0
            for child in node[CHILDREN]:  # a part may repeat, alone or with those beside it, or be missing
                same = places.get(child[KEY])
                if same:
                    k = bisect_left(same, at)
                    at = same[k] if k < len(same) else same[0]
                    stack.append((child, partner[CHILDREN][at], kept))
                else:
                    stack.append((child, None, kept))
        text = "\n\n".join(words for node, words in blocks if inside[id(node)])
        if text:
            return text
    return ""


def _fold_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    wrappers: dict[str, list] = {}
    for batch in batches:
        for host, page in zip(batch["host"], batch["html"], strict=True):
            tree = fold(parse(page)[0])
            wrappers[host] = merge(wrappers[host], tree) if host in wrappers else tree
            if len(wrappers) >= 2000:  # a task with pages of very many hosts gives partial wrappers early
                yield _rows(wrappers)
                wrappers = {}
    yield _rows(wrappers)


def _rows(wrappers: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({"host": list(wrappers), "wrapper": [json.dumps(w) for w in wrappers.values()]}, dtype=object)


def _merge_group(rows: pd.DataFrame) -> pd.DataFrame:
    out: list | None = None
    for text in sorted(rows["wrapper"]):
        out = json.loads(text) if out is None else merge(out, json.loads(text))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(out)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """pages: host, html. One row for each host: host, wrapper (JSON of its tree)."""
    partial = pages.mapInPandas(_fold_pages, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    some = partial.groupBy("host", "salt").applyInPandas(_merge_group, "host string, wrapper string")
    return some.groupBy("host").applyInPandas(_merge_group, "host string, wrapper string")


def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[str, list] = {}
    for pages, wrappers in batches:
        out = []
        for page, wrapper in zip(pages, wrappers, strict=True):
            if wrapper not in known:
                if len(known) > 1000:
                    known.clear()
                known[wrapper] = mark_article(json.loads(wrapper))
            out.append(extract(page, known[wrapper]))
        yield pd.Series(out, dtype=object)


def extract_text(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """Replace the html of every page by text and n_chars (code points).

    The host is what stands between // and the next / of the url, in lower case; pages of null or other urls share the
    host "". Null or empty html: empty text. Repeated rows: each has its own, equal result. Columns of pages named like
    the new ones are replaced. Empty table: empty result.
    """
    spark = pages.sparkSession
    small_arrow_batches(spark, 500)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1), F.lit("")))
    hosted = drop_clashes(pages, ["text", "n_chars", "_host", "_w"], keep=(url, page)).withColumn("_host", host)
    wrappers = written(infer_wrappers(hosted.select(F.col("_host").alias("host"), F.col(f"`{page}`").alias("html"))), "wrappers")
    wrappers = wrappers.select(F.col("host").alias("_host"), F.col("wrapper").alias("_w"))
    size = wrappers.agg(F.sum(F.length("_w") + 100)).first()[0] or 0
    wrappers = F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers.hint("shuffle_hash")
    text = F.pandas_udf(_extract, "string")(F.col(f"`{page}`"), F.col("_w"))
    out = hosted.join(wrappers, "_host", "left").withColumn("_t", text).drop("_host", "_w", page)
    return out.withColumns({"text": F.col("_t"), "n_chars": F.length("_t").cast("long")}).drop("_t")


def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
