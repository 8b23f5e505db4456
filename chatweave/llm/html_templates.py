"""Operator 1: main text of web pages by site template removal.

Pages are parsed into an element tree (implied end tags, raw text elements,
open elements at the end). Each candidate subtree is hashed over its tags,
classes and text. Spark counts per host on how many pages with different main
text a subtree occurs; a subtree on at least ``MIN_PAGES`` of them that are
also ``MIN_SHARE`` of the host's, or ``ENOUGH`` whatever the host's size, is a
template, and is deleted wherever it occurs on that host. Copies of one page count once, so a copied article is no
template; paragraphs and headings directly in an article are never
candidates, so quotations stay. What a host shows too rarely to be counted is
recognised by its role: tag, role attribute, a whole class or id, or one made of
such a word and another that does not speak of the text itself. Comments and
teasers are roles of articles, adverts and notices of any element. A role
does not count for elements that hold the main article: a form that holds an
article or main, and, if a page shows no article or main without roles and its
other text is shorter than the one inside them, the elements around that. The
text that remains in the article (else main, else the body) is the result; main
itself if its other text is longer than all its articles, and with the headline
of main if the article has none.

The second pass parses again and gets the template keys as a sorted array if
there are at most ``MOST_KEYS`` (8 bytes each); beyond that each page gets its
own by a join. No page text is shuffled in the first case.

Defined results: null or empty html gives empty text; a null url, or one
without host, belongs to the host "" ; repeated rows get equal texts (they are
copies of one page); ``<br>`` ends a block; an empty table gives an empty
table. Very long pages are parsed whole.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import join_small, stored

MIN_PAGES, MIN_SHARE, ENOUGH, MOST_KEYS = 5, 0.01, 50, 2_000_000

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
ENDS_P = BLOCK - set("br td th tr tbody thead tfoot".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

# Roles that are never main text.
BOILERPLATE = set("head script style noscript template iframe object nav footer aside form button select textarea dialog menu title svg".split())
BOILERPLATE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header notice notices cookie cookies consent comment comments disqus share social related "
    "newsletter subscribe popup modal widget toolbar".split()
)
#: of an article, or of a single line of text
COMMENT_WORDS = set("comment reply teaser related promo sponsored advert advertisement".split())
LINE_WORDS = set("ad ads advert adverts advertisement advertising sponsored promo notice notices cookie cookies breadcrumb breadcrumbs newsletter".split())
#: compound classes: such a word before or after another one that is not of the text or its layout
COMPOUND = re.compile(
    r"(?:comments?|ads?|adverts?|advertisement|cookies?|related|newsletter|disqus|breadcrumbs?|promo|sponsor|sponsored|popup|modal|sidebar|nav|navbar)[-_](?!free|content|text|title|article|body-text)[a-z0-9_-]+"
    r"|(?!with|has|no|without|article|post|entry|content|main|page|site|is)[a-z0-9]+[-_](?:comments|ads?|adverts?|sidebar|nav|navbar|menu|breadcrumbs?|cookies|newsletter|popup|modal)"
)
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search alert dialog form menu".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 pre blockquote td th tr tbody thead tfoot li dt dd br hr figcaption".split())
ROOTS = set("html body article main".split())
LINES = set("h1 h2 h3 h4 h5 h6 p a b i em strong span code".split())
ARTICLE_WORDS = BOILERPLATE_WORDS - {"header"}
MARKED = BLOCK | BOILERPLATE

# a quote opens a value only after an equals sign
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


class _Node:
    __slots__ = ("tag", "in_article", "holds_root", "digest", "number")

    def __init__(self, tag, head, in_article, number):
        self.tag, self.in_article, self.number = tag, in_article, number
        self.holds_root, self.digest = False, xxhash.xxh64(head)


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw == "/":
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _is_role(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in BOILERPLATE or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    words = set(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()) if "class" in attrs or "id" in attrs else set()
    if tag == "article":
        return not COMMENT_WORDS.isdisjoint(words) or any(w.startswith(("comment-", "comment_", "related-", "teaser-")) for w in words)
    if tag in LINES:
        return not LINE_WORDS.isdisjoint(words)
    if attrs.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if not words:
        return False
    return not (ARTICLE_WORDS if in_article else BOILERPLATE_WORDS).isdisjoint(words) or any(COMPOUND.fullmatch(w) for w in words)


class Page:
    """A parsed page. Elements are numbered from 1 in page order, 0 is the page
    itself; ``up`` has each element's parent, so what holds for an element and all
    around it takes one pass over the numbers, however deep they are.

    blocks: (text, element, whether it is a heading); marks: {element: hash} of
    the candidate subtrees; zone: 2 in an article, 1 in main, else 0; role:
    elements with a role that counts."""

    def __init__(self):
        self.blocks: list[tuple[str, int, bool]] = []
        self.marks: dict[int, int] = {}
        self.up, self.zone, self.roles, self.roots = [0], [0], set(), []

    def within(self, some) -> list[bool]:
        """Per element: whether it or one around it is in ``some``."""
        out = [False] * len(self.up)
        for k in range(1, len(out)):
            out[k] = out[self.up[k]] or k in some
        return out

    def around(self, k: int):
        while k:
            yield k
            k = self.up[k]


def _holders(page: Page) -> set[int]:
    """The elements whose role does not count, as they hold the main article."""
    hidden = page.within(page.roles)
    shown = [(page.zone[k], len(t)) for t, k, _ in page.blocks if not hidden[k]]
    if any(zone for zone, _ in shown):  # others are comments or teasers
        return set()
    # text of each article or main that no role parts from it
    inner, base = {}, [0] * len(page.up)
    roots = set(page.roots)
    for k in range(1, len(base)):
        up = page.up[k]
        base[k] = k if k in roots else 0 if k in page.roles else base[up]
    for t, k, _ in page.blocks:
        k = base[k]
        while k:
            inner[k] = inner.get(k, 0) + len(t)
            k = base[page.up[k]]
    best = None
    for k in page.roots:
        if hidden[k] and k in inner:
            roles = {x for x in page.around(k) if x in page.roles}
            rank = (len(roles), -inner[k], k)
            if best is None or rank < best[0]:
                best = rank, roles
    if best is None or -best[0][1] <= sum(n for _, n in shown):
        return set()
    return best[1]


def parse(text: str | None) -> Page:
    page, source = Page(), text or ""
    blocks, marks, stack, words = page.blocks, page.marks, [], []
    open_tags: dict[str, int] = {}
    free, depth = set(), [0]  # open articles and mains
    at, last = 0, source.rfind(">")

    def flush():
        if words:
            t = SPACE.sub(" ", "".join(words)).strip(" ")
            words.clear()
            if t:
                blocks.append((t, stack[-1].number if stack else 0, bool(open_tags.get("h1") or open_tags.get("h2"))))

    def close():
        n = stack.pop()
        open_tags[n.tag] -= 1
        digest = n.digest.intdigest()
        if n.tag in ("article", "main"):
            depth[0] -= 1
        if stack:
            stack[-1].digest.update(digest.to_bytes(8, "little"))
            stack[-1].holds_root |= n.holds_root or n.tag in ("article", "main")
        if n.tag not in ROOTS and n.tag != "head" and not n.holds_root and n.tag in MARKED and not (n.in_article and n.tag in PROSE):
            marks[n.number] = digest
        if n.tag == "form" and n.holds_root:
            free.add(n.number)

    def add(raw: str):
        if raw:
            raw = html.unescape(raw)
            words.append(raw)
            if stack and not raw.isspace():
                stack[-1].digest.update(SPACE.sub(" ", raw).strip(" ").encode("utf-8", "surrogatepass"))

    while True:
        m = TOKEN.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None
        if m is None:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags.get(tag):
                if tag in BLOCK or stack[-1].tag in BLOCK:
                    flush()
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in MARKED:
            flush()
        if tag in ENDS_P and open_tags.get("p"):
            while stack[-1].tag != "p":
                close()
            close()
        if tag in CLOSES and any(open_tags.get(t) for t in CLOSES[tag]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in SCOPE[tag]:
                    break
                if stack[k].tag in CLOSES[tag]:
                    while len(stack) > k:
                        close()
                    break
        if tag in VOID:
            continue
        attrs = _attributes(m[3])
        number, up = len(page.up), stack[-1].number if stack else 0
        page.up.append(up)
        page.zone.append(max(page.zone[up], 2 if tag == "article" else 1 if tag == "main" else 0))
        if _is_role(tag, attrs, depth[0] > 0):
            page.roles.add(number)
        if tag in ("article", "main"):
            page.roots.append(number)
        stack.append(_Node(tag, f"<{tag} {attrs.get('class', '')}>", depth[0] > 0, number))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if tag in ("article", "main"):
            depth[0] += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            raw = source[at : end.start() if end else len(source)]
            stack[-1].digest.update(raw.encode("utf-8", "surrogatepass"))
            at = end.start() if end else len(source)
    flush()
    while stack:
        close()
    page.roles -= free
    if page.roots and page.roles:
        page.roles -= _holders(page)
    return page


def main_text(page: Page, is_template) -> tuple[str, int]:
    """The text of the main blocks, and how many blocks templates deleted."""
    gone = {k for k, h in page.marks.items() if is_template(h)}
    deleted, hidden = page.within(gone), page.within(page.roles)
    kept = [(page.zone[k], t, heading) for t, k, heading in page.blocks if not deleted[k] and not hidden[k]]
    size = [sum(len(t) for z, t, _ in kept if z == zone) for zone in (0, 1, 2)]
    zone = 2 if size[2] and size[2] >= size[1] else 1 if size[1] else 2 if size[2] else 0
    if zone == 2 and not any(z == 2 and heading for z, _, heading in kept):
        first = next((i for i, (z, _, _) in enumerate(kept) if z == 2), 0)
        chosen = [t for i, (z, t, heading) in enumerate(kept) if z == 2 or (z == 1 and heading and i < first)]
    else:
        chosen = [t for z, t, _ in kept if z == zone]
    return "\n".join(chosen), sum(deleted[k] for _, k, _ in page.blocks)


def _key(host: str, digest: int) -> int:
    """64 bits of (host, subtree), signed."""
    k = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"), digest)
    return k - (1 << 64) if k >> 63 else k


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def marked(pages: DataFrame, url: str, page: str) -> DataFrame:
    """(host, key, main): a row per candidate subtree and page; main is a hash
    of the page's main text before templates are deleted."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("_html"))

    def run(batches):
        for batch in batches:
            hosts, keys, mains = [], [], []
            for host, page in zip(batch["host"].to_pylist(), (x.as_py() for x in batch["_html"])):
                parsed = parse(page)
                text, _ = main_text(parsed, lambda h: False)
                main = xxhash.xxh64(text.encode("utf-8", "surrogatepass")).intdigest() >> 1
                found = {_key(host, h) for h in parsed.marks.values()}
                hosts += [host] * (len(found) + 1)
                keys += [*found, None]  # the null key counts the page itself
                mains += [main] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(mains, pa.int64())], names=["host", "key", "main"])

    return rows.mapInArrow(run, "host string, key long, main long")


def find_templates(pages: DataFrame, url: str = "url", page: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, enough: int = ENOUGH) -> DataFrame:
    """(host, key, n): subtrees that recur on a host."""
    seen = stored(marked(pages, url, page).distinct().groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("key").isNull() | (F.col("n") >= min_pages)), "subtrees")
    hosts = seen.where("key IS NULL").select("host", F.col("n").alias("pages"))
    return join_small(seen.where("key IS NOT NULL"), hosts, ["host"], "inner").where((F.col("n") >= enough) | (F.col("n") >= min_share * F.col("pages"))).select("host", "key", "n")


def extract(pages: DataFrame, keep: list[str], url: str = "url", page: str = "html", most_keys: int = MOST_KEYS, **limits) -> DataFrame:
    """Columns ``keep`` of every page, with text, n_chars and n_template_blocks."""
    templates = stored(find_templates(pages, url, page, **limits).select("key").distinct(), "templates")
    rows = pages.select(F.struct(*keep).alias("_keep"), host_of(F.col(url)).alias("_host"), F.col(page).alias("_html"))
    spark = pages.sparkSession
    if templates.limit(most_keys + 1).count() <= most_keys:
        common = spark.sparkContext.broadcast(np.sort(np.array([r["key"] for r in templates.collect()], dtype=np.int64)))
        rows = rows.withColumn("_own", F.lit(None).cast("array<long>"))
    else:  # each page's own template keys, by a join
        common = None
        rows = rows.withColumn("_row", F.xxhash64("_host", "_html"))

        def keys_of(batches):
            for batch in batches:
                ids, keys = [], []
                for row, host, page in zip(batch["_row"].to_pylist(), batch["_host"].to_pylist(), (x.as_py() for x in batch["_html"])):
                    found = {_key(host, h) for h in parse(page).marks.values()}
                    ids += [row] * len(found)
                    keys += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], names=["_row", "key"])

        hits = rows.select("_row", "_host", "_html").mapInArrow(keys_of, "_row long, key long").join(templates, "key")
        rows = rows.join(hits.groupBy("_row").agg(F.collect_set("key").alias("_own")), "_row", "left").drop("_row")
    fields = rows.select("_keep").schema

    def run(batches):
        known = common.value if common is not None else None
        for batch in batches:
            out, deleted = [], []
            for host, page, own in zip(batch["_host"].to_pylist(), (x.as_py() for x in batch["_html"]), batch["_own"].to_pylist()):
                keys = set(own or ()) if known is None else None

                def is_template(h):
                    k = _key(host, h)
                    if keys is not None:
                        return k in keys
                    i = int(np.searchsorted(known, k))
                    return i < len(known) and int(known[i]) == k

                text, n = main_text(parse(page), is_template)
                out.append(text)
                deleted.append(n)
            yield pa.RecordBatch.from_arrays([batch["_keep"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(deleted, pa.int64())], names=["_keep", "text", "n_chars", "n_template_blocks"])

    got = rows.select("_keep", "_host", "_html", "_own").mapInArrow(run, fields.add("text", "string").add("n_chars", "long").add("n_template_blocks", "long"))
    return got.select(*[F.col("_keep")[c].alias(c) for c in keep], "text", "n_chars", "n_template_blocks")
