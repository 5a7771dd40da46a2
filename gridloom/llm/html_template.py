"""Main text of web pages by template deduction over equivalence classes (operator 4).

Every page becomes a sequence of tokens: for each block of text, the slot it stands in (the path of tags and first
classes) and the slot with the text. Over the pages of a host a token's occurrence vector says how often each
page has it; tokens with equal vectors form an equivalence class. Vectors are compared by their sum, their support
and two sums over hashed page ids, which are plain aggregates, so a host with a third of all pages is
never gathered. A class is valid if ``support`` of the host's pages with text have its tokens, however often, given ``min_pages`` such pages
with different text, if its tokens are ordered and if it is nested. Ordered: two tokens stand in one order on ``support`` of the pages that have both. Tokens with
most conflicts leave their class first, of equal ones those on fewer pages, until none is left. Nested, from the classes on most
pages on: a class lies in one slot between the tokens of each valid class before it, or that one in a slot of its own. Lines that wander
over the page are text, however many pages have them. The text tokens of valid classes are template text (notices, slogans, adverts) and are dropped.

What is left of a page is in its slots. A page with ``article`` or ``main`` elements yields these. For pages of a host without either, slots
are classed by what the host's pages of that layout have in them once template text is gone: a slot is kept if most of its text isn't links and if
it holds at least a tenth of what the largest one holds, with the slots inside and around it. On the tables here all pages have an
article, so that template text, and not the choice of slots, is what classes decide.

Slots that HTML itself names as something else (navigation, header, footer, aside, form, script, style, and
classes or ids such as ``ad``, ``sidebar``, ``notice``, ``comments``) are never main text.

The template of a host is a few tokens; the table is broadcast only if it has at most ``broadcast_rows``
rows, and joined by shuffle otherwise.

Defined results: null and empty pages give an empty text; a null or odd url is a host of its own name; pages
repeated word for word count as one for ``min_pages``; very long pages are read whole; an empty table gives an empty result; unclosed and stray tags are allowed; other columns
are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"[^<]+|<(?:(/?)([a-zA-Z][^\s/>]*)([^<>\"']*|(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|!--.*?(?:-->|\Z)|[!?][^>]*>|)",
    re.S,
)
#: Elements whose content is no markup.
RAW = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in "script style noscript template textarea title svg iframe xmp".split()}
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
NOT_TEXT = frozenset("head nav footer aside form button select label menu dialog fieldset object canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class or id that name a slot other than the main text.
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments disqus respond replies notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended widget widgets pagination pager copyright legal toolbar skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
UNLESS_FIRST = frozenset("with has no is without show hide js".split())
KEEP_TAGS = frozenset(("html", "body", "main"))
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
BARRIER = frozenset("article aside body div main nav ol section table td th ul footer header form blockquote dl".split())
P_CLOSERS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


ENDS = {t: CLOSES.get(t, frozenset()) | (frozenset(("p",)) if t in P_CLOSERS else frozenset()) for t in {*CLOSES, *P_CLOSERS}}


def _named(tag: str, attrs: str) -> tuple[bool, str]:
    """Whether a tag's attributes name a slot that isn't main text; its first class."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False, ""
    first, other = "", False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "class" and not first:
            first = value.split()[0] if value.split() else ""
        if tag in KEEP_TAGS:
            continue
        if key == "hidden" and (not m[2] or value in ("", "hidden", "true")) or key == "style" and HIDDEN.search(value) or key == "role" and value in ROLES:
            other = True
        elif key in ("class", "id"):
            for name in value.split():
                words = [w for w in re.split(r"[-_]+", name) if w]
                if words and words[0] not in UNLESS_FIRST and (words[0] in NAMES or words[-1] in NAMES):
                    other = True
    return other, first


def blocks(page: str | None) -> list[tuple[str, int, str, int]]:
    """The blocks of text outside of named slots: role, 2 in an article or 1 in main, text, and how much of it is links."""
    page = page or ""
    out: list = []
    # tag, role, dropped, 2 in an article and 1 in main, in an article's header outside headings, inside a link
    stack: list[tuple[str, str, bool, int, bool, bool]] = []
    top = ("", "", False, 0, False, False)
    buf: list[str] = []
    links = at = 0

    def flush():
        nonlocal links
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                role = next((s[1] for s in reversed(stack) if s[0] in BLOCK), "")
                out.append((role, stack[-1][3] if stack else 0, text, min(links, len(text))))
            buf.clear()
        links = 0

    def close(n: int):
        if any(s[0] in BLOCK for s in stack[n:]):
            flush()
        del stack[n:]

    match = TOKEN.match
    while m := match(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[:1] == "<" and len(text) > 1:
                continue  # comments and declarations
            up = stack[-1] if stack else top
            if up[2] or up[4]:
                continue
            buf.append(html_lib.unescape(text) if "&" in text else text)
            if up[5]:
                links += len(text)
            continue
        tag = tag.lower()
        if m[1]:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == tag:
                    close(n)
                    break
                if tag not in BARRIER and stack[n][0] in BARRIER:
                    break
            if tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        ends = ENDS.get(tag)
        if ends:
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] in ends:
                    close(n)
                    break
                if stack[n][0] in BARRIER:
                    break
        if tag in BLOCK:
            flush()
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        up = stack[-1] if stack else top
        other, first = _named(tag, m[3]) if m[3] else (False, "")
        inside = 2 if tag == "article" else max(up[3], 1) if tag == "main" else up[3]
        dropped = up[2] or other or tag in NOT_TEXT or tag == "header" and not up[3]
        quiet = tag not in HEADINGS and (up[4] or tag == "header" and up[3] > 0)
        stack.append((tag, f"{up[1]}/{tag}.{first}" if first else f"{up[1]}/{tag}", dropped, inside, quiet, up[5] or tag == "a"))
    flush()
    return out


def _hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _container(role: str) -> str:
    """The slot of a block: its role without the tags that hold text itself."""
    parts = role.split("/")
    while len(parts) > 1 and parts[-1].split(".")[0] in HEADINGS | {"p", "li", "ul", "ol", "blockquote", "pre", "td", "tr", "tbody", "table", "br", "dd", "dt", "dl"}:
        parts.pop()
    return "/".join(parts)


_STATS = "host string, kind int, token long, n long, h1 long, h2 long, chars long, links long, role string, pages long"


def _tokens(batches):
    """Per page with text: (0) the whole of it as a token; (1) its text blocks; (2) if it has no article, its slots with their amount of text."""
    for b in batches:
        out: list[list] = [[] for _ in range(10)]
        for host, page_id, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = blocks(page)
            if not found:
                continue
            h = _hash(page_id)
            h1, h2 = (h & 0x7FFFFFFF) + 1, ((h >> 32) & 0x7FFFFFFF) + 1
            bare = not any(x[1] for x in found)
            rows: dict = {(0, _hash(*(x[2] for x in found)), None): [1, 0, 0]}
            for role, _, text, links in found:
                for key in ((1, _hash(role, text), _container(role)), *(((2, _hash(_container(role)), _container(role)),) if bare else ())):
                    row = rows.setdefault(key, [0, 0, 0])
                    row[0] += 1
                    row[1] += len(text)
                    row[2] += links
            for (kind, token, slot), (n, chars, links) in rows.items():
                for col, v in zip(out, (host, kind, token, n, n * h1, n * h2, chars, links, slot, 1), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), *[pa.int64()] * 6, pa.string(), pa.int64()), strict=True)], [c.split()[0] for c in _STATS.split(", ")])


def host_of(url):
    """The host of a url column, in lower case; the whole of it where it has none."""
    return F.lower(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*).*$", "$1"))


def classes(seen: DataFrame, min_pages: int, support: float) -> DataFrame:
    """The equivalence classes of text tokens with enough support: host, vector and ``tokens``."""
    body = seen.where("kind = 0").groupBy("host").agg(F.sum("n").alias("all"), F.count("*").alias("texts_seen")).where(F.col("texts_seen") >= min_pages)
    vectors = seen.where("kind = 1").join(body, "host").where(F.col("pages") >= F.col("all") * support)
    return vectors.groupBy("host", "n", "pages", "h1", "h2").agg(F.collect_set("token").alias("tokens"))


def pattern(x: list[int], y: list[int]) -> int:
    """How places ``x`` and ``y`` alternate: 1 if x comes first, once or in turns, other numbers for other patterns and 0 for long ones; negative for (y, x)."""
    line = [w for _, w in sorted([(i, True) for i in x] + [(i, False) for i in y])]
    first = line[0]
    if line == [first] * line.count(first) + [not first] * line.count(not first) or len(x) == len(y) and line == [first, not first] * len(x):
        code = 1
    else:
        code = int("".join("1" if w is first else "0" for w in line), 2) if len(line) <= 32 else 0
    return code if first else -code


def _orders(batches):
    """From (host, html, tokens): on how many pages two tokens have a pattern, (host, x, y, code, pages) with x < y."""
    for b in batches:
        lines: Counter = Counter()
        for host, page, texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            known = frozenset(texts)
            lines[host, tuple(t for role, _, text, _ in blocks(page) if (t := _hash(role, text)) in known)] += 1
        found: Counter = Counter()
        for (host, line), pages in lines.items():
            places: dict = {}
            for i, t in enumerate(line):
                places.setdefault(t, []).append(i)
            for x, y in combinations(sorted(places), 2):
                found[host, x, y, pattern(places[x], places[y])] += pages
        cols = zip(*((*k, v) for k, v in found.items()), strict=True) if found else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 4), strict=True)], ["host", "x", "y", "code", "pages"])


def valid_tokens(groups: list, pairs: list | None, support: float) -> list[int]:
    """The tokens of the valid ones of a host's classes ``(pages, tokens)``, by the patterns ``(x, y, code, pages)`` of their tokens."""
    on = {t: n for n, tokens in groups for t in tokens}
    seen: dict = {}
    for x, y, code, n in sorted(pairs or ()):
        seen.setdefault((x, y), []).append((n, code))
    code, against = {}, {t: set() for t in on}
    for (x, y), found in seen.items():
        n, main = max(found)
        code[x, y], code[y, x] = main, -main
        if not main or n < support * sum(k for k, _ in found):
            against[x].add(y)
            against[y].add(x)
    while worst := max(map(len, against.values()), default=0):
        gone = [t for t, c in against.items() if len(c) == worst]
        low = min(on[t] for t in gone)
        gone = {t for t in gone if on[t] == low}
        against = {t: c - gone for t, c in against.items() if t not in gone}

    def inside(b, a):
        return len({tuple(code.get((x, y), 0) for y in a) for x in b}) == 1

    valid: list = []
    for _, tokens in sorted((-n, sorted(t for t in tokens if t in against)) for n, tokens in groups):
        if tokens and all(inside(tokens, a) or inside(a, tokens) for a in valid):
            valid.append(tokens)
    return sorted(t for tokens in valid for t in tokens)


def templates(pages: DataFrame, min_pages: int = 5, support: float = 0.9, broadcast_rows: int = 50_000) -> DataFrame:
    """Per host: ``texts``, the template's text tokens, and ``slots``, the main slots of pages without an article."""
    from gridloom.llm._common import materialize

    seen = pages.mapInArrow(_tokens, _STATS).groupBy("host", "kind", "token").agg(*(F.sum(c).alias(c) for c in ("n", "h1", "h2", "chars", "links", "pages")), F.first("role").alias("role"))
    seen = materialize(seen.where((F.col("kind") != 1) | (F.col("pages") >= min_pages * support)))
    groups = classes(seen, min_pages, support).groupBy("host").agg(F.collect_list(F.struct("pages", "tokens")).alias("groups"))
    groups = materialize(groups.withColumn("tokens", F.array_distinct(F.flatten("groups.tokens"))))
    size = groups.agg(F.sum(F.size("tokens"))).first()[0] or 0
    tokens = groups.select("host", "tokens")
    rows = pages.join(F.broadcast(tokens) if size <= broadcast_rows else tokens, "host").select("host", "html", "tokens")
    pairs = rows.mapInArrow(_orders, "host string, x long, y long, code long, pages long").groupBy("host", "x", "y", "code").agg(F.sum("pages").alias("pages"))
    pairs = pairs.groupBy("host").agg(F.collect_list(F.struct("x", "y", "code", "pages")).alias("pairs"))
    valid = F.udf(lambda g, p: valid_tokens(g, p, support), "array<long>")
    texts = materialize(groups.join(pairs, "host", "left").select("host", valid("groups", "pairs").alias("texts")).where(F.size("texts") > 0))
    known = texts.select("host", F.explode("texts").alias("token"))
    fixed = seen.where("kind = 1").join(known, ["host", "token"]).groupBy("host", "role").agg(F.sum("chars").alias("fixed"))
    slot = seen.where("kind = 2").join(fixed, ["host", "role"], "left").where("links * 2 < chars")
    slot = slot.select("host", "role", (F.col("chars") - F.coalesce("fixed", F.lit(0)) - 2 * F.col("links")).alias("plain"))
    most = slot.groupBy("host").agg(F.max("plain").alias("most"))
    slots = slot.join(most, "host").where("most > 0 and plain * 10 >= most").groupBy("host").agg(F.sort_array(F.collect_set("role")).alias("slots"))
    return slots.join(texts, "host", "full")


def _extract(batches):
    for b in batches:
        out: list[list] = [[], [], []]
        for page_id, url, page, texts, slots in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = blocks(page)
            level = max((x[1] for x in found), default=0)
            if level:
                found = [x for x in found if x[1] == level]
            elif slots:  # the slots, what they hold, and what holds them but for links
                inside = tuple(f"{s}/" for s in slots)
                near = []
                for x in found:
                    at = f"{_container(x[0])}/"
                    if at.startswith(inside) or 2 * x[3] < len(x[2]) and any(s.startswith(at) for s in inside):
                        near.append(x)
                found = near or found
            if texts:
                template = frozenset(texts)
                found = [x for x in found if _hash(x[0], x[2]) not in template]
            for col, v in zip(out, (page_id, url, " ".join(x[2] for x in found)), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5, broadcast_rows: int = 50_000, support: float = 0.9) -> DataFrame:
    """One row per page: ``page_id``, ``url`` and the main ``text``."""
    from gridloom.llm._common import materialize

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    page_key = F.concat_ws("|", F.col("page_id").cast("string"), F.coalesce("url", F.lit("")))
    found = materialize(templates(rows.select("host", page_key.alias("key"), "html"), min_pages, support, broadcast_rows))
    size = found.agg(F.sum(1 + F.greatest(F.size("texts"), F.lit(0)) + F.greatest(F.size("slots"), F.lit(0)))).first()[0] or 0
    joined = rows.join(F.broadcast(found) if size <= broadcast_rows else found, "host", "left")
    return joined.select("page_id", "url", "html", "texts", "slots").mapInArrow(_extract, "page_id long, url string, text string")


def op4(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for ``pages``."""
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
