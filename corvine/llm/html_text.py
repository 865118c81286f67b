"""Main text of web pages by tree scoring.

A page is parsed into a tree; menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are pruned by element and by the words of class, id and role. Every remaining paragraph
then passes points for its length and its commas to its ancestors (whole to the first, half to the second, a
third of the level's share beyond), each container's sum is discounted by its link density, and the best
container is kept with those siblings that score a fifth of it, read like prose or hold headings alone. Inside an
``article`` paragraphs are pruned by words of adverts and comments only, so a paragraph's own class cuts no text.

The text is the kept blocks in page order, joined by a blank line: character references decoded, white space
inside a block turned into one space, trimmed. Nothing is cut, however long the page.

Defined results: a null or empty page, or one with nothing but pruned parts, gives ''. Unclosed, wrongly nested
and truncated markup is parsed like a browser does in the common cases (a block closes an open paragraph, an
end tag closes what is open inside it). Repeated rows give repeated results, other columns are left behind.
The parser uses no recursion and is linear in the page, so deep and very long pages pass.

Runs as one ``mapInArrow`` without a shuffle: memory is one Arrow batch of pages and one page's tree; the other columns
pass through Arrow untouched, so null keys and large integers stay what they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html head body caption td th tr tbody thead tfoot option select".split())
#: An element ends open ones of these kinds, up to the nearest of the scope.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
SCOPE = frozenset("article aside body button caption dialog div fieldset footer form header html main nav section table td th".split())
PARAGRAPH = frozenset("p pre blockquote li dd dt td th figcaption caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
OWN = HEADING | frozenset("p pre blockquote li dd dt td th figcaption caption em strong b i a span mark".split())

PRUNED = frozenset("nav footer aside form button select menu dialog head object canvas audio video datalist dir".split())
#: Words of class, id and role that mark what isn't the article: always; but for the article's own paragraphs; unless a content word stands beside them.
ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adbox adslot sponsor sponsored sponsors promo promos promotion banner banners comment comments commentlist disqus replies".split()
)
NEVER = ALWAYS | frozenset(
    "sidebar sidebars cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription paywall share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager navbar navigation sitemap skip login signup signin register widget widgets complementary contentinfo".split()
)
UNLESS_CONTENT = frozenset("header masthead footer nav menu menus toolbar tools search top bottom aside meta tags hidden".split())
CONTENT = frozenset("article post entry content main story text body page".split())
KEPT_WHOLE = frozenset("html body article main".split())


def _unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in PRUNED or (tag == "header" and not in_article):
        return True
    if not attrs or tag in KEPT_WHOLE and tag != "article":
        return False
    words: set[str] = set()
    for name, value in ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.strip("\"'").lower() == "true":
            return True
        words.update(WORD.findall(value.lower()))
    if in_article and tag in OWN:
        return bool(words & ALWAYS)
    return bool(words & NEVER) or bool(words & UNLESS_CONTENT) and not words & CONTENT


def blocks_of(page: str) -> tuple[list[tuple[int, str, int]], list[int], list[str], list[int]]:
    """The text blocks (node, text, characters in links) outside pruned parts; parents, tags and pruning of the nodes."""
    parents, tags, pruned = [-1], ["#root"], [0]
    stack = [0]
    blocks: list[tuple[int, str, int]] = []
    pieces: list[str] = []
    linked, links, articles = 0, 0, 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node = stack[-1]
                while tags[node] not in BLOCK and parents[node] >= 0:
                    node = parents[node]
                blocks.append((node, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(down_to: int) -> None:
        nonlocal links, articles
        while len(stack) > down_to:
            tag = tags[stack[-1]]
            if tag in BLOCK:
                flush()
            links -= tag == "a"
            articles -= tag == "article"
            stack.pop()

    def say(text: str) -> None:
        nonlocal linked
        if not pruned[stack[-1]]:
            pieces.append(html.unescape(text) if "&" in text else text)
            if links:
                linked += len(" ".join(text.split()))

    while at < size:
        found = page.find("<", at)
        if found < 0:
            say(page[at:])
            break
        if found > at:
            say(page[at:found])
        token = TOKEN.match(page, found)
        if token is None:
            say("<")
            at = found + 1
            continue
        at = token.end()
        name = token["name"] or token["name2"]
        if name is None:
            continue
        name = name.lower()
        if token["end"] or token["end2"]:
            if name == "br":
                say(" ")
            elif name not in VOID:
                depth = len(stack) - 1
                while depth > 0 and tags[stack[depth]] != name:
                    # an inline end tag does not reach over a block
                    if name not in BLOCK and tags[stack[depth]] in SCOPE:
                        depth = 0
                        break
                    depth -= 1
                if depth > 0:
                    close(depth)
                elif name in BLOCK:
                    flush()
            continue
        attrs = token["attrs"] or token["attrs2"] or ""
        if name in RAW:
            # only foreign elements can close themselves; in an unquoted value the slash is the value's
            if name != "svg" or not attrs.endswith("/") or re.search(r"=[^\s\"']*/$", attrs):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else size
            continue
        if name in VOID:
            if name in BLOCK:
                flush()
            else:
                say(" " if name in ("br", "wbr", "img") and name != "wbr" else "")
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                tag = tags[stack[depth]]
                if tag == "p":
                    close(depth)
                    break
                if tag in SCOPE or tag in ("li", "dd", "dt"):
                    break
            if name in HEADING and tags[stack[-1]] in HEADING:
                close(len(stack) - 1)
        if name in ENDS:
            kinds, scope = ENDS[name]
            for depth in range(len(stack) - 1, 0, -1):
                tag = tags[stack[depth]]
                if tag in scope:
                    break
                if tag in kinds:
                    close(depth)
                    if name != "tr":
                        break
        if name in BLOCK:
            flush()
        parents.append(stack[-1])
        tags.append(name)
        pruned.append(1 if pruned[stack[-1]] or _unwanted(name, attrs, articles > 0) else 0)
        stack.append(len(tags) - 1)
        links += name == "a"
        articles += name == "article"
    close(1)
    flush()
    return blocks, parents, tags, pruned


def main_text(page: str | None) -> str:
    """The page's article as blocks joined by a blank line; '' if there is none."""
    if not page:
        return ""
    blocks, parents, tags, _ = blocks_of(page)
    if not blocks:
        return ""
    n = len(tags)
    score, chars, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, in_links in blocks:
        chars[node] += len(text)
        linked[node] += in_links
        if tags[node] in HEADING:
            points = 0.1
        else:
            commas = text.count(",") + text.count("，") + text.count("、")
            points = min(1.0, len(text) / 25) + commas + min(len(text) / 100, 3.0)
        points *= 1 - in_links / len(text)
        up = parents[node] if tags[node] in PARAGRAPH or tags[node] in HEADING else node
        level = 1
        while up >= 0 and level <= 6:
            score[up] += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            up, level = parents[up], level + 1
    for node in range(n - 1, 0, -1):  # children come after their parents
        chars[parents[node]] += chars[node]
        linked[parents[node]] += linked[node]
    # containers of headings alone, such as an article's header
    titled = {parents[node] for node, _, _ in blocks if tags[node] in HEADING} - {parents[node] if tags[node] in PARAGRAPH else node for node, _, _ in blocks if tags[node] not in HEADING}
    final = [s * (1 - linked[i] / chars[i]) if chars[i] else 0.0 for i, s in enumerate(score)]
    best = max(range(n), key=lambda i: (final[i], i))
    if final[best] <= 0:
        return ""
    kept = {best}
    if tags[best] not in ("#root", "html", "body"):
        least = 0.2 * final[best]
        for node in range(1, n):
            if parents[node] == parents[best] and chars[node]:
                density = linked[node] / chars[node]
                if final[node] >= least or tags[node] in PARAGRAPH | HEADING and density < 0.25 and chars[node] > (0 if tags[node] in HEADING else 80) or node in titled and density < 0.25:
                    kept.add(node)
    inside = [False] * n
    for node in range(n):
        inside[node] = node in kept or parents[node] >= 0 and inside[parents[node]]
    return "\n\n".join(text for node, text, _ in blocks if inside[node])


def extract_text(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` with text (never null) and n_chars, its code points."""
    rows = df.select(*keep, F.col(page).alias("__page"))

    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(len(names))]
            found = [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*names, "text", "n_chars"])

    kept = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, text string, n_chars long")
