"""Main text of web pages by consensus paths of their hosts (operator 5).

Each page is parsed once into blocks of text, each with the path of containers around it. Paths are generalised to tag and class
names without digits. Containers score by the text in them, less what is in links, less what menus, notices and the like hold.
The scores of a page's containers are votes; Spark adds them up per host and path, and the pages of a host are extracted again
by the paths that won there. A page without a container on a winning path falls back on its own best one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from veilframe.llm._shared import Workspace, byte_slices, lean

#: One attribute: quotes only count behind an equals sign, and only if they are closed.
ATTRIBUTE = re.compile(r"""(?P<name>[^\s/>][^\s/>=]*)(?:\s*=\s*(?P<value>"[^"]*"|'[^']*'|[^\s>]*))?""")
TAG = re.compile(r"[A-Za-z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
#: Elements whose content is never text of the page, up to their end tag.
SILENT = frozenset("script style noscript template iframe object svg math canvas video audio head title select option textarea button datalist".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Containers that hold something beside the article, by tag or role or by words of their class or id.
BESIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Words that by themselves, or with words that say nothing, name a part beside the article.
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer foot sidebar rail related recommended "
    "share sharing social comment comments disqus cookie cookies consent gdpr newsletter subscribe subscription signup pagination pager toolbar".split()
)
#: Words that do so only if what they name holds little text, is mostly links, or stands outside the article.
DOUBTFUL_WORDS = frozenset("banner header masthead side widget more reply replies respond discussion notice alert popup modal overlay login form search copyright legal disclaimer hidden".split())
NEUTRAL_WORDS = frozenset(
    "site page global main primary secondary top bottom left right inner outer wrapper wrap container box block section area list item items bar panel unit slot link links button buttons "
    "icon icons group module content post posts article articles entry story blog user reader text body title heading count author meta date thread row col column the of for and".split()
)
MAIN_WORDS = frozenset("article content main post entry story body text".split())
#: Text outside links that a doubtful part of an article holds if it belongs to it.
PROSE = 400
#: Block elements that an unclosed p does not hold.
CLOSES_P = frozenset("p div article section main ul ol li dl dt dd table h1 h2 h3 h4 h5 h6 blockquote pre header footer nav aside form hr figure address details".split())
SPACE = re.compile(r"\s+")


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w]


def _attributes(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from a place behind a tag's name, whether the tag closes itself, and the place behind the tag."""
    found: dict[str, str] = {}
    while True:
        gap = GAP.match(page, at)
        at = gap.end()
        if at >= len(page):
            return found, False, at
        if page[at] == ">":
            return found, gap[0].endswith("/"), at + 1
        m = ATTRIBUTE.match(page, at)
        value = m["value"] or ""
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        found.setdefault(m["name"].lower(), value)
        at = m.end()


def _names(value: str, listed: frozenset[str]) -> bool:
    """Whether one of the names in an attribute consists of words for parts beside the article, one of them listed, and neutral ones."""
    known = BESIDE_WORDS | DOUBTFUL_WORDS | NEUTRAL_WORDS
    return any(any(w in listed for w in ws) and known.issuperset(ws) for ws in map(_words, value.split()))


#: Elements that names of classes and ids do not remove: their text is the article's, or goes with the part around it.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 html body main article".split())


def _beside(tag: str, attrs: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """Whether an element holds something beside the article, and whether that is in doubt and depends on what it holds.

    An article's header is part of it.
    """
    if tag in BESIDE and not (tag == "header" and inside):
        return True, False
    if not attrs:
        return False, False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True, False
    if attrs.get("role", "").lower() in BESIDE_ROLES and tag not in ("main", "article"):
        return True, False
    if tag in HEADINGS:
        return False, False
    names = [x for x in (attrs.get("class", "") + (" " + attrs.get("id", "") if tag not in TEXTUAL else "")).split()]
    names = " ".join(x for x in names if not ("header" in _words(x) and (inside or not MAIN_WORDS.isdisjoint(_words(x)))))
    if _names(names, BESIDE_WORDS):
        # 'content sidebar-left' is content with a sidebar.
        main = any((ws := _words(x)) and MAIN_WORDS.issuperset(ws) for x in names.split())
        return not main, main
    return False, _names(names, DOUBTFUL_WORDS)


def blocks_of(page: str | None) -> list[tuple[str, str, int]]:
    """(path, text, characters in links) of each block in page order; parts beside the article have paths that end in '!'.

    Character references are decoded, white space is one space, empty blocks are left out. Unclosed elements end where HTML lets them,
    or with their parent; end tags without a start are passed over. Tags end where HTML ends them: quotes that no attribute opens are
    part of a name.
    """
    if not page:
        return []
    out: list[tuple[str, str, int, bool, tuple[int, ...]]] = []
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []  # tag, path, beside, doubtful elements around
    doubtful: list[bool] = []  # whether each stands inside the article
    parts: list[str] = []
    in_link, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                _, path, beside, doubts = stack[-1] if stack else ("", "", False, ())
                out.append((path, text, min(linked, len(text)), beside, doubts))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        parts.append(piece)
        if in_link:
            linked += len(piece.strip())

    def behind(mark: str, start: int) -> int:
        found = page.find(mark, start)
        return len(page) if found < 0 else found + len(mark)

    def end_of(tag: str, start: int) -> int | None:
        m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, start)
        return m.end() if m else None

    at = 0
    while at < len(page):
        here = page.find("<", at)
        if here < 0:
            add(page[at:])
            break
        if here > at:
            add(page[at:here])
        after = page[here + 1 : here + 2]
        if page.startswith("<!--", here):
            at = behind("-->", here + 4)
            continue
        if page.startswith("<![CDATA[", here):
            at = behind("]]>", here + 9)
            add(page[here + 9 : at].removesuffix("]]>").replace("&", "&amp;"))
            continue
        ending = after == "/"
        m = TAG.match(page, here + 1 + ending)
        if m is None:
            if after and after in "!?/":
                at = behind(">", here + 1)
            else:
                add("<")
                at = here + 1
            continue
        tag = m[0].lower()
        attrs, closed, at = _attributes(page, m.end())
        if ending:
            if tag == "a":
                in_link = 0
            if tag in INLINE:
                continue
            if tag == "br":
                flush()
            elif any(x[0] == tag for x in stack):
                flush()
                while stack.pop()[0] != tag:
                    pass
            elif tag == "p":
                flush()
            continue
        if tag == "a":
            in_link = 0 if closed else 1
        if tag in SILENT:
            if not closed or tag in RAW:
                end = end_of(tag, at)
                if end:
                    at = end
                elif tag in RAW:
                    at = len(page)
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            if tag not in VOID and attrs and not closed and _beside(tag, attrs, True)[0]:
                at = end_of(tag, at) or at
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P and any(x[0] == "p" for x in stack):
            while stack.pop()[0] != "p":
                pass
        for same, stops in (("li", ("ul", "ol")), ("tr", ("table",)), ("td", ("tr", "table")), ("th", ("tr", "table")), ("dd", ("dl",)), ("dt", ("dl",))):
            if tag == same:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in stops:
                        break
                    if stack[k][0] == same:
                        del stack[k:]
                        break
        if closed:
            continue
        _, above, beside, doubts = stack[-1] if stack else ("", "", False, ())
        classes = ".".join(sorted(set(_words(attrs.get("class", "")))))
        inside = any(x[0] in ("article", "main") for x in stack)
        own, in_doubt = _beside(tag, attrs, inside)
        if in_doubt:
            doubts = (*doubts, len(doubtful))
            doubtful.append(inside or not MAIN_WORDS.isdisjoint(_words(attrs.get("class", ""))))
        stack.append((tag, f"{above}/{tag}" + (f".{classes}" if classes else ""), beside or own, doubts))
    flush()
    plain, links = [0] * len(doubtful), [0] * len(doubtful)
    for _, text, n, _, doubts in out:
        for k in doubts:
            plain[k] += len(text) - n
            links[k] += n
    cut = {k for k, inside in enumerate(doubtful) if not inside or plain[k] < PROSE or links[k] > plain[k] / 3}
    return [(path + "!" if beside or not cut.isdisjoint(doubts) else path, text, n) for path, text, n, beside, doubts in out]


#: Elements of text, which are not containers of an article.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr ul ol dl table tbody thead figure figcaption address summary".split())


def containers(blocks: list[tuple[str, str, int]]) -> dict[str, float]:
    """Score of each container path: text outside links in it, more for what is close to it, for article and main more still."""
    scores: dict[str, float] = {}
    for path, text, linked in blocks:
        if path.endswith("!"):
            continue
        worth = len(text) - 2.0 * linked
        steps = path.split("/")
        while len(steps) > 1 and steps[-1].split(".")[0] in TEXTUAL:
            steps.pop()
        for depth in range(len(steps), 1, -1):
            name, *classes = steps[depth - 1].split(".")
            factor = 1.0 if depth == len(steps) else 0.7 ** (len(steps) - depth)
            if name in ("article", "main") or any(c in MAIN_WORDS for c in classes):
                factor *= 1.5
            p = "/".join(steps[:depth])
            scores[p] = scores.get(p, 0.0) + worth * factor
    return scores


def _container(path: str) -> str:
    return path.rpartition("/")[0]


def _article(path: str) -> str:
    """A path cut to its innermost article, if there is one."""
    steps = path.split("/")
    at = max((k for k, x in enumerate(steps) if x.split(".")[0] == "article"), default=None)
    return path if at is None else "/".join(steps[: at + 1])


def text_under(blocks: list[tuple[str, str, int]], paths: list[str]) -> str | None:
    """Text of the blocks under the first path that the page has, without parts beside the article; None if it has none of them.

    A path inside an article stands for the article. A headline that stands before it in a container around it belongs to it, with
    what follows it there.
    """
    for path in paths:
        p = _article(path)
        found = [k for k, (at, _, _) in enumerate(blocks) if not at.endswith("!") and (at == p or at.startswith(p + "/"))]
        if not found:
            continue
        if not any("/h1" in blocks[k][0].replace(".", "/") for k in found):
            heads = [k for k in range(found[0]) if re.search(r"/h1(?:\.[^/]*)?\Z", blocks[k][0]) and p.startswith(_container(blocks[k][0]) + "/")]
            if heads:
                around = _container(blocks[heads[-1]][0])
                found = [k for k in range(heads[-1], found[0]) if not blocks[k][0].endswith("!") and _container(blocks[k][0]) == around] + found
        return "\n".join(blocks[k][1] for k in found)
    return None


def host_column(url):
    """Host of an address, lower case, without a user, a port and a leading www.; '' if there is none."""
    text = F.trim(F.coalesce(url, F.lit("")))
    return F.regexp_replace(F.lower(F.regexp_extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1)), r"^www\.|[\[\]]", "")


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, votes, tops): scores of containers as shares of their page's best, and on how many pages they are the best."""
    for batch in batches:
        total: dict[tuple[str, str], list[float]] = {}
        for part in byte_slices(batch, 1):
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                scores = containers(blocks_of(page))
                best = _best(scores)
                if best is not None and scores[best] > 0:
                    for p, s in scores.items():
                        if s > 0:
                            v = total.setdefault((host, p), [0.0, 0])
                            v[0] += round(s / scores[best], 6)
                            v[1] += p == best
        columns = [pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array([v[0] for v in total.values()], pa.float64()), pa.array([v[1] for v in total.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "votes", "tops"])


def _best(scores: dict[str, float]) -> str | None:
    return max(sorted(scores), key=scores.__getitem__) if scores else None


def _extract(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 2):
                texts = []
                for page, paths in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    blocks = blocks_of(page)
                    text = text_under(blocks, paths or [])
                    if text is None and (best := _best(containers(blocks))) is not None:
                        text = text_under(blocks, [best])
                    if text is None:
                        text = "\n".join(t for p, t, _ in blocks if not p.endswith("!"))
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = 0.01) -> DataFrame:
    """id, url, text, n_chars for every input row.

    A host's winning paths are those that are the best of at least two pages and of a share of ``support`` of its pages, so a host has at
    most 1 / support; they are ranked by votes, and a page takes the first that it has. Pages without a winning path, so all of a host with one
    page, take their own best. Null and empty pages, and pages of markup only, have an empty text. Pages without a host vote together.
    Repeated rows each count as a page. Ties between paths go to the smaller path. Pages are read whole; other columns are not
    read. An empty table gives an empty result. The winning paths are one row per host; they meet the pages in a join that the
    pages' hosts cannot skew, since it is broadcast while it fits and split by adaptive execution otherwise.
    """
    work = Workspace(pages.sparkSession, "extract")
    votes = pages.select(host_column(F.col(url_col)).alias("host"), html_col).mapInArrow(lean(_votes), "host string, path string, votes double, tops long")
    summed = work.put(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("tops").alias("tops")).filter("tops > 0"), "votes")
    least = summed.groupBy("host").agg(F.greatest(F.lit(2.0), F.sum("tops") * support).alias("least"))
    won = summed.join(least, "host").filter("tops >= least")
    ranked = won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("votes", 3)).alias("votes"), "path"))), lambda r: r["path"]).alias("paths"))
    ranked = work.put(ranked.withColumnRenamed("host", "_host"), "paths")
    work.drop("votes")
    source = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).withColumn("_host", host_column(F.col("_url")))
    joined = source.join(ranked, "_host", "left").select("_id", "_url", "_html", "paths")
    schema = StructType([StructField(id_col, pages.schema[id_col].dataType), StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType())])
    return joined.mapInArrow(lean(_extract(to_arrow_schema(schema))), schema)
