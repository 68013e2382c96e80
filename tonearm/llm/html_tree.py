"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree.  Its nodes are paths of tags with their class, id and role, numbers of
more digits than one in names taken for the same; each node keeps which presentations (sequences of child nodes) and which contents (texts) it showed on how many
pages, and how much text it held, in links and outside them.  Two things are read off the tree.

Importance of nodes: importance of presentation is the entropy of the presentations over the node's m pages, base m; importance of
content is one minus the entropy with which a text spreads over the pages, so what every page repeats counts nothing; a node
takes the mean of both where it holds text and children.  What m pages show is weighed against a prior importance that counts as
PRIOR_PAGES pages, so a host of one page is judged by the prior alone.  The text that stands directly in a node is removed
from each page if the node's importance is low.  A node's children are judged for themselves, so a branch goes as a whole
only if everything in it is unimportant.  Outside article and main branches a node weighs by its share of text that is not in links,
inside them MAIN_WEIGHT.

The trunk: the deepest element with children that holds TRUNK of the host's text outside links; it does not go into article and
main elements.  A branch that leaves the way to the trunk is minor, and is removed as a whole, if it holds less than MINOR of
the trunk's text outside links; so menus, adverts and footers fall although their words differ on every page, and prose beside an
article stays.  Headings beside the trunk stay too.  Where a page shows no text of the trunk, or has an article or main element
that is not the trunk's, its article and main branches count instead, if it has any.

Names are a prior beside the tree: elements whose tag, role or name says boilerplate are not read.  A name says what its last word
says, words of place and shape aside (story-banner is a banner, banner-story a story); in article and main branches paragraphs,
headings and the like are only taken for adverts by name, not for anything else.  names=False does without tags and names.

Pages of a host with the same text and paths where the priors look for main text count once.

Defined results: null html is empty; a page without text gives the empty string; broken markup is closed like a browser
would; a null or odd url is a host of its own; repeated rows each get their result; extra columns are ignored.  Elements more than
BRANCH_DEPTH deep count to the branch above them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.llm import _common as c

#: Importance before any page was seen, and the pages it counts for.
PRIOR, PRIOR_PAGES = 0.5, 4
LEAST_IMPORTANCE = 0.2
#: Weight of importance in article and main branches.
MAIN_WEIGHT = 2.0
#: Least share of a host's text that the trunk holds, and of the trunk's text that a branch beside it must hold to stay.
TRUNK, MINOR = 0.6, 0.2
#: Levels of elements whose amount of text is told apart.
BRANCH_DEPTH = 64

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|math|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|<[!?/][^>]*+>?",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.I)

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
DROPPED = frozenset("head title nav footer aside form menu button select option dialog object canvas audio video input search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
LABELS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside widget widgets "
    "ad ads adv advert adverts advertisement adbox adslot banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing sharebar comment comments "
    "commentlist disqus respond reply replies discussion related recommend recommended recommendations teaser pagination pager pagenav toolbar "
    "skip skiplink legal copyright disclaimer form search searchbox hidden".split()
)
HEADERS = frozenset(("header", "masthead", "topbar"))
ADVERTS = frozenset("ad ads adv advert adverts advertisement adbox adslot promo promotion sponsor sponsored hidden".split())
#: Words of place and shape, which do not say what an element is.
PLACES = frozenset("site main page post global top bottom left right box wrap wrapper container bar list block area section inner outer slot unit text message link links item items content body".split())
MAIN = re.compile(r"(article|main)\b")
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd td th figcaption caption".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text else {}


def _name(tag: str, a: dict[str, str]) -> str:
    if not a:
        return tag
    name = tag + "".join(f".{x}" for x in sorted(a.get("class", "").lower().split())) + (f"#{a['id'].lower()}" if a.get("id") else "")
    return tag + re.sub(r"\d\d+", "0", name[len(tag) :]).replace("/", "|")


def _hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", ""), re.I))


def _says(name: str) -> str:
    """The last word of a class or id that is not about place or shape."""
    words = [re.sub(r"\d+$", "", x) for x in re.split(r"[^a-z0-9]+", name.lower())]
    return next((w for w in reversed(words) if w and w not in PLACES), "")


def _boilerplate(tag: str, a: dict[str, str], inside: bool) -> bool:
    """Whether the element names a kind of boilerplate; inside: it stands in the main branch, where headers hold titles."""
    if tag in DROPPED or (tag == "header" and not inside) or a.get("role", "").lower() in ROLES:
        return True
    if not a or tag in ("html", "body", "main"):
        return False
    found = {_says(x) for x in f"{a.get('class', '')} {a.get('id', '')}".split()} & LABELS
    if inside:
        return bool(found & ADVERTS if tag in PROSE else found - HEADERS)
    return bool(found)


def blocks(html: str, names: bool = True) -> list[tuple[str, bool, bool, str]]:
    """(path, boilerplate by its names, in an article or main branch, text) of each block with text, in page order."""
    return [b[:4] for b in _blocks(html, names)]


def _blocks(html: str, names: bool) -> list[tuple[str, bool, bool, str, int]]:
    """The same, and about how many characters of the text stand in links."""
    out: list[tuple[str, bool, bool, str, int]] = []
    stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]  # tag, path, boilerplate, main, link
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                _, path, bad, main, _ = stack[-1]
                out.append((path, bad, main, words, min(linked, len(words))))
        linked = 0

    def close(to: int) -> None:
        if any(e[0] not in INLINE for e in stack[to:]):
            flush()
        del stack[to:]

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            text.append(html[at : m.start()])
            if stack[-1][4]:
                linked += len(text[-1].strip())
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("article", "main", "body") and tag not in ("html", "body", "main", "article"):
                    break
            continue
        if tag == "br" or (tag not in INLINE):
            flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        elif tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SCOPES[tag]:
                    break
                if stack[i][0] in SIBLINGS[tag]:
                    close(i)
                    break
        a = _attributes(m["attrs"] or m["attrs2"] or "")
        _, path, bad, main, link = stack[-1]
        if tag == "body":  # also ends a head that was left open
            path, bad, main = "", False, False
        bad = bad or (bool(a) and _hidden(a)) or (names and _boilerplate(tag, a, main))
        main = main or (names and (tag in ("article", "main") or a.get("role", "").lower() == "main") and not bad)
        if tag not in INLINE:
            path = f"{path}/{_name(tag, a)}"
        elif bad and not stack[-1][2]:
            flush()
        stack.append((tag, path, bad, main, link or tag == "a"))
    if at < len(html):
        text.append(html[at:])
    flush()
    return out


def _candidates(found: list[tuple]) -> list[tuple]:
    """The blocks that the priors alone leave."""
    found = [b for b in found if not b[1]]
    return [b for b in found if b[2]] if any(b[2] for b in found) else found


def _branch(path: str, trunk: list[str]) -> str:
    """The element with which a path leaves the way to the trunk."""
    parts = path.split("/", len(trunk))
    same = next((i for i, (x, y) in enumerate(zip(parts, trunk, strict=False)) if x != y), len(trunk))
    return "/".join(parts[: same + 1])


def main_text(html: str, low: frozenset[str] = frozenset(), minor: frozenset[str] = frozenset(), trunk: str | None = None, names: bool = True) -> str:
    """Blocks joined by line feeds; low: paths of nodes that the site's tree holds unimportant, minor: its branches beside the trunk."""
    found = [b for b in blocks(html, names) if not b[1]]
    of_trunk = [b[2] for b in found if b[0] == trunk or b[0].startswith(f"{trunk}/")] if trunk is not None else []
    if of_trunk and (all(of_trunk) or not any(b[2] for b in found)):
        way = trunk.split("/")
        found = [b for b in found if _branch(b[0], way) not in minor]
    else:
        found = _candidates(found)
    return "\n".join(b[3] for b in found if b[0] not in low)


def nodes(html: str, names: bool = True) -> tuple[int, list[tuple[str, int, bool, int, int, int]]]:
    """A hash of what the priors leave of the page, and (path, kind, flag, hash, characters, characters in links) of its nodes.

    Kind 1 is the text directly in a node, kind 0 the sequence of child nodes of a node that also has text; the flag tells
    main branches.  Kind 2 is an element with all its text; the flag tells elements with children that are in no article or main element.
    """
    found = _blocks(html, names)
    page = _hash("\n".join(f"{b[0]}\t{b[3]}" for b in _candidates(found)))
    contents: dict[str, list[str]] = {}
    inside: dict[str, bool] = {}
    amount: dict[str, list[int]] = {}
    for path, bad, main, text, links in found:
        if not bad:
            contents.setdefault(path, []).append(text)
        inside[path] = inside.get(path, False) or main
        held = amount.setdefault(path, [0, 0])
        held[0] += len(text)
        held[1] += links
    branches: dict[str, list] = {}
    for path, (chars, links) in amount.items():
        up, parts, below = "", path.split("/", BRANCH_DEPTH)[1:BRANCH_DEPTH], False
        for part in [*parts, None]:
            branch = branches.setdefault(up, [False, 0, 0])
            branch[0] = branch[0] or (part is not None and not below)
            branch[1] += chars
            branch[2] += links
            if part is not None:
                below = below or (inside[path] and MAIN.match(up, up.rfind("/") + 1) is not None)
                up = f"{up}/{part}"
    children: dict[str, list[str]] = {}
    for path, bad, _, _, _ in found:
        while path and not bad:
            up, _, last = path.rpartition("/")
            if up in contents:
                seen = children.setdefault(up, [])
                if not seen or seen[-1] != last:
                    seen.append(last)
            path = up
    rows = [(p, 1, inside[p], _hash("\n".join(x)), *amount[p]) for p, x in contents.items()]
    rows += [(p, 0, inside[p], _hash("/".join(x)), 0, 0) for p, x in children.items()]
    return page, rows + [(p, 2, flag, 0, chars, links) for p, (flag, chars, links) in branches.items()]


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def merged(pages: DataFrame, url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """(host, path, kind, hash, k, flag, chars, links): the trees of all hosts, by what k pages show; see nodes()."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    schema = "host string, page bigint, path string, kind int, flag boolean, hash bigint, chars bigint, links bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page, found = nodes(html or "", names)
                out += [(host, page, *node) for node in found]
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["host", "page", "path", "kind", "flag", "hash", "chars", "links"])

    flag = F.max("flag").alias("flag")
    once = c.in_small_batches(rows, run, schema).groupBy("host", "page", "path", "kind").agg(flag, F.min("hash").alias("hash"), F.max("chars").alias("chars"), F.max("links").alias("links"))
    return once.groupBy("host", "path", "kind", "hash").agg(F.count("*").alias("k"), flag, F.sum("chars").alias("chars"), F.sum("links").alias("links"))


def importances(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, m, main, importance, weighed) of the nodes with text that more than one page of a host shows."""
    return weighed(merged(pages, url_col, html_col))


def weighed(tree: DataFrame) -> DataFrame:
    """importances() of a merged tree."""
    node = tree.where("kind < 2").groupBy("host", "path", "kind").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log(F.col("k"))).alias("klogk"), F.max("flag").alias("main"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    of = lambda kind, col: F.max(F.when(F.col("kind") == kind, F.col(col)))
    node = node.groupBy("host", "path").agg(of(1, "m").alias("m"), of(1, "klogk").alias("texts"), of(0, "m").alias("with_children"), of(0, "klogk").alias("sequences"), F.max("main").alias("main"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    node = node.where("m > 1")
    # entropy of the texts or presentations over the node's m pages, to base m: 1 if all differ, 0 if all are the same.  For
    # contents this equals the mean over pages of 1 - log(pages with this text) / log(m).  Pages without children share a presentation
    spread = lambda klogk: 1 - klogk / (F.col("m") * F.log(F.col("m")))
    without = F.col("m") - F.col("with_children")
    presentation = spread(F.col("sequences") + F.when(without > 0, without * F.log(without)).otherwise(0.0))
    content = spread(F.col("texts"))
    both = F.coalesce((content + presentation) / 2, content)
    held = ((F.col("m") - 1) * both + PRIOR_PAGES * PRIOR) / (F.col("m") - 1 + PRIOR_PAGES)
    total = held * F.when(F.col("main"), MAIN_WEIGHT).otherwise(1 - F.col("links") / F.col("chars"))
    return node.select("host", "path", "m", "main", both.alias("importance"), total.alias("weighed"))


def trunks(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, trunk, prose) and (host, path) of the minor branches, from elements that more than one page of the host shows."""
    each = tree.where("kind = 2 and k > 1").select("host", "path", "flag", (F.col("chars") - F.col("links")).alias("prose"))
    # elements that hold more than half of the text lie on one way down, so the longest path is the deepest
    whole = each.where("path = ''").select("host", F.col("prose").alias("whole"))
    trunk = each.where("flag").join(whole, "host").where(F.col("prose") >= TRUNK * F.col("whole")).groupBy("host").agg(F.max_by(F.struct(F.col("path").alias("trunk"), "prose"), F.length("path")).alias("t")).select("host", "t.*")
    up = F.regexp_replace("path", "/[^/]*$", "")
    beside = F.startswith(F.concat("trunk", F.lit("/")), F.concat(up, F.lit("/"))) & (F.col("path") != "") & (F.col("trunk") != up) & ~F.startswith(F.concat("trunk", F.lit("/")), F.concat("path", F.lit("/")))
    heading = F.col("path").rlike(r"/h[1-6]([.#][^/]*)?$")
    minor = each.join(trunk.withColumnRenamed("prose", "held"), "host").where(beside & ~heading & (F.col("prose") < MINOR * F.col("held"))).select("host", "path")
    return trunk, minor


def site_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """(host, low, minor, trunk): paths of the unimportant nodes and of the minor branches, and the trunk, of each host that has any."""
    tree = c.materialise(merged(pages, url_col, html_col, names))
    trunk, minor = trunks(tree)
    paths = lambda rows, name: rows.groupBy("host").agg(F.collect_set("path").alias(name))
    low = paths(weighed(tree).where(F.col("weighed") < LEAST_IMPORTANCE), "low")
    return low.join(paths(minor, "minor"), "host", "full").join(trunk.select("host", "trunk"), "host", "full")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """id, url, text and n_chars of each page."""
    tree = c.materialise(site_tree(pages, url_col, html_col, names))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(tree, "host", "left").select("id", "url", "html", "low", "minor", "trunk")
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)
            texts = [main_text(h or "", frozenset(low or ()), frozenset(minor or ()), trunk, names) for h, low, minor, trunk in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return c.in_small_batches(joined, run, schema).withColumnsRenamed({"id": id_col, "url": url_col})
