"""Main text of web pages by consensus of each host's pages.

Pass one reads every page into containers (sections, lists, tables, and blocks with a class) and scores what stands
directly in each by its characters outside links less those inside. Each page votes with these scores for the containers'
generalised paths, tag and class from the body down with digits dropped, and says by a hash what it has there. Spark sums
the votes by host and path. A path is no article's where most of a host's different pages, three at least, say the same
there. Of the others those win that have a hundredth of the votes of the host's best one, or stand on half of its pages.
Pass two reads the page again and takes what stands on winning paths, inside containers on them, or directly in what is
around these, in page order and cut into blocks; containers of links only inside the first path's containers. A page that
has nothing on winning paths, and hosts of fewer than three different pages, are taken whole but for rejected paths.

Menus, headers, footers, sidebars, notices, adverts, scripts, styles and reader comments are known by tag and role, and by
class and id unless what is named so has most of the text of a host's pages, three at least, or all of a page's. Forms are
treated as if named so, and are read, too, where most of a page's text is in them. A header inside an article or main
element is the article's. A word that also has other uses (`share`, `notice`) counts in a name only alone or with words of
layout (`share-buttons`, not `share-price`). Formulas are text, but for their annotations.

Reading is one pass over the page without recursion: its time and memory grow with the page's length, however deep its
elements are nested and however its tags are broken.

Defined cases: null or empty html, and pages without text, give an empty text; a null or unreadable url puts the page
with the other such pages; a null page_id is as good as any; markup that is cut off or badly nested is closed as browsers
do; pages of any length are read whole; copies of a page say the same once; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import slices, table, written

NAMES = re.compile(r"(?:^|[\s/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
OPEN = re.compile(r"[a-zA-Z][^\s/>]*")
UNQUOTED = re.compile(r"[^>\"']*")
SPACE = re.compile(r"\s+")
#: Different pages of a host that say the same on a path, from which on it may be no article's.
SAME_PAGES = 3
#: A path wins with this part of the best one's votes, or on this part of the host's pages.
VOTE_PART, PAGE_PART = 100, 2
#: Bytes of all hosts' verdicts up to which they are sent to the pages; beyond, both are dealt over hosts and SALTS parts.
SENT_BYTES, SALTS = 16 << 20, 64
#: HTML's void elements, elements whose content is no text, and elements that stand as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg annotation annotation-xml object select button canvas".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key's group ends an open element of the value's.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol dl table body html div article section main".split())
ASIDE_TAGS = frozenset("nav header footer aside menu dialog".split())
#: Words of names that stand beside articles, those that do so only alone or with words of layout, and these.
ASIDE_WORDS = re.compile(r"advert\w*|adsense|sponsor\w*|nav\w*|breadcrumbs?|side-?bar|foot(?:er)?\w*|masthead|cookies?|consent|newsletter|subscribe|disqus|pagination|pager")
TWO_WAY_WORDS = re.compile(r"ads?|promo\w*|banner|menu|header|notices?|alert|popup|modal|share|sharing|social|related|recommend\w*|comments?|replies|respond|widget|toolbar|skip")
LAYOUT_WORDS = frozenset("area areas articles bar block blocks body bottom box boxes btn btns button buttons card cards col column container content contents entries fixed form global group holder icon icons id inline inner item items label left link links list lists main module more page panel posts right row section site slot sticky stories thread title top unit widgets wrap wrapper zone".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())


CONTAINERS = frozenset("html body address article blockquote center details dir div dl fieldset figure main ol section table ul".split())


class Page:
    """A page as runs of text and breaks between blocks in order. `runs` holds (element, text), with None for a break;
    of an element `path` (a hash), `container` (the element that its text counts for), `linked`, `beside` (by tag or role)
    and `named` (the innermost element around it, if any, whose name stands beside articles) are known."""

    def __init__(self, page: str, released: frozenset[int] = frozenset()):
        self.runs: list[tuple[int, str | None]] = []
        self.path, self.container, self.linked, self.beside, self.named = [_hash("html")], [0], [False], [False], [-1]
        self.around = [0]
        self.up_named: dict[int, int] = {}  # a named element's next one outward
        self.forms: set[int] = set()
        self.named_path: dict[int, int] = {}
        self._read(page)
        self._settle(released)

    def _read(self, page: str) -> None:
        stack = [(0, "html")]
        at_tag: dict[str, list[int]] = {}  # where in the stack an element of the tag is open
        limits = [0]  # where in the stack elements are that close nothing outside themselves
        none_after: dict[str, int] = {}  # from where on a quote or an end tag is known to be missing

        def pop(k: int) -> None:
            for place in range(len(stack) - 1, k - 1, -1):
                tag = stack.pop()[1]
                at_tag[tag].pop()
                if limits[-1] == place:
                    limits.pop()
                if tag in BLOCKS:
                    self.runs.append((stack[-1][0], None))

        def close(tags: tuple[str, ...]) -> None:
            k = max((at_tag[x][-1] for x in tags if at_tag.get(x)), default=0)
            if k > limits[-1]:
                pop(k)

        def find(what: str, start: int) -> int:
            if none_after.get(what, start + 1) <= start:
                return -1
            k = page.find(what, start)
            if k < 0:
                none_after[what] = start
            return k

        def tag_end(start: int) -> int:
            """The place of the > that ends the tag, quoted ones aside; -1 if the page ends before."""
            while True:
                start = UNQUOTED.match(page, start).end()
                if start == size:
                    return -1
                if page[start] == ">":
                    return start
                k = find(page[start], start + 1)
                start = start + 1 if k < 0 else k + 1  # a quote that is never closed is a character

        at, size = 0, len(page)
        while at < size:
            k = find("<", at)
            if k < 0:
                self.runs.append((stack[-1][0], page[at:]))
                break
            if k > at:
                self.runs.append((stack[-1][0], page[at:k]))
            at = k
            following = page[k + 1 : k + 2]
            if following in ("!", "?"):
                mark = "-->" if page.startswith("<!--", k) else "]]>" if page.startswith("<![CDATA[", k) else ">"
                end = find(mark, k + (4 if mark == "-->" else 1))
                at = size if end < 0 else end + len(mark)
                continue
            ending = following == "/"
            name = OPEN.match(page, k + 1 + ending)
            if name is None:
                at = k + 1
                self.runs.append((stack[-1][0], "<"))
                continue
            tag = name[0].lower()
            end = find(">", name.end()) if ending else tag_end(name.end())
            if end < 0:
                break
            attributes, at = page[name.end() : end], end + 1
            if ending:
                open_at = at_tag.get(tag)
                if open_at and (tag in BLOCKS or open_at[-1] >= limits[-1]):  # a stray inline end tag closes nothing outside its container
                    pop(open_at[-1])
                continue
            if tag in RAW:
                missing = "</" + tag
                if none_after.get(missing, at + 1) > at:
                    found = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                    if found is None:
                        none_after[missing] = at
                else:
                    found = None
                at = found.end() if found else size if tag in ("script", "style") else at
                continue
            if tag in ("html", "head"):
                continue
            if tag == "br":
                self.runs.append((stack[-1][0], " "))
                continue
            if tag in BLOCKS:
                close(("p",))
                self.runs.append((stack[-1][0], None))
            if tag in ENDS:
                close(ENDS[tag])
            if tag in VOID:
                continue
            up = stack[-1][0]
            label, classed, beside, named = _label(tag, attributes, bool(at_tag.get("article") or at_tag.get("main")))
            node = len(self.path)
            block = tag in BLOCKS
            self.around.append(up)
            self.path.append(_hash(f"{self.path[up]:x}/{label}") if block else self.path[up])
            self.container.append(node if block and (tag in CONTAINERS or classed) else self.container[up])
            self.linked.append(self.linked[up] or tag == "a")
            self.beside.append(self.beside[up] or beside)
            self.named.append(node if named else self.named[up])
            if named:
                self.up_named[node] = self.named[up]
                if tag == "form":
                    self.forms.add(node)
                self.named_path[node] = _hash(f"{self.path[up]:x}/named/{label}")
            if not attributes.endswith("/"):
                at_tag.setdefault(tag, []).append(len(stack))
                if tag in LIMITS:
                    limits.append(len(stack))
                stack.append((node, tag))

    def _settle(self, released: frozenset[int]) -> None:
        """Leaves out what stands beside the text: named elements, too, but for the released paths, forms with most of the
        page's text, and pages without other text."""
        self.inside, whole = dict.fromkeys(self.up_named, 0), 0  # characters outside links
        for node, text in self.runs:
            if text is not None and not self.beside[node] and not self.linked[node]:
                whole += len(text.strip())
                if self.named[node] >= 0:
                    self.inside[self.named[node]] += len(text.strip())
        for node in sorted(self.inside, reverse=True):
            if self.up_named[node] >= 0:
                self.inside[self.up_named[node]] += self.inside[node]
        hidden = {-1: False}
        for node in sorted(self.inside):
            read = self.named_path[node] in released or (node in self.forms and 2 * self.inside[node] > whole)
            hidden[node] = hidden[self.up_named[node]] or not read
        runs = [(k, x) for k, x in self.runs if not self.beside[k]]
        seen = [(k, x) for k, x in runs if not hidden[self.named[k]]]
        self.runs = seen if any(x is not None and x.strip() for _, x in seen) else runs

    def containers(self) -> dict[int, tuple[int, int, list[str]]]:
        """Of each container with text the characters outside links, those inside, and its runs of text."""
        out: dict[int, list] = {}
        for node, text in self.runs:
            if text is not None and (n := len(text.strip())):
                own = out.setdefault(self.container[node], [0, 0, []])
                own[self.linked[node]] += n
                own[2].append(text)
        return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _named_beside(names: str, in_article: bool) -> bool:
    """Whether a class or id says that the element stands beside the text."""
    for name in names.lower().replace("side-bar", "sidebar").split():
        parts = [x.strip("0123456789") for x in re.split("[-_]+", name)]
        two_way = [x for x in parts if TWO_WAY_WORDS.fullmatch(x)]
        if in_article and two_way == ["header"]:
            continue
        if any(ASIDE_WORDS.fullmatch(x) for x in parts) or (two_way and all(x in two_way or x in LAYOUT_WORDS or not x for x in parts)):
            return True
    return False


def _label(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, bool, bool]:
    """Tag with its first class, digits dropped; whether it has one; whether tag or role, and whether class or id (or that it
    is a form), say that the element stands beside the text."""
    own = tag == "header" and in_article
    if not attributes:
        return tag, False, tag in ASIDE_TAGS and not own, tag == "form"
    names = {m[1].lower(): next(x for x in m.groups()[1:] if x is not None) for m in NAMES.finditer(attributes)}
    first = names.get("class", "").split()[:1]
    label = tag + "." + re.sub(r"\d+", "", first[0]) if first else tag
    role = names.get("role", "").lower()
    beside = (tag in ASIDE_TAGS and not own) or role in ASIDE_ROLES
    named = tag not in ("body", "article", "main") and (tag == "form" or role == "form" or any(_named_beside(x, in_article) for x in (names.get("class", ""), names.get("id", "")) if x))
    return label, bool(first), beside, named


def votes(page: str | None) -> list[tuple[int, int, int, int, bool]]:
    """A page's container paths with score, hash of what stands there, and hash of the whole page's text; and, marked as
    such, the paths of its outermost named elements."""
    read = Page(page or "")
    by_path: dict[int, list] = {}
    for node, (free, linked, texts) in read.containers().items():
        own = by_path.setdefault(read.path[node], [0, []])
        own[0] += max(0, free - linked)
        own[1] += texts
    said = {path: _hash(" ".join(" ".join(texts).split())) for path, (_, texts) in by_path.items()}
    whole = _hash(",".join(map(str, said.values())))
    named: dict[int, int] = {}
    for node, n in read.inside.items():
        if read.up_named[node] < 0 and n:
            named[read.named_path[node]] = named.get(read.named_path[node], 0) + n
    return [(path, score, said[path], whole, False) for path, (score, _) in by_path.items()] + [(path, n, whole, whole, True) for path, n in named.items()]


def extract(page: str | None, first: int | None, rejected: list[int] | None, released: list[int] | None = None, won: list[int] | None = None) -> str:
    """Text of a page's containers on the paths that won, inside such containers or around them (of all paths where none
    of them has text here or `won` is None), but for the rejected paths; those that are mostly links only within a
    container on the first path. released: paths of named elements that are read nevertheless."""
    open_ = frozenset(released or ())
    read, out = Page(page or "", open_), []
    against, winners = set(rejected or ()), None if won is None else {first, *won}
    within, chosen = [False] * len(read.path), [winners is None] * len(read.path)
    for node, up in enumerate(read.around):  # elements come after those around them
        within[node] = read.path[node] == first or (node > 0 and within[up])
        chosen[node] = chosen[node] or read.path[node] in winners or read.named_path.get(node) in open_ or (node > 0 and chosen[up])
    kept = {node for node, (free, linked, _) in read.containers().items() if read.path[node] not in against and (free >= linked or within[node])}
    if any(chosen[node] for node in kept):
        for node in range(len(read.path) - 1, 0, -1):  # what is around a container that is taken
            if chosen[node] and node in kept:
                up = read.around[node]
                while not chosen[up]:
                    chosen[up] = True
                    up = read.around[up]
        kept = {node for node in kept if chosen[node]}
    block: list[str] = []
    for node, text in [*read.runs, (0, None)]:
        if text is None:
            joined = SPACE.sub(" ", html.unescape("".join(block))).strip()
            if joined:
                out.append(joined)
            block.clear()
        elif read.container[node] in kept:
            block.append(text)
    return "\n\n".join(out)


def host_of(pages: DataFrame):
    return F.coalesce(F.lower(F.try_parse_url(pages["url"], F.lit("HOST"))), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host_key, path (the one with the most votes, ties by path), rejected (paths where pages say the same), released
    (paths of named elements with most of the host's text) and won (null for hosts of fewer than `SAME_PAGES` pages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = [(h, *v) for h, x in zip(batch["host_key"].to_pylist(), batch["html"].to_pylist(), strict=True) for v in votes(x)]
            kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["host_key", "path", "votes", "said", "page", "named"])

    cast = pages.select(host_of(pages).alias("host_key"), "html").mapInArrow(run, "host_key string, path long, votes long, said long, page long, named boolean")
    said = cast.groupBy("host_key", "named", "path", "said", "page").agg(F.sum("votes").alias("votes"))
    said = said.groupBy("host_key", "named", "path", "said").agg(F.count("*").alias("n"), F.sum("votes").alias("votes"))
    paths = said.groupBy("host_key", "named", "path").agg(F.max("n").alias("most"), F.sum("n").alias("pages"), F.sum("votes").alias("votes"))
    same = ~F.col("named") & (F.col("most") >= SAME_PAGES) & (2 * F.col("most") > F.col("pages"))
    paths = paths.withColumn("same", same)
    own = F.when(~F.col("named") & ~F.col("same"), F.col("votes"))
    first = F.max_by("path", F.struct((~F.col("named")).alias("own"), (~F.col("same")).alias("won"), "votes", "path"))
    hosts = paths.groupBy("host_key").agg(first.alias("path"), F.sum("votes").alias("total"), F.max(own).alias("best"), F.max(F.when(~F.col("named"), F.col("pages"))).alias("host_pages"))
    # A host's verdicts are filtered before they are gathered: each list has paths of many pages or many votes.
    known = paths.withColumnRenamed("path", "p").join(hosts, "host_key")
    enough = (VOTE_PART * F.col("votes") >= F.col("best")) | (PAGE_PART * F.col("pages") >= F.col("host_pages"))
    kind = F.when(F.col("named"), F.when((F.col("pages") >= SAME_PAGES) & (2 * F.col("votes") > F.col("total")), "released")).when(F.col("same"), F.when(F.col("p") != F.col("path"), "rejected")).when(enough & (F.col("votes") > 0), "won")
    listed = known.withColumn("kind", kind).groupBy("host_key", "path", "host_pages").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("p"))).alias(k) for k in ("rejected", "released", "won")))
    return listed.select("host_key", "path", "rejected", "released", F.when(F.col("host_pages") >= SAME_PAGES, F.col("won")).alias("won"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and path (its host's first) of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            texts = [extract(*x) for x in zip(*(batch[c].to_pylist() for c in ("html", "path", "rejected", "released", "won")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), batch["path"]], ["page_id", "url", "text", "n_chars", "path"])

    hosts = written(host_paths(pages), "host-paths")
    size = hosts.agg(F.sum(F.octet_length("host_key") + 8 * (F.size("rejected") + F.size("released") + F.coalesce(F.size("won"), F.lit(0)) + 8))).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of(pages).alias("host_key"))
    if size <= SENT_BYTES:
        joined = rows.join(F.broadcast(hosts), "host_key", "left")  # the pages stay where they are
    else:
        salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SALTS)).cast("int")).join(salted, ["host_key", "salt"], "left")
    return joined.select("page_id", "url", "html", "path", "rejected", "released", "won").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, path long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
