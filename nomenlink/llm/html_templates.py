"""HTML extraction by equivalence classes of template tokens.

Pages of one host come from a template. Markup tokens, told apart by where
they stand, that occur equally often on every page of a set have the same
occurrence vector; tokens of one vector form an equivalence class. Classes of
enough pages make the host's template: a tree of containers, nested by their
paths, with slots between them. Text found on nearly all pages that have its
place is template too. The deepest slot that holds most of the other text is
the article, and is extracted on every page. Elements and names that usually
mean menus, notices and the like are a hint only, for hosts with too few pages
and for pages without the slot.

Occurrence vectors are never gathered: each is kept as a fingerprint, the XOR
of one hash per page and count, so a host of any size is a partial sum.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenlink.llm.scratch import Scratch
from nomenlink.llm.url_rules import host_of
from nomenlink.operators.skew import salted_join

# Elements by role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
_CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form ul ol dl table thead tbody tfoot tr td th "
    "figure fieldset details dialog menu select button center blockquote".split()
)
_BLOCKS = _CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd pre hr address caption figcaption legend option summary hgroup search".split()
)
_BOILERPLATE = frozenset("head nav footer aside form menu select button fieldset dialog".split())
_BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice "
    "notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget header footer masthead "
    "comment comments disqus respond replies share sharing social related newsletter subscribe signup popup modal "
    "pagination pager login search toolbar complementary contentinfo".split()
)
_COMMENT_NAMES = frozenset("comment comments disqus respond replies".split())
_ARTICLES = frozenset(("article", "main"))
# Different pages from which a host's own template decides.
ENOUGH_PAGES = 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.DOTALL
)
_NAMING = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_LETTERS = re.compile("[a-z]+")
_DIGITS = re.compile(r"\d+")


def _names(attributes: str) -> str:
    """Classes, ids and roles of an element in one order, numbers left out."""
    if not attributes or "=" not in attributes:
        return ""
    found = {_DIGITS.sub("", x.lower()) for m in _NAMING.finditer(attributes) for x in "".join(m.groups("")[1:]).split()}
    return ".".join(sorted(found - {""}))


class _Reader:
    """Walks a page once: containers, their paths, and text blocks in order."""

    def __init__(self, page: str):
        self.tokens: Counter[str] = Counter()
        self.order: list[str] = []
        self.blocks: list[tuple[str, str, str]] = []  # path, deepest boilerplate container on it, text
        self._open: list[tuple[str, str, str]] = []  # tag, path, deepest boilerplate container
        self._text: list[str] = []
        self._walk(page)

    def _close_block(self) -> None:
        if self._text:
            text = " ".join(entities.unescape("".join(self._text)).split())
            self._text.clear()
            if text:
                _, path, aside = self._open[-1] if self._open else ("", "", "")
                self.blocks.append((path, aside, text))

    def _see(self, token: str) -> None:
        if token not in self.tokens:
            self.order.append(token)
        self.tokens[token] += 1

    def _enter(self, tag: str, attributes: str) -> None:
        _, above, aside = self._open[-1] if self._open else ("", "", "")
        names = _names(attributes)
        path = f"{above}>{tag}.{names}" if names else f"{above}>{tag}"
        self._see(path)
        if tag in _CONTAINERS:
            words = set(_LETTERS.findall(names))
            # The heading of an article is part of it.
            outer = tag == "header" and not any(f">{x}" in above for x in _ARTICLES)
            named = bool(words & _BOILERPLATE_NAMES) and tag != "header"
            own = tag in _BOILERPLATE or outer or named
            out = own and tag not in ("html", "body", *_ARTICLES)
            self._open.append((tag, path, path if out else aside))

    def _leave(self, tag: str) -> None:
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth][0] == tag:
                del self._open[depth:]
                return

    def _walk(self, page: str) -> None:
        place = 0
        while True:
            match = _TOKEN.search(page, place)
            if match is None:
                rest = page[place:]
                cut = re.search(r"<[A-Za-z/!?][^<]*\Z", rest)  # a tag that the page's end cuts off
                self._text.append(rest[: cut.start()] if cut else rest)
                break
            if match.start() > place:
                self._text.append(page[place : match.start()])
            place = match.end()
            if match.group(2) is None:
                continue
            tag = match.group(2).lower()
            if tag in _BLOCKS or tag in _RAW:
                self._close_block()
            elif tag == "br":
                self._text.append(" ")
            if match.group(1):
                self._leave(tag)
            elif tag in _RAW:
                self._see(f"{self._open[-1][1] if self._open else ''}>{tag}")
                end = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, place)
                place = end.end() if end else len(page)
            elif tag not in _VOID:
                self._enter(tag, match.group(3))
        self._close_block()

    def fresh(self, known: set[bytes] | None) -> list[tuple[str, str]]:
        """Path and text of blocks that are not template; without ``known`` texts the hints decide."""
        if known is None:
            return [(path, text) for path, aside, text in self.blocks if not aside]
        return [(path, text) for path, _, text in self.blocks if not known or _mark(path, text) not in known]

    def article(self) -> list[str]:
        """Blocks of the page's article elements, or of ``main`` if there are none; none without either.

        Containers of boilerplate inside are left out; those around do not matter.
        """
        tags = {tag for path, _, _ in self.blocks for tag in _tags(path)} & _ARTICLES
        if not tags:
            return []
        inside = [(path, aside, text, _top(path, "article" if "article" in tags else "main")) for path, aside, text in self.blocks]
        inside = [block for block in inside if block[3]]
        return [text for _, aside, text, top in inside if not _within(aside, top)] or [text for _, _, text, _ in inside]

    def masses(self, known: set[bytes] | None) -> Counter[str]:
        """Characters of text, template left out, below each path; boilerplate by its hints only if nothing else is there."""
        found: Counter[str] = Counter()
        plain = {(path, text) for path, aside, text in self.blocks if not aside}
        fresh = self.fresh(known)
        for path, text in [block for block in fresh if block in plain] or fresh:
            found[""] += len(text)
            at = path
            while at:
                found[at] += len(text)
                at = at.rpartition(">")[0]
        return found


def _below(path: str, top: str) -> bool:
    return path == top or path.startswith(top + ">")


def _within(path: str, top: str) -> bool:
    return path != top and _below(path, top)


def _tags(path: str) -> list[str]:
    return [step.partition(".")[0] for step in path.split(">")]


def _top(path: str, tag: str) -> str:
    """The path as far as its first element of a kind; empty without one."""
    tags = _tags(path)
    return ">".join(path.split(">")[: tags.index(tag) + 1]) if tag in tags else ""


def _mark(path: str, text: str) -> bytes:
    """Name of a text at its place."""
    return hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _known(texts: pa.Scalar) -> set[bytes] | None:
    return set(texts.as_py()) if texts.is_valid else None


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of a page with its place once, the places, and the page; pages of equal texts have one number."""
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64()]
    for batch in batches:
        rows = []
        for host, page in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            marks = sorted({(_mark(path, ""), _mark(path, text)) for path, _, text in _Reader(page).blocks})
            whole = b"".join(mark for _, mark in marks)
            number = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "big", signed=True)
            places = sorted({place for place, _ in marks})
            rows += [(host, place, mark, number) for place, mark in marks]
            rows += [(host, place, b"", number) for place in (b"", *places)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["host", "place", "mark", "page"])


def host_texts(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``host`` and the ``texts`` (marks) of its template; only hosts with enough pages.

    ``pages`` has ``host`` and ``html``. A text is template if it stands on nine
    of ten different pages that have text at its place, and the place has text
    on half of the host's.
    """
    seen = pages.select("host", "html").mapInArrow(_marks, "host string, place binary, mark binary, page long")
    counts = seen.distinct().groupBy("host", "place", "mark").agg(F.count(F.lit(1)).alias("pages"))
    # A text of one page is none of a template; only the others are kept.
    counts = scratch.keep(counts.where(F.col("pages") >= ENOUGH_PAGES // 2), "texts")
    of_place, of_host = F.length("mark") == 0, F.length("place") == 0
    hosts = counts.where(of_host & (F.col("pages") >= ENOUGH_PAGES)).select("host", F.col("pages").alias("of"))
    places = salted_join(counts.where(of_place & ~of_host), hosts, ["host"]).where("2 * pages >= of")
    places = places.select("host", "place", F.col("pages").alias("here"))
    often = salted_join(counts.where(~of_place), places, ["host", "place"]).where("10 * pages >= 9 * here")
    listed = often.groupBy("host").agg(F.collect_list("mark").alias("texts"))
    return hosts.join(listed, "host", "left").select(
        "host", F.coalesce("texts", F.array().cast("array<binary>")).alias("texts")
    )


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "token", "page", "times", "rank", "mass", "total"]
    for batch in batches:
        rows = []
        heads = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
        for (host, page, text), texts in zip(heads, batch.column(3), strict=True):
            reader = _Reader(text)
            masses = reader.masses(_known(texts))
            rows += [
                (host, token, page, reader.tokens[token], rank, masses.get(token, 0), masses[""])
                for rank, token in enumerate(reader.order)
            ]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def host_templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``host``, its template ``tokens`` in order, and the path ``slot`` of its article.

    ``pages`` has ``host``, ``page`` (a number for each page), ``html`` and the
    host's template ``texts``. A class is valid if its pages are at least half
    of the host's. A token takes part at the place where it usually first stands.
    """
    schema = "host string, token string, page long, times long, rank long, mass long, total long"
    seen = pages.select("host", "page", "html", "texts").mapInArrow(_occurrences, schema)
    tokens = seen.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "times")).alias("vector"),
        F.count(F.lit(1)).alias("pages"),
        F.max("times").alias("most"),
        F.avg("rank").alias("rank"),
        F.sum("mass").alias("mass"),
        F.sum("total").alias("total"),
    )
    tokens = scratch.keep(tokens, "tokens")
    # Sizes come from partial sums: the tokens of a host never meet before the valid ones are left.
    whole = tokens.groupBy("host").agg(F.max("pages").alias("of"))
    valid = salted_join(tokens, whole, ["host"]).where("2 * pages >= of")
    of_class = ["host", "vector", "pages"]
    sizes = valid.groupBy(*of_class).agg(F.count(F.lit(1)).alias("together"))
    valid = salted_join(valid, sizes, of_class)
    # Deepest container of the largest class that keeps most of the text.
    slot = (F.col("most") == 1) & (2 * F.col("mass") > F.col("total"))
    depth = F.size(F.split("token", ">"))
    best = F.struct(slot, depth, "together", F.col("mass"), F.col("token"))
    listed = F.sort_array(F.collect_list(F.when(F.col("most") == 1, F.struct("rank", "token"))))
    template = valid.groupBy("host").agg(listed["token"].alias("tokens"), F.max(F.when(slot, best)).alias("best"))
    return template.select("host", "tokens", F.coalesce("best.token", F.lit("")).alias("slot"))


def main_text(page: str, slot: str | None, tokens: list[str] | None, known: set[bytes] | None = None) -> str:
    """The text of the page's article, a line per block.

    An article element says what the article is; all its text stays, repeated or
    not, but for containers of boilerplate in it, reader comments among them. On
    a page without one the template's slot decides, where the page has it in
    the template's containers. ``known`` are the marks of the host's template
    texts; they are left out unless nothing else is in the slot. Without them
    or the slot, boilerplate is left out by the hints, unless they leave less
    than half of the page without its comments.
    """
    reader = _Reader(page)
    article = reader.article()
    if article:
        return "\n".join(article)
    whole = [(path, text) for path, _, text in reader.blocks]
    texts = reader.fresh(known)
    around = [token for token in tokens or () if slot and _below(slot, token)]
    inside = slot and all(reader.tokens[token] for token in around)
    if inside and known is not None:
        own = {(path, text) for path, aside, text in reader.blocks if not _within(aside, slot)}
        found = [block for block in texts if _below(block[0], slot)]
        found = [block for block in found if block in own] or found
        found = found or [block for block in whole if _below(block[0], slot)]
        if found:
            return "\n".join(text for _, text in found)
    hinted = reader.fresh(None)
    if known is not None:
        hinted = [block for block in hinted if _mark(*block) not in known] or hinted
    found = [block for block in hinted if inside and _below(block[0], slot)] or hinted
    rest = [block for block in (texts if known else whole) if _COMMENT_NAMES.isdisjoint(_LETTERS.findall(block[0]))]
    if 2 * _chars(found) < _chars(rest):
        found = rest
    return "\n".join(text for _, text in found)


def _chars(blocks: list[tuple[str, str]]) -> int:
    return sum(len(text) for _, text in blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, slots, tokens, known = (batch.column(k) for k in (2, 3, 4, 5))
        texts = [
            main_text(page.as_py(), slot.as_py(), around.as_py(), _known(marks))
            for page, slot, around, marks in zip(pages, slots, tokens, known, strict=True)
        ]
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and main ``text`` of every page.

    Reads ``page_id``, ``url`` and ``html``; other columns are ignored,
    whatever their names. A block is what stands between tags of blocks;
    character references are decoded, white space inside a block becomes one
    space, blocks are joined by a line feed.

    Null and empty html give an empty text. Pages without a host are a host of
    their own together. A null ``page_id`` stays null; rows that repeat are
    all returned and weigh as often in the template. A page of any length is
    read whole. No rows give no rows.
    """
    scratch = Scratch(pages.sparkSession, "templates")
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
    )
    number = F.xxhash64("page_id", "url", "html").alias("page")
    texts = scratch.keep(host_texts(source, scratch), "host-texts")
    numbered = source.select("host", number, "html").join(texts, "host", "left")
    templates = scratch.keep(host_templates(numbered, scratch).join(texts, "host", "left"), "templates")
    joined = source.join(templates, "host", "left").select("page_id", "url", "html", "slot", "tokens", "texts")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")


def op1_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
