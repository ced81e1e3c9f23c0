"""Main text of web pages by template deduction with equivalence classes.

1. A page is cut into tokens: tags with their path of elements, text blocks as a whole, and words with
   the path of their element. The same string in different paths is a different token; sibling
   containers with one name are told apart by their number.
2. Over the pages of a host each token has an occurrence vector, its count in every page. Spark sums
   a 48-bit hash of (page's content, count) for each token, which stands for the whole vector and can
   be added up before anything is shuffled, so a host of any size is never gathered. Tokens with equal
   sums form an equivalence class.
3. A class is large enough with MIN_TOKENS tokens, found in MIN_SHARE of the host's different pages
   or more; copies count as one. It is valid if its tags and blocks come in one order in MIN_SHARE of the
   pages that have it; words come in the order of their blocks. Valid classes nest: a token's path names the elements around it, so the elements that
   open and close a class lie inside those of the class around it. They are the host's template, a tree
   of elements with slots between its tokens.
4. A slot's text is what its template element holds beside template blocks and beside parts that an
   element or class name gives away as menu, header, footer, sidebar, notice, advert, form or comments.
   The elements that hold more than half of the host's slot text form a chain, and the article is the
   innermost of them; where the chain has an element named article or main, the outermost of these. Length alone
   can't tell an article from longer comments below it, so an unnamed one must be where the text goes on behind the
   top heading: if on most pages the first slot behind the first h1 is outside of it, the largest element with that slot and
   at least LEAD_SHARE of the text is the article.
   A page's text is its slots in there and its top headings that aren't template.
5. Names alone decide on hosts with too few pages for a template, and on pages without the element.
   There the text is that of the article or main element, or of all blocks where the page has none,
   without parts that names give away and without blocks made of template words.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdelta.llm.common import quoted, small_batches, written

MIN_TOKENS = 3
MIN_SHARE = 0.6
#: Hosts with fewer pages deduce nothing: in so few, words of an article easily have equal vectors.
MIN_PAGES = 4
#: Share of a host's slot text that an element which follows the heading has to have.
LEAD_SHARE = 0.2
#: Tokens that a task sums up before it hands them on.
HELD_TOKENS = 2_000_000
#: A page counts as this many units, shared among its copies.
UNIT = 1 << 32

# Fixed values of HTML: elements without content, elements that end a block, elements without text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
#: Elements that are never the article, and words that name such parts in class, id and role.
ASIDE = frozenset("nav header footer aside form button select menu dialog head script style noscript template textarea title iframe".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments comentario comentarios commentaire commentaires consent contentinfo cookie cookiebar cookies dialog disqus footer header kommentar kommentare menu modal nav navbar navigation newsletter opinions notice notification opiniones popup promo related topmenu reply share sharing sidebar social sponsor sponsored subscribe".split()
)
#: Words that stand beside those in names of such parts; inside an article only names made of both are parts that go.
PLAIN_WORDS = frozenset("area bar block body box button buttons container content group icons inner item items link links list outer panel posts reader readers section site slot title top bottom left right unit user users widget wrap wrapper".split())
MAIN = frozenset({"article", "main"})
#: Elements that are numbered among siblings with the same name.
NUMBERED = frozenset("aside div dl footer form header nav ol section table ul".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|style\s*=\s*[\"'][^\"'>]*display\s*:\s*none)", re.I)
# Optional end tags: an element that ends the open one of its kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Block:
    """Text between two block borders: its element path, its words, whether it is in a part that goes, whether in the main one, number of tags before."""

    __slots__ = ("path", "text", "words", "aside", "main", "at")

    def __init__(self, path: str, words: list[str], aside: bool, main: bool, at: int):
        self.path, self.text, self.words, self.aside, self.main, self.at = path, " ".join(words), words, aside, main, at


def _is_aside(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in ASIDE:
        return tag != "header" or not in_main  # inside the article it holds the title
    if not attributes or tag in ("html", "body"):
        return False
    if ("hidden" in attributes or "display" in attributes) and _HIDDEN.search(attributes):
        return True
    if "=" not in attributes:
        return False
    names = (_NAME.findall(n) for m in _ATTRIBUTE.finditer(attributes) for n in entities.unescape(m[2] or m[3] or m[4] or "").lower().split())
    return any(any(w in ASIDE_WORDS for w in n) and (not in_main or all(w in ASIDE_WORDS or w in PLAIN_WORDS for w in n)) for n in names)


class _Known(dict):
    """What a worker remembers of keys that mostly come again: hashes of paths and words, what attributes say."""

    def __init__(self, value_of: Callable, most: int, length: Callable = len):
        self.value_of, self.most, self.length = value_of, most, length

    def __missing__(self, key):
        x = self.value_of(key)
        if self.length(key) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = x
        return x


#: Attributes of elements that a worker remembers, and the characters of the longest key that it does.
HELD_ATTRIBUTES, LONGEST = 20_000, 1000
_aside_of = _Known(lambda key: _is_aside(*key), HELD_ATTRIBUTES, lambda key: len(key[1]))
_class_of = _Known(lambda name: f".{'.'.join(sorted(_NAME.findall(name.lower())))[:60]}" if "class" in name else "", HELD_ATTRIBUTES)
_OPENS = BLOCK | RAW


def parse(page: str) -> tuple[list[Block], list[str]]:
    """The page's text blocks and its tag tokens, both in page order."""
    blocks: list[Block] = []
    tags: list[str] = []
    # Elements named as parts that go: the named one around them, their depth among named ones, their characters.
    named: list[list[int]] = [[-1, 0, 0]]
    held: list[tuple[int, int]] = []  # for each block, the named element around it and the one around its main element, or -1
    stack: list[tuple[str, str, int, int]] = [("", "", 0, -1)]
    numbers: dict[str, int] = {}
    text: list[str] = []

    def close() -> None:
        words = entities.unescape("".join(text)).split()
        if words:
            _, path, around, main = stack[-1]
            blocks.append(block := Block(path, words, False, main >= 0, len(tags)))
            held.append((around, main))
            while around >= 0:
                named[around][2] += len(block.text)
                around = named[around][0]
        text.clear()

    at, search = 0, _TAG.search
    while at < len(page):
        m = search(page, at)
        if not m:
            text.append(page[at:])
            break
        start, end = m.span()
        if start > at:
            text.append(page[at:start])
        at = end
        closing, tag, attributes = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                if text:
                    close()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        tags.append(f"{stack[-1][1]}/{tag}.end")
                        break
            elif tag == "br":
                text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _OPENS:
            continue  # inline elements neither end a block nor have a place in the path
        if text:
            close()
        if stack[-1][0] == "p":
            del stack[-1:]
        if tag in _CLOSES:
            closes = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "tbody", "thead", "div", "section"):
                    break
        _, path, around, main = stack[-1]
        if tag not in VOID and tag not in RAW and _aside_of[tag, attributes, main >= 0]:
            named.append([around, named[around][1] + 1, 0])
            around = len(named) - 1
        path = f"{path}/{tag}{_class_of[attributes.strip()]}"
        if tag in NUMBERED:
            # Siblings of one opened element: a closed and reopened parent of the same path goes on counting.
            numbers[path] = n = numbers.get(path, 0) + 1
            if n > 1:
                path = f"{path}#{n}"
        tags.append(path)
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append((tag, path, around, around if main < 0 and tag in MAIN else main))
    close()
    stays = {0}
    mains = {main for _, main in held if main >= 0}
    if mains:
        least = min(named[x][1] for x in mains)
        for x in mains:
            while named[x][1] <= least and x not in stays:
                stays.add(x)
                x = named[x][0]
    else:
        stays.update(i for i, x in enumerate(named) if 2 * x[2] > named[0][2])
    goes = [False] * len(named)
    for i, x in enumerate(named[1:], 1):
        goes[i] = goes[x[0]] or i not in stays
    for block, (around, _) in zip(blocks, held, strict=True):
        block.aside = goes[around]
    return blocks, tags


def _block_token(block: Block) -> str:
    return f"{block.path}\n{block.text}"


def _tokens(page: str) -> Counter[str]:
    """Each token's count."""
    blocks, tags = parse(page)
    out = Counter(f"<{tag}" for tag in tags)
    for block in blocks:
        path = f"{block.path} "
        out.update([path + word for word in block.words])
        out[_block_token(block)] += 1
    return out


_MIX = 0x9E3779B97F4A7C15


def _half(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode())
    return h - (h >> 63 << 64)


def _hash(token: str) -> int:
    """48 bits: they tell the tokens of a host apart and move cheaply. Made of what stands before the first blank and behind it."""
    head, _, tail = token.partition(" ")
    return (_half(head) + _half(tail) * _MIX & 0xFFFFFFFFFFFFFFFF) >> 16


_half_of = _Known(_half, HELD_TOKENS)
_tag_of = _Known(lambda path: _hash(f"<{path}"), HELD_TOKENS)


def _sequence(page: str, with_words: bool = True) -> tuple[list[Block], np.ndarray, np.ndarray]:
    """The blocks, the place of each block's token, and the hashes of all tokens in page order."""
    blocks, tags = parse(page)
    split = [b.words if with_words else () for b in blocks]
    sizes = np.array([len(x) for x in split], np.int64)
    before = np.cumsum(sizes) - sizes
    places = np.array([b.at for b in blocks], np.int64) + np.arange(len(blocks)) + before
    words = np.fromiter(map(_half_of.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum())).view(np.uint64)
    paths = np.repeat(np.fromiter((_half_of[b.path] for b in blocks), np.int64, len(blocks)).view(np.uint64), sizes)
    at = np.arange(len(words)) + np.repeat(places + 1 - before, sizes)
    out, rest = np.empty(len(tags) + len(blocks) + len(words), np.int64), np.ones(len(tags) + len(blocks) + len(words), bool)
    out[at] = ((paths + words * np.uint64(_MIX)) >> np.uint64(16)).astype(np.int64)
    out[places] = [_hash(_block_token(b)) for b in blocks]
    rest[at] = rest[places] = False
    out[rest] = np.fromiter(map(_tag_of.__getitem__, tags), np.int64, len(tags))
    return blocks, places, out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for each host and token of a task: pages, in UNITs, and hash of the occurrence vector, modulo 2**48."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray, int]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for host, own in held.items():
            tokens = np.concatenate([x for x, _, _ in own])
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            vectors = np.add.reduceat(np.concatenate([x for _, x, _ in own])[order], starts) & np.uint64((1 << 48) - 1)
            pages = np.add.reduceat(np.repeat([n for _, _, n in own], [len(x) for x, _, _ in own])[order], starts)
            # Back to the order of the pages: tokens of one page alone have one vector there, which packs well when they are dealt.
            row = np.full(len(tokens), -1, np.int64)
            row[order[starts]] = np.arange(len(starts))
            row = row[row >= 0]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(host, pa.string()), len(starts)), *map(pa.array, (tokens[starts][row], pages[row], vectors[row].astype(np.int64)))], ["host", "token", "pages", "vector"])

    for batch in batches:
        hosts, contents, copies, pages = (batch.column(i).to_pylist() for i in range(4))
        for host, content, n, page in zip(hosts, contents, copies, pages, strict=True):
            tokens, counts = np.unique(_sequence(page or "")[2], return_counts=True)
            if not len(tokens):
                continue
            kinds, which = np.unique(counts, return_inverse=True)
            marks = np.array([_hash(f"{content} {x}") for x in kinds.tolist()], np.uint64)
            order = np.argsort(which, kind="stable")  # tokens with one vector stand together, so that it packs well
            held.setdefault(host, []).append((tokens[order], marks[which[order]], round(UNIT / n)))
            size += len(tokens)
            if size >= HELD_TOKENS:
                yield from out()
                held, size = {}, 0
    yield from out()


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)", 1))


def classes(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, token, class): the tokens of each host's classes that are large enough, of pages (host, html); written."""
    rows = pages.select("host", F.xxhash64("html").alias("content"), "html")
    contents = written(rows.groupBy("host", "content").agg(F.count("*").alias("copies")), "contents")
    # Written, so that Spark knows its size and moves the pages only where many have copies.
    copied = written(contents.where("copies > 1"), "copied")
    seen = rows.join(copied, ["host", "content"], "left").select("host", "content", F.coalesce("copies", F.lit(1)).alias("copies"), "html")
    seen = seen.mapInArrow(_occurrences, "host string, token long, pages long, vector long")
    # Halves are summed apart, so that no sum overflows; equal vectors have equal sums of both.
    halves = F.sum(F.shiftright("vector", 24)).alias("high"), F.sum(F.col("vector").bitwiseAND(F.lit((1 << 24) - 1))).alias("low")
    # Dealt before they are summed: a task has summed its own, and one vector packs better than two halves.
    each = seen.repartition("host", "token").groupBy("host", "token").agg(F.round(F.sum("pages") / UNIT).alias("pages"), *halves)
    sizes = contents.groupBy("host").agg(F.sum("copies").alias("rows"), F.count("*").alias("of")).where((F.col("rows") >= min_pages) & (F.col("of") > 1))
    common = written(each.join(sizes, "host").where(F.col("pages") >= F.col("of") * MIN_SHARE), "tokens")
    large = common.groupBy("host", "high", "low").agg(F.count("*").alias("size")).where(F.col("size") >= MIN_TOKENS)
    return written(common.join(large, ["host", "high", "low"]).select("host", "token", F.xxhash64("high", "low").alias("class")), "classes")


def _with_tokens(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """pages with the array of (token, class) of their host: at most 1 / MIN_SHARE times the different tokens of its mean page."""
    of_host = written(tokens.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("tokens")), "of_host")
    return pages.join(of_host, "host")


def _chain(path: str) -> list[str]:
    """The paths of the elements around a block, outermost first."""
    return [path[:i] for i, x in enumerate(path) if x == "/" and i] + [path] if path else []


#: For a block's path the elements around it, outermost first: hash of the element's tag, 1 if named as main, path.
_around = _Known(lambda path: [(_tag_of[x], int(x.rpartition("/")[2].partition(".")[0].partition("#")[0] in MAIN), x) for x in _chain(path)], HELD_ATTRIBUTES)


def _orders_and_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For pages (host, html, tokens), summed for each task: pages by host, class and order of the class's tags and blocks
    (kind 0: class, order), slot text by element (kind 1: token of the element, 1 if named as main, path), and pages
    whose first slot behind the first h1 is in an element (kind 2: the same)."""
    sums: Counter[tuple] = Counter()
    last, template, of_class = None, np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        for host, page, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if host != last:
                last, (template, of_class) = host, (tokens.values.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(template)
                template, of_class = template[order], of_class[order]
                known = set(template.tolist())
            blocks, places, every = _sequence(page or "", with_words=False)
            at = np.minimum(np.searchsorted(template, every), len(template) - 1)
            found, first = np.unique(at[template[at] == every], return_index=True)
            found = found[np.argsort(first)]  # the template's tokens in the order of their first places
            for own in np.unique(of_class[found]):
                order = template[found[of_class[found] == own]]
                sums[host, 0, int(own), xxhash.xxh3_64_intdigest(order.tobytes()) >> 1, ""] += 1
            headed, led = False, False
            for block, place in zip(blocks, every[places].tolist(), strict=True):
                heading = block.path.rpartition("/")[2].partition(".")[0] == "h1"
                headed |= heading and not block.aside
                if place in known or block.aside:
                    continue
                lead = headed and not heading and not led
                led |= lead
                for h, main, path in _around[block.path]:
                    if h in known:
                        sums[host, 1, h, main, path] += len(block.text)
                        if lead:
                            sums[host, 2, h, main, path] += 1
        if len(sums) >= HELD_TOKENS:
            yield _summed(sums)
            sums = Counter()
    if sums:
        yield _summed(sums)


def _summed(sums: Counter[tuple]) -> pa.RecordBatch:
    columns = [*zip(*sums, strict=True), sums.values()]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], ["host", "kind", "of", "mark", "path", "n"])


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, tokens, article) of pages (host, html): the hashes of the template's tokens, and the path of the element
    with the article, null where no element has more than half of the text; written."""
    found = classes(pages, min_pages)
    sums = _with_tokens(pages.select("host", "html"), found).select("host", "html", "tokens")
    sums = sums.mapInArrow(_orders_and_slots, "host string, kind int, of long, mark long, path string, n long")
    sums = written(sums.groupBy("host", "kind", "of", "mark", "path").agg(F.sum("n").alias("n")), "slots")
    orders = sums.where("kind = 0").groupBy("host", F.col("of").alias("class")).agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    mixed = orders.where(F.col("most") < F.col("all") * MIN_SHARE).select("host", "class")
    template = written(found.join(mixed, ["host", "class"], "left_anti"), "template")
    own = template.select("host", F.col("token").alias("of"))
    leads = sums.where("kind = 2").groupBy("host", "path").agg(F.sum("n").alias("lead"))
    slots = sums.where("kind = 1").join(own, ["host", "of"]).join(leads, ["host", "path"], "left").fillna(0, "lead")
    whole = slots.groupBy("host").agg(F.max("n").alias("whole"), F.max("lead").alias("leads"))
    depth = F.size(F.split("path", "/"))
    # The outermost element named as main comes first, else the innermost; of equal ones the last by path.
    rank = F.struct("mark", F.when(F.col("mark") == 1, -depth).otherwise(depth), "path")
    half = F.col("n") * 2 > F.col("whole")
    follows = (F.col("lead") * 2 > F.col("leads")) & (F.col("n") >= F.col("whole") * LEAD_SHARE) & ~half
    article = slots.join(whole, "host").groupBy("host").agg(
        F.max_by(F.when(half, F.struct("path", "mark", "lead", "leads")), F.when(half, rank)).alias("most"),
        F.max_by(F.when(follows, F.col("path")), F.when(follows, F.struct("n", -depth, "path"))).alias("after"),
    )
    elsewhere = (F.col("most.mark") == 0) & (F.col("most.lead") * 2 <= F.col("most.leads")) & F.col("after").isNotNull()
    article = article.select("host", F.when(elsewhere, F.col("after")).otherwise(F.col("most.path")).alias("article"))
    tokens = template.groupBy("host").agg(F.collect_list("token").alias("tokens"))
    return written(tokens.join(article, "host", "left"), "templates")


def main_text(page: str | None, template: frozenset[int] | set[int], article: str | None = None) -> str:
    """The article's text, a line for each block: the slots of the element `article`, or what names tell."""
    if not page:
        return ""
    blocks, _ = parse(page)
    free = [b for b in blocks if not b.aside]
    if article:
        inside = f"{article}/"
        slots = [b for b in free if _hash(_block_token(b)) not in template]
        kept = [b for b in slots if b.path == article or b.path.startswith(inside) or b.path.rpartition("/")[2].partition(".")[0] == "h1"]
        if any(b.path == article or b.path.startswith(inside) for b in kept):
            return "\n".join(b.text for b in kept)
    if any(b.main for b in free):
        free = [b for b in free if b.main]
    elif template:
        free = [b for b in free if not all(_hash(f"{b.path} {w}") in template for w in b.words)]
    return "\n".join(b.text for b in free)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of pages.

    A null or empty html has an empty text. Rows with a null URL form a host of their own. Repeated
    rows stay. Other columns are not read. A block that recurs in MIN_SHARE of a host's pages is its template, not its
    article, wherever it stands: what is the same on most pages is no page's own text. Hidden elements go. Hosts with fewer than min_pages pages, or with one page
    alone in any number of copies, have no template; names of elements and classes decide there.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(quoted(id_col).cast("long").alias("page_id"), quoted(url_col).alias("url"), quoted(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    joined = rows.join(templates(rows, min_pages), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, template = None, frozenset()
        for batch in batches:
            texts = []
            for host, page, tokens, article in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist(), strict=True):
                if host != last:
                    last, template = host, frozenset(tokens.as_py() or ())
                texts.append(main_text(page, template, article))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "html", "tokens", "article").mapInArrow(run, "page_id long, url string, text string, n_chars long")
