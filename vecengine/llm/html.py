"""Main text of web pages by equivalence classes of template tokens.

The tokens of a page are its containers, each told apart by its path from the root, and its text
blocks, each told apart by its path and its words.  Over the distinct pages of a host a token has
an occurrence vector (how often it is in each page); tokens with equal vectors make up an
equivalence class.  A class is valid if its tokens come in one order in all pages; its members nest
by their paths in those of other classes, down from the class of the root, and make up the host's
template.  Text that belongs to the template is left out.  The text right under each container is a
slot; of the template's subtrees those that hold the main text are found by the text in them over
all pages and by what their tags and names tell, and their slots are extracted from each page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .substring import DOC_BITS, _has, _id_bits, _mixed

# HTML's elements by their part in a page.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot
    th thead tr ul""".split()
)
CONTAINERS = frozenset(
    "address article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu nav ol section table td ul".split()
)
NO_TEXT = frozenset("script style noscript template iframe object svg math canvas audio video title textarea select button head".split())
OUTSIDE = frozenset("nav footer aside form menu dialog header".split())
MAIN = frozenset("article main".split())
#: Words of a class, id or role that tell parts beside the main text.
BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|promo|sponsor(?:ed)?|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|header|masthead|comments?|reply|replies|respond|disqus|cookies?|notice|consent|gdpr|popup|modal|overlay|newsletter|"
    r"subscribe|signup|login|search|social|share|sharing|related|recommend(?:ed|ations)?|teaser|pagination|pager|widget|toolbar|"
    r"complementary|contentinfo|alert|disclaimer)(?:$|[\s_-])",
    re.I,
)
_RAW = frozenset("script style noscript template iframe object svg math canvas audio video title textarea select button".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}


#: Containers without a name are told apart by their number among their siblings of one tag, up to so many.
NUMBERED = 8


class Slot:
    """A container that is open: the one that it is in, its token's key, the part of the page that it is in, and what came before it."""

    __slots__ = ("above", "name", "key", "place", "before", "youngest", "numbers")

    def __init__(self, name: str, named: str, above: Slot | None):
        self.name, self.above, self.before = name, above, 0
        self.youngest, self.numbers = 0, {}
        part = f"{name}.{named}"
        if above:
            self.before = above.youngest
            if not named:
                nth = above.numbers[name] = min(NUMBERED, above.numbers.get(name, 0) + 1)
                part = f"{name}:{nth}"
        self.key = xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"), above.key if above else 0)
        if above:
            above.youngest = self.key
        if above and above.place == "beside" or name in NO_TEXT or name in OUTSIDE or (named and name not in ("html", "body") and name not in MAIN and BESIDE.search(named)):
            self.place = "beside"
        elif above and above.place == "main" or name in MAIN or "articlebody" in named or " main " in f" {named} ":
            self.place = "main"
        else:
            self.place = "open"


def slots(page: str, opened: list[Slot] | None = None) -> Iterator[tuple[Slot, str, int]]:
    """The text blocks of a page in order: the container that each is right in, its text, and how much of it is links.

    ``opened`` gets each container as it opens.  A container's key is made from its parent's and
    its tag name with class, id and role, lower case.  White space inside a block is one space; a
    block starts and ends with a block-level tag.  Character references are decoded.  Scripts,
    styles and the like, comments and markup are left out; a tag that is never closed ends with
    its container, and a paragraph ends where another block begins.  The work is linear in the
    page's length, however deep its containers nest.
    """
    root = Slot("html", "", None)
    stack = [root]
    counts: dict[str, int] = {}
    text: list[str] = []
    links = in_link = at = 0
    if opened is not None:
        opened.append(root)

    def flush() -> Iterator[tuple[Slot, str, int]]:
        nonlocal links
        block = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if block:
            yield stack[-1], block, min(links, len(block))
        links = 0

    def say(piece: str) -> None:
        nonlocal links
        text.append(piece)
        if in_link:
            links += len(piece)

    def enter(name: str, named: str) -> None:
        if name == "html" and not named and len(stack) == 1:
            return  # the root itself
        new = Slot(name, named, stack[-1])
        stack.append(new)
        counts[name] = counts.get(name, 0) + 1
        if opened is not None:
            opened.append(new)

    def leave() -> str:
        name = stack.pop().name
        counts[name] -= 1
        return name

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, told = name.lower(), bool(m[1] or m[4]), m[3] if m[2] else m[6]
        if name == "br":
            text.append(" ")
            continue
        if name in _RAW and not closing:
            if not told.endswith("/"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else size
            text.append(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name not in BLOCKS:
            # an inline part may be beside the text, too
            if not closing and told and (named := _names(told)) and BESIDE.search(named) and not told.endswith("/"):
                yield from flush()
                enter(name, named)
            elif closing and len(stack) > 1 and stack[-1].name == name:
                yield from flush()
                leave()
            continue
        yield from flush()
        in_link = 0
        while len(stack) > 1 and stack[-1].name == "p" and (not closing or name != "p"):
            leave()
        if closing:
            if counts.get(name):
                while leave() != name:
                    pass
        elif not told.endswith("/"):
            named = _names(told)
            if name in CONTAINERS or name == "head" or (named and BESIDE.search(named)):
                enter(name, named)
    yield from flush()


def _names(attributes: str) -> str:
    return " ".join(re.sub(r"\d+", "#", (a or b or c).lower()) for _, a, b, c in _NAMED.findall(attributes)) if attributes else ""


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


_WRAP = (1 << 64) - 1
_SIGNED = lambda x: (x & _WRAP) - (1 << 64) if x & (1 << 63) else x & _WRAP
#: A token is in a template if it is in this share of a host's distinct pages at least, so a template's size is bounded
#: by that of a page over this share; a text block is template text from the second share and number of pages on (twice
#: the number where it is marked as main text).
SHARE, TEXT_SHARE, TEXT_PAGES = 0.01, 0.8, 4
#: A host's subtrees that are marked as main are the main text if they hold that share of its open text; else the
#: subtree is narrowed as long as one container holds that share of it.
MARKED, NARROWED = 0.2, 0.9
PLACES = ("open", "main", "beside")
_TOKENS = "host string, token long, parent long, place int, block boolean, pages long, vector long, chars long, links long, lo long, hi long"


def block_key(slot: Slot, text: str) -> int:
    """The key of the token that a text block is."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), slot.key ^ 0x5BD1E995)


def page_tokens(page: str) -> dict[int, list]:
    """Each token of a page: parent, place, whether it is a text block, how often it is there, characters, of them links, what came before it first."""
    opened: list[Slot] = []
    blocks = list(slots(page, opened))
    own: dict[int, list] = {}
    for s in opened:
        own.setdefault(s.key, [s.above.key if s.above else 0, PLACES.index(s.place), False, 0, 0, 0, s.before])[3] += 1
    for s, text, links in blocks:
        told = own[s.key]
        told[4] += len(text)
        told[5] += links
        own.setdefault(block_key(s, text), [s.key, told[1], True, 0, len(text), links, 0])[3] += 1
    return own


def tokens(pages: DataFrame) -> DataFrame:
    """``(host, token, ...)``: each token's figures over the pages of a host, its occurrence vector as a sum of hashes.

    ``pages`` has ``(page_id, text, url)``.  The sums are made a batch at a time before they are
    shuffled, so a host of many pages is a row a batch and token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], list] = {}
            for page, url in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                host, page_hash = _host(url), xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass"))
                for key, (parent, place, block, n, chars, links, before) in page_tokens(page or "").items():
                    f = found.setdefault((host, key), [_SIGNED(parent), place, block, 0, 0, 0, 0, 1 << 62, -(1 << 62)])
                    f[3] += 1
                    f[4] = (f[4] + xxhash.xxh64_intdigest(page_hash.to_bytes(8, "little"), seed=n)) & _WRAP
                    f[5:7] = f[5] + chars, f[6] + links
                    f[7], f[8] = min(f[7], before >> 2), max(f[8], before >> 2)
            columns = [[h for h, _ in found], [_SIGNED(k) for _, k in found], *map(list, zip(*found.values(), strict=True))] if found else [[] for _ in range(11)]
            columns[6] = [_SIGNED(v) for v in columns[6]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _TOKENS.split(", ")])

    sums = pages.mapInArrow(run, _TOKENS).withColumn("vector", F.col("vector").cast("decimal(38,0)"))
    once = [F.first(c).alias(c) for c in ("parent", "place", "block")]
    told = sums.groupBy("host", "token").agg(*once, *[F.sum(c).alias(c) for c in ("pages", "vector", "chars", "links")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return told.withColumn("vector", F.expr("pmod(vector, 18446744073709551616BD)").cast("string"))


def main_slots(own: dict[int, list]) -> set[int]:
    """The keys of the containers whose text is main text, of a tree ``{token: (parent, place, chars, links)}``.

    Text beside the main text counts for nothing.  Subtrees that are marked as main are chosen if
    they hold a fair share of the rest.  Otherwise the tree is narrowed from the root to the
    smallest container that holds nearly all text that is not links, and what is mostly links is
    left out.
    """
    below: dict[int, list[int]] = {}
    for key, (parent, *_) in own.items():
        below.setdefault(parent if parent in own and parent != key else 0, []).append(key)
    order, todo = [], list(below.get(0, ()))
    while todo:
        key = todo.pop()
        order.append(key)
        todo += below.get(key, ())
    plain = {k: max(0, own[k][2] - own[k][3]) if own[k][1] != 2 else 0 for k in order}
    mass = dict(plain)
    for key in reversed(order):
        if own[key][0] in mass and own[key][0] != key:
            mass[own[key][0]] += mass[key]
    marked = {k for k in order if own[k][1] == 1}
    if marked and sum(plain[k] for k in marked) >= MARKED * sum(plain.values()):
        return marked
    current, todo = 0, below.get(0, [])
    total = sum(mass[k] for k in todo)
    while todo and total:
        best = max(todo, key=lambda k: (mass[k], k))
        if mass[best] < NARROWED * total:
            break
        current, todo = best, below.get(best, [])
    todo, kept = [current] if current else list(todo), set()
    while todo:
        key = todo.pop()
        if own[key][1] != 2 and own[key][3] * 2 <= own[key][2]:
            kept.add(key)
        todo += below.get(key, ())
    return kept


def template(told: DataFrame) -> DataFrame:
    """``(host, mains, others, texts)``: of each host, the containers that hold the main text, those that do not, and the text blocks of its template.

    A class is the tokens of one host with equal vectors; it is valid if some of its containers
    come in one order in all pages.  Classes nest by their containers' parents; a container whose
    parents are not all in the template is not in it.  Only tokens in a fair share of the host's pages are looked at, so the
    rows of a host are bounded by the size of a page.
    """
    root = _SIGNED(Slot("html", "", None).key)
    whole = told.where(F.col("token") == root).select("host", F.col("pages").alias("all"))
    common = told.join(whole, "host").where((F.col("pages") >= SHARE * F.col("all")) & (~F.col("block") | (F.col("pages") >= TEXT_SHARE * F.col("all"))))
    size = common.where("NOT block AND lo = hi").groupBy("host", "vector").agg(F.count("*").alias("members"))
    classed = common.join(size, ["host", "vector"], "left").select("host", "token", "parent", "place", "block", "pages", "chars", "links", F.coalesce("members", F.lit(0)).alias("members"))

    def judge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = {r["token"]: (r["parent"], r["place"], r["chars"], r["links"]) for r in rows if not r["block"] and r["members"] > 0}
        nested: dict[int, bool] = {root: True}

        def is_nested(key: int) -> bool:
            path = []
            while key not in nested:
                path.append(key)
                key = own[key][0] if key in own else 0
                if key == 0 or len(path) > len(own):
                    nested[key] = False
            for k in path:
                nested[k] = nested[key]
            return nested[key]

        own = {k: v for k, v in own.items() if is_nested(k)}
        texts = [r["token"] for r in rows if r["block"] and r["parent"] in own and r["pages"] >= TEXT_PAGES * (1 + (r["place"] == 1))]
        less = {r["parent"]: (r["chars"], r["links"]) for r in rows if r["block"] and r["token"] in set(texts)}
        own = {k: (p, at, c - less.get(k, (0, 0))[0], n - less.get(k, (0, 0))[1]) for k, (p, at, c, n) in own.items()}
        kind = pa.list_(pa.int64())
        mains = main_slots(own)
        lists = {"mains": mains, "others": own.keys() - mains, "texts": texts}
        return pa.table({"host": pa.array([rows[0]["host"]], pa.string())} | {k: pa.array([sorted(v)], kind) for k, v in lists.items()})

    return classed.groupBy("host").applyInArrow(judge, "host string, mains array<long>, others array<long>, texts array<long>")


def extract(page: str, mains: set[int], others: set[int], texts: set[int]) -> str:
    """The blocks of a page in its template's main slots, without template text.

    A container that is not in the template belongs to the slot that it is in.  A page that has no
    text in main slots is judged by its own tree.
    """
    opened: list[Slot] = []
    blocks = [(s, text) for s, text, _ in slots(page, opened) if not texts or _SIGNED(block_key(s, text)) not in texts]
    role: dict[Slot | None, bool] = {None: False}
    for s in opened:  # each one after that which it is in
        key = _SIGNED(s.key)
        role[s] = s.place != "beside" and (key in mains or (key not in others and role[s.above]))
    kept = [text for s, text in blocks if role[s]]
    if not kept and blocks:
        own = {k: (p, place, chars, links) for k, (p, place, block, _, chars, links, _) in page_tokens(page).items() if not block}
        chosen = main_slots(own)
        kept = [text for s, text in blocks if s.key in chosen]
    return "\n".join(kept)


def _distinct(hashed: DataFrame) -> list[DataFrame]:
    """Tables of ``(page_id, text, url)`` that have each host's pages of equal 128-bit hashes once.

    A filter of fixed size holds the hashes that are there more than once.  Pages that are not in
    it are the first table as they are; those that are in it (with some that are there by chance, all
    of them where the filter is full) are told apart exactly, with one row left of each before the shuffle.
    """
    again = hashed.groupBy("host", "h0", "h1").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h0").alias("doc_id"))
    held = hashed.sparkSession.sparkContext.broadcast(_id_bits(again, DOC_BITS))

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.frombuffer(held.value, np.uint8)
            for batch in batches:
                found = _has(bits, _mixed(batch.column(4).to_numpy().view(np.uint64)) >> np.uint64(64 - DOC_BITS))
                yield batch.filter(pa.array(found if inside else ~found))

        return hashed.mapInArrow(run, hashed.schema)

    return [df.select("page_id", "text", "url") for df in (part(False), part(True).dropDuplicates(["host", "h0", "h1"]))]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row: the blocks of its main slots, joined by line breaks.

    A page without text in its host's main slots is judged by itself.  Null html is an empty page
    with an empty text; pages without a host (null or odd urls) share one template; repeated rows
    stay, and pages of equal html count once for the template.  An empty table gives an empty
    result.  Other columns do not matter.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("text"), F.col(url_col).alias("url"))
    where = F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    hashed = source.where("page_id IS NOT NULL").select("page_id", "text", "url", where.alias("host"), *[F.xxhash64(F.coalesce("text", F.lit("")), F.lit(i)).alias(f"h{i}") for i in (0, 1)])
    distinct = _distinct(hashed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            hosts = [_host(u) for u in batch.column(2).to_pylist()]
            packed = [press((p or "").encode("utf-8", "surrogatepass")) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(hosts, pa.string()), pa.array(packed, pa.binary())], ["page_id", "url", "host", "packed"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True)
            texts = [extract(plain(p).decode("utf-8", "surrogatepass"), *(set(x or ()) for x in lists)) for p, *lists in rows]
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    told = stored(tokens(distinct[0].unionByName(distinct[1])), "html-tokens")
    hosts = stored(template(told), "html-templates")
    discard(told)
    joined = source.mapInArrow(pack, "page_id long, url string, host string, packed binary").join(hosts, "host", "left")
    return joined.select("page_id", "url", "packed", "mains", "others", "texts").mapInArrow(pick, "page_id long, url string, text string, n_chars long")
