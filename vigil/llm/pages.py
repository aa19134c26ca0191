"""HTML extraction with a host's suffix array.

A page is parsed into blocks: runs of text between block-level tags, each with the region that it stands in (article,
navigation, header, footer, aside, advert, form, comments, plain body). The token streams of a host's pages are put end
to end, a suffix array with the lengths of common prefixes finds the substrings of LEAST tokens or more that recur on
distinct pages, and a page's tokens that such a substring covers are boilerplate.

What goes: regions that are not the article by their markup, wherever they stand. Where a page says which part is its
article (article or main element), blocks of it go only if they are covered by what the host as a whole repeats, and something is left: a
passage that its author shares with some others is still the page's text. The share of the host's pages that have it must be WIDE_SHARE
at least with a confidence of 97.5 % (the lower bound by Wilson), one rule for hosts of any size; where a class or id makes it likely that the
block is none of the article's, LIKELY_SHARE. Where a page says nothing, a block that is covered at all goes, and the unique runs of blocks stay.

Pages of a host are dealt into groups of about GROUP pages by a hash of id, url and html, so that a hot host is many groups; what
a site puts on its pages is on those of every group. A group's pages meet in one task: their tokens in
pieces of at most TOKENS tokens a suffix array, so that memory is bounded also for very long pages. Pages that name
their article still take part in the array: they show what the host repeats.

What recurs only between groups or pieces is found by hash, for pages of hosts that are more than one piece. Groups are
dealt into bins, whose pages are exchanged once, as compressed blocks, and read three times. First each bin gives the cells
that the hashes of all its substrings of LEAST tokens are in, a few bits each in ascending order, and learns by one bit
which of them another bin has too. Of the substrings in those it gives the whole hashes, with the number of
pages, and learns on how many of the host's pages each is; all others are in no other bin, so that they are counted there. What is on distinct pages
covers as the array's does. So neither limit changes what is covered, and cells decide only what is asked.

Nulls and the like: a null or empty html, and a page without text, gives an empty text. A null url is a host of its
own. Rows that repeat (same id) are one page for the array, which looks for distinct pages, and each returns a row; rows
without an id are pages of their own each. Unclosed tags, heads and quotes and cut-off pages are read as far as they go. Other columns play no part.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import byte_table, release, released, span_hashes, stored, word_bounds

LEAST, GROUP, TOKENS = 8, 64, 1 << 20
#: In an article goes what is on such a share of the host's pages, beyond doubt; and what its markup makes likely, on such a share.
WIDE_SHARE, LIKELY_SHARE = 0.7, 0.3
#: A page's tokens are at most so many for each character: a block of one word, `<p>a`, counts as LEAST words and its end.
DENSE = 3
#: Characters of html whose substrings' hashes meet in one bucket, about; cells for each character, eight of which make a substring or more.
BUCKET_CHARS, SPARE = 32 << 20, 32
#: Characters of html in a bin, about, and bins of small inputs.
BIN_CHARS, LEAST_BINS, LEAST_BIN_CHARS = 4 << 20, 128, 64 << 10
#: Up to so many hosts of more than GROUP pages their numbers of pages are broadcast; beyond, a join serves.
BROADCAST_HOSTS = 500_000

#: Fixed values of the HTML standard: elements whose content is never text, those without content, those that end a block.
_SILENT = {"script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CLOSES_P = _BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
_CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "search"}
#: Words of class and id, and roles, that name what is not the article.
_WORDS = (
    "ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|header|masthead|footer|sidebar|side|aside|widget|related|recommended|share|sharing|social|"
    "cookie|cookies|consent|gdpr|notice|notices|alert|alerts|popup|modal|overlay|subscribe|newsletter|signup|login|comment|comments|disqus|respond|reply|replies|pagination|pager|toc|copyright|legal|disclaimer|skip"
)
#: Those that an article's own parts are called as well.
_OWN_PARTS = {"header", "masthead", "side", "toc", "copyright", "legal", "disclaimer", "skip"}
_NAMES = re.compile(rf"(?:^|[^a-z])(?:{_WORDS})(?:[^a-z]|$)")
#: In an article, where headings and sections have names of their own, a whole name must say so: such a word, and what it is made of. A name that only has such a word in it makes it likely.
_WHOLE_NAME = re.compile(rf"(?:(?:site|page|global|top|bottom)[-_])?(?:{'|'.join(w for w in _WORDS.split('|') if w not in _OWN_PARTS)})(?:[-_]?(?:area|articles?|bar|block|box|buttons?|container|content|form|inner|items?|links?|list|panel|posts?|section|slot|unit|widget|wrap|wrapper|[0-9]+))*")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')(?=[\s/>]|\Z)|[^>])*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noscript")}
#: What may stand in a head.
_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
_HIDDEN = re.compile(r"display\s*:\s*none")


def blocks(source: str) -> list[tuple[str, bool, bool | None]]:
    """(text, whether it stands in an article or main element, whether its markup says that it is not the article, None where it makes that likely) of each block with text, in order."""
    out: list[tuple[str, bool, bool | None]] = []
    text: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, 1 if it opens an article, 1 if it opens what is none, 1 if it opens what may be none
    article = chrome = likely = 0

    def end_block() -> None:
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            if line:
                out.append((line, article > 0, True if chrome else None if likely else False))
            text.clear()

    def pop(to: int) -> None:
        nonlocal article, chrome, likely
        while len(stack) > to:
            tag, a, c, k = stack.pop()
            if tag in _BLOCK or c or k:
                end_block()
            article, chrome, likely = article - a, chrome - c, likely - k

    at, size = 0, len(source)
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            text.append(source[at:])
            break
        if lt > at:
            text.append(source[at:lt])
        m = _TOKEN.match(source, lt)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        at = max(m.end(), lt + 1)
        if not m["tag"]:
            if m[0].startswith("<![CDATA["):
                text.append(_html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if tag == "br":
                text.append(" ")
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in _BLOCK:
                        end_block()
                    pop(i)
                    break
            else:
                if tag in _BLOCK:
                    end_block()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if stack and stack[-1][0] == "head" and tag not in _HEAD:
            pop(len(stack) - 1)  # a head that was left open ends where the body begins
        if tag in _BLOCK:
            end_block()
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in _BLOCK:
                        break
            if stack and tag == stack[-1][0] and tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
                pop(len(stack) - 1)
        if tag in _VOID or m["attrs"].endswith("/"):
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(source, at)
            at = end.start() if end else size
            close = source.find(">", at)
            at = close + 1 if end and close >= 0 else size
            continue
        attrs = {a.lower(): _html.unescape(x or y or z or "") for a, x, y, z in _ATTR.findall(m["attrs"])} if m["attrs"].strip() else {}
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower() if attrs else ""
        is_article = tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")) is not None
        says = tag not in ("html", "body", "article", "main") and (any(map(_WHOLE_NAME.fullmatch, named.split())) if article else _NAMES.search(named) is not None)
        none = tag in _SILENT or tag in _CHROME or attrs.get("role") in _ROLES or hidden or says
        if tag == "header" and article and not says:
            none = False  # an article's own heading
        maybe = bool(article and named and not none and tag not in ("article", "main") and _NAMES.search(named))
        if (none and not chrome or maybe) and tag not in _BLOCK:
            end_block()
        stack.append((tag, int(is_article), int(none), int(maybe)))
        article, chrome, likely = article + is_article, chrome + none, likely + maybe
    end_block()
    return out


# ---- suffix arrays ----


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffixes of an array of integers in order, by doubling. depth: where no more than so many tokens of each are looked at, those that share them may be in any order."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while n > 1 and (depth is None or step < depth):
        second = np.full(n, -1, np.int64)
        second[:-step] = rank[step:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            break
    return order


def _distinct(x: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array is first."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])


def _covered(n: int, first: np.ndarray, least: int) -> np.ndarray:
    """Whether each of n tokens is in a substring of so many tokens that begins at one of first."""
    change = np.bincount(first, minlength=n + 1) - np.bincount(np.minimum(first + least, n), minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def recurring(tokens: np.ndarray, page: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(first tokens of the substrings of so many tokens, within one page, that occur on another page; on how many pages each does). A negative token ends what can repeat."""
    n = len(tokens)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_array(tokens, least)
    # what neighbours in the order have in common, up to `least`
    a, b = order[:-1], order[1:]
    same = np.ones(n - 1, bool)
    for k in range(least):
        x, y = np.minimum(a + k, n - 1), np.minimum(b + k, n - 1)
        same &= (a + k < n) & (b + k < n) & (tokens[x] == tokens[y]) & (tokens[x] >= 0) & (page[x] == page[a]) & (page[y] == page[b])
    # runs of suffixes that share `least` tokens; those with two pages or more recur
    run = np.concatenate([[0], np.cumsum(~same)])
    pair = np.sort(run * (int(page.max()) + 1) + page[order])
    pages = np.bincount(pair[_distinct(pair)] // (int(page.max()) + 1))[run]
    return order[pages > 1], pages[pages > 1]


def repeated(tokens: np.ndarray, page: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Whether each token is in a substring of at least so many tokens, within one page, that occurs on another page."""
    return _covered(len(tokens), recurring(tokens, page, least)[0], least)


def least_pages(pages: int, share: float) -> int:
    """On how many of so many pages something must be to be, with a confidence of 97.5 %, on such a share of all that the host might have (the least number with that lower bound by Wilson; one more than there are where none has it)."""
    z = 1.96 * 1.96
    # the bound grows with the number k: (k + z/2 - 1.96 sqrt(k (pages - k) / pages + z/4)) / (pages + z) >= share
    lo, hi = 1, pages + 1
    while lo < hi:
        k = (lo + hi) // 2
        if k + z / 2 - 1.96 * (k * (pages - k) / pages + z / 4) ** 0.5 >= share * (pages + z):
            hi = k
        else:
            lo = k + 1
    return max(2, lo)


_SEPARATORS = byte_table(b" \n")
_PAD = np.uint64(0x7E57AB1E0DDBA115)


def tokenised(pages: list[list[str]], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, whether it is the mark that ends a block, number of the block) of the blocks of pages, end to end. A block shorter than `least` words is padded, so that it repeats if the whole of it does."""
    lines = [b for p in pages for b in p]
    if not lines:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    data = np.frombuffer("\n".join(lines).encode("utf-8", "surrogatepass"), np.uint8)
    first, last, _ = word_bounds(data, np.array([0, len(data)]), _SEPARATORS)
    block = np.searchsorted(np.flatnonzero(data == 10), first)
    words = np.bincount(block, minlength=len(lines))
    sizes = np.maximum(words, least) + 1
    start = np.cumsum(sizes) - sizes
    tokens = np.full(int(sizes.sum()), _PAD, np.uint64)
    tokens[start[block] + np.arange(len(first)) - (np.cumsum(words) - words)[block]] = span_hashes(data, first, last, fold=False)
    ends = np.zeros(len(tokens), bool)
    ends[start + sizes - 1] = True
    return tokens, ends, np.repeat(np.arange(len(lines)), sizes)


def window_hashes(tokens: np.ndarray, ends: np.ndarray, salt: np.ndarray | int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(first tokens, hashes) of the substrings of `least` tokens without an end. salt: of all, or of each token; the hash of the same words and salt is the same anywhere."""
    n = len(tokens) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    before = np.concatenate([[0], np.cumsum(ends)])
    at = np.flatnonzero(before[least:] == before[:n])
    out = salt[at] if isinstance(salt, np.ndarray) else np.full(len(at), salt & (1 << 64) - 1, np.uint64)
    for k in range(least):
        out = (out ^ tokens[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return at, out


def page_windows(pages: list[list[str]], salts: list[int], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(place of the page, hash) of the substrings of `least` tokens of each page, in order of the pages."""
    tokens, ends, block = tokenised(pages, least)
    page_of_block = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    page = page_of_block[block] if len(block) else block
    at, h = window_hashes(tokens, ends, np.array(salts, np.int64).view(np.uint64)[page] if len(page) else 0, least)
    return page[at], h


def covered_blocks(pages: list[list[str]], ids: list[int], least: int = LEAST, known: tuple[np.ndarray, np.ndarray] | None = None, salt: int = 0, wide: tuple[int, ...] = (), modulus: int = 0) -> list[list[tuple[float, ...]]]:
    """Of each block of each page: the share of its tokens that recur on pages of other ids, and that recur on so many pages or more, for each number in `wide`. known: the hashes, under the salt and modulo the modulus, that recur on the whole host, sorted, and on how many pages; then `wide` is judged by these alone."""
    shares: list[list[tuple[float, ...]]] = [[] for _ in pages]
    at = 0
    while at < len(pages):
        end, n = at, 0
        while end < len(pages) and (end == at or n < TOKENS):
            n += sum(max(b.count(" ") + 1, least) + 1 for b in pages[end])
            end += 1
        some = pages[at:end]
        hashes, ends, block = tokenised(some, least)
        if len(hashes):
            tokens = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
            tokens[ends] = -1 - np.arange(int(ends.sum()))
            counts = [len(p) for p in some]
            page = np.repeat(np.array(ids[at:end], np.int64), counts)[block]
            first, many = recurring(tokens, page, least)
            hit = _covered(len(tokens), first, least)
            if known is not None and len(known[0]):
                where, h = window_hashes(hashes, ends, salt, least)
                h = h % np.uint64(modulus) if modulus else h
                order = np.argsort(h)  # in order, they find their places in one pass of the cache
                place = np.empty(len(h), np.int64)
                place[order] = np.minimum(np.searchsorted(known[0], h[order]), len(known[0]) - 1)
                same = known[0][place] == h
                hit |= _covered(len(tokens), where[same], least)
                first, many = where[same], known[1][place[same]]
            elif known is not None:
                first = first[:0]
                many = many[:0]
            broad = [_covered(len(tokens), first[many >= n], least) for n in wide]
            real = ~ends
            total = np.bincount(block[real])
            part = [np.bincount(block[real], weights=x[real]) / total for x in (hit, *broad)]
            both = list(zip(*(x.tolist() for x in part), strict=True))
            cuts = np.concatenate([[0], np.cumsum(counts)]).tolist()
            for p in range(at, end):
                shares[p] = both[cuts[p - at] : cuts[p - at + 1]]
        at = end
    return shares


def main_text(found: list[tuple[str, bool, bool | None]], shares: list[tuple[float, float, float]]) -> str:
    """The blocks that are the page's text, one a line. shares: of the blocks that markup doesn't rule out, in order: covered at all, on LIKELY_SHARE and on WIDE_SHARE of the host's pages."""
    left = [(text, inside, none is None, *share) for (text, inside, none), share in zip([b for b in found if not b[2]], shares, strict=True)]
    if any(inside for _, inside, *_ in left):
        whole = [(text, likely_share if likely else wide_share) for text, inside, likely, _, likely_share, wide_share in left if inside]
        own = [text for text, share in whole if share < 0.5]
        return "\n".join(own or [text for text, _ in whole])
    return "\n".join(text for text, _, _, share, *_ in left if share < 0.5)


def host(url):
    """The host of a url; '' of a null one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def coded(x: np.ndarray, bits: int) -> bytes:
    """Distinct numbers of so many bits in ascending order, each in about two bits more than the logarithm of their mean distance: low bits as they are, high bits as marks (Elias and Fano)."""
    n = len(x)
    low = max(0, bits - n.bit_length())
    marks = np.zeros(int(x[-1] >> np.uint64(low)) + n if n else 0, bool)
    marks[(x >> np.uint64(low)).astype(np.int64) + np.arange(n)] = True
    tail = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - low :]
    return n.to_bytes(4, "little") + np.packbits(marks).tobytes() + np.packbits(tail).tobytes()


def decoded(data: bytes, bits: int) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    low = max(0, bits - n.bit_length())
    cut = len(data) - -(-n * low // 8)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data[4:cut], np.uint8)))[:n] - np.arange(n)
    out = np.zeros((n, 64), np.uint8)
    out[:, 64 - low :] = np.unpackbits(np.frombuffer(data[cut:], np.uint8), count=n * low).reshape(n, low)
    return np.packbits(out, axis=1).view(">u8").ravel().astype(np.uint64) | high.astype(np.uint64) << np.uint64(low)


def _counts(x: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs; the first says how many."""
    width = 1 if x.max(initial=0) < 1 << 8 else 4
    return bytes([width]) + np.minimum(x, 0xFFFFFFFF).astype(f"<u{width}").tobytes()


def _counted(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], f"<u{data[0]}").astype(np.int64)


def _squeezed(batches):
    """The same rows with the blocks that markup doesn't rule out, compressed, in the place of html: they are what the exchange carries. Before them their length and the number of all blocks."""
    codec = pa.Codec("zstd")
    for batch in batches:
        out = []
        for source in batch.column("html").to_pylist():
            found = blocks(source or "")
            lines = "\n".join(f"{2 * inside + (none is None)}{t}" for t, inside, none in found if not none).encode("utf-8", "surrogatepass")
            out.append(len(lines).to_bytes(4, "little") + len(found).to_bytes(4, "little") + (codec.compress(lines, asbytes=True) if lines else b""))
        columns = {c: batch.column(c) for c in batch.schema.names if c != "html"}
        yield pa.RecordBatch.from_pydict(columns | {"blocks": pa.array(out, pa.binary())})


def _unsqueezed(data: bytes, codec) -> list[tuple[str, bool, bool | None]]:
    n = int.from_bytes(data[:4], "little")
    lines = codec.decompress(data[8:], n, asbytes=True).decode("utf-8", "surrogatepass").split("\n") if n else []
    return [(x[1:], x[0] > "1", None if x[0] in "13" else False) for x in lines]


class Deal:
    """How the hashes of substrings are dealt: over buckets; `bits` beside the bucket tell them apart, the first `cell` of those say where one may have met another."""

    def __init__(self, chars: int):
        self.buckets = max(1, -(-chars // BUCKET_CHARS))
        self.bits = min(48, 64 - self.buckets.bit_length())
        self.modulus = self.buckets << self.bits
        self.cell = min(self.bits, max(10, (SPARE * chars // (8 * self.buckets)).bit_length()))

    def sorted_keys(self, h: np.ndarray) -> np.ndarray:
        """Hashes modulo the modulus to keys that ascend by bucket, then by what tells them apart."""
        return h % np.uint64(self.buckets) << np.uint64(self.bits) | h // np.uint64(self.buckets)

    def hashes(self, key: np.ndarray) -> np.ndarray:
        return (key & np.uint64((1 << self.bits) - 1)) * np.uint64(self.buckets) + (key >> np.uint64(self.bits))

    def cells(self, key: np.ndarray) -> np.ndarray:
        return key >> np.uint64(self.bits - self.cell)

    def runs(self, x: np.ndarray, bits: int):
        """(bucket, first, last, numbers beside the bucket) of sorted keys or cells."""
        bucket = x >> np.uint64(bits)
        first = _distinct(bucket)
        for a, b in zip(first.tolist(), np.append(first, len(x))[1:].tolist(), strict=True):
            yield int(bucket[a]), a, b, x[a:b] & np.uint64((1 << bits) - 1)


class Bin:
    """The pages of a bin, and the substrings of those whose host is of several groups or pieces."""

    def __init__(self, data: pa.Table, deal: Deal):
        codec = pa.Codec("zstd")
        self.deal, self.blocks = deal, [_unsqueezed(b, codec) for b in data.column("blocks").to_pylist()]
        self.texts = [[t for t, *_ in found] for found in self.blocks]
        large = [i for i, m in enumerate(data.column("m").to_pylist()) if m is not None]
        salts, page = data.column("s").to_pylist(), data.column("page").to_pylist()
        place, h = page_windows([self.texts[i] for i in large], [salts[i] for i in large])
        key = deal.sorted_keys(h % np.uint64(deal.modulus))
        order = np.argsort(key)
        self.key, place = key[order], place[order]
        # a row whose id is its own is a page of its own: a number that no other row has
        self.shared = np.array([page[i] is not None for i in large], bool)[place]
        self.page = np.array([page[i] if page[i] is not None else n for n, i in enumerate(large)], np.int64)[place]
        cells = deal.cells(self.key)
        self.first = _distinct(cells)
        self.cells = cells[self.first]

    def asked(self, back: pa.Table) -> None:
        """Which cells other bins have too, as those of _met_cells say."""
        met = np.zeros(len(self.cells), bool)
        bits = dict(zip(back.column("bucket").to_pylist(), back.column("bits").to_pylist(), strict=True))
        for k, a, b, _ in self.deal.runs(self.cells, self.deal.cell):
            if k in bits:
                met[a:b] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a)
        self.bits = {k: bits[k] for k, a, b, _ in self.deal.runs(self.cells, self.deal.cell) if met[a:b].any()}
        self.met = np.repeat(met, np.diff(np.append(self.first, len(self.key))))

    def pages_of(self, which: np.ndarray):
        """(the distinct ones of some substrings in order, on how many pages whose id is their own each is; place among them and page of those on pages whose id may come again)."""
        key, page, shared = self.key[which], self.page[which], self.shared[which]
        order = np.lexsort((page, shared, key))
        key, page, shared = key[order], page[order], shared[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (page[1:] != page[:-1]) | (shared[1:] != shared[:-1])])[: len(key)]
        key, page, shared = key[new], page[new], shared[new]
        first = _distinct(key)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        return key[first], np.bincount(of, weights=~shared, minlength=len(first)).astype(np.int64), of[shared], page[shared]


def _cells(deal: Deal):
    """From a bin to the cells of its substrings, by bucket."""

    def cells(key, data):
        runs = [(k, coded(x, deal.cell)) for k, _, _, x in deal.runs(Bin(data, deal).cells, deal.cell)]
        return pa.table({"bucket": pa.array([k for k, _ in runs], pa.int32()), "r": pa.array([key[0].as_py()] * len(runs), pa.int32()), "cells": pa.array([x for _, x in runs], pa.binary())})

    return cells


def _met_cells(deal: Deal):
    """From the cells of all bins in a bucket to a bit for each: whether another bin has it."""

    def met(key, data):
        parts = [decoded(x, deal.cell) for x in data.column("cells").to_pylist()]
        cells = np.sort(np.concatenate(parts))
        twice = cells[1:][cells[1:] == cells[:-1]]
        bits = []
        for x in parts:
            at = np.minimum(np.searchsorted(twice, x), max(0, len(twice) - 1))
            bits.append(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), bool)).tobytes())
        return pa.table({"r": data.column("r"), "bucket": pa.array([key[0].as_py()] * len(bits), pa.int32()), "bits": pa.array(bits, pa.binary())})

    return met


def _candidates(deal: Deal):
    """From a bin, and which of its cells are met, to the hashes of the substrings there, on how many pages each is, and the pages whose id may be in another bin."""

    def candidates(key, data, back):
        rows = {c: [] for c in ("bucket", "r", "bits", "h", "own", "place", "page")}
        if len(back):
            here = Bin(data, deal)
            here.asked(back)
            h, own, place, page = here.pages_of(here.met)
            for k, a, b, x in deal.runs(h, deal.bits):
                i, j = np.searchsorted(place, [a, b])
                made = (k, key[0].as_py(), here.bits[k], coded(x, deal.bits), _counts(own[a:b]), (place[i:j] - a).astype("<u4").tobytes() or None, page[i:j].astype("<i8").tobytes() or None)
                for c, v in zip(rows, made, strict=True):
                    rows[c].append(v)
        return pa.table({c: pa.array(v, pa.int32() if c in ("bucket", "r") else pa.binary()) for c, v in rows.items()})

    return candidates


def _met(deal: Deal):
    """From the hashes of all bins in a bucket to the number of distinct pages of each, in the order in which its bin gave them."""

    def met(key, data):
        parts = [decoded(x, deal.bits) for x in data.column("h").to_pylist()]
        every = np.concatenate(parts)
        h, of = np.unique(every, return_inverse=True)
        many = np.bincount(of, weights=np.concatenate([_counted(x) for x in data.column("own").to_pylist()]), minlength=len(h)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).tolist()
        pairs = [(of[a + np.frombuffer(i, "<u4")], np.frombuffer(p, "<i8")) for a, i, p in zip(cuts[:-1], data.column("place").to_pylist(), data.column("page").to_pylist(), strict=True) if i is not None]
        if pairs:
            at, page = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.lexsort((page, at))
            at, page = at[order], page[order]
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (page[1:] != page[:-1])])
            many += np.bincount(at[new], minlength=len(h))
        totals = [_counts(many[of[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"r": data.column("r"), "bucket": pa.array([key[0].as_py()] * len(parts), pa.int32()), "bits": data.column("bits"), "pages": pa.array(totals, pa.binary())})

    return met


def _known(here: Bin, back: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a bin's substrings that are on distinct pages of their host, sorted, and on how many."""
    here.asked(back)
    h, *_ = here.pages_of(here.met)
    totals = dict(zip(back.column("bucket").to_pylist(), back.column("pages").to_pylist(), strict=True))
    many = np.concatenate([np.zeros(0, np.int64), *(_counted(totals[k]) for k, *_ in here.deal.runs(h, here.deal.bits))])
    # those whose cell no other bin has are all here; of interest are those that come twice
    same = here.key[1:] == here.key[:-1]
    several = np.zeros(len(here.key), bool)
    several[1:] |= same
    several[:-1] |= same
    local, own, place, _ = here.pages_of(~here.met & several)
    h, many = np.concatenate([h, local]), np.concatenate([many, own + np.bincount(place, minlength=len(local))])
    h, many = here.deal.hashes(h[many > 1]), many[many > 1]
    order = np.argsort(h)
    return h[order], many[order]


def _texts(deal: Deal):
    """From a bin, and what was met of it, to its rows with their texts."""

    def texts(key, data, back):
        here = Bin(data, deal)
        known = _known(here, back)
        given = data.column("page_id").to_pylist()
        ids = [i if i is not None else ("", n) for n, i in enumerate(given)]
        salts, sizes = data.column("s").to_pylist(), data.column("m").to_pylist()
        shares: list = [[] for _ in ids]
        groups: dict[tuple[int, int], list[int]] = {}
        for i, g in enumerate(zip(salts, data.column("k").to_pylist(), strict=True)):
            groups.setdefault(g, []).append(i)
        for members in groups.values():
            numbers = {x: n for n, x in enumerate(dict.fromkeys(ids[i] for i in members))}
            m = sizes[members[0]]
            of_host = known if m is not None else None  # a host of several groups or pieces: what recurs on it has been told
            m = m or len(numbers)
            wide = (least_pages(m, LIKELY_SHARE), least_pages(m, WIDE_SHARE))
            for i, s in zip(members, covered_blocks([here.texts[i] for i in members], [numbers[ids[i]] for i in members], LEAST, of_host, salts[members[0]], wide, deal.modulus if of_host else 0), strict=True):
                shares[i] = s
        found = [main_text(f, s) for f, s in zip(here.blocks, shares, strict=True)]
        n_blocks = [int.from_bytes(b[4:8], "little") for b in data.column("blocks").to_pylist()]
        release()
        return pa.table({
            "page_id": data.column("page_id"), "url": data.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64()),
            "n_blocks": pa.array(n_blocks, pa.int64()), "n_repeated": pa.array([sum(x[0] >= 0.5 for x in s) for s in shares], pa.int64()),
        })

    return texts


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, host, n_blocks, n_repeated (blocks that recur on the host's pages) of each row of pages."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    # a page is told by its id (a row without one is a page of its own), and dealt by all that it holds, so that an id of many rows is no group
    rows = rows.withColumn("page", F.xxhash64(F.col("page_id").cast("string")))
    dealing = F.xxhash64("page_id", "url", "html")
    counts = rows.groupBy("host").agg(F.count("*").alias("m"), (F.count_distinct(F.when(F.col("page_id").isNotNull(), F.col("page"))) + F.count_if(F.col("page_id").isNull())).alias("distinct"), F.sum(F.coalesce(F.length("html"), F.lit(0))).alias("size"))
    # the hosts of more than one group or piece: at most one for each GROUP rows, or TOKENS / DENSE characters
    # `m` rows make the groups; `distinct` pages are what shares are of
    read = Observation()
    small = stored(counts.observe(read, F.sum("size").alias("size")).where((F.col("m") > GROUP) | ((F.col("m") > 1) & (F.col("size") * DENSE > TOKENS))), "pages-hosts")
    deal, chars = Deal(small.agg(F.sum("size")).first()[0] or 0), read.get["size"] or 0
    bins = max(1, -(-chars // BIN_CHARS), min(LEAST_BINS, chars // LEAST_BIN_CHARS))
    small = F.broadcast(small) if small.count() <= BROADCAST_HOSTS else small
    large = rows.select("page_id", "page", "host").join(small, "host")
    again = large.where("page_id is not null").groupBy("page").agg(F.count("*").alias("c")).where("c > 1").select("page", F.lit(True).alias("many"))
    again = stored(again, "pages-again")  # ids of several rows: none, as a rule
    again = F.broadcast(again) if again.count() <= BROADCAST_HOSTS else again
    form = f"page_id {kind}, url string, host string, page long, deal long, blocks binary"
    squeezed = rows.withColumn("deal", dealing).mapInArrow(released(_squeezed), form)
    told = squeezed.join(small.withColumnRenamed("size", "host_size"), "host", "left").join(again, "page", "left")
    key = F.pmod("deal", F.coalesce(F.ceil(F.col("m") / GROUP), F.lit(1)))
    told = told.select("page_id", "url", "blocks", F.xxhash64("host").alias("s"), key.cast("int").alias("k"), F.when(F.col("many") & F.col("m").isNotNull(), F.col("page")).alias("page"), F.col("distinct").alias("m"))
    # bins are exchanged once; the three steps below read that exchange
    dealt = told.withColumn("r", F.pmod(F.xxhash64("s", "k"), F.lit(bins)).cast("int")).repartition("r")
    cells = dealt.groupBy("r").applyInArrow(_cells(deal), "bucket int, r int, cells binary")
    met = cells.groupBy("bucket").applyInArrow(_met_cells(deal), "r int, bucket int, bits binary")
    asked = dealt.groupBy("r").cogroup(met.groupBy("r")).applyInArrow(_candidates(deal), "bucket int, r int, bits binary, h binary, own binary, place binary, page binary")
    known = asked.groupBy("bucket").applyInArrow(_met(deal), "r int, bucket int, bits binary, pages binary")
    form = f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_repeated long"
    out = dealt.groupBy("r").cogroup(known.groupBy("r")).applyInArrow(_texts(deal), form)
    return out.select("page_id", "url", "text", "n_chars", host(F.col("url")).alias("host"), "n_blocks", "n_repeated")
