"""Operator 4, main text of web pages: a suffix array over each host's pages, with block structure as support.

A page is cut into blocks by its block elements. Blocks inside navigation, headers, footers, asides, forms,
scripts, adverts, notices, comments and the like (by element, role, class or id) are boilerplate; blocks inside an
article or main element are the page's text; of a page without one, blocks inside elements whose class or id says content
are. What is in neither is open, and what bears a doubtful name within an article is doubtful: there repetition decides.

The token streams of a host's pages are concatenated, and of their suffixes those are kept that begin a block, end one
with their first WINDOW tokens, or have the least hash of GAP neighbours: by content alone, so that equal runs keep equal
suffixes wherever they stand, and no run of WINDOW + GAP - 1 tokens is without one (a sparse suffix array). They are sorted by
host and first WINDOW tokens, by hash ranges over all pages of the table, and those on LEAST or more distinct pages of their host are
repeated. Tokens of open blocks that repeated suffixes cover are removed and the unique runs kept; a doubtful block
goes if they cover half of it. Blocks of an article are kept whole even if other pages repeat them: copies and quoted
passages are text, as they would be lost if repetition alone decided (the README has figures).

Pages are read in chunks of about CHUNK bytes of text. A chunk's hashes, each once with its count of pages, go to the hash ranges; what
is repeated comes back to the chunk. No task holds a host, and results don't depend on chunks or on the number of pages.

Character references are decoded, white space within a block becomes one space, blocks are joined by one newline. Null html and pages
without text give an empty string. Broken markup: unclosed elements end with their parent, a cut tag or comment ends the page.
Repeated rows are each returned and count as one page; rows without an id are a page each. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import pickle
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .shingles import C, mix, word_hashes
from .url_filter import parts

#: Tokens of a window, suffixes of which one at least is kept, distinct pages that make a run repeated.
WINDOW, GAP, LEAST = 8, 8, 3
#: Text bytes and pages of a chunk, pages whose hashes a range holds.
CHUNK, MOST_PAGES, PAGES_A_RANGE = 4 << 20, 4096, 4000

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*'|["'](?=[^"']*>))*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
#: Content of these is no markup.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split())
SPACED = {"br", "td", "th"}
OFF = set("nav footer aside form script style noscript template iframe object svg canvas button select dialog head menu fieldset audio video map textarea title".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form", "note"}
#: Words that name boilerplate in a class or id, alone or beside general words; beside others (as in related-work) within an article they are doubtful, elsewhere they still do.
HARD = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dropdown footer gdpr "
    "login masthead menu menubar modal nav navbar navigation newsletter overlay pager pagination popup promo promotion recommended related sharing sidebar sidenav signup social "
    "sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that name boilerplate alone or beside general words (as in share-buttons), but may name text beside others (share-price).
SOFT = set("copyright disclaimer form header hidden notice notices notification reply respond response responses search share skip tags toc".split())
GENERAL = set("area bar block body bottom box button buttons col column container content field group icon icons inner item items left line link links list main outer page panel right row section site text title top wrap wrapper".split())
#: More words that only say what kind of boilerplate it is.
BESIDE = set("articles count feed media network now posts slot stories unit us".split())
MAIN = {"article", "main"}
#: Words that, alone or beside general words, name the content of a page without an article or main element.
CONTENT = {"article", "content", "entry", "main", "post", "story"}
WORD = re.compile(r"[a-z]+")

DROP, OPEN, TEXT, MAYBE, DOUBT, NAMED = 0, 1, 2, 3, 4, 5


def named_kind(token: str, main: bool) -> int | None:
    """What one class or id says: DROP, DOUBT, NAMED (doubtful in an article, else DROP), MAYBE, or nothing."""
    words = WORD.findall(token)
    if HARD.intersection(words[:1] if main else words):
        return DROP if (HARD | SOFT | GENERAL | BESIDE).issuperset(words) else NAMED
    if SOFT.intersection(words):
        return DROP if SOFT.union(GENERAL).issuperset(words) else DOUBT
    return MAYBE if CONTENT.intersection(words) and CONTENT.union(GENERAL).issuperset(words) else None


def element_kind(name: str, attributes: str, inside: int) -> int:
    """What the element makes of its content: DROP, TEXT, MAYBE, DOUBT, or as around it."""
    if inside == DROP or name in OFF or name == "header" and inside not in (TEXT, MAYBE, DOUBT):
        return DROP
    main, said = name in MAIN, set()
    if attributes and name not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                said.update(named_kind(token, main) for token in value.split())
            elif key == "role":
                if value in ROLES:
                    return DROP
                main |= value in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return DROP
    if NAMED in said and not main and inside not in (TEXT, DOUBT):
        said.add(DROP)
    if DROP in said and not (name == "header" and inside != OPEN):
        return DROP
    if main:
        return TEXT
    if inside == TEXT and (DOUBT in said or NAMED in said):
        return DOUBT
    return MAYBE if inside == OPEN and MAYBE in said else inside


def blocks(html: str | None) -> list[tuple[int, str]]:
    """Kind and text of every block of a page, in order."""
    html = html or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    kind, part, at = OPEN, [], 0

    def close() -> None:
        if part:
            text = " ".join(entities.unescape("".join(part)).split())
            part.clear()
            if text:
                out.append((kind, text))

    while at < len(html):
        m = MARKUP.search(html, at)
        if m is None:
            part.append(html[at:])
            break
        if m.start() > at:
            part.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS or name in OFF:
            close()
        elif name in SPACED:
            part.append(" ")
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name not in BLOCKS and stack[k][1] != kind:
                        close()
                    kind = stack[k][1]
                    del stack[k:]
                    break
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif name not in VOID and not m[3].endswith("/"):
            inner = element_kind(name, m[3], kind)
            # Paragraphs and inline elements are often left open, and change nothing; only what matters is kept.
            if inner != kind or name in BLOCKS and name not in ("p", "li", "dt", "dd", "option", "tr"):
                if inner != kind:
                    close()
                stack.append((name, kind))
                kind = inner
    close()
    return out


def windows(page: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first token) of the kept suffixes of a chunk's token stream; page: the page of each token, starts and ends: those of the blocks."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for k in range(1, window):
        h = mix(h * C + words[k : n + k])
    whole = page[:n] == page[window - 1 :]
    keep = np.zeros(n, bool)
    keep[starts[starts < n]] = True
    last = ends - window
    keep[last[last >= 0]] = True
    if n >= gap:
        inside = page[: n - gap + 1] == page[window + gap - 2 :]  # all `gap` neighbours are on one page
        at = np.arange(n - gap + 1) + np.lib.stride_tricks.sliding_window_view(h, gap).argmin(1)
        keep[at[inside]] = True
    at = np.flatnonzero(keep & whole)
    return h[at], at


def marked(repeated: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Which of n tokens are covered by the windows that begin at `repeated`."""
    change = np.zeros(n + window + 1, np.int64)
    np.add.at(change, repeated, 1)
    np.add.at(change, repeated + window, -1)
    return np.cumsum(change)[:n] > 0


def runs(marks: np.ndarray, least: int) -> np.ndarray:
    """The marked runs of a block that are its whole or have `least` tokens: shorter ones are ends of a neighbour's."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    out = np.zeros(len(marks), bool)
    for a, b in zip(edges[::2], edges[1::2]):
        out[a:b] = b - a >= min(least, len(marks))
    return out


def page_text(blocks_: list[tuple[int, str]], marks: np.ndarray, window: int = WINDOW) -> str:
    """The main text of a page from its blocks and the marks of its tokens."""
    kinds = {k for k, _ in blocks_}
    if not kinds & {TEXT, DOUBT} and MAYBE in kinds:
        return "\n".join(t for k, t in blocks_ if k == MAYBE)
    out, at = [], 0
    for k, t in blocks_:
        size = t.count(" ") + 1
        m = marks[at : at + size]
        at += size
        if kinds & {TEXT, DOUBT}:
            if k == TEXT or k == DOUBT and 2 * int(m.sum()) < size:
                out.append(t)
        elif k == OPEN:
            kept = [w for w, gone in zip(t.split(" "), runs(m, window).tolist()) if not gone] if m.any() else [t]
            if kept:
                out.append(" ".join(kept))
    return "\n".join(out)


class Chunk:
    """Some pages: their rows, blocks, token stream, and the hashes of the kept suffixes with their hosts."""

    def __init__(self, rows: list[tuple], pages: list[list[tuple[int, str]]], window: int, bits: int):
        self.rows, self.pages = rows, pages
        raw = [" ".join(t for _, t in p).encode("utf-8", "surrogatepass") for p in pages]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        words, page = word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends)
        sizes = np.array([t.count(" ") + 1 for p in pages for _, t in p], np.int64)
        stops = np.cumsum(sizes)
        h, self.at = windows(page, words, stops - sizes, stops, window)
        self.page, self.size, self.window = page[self.at], len(words), window
        names = {x: k for k, x in enumerate(dict.fromkeys(r[2] for r in rows))}
        hosts = np.array([int.from_bytes(hash_of(x), "little") for x in names], np.uint64)
        own = np.array([names[r[2]] for r in rows], np.int64)
        # Hashes of 48 bits beside those that name the range: of LEAST equal ones chance makes none.
        self.keys = mix(h ^ hosts[own[self.page]]) >> np.uint64(max(0, 16 - bits)) if len(h) else h
        self.first = np.searchsorted(page, np.arange(len(pages) + 1))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, ascending, and on how many pages that count each is."""
        order = np.lexsort((self.page, self.keys))
        k, p = self.keys[order], self.page[order]
        new = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])) if len(k) else np.zeros(0, bool)
        k, n = k[new], np.array([r[3] for r in self.rows], np.int64)[p[new]]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        return k[first], np.add.reduceat(n, first).astype(np.uint32) if len(k) else n.astype(np.uint32)

    def texts(self, repeated: np.ndarray) -> list[str]:
        """repeated: keys, ascending."""
        hit = np.zeros(len(self.keys), bool)
        if len(repeated):
            k = np.minimum(np.searchsorted(repeated, self.keys), len(repeated) - 1)
            hit = repeated[k] == self.keys
        marks = marked(self.at[hit], self.size, self.window)
        return [page_text(p, marks[a:b], self.window) for p, a, b in zip(self.pages, self.first[:-1], self.first[1:])]


def hash_of(text: str) -> bytes:
    import hashlib

    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def packed(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, then compressed."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


ROWS, NAMES = "bucket bigint, chunk bigint, kind int, a binary, b binary", ["bucket", "chunk", "kind", "a", "b"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], NAMES)


def _chunks(window: int, bits: int, chunk: int, most_pages: int):
    """Task over pages: for each chunk a row with its blocks, and a row of hashes for each range."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        pages: list[list[tuple[int, str]]] = []
        held = 0

        def flush():
            nonlocal rows, pages, held, seq
            name = part << 24 | seq
            keys, counts = Chunk(rows, pages, window, bits).counts()
            # Block texts have no control characters that are white space, so that these can part them.
            text = "\x1e".join("\n".join(f"{k}{t}" for k, t in p) for p in pages).encode("utf-8", "surrogatepass")
            out = [(1 << 40 | name, name, 1, zstandard.compress(text, 9), zstandard.compress(pickle.dumps(rows), 9))]
            cuts = np.searchsorted(keys >> np.uint64(64 - bits - max(0, 16 - bits)), np.arange((1 << bits) + 1).astype(np.uint64))
            for r in np.flatnonzero(np.diff(cuts)):
                x = keys[cuts[r] : cuts[r + 1]]
                out.append((int(r), name, 0, packed(np.diff(x, prepend=np.uint64(0))), packed(counts[cuts[r] : cuts[r + 1]])))
            rows, pages, held, seq = [], [], 0, seq + 1
            return _rows(out)

        for b in batches:
            for ident, url, host, html, counts in zip(*(b.column(k).to_pylist() for k in range(5))):
                pages.append(blocks(html))
                rows.append((ident, url, host, int(counts)))
                held += sum(len(t) for _, t in pages[-1])
                if held >= chunk or len(rows) >= most_pages:
                    yield flush()
        if rows:
            yield flush()

    return run


def _repeated(least: int):
    """Task of a hash range: for each chunk those of its keys that are on `least` pages or more. A chunk's own row passes."""

    def run(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(k).to_pylist() for k in NAMES)))
        out = [r for r in rows if r[2]]
        rows = [r for r in rows if not r[2]]
        if rows:
            parts_ = [np.cumsum(unpacked(r[3], np.uint64), dtype=np.uint64) for r in rows]
            keys, counts = np.concatenate(parts_), np.concatenate([unpacked(r[4], np.uint32) for r in rows]).astype(np.int64)
            order = np.argsort(keys)
            k = keys[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            often = np.empty(len(k), bool)
            often[order] = np.repeat(np.add.reduceat(counts[order], first) >= least, np.diff(np.append(first, len(k))))
            at = 0
            for r, x in zip(rows, parts_):
                found = x[often[at : at + len(x)]]
                at += len(x)
                if len(found):
                    out.append((r[0], r[1], 0, packed(np.diff(found, prepend=np.uint64(0))), b""))
        return pa.Table.from_batches([_rows(out)])

    return run


def _texts(window: int, bits: int):
    """Task of a chunk: the texts of its pages."""

    def run(group: pa.Table) -> pa.Table:
        rows, pages, repeated = [], [], [np.zeros(0, np.uint64)]
        for kind, a, b in zip(*(group.column(k).to_pylist() for k in NAMES[2:])):
            if kind:
                rows = pickle.loads(zstandard.decompress(b))
                text = zstandard.decompress(a).decode("utf-8", "surrogatepass")
                pages = [[(int(line[0]), line[1:]) for line in p.split("\n")] if p else [] for p in text.split("\x1e")]
            else:
                repeated.append(np.cumsum(unpacked(a, np.uint64), dtype=np.uint64))
        texts = Chunk(rows, pages, window, bits).texts(np.sort(np.concatenate(repeated)))
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.table(cols, ["page_id", "url", "text", "n_chars"])

    return run


def counted_once(pages: DataFrame) -> DataFrame:
    """Adds `_counts`: whether the row counts as a page; of rows with one id the first (by a hash of the page) does."""
    again = written(pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 AND page_id IS NOT NULL").select("page_id"), "html-again")
    if not again.count():
        return pages.withColumn("_counts", F.lit(True))
    first = F.row_number().over(Window.partitionBy("page_id").orderBy(F.xxhash64("url", "html"))) == 1
    one = pages.join(again, "page_id", "left_anti").withColumn("_counts", F.lit(True))
    return one.unionByName(pages.join(again, "page_id", "left_semi").withColumn("_counts", first))


def extract(pages: DataFrame, window: int = WINDOW, least: int = LEAST, chunk: int = CHUNK, most_pages: int = MOST_PAGES) -> DataFrame:
    """pages (page_id, url, html): page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    bits = max(4, int(np.ceil(np.log2(max(1, pages.count()) / PAGES_A_RANGE))))
    hosted = parts(counted_once(pages)).select("page_id", "url", "host", "html", "_counts")
    dealt = hosted.mapInArrow(_chunks(window, bits, chunk, most_pages), ROWS)
    shared = dealt.groupBy("bucket").applyInArrow(_repeated(least), ROWS)
    return shared.groupBy("chunk").applyInArrow(_texts(window, bits), "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
