"""Main text of web pages by differencing each page with its nearest neighbours.

Pages of a host are ordered by URL path, and each page is paired with the nearest pages before and after it whose lines
differ from its own: a copy of a page says nothing about furniture, nor does a page without lines. Text lines (one per
block element) that are in the longest common subsequence with both are the host's furniture and are deleted; the first
and last page of a host have one such neighbour, which decides alone. All lines take part. The lines that are left are
then checked against the markup: menus, page headers, footers, sidebars, notices, adverts, forms and reader comments go.
Lines left inside ``article`` or ``main`` elements stand for these: each such element is taken whole, for a line that it
shares with other pages is still part of it, and what is outside goes. So an element that the neighbours repeat (a teaser,
a box of the host) is furniture beside one that is the page's own. Where they repeat all of them, the page's own article
can't be told from a copy's, and all of them stay.

Order and pairing use rows of a global sort, so a host with a third of all pages is not a group of its own, and pages
with equal lines that follow one another are paired once, as a run.
"""

from __future__ import annotations

import html
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.llm import tokens as text_bytes
from candora.llm.shared import over_batches, stored, stored_chunks
from candora.plans.ordering import global_row_number, running_totals
from candora.plans.skew import spread_join

CHUNK_BYTES = 4 << 20  # html of the pages that are stored together
OUTSIDE, OWN, FURNITURE = 0, 1, -1  # a line outside any known part, in the page's first article (then 2, 3, …), in a part that is dropped

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody tfoot thead tr ul caption noscript template".split()
)
_SPACED = {"br", "td", "th", "wbr"}
_DROPPED = set(
    "head nav footer aside form button select menu dialog noscript template svg canvas object audio video datalist".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())  # have no content and no end
_UNCLOSED_END = _BLOCKS  # a block start ends an element that is never closed
_PARTS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice alert newsletter subscribe subscription signup popup modal overlay sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager toolbar footer masthead topbar share sharing social comment comments "
    "discussion disqus respond replies related recommended widget login search form contentinfo complementary dialog".split()
)
_HEADS = {"header"}


def _roles(attrs: str) -> set[str]:
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(attrs):
        value = next(g for g in m.groups()[1:] if g is not None) if any(g is not None for g in m.groups()[1:]) else ""
        found.update(re.split(r"[^a-z0-9]+", value.lower()))
    return found


def page_lines(source: str) -> tuple[list[str], list[int]]:
    """Text lines of a page in order, and what each belongs to: :data:`OUTSIDE`, :data:`FURNITURE`, or its article's number.

    Articles are numbered from :data:`OWN`; one inside another counts to it.
    """
    tokens: list[tuple[int, int, str, bool, str]] = []
    at = 0
    while m := _TOKEN.search(source, at):
        name = (m["name"] or m["name2"] or "").lower()
        closing = bool(m["end"] or m["end2"])
        at = m.end()
        tokens.append((m.start(), at, name, closing, m["attrs"] or m["attrs2"] or ""))
        if name in _RAW and not closing:
            over = re.compile(rf"</{name}\b", re.IGNORECASE).search(source, at)
            tokens[-1] = (m.start(), over.start() if over else len(source), name, closing, "")
            at = tokens[-1][1]
    # the end of each element: its own closing tag, or else the next block
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for k, (_, _, name, closing, _) in enumerate(tokens):
        if not name or name in _RAW or name in _VOID:
            continue
        if closing:
            if opened.get(name):
                ends[opened[name].pop()] = k
        else:
            opened.setdefault(name, []).append(k)

    def end_of(k: int) -> int:
        if k in ends:
            return ends[k]
        if tokens[k][2] in ("article", "main", "body"):
            return len(tokens)
        return next((j for j in range(k + 1, len(tokens)) if tokens[j][2] in _UNCLOSED_END and not tokens[j][3]), len(tokens))

    lines: list[str] = []
    kinds: list[int] = []
    text: list[str] = []
    kind = OUTSIDE
    own_end = drop_end = -1
    article = OWN - 1  # number of the latest

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append(line)
            kinds.append(kind)

    def now(k: int) -> int:
        return FURNITURE if k < drop_end else article if k < own_end else OUTSIDE

    at = 0
    for k, (start, stop, name, closing, attrs) in enumerate(tokens):
        if start > at:
            text.append(source[at:start])
        at = stop
        if not name:
            continue
        if name in _BLOCKS or k == drop_end or k == own_end:
            flush()
        elif name in _SPACED:
            text.append(" ")
        if not closing and name not in _RAW and name not in _VOID:
            roles = _roles(attrs) if attrs and "=" in attrs else set()
            if k >= own_end and (name in ("article", "main") or "main" in roles and k >= drop_end and name in ("div", "section")):
                if k >= drop_end:
                    flush()
                    own_end = end_of(k)
                    article += 1
            elif k >= drop_end and name not in ("html", "body"):
                inside = k < own_end
                if name in _DROPPED or roles & _PARTS or (not inside and (name in _HEADS or roles & _HEADS)):
                    flush()
                    drop_end = end_of(k)
        kind = now(k)
    if at < len(source):
        text.append(source[at:])
    flush()
    return lines, kinds


def lcs_members(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of ``a`` belong to one longest common subsequence of ``a`` and ``b``."""
    shared = np.zeros(len(a), bool)
    common = np.intersect1d(a, b)
    if not len(common):
        return shared
    at, other = np.flatnonzero(np.isin(a, common)), b[np.isin(b, common)]
    mine = a[at]
    low = 0
    while low < min(len(mine), len(other)) and mine[low] == other[low]:
        low += 1
    high = 0
    while high < min(len(mine), len(other)) - low and mine[-1 - high] == other[-1 - high]:
        high += 1
    inner = _align(mine[low : len(mine) - high], other[low : len(other) - high])
    shared[at[:low]] = True
    shared[at[low : len(mine) - high][inner]] = True
    shared[at[len(mine) - high :]] = True
    return shared


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.where(b == x, row[:-1] + 1, row[1:]))
    return row


def _align(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hirschberg's division: memory in proportion to the lines, not to their product."""
    out = np.zeros(len(a), bool)
    if not len(a) or not len(b):
        return out
    if len(a) == 1:
        out[0] = bool((b == a[0]).any())
        return out
    half = len(a) // 2
    forward = _lengths(a[:half], b)
    backward = _lengths(a[half:][::-1], b[::-1])[::-1]
    cut = int((forward + backward).argmax())
    out[:half], out[half:] = _align(a[:half], b[:cut]), _align(a[half:], b[cut:])
    return out


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _to_blob(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def _from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _parsed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Chunks of parsed pages: id, URL, lines and their kinds as one compressed Arrow batch each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            _, offsets = text_bytes.buffers(batch.column(2))
            for low, high in text_bytes.row_groups(offsets, CHUNK_BYTES):
                part = batch.slice(low, high - low)
                lines, kinds = [], []
                for source in part.column(2).to_pylist():
                    text, kind = page_lines(source) if source else ([], [])
                    lines.append(text)
                    kinds.append(kind)
                columns = [part.column(0), part.column(1), _lists(lines, pa.string()), _lists(kinds, pa.int32())]
                blob = _to_blob(pa.RecordBatch.from_arrays(columns, ["id", "url", "lines", "kinds"]))
                name = f"{TaskContext.get().partitionId()}-{number}"
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([blob], pa.binary())], ["_chunk", "_blob"])

    rows = pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return stored_chunks(rows.mapInArrow(work, "_chunk string, _blob binary"), "lines")


def _hashed_lines(chunks: DataFrame) -> DataFrame:
    """``_chunk``, ``_row`` (place in the chunk), ``_url`` and the hashes of the lines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                page = _from_blob(blob)
                hashes = [
                    [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in text]
                    for text in page.column("lines").to_pylist()
                ]
                rows = pa.array(np.arange(page.num_rows, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * page.num_rows), rows, page.column("url").combine_chunks(), _lists(hashes, pa.int64())],
                    ["_chunk", "_row", "_url", "_hashes"],
                )

    return chunks.mapInArrow(work, "_chunk string, _row int, _url string, _hashes array<long>")


def _shared_lines(rows: DataFrame) -> DataFrame:
    """``_chunk``, ``_row`` and, for each of its lines, whether the neighbours share it.

    Pages without lines are left out.
    """
    rows = stored(rows.filter(F.size("_hashes") > 0), "hashed")
    bare = F.regexp_replace(F.lower(F.coalesce("_url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    slim = rows.withColumn("_b", F.regexp_replace(bare, r"[?#].*$", "")).withColumn("_host", F.substring_index("_b", "/", 1))
    path = F.regexp_replace(F.expr("substr(_b, length(_host) + 1)"), r"(\.html?)?/*$", "")
    slim = slim.select("_chunk", "_row", "_host", path.alias("_path"), F.xxhash64("_hashes").alias("_lines"))
    placed = global_row_number(slim, ["_host", "_path", "_chunk", "_row"], "_place").drop("_path")
    # pages of a host with equal lines that follow one another are one run
    before = placed.select((F.col("_place") + 1).alias("_place"), F.struct("_host", "_lines").alias("_last"))
    marked = placed.join(before, "_place", "left")
    marked = marked.withColumn("_head", F.when(F.struct("_host", "_lines").eqNullSafe(F.col("_last")), 0).otherwise(1))
    runs = stored(running_totals(marked.drop("_last"), [], ["_place"], {"_run": "_head"}), "runs")
    heads = runs.filter("_head = 1").select("_run", "_host", "_chunk", "_row").join(rows.drop("_url"), ["_chunk", "_row"])
    heads = heads.select("_run", "_host", "_hashes")
    near = [
        heads.select((F.col("_run") + step).alias("_run"), "_host", F.col("_hashes").alias(name))
        for step, name in ((1, "_before"), (-1, "_after"))
    ]
    pairs = heads.join(near[0], ["_run", "_host"], "left").join(near[1], ["_run", "_host"], "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for own, *others in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
            mine = np.array(own.as_py(), np.int64)
            found = [lcs_members(mine, np.array(other, np.int64)) for other in (o.as_py() for o in others) if other]
            out.append((np.logical_and.reduce(found) if found else np.zeros(len(mine), bool)).tolist())
        return pa.RecordBatch.from_arrays([batch.column(0), _lists(out, pa.bool_())], ["_run", "_shared"])

    shared = over_batches(pairs.select("_run", "_hashes", "_before", "_after"), work, "_run long, _shared array<boolean>")
    sizes = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_pages"))
    pages = runs.select("_run", "_chunk", "_row")
    joined = spread_join(pages, shared.join(sizes, "_run"), ["_run"], "_pages", ["_chunk", "_row"], sizes=sizes)
    return joined.select("_chunk", "_row", "_shared")


def main_lines(lines: list[str], kinds: list[int], shared: list[bool]) -> list[str]:
    """Lines that stay of those that the neighbours don't share, once checked against the markup.

    ``shared`` has a flag for each line; without neighbours it may be empty. Articles that hold a line that isn't shared
    are taken whole, and alone. If there are articles and all lines in them are shared, all of them are taken.
    """
    left = [k for k, s in zip(kinds, shared or [False] * len(kinds), strict=True) if not s and k >= OWN]
    articles = set(left) or {k for k in kinds if k >= OWN}
    if articles:
        return [t for t, k in zip(lines, kinds, strict=True) if k in articles]
    return [t for t, k, s in zip(lines, kinds, shared or [False] * len(kinds), strict=True) if not s and k != FURNITURE]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` (blocks joined by an empty line) and ``n_chars`` (its code points).

    Null, empty and textless pages have an empty text. Pages with a null URL are neighbours of one another. Repeated
    rows and ids are extracted one by one. Other columns are ignored.
    """
    chunks = _parsed(pages, id_col, url_col, html_col)
    flags = _shared_lines(_hashed_lines(chunks))
    kind = pages.schema[id_col].dataType.simpleString()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        page = _from_blob(left.column("_blob")[0].as_py())
        shared: list[list[bool]] = [[]] * page.num_rows
        if right.num_rows:
            for row, found in zip(right.column("_row").to_pylist(), right.column("_shared").to_pylist(), strict=True):
                shared[row] = found
        columns = (page.column(c).to_pylist() for c in ("lines", "kinds"))
        texts = ["\n\n".join(main_lines(*row)) for row in zip(*columns, shared, strict=True)]
        return pa.Table.from_arrays(
            [page.column("id"), page.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            [id_col, url_col, "text", "n_chars"],
        )

    grouped = chunks.groupBy("_chunk").cogroup(flags.groupBy("_chunk"))
    return grouped.applyInArrow(finish, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
