"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines (one per block of its markup). Within each host pages are ordered by URL path; each page
is paired with the neighbour whose path has the longer prefix in common with its own (ties: the one before). A copy, a
page with the same lines, tells nothing, so the nearest page that differs counts. The two pages' lines are aligned by a
longest common subsequence, and the lines they share are template: they are deleted, unless they stand inside the page's
article or main element, which marks them as its own content (articles share sentences that belong to each). Of the
rest, what stands in navigation, header, footer, aside, form, notice, advert or comment elements is dropped by its
markup, within a line too, and if the page has an article or main element, so is what lies outside it.

Null or empty html: empty text. Null url: an empty host and path. Ties (equal paths): by page_id. A page alone on its
host, or among copies only, has no partner and loses no shared lines. Repeated rows: each is a page. Broken markup:
unclosed elements end with their parent; an unclosed script, style or comment ends with the page; a quote that doesn't
follow an equals sign is a plain character of its tag. Very long pages: whole; an alignment of many lines is halved until
it fits. Empty table: empty result. Extra columns: not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import MOST_PARTS, lean, slices, small_batches, span_hashes, utf8

PART_ROWS = 500
#: Splitters come from a sample of so many keys a part.
SAMPLE_KEYS = 8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|textarea|select|title|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)>|<[!?/][^>]*>", re.S | re.I)
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("nav footer aside form dialog menu button head fieldset".split())
#: An element of these closes an open one of the listed kinds.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_CLOSES_P = _BLOCKS - {"br", "body", "html", "head"}
_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: Words that may stand beside one of those in the name of an element.
_PARTS = frozenset("area articles bar block bottom box button buttons container content fixed form global header icon icons inner item items left link links list main outer page panel parts post posts primary right secondary section site slot stories text top unit wrap wrapper".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_INSIDE, _CHROME_LINE, _BODY = 2, 0, 1


def _is_furniture(name: str) -> bool:
    """Whether a class or id names page furniture: one of _WORDS, and beside it only such words, parts and numbers."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return not _WORDS.isdisjoint(words) and all(w in _WORDS or w in _PARTS for w in words)


def kind_of(tag: str, attributes: str, inside: bool) -> int | None:
    """What an element makes of its lines: 0 drop, 2 content, None as its parent."""
    if tag in _CHROME or tag == "header" and not inside:
        return _CHROME_LINE
    role = ""
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id") and any(map(_is_furniture, value.split())) or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return _CHROME_LINE
            if name == "role":
                role = value
    if role in _ROLES:
        return _CHROME_LINE
    return _INSIDE if tag in ("article", "main") or role in ("main", "article") else None


def lines_of(page: str) -> tuple[list[str], list[int]]:
    """The text lines of a page in order, and for each: 0 in page furniture, 1 elsewhere, 2 in the content element."""
    lines: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    kind = held_kind = _BODY

    def flush() -> None:
        if held:
            line = " ".join("".join(held).split())
            held.clear()
            if line:
                lines.append(line)
                kinds.append(held_kind)

    def hold(text: str) -> None:
        """Add text to the line. Furniture within a line of another kind goes, and the line goes on after it."""
        nonlocal held_kind
        if held and (held_kind == _CHROME_LINE) != (kind == _CHROME_LINE) and "".join(held).strip():
            if kind == _CHROME_LINE:
                return
            flush()
        if not held or not "".join(held).strip():
            held_kind = kind
        held.append(html.unescape(text) if "&" in text else text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            hold(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and m[1].lower() in ("title", "textarea", "select"):
                flush()
            continue
        tag = tag.lower()
        if tag in _BLOCKS:
            flush()
        if tag in _VOID:
            continue
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    kind = stack[i][1]
                    del stack[i:]
                    break
                # Inline elements and paragraphs left open end here; a stray end tag of those doesn't close a block.
                if tag not in _BLOCKS and stack[i][0] in _BLOCKS:
                    break
            continue
        ends = _ENDS.get(tag, frozenset()) | ({"p"} if tag in _CLOSES_P else frozenset())
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name in ends:
                    kind = stack[i][1]
                    del stack[i:]
                    break
                if name in _BLOCKS and name not in ("p", "li", "td", "th", "dd", "dt"):
                    break
        if m[4].endswith("/"):
            continue
        stack.append((tag, kind))
        if kind != _CHROME_LINE:
            own = kind_of(tag, m[4], kind == _INSIDE)
            kind = kind if own is None else own
    if at < len(page):
        hold(page[at:])
    flush()
    return lines, kinds


def lcs_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of a and b.

    Bit-parallel lengths; halves of a are solved apart (divide and conquer) where all rows would need too much memory."""
    out: list[tuple[int, int]] = []

    def row(x: list[int], y: list[int]) -> list[int]:
        """Length of the LCS of x and each prefix of y."""
        places: dict[int, int] = {}
        for j, s in enumerate(y):
            places[s] = places.get(s, 0) | 1 << j
        full = (1 << len(y)) - 1
        v = full
        for s in x:
            u = v & places.get(s, 0)
            v = (v + u | v - u) & full
        zeros, total = bin(v)[2:].rjust(len(y), "0")[::-1][: len(y)], 0
        counts = [0]
        for z in zeros:
            total += z == "0"
            counts.append(total)
        return counts

    def solve(a0: int, a1: int, b0: int, b1: int) -> None:
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        tail = 0
        while a0 < a1 - tail and b0 < b1 - tail and a[a1 - tail - 1] == b[b1 - tail - 1]:
            tail += 1
        x, y = a[a0 : a1 - tail], b[b0 : b1 - tail]
        if x and y:
            if len(x) == 1:
                if x[0] in y:
                    out.append((a0, b0 + y.index(x[0])))
            elif len(x) * len(y) <= 1 << 22:
                places: dict[int, int] = {}
                for j, s in enumerate(y):
                    places[s] = places.get(s, 0) | 1 << j
                full, v, rows = (1 << len(y)) - 1, (1 << len(y)) - 1, []
                for s in x:
                    u = v & places.get(s, 0)
                    v = (v + u | v - u) & full
                    rows.append(v)
                found, j = [], len(y)
                for i in range(len(x) - 1, -1, -1):
                    # Row i counts one match more than row i - 1 up to j where x[i] is matched.
                    now = (j - (rows[i] & (1 << j) - 1).bit_count()) if j else 0
                    before = (j - (rows[i - 1] & (1 << j) - 1).bit_count()) if i and j else 0
                    if now > before:
                        while y[j - 1] != x[i] or (j - 1) - (rows[i] & (1 << (j - 1)) - 1).bit_count() == now:
                            j -= 1
                        found.append((a0 + i, b0 + j - 1))
                        j -= 1
                out.extend(reversed(found))
            else:
                half = len(x) // 2
                left, right = row(x[:half], y), row(x[half:][::-1], y[::-1])
                cut = max(range(len(y) + 1), key=lambda j: left[j] + right[len(y) - j])
                solve(a0, a0 + half, b0, b0 + cut)
                solve(a0 + half, a1 - tail, b0 + cut, b1 - tail)
        out.extend((a1 - tail + i, b1 - tail + i) for i in range(tail))

    solve(0, len(a), 0, len(b))
    return out


def main_text(lines: list[str], kinds: list[int], shared: set[int]) -> str:
    """The lines that stay: those of the content element; without one, those neither shared nor page furniture."""
    if _INSIDE in kinds:
        return "\n".join(line for line, k in zip(lines, kinds, strict=True) if k == _INSIDE)
    return "\n".join(line for i, (line, k) in enumerate(zip(lines, kinds, strict=True)) if k == _BODY and i not in shared)


def url_key(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path (without query, fragment, index suffix or last slash) of a URL."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    return host, F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", "")


_PARSED = "page_id long, url string, _part int, _key string, _own boolean, lines binary, kinds binary, hashes binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(3)
    for part in slices(batches, "html"):
        rows = [lines_of(t or "") for t in part.column("html").to_pylist()]
        data, offsets = utf8(pa.array([x for lines, _ in rows for x in lines], pa.large_string()))
        hashes = span_hashes(data, offsets[:-1], offsets[1:])
        ends = np.cumsum([0, *(len(lines) for lines, _ in rows)])
        yield pa.RecordBatch.from_arrays(
            [
                *(part.column(c) for c in ("page_id", "url", "_part", "_key", "_own")),
                pa.array([press.compress("\n".join(lines).encode()) for lines, _ in rows], pa.binary()),
                pa.array([bytes(kinds) for _, kinds in rows], pa.binary()),
                pa.array([hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
            ],
            ["page_id", "url", "_part", "_key", "_own", "lines", "kinds", "hashes"],
        )


def _common_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def partners(keys: list[tuple[str, str]], contents: list[bytes]) -> list[int | None]:
    """Of pages in order, given as (host, path) and content, the place of each one's partner."""

    def differing(order: list[int]) -> list[int | None]:
        """The nearest page that differs, in the direction from which order comes."""
        out: list[int | None] = [None] * len(keys)
        for last, own in zip(order, order[1:], strict=False):
            out[own] = last if contents[last] != contents[own] else out[last]
        return out

    places = list(range(len(keys)))
    found = []
    for own, near in zip(places, zip(differing(places), differing(places[::-1]), strict=True), strict=True):
        host, path = keys[own]
        sides = [(_common_prefix(keys[i][1], path), -k, i) for k, i in enumerate(near) if i is not None and keys[i][0] == host]
        found.append(max(sides)[2] if sides else None)
    return found


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part and key; a part, some PART_ROWS packed pages, is done at once."""
    unpress = zstandard.ZstdDecompressor()
    names = ["page_id", "url", "text", "n_chars"]

    def done(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        near = partners([tuple(r["_key"].split("\x01")[:2]) for r in rows], [r["hashes"] for r in rows])
        out: list[tuple] = []
        for own, other in zip(rows, near, strict=True):
            if own["_own"]:
                text = unpress.decompress(own["lines"]).decode()
                lines, kinds = text.split("\n") if text else [], list(own["kinds"])
                mine = np.frombuffer(own["hashes"], np.uint64).tolist()
                shared = {i for i, _ in lcs_pairs(mine, np.frombuffer(rows[other]["hashes"], np.uint64).tolist())} if other is not None else set()
                text = main_text(lines, kinds, shared)
                out.append((own["page_id"], own["url"], text, len(text)))
        for a in range(0, len(out), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 500], strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names)

    part: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if part and part[0]["_part"] != r["_part"]:
                yield from done(part)
                part = []
            part.append(r)
    if part:
        yield from done(part)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html).

    Pages are dealt into ranges of (host, path, id); each range also sees the page before and the one after it, so a
    host may span many ranges. The driver holds a splitter for each range, at most MOST_PARTS."""
    spark = pages.sparkSession
    small_batches(spark)
    host, path = url_key(F.col("url"))
    order = F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0")
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", F.concat_ws("\x01", host, path, order).alias("_key"))
    n = keyed.count()
    parts = min(MOST_PARTS, max(1, n // PART_ROWS))
    wanted = parts * SAMPLE_KEYS
    picked = keyed.select("_key").filter(F.pmod(F.xxhash64("_key"), F.lit(max(1, n // wanted))) == 0).limit(4 * wanted) if parts > 1 else None
    keys = sorted(r[0] for r in picked.collect()) if picked is not None else []
    cuts = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    shared = spark.sparkContext.broadcast(np.array(cuts, object))
    find = F.pandas_udf(lambda k: _found(shared.value, k), "int")
    parted = keyed.withColumn("_part", find("_key"))
    # The first and last page of each range also go to its neighbours.
    edges = parted.groupBy("_part").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"))
    w = Window.orderBy("_part")
    ends = edges.select("_low", "_high", F.lag("_part").over(w).alias("_before"), F.lead("_part").over(w).alias("_after"))
    guests = ends.select(F.col("_low").alias("_k"), F.col("_before").alias("_to")).unionByName(ends.select(F.col("_high").alias("_k"), F.col("_after").alias("_to"))).filter("_to is not null")
    visiting = keyed.join(F.broadcast(guests), F.col("_key") == F.col("_k")).select("page_id", "url", "html", "_key", F.col("_to").alias("_part"), F.lit(False).alias("_own"))
    rows = parted.withColumn("_own", F.lit(True)).unionByName(visiting).select("page_id", "url", "html", "_part", "_key", "_own")
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.mapInArrow(lean(_parse), _PARSED).repartition(n_tasks, "_part").sortWithinPartitions("_part", "_key", "hashes")
    return placed.mapInArrow(lean(_difference), "page_id long, url string, text string, n_chars long")


def _found(cuts: np.ndarray, keys):
    import pandas as pd

    return pd.Series(np.searchsorted(cuts, keys.to_numpy(object), side="right").astype(np.int32) if len(cuts) else np.zeros(len(keys), np.int32))


def op4_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
