"""Link, document and metadata extraction.

The cheap path is Catalyst only. The thorough path needs HTML semantics (nesting, entities, text of a subtree) and
runs over Arrow batches (see ``structure``), on the pages routed to it alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.config import DEFAULT
from webloom.functions import figures, urls
from webloom.functions.resolve import resolve
from webloom.operators import structure
from webloom.operators.routing import routed


def raw_links(html: Column) -> Column:
    """array<string>: the value after each href=, quoted (up to the same quote or the end) or up to space or >.

    A page's last six bytes begin no link: of a page that ends in ``href=x`` that one is left out.
    """
    found = F.regexp_extract_all(html, F.lit(r"(?i)href=(?![\x00-\x7F]?\z)(\"[^\"]*|'[^']*|[^ >]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, "^[\"']", "")), urls.fast_link_kept)


def fast_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, raw, link): all links of ``pages`` by the cheap path, duplicates kept."""
    each = pages.select("page_id", "url", F.explode(raw_links(F.col("html"))).alias("raw"))
    return each.withColumn("link", urls.make_absolute(F.col("raw"), F.col("url")))


def dotted(url: str) -> str:
    """As functions.urls.extension."""
    return "." + url.rsplit(".", 1)[1].split("?", 1)[0] if "." in url else ""


_FOUND = "links array<string>, documents array<struct<url:string,extension:string,title:string,context:string>>, title string, description string, has_nav boolean, reason string, us long"
_NAMES = ["links", "documents", "title", "description", "has_nav", "reason", "us"]
_KINDS = (pa.list_(pa.string()), pa.list_(pa.struct([(n, pa.string()) for n in ("url", "extension", "title", "context")])), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64())
#: Pages and bytes that are parsed at once; a longer page is parsed alone.
PAGES, BYTES = 256, 4 << 20


def _analyzer(extensions: Sequence[str], contains: bool) -> Callable[[pa.Array, pa.Array], list[pa.Array]]:
    """Of (urls, htmls) the columns _NAMES; null for a null html."""
    wanted = tuple(extensions)

    def is_document(url: str) -> bool:
        low = url.lower()
        return low.endswith(wanted) or contains and any(e + "?" in low or e + "&" in low for e in wanted)

    def one(url: str, page: structure.Tree) -> tuple:
        links, documents = [], []
        for x in page.links:
            href = x["href"]
            if href in ("", "#") or href.startswith(("javascript:", "mailto:")) or (link := resolve(url, href)) is None:
                continue
            links.append(link)
            if is_document(link):
                documents.append({"url": link, "extension": dotted(link), "title": x["text"], "context": x["context"]})
        return links, documents, page.title or "", page.description or "", page.nav, None

    def some(urls_: list[str], htmls: list[bytes]) -> Iterator[tuple]:
        """A page's time is its own, and its share by size of what is done for all at once."""
        began = time.perf_counter_ns()
        trees = structure.parsed(htmls)
        shared, total, own = 0, sum(map(len, htmls)) or 1, began
        for n, (url, html, (page, fault)) in enumerate(zip(urls_, htmls, trees, strict=True)):
            found = one(url, page) if page is not None else ([], [], "", "", False, f"{type(fault).__name__}: {fault}")
            now = time.perf_counter_ns()
            if n == 0:
                shared = now - own
                spent = shared * len(html) / total
            else:
                spent = now - own + shared * len(html) / total
            own = time.perf_counter_ns()
            yield *found, max(1, round(spent / 1000))

    def run(urls_: pa.Array, htmls: pa.Array) -> list[pa.Array]:
        at = [i for i, ok in enumerate(htmls.is_valid().to_pylist()) if ok]
        names, bodies = urls_.take(pa.array(at, pa.int64())).fill_null("").to_pylist(), htmls.take(pa.array(at, pa.int64())).cast(pa.binary()).to_pylist()
        rows, first, size = [], 0, 0
        for i, body in enumerate(bodies):
            if i > first and (i - first >= PAGES or size + len(body) > BYTES):
                rows += some(names[first:i], bodies[first:i])
                first, size = i, 0
            size += len(body)
        rows += some(names[first:], bodies[first:])
        back = {place: row for place, row in zip(at, rows, strict=True)}
        return [pa.array([back[i][k] if i in back else None for i in range(len(htmls))], kind) for k, kind in enumerate(_KINDS)]

    return run


def analyzed(pages: DataFrame, extensions: Sequence[str] = DEFAULT.extensions, contains: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row per page by the thorough path; a page that cannot be parsed gets empty values, ``failed`` and a reason.

    ``contains`` finds documents by the single-tier rule (an extension before ? or & too). ``us`` is how long the
    page took, in microseconds. Columns of ``keep`` stay.
    """
    find = _analyzer(extensions, contains)
    own = ["page_id", "url", "size", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4 * PAGES):
                b = batch.slice(a, 4 * PAGES)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in own), *find(b["url"], b["html"].fill_null(""))], [*own, *_NAMES])

    given = pages.select(*own, "html")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "html")
    return given.mapInArrow(run, f"{schema}, {_FOUND}").withColumn("failed", F.col("reason").isNotNull())


def _nanos(after: Column) -> Column:
    """The clock of the machine that computes the row, read after ``after`` is known."""
    return after * 0 + F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def extracted(pages: DataFrame, extensions: Sequence[str] = DEFAULT.extensions, timed: bool = False) -> DataFrame:
    """(page_id, url, size, route, links, documents, title, description, has_nav, reason, us) of each page, in one pass.

    Each page goes by the path that it is routed to: the parser gets null for the others, so that neither their text
    leaves the JVM nor the table is read twice. ``us`` is how long the page took on its path, in microseconds; for
    the cheap path only if ``timed``, as reading the clock for each row costs it its generated code.
    """
    find = _analyzer(extensions, False)

    @F.arrow_udf(f"struct<{_FOUND.replace(' array', ':array').replace(' string', ':string').replace(' boolean', ':boolean').replace(' long', ':long')}>")
    def thorough(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for urls_, htmls in batches:
            yield pa.StructArray.from_arrays(find(urls_, htmls), _NAMES)

    fast = F.col("route") == "fast"
    rows = routed(pages)
    rows = rows.withColumn("_began", _nanos(F.col("size"))) if timed else rows
    rows = rows.select("page_id", "url", "size", "route", *(["_began"] if timed else []), F.when(fast, raw_links(F.col("html"))).alias("_raw"), F.when(~fast, F.coalesce("html", F.lit(""))).alias("_html"))
    taken = F.lit(None).cast("long")
    if timed:
        rows = rows.withColumn("_ended", _nanos(F.coalesce(F.size("_raw"), F.lit(0)) + F.col("_began") * 0))
        taken = F.greatest(F.lit(1), F.round((F.col("_ended") - F.col("_began")) / 1000)).cast("long")
    both = rows.withColumn("_slow", thorough("url", "_html"))
    mine = lambda name, other: F.when(fast, other).otherwise(F.col(f"_slow.{name}")).alias(name)
    links = F.transform("_raw", lambda raw: urls.make_absolute(raw, F.col("url")))
    return both.select(
        "page_id", "url", "size", "route", mine("links", links), mine("documents", F.array()), mine("title", F.lit("")), mine("description", F.lit("")), mine("has_nav", F.lit(False)), F.col("_slow.reason").alias("reason"),
        mine("us", taken),
    )


def slow_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link) by the thorough path."""
    return analyzed(pages).select("page_id", "url", F.explode("links").alias("link"))


def documents(pages: DataFrame, extensions: Sequence[str] = DEFAULT.extensions, contains: bool = False) -> DataFrame:
    """(page_id, page_url, url, extension, title, context) of each document link."""
    return analyzed(pages, extensions, contains).select("page_id", F.col("url").alias("page_url"), F.inline("documents"))


def closed_references(html: Column, names: Sequence[str]) -> Column:
    """``html`` in which the references of these names, each with its semicolon, are the only ones: any other & stands for itself."""
    return F.regexp_replace(html, f"&(?!(?:{'|'.join(names)});)", "&amp;")


def metadata(pages: DataFrame, references: Sequence[str] | None = None) -> DataFrame:
    """(page_id, url, title, description, has_nav, link_count, doc_count, link_density, depth); depth is always 0.

    Character references are read as HTML has them, some of which need no semicolon (``&amp`` is &); with
    ``references`` only those of these names, and only with their semicolons.
    """
    pages = pages if references is None else pages.withColumn("html", closed_references(F.col("html"), references))
    n = F.size("links").cast("long")
    return analyzed(pages).select("page_id", "url", "title", "description", "has_nav", n.alias("link_count"), F.size("documents").cast("long").alias("doc_count"), figures.link_density(n, F.col("size")).alias("link_density"), F.lit(0).alias("depth"))


def two_tier_links(pages: DataFrame, outer: bool = False) -> DataFrame:
    """(page_id, url, route, pos, link): each page by the path that it is routed to. Split before the parser runs.

    With ``outer`` a page without links has one row of null link, so that pages and links are counted in one pass.
    """
    explode = F.posexplode_outer if outer else F.posexplode
    return extracted(pages).select("page_id", "url", "route", explode("links").alias("pos", "link"))


def two_tier_documents(pages: DataFrame, extensions: Sequence[str] = DEFAULT.extensions) -> DataFrame:
    """Documents of the pages that are routed to the thorough path; the cheap path finds none."""
    return documents(routed(pages).where("route = 'slow'"), extensions)


def quarantined(done: DataFrame) -> DataFrame:
    """(page_id, url, reason) of the pages that were given up: the log of failed pages, and what is counted."""
    return done.where("reason IS NOT NULL").select("page_id", "url", "reason")


def measures() -> list[Column]:
    """What to observe of ``extracted`` rows, by route: pages, microseconds, links and documents."""
    out = []
    for route in ("fast", "slow"):
        mine = F.col("route") == route
        out += [F.count_if(mine).alias(f"{route}_pages")]
        out += [F.coalesce(F.sum(F.when(mine, x)), F.lit(0)).cast("long").alias(f"{route}_{n}") for n, x in (("us", F.col("us")), ("links", F.size("links")), ("docs", F.size("documents")))]
    return out


def path_stats(timed: DataFrame) -> DataFrame:
    """(route, n_pages, avg_us, n_links, n_docs) of ``extracted`` rows; the average is a whole number."""
    total = timed.groupBy("route").agg(F.count("*").alias("n_pages"), F.sum("us").alias("us"), F.sum(F.size("links")).alias("n_links"), F.sum(F.size("documents")).alias("n_docs"))
    return total.select("route", "n_pages", F.floor(F.col("us") / F.col("n_pages")).alias("avg_us"), "n_links", "n_docs")


def new_urls(links: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """Distinct normalized crawlable URLs of ``links``, without those of ``visited`` (norm_url)."""
    out = links.where(urls.is_crawlable(F.col("link"))).select(urls.normalize_url(F.col("link")).alias("norm_url")).distinct()
    return out if visited is None else out.join(visited, "norm_url", "left_anti")
