"""Main text of pages by template deduction from equivalence classes.

The tokens of a page are its elements, told apart by their paths, and its runs
of text. Over the pages of a host each token has an occurrence vector: how
often it is on every page. Tokens with the same vector form a class. A class is
valid if its members come in one order on every page and nest into one slot of
the class around them; valid classes make the host's template. What is left are
the slots: the template element that holds nearly all text which isn't the
template's own is the main one, and what it holds, without the template's parts
in it, is the text.

A vector is never put together. It is known by its support and three exact sums
of (count x 31 bits of the page's hash), which tasks add up before anything is
shuffled, so a host with a third of all pages is a few rows a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stage, stage
from .markup import CONTAINERS, Names, Page

#: Pages that a token must be on, at least, and as a share of the host's: so a host's template is no longer than 20 pages.
SUPPORT, SHARE = 3, 0.05
#: Share of a slot's occurrences on which text stands that is the template's.
CONSTANT = 0.8
#: Share of the text that isn't the template's that the main slot holds.
MAIN = 0.8
#: Share of link text from which a block inside the main slot is a list of links.
LINKS = 0.8
#: Bytes of templates that are broadcast; beyond it those of hosts with HOT pages or more are, and the others joined.
MAX_BROADCAST, HOT = 64 << 20, 100_000
#: Tokens that a task adds up before it sends them on.
AT_ONCE = 200_000

_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
_SUMS = ("support", "occurrences", "f1", "f2", "f3", "place", "mass", "links", "heads")
TOKENS = "host long, token long, parent long, tag string, " + ", ".join(f"{c} long" for c in _SUMS)
#: What a host's template says: its classes' tokens in order, and what follows for the text.
CLASSES = "host long, pages long, tokens array<long>, classes array<int>, ups array<int>"
SLOTS = "host long, pages long, main array<long>, dropped array<long>"


def host_of(url: str | None) -> int:
    """A hash of the host in a URL; pages without one share a host."""
    m = _HOST.match(url or "")
    return xxhash.xxh64_intdigest(m[1].lower() if m else "") >> 1


def _sequence(page: Page) -> Iterator[tuple[int, int, str]]:
    """(token, element, text) of a page in its order: each element where it begins, and the runs of text in it."""
    role, mark = page.role, page.mark
    for node, text in page.items:
        if text == "":
            yield role[node], node, text
        elif text and not mark[node] and not text.isspace():
            yield xxhash.xxh64_intdigest(" ".join(text.split()), role[node]) >> 1, node, text


def _count(url: str | None, html: str | None, names: Names, into: dict) -> None:
    """Add one page's tokens."""
    page, host, h = Page(html, names), host_of(url), xxhash.xxh128_intdigest(f"{url}\0{html}")
    hashes = (h & 0x7FFFFFFF, h >> 32 & 0x7FFFFFFF, h >> 64 & 0x7FFFFFFF)
    role, tag, parent = page.role, page.tag, page.parent
    linked = [t == "a" for t in tag]
    for i in range(1, len(tag)):
        linked[i] = linked[i] or linked[parent[i]]
    own: dict[int, list] = {}
    for place, (token, node, text) in enumerate(_sequence(page)):
        got = own.get(token)
        if got is None:
            up = role[node] if text else role[parent[node]] if node else -1
            got = own[token] = [0, up, "" if text else tag[node], place, 0, 0, 0]
        got[0] += 1
        if text:
            size = len(text)
            for x in (got, own[role[node]]):
                x[4] += size
                if linked[node]:
                    x[5] += size
                if tag[node] in ("h1", "h2"):
                    x[6] += size
    for token, (k, up, name, place, mass, links, heads) in own.items():
        got = into.get((host, token))
        if got is None:
            got = into[host, token] = [up, name, *[0] * len(_SUMS)]
        for j, v in enumerate((1, k, *[k * x for x in hashes], place, mass, links, heads), 2):
            got[j] += v


def tokens(pages: DataFrame) -> DataFrame:
    """TOKENS of pages (url, html): sums over a task's pages, so a token of a host comes once or a few times a task."""

    def out(sums: dict) -> pa.RecordBatch:
        rows = [(*key, *v) for key, v in sums.items()]
        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * len(_SUMS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in TOKENS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sums = Names(), {}
        for b in batches:
            for url, html in zip(b.column(0), b.column(1), strict=True):
                _count(url.as_py(), html.as_py(), names, sums)
                if len(sums) > AT_ONCE:
                    yield out(sums)
                    sums = {}
        if sums:
            yield out(sums)

    return pages.select("url", "html").mapInArrow(run, TOKENS)


def frequent(counted: DataFrame) -> DataFrame:
    """Tokens over whole hosts that are on SUPPORT pages and SHARE of the host's, with `pages`, `class_id` and `members`.

    class_id tells the classes of a host apart; an element counts as two
    members, its start and its end.
    """
    # parent and tag are the token's own; as keys, not as minima, they are hashed and not sorted
    whole = stage(counted.groupBy("host", "token", "parent", "tag").agg(*[F.sum(c).alias(c) for c in _SUMS]).where(F.col("support") >= SUPPORT))
    pages = whole.where((F.col("token") == 0) & (F.col("parent") == -1)).select("host", F.col("support").alias("pages"))
    often = whole.join(pages, "host").where(F.col("support") >= SHARE * F.col("pages"))
    vector = F.xxhash64("support", "f1", "f2", "f3")
    members = F.sum(F.when(F.col("tag") == "", 1).otherwise(2)).over(Window.partitionBy("host", "class_id"))
    return often.withColumn("class_id", vector).withColumn("members", members)


def _ordered(t: pa.Table) -> pa.Table:
    """The classes of one host: tokens by mean place, each with its class and that of its parent."""
    d = t.to_pydict()
    by = sorted(range(t.num_rows), key=lambda i: d["place"][i] / d["support"][i])
    at = {d["token"][i]: d["class_id"][i] for i in by}
    number = {c: k for k, c in enumerate(dict.fromkeys(d["class_id"][i] for i in by))}
    ups = [number.get(at.get(d["parent"][i]), -1) for i in by]
    return pa.table({"host": [d["host"][0]], "pages": [d["pages"][0]], "tokens": [[d["token"][i] for i in by]], "classes": pa.array([[number[d["class_id"][i]] for i in by]], pa.list_(pa.int32())), "ups": pa.array([ups], pa.list_(pa.int32()))})


def _faults(page: Page, template: tuple[list, list, list], into: dict, host: int) -> None:
    """Count, for each class, the places of one page that break its order or its nesting."""
    names, classes, ups = template
    rank: dict[int, tuple[int, int, int]] = {}
    size: dict[int, int] = {}
    for token, c, up in zip(names, classes, ups, strict=True):
        rank[token] = (c, size.get(c, 0), up)
        size[c] = size.get(c, 0) + 1
    following: dict[int, int] = {}
    seen: dict[int, int] = {}
    for token, _, _ in _sequence(page):
        got = rank.get(token)
        if got is None:
            continue
        c, at, up = got
        if following.get(c, 0) % size[c] != at:
            into[host, c] = into.get((host, c), 0) + 1
        following[c] = at + 1
        if up >= 0 and up != c:
            # the slot: after how many of the members of the class around it
            slot = following.get(up, 0)
            if seen.setdefault(token, slot) != slot:
                into[host, c] = into.get((host, c), 0) + 1
    for c, at in following.items():
        if at % size[c]:
            into[host, c] = into.get((host, c), 0) + 1


def with_templates(pages: DataFrame, table: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """run(batches, known) over pages (url, html, ...), where known(host) is the host's row of `table`, or None.

    Templates that are small together are broadcast. Otherwise those of hosts
    with HOT pages or more are (a bounded number: one for HOT pages of input),
    so that no hot host meets a shuffle, and other pages are joined with theirs.
    """
    spark = pages.sparkSession
    columns = [c for c in table.columns if c != "host"]
    arrays = [c for c in columns if c != "pages"]
    weight = sum((F.size(c) * 9 for c in arrays), F.lit(200))
    total = table.agg(F.sum(weight)).first()[0] or 0
    sent = table if total <= MAX_BROADCAST else table.where(F.col("pages") >= HOT)
    shared = spark.sparkContext.broadcast({r.host: tuple(r[c] for c in columns) for r in sent.toLocalIterator()})
    if total <= MAX_BROADCAST:
        return pages.mapInArrow(lambda batches: run(batches, lambda host, _: shared.value.get(host)), schema)
    key = F.udf(lambda url: host_of(url), "long", useArrow=True)
    hot = spark.createDataFrame([(h,) for h in shared.value], "host long")
    keyed = pages.withColumn("__host", key("url"))
    rest = keyed.join(F.broadcast(hot), keyed["__host"] == hot["host"], "left_anti")
    packed = table.where(F.col("pages") < HOT).select(F.col("host").alias("__host"), F.struct(*columns).alias("__template"))
    joined = rest.join(packed, "__host", "left").drop("__host").select(*pages.columns, "__template")
    at_hand = keyed.join(F.broadcast(hot), keyed["__host"] == hot["host"], "left_semi").drop("__host")

    def own(host, row):
        return None if row is None else tuple(row[c] for c in columns)

    return joined.mapInArrow(lambda batches: run(batches, own), schema).unionByName(at_hand.mapInArrow(lambda batches: run(batches, lambda host, _: shared.value.get(host)), schema))


def _template(known: Callable, host: int, b: pa.RecordBatch, i: int):
    at = b.schema.get_field_index("__template")
    return known(host, b.column(at)[i].as_py() if at >= 0 else None)


def invalid(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """host, number of each class that some page breaks."""

    def run(batches: Iterator[pa.RecordBatch], known: Callable) -> Iterator[pa.RecordBatch]:
        names, faults = Names(), {}
        for b in batches:
            for i in range(b.num_rows):
                host = host_of(b.column(0)[i].as_py())
                template = _template(known, host, b, i)
                if template is not None:
                    _faults(Page(b.column(1)[i].as_py(), names), template[1:], faults, host)
        keys = list(faults)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32())], names=["host", "number"])

    return with_templates(pages.select("url", "html"), classes, run, "host long, number int").distinct()


def _slots(t: pa.Table) -> pa.Table:
    """The main slot of one host and the template's parts in it, from its tokens: roles of elements."""
    d = t.to_pydict()
    n, pages = t.num_rows, d["pages"][0]
    at = {d["token"][i]: i for i in range(n)}
    free = list(d["mass"])  # of each element, own text that isn't the template's
    for i in range(n):
        up = at.get(d["parent"][i])
        # constant text counts against the slot only as a member of a valid class
        if not d["tag"][i] and up is not None and d["valid"][i] and d["support"][i] >= CONSTANT * d["support"][up] and pages > SUPPORT:
            free[up] -= d["mass"][i]
    elements = [i for i in range(n) if d["tag"][i]]
    kids: dict[int, list[int]] = {}
    for i in elements:
        kids.setdefault(at.get(d["parent"][i], -1), []).append(i)
    order, todo = [], [at[0]] if 0 in at else []
    for i in todo:
        order.append(i)
        todo += kids.get(i, [])
    sums = {i: [free[i], d["mass"][i], d["links"][i], d["heads"][i]] for i in order}
    for i in reversed(order[1:]):
        up = sums[at[d["parent"][i]]]
        for j in range(4):
            up[j] += sums[i][j]
    main, dropped = [], []
    if order and sums[order[0]][0] > 0:
        here = order[0]
        while d["tag"][here] not in ("article", "main"):
            inner = [i for i in kids.get(here, []) if d["tag"][i] in CONTAINERS and d["valid"][i] and sums[i][0] - sums[i][2] >= MAIN * (sums[here][0] - sums[here][2])]
            inner = [i for i in inner if sums[i][3] >= CONSTANT * sums[here][3] and sums[i][0] > sums[i][2]]
            if not inner:
                break
            here = inner[0]
        main = [d["token"][here]]
        todo = list(kids.get(here, []))
        for i in todo:
            rest, mass, links, _ = sums[i]
            part = d["valid"][i] and pages > SUPPORT and mass > 0 and not re.fullmatch("p|h[1-6]|pre|blockquote|article|main", d["tag"][i])
            if part and d["support"][i] >= CONSTANT * d["support"][here] and (rest <= (1 - CONSTANT) * mass or (links >= LINKS * mass and d["tag"][i] not in ("a", "b", "i", "em", "strong", "span"))):
                dropped.append(d["token"][i])
            else:
                todo += kids.get(i, [])
    return pa.table({"host": [d["host"][0]], "pages": [pages], "main": pa.array([main], pa.list_(pa.int64())), "dropped": pa.array([dropped], pa.list_(pa.int64()))})


def deduce(pages: DataFrame) -> DataFrame:
    """SLOTS of each host that has enough pages for a template; pages has url and html.

    Hosts are grouped only when their tokens are counted: a group is the
    tokens on a twentieth of a host's pages or more.
    """
    often = stage(frequent(tokens(pages)))
    classes = stage(often.where("members > 1").groupBy("host").applyInArrow(lambda t: _ordered(t), CLASSES))
    broken = stage(invalid(pages, classes))
    # classes are numbered by the host's order; back from the number to the tokens
    placed = classes.select("host", F.explode(F.arrays_zip("tokens", "classes")).alias("x")).select("host", F.col("x.tokens").alias("token"), F.col("x.classes").alias("number"))
    held = placed.join(broken.withColumn("broken", F.lit(True)), ["host", "number"], "left").select("host", "token", F.col("broken").isNull().alias("valid"))
    table = often.join(held, ["host", "token"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    out = stage(table.groupBy("host").applyInArrow(lambda t: _slots(t), SLOTS))
    for used in (often, classes, broken):
        drop_stage(used)
    return out


def page_text(page: Page, main: set[int] | None = None, dropped: set[int] | None = None) -> str:
    """The main text of a page: by its host's slots if it has them, else by its own article, main or body.

    Where the page alone decides, elements that are lists of links go too.
    """
    n, tag, parent, role = len(page.tag), page.tag, page.parent, page.role

    def within(starts: Callable[[int], bool], without: Callable[[int], bool]) -> str:
        keep, out = [False] * n, [False] * n
        keep[0] = starts(0)
        for i in range(1, n):
            out[i] = out[parent[i]] or page.mark[i] > 0 or without(i)
            keep[i] = (keep[parent[i]] or starts(i)) and not out[i]
        return page.text(keep)

    if main:
        text = within(lambda i: role[i] in main, lambda i: role[i] in dropped)
        if text:
            return text
    for name in ("article", "main"):
        if any(tag[i] == name and not page.mark[i] for i in range(n)):
            text = within(lambda i: tag[i] == name, lambda i: False)  # noqa: B023
            if text:
                return text
    mass, links = np.zeros(n), np.zeros(n)
    linked = [False] * n
    for i in range(1, n):
        linked[i] = tag[i] == "a" or linked[parent[i]]
    for _, node, text in _sequence(page):
        mass[node] += len(text)
        links[node] += len(text) if linked[node] else 0
    anchors = np.array([t == "a" for t in tag], float)
    for i in range(n - 1, 0, -1):
        for a in (mass, links, anchors):
            a[parent[i]] += a[i]
    lists = [tag[i] in ("ul", "ol", "div", "section", "table", "dl") and anchors[i] >= 3 and links[i] >= LINKS * mass[i] for i in range(n)]
    return within(lambda i: i == 0, lambda i: lists[i])


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of df.

    Null pages are empty, and have the text "". Pages with a null url share a
    host. Pages of hosts with fewer than SUPPORT pages, or of another layout
    than their host's, are judged alone: by article, main, or all that isn't
    boilerplate by its name. Text that repeats over pages stays where it is in
    the main slot's paragraphs. Repeated rows and null ids are rows as any
    others; ties don't arise. Other columns are ignored. A task holds a page
    at a time, and AT_ONCE counters.
    """
    d = df.select(df[page_id].alias("page_id"), df[url].alias("url"), df[html].alias("html"))
    slots = deduce(d.select("url", "html"))
    schema = T.StructType([T.StructField("page_id", df.schema[page_id].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch], known: Callable) -> Iterator[pa.RecordBatch]:
        names, sets = Names(), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b, texts = whole.slice(at, 512), []
                for i in range(b.num_rows):
                    host = host_of(b.column(0)[i].as_py())
                    template = _template(known, host, b, i)
                    if host not in sets:
                        if len(sets) > 1000:
                            sets.clear()
                        sets[host] = (set(template[1]), set(template[2])) if template else (None, None)
                    texts.append(page_text(Page(b.column(1)[i].as_py(), names), *sets[host]))
                yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in schema])

    return with_templates(d.select("url", "html", "page_id"), slots, run, schema)
