"""Main text of web pages by union-free regular-expression inference per host.

A page is a token stream of tags and texts. Its wrapper is a union-free regular
expression over tags: per element its parts in order, each one required, optional or
repeated, and texts that are either a fixed string or a slot. Siblings that come
again fold into a repeated group; two wrappers of a host are aligned in order, what
only one of them has becomes optional, what comes in another order becomes part of a
repeated group, and different texts become a slot. Merging is associative, so tasks
merge what they see of a host first, then salted parts, then the parts, and no task
holds more than two wrappers of a host. The wrappers are joined back by host.

On a page the wrapper says what is template, also inside ``article`` and ``main``: a
block whose texts stand at the same place on every page of the host that has the place,
on ``EVIDENCE`` pages at least that differ in their ``LONGEST`` longest other texts (so
versions of one article that differ in short texts are no evidence); texts of repeated parts are held against each other as
sets. A heading over text of the page's own is no template there, though every page has it.
Outside an article, a fixed text of a part that is not repeated is template too.
The main text is what stands in ``article`` elements, else in ``main`` (or an element
named like these), else in the body, without the template and without the parts that
their tag, role, class or id marks as menu, header, footer, sidebar, notice, advert,
form, script, style or comments. A heading in an article's header stays. A page of
nothing but template keeps it.

Edge cases: a null or empty page has the empty text; unclosed and stray tags, quotes in
attributes and unknown references are read as browsers do, roughly; a null url is a
host of its own; repeated rows are all returned.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, save
from .url_filter import parts

SALTS = 32
WRAPPER_ROWS = 20_000
FIXED_CHARS = 200  # longer fixed texts are held as digests
EVIDENCE = 3
LONGEST = 4

# Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"},
            "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
LISTS = frozenset("ul ol dl table select menu".split())
DROPPED = frozenset("""nav footer aside form button select dialog menu object canvas audio video applet head
datalist""".split())
DROPPED_ROLES = frozenset("""navigation banner contentinfo complementary search form alert alertdialog dialog menu
menubar toolbar tooltip""".split())
DROPPED_NAMES = frozenset("""ad ads adsense advert adverts advertisement advertising sponsor sponsored sponsors promo
promos promotion banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay
sidebar sidenav aside rail widget widgets menu submenu nav navbar navigation breadcrumb breadcrumbs footer masthead
topbar toolbar share sharing social related recommended recommendations newsletter subscribe subscription signup login
search comment comments disqus respond reply replies pagination pager skip""".split())
DROPPED_STARTS = ("comment", "advert", "cookie", "sidebar", "newsletter", "breadcrumb", "sponsor")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_NAMES = frozenset("content article post entry story main maincontent articlebody".split())

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")
_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


def _tag_end(page: str, at: int, broken: set[int]) -> int:
    """The place of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none.

    Quoted values may hold a ``>``. Where the quotes leave no end, the first ``>`` counts;
    ``broken`` remembers the opening quotes from which that is known, so that a page of
    such tags is still read in one go.
    """
    i, opened = at, []
    while (m := _STOP.search(page, i)) is not None:
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end()) if m.start() not in broken else -1
        opened.append(m.start())
        if close < 0:
            break
        i = close + 1
    broken.update(opened)
    return page.find(">", at) if opened else -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name or text, attributes)`` with kinds text, start and end; raw elements are skipped."""
    at, start, broken, last = 0, 0, set(), page.rfind(">")
    while (m := _OPEN.search(page, at)) is not None:
        at = m.end()
        name = (m[4] or "").lower()
        if m[1]:
            end = page.find("-->", at)
            end = end + 3 if end >= 0 else len(page)
        elif m[2]:
            end = page.find(">", at) + 1 or len(page)
        else:
            end = _tag_end(page, at, broken) + 1 if at <= last else 0
            if not end:  # no tag: text
                continue
        if m.start() > start:
            yield "text", page[start:m.start()], ""
        if m[3]:
            yield "end", name, ""
        elif name in RAW:
            if page[end - 2:end] != "/>":
                close = _END[name].search(page, end)
                end = close.end() if close else len(page)
        elif name:
            yield "start", name, page[at:end - 1]
        at = start = end
    if start < len(page):
        yield "text", page[start:], ""


def marks(name: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's signature; whether it is dropped; whether it is named like main content."""
    found = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    names = _NAME.findall(f"{found.get('class', '')} {found.get('id', '')}".lower())
    role = found.get("role", "").lower()
    drop = (name in DROPPED or role in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
            or "display:none" in found.get("style", "").replace(" ", "").lower()
            or (name not in ("body", "html", "article", "main") and any(
                n in DROPPED_NAMES or n.startswith(DROPPED_STARTS) for n in names))
            or (name == "article" and any(n.startswith(("comment", "repl")) for n in names)))
    main = name == "main" or role in ("main", "article") or found.get("itemprop") == "articleBody" or any(
        n in MAIN_NAMES for n in names)
    return ".".join([name, *sorted(set(names))]), drop, main


class Reader:
    """Walks a token stream with a stack of open elements, as browsers close them."""

    def __init__(self):
        self.stack: list[tuple] = []

    def pops(self, name: str) -> int:
        """Elements that the start of ``name`` closes."""
        names = [x[0] for x in self.stack]
        cut = len(names)
        if name in CLOSES_P:
            for i in range(len(names) - 1, -1, -1):
                if names[i] == "p":
                    cut = min(cut, i)
                    break
                if names[i] in BLOCKS:
                    break
        if name in ENDED_BY:
            for i in range(len(names) - 1, -1, -1):
                if names[i] in ENDED_BY[name]:
                    cut = min(cut, i)
                    if name != "tr" or names[i] == "tr":
                        break
                elif names[i] in LISTS:
                    break
        return len(names) - cut

    def end(self, name: str) -> int:
        """Elements that the end tag closes (0: it is stray)."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                return len(self.stack) - i
            if self.stack[i][0] in ("article", "main", "body") and name not in BLOCKS:
                return 0
        return 0


# Wrappers: {"lo": least, "rep": repeated, "kids": {signature: wrapper}} and, for texts,
# {"lo": .., "rep": .., "text": string or None (a slot), "same": {digest: evidence}} with the
# texts of all pages that have the place; kids stay in page order. Nothing here recurses: pages
# nest to any depth.


def _flat(text: str) -> str:
    return " ".join(htmllib.unescape(text).split())


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def page_wrapper(page: str) -> dict:
    """The wrapper of a single page."""
    root = {"lo": 1, "rep": False, "kids": {}}
    reader, nodes = Reader(), [root]
    slots: list[dict] = []
    longest: dict[str, int] = {}  # the longest texts of the page

    def add(parent, signature, make):
        kids = parent["kids"]
        if signature in kids:
            order = list(kids)
            for k in order[order.index(signature):]:  # the part comes again: a repeated group
                kids[k]["rep"] = True
            return kids[signature]
        kids[signature] = make
        return make

    def close(n):
        for _ in range(n):
            reader.stack.pop()
            nodes.pop()

    for kind, what, attributes in tokens(page):
        node = nodes[-1]
        if kind == "text":
            text = _flat(what)
            if text:
                digest = _digest(text)
                longest[digest] = len(text)
                if len(longest) > LONGEST + 1:
                    del longest[min(longest, key=lambda d: (longest[d], d))]
                text = text if len(text) <= FIXED_CHARS else f"#{digest}"
                slot = add(node, "#", {"lo": 1, "rep": False, "text": text, "same": {}})
                if slot["text"] != text:
                    slot["text"] = None
                slot["same"][digest] = []
                slots.append(slot)
        elif kind == "start":
            close(reader.pops(what))
            node = nodes[-1]
            kid = add(node, marks(what, attributes)[0], {"lo": 1, "rep": False, "kids": {}})
            if what not in VOID:
                reader.stack.append((what,))
                nodes.append(kid)
        else:
            close(reader.end(what))
    order = sorted(longest, key=lambda d: (-longest[d], d))
    for slot in slots:
        for digest in slot["same"]:
            others = [d for d in order if d != digest][:LONGEST]
            slot["same"][digest] = [_digest(" ".join(others))] if others else []
    return root


def merged(a: dict, b: dict) -> dict:
    """The wrapper that both pages, or all pages of both wrappers, match."""
    top: dict = {}
    todo = [(a, b, False, top)]
    while todo:
        a, b, moved, out = todo.pop()
        out.update(lo=min(a["lo"], b["lo"]), rep=a["rep"] or b["rep"] or moved)
        if "text" in a:
            same = {d: sorted({*a["same"][d], *b["same"][d]})[:EVIDENCE] for d in a["same"] if d in b["same"]}
            out.update(text=a["text"] if a["text"] == b["text"] else None, same=same)
            continue
        kids, other = {}, list(b["kids"])
        out["kids"] = kids
        places = {k: n for n, k in enumerate(other)}
        at = 0
        for signature, kid in a["kids"].items():
            if signature not in places:
                kids[signature] = kid | {"lo": 0}
                continue
            place = places[signature]
            for k in other[at:place]:  # before it, and only in the other wrapper
                if k not in a["kids"]:
                    kids[k] = b["kids"][k] | {"lo": 0}
            kids[signature] = {}
            # In another order it is part of a repeated group.
            todo.append((kid, b["kids"][signature], place < at, kids[signature]))
            at = max(at, place + 1)
        for k in other:
            if k not in kids:
                kids[k] = b["kids"][k] | {"lo": 0}
    return top


def packed(wrapper: dict, evidence: int = 0) -> str:
    """The wrapper as JSON, its nodes in page order with their depths; only texts with the evidence stay."""
    rows, todo = [], [(0, "", wrapper)]
    while todo:
        depth, signature, node = todo.pop()
        row = [depth, signature, node["lo"], node["rep"]]
        if "text" in node:
            row += [node["text"], {d: e for d, e in node["same"].items() if len(e) >= evidence}]
        else:
            todo += [(depth + 1, k, kid) for k, kid in reversed(node["kids"].items())]
        rows.append(row)
    return json.dumps(rows)


def unpacked(text: str) -> dict:
    """The wrapper from ``packed``."""
    path: list[dict] = []
    for depth, signature, lo, rep, *rest in json.loads(text):
        node = {"lo": lo, "rep": rep} | ({"text": rest[0], "same": rest[1]} if rest else {"kids": {}})
        path[depth:] = [node]
        if depth:
            path[depth - 1]["kids"][signature] = node
    return path[0]


def expression(wrapper: dict) -> str:
    """The wrapper as a union-free regular expression."""
    out, todo = [], [*reversed(wrapper["kids"].items())]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        signature, kid = item
        sign = ("*" if kid["lo"] == 0 else "+") if kid["rep"] else "?" if kid["lo"] == 0 else ""
        out.append("(" if sign else "")
        todo.append(f"){sign}" if sign else "")
        if "text" in kid:
            out.append(kid["text"] if kid["text"] is not None else "#TEXT")
        else:
            out.append(f"<{signature}>")
            todo += [f"</{signature.split('.')[0]}>", *reversed(kid["kids"].items())]
    return "".join(out)


def main_text(page: str | None, wrapper: dict | None = None) -> str:
    """The main text of a page of the host that ``wrapper`` describes."""
    reader = Reader()
    blocks: list[tuple] = []  # (rank, fixed, shared, heading, text); rank 0: article, 1: main, 2: other
    run: list[str] = []
    state = {"rank": 2, "drop": False, "node": wrapper, "heading": False, "fixed": True, "shared": True}
    kept_by_stack = ("rank", "drop", "node", "heading")

    def flush():
        text = " ".join(htmllib.unescape("".join(run)).split())
        if text and not state["drop"]:
            blocks.append((state["rank"], state["fixed"], state["shared"], state["heading"], text))
        run.clear()
        state["fixed"] = state["shared"] = True

    def close(n):
        for _ in range(n):
            name, before = reader.stack.pop()
            if name in BLOCKS:
                flush()
            elif before["drop"] != state["drop"] and state["drop"]:
                run[:] = before["run"]  # an inline part that is dropped
            state.update({k: before[k] for k in kept_by_stack})

    for kind, what, attributes in tokens(page or ""):
        if kind == "text":
            run.append(what)
            if what.strip():
                slot = (state["node"] or {}).get("kids", {}).get("#")
                state["fixed"] &= bool(slot and slot["lo"] == 1 and not slot["rep"] and slot["text"] is not None)
                if not state["drop"]:
                    same = slot["same"] if slot else {}
                    state["shared"] &= bool(same) and len(same.get(_digest(_flat(what)), ())) >= EVIDENCE
        elif kind == "start":
            close(reader.pops(what))
            if what in BLOCKS:
                flush()
            if what in VOID:
                run.append(" ")
                continue
            signature, drop, main = marks(what, attributes)
            reader.stack.append((what, {k: state[k] for k in kept_by_stack} | {"run": list(run)
                                 if drop and what not in BLOCKS else ()}))
            rank = state["rank"]
            if not state["drop"] and not drop:
                rank = 0 if what == "article" else min(rank, 1) if main else rank
            header = what == "header" or "header" in signature.split(".")[1:]
            if header:
                drop = True
            if what in HEADINGS and rank == 0 and state["drop"] and _in_header(reader.stack):
                state["drop"] = drop = False
            kids = (state["node"] or {}).get("kids", {})
            state.update(rank=rank, drop=state["drop"] or drop, node=kids.get(signature),
                         heading=state["heading"] or what in HEADINGS)
        else:
            close(reader.end(what))
    flush()
    if not blocks:
        return ""
    rank = min(b[0] for b in blocks)
    chosen = [b for b in blocks if b[0] == rank]
    template = [b[2] or rank == 2 and b[1] for b in chosen]
    told = False  # whether what follows, up to the next heading, holds text of this page's own
    for n in range(len(chosen) - 1, -1, -1):
        if chosen[n][3]:
            template[n] &= rank == 2 or not told
            told = False
        else:
            told |= not template[n]
    own = [b for b, gone in zip(chosen, template, strict=True) if not gone]
    return "\n".join(b[4] for b in own or chosen)


def _in_header(stack) -> bool:
    """Whether only a header drops what stands here."""
    inside = False
    for name, before in stack[:-1]:
        if name == "header" and not before["drop"]:
            inside = True
        elif inside and name in DROPPED:
            return False
    return inside


def _host(url) -> str:
    return parts(url)[0]


def _merge_rows(rows, held, done):
    """Merges sorted ``(key, wrapper)`` rows; ``done`` gets each finished key."""
    for key, wrapper in rows:
        if held and held[0] == key:
            held[1] = merged(held[1], wrapper)
        else:
            if held:
                done(held)
            held[:] = [key, wrapper]


def _page_wrappers(batches, salts):
    salt = TaskContext.get().partitionId()
    for k, batch in enumerate(batches):
        own: dict[str, dict] = {}
        seen: dict[str, set] = {}
        for url, page in zip(batch.column("_url").to_pylist(), batch.column("_html").to_pylist(), strict=True):
            host, wrapper = _host(url), page_wrapper(page or "")
            text = packed(wrapper)
            if (key := hashlib.blake2b(text.encode(), digest_size=16).digest()) in seen.setdefault(host, set()):
                continue  # equal pages add nothing
            seen[host].add(key)
            own[host] = merged(own[host], wrapper) if host in own else wrapper
        yield pa.RecordBatch.from_pydict({
            "host": list(own), "salt": [(salt * 31 + k) % salts] * len(own), "wrapper": [packed(w) for w in own.values()],
        }, schema=pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())]))


def _merged(batches, evidence=0):
    held: list = []
    for batch in batches:
        out: list = []
        rows = zip(zip(batch.column("host").to_pylist(), batch.column("salt").to_pylist(), strict=True),
                   map(unpacked, batch.column("wrapper").to_pylist()), strict=True)
        _merge_rows(rows, held, lambda h, out=out: out.append((*h[0], packed(h[1], evidence))))
        if out:
            yield _rows(out)
    if held:
        yield _rows([(*held[0], packed(held[1], evidence))])


def _rows(out):
    return pa.RecordBatch.from_pylist([{"host": h, "salt": s, "wrapper": w} for h, s, w in out],
                                      schema=pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.string())]))


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = SALTS) -> DataFrame:
    """``(host, wrapper)``: one wrapper (JSON) per host of all its pages."""
    schema = "host string, salt int, wrapper string"
    rows = pages.select(F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).mapInArrow(
        lambda b: _page_wrappers(b, salts), schema)
    salted = rows.repartition("host", "salt").sortWithinPartitions("host", "salt").mapInArrow(_merged, schema)
    whole = salted.withColumn("salt", F.lit(0)).repartition("host").sortWithinPartitions("host").mapInArrow(
        lambda b: _merged(b, EVIDENCE), schema)
    return save(whole.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper")), "wrappers")


def _extract(batches):
    known: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column("_html").to_pylist(), batch.column("_wrapper").to_pylist(), strict=True):
            if wrapper is not None and wrapper not in known:
                if len(known) > 200:
                    known.clear()
                known[wrapper] = unpacked(wrapper)
            texts.append(main_text(page, known.get(wrapper)))
        yield pa.RecordBatch.from_arrays([batch.column("_page"), batch.column("_url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], ["_page", "_url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``_page, _url, text, n_chars`` of every page."""
    wrappers = broadcast_if_small(host_wrappers(pages, url_col, html_col), WRAPPER_ROWS)
    # The host as in url_filter.parts, as a column expression.
    host = F.translate(F.coalesce(F.regexp_extract(F.col(url_col), r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(F.col(id_col).cast("long").alias("_page"), F.col(url_col).alias("_url"),
                        F.col(html_col).alias("_html"), host.alias("_h"))
    rows = rows.join(wrappers, F.col("_h") == F.col("_host"), "left").select("_page", "_url", "_html", "_wrapper")
    return rows.mapInArrow(_extract, "_page long, _url string, text string, n_chars long")
