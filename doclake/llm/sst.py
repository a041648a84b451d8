"""Operator 9: main text of web pages by site style trees.

The pages of a host are merged into one tree: an element node has *style* nodes, each a sequence of children met under it, whose
entries are element nodes again. A node's key hashes its whole path (host, styles, positions, tag with class and id), so pages
build the same keys apart, and merging is counting. Numbers in classes are all one, and ids with a number in them aren't read, as they
name one page's or one entry's element. With m pages through an element and p_i of them in style i:

* presentation importance -sum(p_i log_m p_i), and 1 where m = 1;
* content importance of a text or image leaf 1 - mean over its different contents of log_m(pages with that content);
* composite importance (1 - g^l) presentation + g^l sum(p_i mean(children of style i)), l styles, g = 0.9; a style without
  children has 0, and a style of one page has 1, as all below it does.

An element is noise if its importance and that of all elements below it is under ``THRESHOLD``; the topmost such branches go from
every page. Boilerplate that rotates has a high importance, as each of its contents is met on few pages, so whole branches (an element
with all below it as one content) are compared too: from the root down, siblings in a style that half of the host's pages have, by
1 - content importance, at the least that of the branch they stand in, and of one pair of equal pages. The widest gap between two in
order parts recurring from one-off ones, if it is a factor of ``GAP`` and a ``SHARE`` of the pages have a content met again; what recurs
goes from every page, below the rest the same is done. A host with less than two pairs of equal branches can't be parted so.
Counts cover all pages; a host's nodes met once aren't gathered, as their importance is known to be 1.

Result: ``page_id, host, text, n_nodes, n_removed`` for every page; text has one line per block. Scripts, styles, comments and the
head are not content. Null or empty html gives an empty text; a page with no host is a site by itself; null ids and repeated rows
are kept, each counting as a page; broken markup is read leniently; an empty table gives an empty result; other columns are not read.
Pages of any length are read whole. Ties: of two gaps as wide, the one between more recurring branches counts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, longs, stash

THRESHOLD, DAMPING = 0.2, 0.9
#: Least factor between branches that recur and those that don't, and least share of pages whose branch is met on another page.
GAP, SHARE = 2.0, 0.1
#: Noise branches that a join may broadcast; beyond it pages and branches are shuffled by host.
BROADCAST_ROWS = 500_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template".split())
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s small span strong sub sup time u var".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {t: {"p"} for t in "div ul ol dl table section article nav header footer aside main form h1 h2 h3 h4 h5 h6 pre blockquote hr".split()}
LIMITS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"div", "td", "li", "article", "section", "body", "blockquote"}}
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NUMBER = re.compile(r"\d+")


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    children: list[Node] = field(default_factory=list)
    text: str = ""
    key: int = 0
    style: int = 0


def parse(source: str) -> Node:
    """A lenient tree of elements, texts (tag '') and images."""
    root = Node("body", "body")
    stack = [root]
    at, n, hidden = 0, len(source), 0

    def say(t: str) -> None:
        t = " ".join((entities.unescape(t) if "&" in t else t).split())
        if t and not hidden:
            stack[-1].children.append(Node("", "#text", text=t))

    def cut(k: int) -> None:
        """Close the open elements from the k-th on."""
        nonlocal hidden
        if hidden:
            hidden -= sum(x.tag in DROPPED for x in stack[k:])
        del stack[k:]

    while at < n:
        i = source.find("<", at)
        if i < 0:
            say(source[at:])
            break
        if i > at:
            say(source[at:i])
        if source.startswith("<!--", i):
            j = source.find("-->", i + 4)
            at = n if j < 0 else j + 3
            continue
        if source[i + 1 : i + 2] in ("!", "?"):
            j = source.find(">", i)
            at = n if j < 0 else j + 1
            continue
        m = _TAG.match(source, i)
        if not m:
            say("<")
            at = i + 1
            continue
        at = m.end()
        close, tag, rest = m.group(1), m.group(2).lower(), m.group(3)
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    cut(k)
                    break
            continue
        if tag in ("script", "style"):
            end = re.compile(rf"(?i)</{tag}\s*>").search(source, at)
            at = end.end() if end else n
            continue
        if tag in ("html", "body"):
            while len(stack) > 1 and stack[-1].tag in DROPPED:
                cut(len(stack) - 1)
            continue
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    cut(k)
                    break
                if stack[k].tag in LIMITS.get(tag, ()) or stack[k].tag not in INLINE and tag not in LIMITS:
                    break
        label, content = tag, ""
        if rest and not rest.isspace():
            seen = set()
            for a in _ATTRIBUTE.finditer(rest):
                name = a.group(1).lower()
                if name not in ("class", "id", "src") or name in seen:
                    continue
                seen.add(name)  # of several the first counts
                value = a.group(2) or a.group(3) or a.group(4) or ""
                if name == "src":
                    content = value
                elif name == "class":
                    label += f" class={_NUMBER.sub('0', value.strip())}"
                elif not _NUMBER.search(value):
                    label += f" id={value.strip()}"
        node = Node(tag, label, text=content if tag == "img" else "")
        if not hidden:
            stack[-1].children.append(node)
        if tag not in VOID and not rest.rstrip().endswith("/"):
            stack.append(node)
            hidden += tag in DROPPED
    return root


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def keyed(root: Node, host: str) -> list[tuple[Node, int, int]]:
    """Every node in document order with its parent's style and its depth; keys and styles are set."""
    root.key = _hash(f"site {host}")
    out, todo = [], [(root, 0, 0)]
    while todo:
        node, under, depth = todo.pop()
        out.append((node, under, depth))
        if node.tag and node.tag != "img":
            node.style = _hash(f"{node.key} " + "\x00".join([c.label for c in node.children]))
            for k in range(len(node.children) - 1, -1, -1):
                c = node.children[k]
                c.key = _hash(f"{node.style} {k} {c.label}")
                todo.append((c, node.style, depth + 1))
        else:
            node.style = _hash(f"content {node.text}")
    return out


def _pages(b: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    for host, source in zip(col(b, "host").to_pylist(), col(b, "html").to_pylist(), strict=True):
        yield host, source or ""


def contents(found: list[tuple[Node, int, int]]) -> dict[int, int]:
    """Key of every element of a page -> hash of all below it."""
    out: dict[int, int] = {}
    for x, _, _ in reversed(found):
        if x.tag and x.tag != "img":
            out[x.key] = _hash(f"{x.style} " + " ".join([str(out.get(c.key, c.style)) for c in x.children]))
    return out


def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, under, depth, leaf, style) of every node of every page, and once more of every element with leaf null and its content as style."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            hosts, node, under, depth, leaf, style = [], [], [], [], [], []
            for host, source in _pages(b.slice(at, 500)):
                all_nodes = keyed(parse(source), host)
                whole = contents(all_nodes)
                for x, u, d in all_nodes:
                    for is_leaf, s in ((False, x.style), (None, whole[x.key])) if x.key in whole else ((True, x.style),):
                        hosts.append(host)
                        node.append(x.key)
                        under.append(u)
                        depth.append(d)
                        leaf.append(is_leaf)
                        style.append(s)
            if node:
                yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(node, pa.int64()), pa.array(under, pa.int64()), pa.array(depth, pa.int32()), pa.array(leaf), pa.array(style, pa.int64())], ["host", "node", "under", "depth", "leaf", "style"])


def noise(nodes_of: dict[int, tuple[int, int, bool, list[tuple[int, int]], int, float]], threshold: float) -> list[int]:
    """Topmost noise among one host's shared nodes: node -> (under, depth, leaf, styles met more than once, pages, sum of leaf logs)."""
    below: dict[int, list[int]] = {}
    for k, v in nodes_of.items():
        below.setdefault(v[0], []).append(k)
    value: dict[int, float] = {}
    quiet: dict[int, bool] = {}
    for k in sorted(nodes_of, key=lambda k: -nodes_of[k][1]):
        _, _, leaf, styles, m, kinds = nodes_of[k]
        log = np.log(m)
        if leaf:
            shared = sum(np.log(n) / log for _, n in styles)
            value[k] = 1 - shared / kinds
            quiet[k] = value[k] < threshold
            continue
        single = m - sum(n for _, n in styles)
        own = -sum(n / m * np.log(n / m) / log for _, n in styles) + single / m
        inner, calm = single / m, single == 0
        for s, n in styles:
            children = below.get(s, [])
            # children of a style of several pages are all met as often, so all of them are here
            inner += n / m * (sum(value[c] for c in children) / len(children) if children else 0.0)
            calm &= all(quiet[c] for c in children)
        g = DAMPING**kinds
        value[k] = (1 - g) * own + g * inner
        quiet[k] = bool(calm and value[k] < threshold)
    parent = {s: k for k, v in nodes_of.items() if not v[2] for s, _ in v[3]}
    return [k for k in nodes_of if quiet[k] and not quiet.get(parent.get(nodes_of[k][0], 0), False)]


def recurring(nodes_of: dict[int, tuple[int, int, bool, list[tuple[int, int]], int, float]], whole: dict[int, tuple[list[tuple[int, int]], int, float]], threshold: float) -> list[int]:
    """Topmost branches of one host that recur, told by the widest gap; whole: element -> (contents met more than once, pages, contents)."""
    root = next((k for k, v in nodes_of.items() if v[1] == 0), None)
    if root is None:
        return []
    pages = nodes_of[root][4]
    below: dict[int, list[int]] = {}
    for k, v in nodes_of.items():
        below.setdefault(v[0], []).append(k)

    def repeat(k: int) -> tuple[float, float]:
        """1 - content importance, and the share of pages whose content is met again."""
        again, m, kinds = whole[k] if k in whole else nodes_of[k][3:]
        return float(sum(np.log(n) for _, n in again) / np.log(m) / kinds), sum(n for _, n in again) / m

    out, todo = [], [root]
    while todo:
        k = todo.pop()
        if nodes_of[k][2]:
            continue
        for s, n in nodes_of[k][3]:
            if 2 * n < pages:
                continue
            floor = max(float(np.log(2) / np.log(n) / max(n - 1, 1)), repeat(k)[0])
            # what is under the importance limit by itself isn't compared
            some = {c: (max(r, floor), share) for c in below.get(s, []) for r, share in [repeat(c)] if 1 - r >= threshold}
            order = [floor, *sorted(r for r, _ in some.values())]
            wide, limit = max(((b / a, b) for a, b in zip(order, order[1:], strict=False)), default=(0.0, 0.0))
            for c, (r, share) in some.items():
                if wide >= GAP and r >= limit and share >= SHARE:
                    out.append(c)
                else:
                    todo.append(c)
    return out


def branches(key: tuple, batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, int, bool, list[tuple[int, int]], int, float]] = {}
    whole: dict[int, tuple[list[tuple[int, int]], int, float]] = {}
    for b in batches:
        styles = col(b, "styles").to_pylist()
        for k, u, d, leaf, m, kinds, s in zip(longs(b, "node"), longs(b, "under"), longs(b, "depth"), col(b, "leaf").to_pylist(), longs(b, "pages"), longs(b, "kinds"), styles, strict=True):
            some = [(x["style"], x["n"]) for x in s or []]
            if leaf is None:
                whole[int(k)] = (some, int(m), float(kinds))
            else:
                found[int(k)] = (int(u), int(d), leaf, some, int(m), float(kinds))
    out = sorted({*noise(found, threshold), *recurring(found, whole, threshold)})
    yield pa.record_batch([pa.array([key[0].as_py()] * len(out), pa.string()), pa.array(out, pa.int64())], ["host", "node"])


def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            texts, total, gone = [], [], []
            for (host, source), bad in zip(_pages(part), col(part, "gone").to_pylist(), strict=True):
                bad = frozenset(bad or ())
                all_nodes = keyed(parse(source), host)
                lines: list[str] = [""]
                kept = 0
                todo: list[Node | None] = [all_nodes[0][0]]
                while todo:
                    x = todo.pop()
                    if x is None:
                        lines.append("")
                        continue
                    if x.key in bad:
                        continue
                    kept += 1
                    if not x.tag:
                        lines[-1] += (" " if lines[-1] else "") + x.text
                        continue
                    block = x.tag not in INLINE
                    if block:
                        lines.append("")
                        todo.append(None)
                    todo.extend(reversed(x.children))
                texts.append("\n".join(t for t in lines if t))
                total.append(len(all_nodes))
                gone.append(len(all_nodes) - kept)
            yield pa.record_batch([col(part, "page_id"), col(part, "site"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["page_id", "host", "text", "n_nodes", "n_removed"])


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Text of every page; see the module's docstring."""
    site = F.nullif(F.regexp_extract(F.lower(F.col("url").cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), site.alias("site"), F.col("html").cast("string").alias("html"))
    alone = F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.md5(F.col("html")), F.lit("")))
    pages = pages.withColumn("host", F.coalesce("site", alone))
    met = pages.where("site is not null").select("host", "html").mapInArrow(nodes, "host string, node long, under long, depth int, leaf boolean, style long")
    styles = met.groupBy("host", "node", "under", "depth", "leaf", "style").agg(F.count("*").alias("n"))
    shared = styles.groupBy("host", "node", "under", "depth", "leaf").agg(
        F.sum("n").alias("pages"), F.count("*").alias("kinds"), F.collect_list(F.when(F.col("n") > 1, F.struct("style", "n"))).alias("styles")
    )
    shared = shared.where("pages > 1").select("host", "node", "under", "depth", "leaf", "pages", "kinds", "styles")

    def found(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from branches(key, batches, threshold)

    bad = stash(shared.groupBy("host").applyInArrow(found, "host string, node long"), "branches", slim=True)
    small = bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    bad = bad.groupBy("host").agg(F.collect_list("node").alias("gone"))
    joined = pages.join(F.broadcast(bad) if small else bad, "host", "left")
    return joined.mapInArrow(render, "page_id long, host string, text string, n_nodes long, n_removed long")
