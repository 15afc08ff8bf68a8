"""HTML extraction by union-free regular-expression inference.

A page is a stream of tokens, its blocks of text with the elements around them. The streams of a host's pages are aligned one after another:
where they differ, a text becomes a slot, a block of one side only becomes optional, and blocks or runs of up to RUN blocks that
follow upon their like become a repeated group. What results is the host's wrapper, a union-free expression whose size
follows the host's templates and not its pages, so wrappers are folded within each task and then merged, in two steps, wherever the
pages lie. A page is then matched to its host's wrapper, token by token, and the wrapper tells what each block is: text that is the same on three
different pages or more is the template's, groups of links are menus, slots are the article's; if most of what varies lies
in article or main elements, that is where the article is, whole. Elements whose names say what they are (footers, adverts, comments) are no tokens.

Defined results: null, empty and text-free pages give an empty text; null and odd urls are one host; a block that the wrapper lacks is
judged by its own links and place; a page that is template for the most part (all pages of its host being alike) keeps that too; a page
that would be left without text gives all its blocks; pages may be nested to any depth; repeated rows are read each; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise
from .html import Block, blocks, parse

#: Roles of all hosts' tokens go to the pages by broadcast up to this size, beyond it by a join on the host.
BROADCAST_BYTES = 32 << 20
_SALTS = 64
#: Blocks of a run that can be repeated as a whole; cells of an alignment beyond which equal blocks are paired in order; different pages that make a template.
RUN, CELLS, PAGES = 4, 250_000, 3
_VARIES = -1

# A wrapper is a list of tokens: [path, skip, optional, repeated, slot, text, links, pages]; slot is a text's hash, or _VARIES;
# text and links count characters over all pages, pages holds hashes of up to PAGES different ones.
PATH, SKIP, OPTIONAL, REPEATED, SLOT, TEXT, LINKS, SEEN = range(8)
# What a token is: no part of the article, a part of it, or the template's.
DROP, KEEP, CONSTANT = range(3)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def hash_text(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) << 20 ^ len(text)


def wrapper_of(page: list[Block]) -> tuple[list[list], list[list[int]]]:
    """A page's own wrapper, and the blocks of each of its tokens."""
    whole = [hash_text("\n".join(b.text for b in page))]
    out: list[list] = []
    members: list[list[int]] = []
    for k, b in enumerate(page):
        out.append([list(b.path), b.skip, False, False, hash_text(b.text), len(b.text), b.links, whole])
        members.append([k])
        _fold(out, members)
    return out, members


def _key(token: list) -> tuple:
    return (tuple(token[PATH]), token[SKIP])


def _alike(x: list[list], y: list[list]) -> bool:
    return all(a[PATH] == b[PATH] and a[SKIP] == b[SKIP] for a, b in zip(x, y, strict=True))


def _fold(out: list[list], members: list[list[int]] | None = None) -> None:
    """Let the last tokens become one repeated group with their like just before them."""
    for n in range(1, RUN + 1):
        if len(out) >= 2 * n and _alike(out[-n:], out[-2 * n : -n]):
            tail = out[-n:]
            del out[-n:]
            for k, y in enumerate(tail):
                x = out[k - n]
                slot = _VARIES if _VARIES in (x[SLOT], y[SLOT]) else (x[SLOT] * 1_000_003 + y[SLOT]) & 0x7FFFFFFFFFFF
                out[k - n] = _both(x, y, slot, True)
            if members is not None:
                more = members[-n:]
                del members[-n:]
                for k, own in enumerate(more):
                    members[k - n] += own
            return


def _both(x: list, y: list, slot: int, repeated: bool) -> list:
    return [x[PATH], x[SKIP], x[OPTIONAL] or y[OPTIONAL], x[REPEATED] or y[REPEATED] or repeated, slot, x[TEXT] + y[TEXT], x[LINKS] + y[LINKS], sorted({*x[SEEN], *y[SEEN]})[:PAGES]]


def merge(a: list[list], b: list[list]) -> list[list]:
    """The union-free generalisation of two wrappers."""
    out: list[list] = []
    for x, y in _aligned(a, b):
        if x is not None and y is not None:
            out.append(_both(x, y, x[SLOT] if x[SLOT] == y[SLOT] else _VARIES, False))
        else:
            only = list(y if x is None else x)
            only[OPTIONAL] = True
            out.append(only)
        _fold(out)
    return out


def _aligned(a: list[list], b: list[list]) -> list[tuple[list | None, list | None]]:
    """Pairs of equal tokens in order, the rest alone: equal ends first, then a longest common subsequence, or in long streams each token with the next equal one."""
    x, y = [_key(t) for t in a], [_key(t) for t in b]
    low, n, m = 0, len(a), len(b)
    while low < n and low < m and x[low] == y[low]:
        low += 1
    while n > low and m > low and x[n - 1] == y[m - 1]:
        n, m = n - 1, m - 1
    pairs = [(k, k) for k in range(low)]
    if (n - low) * (m - low) <= CELLS:
        best = [[0] * (m - low + 1) for _ in range(n - low + 1)]
        for i in range(n - 1, low - 1, -1):
            row, below = best[i - low], best[i - low + 1]
            for j in range(m - 1, low - 1, -1):
                row[j - low] = below[j - low + 1] + 1 if x[i] == y[j] else max(below[j - low], row[j - low + 1])
        i, j = low, low
        while i < n and j < m:
            if x[i] == y[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i - low + 1][j - low] >= best[i - low][j - low + 1]:
                i += 1
            else:
                j += 1
    else:
        where, j = _places(y[:m]), low
        for i in range(low, n):
            at = where.get(x[i], ())
            k = bisect_left(at, j)
            if k < len(at):
                pairs.append((i, at[k]))
                j = at[k] + 1
    pairs += [(n + k, m + k) for k in range(len(a) - n)]
    out: list[tuple[list | None, list | None]] = []
    i = j = 0
    for p, q in [*pairs, (len(a), len(b))]:
        out += [(t, None) for t in a[i:p]] + [(None, t) for t in b[j:q]]
        if p < len(a):
            out.append((a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def _places(keys: list[tuple]) -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = defaultdict(list)
    for k, key in enumerate(keys):
        out[key].append(k)
    return out


def _menu(text: int, links: int) -> bool:
    return 10 * links >= 8 * text


def _article(path: list[str] | tuple[str, ...]) -> tuple[str, ...] | None:
    """The path's part up to the outermost article or main element."""
    at = next((k for k, sign in enumerate(path) if sign.split(".")[0] in ("article", "main")), None)
    return None if at is None else tuple(path[: at + 1])


def roles_of(wrapper: list[list]) -> dict:
    """``region`` (the path of article or main elements that hold most of what varies, or none) and, for each token, its path, skip and role."""
    varies = lambda t: t[SLOT] == _VARIES or len(t[SEEN]) < PAGES
    slots = [t for t in wrapper if varies(t) and not _menu(t[TEXT], t[LINKS])]
    weight = lambda tokens: sum(t[TEXT] for t in tokens)
    # names in doubt do not hide what most of the host's text stands under
    least = 0 if weight(t for t in slots if t[SKIP] == 0) >= weight(t for t in slots if t[SKIP] == 1) else 1
    slots = [t for t in slots if t[SKIP] <= least]
    held: dict[tuple[str, ...], int] = defaultdict(int)
    for t in slots:
        if (at := _article(t[PATH])) is not None:
            held[at] += t[TEXT]
    region = max(held, key=lambda k: (held[k], k), default=None)
    if region is not None and 2 * held[region] < weight(slots):
        region = None
    doubt = least == 1
    roles = []
    for t in wrapper:
        role = _role(t[PATH], t[SKIP], t[TEXT], t[LINKS], region, doubt)
        roles.append([t[PATH], t[SKIP], CONSTANT if role == KEEP and region is None and not varies(t) else role])
    return {"region": region, "doubt": doubt, "roles": roles}


def _role(path: list[str] | tuple[str, ...], skip: int, text: int, links: int, region: tuple[str, ...] | None, doubt: bool) -> int:
    if skip and not doubt:
        return DROP
    if region is not None:
        if tuple(path[: len(region)]) == tuple(region):
            return KEEP
        return KEEP if path and path[-1].split(".")[0] == "h1" and _article(path) is None else DROP
    return DROP if _menu(text, links) else KEEP


class Reader:
    """Pages of one host, matched to its wrapper."""

    def __init__(self, found: dict) -> None:
        self.region, self.doubt = found["region"], found["doubt"]
        self.roles = [role for _, _, role in found["roles"]]
        self.where = _places([(tuple(path), skip) for path, skip, _ in found["roles"]])

    def match(self, tokens: list[list]) -> list[int]:
        """The role of each of the page's tokens: the next equal one's in the wrapper; it may stand before, in a group that is repeated."""
        out, j = [], 0
        for t in tokens:
            at = self.where.get(_key(t), ())
            if at:
                k = bisect_left(at, j)
                j = at[k] if k < len(at) else at[0]
                out.append(self.roles[j])
            else:
                out.append(_role(t[PATH], t[SKIP], t[TEXT], t[LINKS], self.region, self.doubt))
        return out

    def read(self, page: list[Block]) -> str:
        tokens, members = wrapper_of(page)
        role = [DROP] * len(page)
        for r, own in zip(self.match(tokens), members, strict=True):
            for k in own:
                role[k] = r
        size = lambda r: sum(len(b.text) for b, x in zip(page, role, strict=True) if x == r)
        least = (KEEP, CONSTANT) if size(CONSTANT) >= size(KEEP) else (KEEP,)
        return "\n".join(b.text for b, r in zip(page, role, strict=True) if r in least) or "\n".join(b.text for b in page)


def extract(html: str | None, reader: Reader | None) -> str:
    """The article of one page, given its host's reader; without one the page is its own host."""
    if not html:
        return ""
    page = blocks(parse(html))
    return (reader or Reader(roles_of(wrapper_of(page)[0]))).read(page)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    for batch in batches:
        for host, html in zip(batch.column(0), batch.column(1), strict=True):
            if html.is_valid and len(html.as_py()):
                page, host = wrapper_of(blocks(parse(html.as_py())))[0], host.as_py()
                if page:
                    held[host] = merge(held[host], page) if host in held else page
    if held:
        yield pa.RecordBatch.from_pydict({"host": list(held), "wrapper": [json.dumps(w) for w in held.values()]}, pa.schema([("host", pa.string()), ("wrapper", pa.string())]))


def _merged(pdf):
    whole = None
    for text in pdf["wrapper"]:
        one = json.loads(text)
        whole = one if whole is None else merge(whole, one)
    return pdf[["host"]].iloc[:1].assign(wrapper=json.dumps(whole))


def _told(pdf):
    out = _merged(pdf)
    return out[["host"]].assign(roles=json.dumps(roles_of(json.loads(out["wrapper"].iloc[0]))))


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, wrapper`` (JSON), partly merged: a row for each host and task at first, at most one for each host and salt here."""
    parts = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(_infer, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.monotonically_increasing_id().bitwiseXOR(F.shiftright(F.monotonically_increasing_id(), 33)), F.lit(_SALTS)))
    return salted.groupBy("host", "salt").applyInPandas(_merged, "host string, wrapper string")


def infer_roles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, roles``: what each token of the host's wrapper is, as JSON."""
    return infer_wrappers(pages, url, html).groupBy("host").applyInPandas(_told, "host string, roles string")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, Reader | None] = {None: None}
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            texts = []
            for html, roles in zip(batch.column(2), batch.column(3), strict=True):
                key = roles.as_py()
                if key not in known:
                    if len(known) > 1000:
                        known = {None: None}
                    known[key] = Reader(json.loads(key))
                texts.append(extract(html.as_py(), known[key]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"]
            )


def extract_articles(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` for each page."""
    roles = materialise(infer_roles(pages, url, html), "roles")
    size = roles.agg(F.sum(F.octet_length("host") + F.octet_length("roles"))).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(roles), "host", "left")
    else:
        rows = lookup(rows, roles, "host")
    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.select("id", "url", "html", "roles").mapInArrow(_read, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url)
