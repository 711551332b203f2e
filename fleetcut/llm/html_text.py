"""Main-text extraction from HTML by a minimum cut: classifier costs against smoothness between near blocks."""

from __future__ import annotations

import html
import re
from collections import deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcut.llm import _common as C

#: Pages that train the block classifier, at most.
TRAIN_PAGES = 3000
#: Smoothness: capacity between neighbours in page order that share a parent (halved for each further step apart in the DOM), and
#: between consecutive blocks of one parent with others between them.
NEXT, SIBLING = 0.6, 0.4
#: What one block's markup weighs, and how fast it is tied to the element that says so: names of boilerplate lie less often.
SAYS = {1: (1.2, 1.5), -1: (2.8, 3.2)}
#: The text costs of a block lie between these; text without links is weak evidence against a block.
LOWEST, LOWEST_UNLINKED, HIGHEST = -2.5, -1.0, 1.6
#: Prior log odds of each feature's bins, to which learned ones are shrunk: words (0, 1, 2-3, 4-7, ...), share of linked text, ends of
#: sentences a word, last character, share of the page's text that stands before.
PRIOR = ((-0.6, -0.4, -0.3, -0.1, 0.2, 0.6, 1.0, 1.3), (0.8, -1.0, -2.5), (-0.2, 0.2, 0.3), (-0.1, 0.2), (-0.1, 0.0, 0.0, -0.1))
SHRINK = 20.0

# Element names of the HTML standard by role, and words that sites use in classes and ids.
RAW = frozenset("script style template noscript iframe svg textarea select object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img nobr center".split()
)
HEAD = frozenset("head title meta link base".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form button menu dialog".split())
#: Boilerplate tags that no page is wrapped in.
NEVER_WRAPS = frozenset("nav footer aside button menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu header footer sidebar aside ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal "
    "comment comments disqus respond reply replies share sharing social related breadcrumb breadcrumbs pagination pager newsletter subscribe subscription login signup search form widget".split()
)
CONTENT_WORDS = frozenset("article main content post entry story body text".split())
NEUTRAL_WORDS = frozenset("area bar block box bottom center col column container global group holder inner item items left list outer page panel primary right row secondary section site top wrap wrapper".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[a-z]+")
_HEADING = re.compile("h[1-6]$")


#: Elements inside one another, at most, as browsers have a bound; what is nested deeper counts as beside one another, its text stays.
DEEPEST = 128


class Block(NamedTuple):
    text: str
    tag: str
    path: tuple[int, ...]
    linked: int
    says: int
    by: int


def _says(name: str, names: list[str], inside: bool) -> int:
    """What an element says of its text by its tag and its class, id and role names: 1 content, -1 boilerplate, 0 nothing. A name counts
    if all its parts are known words; one part of boilerplate decides it. The header of an article says nothing."""
    if name in ("html", "body"):
        return 0
    known = [set(p) for p in map(_PART.findall, names) if p and all(w in CONTENT_WORDS or w in BOILERPLATE_WORDS or w in NEUTRAL_WORDS for w in p)]
    other = any(p & BOILERPLATE_WORDS for p in known)
    content = any(p & CONTENT_WORDS and not p & BOILERPLATE_WORDS for p in known)
    if name in BOILERPLATE_TAGS:
        return 0 if name == "header" and inside and not other else -1
    if name in CONTENT_TAGS:
        return 0 if other and not content else 1
    return content - other


def _nearest(found: list[tuple[Block, list[tuple[str, int, int]]]]) -> list[Block]:
    """The blocks with the nearest ancestor that says something, and what. An element is a wrapper of the page, and its
    boilerplate names say nothing, if it holds most of the text and no text outside it is said to be content."""
    size: dict[int, int] = {}
    content: dict[int, int] = {}
    total = told = 0
    for b, stack in found:
        n = len(b.text)
        inside = n if any(said > 0 for _, _, said in stack) else 0
        total, told = total + n, told + inside
        for _, i, said in stack:
            if said < 0:
                size[i], content[i] = size.get(i, 0) + n, content.get(i, 0) + inside
    wraps = {i for i, n in size.items() if 2 * n > total and content[i] == told}
    out = []
    for b, stack in found:
        by, says = next(((i, said) for name, i, said in reversed(stack) if said > 0 or (said < 0 and (i not in wraps or name in NEVER_WRAPS))), (0, 0))
        out.append(b._replace(by=by, says=says))
    return out


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order. Raw elements, comments and the head have none; a line break is white space;
    unclosed and stray tags are taken as browsers do, roughly: a block element ends an open paragraph. No tag ends after the page's last `>`, so the search
    for tags ends there, and time grows with the page's length whatever it holds; of what follows, only text before a comment is read."""
    out: list[tuple[Block, list[tuple[str, int, int]]]] = []
    stack: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked, links, serial, at, limit = 0, 0, 0, 0, page.rfind(">") + 1

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not any(t in HEAD for t, _, _ in stack):
                out.append((Block(text, stack[-1][0] if stack else "", tuple(i for _, i, _ in stack), min(linked, len(text)), 0, 0), [x for x in stack if x[2]]))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text)

    while m := _TOKEN.search(page, at, limit):
        say(page[at : m.start()])
        at = m.end()
        closing, name, attrs = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not name:
            continue
        name = name.lower()
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name in INLINE:
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            links = 0
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/") or name not in ("svg", "object"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at, limit)
                at = end.end() if end else len(page)
            continue
        if name == "body" or (name not in HEAD and name != "html"):
            while stack and stack[-1][0] in HEAD:
                stack.pop()
        while stack and stack[-1][0] in ("p", "dt", "dd") or (stack and name == "li" and stack[-1][0] == "li"):
            stack.pop()
        if name not in VOID and len(stack) < DEEPEST:
            serial += 1
            said = " ".join(x.strip("\"'") for x in _ATTRIBUTE.findall(attrs)).lower() if "=" in attrs else ""
            stack.append((name, serial, _says(name, said.split(), any(t in CONTENT_TAGS for t, _, _ in stack))))
    rest = page.find("<!--", at)
    say(page[at : rest if rest >= 0 else len(page)])
    flush()
    return _nearest(out)


def features(found: list[Block]) -> list[tuple[int, ...]]:
    """Bins of what each block's text, its links and its place on the page say; no markup names."""
    total, before, out = sum(len(b.text) for b in found), 0, []
    for b in found:
        n, words = len(b.text), b.text.count(" ") + 1
        stops = sum(map(b.text.count, ".!?"))
        out.append((
            min(7, words.bit_length()), 0 if 4 * b.linked < n else 1 if 4 * b.linked < 3 * n else 2, 0 if not stops else 1 if 20 * stops < words else 2,
            int(b.text[-1] in ".!?:;\"'"), min(3, 4 * before // max(1, total)),
        ))
        before += n
    return out


def costs(found: list[Block], weights: tuple[tuple[float, ...], ...]) -> list[float]:
    """Log odds of being content that the classifier gives each block for its text."""
    out = []
    for f in features(found):
        s = sum(w[i] for w, i in zip(weights, f, strict=True))
        out.append(min(HIGHEST, max(LOWEST if f[1] else LOWEST_UNLINKED, s)))
    return out


def fit(patterns: dict[tuple[int, ...], tuple[int, int]], rounds: int = 25) -> tuple[tuple[float, ...], ...]:
    """Logistic regression on bins with a Gaussian prior around PRIOR, by Newton steps. patterns: (content, not content) blocks of each
    combination of bins; there are at most as many as the bins' product."""
    import numpy as np

    sizes = [len(p) for p in PRIOR]
    prior = np.concatenate([np.array(p) for p in PRIOR])
    keys = sorted(patterns)
    x = np.zeros((len(keys), sum(sizes)))
    for at, i in zip(np.cumsum([0, *sizes[:-1]]), range(len(sizes)), strict=True):
        x[np.arange(len(keys)), [at + k[i] for k in keys]] = 1
    yes, n = np.array([patterns[k][0] for k in keys], float), np.array([sum(patterns[k]) for k in keys], float)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (yes - n * p) - SHRINK * (w - prior)
        w += np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + SHRINK * np.eye(len(w)), slope)
    return tuple(tuple(x.tolist()) for x in np.split(w, np.cumsum(sizes)[:-1]))


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the scores lost plus the edges cut; ties are not content. A node whose score outweighs all its
    edges keeps its sign in some optimum, so only the others enter the flow network; max-flow by Dinic's algorithm."""
    n = len(scores)
    around = [0.0] * n
    for a, b, c in edges:
        around[a] += c
        around[b] += c
    label = [s > 0 for s in scores]
    free = [i for i in range(n) if abs(scores[i]) < around[i]]
    if not free:
        return label
    index = {v: i for i, v in enumerate(free)}
    pull = [scores[v] for v in free]
    s, t = len(free), len(free) + 1
    head: list[list[int]] = [[] for _ in range(len(free) + 2)]
    to: list[int] = []
    cap: list[float] = []

    def link(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to)), to.append(b), cap.append(there)
        head[b].append(len(to)), to.append(a), cap.append(back)

    for a, b, c in edges:
        if a in index and b in index:
            link(index[a], index[b], c, c)
        elif a in index or b in index:
            inside, fixed = (a, b) if a in index else (b, a)
            pull[index[inside]] += c if label[fixed] else -c
    for i, p in enumerate(pull):
        if p > 0:
            link(s, i, p, 0.0)
        elif p < 0:
            link(i, t, -p, 0.0)
    while True:
        level = [-1] * len(head)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        tried = [0] * len(head)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                v = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[v] < len(head[v]):
                e = head[v][tried[v]]
                if cap[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                tried[v] += 1
            else:
                if v == s:
                    break
                e = path.pop()
                v = to[e ^ 1]
                tried[v] += 1
                continue
            path.append(e)
            v = to[e]
    for v, i in index.items():
        label[v] = level[i] >= 0
    return label


def network(found: list[Block], scores: list[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Nodes and edges of the cut: the blocks with their text costs, then the elements whose names say what they hold, each with the
    weight of its blocks. A block is tied to that element, to its neighbour in page order and to the block before it of one parent."""
    scores, edges, element, last = list(scores), [], {}, {}
    for i, b in enumerate(found):
        if i:
            one, two = found[i - 1].path, b.path
            same = next((k for k, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))
            edges.append((i - 1, i, NEXT * 0.5 ** max(0, len(one) + len(two) - 2 * same - 2)))
        parent = b.path[:-1]
        if last.get(parent, i - 1) < i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
        if b.says:
            weight, tie = SAYS[b.says]
            node = element.setdefault(b.by, len(found) + len(element))
            if node == len(scores):
                scores.append(0.0)
            scores[node] += weight * b.says
            edges.append((i, node, tie))
    return scores, edges


def labels(found: list[Block], weights: tuple[tuple[float, ...], ...] = PRIOR) -> list[bool]:
    """Which blocks the minimum cut leaves on the side of the content."""
    return min_cut(*network(found, costs(found, weights)))[: len(found)]


def main_text(page: str, weights: tuple[tuple[float, ...], ...] = PRIOR, headings: bool = True) -> str:
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, labels(found, weights), strict=True) if keep and (headings or not _HEADING.match(b.tag)))


def learn(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> tuple[tuple[float, ...], ...]:
    """The classifier's weights, from the blocks of a bounded sample of pages whose markup says what they are; its names are
    labels here, not features. The driver gets a count for each combination of bins. Without such blocks: PRIOR."""
    C.small_batches(pages.sparkSession)
    total = pages.count()
    few = pages.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, train_pages / max(1, total)))))

    def run(batches):
        import pyarrow as pa

        seen: dict[tuple[tuple[int, ...], int], int] = {}
        for batch in batches:
            for page in batch.column(0):
                found = blocks(page.as_py() or "")
                for f, b in zip(features(found), found, strict=True):
                    if b.says:
                        seen[f, b.says] = seen.get((f, b.says), 0) + 1
        keys = list(seen)
        cols = [pa.array([list(k[0]) for k in keys], pa.list_(pa.int32())), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["f", "h", "n"])
        C.trim()

    side = lambda h: F.sum(F.when(F.col("h") == h, F.col("n")).otherwise(0))
    counts = few.select("html").mapInArrow(run, "f array<int>, h int, n long").groupBy("f").agg(side(1).alias("yes"), side(-1).alias("no"))
    return fit({tuple(r["f"]): (r["yes"], r["no"]) for r in counts.collect()})


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES, headings: bool = True,
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), and further columns to keep, by their names.

    Every page is cut whole; ties of the cut are not content; headings are left out if asked. Null or empty HTML, and a page without
    content, give empty text. Repeated rows give a row each; an empty table none; other columns are ignored. Only the
    classifier's training reads a bounded sample (train_pages pages).
    """
    import pyarrow as pa

    C.small_batches(pages.sparkSession)
    more = [c.alias(name) for name, c in (keep or {}).items()]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), *more)
    weights = learn(rows, train_pages)
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), *rows.schema.fields[3:]])

    def run(batches):
        for batch in batches:
            for part in C.slices(batch, 2, 64):
                texts = [main_text(p.as_py() or "", weights, headings) for p in part.column(2)]
                cols = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())
        C.trim()

    return rows.mapInArrow(run, schema)
