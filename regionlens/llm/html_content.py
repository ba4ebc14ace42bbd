"""Main text of web pages by the maximum-scoring subsequence, with all weights learned from labelled pages.

A page becomes a sequence of blocks of text and tags in one pass. Each word of a block scores the log odds that the block
is content, positive in content and negative in boilerplate; tags score negative, the more the commoner they are in
boilerplate. One linear scan finds the contiguous region with the highest sum; of its blocks those that score positive
are the text. But for elements that hold no text of a page (`HIDDEN`) nothing is removed by its name: what a name, a class word, a heading or the shape of a
block says is a weight.

The weights are fitted to two kinds of labelled pages: those of the table that mark their own article (`article` or
`main`), and layouts made by rule (`layouts`). Every block is shown to the model several times, also without the mark, without class words
and by its shape alone, so that pages that mark nothing are understood as well.

Character references are decoded; white space in a block becomes one space; blocks are joined by two line ends.
Null and empty pages, and pages without a block that scores positive, give an empty text of 0 characters. Broken markup is
read as far as it goes. Repeated rows and null page ids are kept as they are. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import ship, slices

#: Labelled pages of the table that the weights are fitted to, at most: more pages change them little.
LABELLED_PAGES = 4000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style head title noscript template svg math iframe object canvas audio video map textarea select".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
MARKED = ("article", "main")
PART = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^"'>])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
NAMED = re.compile(r"""(?:\bclass|\bid|\brole)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"([a-z])([A-Z])")
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Score of a word at least and at most; words that a boilerplate block counts at most. Boilerplate costs little, so that a long part of it
#: does not cut an article in two: its blocks are left out by their sign.
SCORES, CROSSED = (-0.3, 3.0), 10
#: Costs of a tag: least, most, of one never seen.
TAG_COSTS = (0.01, 0.2, 0.05)
ROUNDS, RATE, SHRINK = 400, 0.5, 1e-4


@dataclass(slots=True)
class Block:
    """Text between two block tags: what is known of it, and whether the page marks it as its article."""

    features: frozenset[str]
    inside: bool
    text: str
    words: int


@lru_cache(1 << 16)
def class_words(value: str) -> frozenset[str]:
    """Features of one class, id or role: its words, and the whole if it has several."""
    found = set()
    for name in value.strip("\"'").split():
        words = LETTERS.findall(CAMEL.sub(r"\1 \2", name).lower())
        found.update(words)
        found.add("-".join(words))
    return frozenset(f"class={w}" for w in found if w)


def parse(page: str) -> list[Block | tuple[str, bool]]:
    """Blocks and tags (name, inside the marked article) of a page, in order."""
    out: list[Block | tuple[str, bool]] = []
    root = ("", False, False, frozenset(), "body", False)  # name, hidden, inside, context, block, link
    stack: list[tuple[str, bool, bool, frozenset[str], str, bool]] = []
    top, pieces, words, linked = root, [], 0, 0
    under, level = "", 0  # a short heading and the depth of the element that it is in

    def flush() -> None:
        nonlocal pieces, words, linked, under, level
        if words:
            text = " ".join("".join(pieces).split())
            count = len(text.split(" "))
            if top[4] in ("h2", "h3", "h4", "h5", "h6"):
                said = LETTERS.findall(text.lower())
                under, level = (" ".join(said) if len(said) <= 3 else ""), len(stack) - 1
            own = {f"block={top[4]}", f"size={(count > 3) + (count > 14)}"}
            if under:
                own.add(f"under={under}")
            if 2 * linked > words:
                own.add("links")
            out.append(Block(top[3] | own, top[2], text, count))
        pieces, words, linked = [], 0, 0

    at, end = 0, len(page)
    while at < end:
        found = PART.search(page, at)
        upto = found.start() if found else end
        if upto > at and not top[1]:
            piece = unescape(page[at:upto])
            n = len(piece.split())
            pieces.append(piece)
            words += n
            linked += n if top[5] else 0
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(found[1] or found[4]), found[3] or found[6] or ""
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name in BLOCKS and not top[1]:
                flush()
            elif depth is not None and any(s[0] in BLOCKS for s in stack[depth + 1 :]):
                continue  # an inline element closed inside another block
            if depth is not None:
                del stack[depth:]
                top = stack[-1] if stack else root
                if len(stack) < level:
                    under = ""
            if not top[1]:
                out.append((name, top[2]))
            continue
        if name in BLOCKS and not top[1]:
            flush()
        elif name == "br":
            pieces.append(" ")
        if not top[1]:
            out.append((name, top[2]))
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name in CLOSES and stack and stack[-1][0] in CLOSES[name]:
            stack.pop()
            top = stack[-1] if stack else root
        if name in RAW:  # its text may look like markup
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        _, hidden, inside, context, block, link = top
        if name in BLOCKS:
            block = name
            if name not in ("html", "body"):
                own = frozenset().union(*map(class_words, NAMED.findall(attributes))) if attributes else frozenset()
                if name not in MARKED:
                    own |= {f"in={name}"}
                context = context if own <= context else context | own
        hidden = name != "body" and (hidden or name in HIDDEN)
        top = (name, hidden, inside or name in MARKED, context, block, link or name == "a")
        stack.append(top)
    flush()
    return out


def seen(parts: list[Block | tuple[str, bool]]) -> list[frozenset[str]]:
    """The features of the blocks, with their place to the article if the page marks it."""
    blocks = [p for p in parts if isinstance(p, Block)]
    if not any(b.inside for b in blocks):
        return [b.features for b in blocks]
    return [b.features | {"marked" if b.inside else "beside"} for b in blocks]


#: Names and headings of the made-up layouts. Parts that are boilerplate wherever they are, parts that are so beside an article.
ALWAYS = (
    "ad ads adv advert advertisement advertising sponsor sponsored promo promoted nav navbar navigation menubar breadcrumb breadcrumbs sidebar "
    "side-bar comments commentlist comment respond disqus cookie cookies consent gdpr modal overlay newsletter subscribe signup share sharing pagination pager"
).split()
BESIDE = "menu header footer masthead topbar toolbar banner promotion notice alert popup login search social recommended related widget skip copyright complementary contentinfo reply replies".split()
HEADINGS = ("comments", "reader comments", "responses", "leave a reply", "leave a comment", "related articles", "you may like", "share this", "newsletter", "advertisement")
CONTENT = "content post entry story text page".split()


def layouts() -> list[str]:
    """Made-up pages. A block that starts with `!` is boilerplate, any other one content."""

    def say(n: int, junk: bool = False) -> str:
        return ("!" if junk else "") + " ".join(["7"] * n)  # no letters: only HEADINGS say something

    first = f"<h1>{say(5)}</h1><p>{say(40)}</p><p>{say(9)}</p><p>{say(2)}</p>"
    second = "".join(f"<h2>{say(4)}</h2>{x}<p>{say(25)}</p><p>{say(1)}</p>" for x in (
        f"<ul><li>{say(3)}</li><li>{say(12)}</li></ul>", f"<ol><li>{say(20)}</li></ol>", f"<pre>{say(20)}</pre><pre>{say(3)}</pre>",
        f"<table><tr><th>{say(1)}</th><th>{say(2)}</th></tr><tr><td>{say(1)}</td><td>{say(5)}</td></tr></table>",
        f"<blockquote>{say(20)}</blockquote><blockquote><p>{say(8)}</p></blockquote>", f"<figure><figcaption>{say(6)}</figcaption></figure>",
        f"<dl><dt>{say(1)}</dt><dd>{say(12)}</dd></dl>", f"<section><h3>{say(3)}</h3><div>{say(30)}</div></section>", f"<div>{say(9)}</div>",
    ))
    menu = f"<ul><li><a href=x>{say(1, True)}</a></li><li><a href=x>{say(3, True)}</a></li></ul>"

    def around(i: int, before: str, inner: str, after: str) -> Iterator[str]:
        name = CONTENT[i % len(CONTENT)]
        for start, stop in (("<article>", "</article>"), (f"<div class={name}>", "</div>"), (f"<main id={name}><div>", "</div></main>")):
            yield f"<body>{before}{start}{first}{inner}{second}{stop}{after}</body>"

    pages = [f"<body>{say(12)}</body>", f"<body>{first}{second}</body>", f"<body><div>{say(40)}</div><div>{say(5, True)}</div></body>", f"<div><div>{say(30)}</div></div>"]
    pages += [f"<body><article><header><h1>{say(6)}</h1><p>{say(5)}</p></header>{second}</article></body>"] * 3
    for i, name in enumerate(ALWAYS):
        part = f"<div class={name}><p>{say(15, True)}</p>{say(4, True)}</div><div class={name}>{say(1, True)}</div><p class={name}>{say(2, True)}</p>"
        pages += around(i, part, part, f"<section id={name}><h3>{say(2, True)}</h3><p>{say(30, True)}</p><ul><li>{say(9, True)}</li></ul></section>")
    for i, name in enumerate(BESIDE):
        pages += around(i, f"<div class={name}>{menu}{say(6, True)}</div>", "", f"<div id={name}><p>{say(20, True)}</p></div>")
    for i, name in enumerate("nav aside form footer button dialog menu".split() * 3):
        part = f"<{name}>{say(4, True)}<p>{say(14, True)}</p></{name}>"
        pages += around(i, f"<{name}>{menu}</{name}>{part}", part, part)
    for i in range(12):
        pages += around(i, f"<header>{menu}<h1>{say(3, True)}</h1><p>{say(8, True)}</p></header>", "", f"<div>{menu}{say(8, True)}</div>")
    for i, heading in enumerate(HEADINGS * 3):
        part = f"<h3>!{heading}</h3><ol><li><p>{say(20, True)}</p>{say(2, True)}</li></ol><p>{say(12, True)}</p>"
        pages += around(i, "", "", part)
        pages.append(f"<body>{first}{second}{part}</body>")
        pages.append(f"<body><article>{first}{second}<div>{part}</div></article></body>")
    return pages


def tally(parts: list[Block | tuple[str, bool]], made: bool = False) -> Counter:
    """(features or a tag, content?) -> how many. A page of the table says by its mark what is content, a made one by its text."""
    counts: Counter = Counter()
    blocks = [p for p in parts if isinstance(p, Block)]
    for block, features in zip(blocks, seen(parts)):
        counts["\t".join(sorted(features)), not block.text.startswith("!") if made else block.inside] += 1
    for part in parts:
        if not isinstance(part, Block):
            counts[f"<{part[0]}>", part[1]] += 1
    return counts


def shown(features: frozenset[str]) -> list[frozenset[str]]:
    """A block as it is, without the mark, without the mark and class words, and by its shape alone."""
    bare = features - {"marked", "beside"}
    shape = frozenset(f for f in bare if not f.startswith(("class=", "in=")))
    return [features, bare, frozenset(f for f in bare if not f.startswith("class=")), shape]


class Weights:
    """Log odds by feature of a block, and cost by name of a tag."""

    def __init__(self, words: dict[str, float], tags: dict[str, float]) -> None:
        self.words, self.tags = words, tags

    @classmethod
    def fit(cls, counts: dict[tuple[str, bool], int]) -> Weights:
        """Logistic regression over the counted pages and the layouts; both kinds weigh the same, and so do content and boilerplate."""
        made: Counter = Counter()
        for page in layouts():
            made.update(tally(parse(page), made=True))
        index: dict[str, int] = {"": 0}
        at, lengths, labels, mass = [], [], [], []
        for own in (counts, made):
            total = {c: sum(n for (f, label), n in own.items() if label == c and not f.startswith("<")) for c in (True, False)}
            for (key, content), n in sorted(own.items()):
                if not key.startswith("<"):
                    for features in shown(frozenset(key.split("\t"))):
                        ids = [0, *(index.setdefault(f, len(index)) for f in sorted(features))]
                        at += ids
                        lengths.append(len(ids))
                        labels.append(content)
                        mass.append(n / total[content])
        where, many = np.array(at), np.array(lengths)
        starts = np.cumsum(many) - many
        y, m = np.array(labels, float), np.array(mass) / sum(mass)
        w, squares = np.zeros(len(index)), np.full(len(index), 1e-8)
        for _ in range(ROUNDS):
            odds = np.add.reduceat(w[where], starts)
            error = m * (1 / (1 + np.exp(-odds)) - y)
            gradient = np.bincount(where, np.repeat(error, many), len(index)) + SHRINK * w
            squares += gradient**2
            w -= RATE * gradient / np.sqrt(squares)
        words = {f: float(w[i]) for f, i in index.items()}
        least, most, _ = TAG_COSTS
        tags = {}
        both = {key: counts.get(key, 0) + made[key] for key in {k for k in (*counts, *made) if k[0].startswith("<")}}
        for tag in {key for key, _ in both}:
            share = (both.get((tag, False), 0) + 1) / (both.get((tag, True), 0) + both.get((tag, False), 0) + 2)
            tags[tag[1:-1]] = least + (most - least) * share**2
        return cls(words, tags)

    def of(self, features: frozenset[str]) -> float:
        odds = self.words.get("", 0.0) + sum(self.words.get(f, 0.0) for f in sorted(features))
        return max(SCORES[0], min(SCORES[1], odds))


def main_text(page: str, weights: Weights) -> str:
    """The blocks that score positive in the best contiguous region."""
    parts = parse(page)
    features = iter(seen(parts))
    best, best_span, total, start = 0.0, (0, 0), 0.0, 0
    known: dict[frozenset[str], float] = {}
    kept: list[tuple[int, str]] = []
    for i, part in enumerate(parts):
        if isinstance(part, Block):
            own = next(features)
            if own not in known:
                known[own] = weights.of(own)
            score = known[own] * (part.words if known[own] > 0 else min(part.words, CROSSED))
            if score > 0:
                kept.append((i, part.text))
        else:
            score = -weights.tags.get(part[0], TAG_COSTS[2])
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, best_span = total, (start, i + 1)
    return "\n\n".join(text for i, text in kept if best_span[0] <= i < best_span[1])


def learn_weights(pages: DataFrame, html: str = "html", labelled: int = LABELLED_PAGES) -> Weights:
    """Weights fitted to at most `labelled` distinct pages, those with the least hashes, and to the layouts."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(html).cast("string").alias("text")).where("text is not null").select(F.xxhash64("text").alias("hash"), "text")
    chosen = rows.select("hash").distinct().orderBy("hash").limit(labelled)
    last = chosen.agg(F.max("hash")).first()[0]
    if last is None:
        return Weights.fit({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches):
            out = []
            for mark, page in zip(batch.column("hash").to_pylist(), batch.column("text").to_pylist()):
                if mark in done:
                    continue
                done.add(mark)
                parts = parse(page)
                if any(p.inside for p in parts if isinstance(p, Block)):
                    out += [(mark, *key, n) for key, n in tally(parts).items()]
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.int64())
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["hash", "feature", "content", "n"])

    # of the sample alone: the kinds of blocks that `labelled` pages have
    counted = rows.where(F.col("hash") <= last).mapInArrow(run, "hash long, feature string, content boolean, n long")
    counted = counted.groupBy("hash", "feature", "content").agg(F.max("n").alias("n")).groupBy("feature", "content").agg(F.sum("n").alias("n"))
    return Weights.fit({(r["feature"], r["content"]): r["n"] for r in counted.collect()})


def extract(pages: DataFrame, weights: Weights | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`."""
    ship(pages.sparkSession)
    known = learn_weights(pages, html) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([main_text(page, known) if page else "" for page in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("text"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
