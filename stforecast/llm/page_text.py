"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stforecast.llm.shared import query, table

SAMPLE_PAGES = 120  # labelled pages, a bound on what training reads
SAMPLE_BYTES = 200_000  # longer pages are not used for training
MARKS = r"(?i)<(article|main)[\s/>]"  # a page that may label itself
COPIES, EPOCHS, RATE, DECAY = 3, 5, 0.5, 1e-4
CHAINS_KEPT = 20_000  # ancestor chains whose scores a worker remembers
SCHEMA = "page_id long, url string, text string, n_chars long"

# fixed values: HTML elements without content, in running text, and never shown
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
HIDDEN = set("head iframe math noscript object script style svg template title".split())
IN_HEAD = set("html head title meta link base basefont bgsound style script noscript template noframes".split())
# an element of the left kind ends an open one of the right kinds
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
CONTAINERS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "aside", "nav", "form", "body", "select"}

# how training pages are dressed: tags and class words of containers, by what they hold
MAIN_BOXES = [("article", ""), ("main", ""), ("div", "content"), ("div", "post body"), ("div", "entry"),
              ("section", "story"), ("td", ""), ("div", "")]
MAIN_LEAVES = [(("ul", ""), ("li", "")), (("ol", ""), ("li", "")), (("blockquote", ""), ("p", "")), (("h2", ""),),
               (("div", ""),), (("pre", ""),), (("table", ""), ("tr", ""), ("td", "")), (("figure", ""), ("figcaption", ""))]
OTHER_BOXES = {
    "menu": [("nav", ""), ("div", "menu"), ("ul", "navbar"), ("div", "breadcrumb"), ("div", "navigation")],
    "advert": [("div", "ad"), ("aside", "promo"), ("div", "sponsored"), ("div", "banner"), ("div", "advertisement")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "topbar logo")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "copyright"), ("div", "legal")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("section", "recommended")],
    "notice": [("div", "cookie notice"), ("div", "consent"), ("div", "alert"), ("div", "popup"), ("div", "notice")],
    "form": [("form", ""), ("form", "search"), ("form", "newsletter"), ("div", "login"), ("div", "subscribe")],
    "share": [("div", "share"), ("ul", "social"), ("div", "tags")],
    "comment": [("section", "comments"), ("div", "comment"), ("ol", "commentlist"), ("div", "reply"), ("div", "discussion")],
}
LEAVES = {"menu": "li", "form": "label", "share": "li", "header": "div", "footer": "", "advert": "", "notice": "p",
          "sidebar": "p", "comment": "p"}


class Block(NamedTuple):
    text: str
    chain: tuple[tuple[str, str], ...]  # ancestors from the root: tag and class words
    linked: int  # characters inside links


class BlockParser(HTMLParser):
    """Leaf blocks of a page: runs of text between the edges of block elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.hidden = self.links = self.linked = 0
        self.buffer: list[str] = []
        self.blocks: list[Block] = []

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            chain = tuple(x for x in self.stack if x[0] not in INLINE)
            self.blocks.append(Block(text, chain, self.linked))
        self.buffer, self.linked = [], 0

    def pop(self, upto: int) -> None:
        for tag, _ in self.stack[upto:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.stack[upto:]

    def close_open(self, tags: set[str]) -> None:
        """Close the innermost of ``tags`` that is open in the current container."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                return self.pop(k)
            if self.stack[k][0] in CONTAINERS:
                return None
        return None

    def end_head(self) -> None:
        """Close a head that is open and has no open element in it."""
        if self.stack and self.stack[-1][0] == "head":
            self.pop(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        if tag == "br":
            self.buffer.append(" ")
        if tag not in INLINE:
            self.flush()
            if tag == "body":  # a head that was not closed
                self.pop(next((k for k, x in enumerate(self.stack) if x[0] == "head"), len(self.stack)))
            self.close_open({"p"} | ENDS.get(tag, set()))
        if tag in VOID:
            return
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        self.stack.append((tag, " ".join(re.findall("[a-z]+", names.lower())[:8])))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in HIDDEN:  # <script/> as written by XML tools
            self.pop(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                return self.pop(k)
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return None
        return None

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        if not self.hidden:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str | None) -> list[Block]:
    parser = BlockParser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def chain_features(chain: tuple[tuple[str, str], ...]) -> list[str]:
    own = chain[-1][0] if chain else ""
    above = chain[-2][0] if len(chain) > 1 else ""
    out = {f"own {own}", f"own {own} in {above}"}
    for tag, names in chain:
        out.add(f"in {tag}")
        out.update(f"class {word}" for word in names.split())
    return sorted(out)


def text_features(blocks: list[Block]) -> list[list[str]]:
    """Length, links, punctuation and neighbours of each block."""
    words = [len(b.text.split()) for b in blocks]
    sizes = [min(8, n.bit_length()) for n in words]
    out = []
    for i, b in enumerate(blocks):
        ending = b.text[-1] if b.text[-1] in ".!?:" else ""
        marks = sum(map(b.text.count, ".,;:!?"))
        out.append([
            "any", f"words {sizes[i]}", f"links {min(10, 10 * b.linked // len(b.text))}", f"end {ending}",
            f"marks {min(6, 20 * marks // words[i])}", f"digits {sum(map(str.isdigit, b.text)) * 5 // len(b.text)}",
            f"before {sizes[i - 1] if i else 'none'}", f"after {sizes[i + 1] if i + 1 < len(blocks) else 'none'}",
            *(["copyright"] if "©" in b.text or "copyright" in b.text.lower() else []),
        ])
    return out


class Model(NamedTuple):
    """A label is main (1) or other (0). ``weights``: what a feature speaks for main; ``step``:
    score of one label after another; ``first``: score of main at the start of a page."""

    weights: dict[str, float]
    step: list[list[float]]
    first: float


def viterbi(gains: list[float], model: Model) -> list[int]:
    """The best labels of a page, from what each block's features gain for main."""
    if not gains:
        return []
    step, back = model.step, []
    other, main = 0.0, gains[0] + model.first
    for gain in gains[1:]:
        from_other = 0 if other + step[0][0] >= main + step[1][0] else 1
        from_main = 0 if other + step[0][1] >= main + step[1][1] else 1
        back.append((from_other, from_main))
        other, main = (
            max(other + step[0][0], main + step[1][0]), max(other + step[0][1], main + step[1][1]) + gain
        )
    labels = [int(main > other)]
    for pair in reversed(back):
        labels.append(pair[labels[-1]])
    return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], seed: int = 0) -> Model:
    """Maximum likelihood with a small decay, one page at a time with AdaGrad steps.

    Marginals come from the forward and backward sums of each page, scaled at every block.
    """
    weights: dict[str, float] = {}
    sizes: dict[str, float] = {}
    chain = {key: 0.0 for key in ("00", "01", "10", "11", "first")}
    order = random.Random(seed)

    def move(table: dict[str, float], key: str, slope: float) -> None:
        slope -= DECAY * table.get(key, 0.0)
        name = f"chain {key}" if table is chain else key
        sizes[name] = sizes.get(name, 1e-6) + slope * slope
        table[key] = table.get(key, 0.0) + RATE * slope / math.sqrt(sizes[name])

    for _ in range(EPOCHS):
        for features, labels in order.sample(pages, len(pages)):
            gains = [math.exp(max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in fs)))) for fs in features]
            step = [[math.exp(chain[f"{a}{b}"]) for b in (0, 1)] for a in (0, 1)]
            ahead = []
            x = (1.0, gains[0] * math.exp(chain["first"]))
            for i in range(len(gains)):
                if i:
                    x = (x[0] * step[0][0] + x[1] * step[1][0], (x[0] * step[0][1] + x[1] * step[1][1]) * gains[i])
                total = x[0] + x[1]
                x = (x[0] / total, x[1] / total)
                ahead.append(x)
            behind = [(1.0, 1.0)] * len(gains)
            for i in range(len(gains) - 2, -1, -1):
                y, g = behind[i + 1], gains[i + 1]
                y = (step[0][0] * y[0] + step[0][1] * g * y[1], step[1][0] * y[0] + step[1][1] * g * y[1])
                behind[i] = (y[0] / (y[0] + y[1]), y[1] / (y[0] + y[1]))
            expected = dict.fromkeys(chain, 0.0)
            for i, fs in enumerate(features):
                main, other = ahead[i][1] * behind[i][1], ahead[i][0] * behind[i][0]
                slope = labels[i] - main / (main + other)
                if not i:
                    expected["first"] += slope
                if abs(slope) > 1e-4:
                    for f in fs:
                        move(weights, f, slope)
                if i:
                    joint = {
                        f"{a}{b}": ahead[i - 1][a] * step[a][b] * (gains[i] if b else 1.0) * behind[i][b]
                        for a in (0, 1) for b in (0, 1)
                    }
                    total = sum(joint.values())
                    for key, value in joint.items():
                        expected[key] -= value / total
                    expected[f"{labels[i - 1]}{labels[i]}"] += 1
            for key, slope in expected.items():
                move(chain, key, slope)
    return Model(weights, [[chain["00"], chain["01"]], [chain["10"], chain["11"]]], chain["first"])


def marked(block: Block) -> int:
    """Label of a block on a page that marks its article: inside it, and in nothing that is not text."""
    tags = {tag for tag, _ in block.chain}
    words = {word for _, names in block.chain for word in names.split()}
    other = {word for boxes in OTHER_BOXES.values() for _, names in boxes for word in names.split()}
    return int(bool(tags & {"article", "main"}) and not tags & {"nav", "aside", "footer", "header", "form"} and not words & other)


def dressed(blocks: list[Block], labels: list[int], pool: list[str], draw: random.Random) -> tuple[list[Block], list[int]]:
    """A labelled page in other markup: other containers, and blocks of every other kind put in."""
    box = draw.choice(MAIN_BOXES)
    out: list[tuple[Block, int]] = []

    def other(kind: str, inside: tuple) -> list[tuple[Block, int]]:
        tag, names = draw.choice(OTHER_BOXES[kind])
        leaf = LEAVES[kind]
        chain = (*inside, (tag, names), *([(leaf, "")] if leaf else []))
        made = []
        for _ in range(draw.randint(1, 5 if leaf else 1)):
            text = draw.choice(pool)
            if kind in ("menu", "share", "form", "header"):
                text = " ".join(text.split()[: draw.randint(1, 3)])
            if kind == "footer" and draw.random() < 0.5:
                text = f"© {text}"
            linked = len(text) if kind in ("menu", "share") or (kind == "sidebar" and draw.random() < 0.5) else 0
            made.append((Block(text, chain, linked), 0))
        return made

    body = (("html", ""), ("body", ""))
    for kind in draw.sample(["notice", "header", "menu", "sidebar", "form", "advert"], draw.randint(1, 4)):
        out += other(kind, body)
    wrap = body if draw.random() < 0.5 else (*body, ("div", draw.choice(["", "wrapper", "page", "container"])))
    for b, label in zip(blocks, labels, strict=True):
        if label:
            tags = [tag for tag, _ in b.chain]
            at = max(k for k, tag in enumerate(tags) if tag in ("article", "main"))
            inner = b.chain[at + 1 :]
            if draw.random() < 0.2 and inner and inner[-1][0] == "p":
                inner = draw.choice(MAIN_LEAVES)
            text = b.text if draw.random() < 0.93 else " ".join(b.text.split()[: draw.randint(1, 3)])
            out.append((Block(text, (*wrap, box, *inner), min(b.linked, len(text))), 1))
            if draw.random() < 0.12:
                inside = (*wrap, box) if draw.random() < 0.7 else wrap
                out += other(draw.choice(["advert", "notice", "share", "form", "sidebar"]), inside)
    for kind in draw.sample(["share", "comment", "sidebar", "form", "menu", "advert"], draw.randint(1, 4)):
        out += other(kind, (*wrap, box) if kind == "comment" and draw.random() < 0.4 else body)
    out += other("footer", body)
    return [b for b, _ in out], [label for _, label in out]


def features_of(blocks: list[Block]) -> list[list[str]]:
    return [chain_features(b.chain) + fs for b, fs in zip(blocks, text_features(blocks), strict=True)]


def learn(pages: DataFrame, seed: int = 0) -> Model:
    """A model from at most SAMPLE_PAGES pages of at most SAMPLE_BYTES, those of smallest id hash.

    Only pages with an article or main tag are drawn, so that the bound counts no others. Pages
    that mark their article label themselves; each is used as it is and in COPIES other
    dresses, with text of the sample in menus, headers, footers, sidebars, notices, adverts,
    forms and comments. Pages without such marks train nothing; if the table has none that do,
    the model takes no block and every text is empty.
    """
    known = pages.where(F.octet_length("html").between(1, SAMPLE_BYTES) & F.col("html").rlike(MARKS))
    known = known.withColumn("h", F.xxhash64("page_id"))
    # hashes first, so that no task sends more pages than the sample has
    upto = known.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    chosen = known.where(F.col("h") <= F.lit(upto)).orderBy("h", "page_id", "html").limit(SAMPLE_PAGES)
    sample = chosen.select("html").collect()
    parsed = [blocks_of(row.html) for row in sample]
    labelled = [(blocks, [marked(b) for b in blocks]) for blocks in parsed]
    labelled = [(blocks, labels) for blocks, labels in labelled if any(labels)]
    pool = [b.text for blocks, _ in labelled for b in blocks if len(b.text) < 600] or ["Some words of text."]
    draw = random.Random(seed)
    train = labelled + [dressed(*draw.choice(labelled), pool, draw) for _ in range(COPIES * len(labelled))]
    return fit([(features_of(blocks), labels) for blocks, labels in train], seed)


class Extractor:
    """Decodes pages with a model; what an ancestor chain gains is remembered."""

    def __init__(self, model: Model):
        self.model, self.chains = model, {}

    def chain_gain(self, chain: tuple[tuple[str, str], ...]) -> float:
        if chain not in self.chains:
            if len(self.chains) >= CHAINS_KEPT:
                self.chains.clear()
            self.chains[chain] = sum(self.model.weights.get(f, 0.0) for f in chain_features(chain))
        return self.chains[chain]

    def text(self, html: str | None) -> str:
        blocks = blocks_of(html)
        known = self.model.weights.get
        gains = [
            self.chain_gain(b.chain) + sum(known(f, 0.0) for f in fs)
            for b, fs in zip(blocks, text_features(blocks), strict=True)
        ]
        return " ".join(b.text for b, label in zip(blocks, viterbi(gains, self.model), strict=True) if label)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """The main text of every page, one row per row of ``pages`` (page_id, url, html).

    Blocks are runs of text between the edges of block elements, with character references
    decoded and white space reduced to one space; the blocks that the model labels main are
    joined by one space in page order. Returns page_id, url, text (empty if there is none, as for
    a null or empty page) and n_chars. Other columns are ignored, nulls in page_id and url stay,
    repeated pages give repeated rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Extractor(model)
        for batch in batches:
            texts = [work.text(html.as_py()) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))
