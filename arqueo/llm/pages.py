"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of its block elements and, as leaves, its runs of text. Every node has a hidden state, main text or not.
Node potentials come from what is seen of it (tag, words of class, id and role, length of the text, share of links, end of
sentence), edge potentials join the states of parent and child. Sum-product messages, once up and once down the tree,
give each leaf the exact probability of being main text; leaves above one half are kept, in page order. The potentials
are fitted to labelled pages; `train` takes any, the default are those of `labelled_pages`.

The text is the page's own: character references decoded, white space inside a block turned into one space, blocks joined by
a line break. Scripts, styles, comments, the head, templates and markup are never text; a formula or drawing belongs to the line that holds
it, and what stands in for scripts, frames and objects is judged like any text. Pages are independent of each other; nothing is shuffled.

Defined cases: null counts as empty, and a page without main text gives an empty text; broken markup is read leniently
(open paragraphs and list items end where the next begins, stray end tags are passed over); repeated rows give the same text; an
empty table gives an empty result; other columns are ignored.
"""

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arqueo.llm.common import text_of
from arqueo.llm.labelled_pages import labelled_pages

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img ruby rt rp object canvas noscript iframe".split())
FORMULA = frozenset(("math", "svg"))  # the elements inside belong to the line of text that holds them
DROPPED = frozenset("script style head template title".split())
RAW = frozenset("script style textarea title".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS_ITSELF = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
SAME = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<!--.*?(?:-->|\Z)|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|data-main|data-other)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
TOKEN = re.compile(r"[a-z]+")
TEXT = "#text"


class Tree:
    """Parallel lists, parents before children; node 0 is the page."""

    def __init__(self):
        self.parent, self.tag, self.seen, self.text, self.links, self.mark = [-1], ["#page"], [()], [""], [0], [False]

    def add(self, parent: int, tag: str, seen: tuple = (), text: str = "", links: int = 0, mark: bool | None = None) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.seen.append(seen)
        self.text.append(text)
        self.links.append(links)
        self.mark.append(self.mark[parent] if mark is None else mark)
        return len(self.parent) - 1


def parse(page: str) -> Tree:
    tree, stack = Tree(), [(0, "#page")]
    pieces, linked, in_link, dropped, formula, position = [], 0, 0, 0, 0, 0
    opened = Counter()  # of each element, how many are on the stack
    end = page.rfind(">") + 1  # nothing after it can be a tag

    def flush():
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                tree.add(stack[-1][0], TEXT, text=text, links=linked)
            pieces, linked = [], 0

    def close(depth: int):
        nonlocal in_link, dropped
        flush()
        in_link = 0
        for _, tag in stack[depth:]:
            dropped -= tag in DROPPED
            opened[tag] -= 1
        del stack[depth:]

    def put(text: str):
        nonlocal linked
        if text and not dropped:
            pieces.append(text)
            linked += len(text) if in_link else 0

    while position < end:
        match = TAG.search(page, position, end)
        if not match:
            break
        put(page[position:match.start()])
        position = match.end()
        name = match[2] or match[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), match[1] or match[4], match[3] or match[6] or ""
        if name == "br":
            put(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif name in FORMULA:
            formula = max(0, formula - 1) if closing else formula + (not attributes.endswith("/"))
        elif formula and name in RAW:
            stop = None if closing else re.compile(f"</{name}", re.I).search(page, position)
            position = position if closing else stop.start() if stop else len(page)
        elif name in INLINE or formula and name not in CLOSES_PARAGRAPH:
            pass
        elif closing:
            if opened[name]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][1] == name))
        else:
            if name in CLOSES_PARAGRAPH:
                formula = 0  # one that was never closed ends here
            flush()
            if name in CLOSES_PARAGRAPH and stack[-1][1] == "p":
                close(len(stack) - 1)
            if name in ENDS_ITSELF and any(opened[tag] for tag in SAME.get(name, (name,))):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][1] in SAME.get(name, (name,)):
                        close(depth)
                        break
                    if stack[depth][1] in ENDS_ITSELF[name]:
                        break
            if name in VOID or attributes.endswith("/") and name in DROPPED:
                continue
            found = {a[0].lower(): a[1].strip("\"'") for a in ATTRIBUTE.findall(attributes)} if attributes else {}
            seen = tuple(sorted(set(TOKEN.findall(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower())))) if found else ()
            mark = True if "data-main" in found else False if "data-other" in found else None
            stack.append((tree.add(stack[-1][0], name, seen, mark=mark), name))
            opened[name] += 1
            if name in DROPPED:
                dropped += 1
            if name in RAW:  # its content is no markup
                stop = re.compile(f"</{name}", re.I).search(page, position)
                put(page[position:stop.start() if stop else len(page)])
                position = stop.start() if stop else len(page)
    put(page[position:])
    flush()
    return tree


def observed(tree: Tree, node: int) -> list[str]:
    """What is seen of a node, as words."""
    tag = tree.tag[node]
    if tag != TEXT:
        return [f"tag {tag}", *(f"name {t}" for t in tree.seen[node])]
    text = tree.text[node]
    words = text.count(" ") + 1
    links = tree.links[node] / len(text)
    return [f"words {min(4, words.bit_length() // 2)}", f"links {0 if links < 0.2 else 1 if links < 0.8 else 2}",
            f"ends {text[-1] in '.!?:;…”\"'}", f"in {tree.tag[tree.parent[node]]}"]


class Model:
    """A conditional model of all states of a page. `seen`: word -> weight for main text; `edge`: whether the child is text
    -> weights as [parent][child]. Fitted by gradient ascent on the likelihood of the labelled pages, the expectations of
    which come from the same messages as the answers."""

    def __init__(self, pages: list[str], rounds: int = 100, step: float = 1.0, shrink: float = 0.0001):
        self.seen: dict[str, float] = {}
        self.edge = {kind: [[0.0, 0.0], [0.0, 0.0]] for kind in (True, False)}
        trees = [(tree, [observed(tree, n) for n in range(len(tree.tag))]) for tree in map(parse, pages)]
        squares: Counter = Counter()  # of the gradients so far: often seen weights take smaller steps
        for _ in range(rounds):
            slope: Counter = Counter()
            for tree, words in trees:
                chances, pairs = self.messages(tree, words)
                for node in range(1, len(tree.tag)):
                    state, kind = int(tree.mark[node]), tree.tag[node] == TEXT
                    for word in words[node]:
                        slope[word] += state - chances[node]
                    slope[kind, int(tree.mark[tree.parent[node]]), state] += 1
                    for (above, below), chance in pairs[node].items():
                        slope[kind, above, below] -= chance
            for name, value in slope.items():
                edge = self.edge[name[0]][name[1]] if isinstance(name, tuple) else None
                weight = self.seen.get(name, 0.0) if edge is None else edge[name[2]]
                value -= shrink * len(trees) * weight
                squares[name] += value * value
                weight += step * value / (1e-9 + math.sqrt(squares[name]))
                if edge is None:
                    self.seen[name] = weight
                else:
                    edge[name[2]] = weight

    def messages(self, tree: Tree, words: list[list[str]] | None = None) -> tuple[list[float], list[dict]]:
        """Sum-product over the tree: the probability of main text per node and, if `words` are given (in training), of each
        pair of states per node and its parent. All in log odds; the page itself is not main text."""
        count = len(tree.tag)
        edges = [tuple(math.exp(w) for row in self.edge[tag == TEXT] for w in row) for tag in tree.tag]
        ratio, message = [0.0] * count, [0.0] * count  # of the node with all below it; what it tells its parent
        for node in range(count - 1, 0, -1):
            ratio[node] += sum(self.seen.get(word, 0.0) for word in (words[node] if words else observed(tree, node)))
            odds = math.exp(min(max(ratio[node], -60.0), 60.0))
            nn, ny, yn, yy = edges[node]
            message[node] = math.log((yn + yy * odds) / (nn + ny * odds))
            ratio[tree.parent[node]] += message[node]
        full, pairs = [-60.0] + [0.0] * (count - 1), [{} for _ in range(count)]
        for node in range(1, count):
            above = math.exp(min(max(full[tree.parent[node]] - message[node], -60.0), 60.0))  # the parent without this child
            nn, ny, yn, yy = edges[node]
            full[node] = ratio[node] + math.log((ny + yy * above) / (nn + yn * above))
            if words:
                odds = math.exp(min(max(ratio[node], -60.0), 60.0))
                weights = {(0, 0): nn, (0, 1): ny * odds, (1, 0): yn * above, (1, 1): yy * above * odds}
                total = sum(weights.values())
                pairs[node] = {states: w / total for states, w in weights.items()}
        return [1 / (1 + math.exp(min(max(-x, -60.0), 60.0))) for x in full], pairs

    def marginals(self, tree: Tree) -> list[float]:
        return self.messages(tree)[0]

    def main_text(self, page: str) -> str:
        tree = parse(page)
        chances = self.marginals(tree)
        return "\n".join(t for t, tag, chance in zip(tree.text, tree.tag, chances) if tag == TEXT and chance > 0.5)


def train(pages: list[str] | None = None) -> Model:
    """From pages in which `data-main` marks elements of the main text and `data-other` other ones inside; a bounded list."""
    return Model(labelled_pages() if pages is None else pages)


def extract(pages: DataFrame, model: Model | None = None, id_column: str = "page_id", url_column: str = "url",
            html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or train()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([T.StructField("page_id", pages.schema[id_column].dataType), T.StructField("url", pages.schema[url_column].dataType),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), text_of(html_column).alias("html"))
    return rows.mapInArrow(extracted, schema)
