"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: elements with the same chain of styles (tag, classes, id) are one node, and a node's text
is a content node below it. With m pages that have a node, c of them showing the same thing there, that thing has the entropy
log c / log (m + 1) and the probability c / (m + 1): one page of its own counts besides, so that few pages prove little and no
number of pages is a switch.

* Presentation importance of a node: one minus the mean entropy of its child sequences.
* Content importance of a text node: one minus the mean entropy of its texts, by how often they are shown; of a single text: one
  minus its entropy times its probability.
* Composite importance of a node with l child sequences: (1 - GAMMA ** l) of its presentation importance, and GAMMA ** l of its
  children's composite importance, weighted by the probability of the sequences that they stand in.

A branch below LOW is noise: a text that most pages show at a node, a text node, and of a noise element the text nodes that are
not themselves of high importance. It goes from each page, besides elements that by name are no part of an article.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import discard, stash
from orefall.llm.dom import HEADINGS, Block, Element, blocks_of, node_of

#: Noise is below LOW; a text node from HIGH on stays in a noise element; weight of the children of one sequence.
LOW, HIGH, GAMMA = 0.3, 0.6, 0.9
#: Below this change of any node's importance it isn't carried further up; GAMMA ** 64 is about as small.
STILL, ROUNDS = 0.002, 64
TEXT = "#text"
PROSE = HEADINGS | {"p", "article", "main"}
#: Kinds of facts: that a page has the node, a node's child sequence, a child's weight in it, a text of a text node.
PRESENT, SEQUENCE, CHILD, CONTENT = 0, 1, 2, 3
#: What a host's tree says of its pages: noise text nodes, those that follow their branch, noise elements, noise texts.
VERDICTS = ("low", "unsure", "branches", "texts")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port and user; empty for null or malformed ones."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def text_node(place: Element | None) -> int:
    return node_of(place.node if place else 0, TEXT)


def page_facts(blocks: list[Block]) -> dict[tuple[int, int, int], float]:
    """(node, kind, value) and its weight, each once. Elements known as noise by name are no part of the tree."""
    below: dict[int, tuple[int, list[str]]] = {}  # element by identity: its node, the styles of its children with text, runs as one
    facts: dict[tuple[int, int, int], float] = {}
    root = (0, [])
    for b in blocks:
        if b.place and b.place.dropped:
            continue
        leaf = text_node(b.place)
        facts[leaf, PRESENT, 0] = facts[leaf, CONTENT, node_of(leaf, b.text)] = 1.0
        e, child = b.place, TEXT
        while True:
            fresh = e is not None and id(e) not in below
            node, signs = below.setdefault(id(e), (e.node, [])) if e else root
            if not signs or signs[-1] != child:
                signs.append(child)
            if not fresh:
                break  # its ancestors know it; a run that another child broke has no other order for them
            e, child = e.parent, e.sign
    for node, signs in [*below.values(), root]:
        if signs:
            facts[node, PRESENT, 0] = 1.0
            sequence = node_of(node, "\x1f".join(signs))
            if (node, SEQUENCE, sequence) not in facts:
                facts[node, SEQUENCE, sequence] = 1.0
                kinds = set(signs)
                for s in kinds:
                    key = (node, CHILD, node_of(node, s))
                    facts[key] = facts.get(key, 0.0) + 1.0 / len(kinds)
    return facts


def style_facts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, node, kind, value, c, w) of all pages that have a host: pages that show the value, and sum of its weights."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(batches):
        for b in batches:
            count: Counter = Counter()
            weight: Counter = Counter()
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                if host:
                    for fact, w in page_facts(blocks_of(page.as_py())).items():
                        count[host, *fact] += 1
                        weight[host, *fact] += w
            keys = list(count)
            cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([count[k] for k in keys], pa.int64()), pa.array([weight[k] for k in keys], pa.float64())], ["host", "node", "kind", "value", "c", "w"])

    facts = rows.mapInArrow(run, "host string, node long, kind int, value long, c long, w double")
    return facts.groupBy("host", "node", "kind", "value").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))


def nodes_of(facts: DataFrame) -> DataFrame:
    """(host, node, m, sequences, presentation, content) of the nodes that two pages or more have; others are of importance 1."""
    c = F.col("c").cast("double")
    m = F.max(F.when(F.col("kind") == PRESENT, c))
    sums = [F.sum(F.when(F.col("kind") == k, x)).alias(f"{n}{k}") for k in (SEQUENCE, CONTENT) for n, x in (("log", c * F.log(c)), ("sum", c))]
    rows = facts.where(F.col("kind") != CHILD).groupBy("host", "node").agg(m.alias("m"), F.count(F.when(F.col("kind") == SEQUENCE, True)).alias("sequences"), *sums).where("m >= 2")
    share = F.col("m") / (F.col("m") + 1) / F.log(F.col("m") + 1)
    return rows.select("host", "node", "m", "sequences", *[(F.lit(1.0) - F.col(f"log{k}") / F.col(f"sum{k}") * share).alias(n) for k, n in ((SEQUENCE, "presentation"), (CONTENT, "content"))])


def composite(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(host, node, importance) of the elements of nodes, by carrying importance from children to parents until it is still.

    All nodes take a step at once; after as many steps as a branch is deep its importance is exact, and each step further up
    weighs GAMMA at most.
    """
    own = F.pow(F.lit(GAMMA), F.col("sequences").cast("double"))
    elements = nodes.where("sequences > 0").select("host", "node", ((F.lit(1.0) - own) * F.col("presentation")).alias("a"), own.alias("g"), F.lit(1.0).alias("importance"))
    texts = nodes.where("content is not null").select("host", F.col("node").alias("child"), F.col("content").alias("of"))
    known = elements.select(F.col("host").alias("_h"), F.col("node").alias("_n"))
    edges = facts.where(F.col("kind") == CHILD).join(known, (F.col("host") == F.col("_h")) & (F.col("node") == F.col("_n")), "left_semi")
    edges = stash(edges.select("host", "node", F.col("value").alias("child"), "w"), "tree-edges")
    now = stash(elements, "tree")
    for _ in range(ROUNDS):
        of = now.select("host", F.col("node").alias("child"), F.col("importance").alias("of")).union(texts)
        mean = edges.join(of, ["host", "child"], "left").groupBy("host", "node").agg((F.sum(F.col("w") * F.coalesce("of", F.lit(1.0))) / F.sum("w")).alias("mean"))
        step = now.join(mean, ["host", "node"], "left")
        new = F.col("a") + F.col("g") * F.coalesce("mean", F.lit(1.0))
        after = stash(step.select("host", "node", "a", "g", new.alias("importance"), F.abs(new - F.col("importance")).alias("change")), "tree")
        change = after.agg(F.max("change")).first()[0]
        discard(now)
        now = after.drop("change")
        if change is None or change < STILL:
            break
    return now.select("host", "node", "importance")


def low_branches(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, low, unsure, branches, texts): VERDICTS for each host with any noise, as arrays of node and text numbers."""
    facts = stash(style_facts(pages, url, html), "style-facts")
    nodes = stash(nodes_of(facts), "style-nodes")
    leaves = nodes.where("content is not null")
    shown = facts.where((F.col("kind") == CONTENT) & (F.col("c") >= 2)).join(leaves.select("host", "node", "m"), ["host", "node"])
    single = F.lit(1.0) - F.col("c") / (F.col("m") + 1) * F.log(F.col("c").cast("double")) / F.log(F.col("m") + 1)
    found = shown.where(single < LOW).select("host", F.lit("texts").alias("what"), F.col("value").alias("n"))
    low = leaves.where(F.col("content") < HIGH).select("host", F.when(F.col("content") < LOW, "low").otherwise("unsure").alias("what"), F.col("node").alias("n"))
    hosts = stash(low.where("what = 'unsure'").select("host").distinct(), "style-hosts")
    found = found.union(low)
    if not hosts.isEmpty():  # only there do branches decide anything
        tree = composite(facts.join(hosts, "host", "left_semi"), nodes.join(hosts, "host", "left_semi"))
        found = found.union(tree.where(F.col("importance") < LOW).select("host", F.lit("branches").alias("what"), F.col("node").alias("n")))
    # A host's lists are as long as its templates have branches and texts that most of its pages share.
    return found.groupBy("host").agg(*[F.collect_list(F.when(F.col("what") == v, F.col("n"))).alias(v) for v in VERDICTS])


def kept_blocks(blocks: list[Block], verdicts: dict[str, set[int]]) -> list[Block]:
    """The blocks that neither their names nor the host's style tree call noise. A page that stands in a form as a whole, with
    paragraphs or headings in it, keeps it."""
    whole = all(b.place and b.place.dropped for b in blocks) and any(b.place.form and b.place.tag in PROSE for b in blocks)
    branches: dict[int, bool] = {}

    def in_noise(e: Element | None) -> bool:
        path = []
        while e is not None and id(e) not in branches:
            path.append(e)
            e = e.parent
        noise = branches[id(e)] if e is not None else 0 in verdicts["branches"]
        for x in reversed(path):
            noise = branches[id(x)] = noise or x.node in verdicts["branches"]
        return noise

    out = []
    for b in blocks:
        if b.place and b.place.dropped and not b.place.form or b.place and b.place.form and not whole:
            continue
        if any(verdicts.values()):
            leaf = text_node(b.place)
            if leaf in verdicts["low"] or node_of(leaf, b.text) in verdicts["texts"] or leaf in verdicts["unsure"] and in_noise(b.place):
                continue
        out.append(b)
    return out


NOTHING: dict[str, set[int]] = {v: set() for v in VERDICTS}


def main_text(blocks: list[Block], verdicts: dict[str, set[int]] = NOTHING) -> str:
    """Text of the blocks that stay: those of the main part if the page has one, else of its articles if they have at least half
    of all the text, else all."""
    kept = kept_blocks(blocks, verdicts)
    main = [b for b in kept if b.place and b.place.main]
    if not main:
        article = [b for b in kept if b.place and b.place.article]
        main = article if 2 * sum(len(b.text) for b in article) >= sum(len(b.text) for b in kept) else kept
    return "\n".join(b.text for b in main)


def extract(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    Null and empty html have empty text, as has a page that is all noise. Pages without a host share no style tree and lose only
    elements known by name; on hosts of fewer than five pages nothing repeats often enough to be noise. Very long, deeply nested
    and broken pages are read whole, in time linear in their length. Repeated pages count as pages of their own; they and null
    keys come back as they are; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    low = stash(low_branches(pages, url, html), "low-branches")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("_html"), host_of(F.col(url)).alias("_host"))
    # The hosts with many pages are on the left side of this join, where Spark splits large partitions.
    rows = rows.join(low, F.col("_host") == F.col("host"), "left").select("page_id", "url", "_html", *VERDICTS)
    kinds = f"page_id {pages.schema[key].dataType.simpleString()}, url {pages.schema[url].dataType.simpleString()}"

    def run(batches):
        for b in batches:
            texts = [main_text(blocks_of(row[2].as_py()), {v: set(x.as_py() or ()) for v, x in zip(VERDICTS, row[3:])}) for row in zip(*b.columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
