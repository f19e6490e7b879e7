"""Main text of web pages by template deduction from equivalence classes of tokens.

A token is a tag, or a whole block of text, together with the path of tags above it; its occurrence vector says how
often it stands on each page of a host. Tokens with equal vectors form an equivalence class. A class is valid if it is
large (LEAST_TOKENS), covers most of the host's pages (SHARE), keeps one order of its tokens on them, and nests: each of
its instances lies in one gap of the valid classes above it. The nested valid classes are the host's template, and what
stands in the gaps are slots. Blocks in slots that are not aside by their elements' names are the main text.
"""

from __future__ import annotations

from bisect import bisect, bisect_left
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, staged
from .markup import blocks

#: A valid class covers this share of the host's pages, is in order and nested on this share of those it is on, and has
#: so many tokens; hosts of fewer pages have no template.
SHARE, LEAST_TOKENS, LEAST_PAGES = 0.9, 3, 5
#: Template tokens, up to which all hosts' templates are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_TOKENS = 4_000_000

def _sequences(batches):
    """Each page's tokens in order, as hashes."""
    for batch in batches:
        yield {"host": batch["host"], "page_key": batch["page_key"], "tokens": [blocks(page)[0] for page in batch["html"]]}


def _vectors(batches):
    """By host and token: pages, a sum over pages that equal occurrence vectors share, occurrences, sum of first places."""
    for batch in batches:
        sums: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        pages: Counter[str] = Counter(batch["host"])
        for host, page_key, tokens in zip(batch["host"], batch["page_key"], batch["tokens"], strict=True):
            first = {t: i for i, t in zip(range(len(tokens) - 1, -1, -1), reversed(tokens))}
            for token, n in Counter(tokens).items():
                s = sums[host, token]
                s[0] += 1
                s[1] = (s[1] + page_key * (2 * n + 1)) & 0xFFFFFFFFFFFF
                s[2] += n
                s[3] += first[token]
        yield {
            "host": [*pages, *(h for h, _ in sums)],
            "token": [*[None] * len(pages), *(t for _, t in sums)],
            **{name: [*(pages.values() if i == 0 else [0] * len(pages)), *(s[i] for s in sums.values())] for i, name in enumerate(("pages", "vector", "times", "places"))},
        }


def _in_order(ranks: list[int]) -> list[int]:
    """The places of a longest strictly increasing part of ranks."""
    if all(a < b for a, b in zip(ranks, ranks[1:])):
        return list(range(len(ranks)))
    ends: list[int] = []  # least last rank by length of the part
    at: list[int] = []
    before: list[int] = []
    for i, rank in enumerate(ranks):
        n = bisect_left(ends, rank)
        before.append(at[n - 1] if n else -1)
        ends[n : n + 1] = [rank]
        at[n : n + 1] = [i]
    part, i = [], at[-1]
    while i >= 0:
        part.append(i)
        i = before[i]
    return part[::-1]


def faults(tokens: list[int], classes: list[tuple[int, list[int]]]) -> tuple[set[int], set[int]]:
    """Of one page: the tokens out of their class's order, and the classes with an instance not in one gap of those before.

    ``classes`` are (id, tokens in order), from the outermost.
    """
    owner = {t: (c, rank) for c, order in classes for rank, t in enumerate(order)}
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, t in enumerate(tokens):
        if t in owner:
            found[owner[t][0]].append((i, owner[t][1]))
    moved: set[int] = set()
    crossed: set[int] = set()
    frame: list[int] = []
    for c, order in classes:
        placed, nested = [], True
        for begin in range(0, len(found[c]), len(order)):
            instance = found[c][begin : begin + len(order)]
            part = _in_order([rank for _, rank in instance])
            moved.update(order[instance[i][1]] for i in set(range(len(instance))).difference(part))
            places = [instance[i][0] for i in part]
            nested = nested and bisect(frame, places[0]) == bisect(frame, places[-1])
            placed += places
        if nested:
            frame = sorted(frame + placed)
        else:
            crossed.add(c)
    return moved, crossed


def _faults(batches):
    """By host and class: pages on which a token is out of order or, with no token, the class crosses another."""
    for batch in batches:
        sums: Counter[tuple[str, int, int | None]] = Counter()
        for host, tokens, found in zip(batch["host"], batch["tokens"], batch["classes"], strict=True):
            classes = [(c["class"], c["tokens"]) for c in found]
            moved, crossed = faults(tokens, classes)
            sums.update((host, c, t) for c, order in classes for t in order if t in moved)
            sums.update((host, c, None) for c in crossed)
        yield {"host": [h for h, _, _ in sums], "class": [c for _, c, _ in sums], "token": [t for _, _, t in sums], "faults": list(sums.values())}


def _pages(pages: DataFrame) -> DataFrame:
    page = F.coalesce("html", F.lit(""))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    key = F.shiftrightunsigned(F.xxhash64("page_id", page), 16)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), key.alias("page_key"), page.alias("html"))


def _small(df: DataFrame, tokens: str) -> DataFrame:
    """df to broadcast if all its arrays of tokens together hold at most BROADCAST_TOKENS, else as it is."""
    return F.broadcast(df) if (df.agg(F.sum(F.expr(tokens))).first()[0] or 0) <= BROADCAST_TOKENS else df


def templates(pages: DataFrame) -> DataFrame:
    """(host, tokens): the tokens of each host's template, made of its valid equivalence classes.

    Pages are parsed once, to hashes. A class's order is that of its tokens' mean places: where the order is the same on
    all pages this is that order, and tokens that move (on a page, the fewest that explain its order) leave the class.
    Counts are added up within tasks first, so a host with a third of all pages is a few rows a task. The tokens of one
    host are no more than 1/SHARE times those of its average page.
    """
    pages = map_batches(_pages(pages).select("host", "page_key", "html"), _sequences, "host string, page_key long, tokens array<long>")
    pages = staged(pages, "tokens")
    summed = map_batches(pages, _vectors, "host string, token long, pages long, vector long, times long, places long")
    totals = [F.sum(F.col(c).cast("decimal(38,0)") if c == "vector" else c).alias(c) for c in ("pages", "vector", "times", "places")]
    summed = staged(summed.groupBy("host", "token").agg(*totals), "vectors")
    hosts = summed.filter("token is null").select("host", F.col("pages").alias("host_pages")).filter(F.col("host_pages") >= LEAST_PAGES)
    tokens = summed.filter(F.col("token").isNotNull() & (F.col("pages") >= LEAST_PAGES * SHARE)).join(hosts, "host").filter(F.col("pages") >= F.col("host_pages") * SHARE)
    members = F.array_sort(F.collect_list(F.struct("places", "token")))["token"]
    large = tokens.groupBy("host", "vector", "pages", "times").agg(members.alias("tokens")).filter(F.size("tokens") >= LEAST_TOKENS)
    large = large.withColumn("class", F.xxhash64("vector", "pages", "times"))
    # From the outermost: least often on a page, then largest.
    level = F.struct((F.col("times") / F.col("pages")).alias("level"), (-F.size("tokens")).alias("size"), "class", "pages", "tokens")
    classes = staged(large.groupBy("host").agg(F.array_sort(F.collect_list(level)).alias("classes")), "classes")
    checked = pages.select("host", "tokens").join(_small(classes, "aggregate(classes, 0L, (n, c) -> n - c.size)"), "host")
    wrong = map_batches(checked, _faults, "host string, class long, token long, faults long").groupBy("host", "class", "token").agg(F.sum("faults").alias("faults"))
    each = classes.select("host", F.explode("classes").alias("c")).select("host", "c.class", "c.pages", "c.tokens")
    wrong = staged(wrong.join(each.select("host", "class", "pages"), ["host", "class"]).filter(F.col("faults") > F.col("pages") * (1 - SHARE)), "faults")
    crossed = wrong.filter("token is null").select("host", "class")
    moved = wrong.filter("token is not null").groupBy("host", "class").agg(F.collect_set("token").alias("moved"))
    valid = each.join(crossed, ["host", "class"], "left_anti").join(moved, ["host", "class"], "left")
    valid = valid.withColumn("tokens", F.array_except("tokens", F.coalesce("moved", F.array().cast("array<long>"))))
    found = staged(valid.filter(F.size("tokens") >= LEAST_TOKENS).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens")), "templates")
    discard(pages, summed, classes, wrong)
    return found


def _extract(batches):
    for batch in batches:
        out = []
        for page, template in zip(batch["html"], batch["tokens"], strict=True):
            known = frozenset(template or ())
            _, found = blocks(page, known)
            articles = any(main and not aside for _, _, main, aside in found)
            main = [(token, text) for token, text, main, aside in found if not aside and (main or not articles)]
            slots = [text for token, text in main if token not in known]
            kept, whole = sum(map(len, slots)), sum(len(text) for _, text in main)
            # What holds most of an article is shared by copies of it and no frame; nor is all that a page has.
            out.append("\n".join([text for _, text in main] if not kept or (articles and 2 * kept <= whole) else slots))
        yield {"page_id": batch["page_id"], "url": batch["url"], "text": out, "n_chars": [len(t) for t in out]}


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, url, text, n_chars.

    Blocks of an article or main element are the main text where a page has one outside of the following, else all that
    no menu, header, footer, sidebar, notice, advert, form or comment holds. Blocks that are tokens of a valid class, on
    hosts with five or more pages, are template and left out, unless nothing, or no more than half of the article, would
    remain: such blocks are text that copies of one article share. A block that one page of a host repeats differs in its
    vector from the rest of the template and stays. Null and empty pages give an empty text; pages without a host share
    the template of all such pages; rows that repeat are extracted each on its own.
    """
    known = _small(templates(pages), "size(tokens)")
    return map_batches(_pages(pages).join(known, "host", "left").select("page_id", "url", "html", "tokens"), _extract, "page_id long, url string, text string, n_chars long")
