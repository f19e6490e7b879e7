"""Near-duplicate classes by BagMinHash: weighted signatures, bands, and exact comparison of multisets of shingles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, discard, map_batches, mix, staged, texts, whole_row
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: At a likeness of 0.8 a pair shares one of 25 bands of 5 components with probability 0.99995.
BANDS, BAND_ROWS = 25, 5
COMPONENTS = BANDS * BAND_ROWS
#: Rounds at most in which a bucket's texts are compared with one leader, before the rest is joined exactly; they end once one has not halved the rows.
STAR_ROUNDS = 4
#: Likewise texts that share one of their rarest items, while a row would be joined to more than so many others and the last round has halved the pairs.
PAIRS_A_ROW = 8
#: 64-bit words of a multiset's parities; multisets differ in as many items at least as their parities in bits.
PARITY_WORDS = 16
#: Rows up to which keys, leaders and decisions (16 to 40 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 250_000

_U = np.uint64
_TABLES: dict[str, np.ndarray] = {}


def _alnum() -> np.ndarray:
    if "alnum" not in _TABLES:
        _TABLES["alnum"] = np.frombuffer(bytes(chr(c).isalnum() for c in range(0x110000)), bool)
    return _TABLES["alnum"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers, and their inverses, modulo 2^64."""
    if "powers" not in _TABLES or len(_TABLES["powers"]) < n:
        for name, base in (("powers", MULTIPLIER), ("inverses", pow(MULTIPLIER, -1, 1 << 64))):
            _TABLES[name] = np.cumprod(np.concatenate([[_U(1)], np.full(n, base, _U)]), dtype=_U)
    return _TABLES["powers"], _TABLES["inverses"]


def shingles(batch: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of every run of ``width`` words (letters and digits, in lower case) of some texts.

    A text of fewer words is one shingle, a text without words none. A word's hash is a difference of sums of powers
    over the whole batch, so no word is handled by itself.
    """
    lowered = [t.lower() for t in batch]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(np.diff(_alnum()[codes], prepend=False, append=False))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, _U)
    powers, inverses = _powers(len(codes))
    sums = np.concatenate([[_U(0)], np.cumsum(codes * powers[: len(codes)], dtype=_U)])
    word = mix((sums[last] - sums[first]) * inverses[first] + (last - first).astype(_U))
    starts = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    document = np.searchsorted(starts, first, "right") - 1
    n = np.bincount(document, minlength=len(batch))
    begin = np.cumsum(n) - n
    at = np.flatnonzero(np.arange(len(word)) < (begin + np.maximum(n - width + 1, np.minimum(n, 1)))[document])
    key = np.zeros(len(at), _U)
    for k in range(width):
        inside = at + k < (begin + n)[document[at]]
        key = key * _U(MULTIPLIER) + np.where(inside, word[np.minimum(at + k, len(word) - 1)], _U(0))
    return document[at], mix(key)


def counted(document: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with how often each occurs."""
    order = np.lexsort((key, document))
    document, key = document[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (document[1:] != document[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.empty(0, np.int64)
    return document[new], key[new], np.diff(np.append(new, len(key)))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(document: np.ndarray, key: np.ndarray, weight: np.ndarray, n_documents: int, components: int = COMPONENTS) -> np.ndarray:
    """A weighted minwise signature for each document: two agree in a component with probability equal to their likeness.

    A shingle's weight is cut into levels [0, 1), [1, 2), [2, 4), [4, 8), ...; each level of each shingle is a Poisson
    process of points in time, at a rate of the level's width. A point has a random component, and a random weight
    within its level that must lie below the shingle's own. Each component keeps its earliest point. Processes are
    followed up to a time by which nearly every component has one; documents that still lack one are followed on.
    """
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    entry = np.repeat(np.arange(len(key)), levels)
    level = np.arange(len(entry)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.maximum(low, 1.0)
    seed = mix(key[entry] + level.astype(_U) * _U(MULTIPLIER))
    doc, own = document[entry], weight[entry]
    total = np.bincount(document, weight, n_documents)
    earliest = np.full(n_documents * components, np.inf)
    point = np.zeros(n_documents * components, _U)
    bound = components * (np.log(components) + 6) / np.maximum(total, 1)
    live = np.arange(len(entry))
    while len(live):
        s, d, t = seed[live], doc[live], np.zeros(len(live))
        at, number = np.arange(len(live)), 0
        while len(at):
            number += 1
            h = mix(s[at] ^ _U(number * MULTIPLIER & (1 << 64) - 1))
            t[at] -= np.log(_unit(h)) / width[live[at]]
            in_time = t[at] <= bound[d[at]]
            at, h = at[in_time], h[in_time]
            other = mix(h)
            valid = low[live[at]] + width[live[at]] * _unit(mix(other)) < own[live[at]]
            cell = d[at[valid]] * components + (other[valid] % _U(components)).astype(np.int64)
            when = t[at[valid]]
            np.minimum.at(earliest, cell, when)
            won = earliest[cell] == when
            point[cell[won]] = h[valid][won]
        lacking = np.isinf(earliest.reshape(n_documents, components)).any(1) & (total > 0)
        bound = np.where(lacking, bound * 2, bound)
        live = live[lacking[doc[live]]]
    return point.reshape(n_documents, components)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, its number mixed in."""
    parts = signature.reshape(len(signature), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=_U), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key = mix(key * _U(MULTIPLIER) + parts[:, :, k])
    return key


def _slices(batch: list[str], size: int = 300_000, rows: int = 1_000):
    begin, total = 0, 0
    for i, t in enumerate(batch):
        total += len(t)
        if total >= size or i + 1 - begin >= rows:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(batch):
        yield begin, len(batch)


def _sketch(batches):
    for batch in batches:
        for a, b in _slices(batch["text"]):
            document, key, weight = counted(*shingles(batch["text"][a:b]))
            n = b - a
            total = np.bincount(document, weight, n).astype(np.int64)
            bands = band_keys(signatures(document, key, weight, n)).view(np.int64)
            sums = []
            for salt in (1, 2):
                s = np.zeros(n, _U)
                np.add.at(s, document, mix(key ^ _U(salt)) * weight.astype(_U))
                sums.append(s.view(np.int64))
            yield {
                "doc_id": batch["doc_id"][a:b],
                "text_hash": batch["text_hash"][a:b],
                "k1": sums[0],
                "k2": sums[1],
                "n": total,
                "bands": [list(x) if t else [] for x, t in zip(bands, total, strict=True)],
            }


def _bag(batches):
    """Each text's shingles as a sorted array, the second, third, ... of a shingle with a hash of its own; and how often items fall on each bit, modulo 2."""
    for batch in batches:
        for a, b in _slices(batch["text"]):
            document, key, weight = counted(*shingles(batch["text"][a:b]))
            entry = np.repeat(np.arange(len(key)), weight)
            turn = np.arange(len(entry)) - np.repeat(np.cumsum(weight) - weight, weight)
            item = np.where(turn > 0, mix(key[entry] + turn.astype(_U)), key[entry])
            own = document[entry]
            cuts = np.searchsorted(own, np.arange(b - a + 1))
            parity = np.zeros((b - a, PARITY_WORDS), _U)
            np.bitwise_xor.at(parity, (own, (item >> _U(6)) % _U(PARITY_WORDS)), _U(1) << (item & _U(63)))
            item = item.view(np.int64)
            yield {"rep": batch["rep"][a:b], "bag": [np.sort(item[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)], "parity": list(parity.view(np.int64))}


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, class_id, class_size, kept, text_hash, and component.

    Texts are near when their multisets of five-word shingles have a weighted Jaccard likeness of 0.8 or more; classes
    are the connected components, named by their least doc_id (null only if the class has no other). Texts with equal
    multisets are always in one class, as are all texts without a word (null, empty, punctuation only). ``kept`` marks
    rows of the least doc_id; rows that repeat it are all marked, and keep_one() takes one. ``component`` tells classes
    apart where class_id does not, as among classes of null ids; its values hold for one run. An empty table gives an
    empty result.

    Equal multisets are one representative from the start. In each round every text of a bucket meets the bucket's
    leader, who then leaves it, as long as the bucket holds several classes: a class of any size costs a few comparisons
    a text, and a bucket of few texts is decided. Of what buckets are left when rounds no longer halve them, texts that share one of
    their rarest items meet likewise, the most ordinary ones first, and what is left then is joined exactly. So every
    pair that shares a bucket is compared, or known to be connected, or known to be too unlike.
    """
    hashed = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = staged(map_batches(hashed, _sketch, "doc_id long, text_hash long, k1 long, k2 long, n long, bands array<long>"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash"))
    reps = rows.groupBy("k1", "k2").agg(first.alias("f"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    reps = staged(reps.select(F.monotonically_increasing_id().alias("rep"), "k1", "k2", "f.doc_id", "f.text_hash", "n", "bands", "copies"), "representatives")

    buckets = reps.select("rep", "n", F.explode("bands").alias("group"))
    shared = staged(buckets.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1").select("group"), "shared")
    placed = staged(buckets.join(_bounded(shared), "group").withColumn("component", F.col("rep")), "buckets")
    labels = staged(placed.select("rep").distinct().join(reps.select("rep", "doc_id", "text_hash", "copies"), "rep").withColumn("component", F.col("rep")), "labels")
    wanted = labels.select("rep", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    found = hashed.join(_bounded(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("rep", "text")
    bags = staged(map_batches(found, _bag, "rep long, bag array<long>, parity array<long>"), "bags")
    if bags.count() > labels.count():  # rows that repeat a doc_id and its text, which well-formed tables lack
        repeated, bags = bags, staged(bags.dropDuplicates(["rep"]), "bags")
        discard(repeated)
    discard(shared)

    apart: list[DataFrame] = []
    turn, before = 0, None
    led, mixed = _leaders(placed)
    while mixed and turn < STAR_ROUNDS and (before is None or mixed <= before / 2):
        met = _meet(placed, led)
        discard(placed, led)
        pairs = met.filter(_may_be_near("n", "n_2") & (F.col("component") != F.col("component_2")))
        merged = _merged(_compare(pairs, bags, apart))
        labels = _relabelled(labels, merged, "labels")
        placed = _relabelled(met.select("group", "rep", "n", "component"), merged, "buckets")
        discard(met, merged)
        turn, before = turn + 1, mixed
        led, mixed = _leaders(placed)
    if mixed:
        rare = _rarest_items(placed.join(_bounded(led.select("group")), "group", "left_semi"), bags)
    discard(placed, led)
    if mixed:
        before, (n_rows, pairs) = None, _sizes(rare)
        while pairs > PAIRS_A_ROW * n_rows and (before is None or pairs <= before / 2):
            led, _ = _leaders(rare, "common")
            met = _meet(rare, led)
            discard(rare, led)
            merged = _merged(_compare(met.filter(_fit()), bags, apart))
            labels = _relabelled(labels, merged, "labels")
            rare = _relabelled(met.select("group", "rep", "n", "component", "place", "common"), merged, "rare-items")
            discard(met, merged)
            before, (n_rows, pairs) = pairs, _sizes(rare)
        candidates = _item_pairs(rare, bags)
        merged = _merged(_compare(candidates, bags, apart))
        labels = _relabelled(labels, merged, "labels")
        discard(rare, candidates, merged)
    discard(bags, *apart)

    classes = staged(labels.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size")), "classes")
    linked = labels.select("rep", "component").join(_bounded(classes), "component")
    own = F.struct(F.col("rep").alias("component"), F.col("doc_id").alias("class_id"), F.col("copies").alias("class_size"))
    named = reps.select("rep", "k1", "k2", own.alias("own")).join(linked.select("rep", F.struct("component", "class_id", "class_size").alias("joint")), "rep", "left")
    named = staged(named.select("k1", "k2", F.coalesce("joint", "own").alias("c")).select("k1", "k2", "c.*"), "named")
    discard(reps, labels, classes)
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    return rows.select("doc_id", "text_hash", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "class_id", "class_size", kept.alias("kept"), "text_hash", "component")


def _bounded(df: DataFrame) -> DataFrame:
    """A staged table, to be broadcast if it has at most BROADCAST_ROWS rows (16 to 40 bytes each); else the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _may_be_near(n: str, n_2: str) -> Column:
    """Whether multisets of these sizes can be as alike as the threshold asks."""
    return F.least(n, n_2) >= F.greatest(n, n_2) * F.lit(THRESHOLD) - 1e-9


def _leaders(placed: DataFrame, first: str | None = None) -> tuple[DataFrame, int]:
    """The leader of each group of placed(group, rep, n, component, ...) that has several components, and how many rows those groups have.

    The leader is the member with the greatest value of ``first``, and of these that with the least hash: the same one
    in most of the groups that two texts share. Its columns are called leader, n_2, component_2, ...
    """
    others = [c for c in placed.columns if c not in ("group", "rep", first)]
    order = [*([(-F.col(first)).alias("first")] if first else []), F.xxhash64("rep").alias("order")]
    leader = F.min(F.struct(*order, "rep", *others)).alias("leader")
    led = placed.groupBy("group").agg(leader, F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).filter("x != y")
    led = staged(led.select("group", F.col("leader.rep").alias("leader"), *(F.col(f"leader.{c}").alias(f"{c}_2") for c in others), "members"), "leaders")
    return led, led.agg(F.sum("members")).first()[0] or 0


def _meet(placed: DataFrame, led: DataFrame) -> DataFrame:
    """Each row of placed beside its group's leader, who drops out; groups without one of led are left out."""
    return staged(placed.join(_bounded(led.drop("members")), "group").filter("rep != leader"), "met")


def _compare(pairs: DataFrame, bags: DataFrame, apart: list[DataFrame]) -> DataFrame:
    """The components that near ones of pairs(rep, leader, n, n_2, component, component_2) link; those compared that aren't near go into ``apart``.

    Parities come first: a few bytes a text show most pairs to be too unlike. The rest are compared row by row in the
    JVM, where two multisets are all that is held; only theirs move. Pairs take up the bag of ``rep`` first, so that a
    leader of many texts makes a partition of many bytes, which adaptive execution splits.
    """
    pairs = pairs.select("rep", "leader", "n", "n_2", "component", "component_2").distinct()
    for known in apart:
        pairs = pairs.join(known, ["rep", "leader"], "left_anti")
    pairs = staged(pairs, "pairs")
    of = lambda what, whose, name: bags.select(F.col("rep").alias(whose), F.col(what).alias(name))
    alike = of("parity", "rep", "parity").join(_bounded(pairs), "rep").join(of("parity", "leader", "parity_2"), "leader").filter(_alike())
    likely = staged(alike.select("rep", "leader", "component", "component_2"), "likely")
    leaders = staged(likely.select("leader").distinct(), "leaders")
    left, right = of("bag", "rep", "bag_rep").join(_bounded(likely), "rep"), of("bag", "leader", "bag_leader").join(_bounded(leaders), "leader", "left_semi")
    both = F.size(F.array_intersect("bag_rep", "bag_leader"))
    near = both >= F.lit(THRESHOLD) * (F.size("bag_rep") + F.size("bag_leader") - both) - 1e-9
    done = staged(left.join(right, "leader").select("rep", "leader", "component", "component_2", near.alias("near")), "compared")
    apart.append(staged(done.filter("NOT near").select("rep", "leader"), "apart"))
    links = staged(done.filter("near").select(F.col("component").alias("a"), F.col("component_2").alias("b")).distinct(), "links")
    discard(pairs, likely, leaders, done)
    return links


def _merged(links: DataFrame) -> DataFrame:
    """(node, component) of components that links(a, b) join; only the components of the last round are nodes, so links stay few."""
    merged = components(links)
    discard(links)
    return merged


def _relabelled(df: DataFrame, merged: DataFrame, name: str) -> DataFrame:
    """df with its components as merged."""
    new = _bounded(merged).select(F.col("node").alias("component"), F.col("component").alias("_new"))
    out = staged(df.join(new, "component", "left").withColumn("component", F.coalesce("_new", "component")).drop("_new"), name)
    if hasattr(df, "scratch"):
        discard(df)
    return out


def _rarest_items(placed: DataFrame, bags: DataFrame) -> DataFrame:
    """(group, rep, n, component, place, common) of the rarest items of each text of placed(group, rep, n, component).

    Multisets of sizes n and m are near only if they share 4/9 (n + m) items. So they share one at a place, from the
    rarest on, of at most n - ceil(4/9 (n + m)) + 1 in the one and likewise in the other. A group is an item that several
    texts have; ``common`` is how many have a text's rarest items in the mean, so it is great for those that others vary.
    """
    apart = staged(placed.select("rep", "n", "component").distinct(), "apart-texts")
    items = staged(apart.join(bags.select("rep", "bag"), "rep").select("rep", "n", "component", F.explode("bag").alias("item")), "items")
    often = items.groupBy("item").agg(F.count("*").alias("df"))
    ranked = items.join(often, "item").groupBy("rep", "n", "component").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("items"))
    ranked = ranked.withColumn("items", F.slice("items", 1, (F.col("n") - F.ceil(F.col("n") * THRESHOLD - 1e-9) + 1).cast("int")))
    common = F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["df"]) / F.size("items")
    places = ranked.select("rep", "n", "component", common.alias("common"), F.posexplode("items").alias("place", "it"))
    rare = staged(places.filter("it.df > 1").select(F.col("it.item").alias("group"), "rep", "n", "component", (F.col("place") + 1).alias("place"), "common"), "rare-items")
    discard(apart, items)
    return rare


def _fit() -> Column:
    """Whether rows that share a rare item, of two components, can be near by their sizes and the item's places."""
    needed = F.ceil(F.lit(THRESHOLD / (1 + THRESHOLD)) * (F.col("n") + F.col("n_2")) - 1e-9)
    return _may_be_near("n", "n_2") & (F.col("component") != F.col("component_2")) & (F.col("place") <= F.col("n") - needed + 1) & (F.col("place_2") <= F.col("n_2") - needed + 1)


def _alike() -> Column:
    """Whether two texts can be near by their parities: near multisets differ in (n + m) / 9 items at most, so their parities do in no more bits."""
    bits = sum((F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("parity_2", F.lit(i)))) for i in range(PARITY_WORDS)), F.lit(0))
    return bits <= F.lit((1 - THRESHOLD) / (1 + THRESHOLD)) * (F.col("n") + F.col("n_2")) + 1e-9


def _mains(rare: DataFrame) -> DataFrame:
    """(group, main, size, members): each item's largest component, for items of several components."""
    sizes = rare.groupBy("group", "component").agg(F.count("*").alias("size"))
    most = sizes.groupBy("group").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("several"), F.sum("size").alias("members"))
    return most.filter("several > 1").select("group", F.col("main.component").alias("main"), F.col("main.size").alias("size"), "members")


def _sizes(rare: DataFrame) -> tuple[int, float]:
    """The rows of items of several components, and the pairs that a join of them meets."""
    others = F.col("members") - F.col("size")
    found = _mains(rare).agg(F.sum("members").alias("rows"), F.sum(F.col("size") * others + others * others / 2).alias("pairs")).first()
    return found["rows"] or 0, found["pairs"] or 0


def _item_pairs(rare: DataFrame, bags: DataFrame) -> DataFrame:
    """Candidate pairs, each once, of rare(group, rep, n, component, place): (rep, leader, n, n_2, component, component_2).

    Of an item's components, the smaller ones meet all: members of the largest need no partners among themselves.
    """
    main = staged(_mains(rare).select("group", "main"), "main")
    left = staged(rare.join(_bounded(main), "group"), "mixed")
    parities = bags.join(left.select("rep").distinct(), "rep", "left_semi").select("rep", "parity")
    mixed = staged(left.join(parities, "rep"), "mixed-parities")
    few = mixed.filter("component != main").select("group", *(F.col(c).alias(f"{c}_2") for c in ("rep", "n", "component", "place", "parity")))
    # Of two members of smaller components, the pair is made once.
    once = (F.col("component") == F.col("main")) | (F.col("rep") > F.col("rep_2"))
    pairs = staged(mixed.join(few, "group").filter(once & _fit() & _alike()).select("rep", F.col("rep_2").alias("leader"), "n", "n_2", "component", "component_2").distinct(), "item-pairs")
    discard(main, left, mixed)
    return pairs


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near_classes, with all columns of docs.

    Up to BROADCAST_ROWS dropped rows are broadcast by doc_id and a hash of the text; beyond that the join shuffles.
    """
    found = staged(near_classes(docs).filter("class_size > 1"), "decisions")
    keys = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.max("kept").alias("stays"), F.count("*").alias("n"), F.first("component").alias("component"))
    # Of a class's rows that share the kept doc_id the first text stays; only such rows, which well-formed tables lack, need it.
    stay = keys.filter("stays").groupBy("component").agg(F.min("_hash").alias("keep_hash"))
    keys = staged(keys.join(stay, "component", "left"), "keys")
    stays = F.col("stays") & (F.col("_hash") == F.col("keep_hash"))
    dropped = keys.filter(~F.coalesce(stays, F.lit(False))).select("_id", "_hash")
    repeated = keys.filter(stays & (F.col("n") > 1)).select("_id", "_hash")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    hashed = docs.select(whole_row(), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text_hash"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    out = hashed.join(dropped, same, "left_anti")
    if not repeated.isEmpty():
        again = out.join(repeated, same, "left_semi").dropDuplicates(["_doc", "_text_hash"])
        out = out.join(repeated, same, "left_anti").unionByName(again)
    return out.select("_row.*")
