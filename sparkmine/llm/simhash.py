"""SimHash near-duplicates: a binary trie joined with itself under a Hamming error budget.

Copies share a fingerprint, so rows are first reduced to distinct fingerprints. Two fingerprints of 64 bits with at
most ``bits`` differing bits have at most ``bits // 2`` of them in one of their halves. So two tries are walked, one
over the bits as they are and one with the halves swapped, with a budget of bits // 2 for the first 32 levels and of
bits below. A walk takes pairs of nodes together, adds up their differing bits, and drops a pair whose budget is
exceeded. The top levels deal subtrees out to tasks: a fingerprint goes to its own subtree and to the lower-numbered
ones within the budget; subtrees that are too large are parted by further levels. Within a task, links are merged at once into components, and pairs of subtrees that are already
one component aren't opened, so dense groups don't give all their pairs. What leaves a task is one link per fingerprint
at most; the components of these links are found by iterating over written tables.

Nulls and empty texts have fingerprint zero and are linked like any other. Repeated rows and ids keep their rows; a
null id counts in no component's smallest id. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmine.llm import fingerprints as sketches
from sparkmine.lineage import drop
from sparkmine.llm.common import bounded, give_back, partitions, written
from sparkmine.llm.encode import batches

SHINGLE, BITS, SEED = 3, 3, 42
#: Fingerprints that a task's subtree has on average at most, levels by which twice as large ones are parted, and node pairs
#: opened at once.
SUBTREE, STEP, CHUNK = 40_000, 4, 1 << 18
#: Numbers of rows that stay are broadcast up to so many.
BROADCAST_ROWS = 1_000_000


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": np.array([text_fingerprint(t, shingle) for t in pdf["text"]], dtype=np.int64)})

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(make, "doc_id long, fp long")


class _Components:
    """Components of the rows of a sorted array, and which ranges of it are one component."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.changes = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        a, b = label[a], label[b]
        while True:
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            parent = np.arange(len(label))
            np.minimum.at(parent, high, low)
            while (jump := parent[parent] != parent).any():
                parent[jump] = parent[parent[jump]]
            label = parent[label]
            a, b = parent[a], parent[b]
        self.label = label
        self.changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])

    def one(self, a0, a1, b0, b1) -> np.ndarray:
        """Whether the ranges [a0, a1) and [b0, b1) are within one and the same component."""
        return (self.changes[a1 - 1] == self.changes[a0]) & (self.changes[b1 - 1] == self.changes[b0]) & (self.label[a0] == self.label[b0])


def trie_components(keys: np.ndarray, bits: int = BITS, depth: int = 0, groups: np.ndarray | None = None) -> np.ndarray:
    """Component of each of the sorted, distinct uint64 keys under links of at most bits differing bits, of which at most
    bits // 2 in the first 32. Only pairs with a member in the first group are linked if groups (False: foreign) is given.
    """
    n = len(keys)
    comps = _Components(n)
    own = np.concatenate([[0], np.cumsum(np.ones(n, bool) if groups is None else groups)])
    half = bits // 2
    # each entry: level, ranges of both nodes, differing bits so far
    stack = [(0, *(np.array([x]) for x in (0, n, 0, n, 0)))] if n else []
    while stack:
        level, a0, a1, b0, b1, err = stack.pop()
        keep = ~comps.one(a0, a1, b0, b1) & ((own[a1] > own[a0]) | (own[b1] > own[b0]))
        a0, a1, b0, b1, err = a0[keep], a1[keep], b0[keep], b1[keep], err[keep]
        if not len(a0):
            continue
        if len(a0) > CHUNK:
            cutoff = len(a0) // 2
            stack += [(level, a0[s], a1[s], b0[s], b1[s], err[s]) for s in (slice(cutoff, None), slice(cutoff))]
            continue
        if level == 64:
            comps.link(a0, b0)
            continue
        # a range of one key needs no search; others are parted where the bit at this level becomes one
        bit = np.uint64(1) << np.uint64(63 - level)

        def part(lo: np.ndarray, hi: np.ndarray, bit=bit) -> np.ndarray:
            mid = hi.copy()
            single = hi - lo == 1
            mid[single] = lo[single] + ((keys[lo[single]] & bit) == 0)
            if not single.all():
                base = keys[lo[~single]]
                prefix = base & ~(bit | (bit - np.uint64(1)))
                mid[~single] = np.clip(np.searchsorted(keys, prefix | bit), lo[~single], hi[~single])
            return mid

        am, bm = part(a0, a1), part(b0, b1)
        budget = half if level < 32 else bits
        out = []
        same = (a0 == b0) & (a1 == b1)
        for x0, x1, y0, y1, more, need in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            ok = (x1 > x0) & (y1 > y0) & (err + more <= budget)
            if need is not None:
                ok &= need
            out.append((x0[ok], x1[ok], y0[ok], y1[ok], err[ok] + more))
        stack.append((level + 1, *(np.concatenate(c) for c in zip(*out, strict=True))))
    return comps.label


def _swap(x: np.ndarray) -> np.ndarray:
    return (x << np.uint64(32)) | (x >> np.uint64(32))


def links(distinct: DataFrame, bits: int = BITS, subtree: int = SUBTREE) -> DataFrame:
    """fp, root: for each task's component of two or more fingerprints, links to its smallest; no link between different
    fingerprints is lost to components. distinct: one row per fingerprint (fp long).

    Subtrees begin as deep as makes them subtree large on average; those of more than twice that are parted by STEP
    further levels, again and again, down to the whole first half.
    """
    half, n = bits // 2, distinct.count()
    p = min(20, max(4, int(np.ceil(np.log2(max(1, n) / subtree)))))
    halves = [F.col("fp"), F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))]
    rows = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), h.alias("key")) for i, h in enumerate(halves)])).alias("x")).select("fp", "x.*")
    rows = rows.select("fp", "turn", "key", F.lit(0).cast("long").alias("home"), F.lit(True).alias("own"), F.lit(0).alias("used"))

    def parted(rows: DataFrame, done: int, more: int) -> DataFrame:
        """Rows of subtrees done levels deep, dealt to their own subtrees more levels deeper and to those within the budget:
        pairs of own rows meet in the lower one's, foreign rows go wherever own ones may be."""
        masks = [(m, bin(m).count("1")) for m in range(1 << more) if bin(m).count("1") <= half] if more <= 12 else [(0, 0)]
        if more > 12:  # the same, without looking at every number
            for _ in range(half):
                masks = sorted({(m | 1 << i, bin(m | 1 << i).count("1")) for m, _ in masks for i in range(more)} | set(masks))
        here = F.shiftrightunsigned("key", 64 - done - more).bitwiseAND(F.lit((1 << more) - 1).cast("long"))
        each = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(c).alias("count")) for m, c in masks])
        dealt = rows.withColumn("here", here).withColumn("m", F.explode(F.filter(each, lambda x: x["count"] + F.col("used") <= half)))
        to = F.col("here").bitwiseXOR(F.col("m.mask"))
        return dealt.where(~F.col("own") | (to <= F.col("here"))).select(
            "fp", "turn", "key", (F.col("home") * (1 << more) + to).alias("home"), (F.col("own") & (F.col("m.mask") == 0)).alias("own"), (F.col("used") + F.col("m.count")).alias("used")
        )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["fp"].to_numpy().astype(np.uint64)
        if pdf["turn"].iloc[0]:
            keys = _swap(keys)
        order = np.argsort(keys)
        keys = keys[order]
        label = trie_components(keys, bits, groups=pdf["own"].to_numpy()[order])
        multi = np.bincount(label, minlength=len(label))[label] > 1
        fp = pdf["fp"].to_numpy()[order]
        return pd.DataFrame({"fp": fp[multi], "root": fp[label[multi]]})

    found, rows = [], parted(rows, 0, p)
    while True:
        sizes = rows.groupBy("turn", "home").agg(F.count("*").alias("n")).where(F.col("n") > 2 * subtree).select(F.col("turn").alias("t"), F.col("home").alias("h"))
        large = written(sizes) if p < 32 else None
        count = large.count() if large is not None else 0
        small = rows
        if count:
            large = F.broadcast(large) if count <= BROADCAST_ROWS else large
            same = (F.col("turn") == F.col("t")) & (F.col("home") == F.col("h"))
            small = rows.join(large, same, "left_anti")
        found.append(small.repartition(max(partitions(distinct), 2 << min(p, 10)), "turn", "home").groupBy("turn", "home").applyInPandas(walk, "fp long, root long"))
        if not count:
            return reduce(DataFrame.unionByName, found)
        more = min(STEP, 32 - p)
        rows = parted(rows.join(large, same, "left_semi"), p, more)
        p += more


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of the edges (u, v long) reaches.

    Alternates large-star and small-star, each round written; map-side minima keep hubs from gathering in one task.
    """
    marks = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % (1 << 40)).alias("s")).first()
    edges, before = written(edges.where("u <> v").distinct()), None
    while True:
        # a star forest that no longer changes: as many edges as before, of the same hashes
        now = marks(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, before, edges = edges, now, written(small)
        drop(old)


def groups_of(marked: DataFrame, bits: int = BITS) -> DataFrame:
    """fp, component (a fingerprint that stands for its group), component_id (the least id): one row per fingerprint."""
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = written(links(distinct.select("fp"), bits).distinct())
    first = linked.groupBy("fp").agg(F.min("root").alias("first"))
    # components that share a fingerprint are linked through their roots, of which there are far fewer
    bridges = linked.join(first, "fp").select(F.col("root").alias("u"), F.col("first").alias("v"))
    label = connected(bridges)
    member = written(first.join(label, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("label", "first").alias("label")))
    least = member.join(distinct, "fp").groupBy("label").agg(F.min("least_id").alias("component_id"))
    known = written(member.join(least, "label").select("fp", "label", "component_id"))
    return distinct.join(known, "fp", "left").select("fp", F.coalesce("label", "fp").alias("component"), F.when(F.col("label").isNotNull(), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id: one row per row of docs."""
    marked = written(fingerprints(docs, id_col, text_col, shingle))
    groups = written(groups_of(marked, bits).select("fp", "component_id"))
    # a row per fingerprint: few are broadcast, many are joined by shuffle, where a fingerprint of many rows is split
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    return marked.join(groups, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """docs with one row of each group: that of the least id (a null id last), with all its columns."""
    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(_simhash_fp=np.array([text_fingerprint(t, shingle) for t in pdf[text_col]], dtype=np.int64))

    hashed = docs.mapInPandas(make, T.StructType([*docs.schema.fields, T.StructField("_simhash_fp", T.LongType())]))
    marked = written(hashed.withColumn("_simhash_row", F.monotonically_increasing_id()))
    groups = groups_of(marked.select(F.col(id_col).cast("long").alias("doc_id"), F.col("_simhash_fp").alias("fp")), bits)
    least = F.min(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("_simhash_row").alias("row")))
    pairs = marked.groupBy("_simhash_fp").agg(least.alias("at"))
    stays = written(pairs.join(groups, F.col("_simhash_fp") == F.col("fp")).groupBy("component").agg(F.min("at").alias("at")).select(F.col("at.row").alias("_simhash_row")))
    # one number per row that stays; few are broadcast, many are joined by shuffle
    stays = F.broadcast(stays) if stays.count() <= BROADCAST_ROWS else stays
    return marked.join(stays, "_simhash_row", "left_semi").drop("_simhash_fp", "_simhash_row")


# ---- every pair from a resemblance on, for the pipeline ---------------------------------------------------------------

#: Least resemblance of five-word shingle sets, as a fraction, from which two texts are near-duplicates.
SIMILAR = (4, 5)
#: Texts whose shingles are counted to find common ones, how many of them must hold a common one, and common ones known at most.
#: They come last in the order of shingles: any one order gives the same pairs, only the number of candidates differs.
COUNTED, COMMON, KNOWN = 4096, 8, 1 << 16
#: Rounds in which a row is compared with a few partners before all that is left is compared.
LIKELIEST, PARTNERS = 1, 16
#: A shingle in the prefixes of more rows than CROWD is crowded, unless one of its rows has more than WIDE shingles. Rows that
#: crowded shingles chain together are a crowd; it is compared by blocks of about BLOCK rows if it has at most SPREAD times
#: the rows of its most crowded shingle.
CROWD, WIDE, BLOCK, SPREAD = 64, 4096, 256, 4
_ALL = 1 << 60


def shingle_set(text: str | None) -> np.ndarray:
    """All distinct hashes of a text's five-word shingles, ascending as signed 64-bit integers."""
    return (sketches.sketch(text, _ALL) ^ np.uint64(1 << 63)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = SIMILAR) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * (least[0] + least[1]) >= least[0] * (len(a) + len(b))


def _prefix(n, least: tuple[int, int]):
    """So many of its n first shingles that any similar set has one of them among its own; numbers or columns."""
    most = n * least[0] + least[1] - 1
    return n - (F.floor(most / least[1]) if isinstance(n, Column) else most // least[1]) + 1


def ordered_prefix(s: np.ndarray, common: np.ndarray, least: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The first shingles of a set, common ones (ascending) last."""
    if not len(s):
        return s
    k = _prefix(len(s), least)
    if len(common):
        known = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        s = np.concatenate([s[~known], s[known]])
    return s[:k]


def common_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """Shingles that COMMON or more of about COUNTED distinct texts hold: KNOWN at most, the commonest."""
    some = docs.select(F.col(text_col).alias("text")).sample(min(1.0, COUNTED / max(1, docs.count())), SEED).distinct()

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf["text"]:
                yield pd.DataFrame({"h": shingle_set(t)})

    held = some.mapInPandas(each, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = np.array(sorted(r["h"] for r in held.orderBy(F.desc("n"), "h").limit(KNOWN).collect()), np.int64)
    give_back()
    return found


def _may_be_similar(pairs: DataFrame, least: tuple[int, int]) -> DataFrame:
    """u, v, seen of those (u, v, un, vn, one row per shared prefix shingle) that can still be similar.

    Up to where the shorter of both prefixes ends all shared shingles are seen; beyond it, at most that set's rest is shared.
    """
    counted = pairs.groupBy("u", "v").agg(F.count("*").alias("seen"), *[F.first(c).alias(c) for c in ("un", "vn")])
    rest = F.greatest(*[F.col(c) - _prefix(F.col(c), least) for c in ("un", "vn")])
    return counted.where((F.col("seen") + rest) * sum(least) >= (F.col("un") + F.col("vn")) * least[0]).select("u", "v", "seen")


def _verified(pairs: DataFrame, texts: DataFrame, least: tuple[int, int], made: list[DataFrame]) -> DataFrame:
    """The pairs (u, v) of rows whose texts (row, text) are similar, compared exactly."""
    pairs = written(pairs.distinct())
    asked = written(pairs.select(F.col("u").alias("row")).union(pairs.select(F.col("v").alias("row"))).distinct())
    some = texts.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, "row", "left_semi")
    both = pairs.join(some.select(F.col("row").alias("u"), F.col("text").alias("a")), "u").join(some.select(F.col("row").alias("v"), F.col("text").alias("b")), "v")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.loc[[similar(shingle_set(a), shingle_set(b), least) for a, b in zip(pdf["a"], pdf["b"], strict=True)], ["u", "v"]]

    found = written(both.mapInPandas(compare, "u long, v long"))
    made += [pairs, asked, found]
    return found


def _settled(pairs: DataFrame, more: DataFrame, texts: DataFrame, least: tuple[int, int], made: list[DataFrame], known: bool = False) -> DataFrame:
    """Links that have the components of all similar ones among pairs (u, v, seen) and more (u, v; similar already if known).

    In each of the first rounds every row is compared with the likeliest of its partners, PARTNERS of them, that aren't in its
    component yet; in the last one all pairs are compared that are still between components.
    """
    links_, pairs = more, written(pairs)
    for i in range(LIKELIEST + 1):
        turn = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("seen"), "u"))
        likeliest = pairs.withColumn("turn", turn).where(F.col("turn") <= PARTNERS).select("u", "v")
        asked = written((likeliest if i < LIKELIEST else pairs.select("u", "v")).union(more if not (i or known) else more.limit(0)))
        found = _verified(asked, texts, least, made)
        links_ = written(links_.union(found).distinct()) if i or known else found
        if i == LIKELIEST:
            return links_
        label = connected(links_)
        at = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"{side}comp"))  # noqa: B023, E731
        left = pairs.join(asked.select("u", "v"), ["u", "v"], "left_anti").join(at("u"), "u", "left").join(at("v"), "v", "left")
        left = written(left.where(F.coalesce("ucomp", "u") != F.coalesce("vcomp", "v")).select("u", "v", "seen"))
        drop(pairs, asked)
        give_back()
        pairs = left
        if pairs.isEmpty():
            return links_


def _crowds(shared: DataFrame, made: list[DataFrame]) -> DataFrame | None:
    """row, crowd (its least row), blocks: the rows of crowds that are compared by blocks; None without any.

    Every shingle that is crowded has all its rows in one crowd, and shared marks it as such.
    """
    crowded = shared.where("crowded")
    if crowded.isEmpty():
        return None
    label = connected(crowded.select(F.col("m.row").alias("u"), F.col("row").alias("v")))
    rows = crowded.groupBy("row").agg(F.max("sharing").alias("most")).join(label, F.col("row") == F.col("node"), "left")
    rows = written(rows.select("row", "most", F.coalesce("label", "row").alias("crowd")))
    size = rows.groupBy("crowd").agg(F.count("*").alias("size"), F.max("most").alias("most")).where(F.col("size") <= SPREAD * F.col("most"))
    found = written(rows.join(size.select("crowd", F.ceil(F.col("size") / BLOCK).alias("blocks")), "crowd").select("row", "crowd", "blocks"))
    made += [rows, found]
    return found


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share, by matrix products over a few thousand elements at a time."""
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts > 1
    own, at = own[several[at]], (np.cumsum(several) - 1)[at[several[at]]]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    both = np.zeros((len(sets), len(sets)))
    for low in range(0, int(several.sum()), 4096):
        a, b = np.searchsorted(at, [low, low + 4096])
        ones = np.zeros((len(sets), 4096), np.float32)
        ones[own[a:b], at[a:b] - low] = 1
        both += ones @ ones.T
    return both.astype(np.int64)


def _linked_crowds(crowds: DataFrame, texts: DataFrame, least: tuple[int, int], made: list[DataFrame]) -> DataFrame:
    """u, v: links that have the components of all similar pairs within each crowd.

    Each two blocks of a crowd, and each with itself, meet in one task, which compares all their pairs exactly and passes on
    one link per row at most.
    """
    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.drop(columns="text").assign(set=[shingle_set(t).tobytes() for t in pdf["text"]])

    few = F.broadcast(crowds) if crowds.count() <= BROADCAST_ROWS else crowds
    rows = texts.join(few, "row").mapInPandas(sets, "row long, crowd long, blocks long, set binary")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    every = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = every.select("crowd", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "row", "set")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        row, block = pdf["row"].to_numpy(), pdf["block"].to_numpy()
        held = [np.frombuffer(s, np.int64) for s in pdf["set"]]
        n = np.array([len(s) for s in held])
        alike = _intersections(held) * sum(least) >= least[0] * (n[:, None] + n[None])
        if pdf["low"].iloc[0] != pdf["high"].iloc[0]:  # pairs within a block meet in its own task
            alike &= block[:, None] != block[None]
        comps = _Components(len(row))
        comps.link(*np.nonzero(np.triu(alike, 1)))
        later = comps.label != np.arange(len(row))
        return pd.DataFrame({"u": row[comps.label[later]], "v": row[later]})

    found = written(every.groupBy("crowd", "low", "high").applyInPandas(compare, "u long, v long"))
    made.append(found)
    return found


def one_of_each_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs with one row of each group of texts linked by a resemblance of least or more: that of the least id (a null
    id last), with all its columns.

    Equal shingle sets are reduced to one row. Candidates are the links of the tries and the pairs that share one of the
    first shingles of both sets, of which every similar pair has one; all are compared exactly on whole sets, unless they
    are in one component already. First a row is only held against the first row of a shingle, then against all, and each
    time against the one it shares most with before the others, so that dense groups don't give all their pairs. Rows of
    shingles that many rows share are compared within blocks instead, so that their pairs are never rows of a table. Common
    shingles are last in the order, so that a passage that many texts hold makes candidates only of texts that hold little
    else.
    """
    docs = bounded(docs)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col))

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a, b in batches(pdf[text_col].tolist()):
                part = pdf.iloc[a:b]
                sets = [shingle_set(t) for t in part[text_col]]
                yield part.assign(
                    _near_fp=np.array([text_fingerprint(t) for t in part[text_col]], dtype=np.int64),
                    _near_set=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                    _near_n=np.array([len(s) for s in sets], dtype=np.int64),
                    _near_prefix=[ordered_prefix(s, common.value, least) for s in sets],
                )

    added = [("_near_fp", T.LongType()), ("_near_set", T.BinaryType()), ("_near_n", T.LongType()), ("_near_prefix", T.ArrayType(T.LongType()))]
    hashed = docs.mapInPandas(make, T.StructType([*docs.schema.fields, *[T.StructField(*a) for a in added]]))
    marked = written(hashed.withColumn("_near_row", F.monotonically_increasing_id()))
    texts = marked.select(F.col("_near_row").alias("row"), F.col(text_col).alias("text"))

    first = F.min(F.struct(F.col(id_col).isNull().alias("no"), F.col(id_col).alias("id"), F.col("_near_row").alias("row")))
    sets = written(marked.groupBy("_near_set").agg(first.alias("at")).select("at", F.col("at.row").alias("row")))
    heads = marked.select(F.col("_near_row").alias("row"), F.col("_near_fp").alias("fp"), F.col("_near_n").alias("n"), F.col("_near_prefix").alias("prefix"))
    heads = heads.join(F.broadcast(sets.select("row")) if sets.count() <= BROADCAST_ROWS else sets.select("row"), "row", "left_semi")
    made = [sets]

    by_shingle = Window.partitionBy("h")
    shared = written(
        heads.select("row", "n", F.explode("prefix").alias("h"))
        .withColumn("m", F.min(F.struct("row", "n")).over(by_shingle))
        .withColumn("sharing", F.count("*").over(by_shingle))
        .withColumn("crowded", (F.col("sharing") > CROWD) & (F.max("n").over(by_shingle) <= WIDE))
        .where("sharing > 1")
    )
    crowds, sure = _crowds(shared, made), None
    if crowds is not None:
        sure = _linked_crowds(crowds, texts, least, made)
        # all pairs within a crowd are settled: its crowded shingles make no more candidates
        few = F.broadcast(crowds.select("row")) if crowds.count() <= BROADCAST_ROWS else crowds.select("row")
        done = shared
        shared = written(shared.where("not crowded").unionByName(shared.where("crowded").join(few, "row", "left_anti")))
        drop(done)
    fits = lambda a, b: F.least(a, b) * least[1] >= F.greatest(a, b) * least[0]
    stars = shared.where("row > m.row").where(fits(F.col("n"), F.col("m.n")))
    stars = stars.select(F.col("m.row").alias("u"), F.col("row").alias("v"), F.col("m.n").alias("un"), F.col("n").alias("vn"))
    one = written(heads.groupBy("fp").agg(F.min("row").alias("row")))
    tries = links(one.select("fp")).where("fp <> root").distinct()
    tries = tries.join(one.withColumnRenamed("row", "v"), "fp").join(one.select(F.col("fp").alias("root"), F.col("row").alias("u")), "root").select("u", "v")
    near = _settled(_may_be_similar(stars, least), tries, texts, least, made)
    near = near if sure is None else near.unionByName(sure)
    label = connected(near)
    apart = written(shared.join(label, F.col("row") == F.col("node"), "left").select("h", "row", "n", F.coalesce("label", "row").alias("comp")))
    drop(shared, one)
    a, b = (apart.select("h", *[F.col(c).alias(side + c) for c in ("row", "n", "comp")]) for side in "uv")
    between = a.join(b, "h").where((F.col("urow") < F.col("vrow")) & (F.col("ucomp") != F.col("vcomp")) & fits(F.col("un"), F.col("vn")))
    near = _settled(_may_be_similar(between.withColumnsRenamed({"urow": "u", "vrow": "v"}), least), near, texts, least, made, known=True)
    drop(apart)

    label = connected(near)
    stays = written(sets.join(label, F.col("row") == F.col("node"), "left").groupBy(F.coalesce("label", "row")).agg(F.min("at").alias("at")).select(F.col("at.row").alias("_near_row")))
    drop(*made)
    give_back()
    stays = F.broadcast(stays) if stays.count() <= BROADCAST_ROWS else stays
    return marked.join(stays, "_near_row", "left_semi").select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
