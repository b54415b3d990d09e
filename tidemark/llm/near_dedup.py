"""MinHash near-dedup with sequential Bayesian verification.

Signatures are banded into candidate pairs; a pair's signatures are compared batch by batch and
it is dropped as soon as the posterior probability that it is similar enough falls below the
chosen miss probability; what survives is verified on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import dealt, each_part, join_back, likely_in, map_texts, part_of, part_of_row, parts_met, small_batches, stage

WORDS = 5
SIMILAR = (75, 100)
#: 32 bands of 4: a pair at the threshold shares no band with probability 5e-6.
HASHES, ROWS = 128, 4
BATCH, MISS = 32, 1e-6
#: Rounds in which a bucket's members are compared with one of them; rows and bytes of a block of
#: the rounds that compare what is left.
STARS, BLOCK_ROWS, BLOCK_BYTES = 2, 2048, 16 << 20
#: Pairs of signatures compared at once.
PAIRS = 1 << 14

_rng = np.random.default_rng(20240101)
_MULT = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_PLACE = (_rng.integers(0, 2**63, WORDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; empty without words.

    A-Z are lower-cased; words are runs without ASCII white space, which is how bytes.split cuts.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    if n < 1:
        x = np.array([(h * _PLACE[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)
    else:
        x = h[:n] * _PLACE[0]
        for j in range(1, WORDS):
            x += h[j : j + n] * _PLACE[j]
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return np.unique(x)


def signature(x: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES hash functions over a set's elements."""
    low = x.astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 2048):
        v = np.multiply.outer(_MULT, low[i : i + 2048])
        v += _ADD[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def least_matches(share: float, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matching hashes with which a pair goes on.

    With m of n hashes equal and a uniform prior, similarity is Beta(m + 1, n - m + 1); a pair
    goes on while P(similarity >= share) is miss or more. The tail is the binomial sum
    P(X <= m) for n + 1 trials of probability `share`.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * share**m * (1 - share) ** (n + 1 - m)
        out.append(m)
    return out


def _set_key(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _sign(texts: list) -> dict[str, list]:
    n, key, sig = [], [], []
    for text in texts:
        x = shingles(text)
        n.append(len(x))
        key.append(_set_key(x) if len(x) else None)
        sig.append(signature(x).tobytes() if len(x) else None)
    return {"n": n, "set_key": key, "sig": sig}


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = [shingles(t) for t in b["text"]]
        yield pd.DataFrame({"node": [_set_key(x) for x in sets], "items": [x.tobytes() for x in sets]})


def _plausible(limits: list[int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.frombuffer(b"".join(b["sig_a"]), np.uint32).reshape(len(b), HASHES)
            y = np.frombuffer(b"".join(b["sig_b"]), np.uint32).reshape(len(b), HASHES)
            left, matches = np.arange(len(b)), np.zeros(len(b), np.int64)
            for i, least in enumerate(limits):
                part = slice(i * BATCH, (i + 1) * BATCH)
                matches[left] += (x[left, part] == y[left, part]).sum(axis=1)
                left = left[matches[left] >= least]
            yield b.iloc[left][["a", "b"]]

    return run


def _linked(similar: tuple[int, int]):
    most, least = similar[1], similar[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for p, q in zip(b["items_a"], b["items_b"], strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(most * shared >= least * (len(x) + len(y) - shared))
            yield b.loc[ok, ["a", "b"]]

    return run


def _likely(b: pd.DataFrame, similar: tuple[int, int], limits: list[int], comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) of the pairs of blocks in b, which lie one after the other: i in the first block and j in the
    second, whose signatures make a link plausible and that are not in one component, most alike first for each i.

    About PAIRS pairs are compared at once, of as many blocks as that takes; comp may change from one such turn to the next. A pair
    of members that can both come first is left to one of its two orders, and every pair to the first band that it shares.
    """
    sig = np.frombuffer(b"".join(b["sig"]), np.uint32).reshape(len(b), HASHES)
    n, left, right, one, two = (b[c].to_numpy() for c in ("n", "left", "right", "one", "two"))
    rank = pd.factorize(b["node"], sort=True)[0]
    starts = _starts(b)
    group = np.zeros(len(b), np.int64)
    group[starts[1:]] = 1
    group = group.cumsum()
    # The band of a bucket: the first in which all its rows agree.
    same = (sig == sig[starts[group]]).reshape(len(b), -1, ROWS).all(2)
    first = np.logical_and.reduceat(same, starts).argmax(1)
    rows, seconds = np.flatnonzero(left == one), np.flatnonzero(right == two)
    lo, hi = (np.searchsorted(group[seconds], group[rows], side) for side in ("left", "right"))
    ends = np.cumsum(hi - lo)
    at = 0
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        count = hi[at:upto] - lo[at:upto]
        i = np.repeat(rows[at:upto], count)
        j = seconds[np.arange(len(i)) + np.repeat(lo[at:upto] - (np.cumsum(count) - count), count)]
        keep = (comp[i] != comp[j]) & ((left[j] < 0) | (rank[j] > rank[i]))
        keep &= (n[j] * similar[1] >= n[i] * similar[0]) & (n[i] * similar[1] >= n[j] * similar[0])
        i, j = i[keep], j[keep]
        matches = np.zeros(len(i), np.int64)
        for k, least in enumerate(limits):
            cols = slice(k * BATCH, (k + 1) * BATCH)
            matches += (sig[i, cols] == sig[j, cols]).sum(1)
            keep = matches >= least
            i, j, matches = i[keep], j[keep], matches[keep]
        keep = (sig[i] == sig[j]).reshape(len(i), HASHES // ROWS, ROWS).all(2).argmax(1) >= first[group[i]]
        i, j, matches = i[keep], j[keep], matches[keep]
        order = np.lexsort((-matches, i))
        yield i[order], j[order]
        at = upto


def _partners(b: pd.DataFrame, similar: tuple[int, int], limits: list[int], comp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The pairs of _likely by their first row: each row that has any, and its others."""
    for i, j in _likely(b, similar, limits, comp):
        new = np.flatnonzero(i[1:] != i[:-1]) + 1
        if len(i):
            yield from zip(i[[0, *new]].tolist(), np.split(j, new), strict=True)


def _starts(b: pd.DataFrame) -> np.ndarray:
    """The first row of each pair of blocks."""
    new = np.ones(len(b), bool)
    new[1:] = False
    for c in ("bucket", "one", "two"):
        x = b[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _by_blocks(work: Callable[[pd.DataFrame], pd.DataFrame]):
    """work on whole pairs of blocks, as many at once as have BLOCK_ROWS rows or BLOCK_BYTES in their sets; most have a few rows.

    The rows of a pair of blocks come one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, size = [], 0, 0
        for b in batches:
            held.append(b)
            rows, size = rows + len(b), size + (int(b["items"].map(len).sum()) if "items" in b else 0)
            if not rows or (rows < BLOCK_ROWS and size < BLOCK_BYTES):
                continue
            whole = pd.concat(held, ignore_index=True)
            last = int(_starts(whole)[-1])
            if last:
                yield work(whole.iloc[:last])
            held, rows, size = [whole.iloc[last:]], 0, 0
        whole = pd.concat(held, ignore_index=True) if held else ()
        if len(whole):
            yield work(whole)

    return run


def _doubtful(similar: tuple[int, int], limits: list[int]):
    """The members of pairs of blocks to which signatures leave a plausible link; each comes once."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        comp, found = pd.factorize(b["component"])[0], np.zeros(len(b), bool)
        for i, j in _likely(b, similar, limits, comp):
            found[i] = found[j] = True
        return b.loc[found, ["bucket", "node", "n", "component"]]

    return run


def _across(similar: tuple[int, int], limits: list[int]):
    """Links between components within pairs of a bucket's blocks. A link found merges two
    components here, so theirs are not compared again."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        items, comp = [np.frombuffer(x, np.uint64) for x in b["items"]], pd.factorize(b["component"])[0]
        node, out = b["node"].tolist(), []
        for i, others in _partners(b, similar, limits, comp):
            for j in others.tolist():
                if comp[j] == comp[i]:
                    continue
                both = np.sort(np.concatenate((items[i], items[j])))
                shared = int((both[1:] == both[:-1]).sum())
                if similar[1] * shared >= similar[0] * (len(items[i]) + len(items[j]) - shared):
                    out.append((node[i], node[j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR, miss: float = MISS
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Texts link when 100 * |intersection| >= 75 * |union| of their sets of distinct five-word
    shingles (the whole sequence for fewer words). A shingle stands in the sets as a 64-bit hash, here and where
    links are confirmed. component_id is the smallest id reachable over
    links; the document of that id is kept. A null text, or one without words, has no shingles and
    links with nothing: it is its own component. A null id never names a component: such a row
    has the component of its text, or null if there is none, and is kept only then. Repeated rows
    share their result. Other columns of docs are not read.

    Rows of equal shingle sets are one class and only its smallest id goes on. Within a bucket of
    equal bands, members are first compared with one of them each round, not with each other.
    Then members that still lie in different components are compared block by block within tasks: those
    outside the bucket's largest component with all others, first by signature, and on their sets where that
    leaves a link plausible. So no link between different texts is lost; only members and links leave a task, never all pairs. Rows of one bucket,
    component or class meet what their key has in common in parts, so none of them is one task's.
    """
    share = similar[0] / similar[1]
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = map_texts(docs.withColumn("part", part_of_row()), "text", lambda: _sign, {"n": "bigint", "set_key": "binary", "sig": "binary"})
    signed = stage(signed, "signed")
    classes = stage(
        signed.where("n > 0").groupBy("set_key")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), parts_met("part").alias("met"))
        .where("rep is not null"),
        "classes",
    )
    width = ROWS * 4
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)),
        lambda i: F.xxhash64(i, F.substring("sig", i * width + 1, F.lit(width))),
    )
    # Most bands are met once, so a class goes by half of its key until they are left out. Two classes of one half would
    # both be members of either's buckets, which adds comparisons and loses none.
    half = F.xxhash64("set_key")
    banded = classes.select(half.alias("half"), F.explode(bands).alias("bucket"))
    shared = join_back(banded, ["bucket"], part_of("half"), F.count("*").alias("m"), where="m > 1").drop("m")
    members = stage(shared.join(classes.select(half.alias("half"), F.col("set_key").alias("node"), "n"), "half").drop("half"), "buckets", narrow=True)
    own = part_of("node")
    nodes = members.select(F.col("node").alias("set_key")).distinct()
    candidates = stage(classes.join(nodes, "set_key", "left_semi"), "candidates")
    reps = candidates.select(F.col("rep").alias("id")).distinct()
    sets = stage(
        likely_in(docs, "id", reps).join(reps, "id")
        .dropDuplicates(["id", "text"]).select("text").mapInPandas(_sets, "node binary, items binary"),
        "sets",
    )
    limits = least_matches(share, miss)

    def both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        """pairs with the values of a and b. A node is b in one pair a bucket at most, but a in any number."""
        a, b = (table.select(F.col("node").alias(x), F.col(value).alias(f"{value}_{x}")) for x in "ab")
        return pairs.join(b, "b").join(dealt(a, pairs, "a"), ["a", "part"]).select("a", "b", f"{value}_a", f"{value}_b")

    def verify(pairs: DataFrame) -> DataFrame:
        sigs = candidates.select(F.col("set_key").alias("node"), "sig")
        pairs = stage(pairs.withColumn("part", part_of("b")), "pairs", narrow=True)
        likely = both(pairs, sigs, "sig").mapInPandas(_plausible(limits), "a binary, b binary")
        likely = stage(likely.withColumn("part", part_of("b")), "survivors")
        nodes = likely.select(F.explode(F.array("a", "b")).alias("node"))
        return both(likely, likely_in(sets, "node", nodes), "items").mapInPandas(_linked(similar), "a binary, b binary")

    def placed(found: DataFrame | None, *totals: Column) -> DataFrame:
        """The members of the buckets that hold several components still, with their component and their bucket's totals."""
        if found is None:
            now = members.withColumn("component", F.col("node"))
        else:
            now = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            now = stage(now, "members", narrow=True)
        ends = F.min("component").alias("lo"), F.max("component").alias("hi")
        return join_back(now, ["bucket"], own, *ends, *totals, where="lo < hi").drop("lo", "hi")

    def stars(found: DataFrame | None, turn: int) -> DataFrame:
        """Each bucket's members (b) against one of them (a), drawn by a hash, unless they are connected."""
        drawn = F.struct(F.xxhash64("bucket", "node", F.lit(turn)).alias("h"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("comp_a"))
        pairs = placed(found, F.min(drawn).alias("c")).select("*", "c.*").where("component <> comp_a")
        pairs = pairs.where((F.col("n_a") * similar[1] >= F.col("n") * similar[0]) & (F.col("n") * similar[1] >= F.col("n_a") * similar[0]))
        pairs = pairs.groupBy(F.least("a", "node").alias("lo"), F.greatest("a", "node").alias("hi")).agg(F.bool_or(F.col("a") < F.col("node")).alias("up"))
        return pairs.select(F.when(F.col("up"), F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("up"), F.col("hi")).otherwise(F.col("lo")).alias("b"))

    links = found = None
    for i in range(STARS):
        new = stage(verify(stars(found, i)), "links")
        links = new if links is None else links.union(new)
        found = stage(components(links), "components", narrow=True)
    sigs = candidates.select(F.col("set_key").alias("node"), "sig")

    def blocks(now: DataFrame, load: Column, *values: DataFrame) -> DataFrame:
        """The rows of each pair of a bucket's blocks, with the values of their nodes: blocks of its members
        outside its largest component (left, else -1) against blocks of all its members (right).

        So the largest component is sent once for each block of the others, not once for each of its own.
        load (long) is what a row adds to a block, which holds about BLOCK_BYTES.
        """
        groups = now.groupBy("bucket", "component").agg(F.sum(load).alias("load"), parts_met("part").alias("met"))
        whole, top = F.sum("load"), F.max(F.struct("load", "component"))
        totals = groups.groupBy("bucket").agg(
            top["component"].alias("largest"),
            F.ceil((whole - top["load"]) / F.lit(BLOCK_BYTES)).cast("int").alias("lefts"),
            F.ceil(whole / F.lit(BLOCK_BYTES)).cast("int").alias("rights"),
            F.bit_or("met").alias("met"),
        )
        now = now.join(each_part(totals, "met", "part"), ["bucket", "part"])
        left = F.when(F.col("component") == F.col("largest"), -1).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), F.col("lefts"))).cast("int")
        now = now.withColumn("left", left).withColumn("right", F.pmod(F.xxhash64("node"), F.col("rights")).cast("int"))
        for table in values:
            now = now.join(table, "node")
        each = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("one"), F.col("right").alias("two")))
        own_turns = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda i: F.struct(F.col("left").alias("one"), i.alias("two")))
        turns = F.when(F.col("left") < 0, each).otherwise(F.array_union(each, own_turns))
        return now.withColumn("turn", F.explode(turns)).select("*", "turn.*").drop("turn", "part", "largest", "lefts", "rights")

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")

    row = BLOCK_BYTES // BLOCK_ROWS
    now = stage(placed(found).withColumn("part", own), "open", narrow=True)
    doubtful = together(blocks(now, F.lit(row).cast("bigint"), sigs)).mapInPandas(
        _by_blocks(_doubtful(similar, limits)), "bucket bigint, node binary, n bigint, component binary"
    )
    doubtful = stage(doubtful.distinct().withColumn("part", own), "doubtful", narrow=True)
    few = [likely_in(table, "node", doubtful) for table in (sigs, sets)]
    rest = together(blocks(doubtful, F.greatest(F.col("n") * 8, F.lit(row)).cast("bigint"), *few)).mapInPandas(
        _by_blocks(_across(similar, limits)), "a binary, b binary"
    )
    links = links.union(stage(rest, "links"))
    found = stage(components(links), "components", narrow=True)
    smallest = classes.join(found.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        "set_key", "rep", "met", F.coalesce("component", "set_key").alias("component")
    )
    labels = join_back(smallest, ["component"], part_of("set_key"), F.min("rep").alias("component_id"))
    labels = each_part(labels.select("set_key", "component_id", "met"), "met", "part")
    component = F.coalesce("component_id", "id")
    return signed.select("id", "n", "set_key", "part").join(labels, ["set_key", "part"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
