"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

Two sets that link share at least a known number of elements, which their sizes give. A small set has few subsets of that
many elements, so small sets enumerate them all: sharing one is a link. A large set has too many; it scans the inverted lists
of its rarest elements, in an order that puts what is frequent in the whole corpus last, and what it meets there is verified.
The boundary between small and large is where the estimated cost is least.

Links between sets that are already connected add nothing to the components. So each list first tries to link all its sets to
one of them, and only sets that are then still apart are compared with each other: no pair that could link is left out. Sets that
link share two elements of prefixes one longer, so a long list is cut into lists by a second element, exactly.

Before two sets are compared in full their parity sketches are. An element flips one bit of its set's sketch, so sketches differ
in no more bits than the sets do in elements: a pair whose sketches differ in too many bits can't link, and a join on a list
never gives it out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm.common import by_ids, input_bytes, mix, release, saved, slices, starts_of, trim_worker, utf8, word_arrays, workspace
from corvid.llm.components import components

#: Words in a shingle; a link needs 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 4, 85
#: Largest size that may count as small; what scanning one list costs, in subsets.
MOST_SMALL, SCAN_COST = 20, 12
#: Counters of the frequency sketch: shingles for each, and least and most counters (4 bytes each, so at most 64 MB).
SHINGLES_A_COUNTER, LEAST_COUNTERS, MOST_COUNTERS = 128, 1 << 16, 1 << 24
RANGES = 16
#: Sets of several components in a list from which on it is cut by a second element.
LONG_LIST = 2000
#: 64-bit words of a parity sketch.
SKETCH_WORDS = 8
BITS = [f"b{i}" for i in range(SKETCH_WORDS)]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Each text's set as sorted 64-bit hashes: its distinct shingles, or its whole word sequence if that is shorter."""
    hashes, counts = word_arrays(texts, lower=True)
    starts = starts_of(counts)
    n = max(0, len(hashes) - words + 1)
    grams = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            grams = mix(grams ^ hashes[i : i + n], i + 1)
    out = []
    for a, c in zip(starts.tolist(), counts.tolist(), strict=True):
        if c >= words:
            out.append(np.unique(grams[a : a + c - words + 1]))
        elif c:
            x = np.uint64(c)
            with np.errstate(over="ignore"):
                for h in hashes[a : a + c]:
                    x = mix(np.array([x ^ h]), 77)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(s: int, t: int, percent: int = PERCENT) -> int:
    """The least intersection of linked sets of sizes s and t."""
    return -(-percent * (s + t) // (100 + percent))


def partners(n: int, percent: int = PERCENT) -> range:
    """Sizes, from n on, that can link with size n."""
    return range(n, 100 * n // percent + 1)


def parity(elements: np.ndarray) -> np.ndarray:
    """The set's parity sketch, as words."""
    bits = np.bincount((mix(elements, 3) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def may_link(x: str, y: str, percent: int = PERCENT) -> Column:
    """Whether two rows, with sizes n and sketches, can link: sizes first, then the bits in which the sketches differ."""
    sizes = F.col(f"{x}.n") + F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITS), F.lit(0))
    return (100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")) & ((100 + percent) * apart <= (100 - percent) * sizes)


def subset_count(n: int, percent: int = PERCENT) -> int:
    """Subsets that a set of n elements enumerates, as the smaller and as the larger one of a pair."""
    from math import comb

    up = sum(comb(n, needed(n, t, percent)) for t in partners(n, percent) if needed(n, t, percent) <= n)
    down = sum(comb(n, needed(s, n, percent)) for s in range(-(-percent * n // 100), n) if needed(s, n, percent) <= s)
    return up + down


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Elements in order of which a linked set of any size must hold one."""
    return n - -(-percent * n // 100) + 1


def index_length(n: int, percent: int = PERCENT) -> int:
    """Elements in order of which a linked set that isn't smaller must hold one among its own ``prefix_length``."""
    return n - needed(n, n, percent) + 1


def boundary(histogram: dict[int, int], percent: int = PERCENT, most: int = MOST_SMALL, scan: int = SCAN_COST) -> int:
    """The size up to which sets enumerate subsets: the total of subsets below and of lists scanned above is least."""
    sizes = range(1, most + 1)
    small = {n: histogram.get(n, 0) * subset_count(n, percent) for n in sizes}
    large = {n: histogram.get(n, 0) * prefix_length(n, percent) * scan for n in sizes}
    costs = {x: sum(small[n] for n in sizes if n <= x) + sum(large[n] for n in sizes if n > x) for x in range(most + 1)}
    return min(costs, key=lambda x: (costs[x], -x))


def subset_keys(elements: np.ndarray, up_to: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(key, role) of all subsets that sizes up to ``up_to`` ask for; role 1: the set is of the pair's smaller size, 2: of the larger.

    A subset's hash is a sum over its elements, so each comes from the whole sum by taking away what is left out.
    """
    n = len(elements)
    pairs = [(n, t) for t in partners(n, percent) if t <= up_to] + [(s, n) for s in range(-(-percent * n // 100), n)]
    m = mix(elements, 5)
    out = []
    with np.errstate(over="ignore"):
        whole = m.sum(dtype=np.uint64)
        for s, t in pairs:
            size = needed(s, t, percent)
            if size > s:
                continue
            gone = np.zeros(1, np.uint64)
            last = np.full(1, -1)
            for _ in range(n - size):
                gone = np.concatenate([gone[last < i] + m[i] for i in range(n)]) if len(gone) else gone
                last = np.concatenate([np.full((last < i).sum(), i) for i in range(n)])
            keys = mix(whole - gone, 1000 * s + t + 17)
            out += [(int(k), 1 if n == s else 2) for k in keys.view(np.int64)]
    return out


def _sketch_size(shingles: int) -> int:
    return int(min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << max(0, shingles // SHINGLES_A_COUNTER).bit_length())))


def _described(docs: DataFrame, counters: int, words: int) -> DataFrame:
    """A row per document (doc_id, n, print1, print2, its parity sketch), and rows (part, sketch) with the task's counts of shingles."""
    step = counters // RANGES

    def run(batches):
        trim_worker()
        counts = np.zeros(counters, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(utf8(part.column("text")), words)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                np.add.at(counts, (flat % np.uint64(counters)).astype(np.int64), 1)
                prints = [[int(mix(s, k).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for k in (1, 2)]
                bits = np.array([parity(s) for s in sets]).reshape(-1, SKETCH_WORDS)
                n = len(sets)
                yield pa.record_batch([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[0], pa.int64()), pa.array(prints[1], pa.int64()), *(pa.array(bits[:, i], pa.int64()) for i in range(SKETCH_WORDS)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        none = pa.nulls(RANGES, pa.int64())
        packed = [zlib.compress(counts[i * step : (i + 1) * step].astype("<u4").tobytes(), 1) for i in range(RANGES)]
        yield pa.record_batch([none] * (4 + SKETCH_WORDS) + [pa.array(range(RANGES), pa.int32()), pa.array(packed, pa.binary())], names=names)

    names = ["doc_id", "n", "print1", "print2", *BITS, "part", "sketch"]
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{c} bigint" for c in names[:-2]) + ", part int, sketch binary")


def _summed(parts: DataFrame, counters: int) -> np.ndarray:
    """The sketch over all documents: tasks add up ranges of counters, row by row; its size is fixed by ``counters``."""
    step = counters // RANGES

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("sketch").to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], names=["part", "sketch"])

    out = np.zeros(counters, np.int64)
    for row in parts.repartition(RANGES, "part").mapInArrow(run, "part int, sketch binary").toLocalIterator():
        out[row["part"] * step : (row["part"] + 1) * step] += np.frombuffer(bytes(row["sketch"]), "<i8")
    return out


def ranks(sketch: np.ndarray) -> np.ndarray:
    """How frequent each counter is, in powers of two of eight times the mean; 0 for all that is not frequent."""
    usual = 8 * (sketch.mean() + 1)
    return np.clip(np.floor(np.log2(np.maximum(sketch / usual, 0.5))) + 1, 0, 63).astype(np.uint64)


#: Places of a large set's elements in the common order: among its first ``index_length`` (INNER), the one after those, the others
#: of its first ``prefix_length``, and the one after those, which serves as a second element only (and may be both of "after").
INNER, AFTER_INNER, OUTER, AFTER_OUTER, AFTER_BOTH = 0, 5, 3, 4, 6


def _posted(docs: DataFrame, order, small: int, words: int, percent: int) -> DataFrame:
    """(key, doc_id, n, role): subset keys of small sets (role 1 and 2), and for the others their rarest elements.

    Of sets that are equal within a task only the first is posted.
    """
    lowest = -(-percent * (small + 1) // 100)

    def run(batches):
        trim_worker()
        frequency = order.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                keys, ids, sizes, roles = [], [], [], []
                for doc, s in zip(part.column("doc_id").to_pylist(), shingle_sets(utf8(part.column("text")), words), strict=True):
                    n = len(s)
                    if not n:
                        continue
                    mark = (int(mix(s, 1).sum(dtype=np.uint64)), int(mix(s, 2).sum(dtype=np.uint64)))
                    if mark in seen:
                        continue
                    seen.add(mark)
                    if n <= small:
                        got = subset_keys(s, small, percent)
                        if got:
                            keys.append(np.array([k for k, _ in got], np.int64))
                            ids.append(np.full(len(got), doc))
                            sizes.append(np.full(len(got), n))
                            roles.append(np.array([r for _, r in got]))
                    if n >= lowest:
                        p, q = prefix_length(n, percent), index_length(n, percent)
                        rank = frequency[(s % np.uint64(len(frequency))).astype(np.int64)]
                        by = rank << np.uint64(58) | mix(s, 9) >> np.uint64(6)
                        m = min(n, p + 1)
                        keys.append(np.partition(by, sorted({i for i in (q - 1, q, p - 1, p) if i < n}))[:m].view(np.int64))
                        ids.append(np.full(m, doc))
                        sizes.append(np.full(m, n))
                        role = np.full(m, OUTER)
                        role[:q] = INNER
                        role[q : q + 1] = AFTER_INNER
                        role[p:] = AFTER_BOTH if p == q else AFTER_OUTER
                        roles.append(role)
                if keys:
                    yield pa.record_batch([pa.array(np.concatenate(x).astype(t)) for x, t in ((keys, np.int64), (ids, np.int64), (sizes, np.int32), (roles, np.int32))], names=["key", "doc_id", "n", "role"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("doc_id IS NOT NULL").mapInArrow(run, "key bigint, doc_id bigint, n int, role int")


def _cut(long: DataFrame, elements: DataFrame) -> DataFrame:
    """Long lists (key, doc_id, role, component) as lists of pairs of elements: the list's and each other one of the set's."""
    other = elements.select("doc_id", F.col("key").alias("second"), F.col("role").alias("second_role"))
    both = long.join(other, "doc_id").filter(F.col("key") != F.col("second"))
    inner = (F.col("role") == INNER) & F.col("second_role").isin(INNER, AFTER_INNER, AFTER_BOTH)
    key = F.xxhash64(F.least("key", "second"), F.greatest("key", "second"))
    return both.select(key.alias("key"), "doc_id", F.when(inner, INNER).otherwise(OUTER).alias("role"), "component").distinct()


def _picked(docs: DataFrame, pairs: DataFrame, words: int, column: str, form) -> DataFrame:
    """(doc_id, ``column``): ``form`` of the set of every document that occurs in a pair. Other texts aren't moved."""
    ids = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    texts = by_ids(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), ids, "doc_id", "left_semi")

    def run(batches):
        trim_worker()
        for batch in batches:
            for part in slices(batch, "text"):
                found = shingle_sets(utf8(part.column("text")), words)
                yield pa.record_batch([part.column("doc_id"), pa.array([form(s) for s in found], pa.binary())], names=["doc_id", column])

    found = saved(texts.mapInArrow(run, f"doc_id bigint, {column} binary").groupBy("doc_id").agg(F.max(column).alias(column)), column)
    release(ids)
    return found


def fine_sketch(elements: np.ndarray) -> bytes:
    """The set's size and a parity sketch of two bits or more for each element."""
    bits = 1 << max(9, (2 * len(elements) - 1).bit_length())
    odd = np.bincount((mix(elements, 4) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return len(elements).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fine_may_link(x: bytes, y: bytes, percent: int) -> bool:
    """The same test on fine sketches; the longer one is folded, half upon half, to the other's length."""
    s, t = int.from_bytes(x[:8], "little"), int.from_bytes(y[:8], "little")
    p, q = np.frombuffer(x, np.uint64, offset=8), np.frombuffer(y, np.uint64, offset=8)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return (100 + percent) * int(np.bitwise_count(p ^ q).sum()) <= (100 - percent) * (s + t)


def linked(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets, as sorted elements, link."""
    s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    common = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
    return 100 * common >= percent * (len(s) + len(t) - common)


def verified(docs: DataFrame, pairs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) those whose sets link: by their fine sketches first, what is left by the sets themselves."""

    def step(pairs: DataFrame, column: str, form, test, name: str) -> DataFrame:
        forms = _picked(docs, pairs, words, column, form)

        def run(batches):
            trim_worker()
            for batch in batches:
                keep = [test(x, y, percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        half = pairs.join(forms.withColumnsRenamed({"doc_id": "b", column: "y"}), "b")
        both = half.join(forms.withColumnsRenamed({"doc_id": "a", column: "x"}), "a")
        out = saved(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), name, batch_rows=400)
        release(forms)
        return out

    likely = step(pairs, "fine", fine_sketch, fine_may_link, "likely")
    out = step(likely, "elements", np.ndarray.tobytes, linked, "links")
    release(likely)
    return out


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, most_small: int = MOST_SMALL, long_list: int = LONG_LIST) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Null and empty texts have no shingles, link with nothing and are their own component. Texts of any length are one set. Equal
    sets link; so do repeated rows. A doc_id names one text: rows that share one but not the text are one node, linked through
    equal sets of any of them and by the greatest of their other sets. A row without doc_id has a null component. Columns other
    than doc_id and text are ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    counters = _sketch_size(input_bytes(docs, "text") // 6)
    described = saved(_described(docs, counters, words), "described")
    sets = described.filter("part IS NULL").select("doc_id", "n", "print1", "print2")
    order = spark.sparkContext.broadcast(ranks(_summed(described.filter("part IS NOT NULL").select("part", "sketch"), counters)))
    # Equal sets: one of them stands for all.
    first = saved(sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "print1", "print2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"), "equal-sets")
    named = saved(sets.join(first, ["n", "print1", "print2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "named")
    aliases = saved(named.filter("doc_id <> rep").select("doc_id", "rep").distinct(), "aliases")
    sizes = {r["n"]: r["count"] for r in sets.filter(F.col("n").between(1, most_small)).groupBy("n").count().collect()}
    small = boundary(sizes, percent, most_small)

    posted = saved(_posted(docs, order, small, words, percent), "posted")
    order.destroy()
    centres = saved(posted.groupBy("key").agg(F.min(F.when(F.col("role").isin(INNER, 1), F.col("doc_id"))).alias("centre"), F.count(F.lit(1)).alias("length")).filter("length > 1 AND centre IS NOT NULL").drop("length"), "centres")
    lists = saved(posted.join(centres, "key"), "lists")
    release(posted, centres)
    first_only = ~F.col("role").isin(AFTER_OUTER, AFTER_BOTH)
    spokes = saved(lists.filter(first_only & (F.col("doc_id") != F.col("centre"))).select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct(), "spokes")
    # Written, so that a join with a hot centre has nothing but exchanges below it and can be split.
    sketch = F.max(F.struct("n", *BITS)).alias("s")
    sketches = saved(described.filter("part IS NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(sketch).select("doc_id", "s.*"), "sketches")
    x, y = sketches.alias("x"), sketches.alias("y")
    likely = spokes.join(x, F.col("a") == F.col("x.doc_id")).join(y, (F.col("b") == F.col("y.doc_id")) & may_link("x", "y", percent)).select("a", "b")

    def representative(links: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            links = links.join(aliases.withColumnsRenamed({"doc_id": side, "rep": f"{side}_rep"}), side, "left").withColumn(side, F.coalesce(f"{side}_rep", side)).drop(f"{side}_rep")
        return links.select("a", "b")

    likely = saved(likely, "likely-spokes")
    links = saved(representative(verified(docs, likely, words, percent)), "rep-links")
    near = saved(components(links), "components")
    release(links, likely)
    # Lists in which sets of several components meet: compare every two of them that are apart.
    with_rep = lists.filter(~F.col("role").isin(1, 2)).select("key", "doc_id", "role").join(aliases, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    placed = saved(with_rep.join(near.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.col("rep").alias("doc_id"), "role", F.coalesce("component", "rep").alias("component")).distinct(), "placed")
    release(lists)

    def apart(rows: DataFrame) -> DataFrame:
        """Lists with sets of several components, and how many sets they have."""
        return rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("sets")).filter("lo <> hi").select("key", "sets")

    met = placed.filter(first_only)
    open_lists = saved(apart(met), "apart")
    short = met.join(open_lists.filter(F.col("sets") <= long_list), "key", "left_semi")
    # Two sets of small sizes may link by one element alone at low thresholds; then there is no second one to cut by.
    if percent <= 50:
        cut = met.join(open_lists.filter(F.col("sets") > long_list), "key", "left_semi")
    else:
        cut = saved(_cut(met.join(open_lists.filter(F.col("sets") > long_list), "key", "left_semi"), placed), "cut-lists")
        cut = cut.join(apart(cut), "key", "left_semi")
    several = saved(short.unionByName(cut.select(short.columns)).join(sketches, "doc_id"), "several")
    x, y = several.filter("role = 0").alias("x"), several.alias("y")
    order_ = F.struct("x.n", "x.doc_id") < F.struct("y.n", "y.doc_id")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & order_ & may_link("x", "y", percent)).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()
    tried = saved(representative(spokes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    pairs = saved(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    release(placed, several, spokes, tried)
    more = verified(docs, pairs, words, percent)
    near = saved(components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")
    release(described, first, pairs, more, aliases, sketches)
    out = named.join(near.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows whose doc_id is their component's, with all columns: one document of each group stays."""
    with workspace():
        dropped = saved(joined(docs, words, percent).filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies", keep=True)
    return by_ids(docs, dropped, "doc_id", "left_anti").select(docs.columns)
