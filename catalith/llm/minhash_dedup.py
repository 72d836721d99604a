"""Near duplicates by one-permutation hashing with optimal densification and star-shaped candidate edges.

1.  A document's set is its distinct 3-word shingles, as 64-bit hashes. Documents with equal sets (a 128-bit
    sum of the set) are one class with one representative; only representatives go on.
2.  The hash range is cut into BINS bins; the smallest hash of each bin is the signature. An empty bin borrows from
    a bin found by a hash of (bin, attempt), the same for all documents (Shrivastava 2017). Each
    4 bins make a band: sets with similarity 0.85 miss all 32 bands with probability 6e-11.
3.  In a bucket, every member is paired with one centre, not with each other, so pairs grow as members.
    Pairs are confirmed on the full sets, and links joined to components by distributed star contraction.
4.  Stars alone can lose a link between two members that are both too far from the centre. So members are
    also joined loosely (similarity LOOSE to a centre). Members of a bucket that the centres leave in different
    loose groups are compared with each other by their smallest hashes, in blocks of bounded size; groups whose
    members may be similar become one. Where a loose group is not one component, the members
    outside its largest component meet all members of the group in blocks of bounded size, and
    each gives one link for each component it reaches. Groups that the stars have joined take no part.

Aggregations combine before the shuffle; joins have one row for each key on one side, so Spark splits hot ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import Words, cut, freed, join_groups, mix, signed, slices

BINS, BANDS = 128, 32
#: Similarity to a centre that makes a loose group.
LOOSE_PERCENT = 50
#: Shingles and members of a block in the exact comparison.
BLOCK_SHINGLES, BLOCK_MEMBERS = 1 << 18, 1024
#: Smallest hashes of a set that the members of a bucket compare, by their first 32 bits, and members of a block in that comparison.
SKETCH, SKETCH_MEMBERS = 128, 512
_BITS = BINS.bit_length() - 1
_FIRST = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - _BITS)
#: The bins that an empty bin asks, in order.
_ASK = (mix(np.arange(BINS * 512, dtype=np.uint64) + np.uint64(1)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, 512)
_ROWS = mix(np.arange(BINS // BANDS, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
_BAND = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1234))


def shingle_sets(text: pa.Array, words: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle, without words none."""
    w = Words(text, lower=True)
    grams = w.grams(words)
    for a, b in zip(w.row[:-1], w.row[1:], strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield mix(w.span_hash(np.array([a]), int(b - a)) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def bands_of(s: np.ndarray) -> np.ndarray:
    """The band hashes of a set that isn't empty."""
    at = np.minimum(np.searchsorted(s, _FIRST), len(s) - 1)
    least = s[at]
    full = (least >> np.uint64(64 - _BITS)) == np.arange(BINS, dtype=np.uint64)
    if not full.all():
        empty = np.flatnonzero(~full)
        asked = full[_ASK[empty]]
        lender = _ASK[empty, asked.argmax(1)]
        lender[~asked.any(1)] = np.flatnonzero(full)[0]
        least[empty] = least[lender]
    return mix((least.reshape(BANDS, -1) * _ROWS).sum(1, dtype=np.uint64) ^ _BAND)


def _signatures(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    c1, c2 = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, f1, f2, bands = [], [], [], []
                for s in shingle_sets(part.column("text"), words):
                    n.append(len(s))
                    f1.append(mix(s ^ c1).sum(dtype=np.uint64))
                    f2.append(mix(s ^ c2).sum(dtype=np.uint64))
                    bands.append(signed(bands_of(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n, pa.int64()),
                        pa.array(signed(np.array(f1, np.uint64))),
                        pa.array(signed(np.array(f2, np.uint64))),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "f1", "f2", "bands"],
                )

    return task


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [signed(s) for s in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "set"])

    return task


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both = [len(np.intersect1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)) for x, y in zip(b.column("x_set"), b.column("y_set"), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), b.column("nx"), b.column("ny"), pa.array(both, pa.int64())], names=["x", "y", "nx", "ny", "both"])


def components(edges: DataFrame, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(id, component) for every end of edges(x, y) but the smallest of its component: the smallest id that can be reached.

    Edges of different kinds (columns of edges) are graphs of their own, and the kinds are columns of the result.
    Large-star and small-star in turn (Kiveris et al. 2014) until every id has one edge, to an id without any;
    each round is cut from its lineage. Neighbours are never gathered: a star is a minimum by key and a join
    that Spark splits where an id has many edges.
    """
    e = cut(edges.select(*kinds, F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u > v").distinct())
    of = lambda name, value: F.struct(F.col(name).alias("id"), F.col(value).alias("to"))
    ways = lambda df, *structs: df.select(*kinds, F.explode(F.array(*structs)).alias("_")).select(*kinds, "_.*")  # noqa: E731  # one pass for both
    while True:
        ends = ways(e, of("u", "v"), of("v", "u")).groupBy(*kinds, "id").agg(F.sum(F.expr("int(id > to)")).alias("up"), F.max(F.expr("int(id < to)")).alias("down"))
        if ends.where("up + down > 1 and up > 0").isEmpty():
            return e.select(*kinds, F.col("u").alias("id"), F.col("v").alias("component"))
        least = ways(e, of("u", "v"), of("v", "u")).groupBy(*kinds, "id").agg(F.least(F.min("to"), F.col("id")).alias("m"))
        large = join_groups(e.withColumn("id", F.col("v")), least, [*kinds, "id"]).select(*kinds, "u", F.col("m").alias("v"))
        least = large.groupBy(*kinds, "u").agg(F.min("v").alias("m"))
        e = cut(ways(join_groups(large, least, [*kinds, "u"]), of("v", "m"), of("u", "m")).where("id <> to").select(*kinds, F.col("id").alias("u"), F.col("to").alias("v")).distinct())


def _block_links(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links between the left and right rows of a block that are in different components."""

    def task(rows: pa.Table) -> pa.Table:
        left, rep, of = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("left", "rep", "of"))
        sets = rows.column("set").combine_chunks()
        sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
        n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(n) - n
        shingles, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        right = np.flatnonzero(~left)
        others = np.concatenate([code[begin[j] : begin[j] + n[j]] for j in right]) if len(right) else code[:0]
        starts = np.cumsum(n[right]) - n[right]
        x, y = [], []
        for i in np.flatnonzero(left) if len(right) else ():
            mark = np.zeros(len(shingles), np.int64)
            mark[code[begin[i] : begin[i] + n[i]]] = 1
            both = np.add.reduceat(mark[others], starts)
            hit = right[(100 * both >= percent * (n[i] + n[right] - both)) & (of[right] != of[i])]
            _, first = np.unique(of[hit], return_index=True)
            x += [rep[i]] * len(first)
            y += rep[hit[first]].tolist()
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return task


def _blocks(outside: Column) -> Column:
    """A row for each block (l, r of ls times rs) of a member: as a left row if it is outside the largest part, and as a right row."""
    at = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
    each = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    row = lambda left, right, is_left: F.struct(left.alias("l"), right.alias("r"), F.lit(is_left).alias("left"))
    lefts, rights = F.transform(each("rs"), lambda j: row(at("ls"), j, True)), F.transform(each("ls"), lambda j: row(j, at("rs"), False))
    return F.explode(F.when(outside, F.concat(lefts, rights)).otherwise(rights)).alias("_")


def _links_in_groups(reps: DataFrame, groups: DataFrame, of: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links of step 4: reps(rep, n), groups and of (id, component), sets(doc_id, set)."""
    member = reps.join(groups.select(F.col("id").alias("rep"), F.col("component").alias("g")), "rep", "left").withColumn("g", F.coalesce("g", "rep"))
    member = member.join(of.select(F.col("id").alias("rep"), F.col("component").alias("of")), "rep", "left").withColumn("of", F.coalesce("of", "rep"))
    parts = member.groupBy("g", "of").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    open_ = parts.groupBy("g").agg(
        F.max(F.struct("size", "of", "total")).alias("top"), F.sum("size").alias("size"), F.sum("total").alias("total"), F.count("*").alias("parts")
    )
    blocks = lambda size, total: F.ceil(F.greatest(size / BLOCK_MEMBERS, total / BLOCK_SHINGLES)).cast("int")
    size, total = F.col("size"), F.col("total")
    open_ = open_.where("parts > 1").select(
        "g", F.col("top.of").alias("largest"), blocks(size - F.col("top.size"), total - F.col("top.total")).alias("ls"), blocks(size, total).alias("rs")
    )
    member = cut(join_groups(member, open_, ["g"]))
    dealt = member.select("g", "rep", "of", _blocks(F.col("of") != F.col("largest"))).select("g", "rep", "of", "_.*")
    rows = dealt.join(sets.select(F.col("doc_id").alias("rep"), "set"), "rep")
    return rows.groupBy("g", "l", "r").applyInArrow(_block_links(percent), "x long, y long")


def sketch_percent(percent: int) -> int:
    """The largest share of the SKETCH smallest hashes that sets of similarity percent miss no oftener than all bands (Chernoff)."""
    p = min(percent / 100, 0.9999)
    miss = (1 - p ** (BINS // BANDS)) ** BANDS
    far = lambda t: t * math.log(t / p) + (1 - t) * math.log((1 - t) / (1 - p))
    return next((t for t in range(percent - 1, 0, -1) if math.exp(-SKETCH * far(t / 100)) <= miss), 0)


def _block_groups(least: int) -> Callable[[pa.Table], pa.Table]:
    """Pairs that join the loose groups of a block whose left and right rows share least percent of their smallest hashes: a forest."""

    def task(rows: pa.Table) -> pa.Table:
        left, rep, g = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("left", "rep", "g"))
        sets = rows.column("sketch").combine_chunks()
        sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
        n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(n) - n
        values, code = np.unique(sets.flatten().to_numpy().view(np.uint32), return_inverse=True)
        last = np.where(n < SKETCH, len(values), code[begin + n - 1])  # a smaller sketch is the whole set
        right = np.flatnonzero(~left)
        others = np.concatenate([code[begin[j] : begin[j] + n[j]] for j in right]) if len(right) else code[:0]
        starts = np.cumsum(n[right]) - n[right]
        group, of = np.unique(g, return_inverse=True)
        top = np.arange(len(group))  # the joined group of each group
        x, y = [], []
        for i in np.flatnonzero(left) if len(right) else ():
            own = code[begin[i] : begin[i] + n[i]]
            mark = np.zeros(len(values), np.int64)
            mark[own] = 1
            both = np.add.reduceat(mark[others], starts)
            either = np.searchsorted(own, last[right], side="right") + np.add.reduceat((others <= last[i]).astype(np.int64), starts) - both
            hit = right[(100 * both >= least * either) & (top[of[right]] != top[of[i]])]
            _, first = np.unique(top[of[hit]], return_index=True)
            for j in hit[first]:
                top[top == top[of[j]]] = top[of[i]]
                x.append(rep[i])
                y.append(rep[j])
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return task


def _pairs_in_buckets(live: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The loose pairs (x, y) of members that share a bucket live(rep, b, c) but no loose group of groups(id, component)."""
    member = live.where("rep <> c.rep").select("rep", "b").join(groups.select(F.col("id").alias("rep"), F.col("component").alias("g")), "rep", "left")
    member = member.withColumn("g", F.coalesce("g", "rep"))  # a centre has met its members
    parts = member.groupBy("b", "g").agg(F.count("*").alias("size"))
    open_ = parts.groupBy("b").agg(F.max(F.struct("size", "g")).alias("top"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda size: F.ceil(size / SKETCH_MEMBERS).cast("int")
    open_ = open_.select("b", F.col("top.g").alias("largest"), blocks(F.col("size") - F.col("top.size")).alias("ls"), blocks(F.col("size")).alias("rs"))
    member = cut(join_groups(member, open_, ["b"]))
    dealt = member.select("b", "rep", "g", _blocks(F.col("g") != F.col("largest"))).select("b", "rep", "g", "_.*")
    sketch = F.transform(F.slice("set", 1, SKETCH), lambda x: F.shiftright(x, 32).cast("int"))
    rows = dealt.join(sets.select(F.col("doc_id").alias("rep"), sketch.alias("sketch")), "rep")
    return rows.groupBy("b", "l", "r").applyInArrow(_block_groups(sketch_percent(percent)), "x long, y long")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document.

    Documents link where 100 * intersection >= percent * union of their sets of `words`-word shingles (A-Z
    lower-cased). component_id: the smallest doc_id that links reach, its own included; kept: it is its own.
    Null, empty or blank text: 0 shingles, linked with nothing. Null doc_id: linked with nothing, component_id
    null, kept. Repeated rows: each is returned, with the component of its doc_id; a doc_id with several texts
    links where one of them does. A text of any length is one set. Other columns, whatever their names, are not read. An
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = cut(docs.mapInArrow(freed(_signatures(words)), "doc_id long, n long, f1 long, f2 long, bands array<long>"))
    real = every.where("doc_id is not null and n > 0")
    classes = real.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "bands")).alias("first"))
    banded = classes.select(F.col("first.doc_id").alias("rep"), "n", F.explode("first.bands").alias("b"))
    centres = banded.groupBy("b").agg(F.min(F.struct("rep", "n")).alias("c"), F.max("rep").alias("last")).where("last > c.rep").select("b", "c")
    live = cut(join_groups(banded, centres, ["b"]))
    loosely = F.expr(f"100 * least(nx, ny) >= {LOOSE_PERCENT} * greatest(nx, ny)")
    ids = live.select(F.col("rep").alias("_id")).distinct()
    sets = cut(docs.join(ids, docs["doc_id"] == ids["_id"], "left_semi").mapInArrow(freed(_sets(words)), "doc_id long, set array<long>"))
    star = live.where("rep <> c.rep").select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("c.rep").alias("y"), F.col("c.n").alias("ny"))
    full = star.where(loosely).distinct().join(sets.select(F.col("doc_id").alias("x"), F.col("set").alias("x_set")), "x")
    full = full.join(sets.select(F.col("doc_id").alias("y"), F.col("set").alias("y_set")), "y").select("x", "y", "nx", "ny", "x_set", "y_set")
    pairs = cut(full.mapInArrow(freed(_overlaps), "x long, y long, nx long, ny long, both long").where(f"100 * both >= {LOOSE_PERCENT} * (nx + ny - both)"))
    groups = components(pairs)
    met = _pairs_in_buckets(live, groups, sets, percent).distinct()
    loose, strict = F.lit(False).alias("strict"), F.lit(True).alias("strict")
    links = pairs.where(f"100 * both >= {percent} * (nx + ny - both)").select("x", "y", strict)
    graphs = components(groups.select(F.col("id").alias("x"), F.col("component").alias("y"), loose).unionByName(met.select("x", "y", loose)).unionByName(links), ("strict",))
    groups, of = (graphs.where(F.col("strict") == k).select("id", "component") for k in (False, True))
    more = _links_in_groups(live.select("rep", "n").distinct(), groups, of, sets, percent)
    of = components(of.select(F.col("id").alias("x"), F.col("component").alias("y")).unionByName(more))
    named = classes.select(F.col("first.doc_id").alias("rep"), "f1", "f2", "n").join(of.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    joined = join_groups(every.drop("bands"), named, ["f1", "f2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
