"""N-gram Jaccard join by vertical partitioning.

A document is its set of word n-grams; documents link when 100 * overlap >= percent *
union.  Documents with equal sets are one class, and only classes are joined.

Order: n-grams that many classes hold come last, otherwise by hash; the number of classes
is counted over each set's lowest hashes, which is where prefixes lie, and only decides the
order, never the result.  The set of frequent n-grams sent to tasks has at most ``HOT``
members by construction (its limit is rows / HOT, 64 at least).

Fragment one, the prefix: two linking sets share one of their first n - ceil(t n) + 1
n-grams.  Shared prefix n-grams are counted per pair; the overlap is at most that count
plus what the set whose prefix ends first has beyond it, and pairs that cannot reach the
overlap needed go.  The rest of the order is cut into ``FRAGMENTS`` hash ranges: each
range's partial overlap is counted on its own and the counts are summed per pair.

N-grams with over ``SMALL`` classes would give all pairs of a large group of near copies.
Their classes form families instead, under the class that occurs in most of them; a family
is dealt into tiles, and a pair of tiles sums the fragments' partial overlaps as matrices.
Every pair is compared; a tile returns each class's number of links and a tie to the least
class it hangs together with, not the links themselves, whose number is a group's square.

Links are counted between documents, so a class counts as often as it has copies, and its
own copies link with each other.  A pair of classes counts once: in the least of the
families both belong to, or as a candidate pair if they share none.

Defined cases: a null, empty or wordless text has an empty set and links with nothing;
fewer words than n make one n-gram of all of them; very long texts are used whole; a null
doc_id may link, but the class id is the smallest id that is not null; repeated rows are
one class, and one document where doc_id and text repeat; no rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, shingles
from .components import components
from .token_store import _arrow, text_steps

HOT, HOT_LEAST, SMALL, FRAGMENTS = 1 << 20, 32, 32, 8
TILE_LEAST, TILE_MOST, TILES = 128, 2048, 32
#: N-grams of a tile on average; with TILE_MOST it bounds what a task holds.
TILE_GRAMS = 1 << 21
#: Bits of the map of rows whose sets are fetched: 2 MB, whatever the input.
CELLS = 1 << 24
#: Bits of the map of shared prefix n-grams: 4 MB; it only saves rows, the counts after it are exact.
KEY_CELLS = 1 << 25


def _prefix(n: np.ndarray | int, percent: int):
    return n - (n * percent + 99) // 100 + 1


def _signed(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Signed keys in the global order: by hash, with the frequent n-grams above the others."""
    low = (hashes >> np.uint64(1)).astype(np.int64)
    return np.where(hot, low, low + np.iinfo(np.int64).min)


def document_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Written: doc_id, place (a hash of the text), n, fp (of the set), low (its lowest hashes, cut to 32 bits)."""
    kind = "doc_id bigint, place bigint, n long, fp long, low array<int>"

    def run(batches):
        for batch in batches:
            for at, (ids, texts) in _steps(batch):
                sets = list(shingles.shingle_sets(texts, width))
                low = [(s[: _prefix(len(s), percent) * 3 // 2] >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets]
                columns = [
                    pa.array(ids, pa.int64()), batch.column("place").slice(at, len(ids)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([shingles.set_id(s) for s in sets], pa.int64()), pa.array(low, pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_arrow(kind))

    rows = docs.select("doc_id", F.xxhash64("text").alias("place"), "text")
    return scratch.save(rows.mapInArrow(run, kind), "ngram-sets", scratch.TEXT_BATCH)


def _steps(batch: pa.RecordBatch):
    at = 0
    for ids, texts in text_steps(iter([batch])):
        yield at, (ids, texts)
        at += len(ids)


def frequent(sets: DataFrame) -> np.ndarray:
    """Sorted 32-bit hashes of n-grams that many classes hold; at most ``HOT``."""
    lows = sets.where("n > 0").groupBy("fp").agg(F.first("low").alias("low")).select(F.explode("low").alias("g"))
    counts = scratch.save(lows.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") >= HOT_LEAST), "ngram-counts")
    most = max(HOT_LEAST, (counts.agg(F.sum("c")).first()[0] or 0) // HOT)
    hot = counts.where(F.col("c") > most).select("g").toPandas()["g"].to_numpy(np.int32)
    scratch.drop(counts)
    return np.sort(hot.view(np.uint32))


def _is_hot(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(hashes), bool)
    cut = (hashes >> np.uint64(32)).astype(np.uint32)
    return hot[np.minimum(np.searchsorted(hot, cut), len(hot) - 1)] == cut


def _bitmap(cells: DataFrame, size: int) -> np.ndarray:
    """Bits of the numbers from 0 in the column ``cell``, on the driver: ``size`` / 8 bytes."""
    word, bit = F.floor(F.col("cell") / 64).alias("word"), F.bit_or(F.expr("shiftleft(1L, CAST(cell % 64 AS INT))")).alias("bits")
    found = cells.groupBy(word).agg(bit).toPandas()
    bits = np.zeros(size // 64, np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits


def _has(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells // 64] >> (cells % 64)) & 1 == 1


def _prefix_rows(docs: DataFrame, width: int, percent: int, hot: np.ndarray, shared: np.ndarray | None) -> DataFrame:
    """key, fp, n, last for every prefix n-gram, or for those that the map ``shared`` has."""
    kind = "key long, fp long, n long, last long"

    def run(batches):
        for _, texts in text_steps(batches):
            out = [[], [], [], []]
            for s in shingles.shingle_sets(texts, width):
                if len(s):
                    keys = np.sort(_signed(s, _is_hot(s, hot)))[: _prefix(len(s), percent)]
                    last = keys[-1]
                    if shared is not None:
                        keys = keys[_has(shared, keys % KEY_CELLS)]
                    for column, value in zip(out, (keys, shingles.set_id(s), len(s), last), strict=True):
                        column.append(np.broadcast_to(np.int64(value) if np.ndim(value) == 0 else value, len(keys)))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=_arrow(kind))

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def prefixes(docs: DataFrame, width: int, percent: int, hot: np.ndarray) -> DataFrame:
    """Written: key, fp, n, last, size for prefix n-grams that two classes or more share.

    A first pass finds the shared n-grams by their least and greatest class; a map of fixed
    size of them tells the second pass which rows may be needed, and sizes are counted on
    those.  Both passes merge before the shuffle, so copies and very common n-grams don't
    travel, and no task gets an n-gram's rows as a whole.
    """
    every = _prefix_rows(docs, width, percent, hot, None).groupBy("key")
    shared = scratch.save(every.agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("key"), "ngram-shared", scratch.TEXT_BATCH)
    bits = _bitmap(shared.select(F.pmod("key", F.lit(KEY_CELLS)).alias("cell")), KEY_CELLS)
    rows = _prefix_rows(docs, width, percent, hot, bits).groupBy("key", "fp")
    rows = scratch.save(rows.agg(F.first("n").alias("n"), F.first("last").alias("last")), "ngram-rows", scratch.TEXT_BATCH)
    sizes = scratch.save(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "ngram-sizes")
    out = scratch.save(rows.join(sizes, "key"), "ngram-prefixes")
    scratch.drop(shared, rows, sizes)
    return out


def candidate_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """x, y, nx, ny, c (shared) of pairs that their prefix overlap still allows (n-grams of few classes)."""
    few = rows.where(F.col("size") <= SMALL).drop("size")
    x = few.select("key", F.col("fp").alias("x"), F.col("n").alias("nx"), F.col("last").alias("lx"))
    y = few.select("key", F.col("fp").alias("y"), F.col("n").alias("ny"), F.col("last").alias("ly"))
    pairs = x.join(y, "key").where(f"(nx < ny OR nx = ny AND x < y) AND 100 * nx >= {percent} * ny")
    pairs = pairs.groupBy("x", "y", "nx", "ny", "lx", "ly").agg(F.count("*").alias("c"))
    beyond = f"(CASE WHEN lx <= ly THEN nx ELSE ny END * {percent} + 99) div 100 - 1"
    return pairs.where(f"{100 + percent} * (c + {beyond}) >= {percent} * (nx + ny)").select("x", "y", "nx", "ny", "c")


def class_copies(sets: DataFrame) -> DataFrame:
    """Written: fp, copies (the documents of the class)."""
    documents = sets.where("n > 0").select("fp", "doc_id", "place").distinct()
    return scratch.save(documents.groupBy("fp").agg(F.count("*").alias("copies")), "ngram-copies")


def families(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Written: family, fp, n, tile, tiles, copies, all (the class's families) of the classes
    that share a frequent prefix n-gram."""
    many = rows.where(F.col("size") > SMALL).select("key", "fp", "n")
    degree = scratch.save(many.groupBy("fp").agg(F.count("*").alias("d")), "ngram-degrees")
    hub = scratch.save(many.join(degree, "fp").groupBy("key").agg(F.max(F.struct("d", "fp")).alias("hub")), "ngram-hubs")
    members = many.join(hub, "key").select(F.col("hub.fp").alias("family"), "fp", "n").distinct()
    members = scratch.save(members, "ngram-members")
    sizes = members.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("grams"))
    per = F.least(F.greatest(F.ceil(F.col("size") / TILES), F.lit(TILE_LEAST)), F.lit(TILE_MOST))
    tiles = F.greatest(F.ceil(F.col("size") / per), F.ceil(F.col("grams") / TILE_GRAMS)).cast("int")
    sizes = scratch.save(sizes.select("family", tiles.alias("tiles")), "ngram-tiles")
    dealt = members.join(sizes, "family").withColumn("tile", F.expr("CAST(pmod(xxhash64(fp), tiles) AS INT)"))
    every = scratch.save(members.groupBy("fp").agg(F.collect_set("family").alias("all")).join(copies, "fp"), "ngram-all")
    return scratch.save(dealt.join(every, "fp"), "ngram-families")


def outside_families(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Written: the ``pairs`` that no family's tiles compare."""
    every = scratch.save(members.select("fp", "all").distinct(), "ngram-all")
    for end in ("x", "y"):
        pairs = pairs.join(every.select(F.col("fp").alias(end), F.col("all").alias(f"all_{end}")), end, "left")
    apart = pairs.where(~F.coalesce(F.arrays_overlap("all_x", "all_y"), F.lit(False)))
    return scratch.save(apart.select("x", "y", "nx", "ny", "c"), "ngram-apart")


def wanted_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Written: fp, parts (sorted hashes of each fragment) for the classes in ``wanted``; a
    class appears twice where rows repeat its doc_id and text."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first")
    places = sets.where("n > 0").groupBy("fp").agg(first)
    places = scratch.save(wanted.join(places, "fp").select("fp", "first.doc_id", "first.place"), "ngram-wanted")

    # a bitmap of fixed size tells tasks which rows may be wanted; the join below is exact
    cell = F.pmod(F.xxhash64("doc_id", "place"), F.lit(CELLS)).alias("cell")
    bitmap = _bitmap(places.select(cell), CELLS)
    kind = "doc_id long, place long, fp long, parts array<binary>"

    def run(batches):
        cuts = (np.arange(1, FRAGMENTS).astype(np.uint64)) * np.uint64((1 << 64) // FRAGMENTS)
        for batch in batches:
            cells = np.asarray(batch.column("cell"))
            hits = batch.filter(pa.array(_has(bitmap, cells)))
            for at, (ids, texts) in _steps(hits):
                sets = list(shingles.shingle_sets(texts, width))
                parts = [[p.tobytes() for p in np.split(s, np.searchsorted(s, cuts))] for s in sets]
                columns = [
                    pa.array(ids, pa.int64()), hits.column("place").slice(at, len(ids)),
                    pa.array([shingles.set_id(s) for s in sets], pa.int64()), pa.array(parts, pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_arrow(kind))

    rows = docs.select("doc_id", F.xxhash64("text").alias("place"), "text").select("*", cell)
    sets = rows.mapInArrow(run, kind)
    same = sets["doc_id"].eqNullSafe(places["doc_id"]) & (sets["place"] == places["place"]) & (sets["fp"] == places["fp"])
    return scratch.save(sets.join(places, same, "left_semi").select("fp", "parts"), "ngram-fragments", scratch.TEXT_BATCH)


def pair_links(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """x, y of the pairs whose fragments' overlaps sum to a link."""
    kind = "x long, y long, nx long, ny long, fragment int, overlap long"

    def count(batches):
        for b in batches:
            overlaps = [
                len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
                for p, q in zip(b.column("p").to_pylist(), b.column("q").to_pylist(), strict=True)
            ]
            columns = [b.column(c) for c in ("x", "y", "nx", "ny", "fragment")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(overlaps, pa.int64())], schema=_arrow(kind))

    x = parts.select(F.col("fp").alias("x"), F.posexplode("parts").alias("fragment", "p"))
    y = parts.select(F.col("fp").alias("y"), F.posexplode("parts").alias("fragment", "q"))
    partial = pairs.join(x, "x").join(y, ["y", "fragment"]).select("x", "y", "nx", "ny", "fragment", "p", "q")
    partial = partial.mapInArrow(count, kind)
    # a class read twice (rows that repeat a doc_id) gives equal counts: max keeps one
    each = partial.groupBy("x", "y", "nx", "ny", "fragment").agg(F.max("overlap").alias("overlap"))
    sums = each.groupBy("x", "y", "nx", "ny").agg(F.sum("overlap").alias("i"))
    return sums.where(f"100 * i >= {percent} * (nx + ny - i)").select("x", "y")


def best_then_rest(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Written links: each class's most promising pair is verified first; of the other pairs
    only those whose ends are not connected by then can matter and are verified."""
    best = pairs.groupBy("y").agg(F.max(F.struct("c", "x")).alias("best")).select("y", F.col("best.x").alias("x"))
    first = scratch.save(pairs.join(best, ["x", "y"], "left_semi"), "ngram-first")
    links = scratch.save(pair_links(first, parts, percent), "ngram-links")
    roots = scratch.save(components(links), "ngram-first-roots")
    near = pairs.join(first, ["x", "y"], "left_anti")
    for end in ("x", "y"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
        near = scratch.save(near.join(named, end, "left"), "ngram-rest")
    near = near.where("coalesce(rx, x) <> coalesce(ry, y)").select("x", "y", "nx", "ny")
    return scratch.save(links.unionByName(pair_links(near, parts, percent)), "ngram-links")


def family_links(members: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """x, y, n for each class with links inside a pair of tiles: y is the least class it hangs
    together with there, n its links with documents that no lesser family compares."""
    kind = "x long, y long, n long"

    def compare(table: pa.Table) -> pa.Table:
        fps, at = np.unique(np.asarray(table.column("fp")), return_index=True)
        n = np.asarray(table.column("n"))[at]
        side = np.asarray(table.column("tile"))[at]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rows, cols = np.flatnonzero(side == i), np.flatnonzero(side == j)
        total = np.zeros((len(rows), len(cols)), np.float32)
        parts = table.column("parts").take(pa.array(at)).to_pylist()
        for f in range(FRAGMENTS):
            segments = [np.frombuffer(p[f], np.uint64) for p in parts]
            owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
            grams, inverse, counts = np.unique(np.concatenate(segments), return_inverse=True, return_counts=True)
            shared = np.flatnonzero(counts > 1)
            slot = np.full(len(grams), -1)
            slot[shared] = np.arange(len(shared))
            for lo in range(0, len(shared), 2048):  # bounded slices of the fragment's n-grams
                mine = (slot[inverse] >= lo) & (slot[inverse] < lo + 2048)
                m = np.zeros((len(fps), min(2048, len(shared) - lo)), np.float32)
                m[owner[mine], slot[inverse][mine] - lo] = 1
                total += m[rows] @ m[cols].T
        union = n[rows][:, None] + n[cols][None, :] - total
        near = (100 * total >= percent * union) & (rows[:, None] != cols[None, :])
        a, b = np.nonzero(near)
        a, b = rows[a], cols[b]

        family, every = table.column("family")[0].as_py(), table.column("all").take(pa.array(at)).to_pylist()
        lesser = {g: k for k, g in enumerate(sorted({g for own in every for g in own if g < family}))}
        belongs = np.zeros((len(fps), len(lesser)), np.float32)
        for k, own in enumerate(every):
            belongs[k, [lesser[g] for g in own if g < family]] = 1
        counted = near & (belongs[rows] @ belongs[cols].T == 0)
        copies, links = np.asarray(table.column("copies"))[at], np.zeros(len(fps), np.int64)
        links[rows] += counted @ copies[cols]
        if i != j:
            links[cols] += copies[rows] @ counted
        best = np.arange(len(fps))
        while True:
            new = best.copy()
            np.minimum.at(new, a, best[b])
            np.minimum.at(new, b, best[a])
            if (new == best).all():
                break
            best = new
        tied = np.union1d(a, b)
        return pa.table({"x": fps[tied], "y": fps[best[tied]], "n": links[tied]}, schema=_arrow(kind))

    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    own = ("family", "fp", "n", "tile", "copies", "all")
    rows = members.select(*own, F.explode(others).alias("other"))
    rows = rows.select(*own, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    return rows.join(parts, "fp").groupBy("family", "i", "j").applyInArrow(compare, kind)


def link_counts(links: DataFrame, tiles: DataFrame, copies: DataFrame) -> DataFrame:
    """Written: fp, n (links with documents of other classes)."""
    ends = links.select(F.col("x").alias("u"), F.col("y").alias("fp")).unionByName(links.select(F.col("y").alias("u"), F.col("x").alias("fp")))
    ends = ends.join(copies, "fp").select(F.col("u").alias("fp"), F.col("copies").alias("n"))
    ends = ends.unionByName(tiles.select(F.col("x").alias("fp"), "n"))
    return scratch.save(ends.groupBy("fp").agg(F.sum("n").alias("n")), "ngram-link-counts")


def similarity_classes(docs: DataFrame, width: int = 5, percent: int = 80, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, place (a hash of the text), root (of the class; null
    for an empty set) for each row of ``docs``, and n_links, the documents it links with.
    Without ``count`` there is no n_links, and pairs already connected are not verified."""
    wide = document_sets(docs, width, percent)
    hot = frequent(wide)
    sets = scratch.save(wide.select("doc_id", "place", "n", "fp"), "ngram-sets")
    scratch.drop(wide)
    copies = class_copies(sets)
    rows = prefixes(docs, width, percent, hot)
    pairs = scratch.save(candidate_pairs(rows, percent), "ngram-pairs")
    members = families(rows, copies)
    scratch.drop(rows)
    pairs = outside_families(pairs, members)
    wanted = pairs.select(F.col("x").alias("fp")).unionByName(pairs.select(F.col("y").alias("fp")))
    wanted = wanted.unionByName(members.select("fp")).distinct()
    parts = wanted_sets(docs, sets, wanted, width)
    del wanted
    if count:
        links = scratch.save(pair_links(pairs.drop("c"), parts, percent), "ngram-links")
    else:
        links = best_then_rest(pairs, parts, percent)
    tiles = scratch.save(family_links(members, parts, percent), "ngram-tile-links")
    scratch.drop(parts)
    roots = components(scratch.save(links.unionByName(tiles.select("x", "y")), "ngram-links"))
    classes = copies.join(scratch.save(roots, "ngram-roots").withColumnRenamed("node", "fp"), "fp", "left")
    if count:
        classes = classes.join(link_counts(links, tiles, copies), "fp", "left")
        classes = classes.withColumn("n_links", F.col("copies") - 1 + F.coalesce("n", F.lit(0)))
    more = ["n_links"] if count else []
    classes = scratch.save(classes.select("fp", F.coalesce("root", "fp").alias("root"), *more), "ngram-classes")

    base = sets.select("doc_id", "place", F.col("n").alias("n_shingles"), "fp")
    some = base.where("n_shingles > 0").join(classes, "fp").drop("fp")
    some = scratch.save(some, "ngram-rows")
    least = scratch.save(some.groupBy("root").agg(F.min("doc_id").alias("component_id")), "ngram-least")
    columns = ("doc_id", "n_shingles", "component_id", "place", "root", *more)
    joined = some.join(least, "root").select(*columns)
    none = base.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "root": F.lit(None).cast("long")})
    none = none.withColumns({c: F.lit(0).cast("long") for c in more}).select(*columns)
    return joined.unionByName(none)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class, the one with its smallest doc_id (then text hash);
    rows without words all stay, rows that repeat doc_id and text stay once."""
    classes = similarity_classes(docs, width, percent, count=False)
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    keep = classes.where("n_shingles > 0").groupBy("root").agg(F.min(at).alias("at")).select("at")
    keep = scratch.save(keep.unionByName(classes.where("n_shingles = 0").select(at.alias("at")).distinct()), "ngram-keep")
    place = F.xxhash64("text").alias("place")
    rows = docs.select(F.struct("*").alias("doc"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", place).alias("at"))
    kept = rows.join(keep, "at", "left_semi").groupBy("at").agg(F.first("doc").alias("doc"))
    return kept.select("doc.*")
