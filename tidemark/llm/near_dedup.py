"""Near-duplicate groups by a chosen-path set similarity join.

A document is the set of its five-word shingles. Documents with equal sets are one
class, numbered by its row in a written table, and only classes go on. They walk down
independent random trees: at each level a node splits by the minwise token of the next random
function, so sets of similarity s stay together with probability s. Nodes of one class end.
Nodes of at most ``SMALL`` classes are leaves. A node that is still larger at the end of
its path is crowded, and is recursed into.

Comparing has two steps. First each class of a node meets the node's pivot, its smallest
class, which links most groups of copies with as many comparisons as members. Then leaves
compare all pairs that are in different components so far. Sketches of 256 bits differ in 19
bits on average at similarity 0.85, with a standard deviation of 4, in 26 at 0.80, with one of
5; pairs that differ in more than ``sketch_bits``, 5 deviations off, are ruled out before
their sets are read. Every link is confirmed on full sets. Components come from
alternating large-star and small-star steps on the links.

A crowded node whose classes are all in one component by then is done. Of the others, those
of at most ``WIDE`` classes are small enough to be compared exhaustively, by sketches in one
group. The classes of larger ones branch: each follows two further paths, by tokens drawn from its full set, into
smaller nodes, which are compared in the same way; and so on for ``rounds`` rounds. Two paths
keep a similar pair together more than once on average, and let the rows of a crowd that
only shares a passage stay about as many as they were. A node that is larger even
then is compared by sketches in blocks of ``WIDE``. A crowd is mostly the same classes in each tree;
of all crowded nodes that two classes share, only the smallest number compares them. The
classes that have a partner by sketches are compared by their sets: those outside the main component
meet all others, in blocks of at most ``WIDE`` classes and ``BLOCK * LONG`` shingles. So
there is no cap on partners, and a class takes one row for each block of its node: a node of up to
``WIDE`` ordinary texts is one or a few blocks, and rows grow with a group's size, unless more
than that are similar to each other by sketches and yet unlinked at each of these steps.

A link takes the similarity of the ``Settings``: 0.85 in op7 (``CONTRACT``), 0.80 in the
pipeline (``STAGE``). With ten trees of depth 3 a pair of similarity 0.85 shares a node with
probability 1 - (1 - 0.85^3)^10 = 0.9999, more similar pairs more surely; if its nodes are
crowded in all trees and rounds, with 0.997. At 0.80 there are twelve trees:
1 - (1 - 0.80^3)^12 = 0.9998, and 0.979 if its nodes are crowded in all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import Scratch

SHINGLE, PERCENT = 5, 85
SMALL, BLOCK, WIDE = 48, 128, 2048
#: A block has as many shingles as BLOCK texts of so many.
LONG = 4096
SALTS = 16
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BATCH = 1 << 22
REMEMBERED = 400_000


class Settings(NamedTuple):
    """The least similarity of a link in percent, and the search that meets such pairs."""

    percent: int
    trees: int
    depth: int
    branches: int
    rounds: int
    sketch_bits: int


CONTRACT = Settings(PERCENT, trees=10, depth=3, branches=2, rounds=3, sketch_bits=40)
STAGE = Settings(80, trees=12, depth=3, branches=2, rounds=3, sketch_bits=50)


class _Words(dict):
    """Hashes of words, A-Z as a-z."""

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = found = xxhash.xxh3_64_intdigest(word.translate(common.ASCII_LOWER))
        return found


def shingles(text: str, words: _Words, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; of fewer words, one for all."""
    found = common.WORD_RE.findall(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(words) > REMEMBERED:
        words.clear()
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(size, len(found))
    out = np.full(len(found) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[k : k + len(out)]
        out = (out ^ (out >> np.uint64(32))) * _MIX2
    return np.unique(out ^ (out >> np.uint64(29)))


def _functions(n: int, draw: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607 + draw)
    return rng.integers(0, 1 << 31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minwise(found: np.ndarray, functions: int, draw: int = 0) -> np.ndarray:
    """Minwise tokens of a set by all functions of a draw."""
    small = (found >> np.uint64(32)).astype(np.uint32)
    a, b = _functions(functions, draw)
    tokens = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(small), 4096):
        np.minimum(tokens, (small[None, start : start + 4096] * a[:, None] + b[:, None]).min(axis=1), out=tokens)
    return tokens.view(np.int32)


def sketch(found: np.ndarray) -> np.ndarray:
    """One bit for each of 256 bins of a set, as four numbers."""
    low = np.sort((found & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    bins, first = np.unique(low >> np.uint32(24), return_index=True)
    bits = np.zeros(256, np.uint8)
    least = low[first] & np.uint32(0xFFFFFF)
    bits[bins] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return np.frombuffer(np.packbits(bits).tobytes(), np.int64)


_SIGNED = "doc_id bigint, text_key bigint, n_shingles bigint, set_id binary, tokens array<int>, sketch array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch], functions: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    words = _Words()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size < _BATCH and i + 1 < len(texts):
                continue
            rows = []
            for text in texts[start : i + 1]:
                found = shingles(text or "", words)
                if len(found):
                    rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), minwise(found, functions), sketch(found)))
                else:
                    rows.append((0, None, None, None))
            n, key, tokens, bits = zip(*rows, strict=True)
            made = [pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(tokens, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))]
            ids = [batch.column(c).slice(start, i + 1 - start) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([*ids, *made], names=["doc_id", "text_key", "n_shingles", "set_id", "tokens", "sketch"])
            start, size = i + 1, 0


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        blobs = [shingles(t or "", words).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(blobs, pa.large_binary())], names=["cls", "set"])


def _drawn(batches: Iterator[pa.RecordBatch], functions: int, draw: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [minwise(np.frombuffer(x, np.uint64), functions, draw) for x in batch.column("set").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(tokens, pa.list_(pa.int32()))], names=["cls", "tokens"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common_size = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common_size >= percent * (len(a) + len(b) - common_size)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [
            similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
        ]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _alike(x: str, y: str, settings: Settings) -> Column:
    """Sizes and sketches that a link needs."""
    differ = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(4)))
    sizes = F.least(f"{x}.n", f"{y}.n") * 100 >= F.greatest(f"{x}.n", f"{y}.n") * settings.percent
    return sizes & (differ <= settings.sketch_bits)


def _with_parts(rows: DataFrame, by_key: DataFrame, key: str, member: str) -> DataFrame:
    """Join a row for each key to its members, which are dealt out over SALTS parts, as one key may hold most."""
    parts = by_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(member), F.lit(SALTS)).cast("int")).join(parts, [key, "_salt"]).drop("_salt")


def _paths(first: int, settings: Settings, n: Column | int, offset: Column | int) -> Column:
    """n paths of tokens: (number, path), cut from the column tokens."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.struct(k.alias("number"), F.slice("tokens", (offset + k) * settings.depth + first, F.lit(settings.depth)).alias("path")),
    )


class _Join:
    """The steps of one run; tables between them are written to the shared folder."""

    def __init__(self, documents: DataFrame, settings: Settings):
        self.settings = settings
        key = F.xxhash64(F.coalesce("text", F.lit("")))
        self.documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("text_key"), "text")
        self.spark = documents.sparkSession
        self.scratch = Scratch(self.spark, "near")

    def descend(self, rows: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
        """Walk down (node, cls, tree, path): leaves (node, cls, pivot), and crowded nodes with tree and size."""
        small = []
        for level in range(self.settings.depth):
            rows = rows.select(F.xxhash64("node", F.col("path")[level]).alias("node"), "cls", "tree", "path")
            sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("cls").alias("pivot")).where("size > 1")
            rows = self.scratch.write(_with_parts(rows, sizes, "node", "cls"), f"{label}-{level}")
            small.append(rows.where(F.col("size") <= SMALL).select("node", "cls", "pivot"))
            rows = rows.where(F.col("size") > SMALL)
        return small, rows.select("node", "cls", "pivot", "tree", "size")

    def candidates(self, small: list[DataFrame], crowded: DataFrame, nodes: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) with pivots, and those within leaves, that sizes and sketches allow."""
        ended = [x.withColumn("leaf", F.lit(True)) for x in small]
        leaves = reduce(DataFrame.unionByName, [*ended, crowded.select("node", "cls", "pivot", F.lit(False).alias("leaf"))]).join(nodes, "cls")
        leaves = self.scratch.write(leaves.select("node", "leaf", "pivot", F.struct("cls", "n", "sketch").alias("m")), f"{label}-leaves")
        members = leaves.where(F.col("m.cls") != F.col("pivot")).select("pivot", "m").distinct()
        pivots = nodes.join(leaves.select(F.col("pivot").alias("cls")).distinct(), "cls", "left_semi")
        pivots = pivots.select(F.col("cls").alias("pivot"), F.struct("cls", "n", "sketch").alias("p"))
        stars = _with_parts(members, pivots, "pivot", "m.cls").where(_alike("m", "p", self.settings))
        stars = self.scratch.write(stars.select(F.col("p.cls").alias("a"), F.col("m.cls").alias("b")), f"{label}-stars")
        groups = leaves.where("leaf").groupBy("node").agg(F.sort_array(F.collect_list("m")).alias("all")).where(F.size("all") > 2)
        pairs = groups.select("all", F.posexplode("all").alias("i", "x")).select("x", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("y"))
        pairs = pairs.where(_alike("x", "y", self.settings)).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
        pairs = self.scratch.write(pairs.join(stars, ["a", "b"], "left_anti"), f"{label}-pairs")
        self.scratch.drop(f"{label}-leaves")
        return stars, pairs

    def apart(self, pairs: DataFrame, found: DataFrame | None) -> DataFrame:
        """The pairs that are in different components so far."""
        if found is None:
            return pairs
        roots = [found.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
        rows = pairs.join(roots[0], "a", "left").join(roots[1], "b", "left")
        return rows.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")

    def link(self, pairs: DataFrame, found: DataFrame | None, sets: DataFrame, label: str) -> DataFrame:
        """Components (id, root) with the links among pairs, each confirmed on the sets."""
        first, second = (sets.select(F.col("cls").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
        rows = self.apart(pairs, found).join(first, "a").join(second, "b")
        return self.extended(rows.mapInArrow(common.lean(partial(_confirm, percent=self.settings.percent)), "a bigint, b bigint"), found, label)

    def extended(self, links: DataFrame, found: DataFrame | None, label: str) -> DataFrame:
        links = self.scratch.write(links, f"{label}-links")
        if found is None:
            return self.components(links, label)
        if links.isEmpty():
            return found
        return self.components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links), label)

    def components(self, links: DataFrame, label: str) -> DataFrame:
        """(id, root) for each id with a link, root being the smallest id that it reaches."""
        star = self.scratch.write(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x > y").distinct(), f"{label}-0")
        step = 0
        while not self._stars_only(star):
            step += 1
            for large in (True, False):
                both = star.unionByName(star.select(F.col("y").alias("x"), F.col("x").alias("y"))) if large else star
                least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
                moved = both.join(least, "x")
                if large:
                    made = moved.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
                else:
                    made = moved.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y")))
                star = made.where("x > y").distinct()
            star = self.scratch.write(star, f"{label}-{step}")
            self.scratch.drop(f"{label}-{step - 1}")
        roots = star.select(F.col("y").alias("id")).distinct().select("id", F.col("id").alias("root"))
        return self.scratch.write(star.select(F.col("x").alias("id"), F.col("y").alias("root")).unionByName(roots), f"{label}-found")

    @staticmethod
    def _stars_only(star: DataFrame) -> bool:
        """Whether each x has one y, and no y is an x: then the y are the roots."""
        ends = star.select(F.col("x").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(star.select(F.col("y").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return ends.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()

    def mixed(self, crowded: DataFrame, found: DataFrame, label: str) -> DataFrame:
        """The rows of crowded nodes that hold several components, with root."""
        rows = crowded.join(found.select(F.col("id").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        rows = self.scratch.write(rows, f"{label}-rooted")
        several = rows.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("node")
        return self.scratch.write(_with_parts(rows, several, "node", "cls"), f"{label}-mixed")

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Signed documents, classes (set_id, cls, first doc_id), and components of classes (id, root)."""
        _, n_trees, depth, branches, rounds, _ = self.settings
        signed = self.scratch.write(self.documents.mapInArrow(common.lean(partial(_sign, functions=n_trees * depth)), _SIGNED), "signed")
        usable = signed.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
        classes = usable.groupBy("set_id").agg(
            F.min(F.struct("doc_id", "text_key")).alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("tokens").alias("tokens"), F.any_value("sketch").alias("sketch")
        )
        # written, so that the numbers stay whatever is computed again
        classes = self.scratch.write(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
        nodes = classes.select("cls", "n", "sketch")
        rows = classes.select("cls", F.explode(_paths(1, self.settings, n_trees, 0)).alias("t"))
        rows = rows.select(F.xxhash64("t.number").alias("node"), "cls", F.col("t.number").alias("tree"), "t.path")
        small, crowded = self.descend(rows, "trees")
        stars, pairs = self.candidates(small, crowded, nodes, "trees")

        ids = [x.select(F.col(c).alias("cls")) for x in (stars, pairs) for c in ("a", "b")]
        needed = reduce(DataFrame.unionByName, [*ids, crowded.select("cls")]).distinct().join(classes.select("cls", "first.*"), "cls")
        sets = self.documents.join(needed, ["doc_id", "text_key"]).select("cls", "text").mapInArrow(common.lean(_sets), "cls bigint, set binary")
        sets = self.scratch.write(sets.dropDuplicates(["cls"]), "sets")  # rows may repeat

        found = self.link(stars, None, sets, "trees-stars")
        found = self.link(pairs, found, sets, "trees-pairs")
        crowded = self.mixed(crowded, found, "trees")
        small_enough = F.col("size") <= WIDE
        ended, crowded = [crowded.where(small_enough)], crowded.where(~small_enough)
        for k in range(1, rounds + 1):
            if crowded.isEmpty():
                break
            drawn = common.lean(partial(_drawn, functions=n_trees * branches * depth, draw=k))
            tokens = sets.join(crowded.select("cls").distinct(), "cls").mapInArrow(drawn, "cls bigint, tokens array<int>")
            rows = crowded.select("node", "cls", "tree").join(tokens, "cls")
            rows = rows.select("node", "cls", "tree", F.explode(_paths(1, self.settings, branches, F.col("tree") * branches)).alias("b"))
            rows = rows.select(F.xxhash64("node", "b.number").alias("node"), "cls", "tree", "b.path")
            small, crowded = self.descend(rows, f"round-{k}")
            stars, pairs = self.candidates(small, crowded, nodes, f"round-{k}")
            found = self.link(stars, found, sets, f"round-{k}-stars")
            found = self.link(pairs, found, sets, f"round-{k}-pairs")
            crowded = self.mixed(crowded, found, f"round-{k}")
            ended.append(crowded.where(small_enough))
            crowded = crowded.where(~small_enough)
        columns = ["node", "cls", "root"]
        crowded = reduce(DataFrame.unionByName, [x.select(*columns) for x in (*ended, crowded)])
        if len(ended) > 1:  # links were found since
            crowded = self.mixed(crowded.select("node", "cls"), found, "rest")
        if not crowded.isEmpty():
            found = self.extended(self._blocks(crowded, nodes, sets), found, "blocks")
        return signed, classes, found

    def _partnered(self, crowded: DataFrame, nodes: DataFrame) -> DataFrame:
        """The rows of crowded nodes whose sizes and sketches allow a link with another component of the node, with the class's nodes."""
        crowded = self.scratch.write(crowded.select("node", "cls", "root", F.collect_set("node").over(Window.partitionBy("cls")).alias("nodes")), "crowds")
        parts = crowded.groupBy("node").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("parts"))
        rows = _with_parts(crowded, parts, "node", "cls").join(nodes, "cls")
        own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
        rows = rows.select("node", "cls", "root", "nodes", "n", "sketch", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other")
        settings = self.settings

        def partners(group: pa.Table) -> pa.Table:
            return _with_partner(group, settings)

        allowed = rows.groupBy("node", "i", "j").applyInArrow(partners, "node bigint, cls bigint").distinct()
        return self.scratch.write(crowded.join(allowed, ["node", "cls"], "left_semi"), "partnered")

    def _blocks(self, crowded: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
        """Links of the classes outside the main component of each node with all of it, in blocks; of each two blocks a spanning forest."""
        crowded = self._partnered(crowded, nodes).join(nodes, "cls")
        # in shares of a block, by number and by size of sets
        share = F.greatest(F.lit(1 / WIDE), F.col("n") / (BLOCK * LONG))
        counts = crowded.groupBy("node", "root").agg(F.count("*").alias("k"), F.sum(share).alias("share"))
        main = counts.groupBy("node").agg(F.sum("share").alias("share"), F.max(F.struct("k", "root", "share")).alias("main"))
        blocks_of = lambda x: F.greatest(F.lit(1), F.ceil(x - 1e-9)).cast("int")
        main = main.select("node", blocks_of(F.col("share")).alias("blocks"), blocks_of(F.col("share") - F.col("main.share")).alias("others"), F.col("main.root").alias("main"))
        rows = _with_parts(crowded, main, "node", "cls")
        slot = lambda of: F.pmod(F.xxhash64("cls"), F.col(of)).cast("int")
        all_of = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
        columns = ["node", "cls", "root", "nodes", "sketch"]
        own = rows.select(*columns, F.lit(False).alias("asks"), slot("blocks").alias("i"), F.explode(all_of("others")).alias("j"))
        asking = rows.where("root <> main").select(*columns, F.lit(True).alias("asks"), slot("others").alias("j"), F.explode(all_of("blocks")).alias("i"))
        settings = self.settings

        def compare(group: pa.Table) -> pa.Table:
            return _compare_blocks(group, settings)

        return own.unionByName(asking).join(sets, "cls").groupBy("node", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def _compared_elsewhere(group: pa.Table) -> Callable[[int], np.ndarray]:
    """For a row of a node, which rows share a node of a smaller number with it."""
    nodes = [np.array(x, np.int64) for x in group.column("nodes").to_pylist()]
    numbers = np.concatenate(nodes)
    owners = np.repeat(np.arange(len(nodes)), [len(x) for x in nodes])
    smaller = numbers < group.column("node")[0].as_py()
    found, which = np.unique(numbers[smaller], return_inverse=True)
    has = np.zeros((len(nodes), len(found)), bool)
    has[owners[smaller], which] = True
    return lambda p: has[:, has[p]].any(axis=1)


def _with_partner(group: pa.Table, settings: Settings) -> pa.Table:
    elsewhere = _compared_elsewhere(group)
    roots, sizes = (group.column(c).to_numpy() for c in ("root", "n"))
    sketches = np.array(group.column("sketch").to_pylist(), np.int64)
    partner = np.zeros(len(roots), bool)
    for p in range(len(roots)):
        differ = np.bitwise_count(sketches[p + 1 :] ^ sketches[p]).sum(axis=1)
        fits = (differ <= settings.sketch_bits) & (roots[p + 1 :] != roots[p]) & ~elsewhere(p)[p + 1 :]
        fits &= 100 * np.minimum(sizes[p + 1 :], sizes[p]) >= settings.percent * np.maximum(sizes[p + 1 :], sizes[p])
        partner[p + 1 :] |= fits
        partner[p] |= fits.any()
    return group.select(["node", "cls"]).filter(pa.array(partner))


def _compare_blocks(group: pa.Table, settings: Settings) -> pa.Table:
    elsewhere, ids = _compared_elsewhere(group), group.column("cls").to_pylist()
    asks = np.array(group.column("asks").to_pylist(), bool)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
    sketches = np.array(group.column("sketch").to_pylist(), np.int64)
    sizes = np.array([len(x) for x in sets])
    # shingles as numbers, so that a set is marked once and met by many
    numbers = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32), np.cumsum(sizes)[:-1])
    marked = np.zeros(max(int(x.max()) for x in numbers) + 1, bool)
    roots = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]

    links = []
    for p in np.flatnonzero(asks):
        differ = np.bitwise_count(sketches ^ sketches[p]).sum(axis=1)
        fits = (differ <= settings.sketch_bits) & (100 * np.minimum(sizes, sizes[p]) >= settings.percent * np.maximum(sizes, sizes[p]))
        fits &= ~asks & (roots != roots[p]) & ~elsewhere(p)
        marked[numbers[p]] = True
        for q in np.flatnonzero(fits):
            if roots[q] != roots[p]:
                both = np.count_nonzero(marked[numbers[q]])
                if 100 * both >= settings.percent * (sizes[p] + sizes[q] - both):
                    roots[roots == roots[q]] = roots[p]
                    links.append((ids[p], ids[q]))
        marked[numbers[p]] = False
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _grouped(documents: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_id, component_id, root) of each row; root numbers the group."""
    signed, classes, found = _Join(documents, settings).run()
    known = classes.select("set_id", "cls", F.col("first.doc_id").alias("own")).join(found.withColumnRenamed("id", "cls"), "cls", "left")
    linked = known.where("root IS NOT NULL")
    least = linked.groupBy("root").agg(F.min("own").alias("least"))
    linked = _with_parts(linked, least, "root", "cls").select("set_id", "root", "least")
    known = linked.unionByName(known.where("root IS NULL").select("set_id", F.col("cls").alias("root"), F.col("own").alias("least")))
    rows = signed.select("doc_id", "text_key", "n_shingles", "set_id").join(known, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return rows.select("doc_id", "text_key", "n_shingles", "set_id", component.alias("component_id"), "root")


def near_groups(documents: DataFrame, settings: Settings = CONTRACT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, set_id) for each row with columns doc_id and text.

    component_id is the smallest doc_id in reach over links of at least settings.percent, the
    document itself included; kept is whether it is doc_id. A null or empty text, or one
    without words, has no shingle and links with nothing. A row without doc_id has a
    null component and is kept. Repeated rows have equal results. Texts that differ under a
    shared doc_id are documents of their own: the id does not link them. Other columns are
    ignored. Without documents the result is empty.
    """
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return _grouped(documents, settings).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "set_id")


def deduplicate(documents: DataFrame, settings: Settings = STAGE) -> DataFrame:
    """One row of each group, as it is: that of the smallest doc_id, and of several texts under it that with the smallest hash.

    Of rows equal in doc_id and text one stays. Rows without doc_id stay.
    """
    rows = _grouped(documents, settings).where("component_id = doc_id")
    # a text without shingles is its own group
    best = rows.groupBy("doc_id", F.coalesce("root", "text_key").alias("_root"), F.col("root").isNull().alias("_alone")).agg(F.min("text_key").alias("_key"))
    best = best.select(F.col("doc_id").alias("_kept"), "_key").distinct()
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    known = documents.where("doc_id IS NOT NULL")
    known = known.join(best, (known["doc_id"].cast("bigint") == best["_kept"]) & (key == best["_key"]), "left_semi")
    return known.unionByName(documents.where("doc_id IS NULL")).dropDuplicates(["doc_id", "text"])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"), CONTRACT).drop("set_id")


QUERIES = {"op7_near_dedup": op7}
