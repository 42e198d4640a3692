"""Near-duplicates of word-shingle sets by bottom-k sketches from one hash function.

1. A document's set is the hashes of its distinct shingles; its sketch is the `k` least. Documents
   with one and the same set (by a 128-bit fingerprint) are one class with one representative.
2. Inverted lists of the retained values over representatives. Two sets of the wanted similarity
   share at least `m` retained values (but for one chance in 10**9), so it is enough to list each
   sketch under its rarest k - m + 1 values: lists of boilerplate fall away by themselves.
3. Lists give candidate pairs; the sketch of the union, which two sketches determine, estimates
   their similarity and drops the hopeless; the rest is verified on full sets, read again from the
   documents that need it.
4. Only reachability is asked for. So each list first tests its members against one pivot (the most
   central, then one picked by hash), and only against members of other components. Members of lists
   that this leaves in several components are compared by their full sets in the order of rarity,
   which finds the pairs that can still be similar, so a list of g near copies costs about g tests, not
   g * g. With exact=True all representatives are compared so, and the chance of step 2 plays no part.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; rows
with a null id stay alone (component null, kept); repeated rows are copies of one document; rows of
one id with different texts are one document with both sets, which links what either links; very long
texts are hashed whole; other columns aren't read; an empty table gives no rows. Sets of fewer words
than a shingle are the whole sequence as one shingle.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.components import components
from tessera.llm.frames import BROADCAST_ROWS, discard, map_text, number_of, numbered, without, written

K_RETAINED = 32
#: Chance of missing a pair at the threshold.
MISS = 1e-9
#: Rounds of pivots before the rest of each list is tested in full.
ROUNDS = 1


def least_overlap(k: int, percent: int) -> int:
    """How many of k retained values two sets of this similarity share at least, but for a chance of MISS."""
    p, below, m = percent / 100, 0.0, 0
    while below + (step := comb(k, m) * p**m * (1 - p) ** (k - m)) < MISS:
        below += step
        m += 1
    return max(m, 1)


def sets_of(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 63-bit shingle hashes of all documents, and the n + 1 offsets."""
    words = K.Words(*K.text_of(part.column("text")))
    h, room, counts = words.hashes(0, lower=True), words.room(), words.counts()
    doc_of = np.repeat(np.arange(part.num_rows), counts)
    starts = np.flatnonzero(room >= n)
    values, docs = [K.rolling(h, n)[starts] if len(starts) else np.zeros(0, np.uint64)], [doc_of[starts]]
    for short in range(1, n):
        own = np.flatnonzero(counts == short)
        if len(own):
            values.append(K.rolling(h, short)[words.first[:-1][own]])
            docs.append(own)
    value, doc = np.concatenate(values) >> np.uint64(1), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(part.num_rows + 1))


def sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


def lists_of(value: np.ndarray, starts: np.ndarray, n: np.ndarray) -> pa.ListArray:
    at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(value[at].view(np.int64)))


def signatures(docs: DataFrame, n: int, k: int, id_col: str, text_col: str, full: bool = False) -> DataFrame:
    """doc_id, n (set size), s1, s2 (the set's fingerprint), and the sketch (or the full set)."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        value, offsets = sets_of(part, n)
        size = np.diff(offsets)
        values = lists_of(value, offsets[:-1], size if full else np.minimum(size, k))
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array(size), pa.array(sums(K.mix(value), offsets)),
                pa.array(sums(K.mix(value + np.uint64(1 << 63)), offsets)), values,
            ],
            names=["doc_id", "n", "s1", "s2", "values"],
        )

    return map_text(docs, id_col, text_col, kernel, "doc_id long, n long, s1 long, s2 long, values array<long>")


class Search:
    def __init__(self, docs: DataFrame, n: int, percent: int, k: int, id_col: str, text_col: str, exact: bool = False):
        self.docs, self.n, self.percent, self.k, self.id_col, self.text_col = docs, n, percent, k, id_col, text_col
        self.m, self.exact = least_overlap(k, percent), exact
        self.signed = written(signatures(docs, n, k, id_col, text_col))
        has_set = self.signed.where("n > 0 and doc_id is not null")
        self.reps = written(has_set.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.min("values").alias("values")))
        self.tested: DataFrame | None = None
        #: Tables of a step, and of the whole search, that go when it is done.
        self.step: list[str] = []
        self.whole: list[str] = []

    def lists(self) -> DataFrame:
        """(v, rep, n, central): each representative under the rarest of its retained values that others have too."""
        k, m, p = self.k, self.m, self.percent
        values = self.reps.select("rep", "n", F.explode("values").alias("v"))
        counts = values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
        own = values.join(counts, "v").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("vs"))
        # a sketch that is a whole set shares what similar sets share, less what a larger one doesn't retain
        whole = f"greatest(1, cast(ceil(n * {p} / 100.0) as int) - greatest(0, cast(floor(n * 100.0 / {p}) as int) - {k}))"
        prefix = f"least(n, {k}) - if(n >= {k}, {m}, {whole}) + 1"
        keys = F.expr(f"slice(vs, 1, cast(greatest(0, {prefix} - (least(n, {k}) - size(vs))) as int))")
        return written(
            own.select(
                "rep", "n", F.expr("aggregate(vs, 0L, (a, x) -> a + x.c)").alias("central"), F.explode(keys).alias("key"),
            ).select(F.col("key.v").alias("v"), "rep", "n", "central"),
            self.whole,
        )

    def near_sizes(self, a: str, b: str) -> str:
        return f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})"

    def pivots(self, members: DataFrame, round_: int) -> DataFrame:
        """Pairs of each list's pivot and its members of other components."""
        order = -F.col("central") if round_ == 0 else F.xxhash64("rep", "v", F.lit(round_))
        best = members.groupBy("v").agg(F.min(F.struct(order.alias("o"), "rep", "n", "comp")).alias("p"), F.count("*").alias("size")).where("size > 1")
        best = best.select("v", F.col("p.rep").alias("p"), F.col("p.n").alias("pn"), F.col("p.comp").alias("pc"))
        return members.join(best, "v").where(f"rep <> p and comp <> pc and {self.near_sizes('n', 'pn')}").select(
            F.least("rep", "p").alias("x"), F.greatest("rep", "p").alias("y"),
        )

    def sets(self, ids: DataFrame) -> DataFrame:
        """(doc_id, n, values) of full sets, read again from the documents; ids: a written table of one column `wanted`."""
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        docs = self.docs.select(
            F.col(self.id_col).cast("long").alias("doc_id"), F.col(self.text_col).cast("string").alias("text"),
        ).join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
        return signatures(docs, self.n, self.k, "doc_id", "text", full=True).where("n > 0").dropDuplicates(["doc_id", "s1", "s2"]).select("doc_id", "n", "values")

    def compared(self, members: DataFrame, found: DataFrame) -> DataFrame:
        """(doc_id, comp): representatives whose full sets are to be compared: the members of lists that pivots haven't settled (three members or more, two components or more), or all."""
        if self.exact:
            return self.reps.select(F.col("rep").alias("doc_id")).join(found.toDF("doc_id", "to"), "doc_id", "left").select(
                "doc_id", F.coalesce("to", "doc_id").alias("comp"),
            )
        mixed = members.groupBy("v").agg(
            F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        ).where("size > 2 and low <> high").select("v")
        return members.join(mixed, "v", "left_semi").select(F.col("rep").alias("doc_id"), "comp").distinct()

    def rest(self, wanted: DataFrame) -> DataFrame:
        """Pairs of different components among some representatives.

        Full sets are put in the order of rarity among these members. The least place of a common shingle bounds
        what two sets can share, so a pair is listed only if its first common shingle comes early enough in both.
        Bounds depend on (size, place, component) alone: these classes are joined first, and only classes that fit
        are spelled out. Near copies with many changes of their own fit nowhere, however many share the rest.
        """
        p = self.percent
        comps = written(wanted, self.step)
        ids = comps.select(F.col("doc_id").alias("wanted"))
        shingles = self.sets(ids).select("doc_id", "n", F.explode("values").alias("r"))
        counts = shingles.groupBy("r").agg(F.count("*").alias("c")).where("c > 1")
        shared = shingles.join(counts, "r").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "r"))).alias("rs"))
        # places up to n - (least overlap that any partner needs); single shingles come first and are no keys
        early = F.expr(f"slice(rs, 1, cast(greatest(0, n - cast(ceil({p} * n / 100.0) as long) + 1 - (n - size(rs))) as int))")
        keys = shared.select(
            "doc_id", "n", F.expr("n - size(rs)").alias("alone"), F.posexplode(early).alias("i", "key"),
        ).select(F.col("key.r").alias("r"), "doc_id", "n", (F.col("alone") + F.col("i")).alias("place")).join(comps, "doc_id")
        keys = written(keys, self.step)
        classes = keys.groupBy("r", "n", "place", "comp").count().drop("count")
        one, two = (classes.toDF("r", f"n{i}", f"place{i}", f"comp{i}") for i in (1, 2))
        need = f"{p} * (n1 + n2)"
        fits = f"comp1 < comp2 and {100 + p} * least(n1 - place1, n2 - place2) >= {need} and {self.near_sizes('n1', 'n2')}"
        fit = one.join(two, "r").where(fits)
        x, y = (
            keys.select(
                "r", F.col("doc_id").alias(f"doc{i}"), F.col("n").alias(f"n{i}"), F.col("place").alias(f"place{i}"),
                F.col("comp").alias(f"comp{i}"),
            ) for i in (1, 2)
        )
        pairs = fit.join(x, ["r", "n1", "place1", "comp1"]).join(y, ["r", "n2", "place2", "comp2"])
        return pairs.select(F.least("doc1", "doc2").alias("x"), F.greatest("doc1", "doc2").alias("y"))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches leave the wanted similarity possible."""
        k = self.k
        sketch = self.reps.select("rep", "values")
        both = pairs.join(sketch.toDF("x", "xs"), "x").join(sketch.toDF("y", "ys"), "y")
        both = both.withColumn("us", F.expr(f"slice(array_sort(array_union(xs, ys)), 1, {k})"))
        shared = F.expr("size(array_intersect(array_intersect(xs, ys), us))")
        return both.where(F.when(F.size("us") < k, 100 * shared >= self.percent * F.size("us")).otherwise(shared >= self.m)).select("x", "y").distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough."""
        sets = written(self.sets(written(pairs.select(F.explode(F.array("x", "y")).alias("wanted")).distinct(), self.step)), self.step)
        both = pairs.join(sets.toDF("x", "xn", "xs"), "x").join(sets.toDF("y", "yn", "ys"), "y").withColumn("shared", F.expr("size(array_intersect(xs, ys))"))
        return both.where(f"100 * shared >= {self.percent} * (xn + yn - shared)").select("x", "y").distinct()

    def of_one_id(self) -> DataFrame:
        """(u, v) of the representatives whose sets rows of one id have."""
        kinds = F.struct("s1", "s2", "n")
        several = self.signed.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(
            F.min(kinds).alias("low"), F.max(kinds).alias("high"),
        ).where("low <> high").select("doc_id")
        several = written(several, self.whole)
        if several.isEmpty():
            return self.docs.sparkSession.createDataFrame([], "u long, v long")
        reps = self.signed.join(several, "doc_id", "left_semi").join(self.reps.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"]).select("doc_id", "rep").distinct()
        return components(reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("x")), "doc_id").select("x", F.col("rep").alias("y")))

    def components(self) -> DataFrame:
        """(u, v): representatives that aren't the least of their component, and that least one."""
        lists = self.lists()
        found = self.of_one_id()
        for round_ in range(ROUNDS + 1):
            members = lists.join(found.toDF("rep", "to"), "rep", "left").withColumn("comp", F.coalesce("to", "rep")).drop("to")
            pairs = (self.pivots(members, round_) if round_ < ROUNDS else self.rest(self.compared(members, found))).distinct()
            if self.tested is not None:
                pairs = pairs.join(self.tested, ["x", "y"], "left_anti")
            pairs = written(pairs, self.whole)
            likely = pairs if self.exact and round_ == ROUNDS else written(self.likely(pairs), self.step)
            if not likely.isEmpty():
                new = written(self.links(likely), self.step)
                found = components(new.unionByName(found.toDF("x", "y")))
            self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
            discard(self.docs.sparkSession, self.step)
        discard(self.docs.sparkSession, self.whole)
        return found


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, k: int = K_RETAINED, id_col: str = "doc_id", text_col: str = "text",
    exact: bool = False,
) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable) and kept (whether that is the document itself).

    exact: compare all representatives by full sets after the pivots, so that no link depends on the sketches' chance.
    """
    search = Search(docs, n, percent, k, id_col, text_col, exact)
    rows = search.signed.select("doc_id", "n", "s1", "s2")
    reps = search.reps.select("s1", "s2", "n", "rep").join(search.components().toDF("rep", "comp"), "rep", "left").select(
        "s1", "s2", "n", F.coalesce("comp", "rep").alias("comp"),
    )
    alone = rows.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    linked = rows.where("doc_id is not null and n > 0").join(reps, ["s1", "s2", "n"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"),
    )
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """The rows of docs without those of another's group: the least doc_id of each stays, one row of it, and rows without an id.

    Columns may have any names; rows of one id are one document, of which one row stays, even if their texts differ.
    """
    scratch: list[str] = []
    rows, id_ = numbered(docs), number_of(docs, id_col)
    names = rows.columns
    marks = written(near_duplicates(rows, n, percent, id_col=id_, text_col=number_of(docs, text_col), exact=exact).select(F.col("doc_id").alias(id_), "kept"), scratch)
    kept = without(rows, written(marks.where("not kept").select(id_).distinct(), scratch), id_).select(*names)
    twice = written(marks.where(f"{id_} is not null").groupBy(id_).count().where("count > 1").select(id_), scratch)
    if not twice.isEmpty():
        again = kept.join(twice, id_, "left_semi").select(*names).dropDuplicates([id_])
        kept = without(kept, twice, id_).select(*names).unionByName(again)
    return kept.toDF(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 3, 85)
