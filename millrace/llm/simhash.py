"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments, a point of
{0,1,2}^32 kept packed in one long. The Manhattan distance of two points never exceeds the
Hamming distance of the fingerprints. The segments form ``g`` groups; points within
Manhattan distance 4 agree wholly on ``g - 4`` groups or more, so the cells of the grids over each
choice of ``g - 4`` groups (70 grids of eight groups) hold every such pair together. Cells are joined, pairs kept in
the first grid that holds them, and the exact Hamming distance decides. More groups make more grids
with smaller cells; ``g`` follows the number of fingerprints (``groups_for``), and any ``g`` finds the same pairs.

Cells with more than ``dense`` different fingerprints are not compared pair by pair: there,
two fingerprints within four bits share a midpoint within two bits of both, and only such
share one, so each midpoint links its fingerprints to the smallest (2,081 midpoints each).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, number_of, numbered, per_document, quoted, stage

SEED, WORDS, LIMIT, CHUNK = 42, 4, 4, 1 << 15
LOW = 0x5555555555555555
SEGMENTS = 32
#: Numbers of groups to choose from, and the cost of comparing two fingerprints of a cell against that of a row of a grid.
GROUPS, COMPARED = (8, 10, 12, 16), 0.05


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash over XXH64 of the word shingles, with repeats; 0 without words."""
    found = text.encode().lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    n = max(1, len(found) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    count = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(line[i:j], seed) for i, j in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], np.uint64)
        count += np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed long."""
    return per_document(docs, keep, "fp long", lambda: lambda texts: [[signed(fingerprint(t, words)) for t in texts]], text_col)


def _embedded(fp: Column) -> Column:
    """Bit counts of the two-bit segments, packed in place."""
    even, odd = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return even.bitwiseXOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def _bounds(groups: int) -> list[int]:
    """Where each group of segments starts, and the end."""
    return [round(i * SEGMENTS / groups) for i in range(groups + 1)]


def _masks(groups: int) -> list[int]:
    """The bits of each group."""
    at = _bounds(groups)
    return [(1 << 2 * b) - (1 << 2 * a) for a, b in zip(at, at[1:])]


def grids_of(groups: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Each grid's bits, and a mark for each earlier group that it leaves out."""
    masks = _masks(groups)
    return [(sum(masks[g] for g in k), sum(1 << g for g in range(max(k)) if g not in k)) for k in combinations(range(groups), groups - limit)]


def groups_for(n: int, limit: int = LIMIT) -> int:
    """The number of groups with the least expected work a fingerprint, among ``n`` that are spread like random ones.

    Two random segments have the same bit count with a chance of 3/8.
    """

    def work(groups: int) -> float:
        return sum(1 + COMPARED * n / 2 * 0.375 ** (mask.bit_count() // 2) for mask, _ in grids_of(groups, limit))

    return min(GROUPS, key=work)


def links(fps: DataFrame, limit: int = LIMIT, dense: int = 4096, groups: int | None = None) -> DataFrame:
    """Edges (a, b) between different values of ``fp`` that give the components of all pairs within ``limit`` bits.

    Every edge is itself such a pair or, in dense cells, joins two fingerprints with a common
    midpoint, which is the same thing.
    """
    if limit != LIMIT:
        raise ValueError("the grids are laid for four bits")
    each = stage(fps.where("fp is not null").select("fp").distinct(), "fingerprints")
    # dealt out evenly, as each fingerprint becomes a row a grid
    dealt = each.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    groups = groups or groups_for(each.count(), limit)
    grids = grids_of(groups, limit)
    grid = F.expr("array(" + ", ".join(f"struct({i}S AS k, {signed(m)}L AS m)" for i, (m, _) in enumerate(grids)) + ")")
    v = _embedded(F.col("fp"))
    cells = dealt.select("fp", F.explode(grid).alias("g")).select(F.col("g.k").alias("k"), v.bitwiseAND(F.col("g.m")).alias("cell"), "fp")
    crowded = stage(cells.groupBy("k", "cell").count().where(F.col("count") > dense).select("k", "cell"), "dense_cells")
    any_crowded = not crowded.isEmpty()
    open_cells = cells.join(crowded, ["k", "cell"], "left_anti") if any_crowded else cells
    # a sort-merge join by hint: sizes are estimated without the grids, so Spark might broadcast all cells
    a, b = open_cells.alias("p").hint("merge"), open_cells.alias("q")
    fa, fb = F.col("p.fp"), F.col("q.fp")
    x = _embedded(fa).bitwiseXOR(_embedded(fb))
    low, high = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(LOW))
    manhattan = F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))
    differ = reduce(Column.bitwiseOR, [F.when(x.bitwiseAND(F.lit(signed(m))) != 0, 1 << g).otherwise(0) for g, m in enumerate(_masks(groups))])
    # no group outside the grid and before its last is wholly alike: no earlier grid holds the pair
    earlier = F.element_at(F.expr("array(" + ", ".join(str(w) for _, w in grids) + ")"), F.col("p.k").cast("int") + 1)
    first = differ.bitwiseAND(earlier) == earlier
    pairs = a.join(
        b,
        (F.col("p.k") == F.col("q.k")) & (F.col("p.cell") == F.col("q.cell")) & (fa < fb) & (manhattan <= limit)
        & (F.bit_count(fa.bitwiseXOR(fb)) <= limit) & (F.lit(True) if any_crowded else first),
    ).select(fa.alias("a"), fb.alias("b"))
    if not any_crowded:
        return pairs
    inside = cells.join(crowded, ["k", "cell"], "left_semi").select("fp").distinct()
    masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    mid = stage(inside.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("mid")), "midpoints")
    first = mid.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("mid", "b")
    stars = mid.join(first, "mid").where("fp != b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = 4096) -> DataFrame:
    """One row a document: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Lower-cases A-Z, takes words split at ASCII white space and four-word shingles with
    repeats; fewer words make one shingle. Null and empty texts have fingerprint zero and link
    like any other. ``component_id`` is the smallest id reachable over links of four bits or
    fewer; null ids get the component of their group and are never its smallest unless all are
    null. Repeated rows stay.
    """
    base = stage(fingerprints(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), ["id"]), "documents")
    classes = components(links(base, dense=dense))
    return (
        labelled(base, classes)
        .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def labelled(base: DataFrame, classes: DataFrame) -> DataFrame:
    """``base`` (id, fp, ...) with ``component_id``, the smallest id of the class of its fingerprint."""
    by_fp = base.groupBy("fp").agg(F.min("id").alias("least"))
    grouped = stage(by_fp.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp")), "grouped")
    # written, so that the join on the class can be split where one class is large
    least = stage(grouped.groupBy("class").agg(F.min("least").alias("component_id")), "classes")
    of = grouped.select("fp", "class").join(least, "class").select("fp", "component_id")
    return base.join(of, "fp", "left")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns and rows of ``docs``, of each group of near-duplicates only one row.

    The row kept has the smallest id of the group; of rows that share it, the one with the
    smallest hash of its text. Rows without an id count after all others. Null and empty texts are near-duplicates
    of one another; columns keep their values whatever their names.
    """
    renamed, id_at, text_at = numbered(docs), number_of(docs, id_col), number_of(docs, text_col)
    keyed = stage(fingerprints(renamed.withColumn("row", F.monotonically_increasing_id()), [*renamed.columns, "row"], text_at), "documents")
    classes = components(links(keyed.select("fp")))
    rank = F.struct(F.col(id_at).isNull().alias("n"), F.col(id_at).alias("i"), F.xxhash64(text_at).alias("h"), F.col("row").alias("row"))
    ranked = keyed.select("fp", rank.alias("rank")).groupBy("fp").agg(F.min("rank").alias("rank"))
    first = ranked.join(classes.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("rank").alias("rank"))
    return keyed.join(first.select(F.col("rank.row").alias("row")), "row", "left_semi").select(*renamed.columns).toDF(*docs.columns)
