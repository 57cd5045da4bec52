"""Interaction of filters: what each order of application removes, by decision diagrams.

Every document gets a mask of the filters that it fails.  Masks are counted per part, so that at
most ``2**filters`` rows a part are left, whatever the size of the corpus.  From these each part
builds an ordered decision diagram: a level a filter, shared nodes, at each node the number
of documents (also good and toxic ones) below it.  All orders are visited by swaps of two adjacent
levels; in each order the path on which every filter passes gives what a step keeps and removes.

A text is identical to an earlier one if any row of the whole table has the same text and a smaller
doc_id.  A null text is an empty one, a null part the empty string.  Rows with a null doc_id have no
labels, are never later than others and make none later.  Repeated rows count one by one; several
labels of a document hold if any says so.  An empty table has no parts and gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: Letters of the filters, in the order of their bits; the last one compares with the whole table.
LETTERS = "ABCDE"
FEWEST_WORDS = 100
LEAST_DISTINCT = 80
MOST_CAPITALS = 10

Weights = tuple[int, int, int]


def _failed(text: Column, words: Column) -> list[Column]:
    """Failure of each filter that needs only the text itself."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [
        n < FEWEST_WORDS,
        100 * distinct.cast("long") < LEAST_DISTINCT * n.cast("long"),
        100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


def failure_counts(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """Documents, good and toxic ones per part and mask of failed filters (bit k: letter k)."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    base = base.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    bits = sum((failed.cast("int") * (1 << k) for k, failed in enumerate(_failed(F.col("text"), F.col("words")))), F.lit(0))
    slim = base.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), bits.alias("mask"))
    # repeated rows shrink to one before anything is joined
    slim = slim.groupBy("id", "part", "same", "mask").agg(F.count("*").alias("n"))
    said = labels.select(F.col("doc_id").cast("long").alias("label_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.where("label_id IS NOT NULL").groupBy("label_id").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    # rows without an id are dealt by their text, so that they don't meet in one task; they match no label
    key = F.coalesce(F.col("id"), F.xxhash64("same"))
    rows = slim.withColumns({"key": key, "loose": F.col("id").isNull()}).join(said.withColumn("loose", F.lit(False)).withColumnRenamed("label_id", "key"), ["key", "loose"], "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    # equal texts have equal masks: a few rows a text are left, however many copies it has
    groups = rows.groupBy("same", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("loose"), F.col("n")).otherwise(0)).alias("loose"),
        F.min(F.when(~F.col("loose"), F.struct("id", "n"))).alias("first"),
    )
    least = F.min("first.id").over(Window.partitionBy("same"))
    first = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    groups = groups.withColumn("least", least).withColumn("first_n", F.col("loose") + first)
    repeated = F.lit(1 << (len(LETTERS) - 1))
    both = F.array(F.struct("mask", F.col("first_n").alias("n")), F.struct((F.col("mask") + repeated).alias("mask"), (F.col("n") - F.col("first_n")).alias("n")))
    flat = groups.select("part", "good", "toxic", F.inline(both)).where("n > 0")
    return flat.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    )


class Diagram:
    """Ordered decision diagram over masks; each node knows the weights of all masks below it.

    ``levels[k]`` holds the nodes that test the k-th filter of ``order`` as (passed, failed)
    children; the children of the last level are weights.  Equal nodes of a level are one node.
    """

    def __init__(self, letters: str, counts: dict[int, Weights]):
        self.order = list(letters)
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in letters]
        self.known: list[dict[tuple[int, int], int]] = [{} for _ in letters]
        self.weights: list[Weights] = []
        self.leaves: dict[Weights, int] = {}
        zero = (0, 0, 0)

        def build(k: int, mask: int) -> int:
            if k == len(letters):
                return self._leaf(counts.get(mask, zero))
            return self._node(k, build(k + 1, mask), build(k + 1, mask | 1 << k))

        self.root = build(0, 0)

    def _leaf(self, weights: Weights) -> int:
        if weights not in self.leaves:
            self.leaves[weights] = len(self.weights)
            self.weights.append(weights)
        return self.leaves[weights]

    def _node(self, level: int, passed: int, failed: int) -> int:
        found = self.known[level].get((passed, failed))
        if found is None:
            found = self.known[level][passed, failed] = len(self.weights)
            self.levels[level][found] = (passed, failed)
            self.weights.append(tuple(a + b for a, b in zip(self.weights[passed], self.weights[failed], strict=True)))
        return found

    def swap(self, k: int) -> None:
        """Exchanges levels k and k + 1.  Nodes of level k keep their number and so their parents."""
        upper, lower = self.levels[k], self.levels[k + 1]
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]
        self.levels[k], self.known[k], self.levels[k + 1], self.known[k + 1] = {}, {}, {}, {}
        for node, (passed, failed) in upper.items():
            (pp, pf), (fp, ff) = lower[passed], lower[failed]
            children = self._node(k + 1, pp, fp), self._node(k + 1, pf, ff)
            self.levels[k][node] = children
            self.known[k][children] = node

    def steps(self) -> list[tuple[Weights, int]]:
        """What each step of the present order removes, and how many documents it keeps."""
        found, node = [], self.root
        for level in self.levels:
            node, failed = level[node]
            found.append((self.weights[failed], self.weights[node][0]))
        return found


def plain_changes(n: int) -> Iterator[int]:
    """Positions of the adjacent swaps that visit all orders of n things once each."""
    places, ways = list(range(n)), [-1] * n
    while True:
        for thing in reversed(range(n)):
            at = places.index(thing)
            to = at + ways[thing]
            if 0 <= to < n and places[to] < thing:
                break
        else:
            return
        places[at], places[to] = places[to], places[at]
        for larger in range(thing + 1, n):
            ways[larger] = -ways[larger]
        yield min(at, to)


def all_orders(letters: str, counts: dict[int, Weights]) -> dict[str, list[tuple[Weights, int]]]:
    """Steps of every order of the filters, from one diagram."""
    diagram = Diagram(letters, counts)
    found = {"".join(diagram.order): diagram.steps()}
    for k in plain_changes(len(letters)):
        diagram.swap(k)
        found["".join(diagram.order)] = diagram.steps()
    return found


ROWS = pa.schema(
    [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
    + [(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
)


def _audited(letters: str) -> Callable[[pa.Table], pa.Table]:
    def audit(table: pa.Table) -> pa.Table:
        rows = table.select(["mask", "n", "good", "toxic"]).to_pydict()
        orders = all_orders(letters, dict(zip(rows["mask"], zip(rows["n"], rows["good"], rows["toxic"], strict=True), strict=True)))
        failing, alone, shapley = {}, {}, dict.fromkeys(letters, 0)
        for order, steps in orders.items():
            failing[order[0]] = steps[0][0][0]
            alone[order[-1]] = steps[-1][0][0]
            for letter, (removed, _) in zip(order, steps, strict=True):
                shapley[letter] += removed[0]
        part = table.column("part")[0].as_py()
        out = [
            (part, order, k + 1, kept, n, failing[order[k]] - n, alone[order[k]], good, toxic, shapley[order[k]])
            for order, steps in sorted(orders.items())
            for k, ((n, good, toxic), kept) in enumerate(steps)
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ROWS, strict=True)], schema=ROWS)

    return audit


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step, from the output of :func:`failure_counts`."""
    schema = "part string, filter_order string, step int, " + ", ".join(f"{f.name} long" for f in list(ROWS)[3:])
    return counts.groupBy("part").applyInArrow(_audited(letters), schema)
