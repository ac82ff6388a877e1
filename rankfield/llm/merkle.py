"""A Merkle manifest of a dataset: one tree of the rows of each source, and one over the sources.

Every 16 consecutive nodes of a level become one node of the next, until one remains. Rows get
their place in their source from per-partition counts of a range-sorted table, so no source has to
fit one task. Tasks then append aligned blocks of 4,096 leaves in order. A leaf that is appended
has an empty witness and belongs to the open subtree of its own; whenever a run of siblings is
complete, the witnesses of all leaves below each of them are extended by the others, and the run
is appended to the level above as one node. The roots of blocks are appended to blocks of their
own in the same way, level by level, so the driver sees nothing but one count. At last a block's
leaves are appended once more behind a header, the witness of the block's root, which continues
theirs up to the root of all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfield.llm.tables import discard, staged

FANOUT = 16
#: Levels of a block, which has 16^3 leaves.
BLOCK_LEVELS = 3
#: Leaves that leave a task at a time, whole blocks.
OUT_ROWS = 2048

WITNESS = "array<struct<before: string, after: string>>"
_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 in hexadecimal of the columns: each ``-`` if null, else its bytes in UTF-8, a colon and its value."""
    said = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said)).cast("binary"), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf digest and a witness give."""
    return F.aggregate(witness, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def proof_digest(witness: Column) -> Column:
    """SHA-256 of all siblings of a witness, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda step: F.concat(step["before"], step["after"])), "").cast("binary"), 256)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's number within its tree's rows of this task; rows come sorted."""
    part = TaskContext.get().partitionId()
    tree, seen = None, 0
    for batch in batches:
        places = []
        for one in batch.column("tree").to_pylist():
            if one != tree:
                tree, seen = one, 0
            places.append(seen)
            seen += 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"]
        )


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, their place among the rows of their ``tree`` in the order of ``order``, and ``total``, how many these are.

    ``rows`` has to be a staged table; equal rows are spread by its column ``row``, which then goes.
    """
    keys = ["tree", *order, "row"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    numbered = staged(ranged.mapInArrow(_numbered, f"{fields}, part int, place long"), "numbered")
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("n"))  # a row for each part and for each tree within one
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    whole = numbered.join(starts, ["tree", "part"]).withColumn("at", F.col("start") + F.col("place"))
    out = staged(whole.drop("part", "place", "start"), "placed")
    discard(numbered)
    return out


def _levels(total: int, most: int) -> int:
    """Levels that a block of a tree of ``total`` leaves climbs, ``most`` at most."""
    levels = 0
    while total > 1 and levels < most:
        total, levels = -(-total // FANOUT), levels + 1
    return levels


class _Appender:
    """One block: nodes are appended on the right, witnesses grow as runs of siblings become whole."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open = [([], []) for _ in range(levels)]  # of each level, the nodes of the open run and the leaves below each of them
        self.root = None
        self.witnesses: list[list[tuple[str, str]]] = []

    def append(self, node: str) -> None:
        self.witnesses.append([])
        self._append(0, node, [len(self.witnesses) - 1])

    def _append(self, level: int, node: str, leaves: list[int]) -> None:
        if level == self.levels:
            self.root = node
            return
        nodes, below = self.open[level]
        nodes.append(node)
        below.append(leaves)
        if len(nodes) == FANOUT:
            self._complete(level)

    def _complete(self, level: int) -> None:
        nodes, below = self.open[level]
        self.open[level] = ([], [])
        run = "".join(nodes)
        for i, leaves in enumerate(below):
            step = (run[: 64 * i], run[64 * (i + 1) :])
            for leaf in leaves:
                self.witnesses[leaf].append(step)
        self._append(level + 1, hashlib.sha256(run.encode()).hexdigest(), [leaf for leaves in below for leaf in leaves])

    def close(self) -> str:
        """The block's root, its last runs being as short as they are."""
        for level in range(self.levels):
            if self.open[level][0]:
                self._complete(level)
        return self.root


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((tree, block), rows) of every block, from rows sorted by tree, block and place."""
    name, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:2] != name:
                if rows:
                    yield name, rows
                name, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield name, rows


def _roots(most: int):
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The root of every block, as a leaf of a tree of blocks."""
        out = []
        for (tree, block), rows in _blocks(batches):
            total = rows[0][1]
            block_of = _Appender(_levels(total, most))
            for _, _, node in rows:
                block_of.append(node)
            out.append((tree, block, -(-total // FANOUT**most), block_of.close()))
            if len(out) >= OUT_ROWS:
                yield _root_batch(out)
                out = []
        if out:
            yield _root_batch(out)

    return roots


def _root_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tree", "at", "total", "node"])


def _witnessed(most: int):
    def witnessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of every block with their witnesses, each block led by its header."""
        out, steps = [], []
        for (tree, _), (header, *rows) in _blocks(batches):
            *_, above, subroot, root = header
            above = [(step["before"], step["after"]) for step in above]
            block_of = _Appender(_levels(rows[0][1], most))
            for row in rows:
                block_of.append(row[2])
            block_of.close()
            for (at, _, node, doc_id, altered, *_), witness in zip(rows, block_of.witnesses, strict=True):
                out.append((tree, at, node, doc_id, altered, subroot, root))
                steps.append(witness + above)
            if len(out) >= OUT_ROWS:
                yield _witness_batch(out, steps)
                out, steps = [], []
        if out:
            yield _witness_batch(out, steps)

    return witnessed


def _witness_batch(rows: list[tuple], steps: list[list[tuple[str, str]]]) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [text, number, text, number, text, text, text], strict=True)]
    ends = [0]
    for witness in steps:
        ends.append(ends[-1] + len(witness))
    flat = [step for witness in steps for step in witness]
    pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], text), pa.array([s[1] for s in flat], text)], names=["before", "after"])
    witnesses = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(_STEPS)
    return pa.RecordBatch.from_arrays([*columns, witnesses], names=["tree", "at", "node", "doc_id", "altered", "subroot", "root", "witness"])


def _block(most: int) -> Column:
    return F.expr(f"at div {FANOUT**most}").alias("block")


def _climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Staged (tree, at, total, node) of the block roots over ``nodes``, and of the block roots over these, until every tree has one."""
    levels = []
    while True:
        keyed = nodes.select("tree", _block(most), "at", "total", "node")
        sorted_ = keyed.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
        nodes = staged(sorted_.mapInArrow(_roots(most), "tree string, at long, total long, node string"), "roots")
        levels.append(nodes)
        if (nodes.agg(F.max("total")).first()[0] or 1) == 1:
            return levels


def _descend(nodes: DataFrame, headers: DataFrame, most: int) -> DataFrame:
    """``nodes`` with their witnesses, which ``headers`` (tree, at, witness, subroot, root) of their blocks continue."""
    rows = nodes.select("tree", _block(most), "at", "total", "node", "doc_id", "altered", *_nothing("witness", "subroot", "root"))
    heads = headers.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), *_nothing("total", "node", "doc_id", "altered"), "witness", "subroot", "root")
    together = rows.union(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    return together.mapInArrow(_witnessed(most), f"tree string, at long, node string, doc_id long, altered string, subroot string, root string, witness {WITNESS}")


_KINDS = {"total": "long", "node": "string", "doc_id": "long", "altered": "string", "subroot": "string", "root": "string", "witness": WITNESS}


def _nothing(*names: str) -> list[Column]:
    return [F.lit(None).cast(_KINDS[name]).alias(name) for name in names]


def _witnesses(nodes: DataFrame, most: int, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``nodes`` with witnesses; ``above`` makes of the roots (tree, subroot) what continues a tree's: (tree, above, root)."""
    levels = _climb(nodes, most)
    if above is None:
        over = levels[-1].select("tree", "at", F.array().cast(WITNESS).alias("witness"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    else:
        roots = levels[-1].select("tree", F.col("node").alias("subroot"))
        over = roots.join(above(roots), "tree").select("tree", F.lit(0).cast("long").alias("at"), F.col("above").alias("witness"), "subroot", "root")
    for level in reversed(levels[:-1]):
        over = _descend(level.select("*", *_nothing("doc_id", "altered")), over, most)
    return _descend(nodes, over, most)


def _over_sources(roots: DataFrame, most: int) -> DataFrame:
    """(tree, above, root) for the root of each source: its witness in the tree over all sources."""
    leaves = staged(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("subroot").alias("node"), F.lit(0).alias("row")), "sources")
    nodes = placed(leaves, "of")
    discard(leaves)
    witnessed = _witnesses(nodes.select("tree", "at", "total", "node", *_nothing("doc_id", "altered")), most)
    return nodes.select("of", "at").join(witnessed.select("at", "witness", "root"), "at").select(F.col("of").alias("tree"), F.col("witness").alias("above"), "root")


def manifest(docs: DataFrame, altered: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, source, leaf, altered, subroot, root, witness) of every row of ``docs``.

    Leaves digest doc_id, source, lang, n_chars and text and ascend by doc_id within a source; rows
    without doc_id come first, rows of one doc_id in the order of their digests. ``altered`` is a
    text that may stand in the place of ``text``, or null; its leaf is given beside the true one. A
    source that is null is the first one, the empty one the next. A witness has the siblings before
    and after the node of each level. An empty table gives no rows; further columns are ignored;
    equal rows have a leaf each. ``block_levels`` sets how many leaves a task appends at a time, not
    what comes out. Runs jobs when called, one more for each factor of a block's leaves.
    """
    fields = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    other = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf_digest(*fields, altered))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    narrow = docs.select(tree.alias("tree"), F.col("doc_id").cast("long"), leaf_digest(*fields, F.col("text")).alias("node"), other.alias("altered"))
    leaves = staged(narrow.withColumn("row", F.monotonically_increasing_id()), "leaves")
    nodes = placed(leaves, "doc_id", "node")
    discard(leaves)
    rows = _witnesses(nodes, block_levels, lambda roots: _over_sources(roots, block_levels))
    source = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    return rows.select("doc_id", source.alias("source"), F.col("node").alias("leaf"), "altered", "subroot", "root", "witness")
