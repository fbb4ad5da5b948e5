"""Sharding by a k-d tree over metadata; DataFrame functions only.

Documents are points: a code per text column of metadata (its place among the distinct
values) and a clamped number per numeric one. A node that is to become ``n`` leaves is split
where its bytes reach the share of ``n // 2`` of them, along the dimension in which it is
widest (its extent over the extent of the whole table; the first of equals). So all leaves
come to the target bytes, as nearly as whole documents allow: a document over which a cut
falls goes to the side that holds its middle.

The weighted median of a node is exact and found without a sort. A point's key is (its
coordinate, its id); a round adds up the bytes of 512 equal ranges of the key per node, keeps
the range that holds the cut and looks closer into it. Combined before the exchange, a round
moves at most 256 rows per node and task, whatever values are frequent. All nodes of a level
go through the rounds together. A level's cuts are one row per node, written to the shared
folder; the tree is the list of these tables and is applied to any rows by one join per level.

``slot`` numbers the rows of a shard from 0 in the order of a hash of the id, by the counts
of hash ranges of about 4096 rows, so that no task numbers a whole shard.

NULL texts count as empty (size 1), NULL metadata as '' or 0, a NULL id as the smallest.
Rows that share an id and a coordinate stay on one side of a cut. An empty table has no
rows; fewer documents than shards leave shards empty. Groups of equal texts have no part
in this law: one that is larger than a shard could not stay whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whence.session import durable
from whence.sources.text import dense_index

#: Ranges that a round tells apart in a node, and rows of a hash range when slots are given.
RANGES = 512
SLOT_ROWS = 4096
#: Numeric metadata are clamped to 0 .. MOST.
MOST = 1 << 40
#: Order value of a NULL id.
LEAST = -(2**63)
LOW = (1 << 32) - 1

#: What is known of a cut that is searched: the key's parts so far, the bytes before and in the open range.
PARTS = ("at", "high", "low")
STATE = ("node", "dim", "target", "stage", "before", "own", *PARTS, "from", "to")
FOUND = {"id": "__kd_id", "size": "__kd_size", "first": "__kd_first", "leaves": "__kd_leaves"}


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (none if NULL) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def rounds_for(width: int) -> int:
    """Rounds until a range of ``width`` + 1 values is down to one."""
    rounds = 0
    while width > 0:
        width //= RANGES
        rounds += 1
    return rounds


class Tree:
    """A k-d tree over ``dims`` (metadata columns of the documents) with ``leaves`` leaves."""

    def __init__(self, docs: DataFrame, dims: Sequence[str], leaves: int | None = None, target_bytes: int | None = None):
        self.dims = list(dims)
        self.codes: dict[str, DataFrame] = {}
        slim = durable(docs.select(*dict.fromkeys(["doc_id", *self.dims]), size_of(F.col("text")).alias(FOUND["size"])))
        for name in self.dims:
            if not isinstance(docs.schema[name].dataType, T.NumericType):
                values = slim.select(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("value")).distinct()
                self.codes[name] = durable(dense_index(values, ["value"], "code"))
        self.bytes = slim.agg(F.sum(FOUND["size"])).first()[0] or 0
        self.leaves = leaves or max(1, -(-self.bytes // (target_bytes or 1 << 28)))
        points = durable(self.points(slim).select(*FOUND.values(), *self.axes))
        low = F.col(FOUND["id"]).bitwiseAND(F.lit(LOW))
        high = F.shiftright(FOUND["id"], 32)
        seen = points.agg(*[f(c).alias(n) for n, f, c in self._extents(low, high)]).first()
        #: Least and largest of each coordinate and of the halves of the id.
        self.extent = {c: (seen[f"least_{c}"], seen[f"most_{c}"]) for c in [*self.axes, "high", "low"]}
        #: Rounds that every cut needs at most.
        widths = [max((m - l for l, m in map(self.extent.get, self.axes)), default=0) if self.bytes else 0]
        widths += [self.extent[c][1] - self.extent[c][0] if self.bytes else 0 for c in ("high", "low")]
        self.rounds = sum(rounds_for(w) for w in widths) + (widths[2] == 0)
        self.levels: list[DataFrame] = []
        while self.bytes and 1 << len(self.levels) < self.leaves:
            self.levels.append(self._cuts(self._walk(points)))

    @property
    def axes(self) -> list[str]:
        return [f"__kd_x{i}" for i in range(len(self.dims))]

    def _extents(self, low: Column, high: Column):
        named = [*[(a, F.col(a)) for a in self.axes], ("high", high), ("low", low)]
        return [x for n, c in named for x in ((f"least_{n}", F.min, c), (f"most_{n}", F.max, c))]

    def points(self, docs: DataFrame) -> DataFrame:
        """``docs`` with order value, coordinates and the root's leaves; needs doc_id, the dims and the size."""
        for axis, name in zip(self.axes, self.dims):
            if name in self.codes:
                # Values that the tree has not seen stand before all others.
                code = self.codes[name].toDF("__kd_value", "__kd_code")
                docs = docs.join(code, F.coalesce(F.col(name).cast("string"), F.lit("")) == F.col("__kd_value"), "left")
                docs = docs.withColumn(axis, F.coalesce("__kd_code", F.lit(-1)).cast("bigint")).drop("__kd_value", "__kd_code")
            else:
                number = F.coalesce(F.col(name), F.lit(0)).cast("double")
                docs = docs.withColumn(axis, F.greatest(F.least(number, F.lit(float(MOST))), F.lit(0.0)).cast("bigint"))
        # The root's number is a column, as joins on a literal would be planned without a key.
        root = F.pmod(F.xxhash64("doc_id"), F.lit(1)).cast("int")
        return docs.withColumn(FOUND["id"], F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST))).withColumns(
            {FOUND["first"]: root, FOUND["leaves"]: F.lit(self.leaves)}
        )

    def _walk(self, points: DataFrame) -> DataFrame:
        """The points at their nodes, below all levels so far; a node is named by its first shard."""
        first, leaves, id_ = FOUND["first"], FOUND["leaves"], FOUND["id"]
        kept = points.columns
        for cuts in self.levels:
            named = cuts.selectExpr(*[f"{c} as __kd_{c}" for c in ("node", "dim", "at", "cut", "takes")])
            x = f"element_at(array({', '.join(self.axes)}), __kd_dim + 1)"
            left = f"({x} < __kd_at or ({x} = __kd_at and ({id_} < __kd_cut or ({id_} = __kd_cut and __kd_takes))))"
            points = points.join(named, F.expr(f"{first} = __kd_node"), "left").selectExpr(
                *[f"`{c}`" for c in kept if c not in (first, leaves)],
                f"if(__kd_node is null or {left}, {first}, {first} + {leaves} div 2) as {first}",
                f"cast(case when __kd_node is null then {leaves} when {left} then {leaves} div 2 "
                f"else {leaves} - {leaves} div 2 end as int) as {leaves}",
            )
        return points

    def _cuts(self, points: DataFrame) -> DataFrame:
        """node, dim, at, cut, takes: which key a node is cut at, and whether the left side takes that key."""
        first, leaves, size = (F.col(FOUND[c]) for c in ("first", "leaves", "size"))
        points = points.filter(leaves > 1)
        stats = points.groupBy(first.alias("node")).agg(
            F.sum(size).alias("bytes"), F.max(leaves).cast("bigint").alias("leaves"),
            *[f(a).alias(f"{n}_{a}") for a in self.axes for n, f in (("least", F.min), ("most", F.max))],
        )
        wide = []
        for i, a in enumerate(self.axes):
            extent = float(self.extent[a][1] - self.extent[a][0]) or 1.0
            width = (F.col(f"most_{a}") - F.col(f"least_{a}")).cast("double") / F.lit(extent)
            wide.append(F.struct(width.alias("width"), F.lit(-i).alias("dim")))
        target = F.expr(
            "(bytes div leaves) * (leaves div 2) + ((bytes % leaves) * (leaves div 2)) div leaves"
        )
        ends = {n: F.element_at(F.array(*[f"{n}_{a}" for a in self.axes]), F.col("dim") + 1) for n in ("least", "most")}
        state = stats.withColumn("dim", -F.array_max(F.array(*wide))["dim"]).select(
            "*", target.alias("target"), ends["least"].alias("from"), ends["most"].alias("to")
        )
        state = state.selectExpr(
            "node", "dim", "target", "0 as stage", "0L as before", "0L as own", "0L as at", "0L as high", "0L as low", "`from`", "`to`"
        )
        state = durable(self._settled(state))
        for _ in range(self.rounds):
            state = durable(self._closer(points, state))
        takes = F.col("before") * 2 + F.col("own") <= F.col("target") * 2
        return state.select("node", "dim", "at", (F.shiftleft("high", 32) + F.col("low")).alias("cut"), takes.alias("takes"))

    def _settled(self, state: DataFrame) -> DataFrame:
        """Takes over what is down to one value and goes on to the next part of the key: coordinate, high, low half of the id."""
        for stage, name in enumerate(PARTS):
            # The last part is settled by a round only, since the bytes of the key come from one.
            done = f"(stage = {stage} and `from` = `to` {'and own > 0' if name == 'low' else ''})"
            least, most = self.extent["high" if stage == 0 else "low"]
            new = {
                name: f"if({done}, `from`, {name})",
                "stage": f"if({done}, {stage + 1}, stage)",
                "own": "own" if name == "low" else f"if({done}, 0L, own)",
                "from": f"if({done}, {least}L, `from`)",
                "to": f"if({done}, {most}L, `to`)",
            }
            state = state.selectExpr(*[f"{new.get(c, c)} as `{c}`" for c in STATE])
        return state

    def _closer(self, points: DataFrame, state: DataFrame) -> DataFrame:
        """One round: of the ranges of what is open in each node, the one in which the bytes reach the target."""
        id_, x = FOUND["id"], f"element_at(array({', '.join(self.axes)}), dim + 1)"
        high, low = f"shiftright({id_}, 32)", f"({id_} & {LOW}L)"
        part = f"(case stage when 0 then {x} when 1 then {high} else {low} end)"
        here = (
            f"{FOUND['first']} = node and {part} >= `from` and {part} <= `to` "
            f"and (stage = 0 or {x} = at) and (stage < 2 or {high} = high)"
        )
        names = [f"`{c}`" for c in STATE]
        seen = points.join(state.filter("stage < 3"), F.expr(here)).selectExpr(
            *names, f"({part} - `from`) div ((`to` - `from`) div {RANGES} + 1) as range", f"{FOUND['size']} as bytes"
        )
        sums = seen.groupBy(*STATE, "range").agg(F.sum("bytes").alias("bytes"))
        upto = "before + sum(bytes) over (partition by node order by range) as upto"
        # Sizes are positive, so the target falls into one range.
        reached = sums.selectExpr("*", upto, f"(`to` - `from`) div {RANGES} + 1 as step").filter(
            "upto > target and upto - bytes <= target"
        )
        new = {
            "before": "upto - bytes", "own": "bytes", "from": "`from` + range * step",
            "to": "least(`from` + range * step + step - 1, `to`)",
        }
        moved = reached.selectExpr(*[f"{new.get(c, f'`{c}`')} as `{c}`" for c in STATE])
        return self._settled(moved).unionByName(state.filter("stage = 3"))

    def place(self, docs: DataFrame, name: str = "shard") -> DataFrame:
        """``docs`` (doc_id and the dims, with whatever else) with the shard of each row."""
        kept = [c for c in docs.columns if c != name]
        return self._walk(self.points(docs.select(*kept))).select(*kept, F.col(FOUND["first"]).cast("int").alias(name))


def numbered(rows: DataFrame, name: str = "slot") -> DataFrame:
    """Adds ``name``: the place of each row (doc_id, shard) in its shard, from 0 and without gaps.

    The order is that of a hash of the id, then of the id and the columns. The hash is cut into
    so many ranges that about ``SLOT_ROWS`` rows share one; a range is numbered from the count
    of those before it.
    """
    others = [c for c in rows.columns if c not in ("doc_id", "shard")]
    rows = rows.withColumn("__hash", slot_hash(F.col("doc_id")))
    ranges = max(1, rows.count() // SLOT_ROWS)
    rows = rows.withColumn("__range", F.expr(f"(__hash * {ranges}) div 4294967296"))
    counts = rows.groupBy("shard", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = durable(counts.select("shard", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    order = Window.partitionBy("shard", "__range").orderBy("__hash", "doc_id", *others)
    return (
        rows.withColumn("__place", F.row_number().over(order))
        .join(counts, ["shard", "__range"])
        .withColumn(name, F.col("__before") + F.col("__place") - 1)
        .drop("__hash", "__range", "__place", "__before")
    )


def slot_hash(doc_id: Column) -> Column:
    """32 bits of a hash of the id; a NULL id hashes as an empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")


def write_shards(docs: DataFrame, tree: Tree, path: str) -> None:
    """``docs`` as Parquet below ``path``, a folder ``shard=<n>`` per shard, rows in hash order."""
    placed = tree.place(docs).withColumn("__hash", slot_hash(F.col("doc_id")))
    files = placed.repartitionByRange("shard", "__hash").sortWithinPartitions("shard", "__hash", "doc_id")
    files.drop("__hash").write.partitionBy("shard").parquet(path)


#: Production parameters.
SHARDS = 16
DIMENSIONS = ("lang", "source", "n_chars")


def document_shards(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    slim = docs.select(
        "doc_id", *DIMENSIONS, size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = Tree(docs, DIMENSIONS, SHARDS).place(slim).drop(*DIMENSIONS)
    return numbered(durable(placed)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
