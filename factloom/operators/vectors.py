"""A vector index of cells with radii: exact similarity joins and exact nearest neighbours by angle.

Centres are drawn from a bounded sample; every vector belongs to the cell of its nearest centre, at an angle to it. Angles obey the triangle
inequality, so a cell whose centre is further from a vector than the cell's radius and the wanted angle together holds nothing wanted: it need not be looked
at, and what was found is proven to be all. Where all pairs are asked for, rows meet by equality of group and cell. Where the nearest are, or what pairs connect, cells are packed or
split into blocks of about BLOCK rows; a task holds one as a matrix, what is asked of it streams by, and whole products are taken.

Vectors of length zero, null ones and those of another width than the index are like nothing. Cosines are rounded to six digits before
they are compared, so that equal vectors tie whatever the order of summing up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
#: Angles are compared with so much to spare.
SLACK = 1e-5
#: Rows that a task holds as a matrix, and rows multiplied with it at once.
BLOCK, STEP = 8192, 256


@dataclass
class Index:
    """rows: those of the table with unit vector, cell and angle; centres: an array of unit vectors; radii and counts of rows: by cell."""

    rows: DataFrame
    centres: object
    radii: object
    counts: object
    columns: list[str]


def centres_of(vectors: DataFrame, cells: int, sample: int, vector_col: str):
    """Unit vectors far from each other among a sample of so many distinct vectors, those of the least hashes."""
    import numpy as np

    drawn = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).filter("v is not null").distinct().orderBy(F.xxhash64("v")).limit(sample).collect()
    width = max((len(r.v) for r in drawn), default=1)
    points = np.array([r.v for r in drawn if len(r.v) == width], np.float64).reshape(-1, width)
    points = points[np.linalg.norm(points, axis=1) > 0]
    if not len(points):
        return np.eye(1, width)
    points /= np.linalg.norm(points, axis=1)[:, None]
    chosen = [0]
    nearest = points @ points[0]
    while len(chosen) < min(cells, len(points)) and nearest.min() < 1 - 1e-9:  # next the one that is furthest from those chosen
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, points @ points[chosen[-1]])
    return points[chosen]


def unit_batch(column, width: int):
    """Unit vectors of an Arrow list column and which rows have one."""
    import numpy as np

    rows = column.to_pylist()
    good = np.array([x is not None and len(x) == width and None not in x for x in rows], bool)
    out = np.zeros((len(rows), width))
    if good.any():
        out[good] = np.array([x for x, g in zip(rows, good, strict=True) if g], np.float64)
    norms = np.linalg.norm(out, axis=1)
    good &= np.isfinite(norms) & (norms > 0)
    out[good] /= norms[good][:, None]
    return out, good


def build(rows: DataFrame, checkpoint, cells: int = 64, sample: int = 4096, vector_col: str = "embedding") -> Index:
    """An index of all rows that have a vector. Its centres come from at most `sample` vectors; a radius for each cell reaches the driver."""
    import numpy as np

    centres = centres_of(rows, cells, sample, vector_col)
    columns = [c for c in rows.columns if c != vector_col]
    source = rows.select(*columns, F.col(vector_col).cast("array<double>").alias("__vector"))
    schema = T.StructType([*[source.schema[c] for c in columns], T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            unit, good = unit_batch(batch.column(len(columns)), centres.shape[1])
            near = unit @ centres.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            kept = pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(list(unit), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(angle)], names=schema.names)
            yield kept.filter(pa.array(good))

    placed = checkpoint(source.mapInArrow(place, schema))
    radii, counts = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # one for each cell
        radii[r.cell], counts[r.cell] = r.radius, r.n
    return Index(placed, centres, radii, counts, columns)


def matrix(column, width: int):
    """The unit vectors of an index as an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def met(a, b, least):
    """Rows and columns at which the rounded products of two arrays of unit vectors reach a bound (or one for each row of a), and the products."""
    import numpy as np

    products = a @ b.T
    row, column = np.nonzero(products >= np.asarray(least).reshape(-1, 1) - 10.0**-DIGITS)
    score = np.round(products[row, column], DIGITS)
    good = score >= np.broadcast_to(least, len(a))[row]
    return row[good], column[good], score[good]


def stretches(batches, keys: int):
    """(key, role, part) for each stretch of a batch's rows with equal first columns: so many of the key, then the role."""
    for batch in batches:
        marks = list(zip(*(batch.column(i).to_pylist() for i in range(keys + 1)), strict=True))
        start = 0
        for i in range(1, len(marks) + 1):
            if i == len(marks) or marks[i] != marks[start]:
                yield marks[start][:-1], marks[start][-1], batch.slice(start, i - start)
                start = i


def probes(rows: DataFrame, index: Index, keep: list[str], reach) -> DataFrame:
    """The rows' kept columns, unit vector, and a row for each cell that reach(angles to the centres, batch) takes, with the angle to its centre."""
    import numpy as np

    schema = T.StructType([*[rows.schema[c] for c in keep], rows.schema["unit"], T.StructField("cell", T.IntegerType()), T.StructField("to_centre", T.DoubleType())])
    source = rows.select(*keep, "unit", *[c for c in rows.columns if c not in keep and c != "unit"])
    centres = index.centres

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = matrix(batch.column(len(keep)), centres.shape[1])
            angles = np.arccos(np.clip(unit @ centres.T, -1, 1))
            row, cell = np.nonzero(reach(angles, batch))
            taken = pa.RecordBatch.from_arrays(batch.columns[: len(keep) + 1], names=schema.names[: len(keep) + 1]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(angles[row, cell])], names=schema.names)

    return source.mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.round(F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v), DIGITS)


def similar(index: Index, threshold: float, group: list[str], id_col: str = "id") -> DataFrame:
    """group, a, b, score: all pairs of a group with ids a < b whose cosine reaches the threshold."""
    import numpy as np

    wide, radii = float(np.arccos(min(1.0, threshold - 10.0**-DIGITS))) + SLACK, index.radii

    def reach(angles, batch):
        # a row of a cell is within its radius of the centre, and no further from it than from its partner's centre and back
        own = batch.column(batch.schema.get_field_index("angle")).to_numpy()
        return (angles <= radii + wide) & (angles <= own[:, None] + 2 * wide)

    home = index.rows.select(*group, F.col(id_col).alias("a"), F.col("unit").alias("unit_a"), "cell", "angle")
    asked = probes(index.rows, index, [*group, id_col], reach).withColumnRenamed(id_col, "b").withColumnRenamed("unit", "unit_b")
    met = home.join(asked, [*group, "cell"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("angle") - F.col("to_centre")) <= wide))
    return met.withColumn("score", dot(F.col("unit_a"), F.col("unit_b"))).filter(F.col("score") >= threshold).select(*group, "a", "b", "score")


def merged(label, a, b):
    """Labels (of each place the least one tied to it so far) after pairs of places are tied together."""
    import numpy as np

    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, further := label[label]):
            label = further


def tied(index: Index, threshold: float, group: list[str], id_col: str = "id") -> DataFrame:
    """a, b: links that connect what all pairs of a group whose cosine reaches the threshold connect, and nothing else.

    A group's cells are dealt to blocks. A row is sent to those blocks after its own that hold a cell it can reach; a block gives one
    link for each row of its own that is not the first of what it is tied to, and one for a row sent to it and each such first that it is near to: that
    many at most, however dense the pairs are.
    """
    import numpy as np

    wide, radii, cells, width = float(np.arccos(min(1.0, threshold - 10.0**-DIGITS))) + SLACK, index.radii, len(index.centres), index.centres.shape[1]
    centres, n = index.centres, len(group)
    sizes = index.rows.groupBy(*group, "cell").agg(F.count("*").alias("n")).groupBy(*group).agg(F.sum("n").alias("n"), F.ceil(F.max("n") / BLOCK).alias("pieces"))
    sizes = sizes.select(*group, "pieces", F.least(F.lit(cells), F.greatest(F.lit(1), F.ceil(F.col("n") / (BLOCK * F.col("pieces"))))).cast("long").alias("packs"))
    rows = index.rows.join(sizes, group).select(*group, F.col(id_col).alias("id"), "unit", "cell", "angle", "packs", "pieces", F.pmod(F.xxhash64(id_col), "pieces").alias("piece"))
    fields = [rows.schema[c] for c in group] + [T.StructField("block", T.LongType()), T.StructField("role", T.IntegerType()), rows.schema["id"], rows.schema["unit"]]

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            unit, (cell, angle, packs, pieces, piece) = matrix(batch.column(n + 1), width), (batch.column(n + k).to_numpy() for k in range(2, 7))
            home = cell % packs + packs * piece
            at, to = [np.arange(len(home))], [home]
            many = np.flatnonzero(packs * pieces > 1)
            if len(many):
                angles = np.arccos(np.clip(unit[many] @ centres.T, -1, 1))
                reached = (angles <= radii + wide) & (angles <= angle[many, None] + 2 * wide)
                for i, near in zip(many.tolist(), reached, strict=True):
                    found = np.add.outer(packs[i] * np.arange(pieces[i]), np.unique(np.flatnonzero(near) % packs[i])).ravel()
                    found = found[found > home[i]]
                    at.append(np.full(len(found), i))
                    to.append(found)
            row = np.concatenate(at)
            role = (np.arange(len(row)) >= len(home)).astype(np.int32)
            for k in range(0, len(row), 10_000):
                taken = batch.take(pa.array(row[k : k + 10_000]))
                yield pa.RecordBatch.from_arrays([*taken.columns[:n], pa.array(np.concatenate(to)[k : k + 10_000], pa.int64()), pa.array(role[k : k + 10_000]), taken.column(n), taken.column(n + 1)], names=[f.name for f in fields])

    dealt = rows.mapInArrow(deal, T.StructType(fields)).repartition(*group, "block").sortWithinPartitions(*group, "block", "role")
    kind = rows.schema["id"].dataType

    def run(batches):
        import pyarrow as pa

        key, ids, parts, label, unit = None, [], [], None, None

        def links(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, id_type), pa.array(b, id_type)], names=["a", "b"])

        def closed():
            """The block's labels and the links among its own rows."""
            unit, label = np.concatenate(parts), np.arange(len(ids))
            for at in range(0, len(ids), STEP):
                a, b, _ = met(unit[at : at + STEP], unit[at:], threshold)
                label = merged(label, a + at, b + at)
            other = np.flatnonzero(label != np.arange(len(ids)))
            return unit, label, links([ids[i] for i in other], [ids[i] for i in label[other]])

        id_type = None
        for own, role, part in stretches(batches, n + 1):
            id_type = part.column(n + 2).type
            if own != key:
                if parts and label is None:
                    yield closed()[2]
                key, ids, parts, label = own, [], [], None
            if role == 0:
                ids += part.column(n + 2).to_pylist()
                parts.append(matrix(part.column(n + 3), width))
                continue
            if not parts:
                continue
            if label is None:
                unit, label, made = closed()
                yield made
            asked, sent = part.column(n + 2).to_pylist(), matrix(part.column(n + 3), width)
            for at in range(0, len(asked), STEP):
                a, b, _ = met(sent[at : at + STEP], unit, threshold)
                pairs = np.unique(np.stack([a + at, label[b]]), axis=1)
                yield links([asked[i] for i in pairs[0]], [ids[i] for i in pairs[1]])
        if parts and label is None:
            yield closed()[2]

    return dealt.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def nearest(queries: DataFrame, index: Index, k: int, checkpoint, id_col: str = "id", query_col: str = "query", vector_col: str = "embedding") -> DataFrame:
    """query, id, score, rank: the k rows of the greatest cosine for each query (ties: the least id), exactly.

    A first look at a query's own cell gives a bound: the k-th best so far. Only cells that may hold something as near are looked at then; where
    a query has found fewer than k, all are. A row is not its own neighbour.
    """
    import numpy as np

    own = build_units(queries.select(F.col(query_col).alias("query"), F.col(vector_col).alias("embedding")), index)
    shares = F.element_at(F.array(*[F.lit(max(1, -(-int(x) // BLOCK))) for x in index.counts]), F.col("cell") + 1)
    rows = index.rows.select("cell", F.pmod(F.xxhash64(id_col), shares).cast("int").alias("share"), F.lit(0).alias("role"), F.col(id_col).alias("id"), "unit")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    filled, width = np.isfinite(index.radii), index.centres.shape[1]
    schema = T.StructType([own.schema["query"], rows.schema["id"], T.StructField("score", T.DoubleType())])

    def within(batches):
        """The k best of a block for each query that is sent to it, or those that reach its bound."""
        import pyarrow as pa

        key, ids, parts, unit, place = None, [], [], None, None
        for block, role, part in stretches(batches, 2):
            if block != key:
                key, ids, parts, unit = block, [], [], None
            if role == 0:
                ids += part.column(3).to_pylist()
                parts.append(matrix(part.column(4), width))
                continue
            if not parts:
                continue
            if unit is None:
                unit, place = np.concatenate(parts), np.empty(len(ids), np.int64)
                place[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
            for at in range(0, part.num_rows, STEP):
                own = part.slice(at, STEP)
                asked, sent = own.column(5).to_pylist(), matrix(own.column(4), width)
                least = np.array([-2.0 if x is None else x for x in own.column(6).to_pylist()])
                free = np.flatnonzero(least < -1)
                if len(free) and len(ids) > k + 1:  # one more, as a row may be the query itself
                    least[free] = np.round(np.partition(sent[free] @ unit.T, -k - 1, axis=1)[:, -k - 1], DIGITS)
                a, b, score = met(sent, unit, least)
                other = np.array([asked[i] != ids[j] for i, j in zip(a, b, strict=True)], bool)  # a row is not its own neighbour
                a, b, score = a[other], b[other], score[other]
                best = np.lexsort((place[b], -score, a))
                a, b, score = a[best], b[best], score[best]
                kept = np.arange(len(a)) - np.searchsorted(a, a) < k
                yield pa.RecordBatch.from_arrays([pa.array([asked[i] for i in a[kept]], own.column(5).type), pa.array([ids[j] for j in b[kept]], own.column(3).type), pa.array(score[kept])], names=schema.names)

    def best(asked: DataFrame) -> DataFrame:
        sent = asked.select("cell", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(1).alias("role"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "unit", "query", "bound")
        blank = rows.select("*", F.lit(None).cast(own.schema["query"].dataType).alias("query"), F.lit(None).cast("double").alias("bound"))
        dealt = blank.unionByName(sent).repartition("cell", "share").sortWithinPartitions("cell", "share", "role")
        return dealt.mapInArrow(within, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def nearest_cell(angles, batch):
        return np.eye(len(filled), dtype=bool)[np.where(filled, angles, np.inf).argmin(axis=1)]

    first = checkpoint(best(probes(own, index, ["query"], nearest_cell).withColumn("bound", F.lit(None).cast("double"))))
    bound = first.filter(F.col("rank") == k).select("query", F.col("score").alias("bound"))
    radii = index.radii

    def rest(angles, batch):
        bounds = np.array([-1.0 if x is None else x for x in batch.column(batch.schema.get_field_index("bound")).to_pylist()])
        wide = np.arccos(np.clip(bounds - 10.0**-DIGITS, -1, 1))[:, None] + SLACK
        return filled & ~nearest_cell(angles, batch) & (angles - radii <= wide)

    more = best(probes(own.join(bound, "query", "left"), index, ["query", "bound"], rest))
    both = first.unionByName(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return both.select("query", "id", "score", "rank")


def build_units(rows: DataFrame, index: Index) -> DataFrame:
    """query, unit of rows (query, embedding) that have a vector of the index's width."""
    schema = T.StructType([rows.schema["query"], T.StructField("unit", T.ArrayType(T.DoubleType()))])
    width = index.centres.shape[1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            unit, good = unit_batch(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(unit), pa.list_(pa.float64()))], names=schema.names).filter(pa.array(good))

    return rows.select("query", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, schema)
