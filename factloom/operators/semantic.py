"""Second pass of truth maintenance: claims that the first pass left alone retire the nearest earlier claim in meaning.

Only pairs of vectors that reach the threshold matter, and an index finds what they connect: families of near-equal
statements; order decides within such a family, so each is folded by itself, streamed in the order of time. Equal vectors are one member of the family,
however often they come: a task holds what a family still holds of claims and their vectors, never all pairs or a whole session.
Sessions of at most SMALL rows need no index and no families: they are dealt whole, and all pairs of a session are looked at in the order of how far they are apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph, vectors

THRESHOLD = 0.88
CONTEXT_CHARS = 160
REPLACES = "semantic_replace"
#: What is folded in order of time: ends by the first pass and claims.
END, CLAIM = 1, 2
#: Claims and ends taken up at once, and products held at once.
EVENTS, ENTRIES = 256, 1 << 22
#: Rows of a session that is looked at whole, and different vectors of a batch whose products are taken all at once.
SMALL, KINDS = 512, 1024


def identity_text(subject: Column, predicate: Column, context: Column) -> Column:
    """What a claim is about, without its value: subject, predicate and the start of the turn it was read from."""
    said = F.substring(F.replace(F.trim(F.coalesce(context, F.lit(""))), F.lit("\n"), F.lit(" ")), 1, CONTEXT_CHARS)
    return F.concat(subject, F.lit(" "), predicate, F.lit(" "), said)


def statements(claims: DataFrame, turns: DataFrame) -> DataFrame:
    """Claims (session_id, subject, predicate, claim_id, text, source_turn_id, created_ts) as what the second pass compares: a row in their predicate's
    group with their identity, and, in sessions with claims without predicate, a row in the session's group with their text; those without predicate look there."""
    said = turns.select(F.col("turn_id").alias("source_turn_id"), F.col("text").alias("turn_text"))
    rows = claims.join(said, "source_turn_id", "left").withColumn("plain", F.coalesce("predicate", F.lit("")) == "")
    ids = ["session_id", "claim_id", "source_turn_id", "created_ts"]
    typed = rows.filter("not plain").select(*ids, F.concat(F.lit("p:"), "predicate").alias("space"), identity_text(F.col("subject"), F.col("predicate"), F.col("turn_text")).alias("said"), F.lit(True).alias("seeks"))
    loose = rows.filter("plain").select("session_id").distinct()
    free = rows.join(loose, "session_id", "left_semi").select(*ids, F.lit("text").alias("space"), F.coalesce(F.nullif("text", F.lit("")), F.col("turn_text"), F.lit("")).alias("said"), F.col("plain").alias("seeks"))
    return typed.unionByName(free)


def families(rows: DataFrame, checkpoint, threshold: float, cells: int, sample: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their member (rows of equal vectors of a session and space), unit vectors of members, and the family (member, family) of all that can be retired.

    Families need no more links than connect them; a fold finds the scores that it asks for by itself."""
    member = F.xxhash64("session_id", "space", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x, 7)))
    rows = checkpoint(rows.withColumn("member", member))
    kinds = rows.groupBy("session_id", "space", "member").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"))
    index = vectors.build(kinds, checkpoint, cells, sample)
    links = vectors.tied(index, threshold, ["session_id", "space"], "member")
    # a claim in two spaces ties its two members together
    both = rows.groupBy("session_id", "claim_id").agg(F.min("member").alias("a"), F.max("member").alias("b")).filter("a != b").select("a", "b").distinct()
    found = graph.components(links.unionByName(both), checkpoint).select(F.col("node").alias("member"), F.col("root").alias("family"))
    lone = index.rows.filter("n > 1").select("member").join(found, "member", "left_anti").select("member", F.col("member").alias("family"))
    return rows, index.rows.select("member", "unit"), checkpoint(found.unionByName(lone))


class Vectors:
    """Unit vectors of a space's held members, as a matrix that grows and is filled from its end where one leaves."""

    def __init__(self, width: int):
        import numpy as np

        self.data, self.members, self.at = np.empty((16, width)), [], {}

    def add(self, member: int, unit) -> None:
        import numpy as np

        if member not in self.at:
            if len(self.members) == len(self.data):
                self.data = np.concatenate((self.data, np.empty_like(self.data)))
            self.data[len(self.members)] = unit
            self.at[member] = len(self.members)
            self.members.append(member)

    def drop(self, member: int) -> None:
        k, last = self.at.pop(member), self.members.pop()
        if last != member:
            self.data[k] = self.data[len(self.members)]
            self.members[k], self.at[last] = last, k


class Held:
    """What a family holds, as far as it may still be retired. Claims are taken up in blocks: the scores of a block's members with all that is held are one matrix product."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.links: dict[int, list[tuple[float, int]]] = {}  # of the block's members that seek, best first
        self.stacks: dict[int, list[tuple]] = {}  # by member, oldest first: (ts, id, turn)
        self.alive: dict[str, list[int]] = {}  # members of each held claim
        self.counts: dict[int, int] = {}  # held claims of each member
        self.spaces: dict[str, Vectors] = {}

    def best(self, member: int, turn: str) -> tuple[float, tuple] | None:
        """The held claim of the best score; of equal ones the newest."""
        found: tuple[float, tuple] | None = None
        for score, other in [(1.0, member), *self.links.get(member, ())]:  # best first
            if found and score < found[0]:
                break
            stack = self.stacks.get(other, [])
            while stack and stack[-1][1] not in self.alive:
                stack.pop()
            for claim in reversed(stack):
                if claim[1] in self.alive and claim[2] != turn:
                    if not found or claim[:2] > found[1][:2]:
                        found = (score, claim)
                    break
        return found

    def retire(self, claim: str) -> None:
        for m in self.alive.pop(claim, ()):
            self.counts[m] -= 1

    def take(self, ts: int, claim: str, turn: str, members: list[tuple[int, bool]], free: bool) -> tuple[str, float] | None:
        """Adds a claim; the claim that it retires and their score."""
        asked = [x for m, seeks in members if seeks and free for x in [self.best(m, turn)] if x]
        out = None
        if asked:
            score, old = max(asked, key=lambda x: (x[0], x[1][:2]))
            self.retire(old[1])
            out = (old[1], score)
        for m, _ in members:
            self.stacks.setdefault(m, []).append((ts, claim, turn))
            self.counts[m] = self.counts.get(m, 0) + 1
        self.alive[claim] = [m for m, _ in members]
        return out

    def block(self, events: list[tuple]) -> list[tuple]:
        """(session, old, new, score, ts) of claims (ts, id, session, turn, [(member, seeks, space, unit)], free) and ends (id of a claim), in order."""
        import numpy as np

        seen: dict[str, dict[int, object]] = {}
        seeking: dict[str, set[int]] = {}
        for event in events:
            if len(event) > 1:
                for m, seeks, space, unit in event[4]:
                    seen.setdefault(space, {})[m] = unit
                    if seeks and event[5]:
                        seeking.setdefault(space, set()).add(m)
        for space, own in seen.items():
            held = self.spaces.setdefault(space, Vectors(len(next(iter(own.values())))))
            for m, unit in own.items():
                held.add(m, unit)
            asked = sorted(seeking.get(space, ()))
            if len(held.members) > 1:
                step = max(1, ENTRIES // len(held.members))
                for at in range(0, len(asked), step):
                    part = asked[at : at + step]
                    row, column, score = vectors.met(held.data[[held.at[m] for m in part]], held.data[: len(held.members)], self.threshold)
                    order = np.lexsort((-score, row))
                    for i, j, s in zip(row[order].tolist(), column[order].tolist(), score[order].tolist(), strict=True):
                        if held.members[j] != part[i]:
                            self.links.setdefault(part[i], []).append((s, held.members[j]))
        out = []
        for event in events:
            if len(event) == 1:
                self.retire(event[0])
                continue
            ts, claim, session, turn, members, free = event
            found = self.take(ts, claim, turn, [(m, seeks) for m, seeks, _, _ in members], free)
            if found:
                out.append((session, found[0], claim, found[1], ts))
        self.links.clear()
        for space, held in self.spaces.items():
            for m in [m for m in held.members if not self.counts[m]] if len(held.members) > 2 * len(self.alive) or space in seen else []:
                held.drop(m)
                del self.stacks[m], self.counts[m]
        return out


def fold(rows, threshold: float = THRESHOLD):
    """(session, old, new, score, ts) of a stream of (family, kind, ts, id, session, turn, member, seeks, free, target, space, unit), families together, each in order."""
    family, held, events = None, Held(threshold), []
    for own, kind, ts, claim, session, turn, member, seeks, free, target, space, unit in rows:
        if own != family:
            yield from held.block(events)
            family, held, events = own, Held(threshold), []
        more = kind == CLAIM and events and len(events[-1]) > 1 and events[-1][1] == claim
        if len(events) >= EVENTS and not more:
            yield from held.block(events)
            events = []
        if kind == END:
            events.append((target,))
        elif more:
            events[-1][4].append((member, seeks, space, unit))
        else:
            events.append((ts, claim, session, turn, [(member, seeks, space, unit)], free))
    yield from held.block(events)


def second_pass(rows: DataFrame, edges: DataFrame, embed: Callable[[str], Column] | None, checkpoint, threshold: float = THRESHOLD, cells: int = 64, sample: int = 4096) -> DataFrame:
    """Edges (session_id, old_claim_id, new_claim_id, edge_type, identity_score, created_ts) of claims that the first pass (edges) gave none.

    rows: what statements() gives, with an embedding or an embedder for what is said. A claim looks at earlier ones of its session and space that are still held and come from other turns,
    and retires the best if the cosine reaches the threshold. What the first pass retired is gone from then on. The first pass comes first for the whole log.
    """
    plain = ["session_id", "space", "claim_id", "source_turn_id", "created_ts", "seeks"]
    large = checkpoint(rows.groupBy("session_id").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("session_id"))
    some = not large.isEmpty()
    if some:
        edges = checkpoint(edges)  # read by both
    said = checkpoint(rows.select("said").distinct().withColumn("embedding", embed("said"))) if embed else rows  # equal statements are embedded once
    width = said.agg(F.max(F.size("embedding"))).first()[0] or 0

    def embedded(x: DataFrame) -> DataFrame:
        return x.join(said, "said").drop("said") if embed else x

    rows = rows.select(*plain, "said" if embed else "embedding")
    made = within_sessions(rows.join(large, "session_id", "left_anti") if some else rows, edges, embedded, width, threshold)
    return made.unionByName(by_families(embedded(rows.join(large, "session_id", "left_semi")), edges, checkpoint, threshold, cells, sample)) if some else made


def met_in_sessions(batch, width: int, threshold: float):
    """(old row, new row, score) of a batch of whole sessions in order of time: pairs of claims of one space and unlike turns that reach the threshold, for new rows that
    seek; by new claim, the best first and of equal ones the newest. And each row's session's first row, and its claim's number."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    row = np.arange(n)

    def changes(name: str):
        return np.concatenate(([True], pc.fill_null(pc.not_equal(batch[name][1:], batch[name][:-1]), True).to_numpy(zero_copy_only=False)))

    def codes(name: str):
        return pc.fill_null(batch[name].dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)

    begins = changes("session_id")
    first = np.maximum.accumulate(np.where(begins, row, 0))
    claim = np.cumsum(begins | changes("claim_id")) - 1
    turn, space = codes("source_turn_id"), codes("space")
    _, at, kind = np.unique(batch["kind"].to_numpy(), return_index=True, return_inverse=True)
    unit, good = vectors.unit_batch(batch["embedding"].take(at), width)
    products = unit @ unit.T if len(unit) <= KINDS else None
    asks = row[(batch["seeks"].to_numpy(zero_copy_only=False) & batch["free"].to_numpy(zero_copy_only=False)) & good[kind]]
    found = []
    apart = 1
    while len(asks := asks[asks - apart >= first[asks]]):
        old = asks - apart
        fits = (space[old] == space[asks]) & (turn[old] != turn[asks]) & (claim[old] != claim[asks]) & good[kind[old]]
        new, old = asks[fits], old[fits]
        a, b = kind[new], kind[old]
        score = np.round(products[a, b] if products is not None else np.einsum("ij,ij->i", unit[a], unit[b]), vectors.DIGITS)
        near = score >= threshold
        found.append((old[near], new[near], score[near]))
        apart += 1
    old, new, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (row[:0], row[:0], np.zeros(0))
    by = np.lexsort((-claim[old], -score, claim[new]))
    return old[by], new[by], score[by], first, claim


def fold_sessions(batch, width: int, threshold: float) -> list[tuple]:
    """(session, old, new, score, ts) of a batch of whole sessions in order of time: each claim that seeks retires the best of those still held."""
    import numpy as np
    import pyarrow as pa

    old, new, score, first, claim = met_in_sessions(batch, width, threshold)
    ids, ts, end_ts, end_id = (batch[c] for c in ("claim_id", "created_ts", "end_ts", "end_id"))
    session = batch["session_id"]
    # rows of one id that are several claims leave together
    lead = np.flatnonzero(np.concatenate(([True], claim[1:] != claim[:-1])))
    code = pa.compute.fill_null(ids.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    _, one = np.unique(np.stack([first[lead], code[lead]]), axis=1, return_inverse=True) if len(lead) else (None, lead)
    one = one.ravel()
    twins: dict[int, list[int]] = {}
    for c in np.flatnonzero(np.bincount(one)[one] > 1).tolist() if len(one) else ():
        twins.setdefault(int(one[c]), []).append(c)
    ends = np.flatnonzero(end_id.is_valid().to_numpy(zero_copy_only=False))
    gone = dict(zip(claim[ends].tolist(), zip(end_ts.take(pa.array(ends)).to_pylist(), end_id.take(pa.array(ends)).to_pylist(), strict=True), strict=True))
    dead, out, done = set(), [], -1
    for i, j, s, a, b in zip(old.tolist(), new.tolist(), score.tolist(), claim[old].tolist(), claim[new].tolist(), strict=True):
        if b == done or a in dead:
            continue
        if a in gone and (ts[j].as_py(), ids[j].as_py()) >= gone[a]:
            continue
        dead.update(x for x in twins.get(int(one[a]), (a,)) if x < b)
        done = b
        out.append((i, j, s))
    if not out:
        return []
    i, j, s = zip(*out, strict=True)
    i, j = pa.array(i), pa.array(j)
    return list(zip(session.take(j).to_pylist(), ids.take(i).to_pylist(), ids.take(j).to_pylist(), s, ts.take(j).to_pylist(), strict=True))


EDGES = "session_id string, old_claim_id string, new_claim_id string, edge_type string, identity_score double, created_ts long"


def edge_batch(made: list[tuple]):
    import pyarrow as pa

    session, old, new, score, ts = map(list, zip(*made, strict=True))
    arrays = [pa.array(session, pa.string()), pa.array(old, pa.string()), pa.array(new, pa.string()), pa.array([REPLACES] * len(old), pa.string()), pa.array(score, pa.float64()), pa.array(ts, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["session_id", "old_claim_id", "new_claim_id", "edge_type", "identity_score", "created_ts"])


def within_sessions(rows: DataFrame, edges: DataFrame, embedded: Callable[[DataFrame], DataFrame], width: int, threshold: float) -> DataFrame:
    """`second_pass` for sessions of which a task can hold some whole. Their claims come with the first end after them that the first pass gives."""
    answered = edges.select(F.col("new_claim_id").alias("claim_id"), F.lit(True).alias("answered"), F.lit(None).cast("struct<at: bigint, by: string>").alias("end"))
    retired = edges.filter(~F.col("edge_type").isin("blocked", "contradicts"))
    retired = retired.select(F.col("old_claim_id").alias("claim_id"), F.lit(None).cast("boolean").alias("answered"), F.struct(F.col("created_ts").alias("at"), F.col("new_claim_id").alias("by")).alias("end"))
    marks = answered.unionByName(retired).groupBy("claim_id").agg(F.max("answered").alias("answered"), F.collect_set("end").alias("ends"))
    own = F.struct(F.col("created_ts").alias("at"), F.col("claim_id").alias("by"))
    placed = rows.filter("session_id is not null").join(marks, "claim_id", "left")
    placed = placed.withColumn("end", F.array_min(F.filter("ends", lambda x: x > own))).withColumn("free", F.col("answered").isNull())
    placed = placed.select(*rows.columns, "free", F.col("end.at").alias("end_ts"), F.col("end.by").alias("end_id"))
    placed = embedded(placed).withColumn("kind", F.xxhash64("embedding"))
    dealt = placed.repartition("session_id").sortWithinPartitions("session_id", "created_ts", "claim_id", "space")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch]).combine_chunks().to_batches()[0]
            other = rows_to_last(pc.not_equal(whole["session_id"], whole["session_id"][-1]))
            left = pa.Table.from_batches([whole.slice(other)])
            made = fold_sessions(whole.slice(0, other), width, threshold) if other else []
            if made:
                yield edge_batch(made)
        if left is not None:
            made = fold_sessions(left.combine_chunks().to_batches()[0], width, threshold)
            if made:
                yield edge_batch(made)

    return dealt.mapInArrow(run, EDGES)


def rows_to_last(other) -> int:
    """How many rows there are up to the last that is true."""
    import numpy as np

    at = np.flatnonzero(other.to_numpy(zero_copy_only=False))
    return int(at[-1]) + 1 if len(at) else 0


def by_families(rows: DataFrame, edges: DataFrame, checkpoint, threshold: float, cells: int, sample: int) -> DataFrame:
    """`second_pass` for sessions of any size, by families."""
    rows, units, found = families(rows, checkpoint, threshold, cells, sample)
    answered = edges.select(F.col("new_claim_id").alias("claim_id")).distinct().withColumn("answered", F.lit(True))
    placed = rows.drop("embedding").join(found, "member").join(answered, "claim_id", "left")
    placed = checkpoint(placed.withColumn("free", F.col("answered").isNull()).drop("answered"))
    order = ["family", "kind", "ts", "id", "session", "turn", "member", "seeks", "free", "target", "space", "unit"]
    claims = placed.join(units, "member").select("family", F.lit(CLAIM).alias("kind"), F.col("created_ts").alias("ts"), F.col("claim_id").alias("id"), F.col("session_id").alias("session"), F.col("source_turn_id").alias("turn"), "member", "seeks", "free", "space", "unit")
    claims = claims.withColumn("target", F.lit(None).cast("string"))
    retired = edges.filter(~F.col("edge_type").isin("blocked", "contradicts")).select(F.col("old_claim_id").alias("claim_id"), F.col("new_claim_id").alias("by"), F.col("created_ts").alias("at"))
    ended = placed.select("family", "claim_id").distinct().join(retired, "claim_id")
    ended = ended.select("family", F.lit(END).alias("kind"), F.col("at").alias("ts"), F.col("by").alias("id"), F.col("claim_id").alias("target"))
    ended = ended.withColumns({c: F.lit(None).cast("string") for c in ("session", "turn", "space")} | {"member": F.lit(None).cast("long"), "seeks": F.lit(False), "free": F.lit(False), "unit": F.lit(None).cast("array<double>")})
    stream = claims.select(order).unionByName(ended.select(order))
    dealt = stream.repartition("family").sortWithinPartitions("family", "ts", "id", "kind", "member")

    def run(batches):
        def read():
            for batch in batches:
                for at in range(0, batch.num_rows, EVENTS):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, EVENTS).columns), strict=True)

        made = fold(read(), threshold)
        while True:
            rows_out = [x for _, x in zip(range(10_000), made, strict=False)]
            if not rows_out:
                break
            yield edge_batch(rows_out)

    return dealt.mapInArrow(run, EDGES)


def within_groups(rows: DataFrame, checkpoint, threshold: float = THRESHOLD) -> DataFrame:
    """group, old_id, new_id, score for rows (group string, id long, ts long, turn string, embedding) that no first pass has seen."""
    plain = rows.select(
        F.col("group").alias("session_id"), F.lit("").alias("space"), F.format_string("%020d", "id").alias("claim_id"), F.col("turn").alias("source_turn_id"), F.col("ts").alias("created_ts"), F.lit(True).alias("seeks"), "embedding"
    )
    none = rows.sparkSession.createDataFrame([], "old_claim_id string, new_claim_id string, edge_type string, created_ts long")
    made = second_pass(plain, none, None, checkpoint, threshold)
    return made.select(F.col("session_id").alias("group"), F.col("old_claim_id").cast("long").alias("old_id"), F.col("new_claim_id").cast("long").alias("new_id"), F.col("identity_score").alias("score"))
