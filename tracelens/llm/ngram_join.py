"""Exact Jaccard self-join on word n-grams, by token-combination prefixes, and its components.

A document is the set of its distinct five-word shingles (fewer words: the whole sequence as one; none: empty, linked with
nothing). Two link when 100 * intersection >= threshold * union. Shingles are 64-bit hashes (see wordhash).

1. Equal sets fall together: one representative (least doc_id) stands for each class, so copies are never paired.
2. Every shingle is counted over the representatives. Shingles travel packed, in hash ranges of bounded size, with their
   documents; only those that two documents share come out. One that very many documents share doesn't stay in memory.
3. Shingles are ordered from rare to frequent. With tau = how many of its n shingles a document may lack in a partner, one
   of any tau + 1 must be shared. Shingles that no other document has come first and stand for nothing. Rare ones (in at
   most `rare` documents) are indexed singly. Where those don't suffice the prefix is extended into the frequent class,
   whose members are indexed in combinations of two: with r = tau + 1 - (what came before) and g groups, the first r + g
   frequent shingles of a document hold g + 1 shared ones, so two of them in the same one of g hash groups. g follows the
   set's size (two neighbouring powers of two are indexed), which keeps the combinations in proportion to the text.
4. Documents with a common signature form a list. Twice, each document is compared with the two hubs (a list's member with
   fewest shingles of its own) that it shares most lists with, which joins up most groups of copies.
5. Lists still in several components are decided exactly, in rounds. Where a list has few pairs for its rows (`direct` a row
   at most in the first round, more in later ones up to a fixed bound, so that lists that shrink slowly end in few rounds), they
   are compared by exact intersection. The members of any other list are measured against its hub: with
   D = set xor hub's set, and E = (100 + t) |D| - (100 - t) n, two of them link exactly if 2 (100 + t) |D_x and D_y| >=
   E_x + E_y. So all with E_x + E_z <= 0, z the one of least E, link with z outright; any other link needs shared members of D,
   in number known from E, and so lists are formed anew over prefixes of D, of the same rare-to-frequent order: pairs across
   z's component and the rest, pairs within the rest, and pairs far from the hub. A hub leaves its lists and hubs only grow in
   order, so this ends. Copies of one text share next to nothing of their D, however many they are: rows follow documents.

Null or empty text has n_shingles 0 and is its own component. Rows without doc_id are left out; equal rows keep
one row each. Very long texts are held one at a time. Ties go to the least doc_id. An empty table gives an empty one. doc_id
may be of any integer type and comes out as long. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import compact, cut, drop, slices, total, trim
from .components import components
from .wordhash import U, gram_starts, mix, runs, short_runs, words

#: Shingles that a hash range holds, on average; the most documents in which a shingle counts as rare; documents from which on a
#: shingle of a range too large for memory is frequent without being counted further.
RANGE_SHINGLES, RARE, HOT = 1 << 20, 32, 1 << 12
#: Pairs for each row of a list up to which they are compared directly: in the first round, times how much from round to round, at most.
DIRECT, DIRECT_GROWTH, DIRECT_MOST = 32, 4, 1 << 10
HOT_COUNT = (1 << 31) - 1
#: Copies of other documents' sets up to which their ids are broadcast.
COPIES = 1_000_000
#: A row with a set counts as so many when files are dealt out.
WIDE = 8
SHARED = "array<struct<df:int,token:long>>"


def shingle_sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and how many each row has."""
    w = words(part.column("text"), lower=True)
    n, at = np.diff(w.first), gram_starts(w.first, k)
    short = np.flatnonzero((n > 0) & (n < k))
    hashes = np.concatenate([runs(w.hash, k)[at], short_runs(w, short, k - 1)])
    doc = np.concatenate([w.doc[at], short])
    order = np.argsort(hashes)
    order = order[np.argsort(doc[order], kind="stable")]
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(part))


def _classes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                h, n = shingle_sets(part, k)
                at = np.concatenate([[0], np.cumsum(n)])
                sums = []
                for salt in (U(0), U(0x2545F4914F6CDD1D)):
                    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h + salt), dtype=U)])
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                sums[0] = np.where(n == 0, ids, sums[0])  # empty sets are in no class together
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "n_shingles", "h1", "h2"])

    return run


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of each number, byte plane by byte plane: sorted or small numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view(U)


def _packed(k: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                h, n = shingle_sets(part, k)
                ids = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), n)
                order = np.argsort(h, kind="stable")
                h, ids = h[order], ids[order]
                where = ((h >> U(32)) * U(ranges)) >> U(32)
                cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    base = int(ids[a:b].min())
                    offset = (ids[a:b] - base).astype(np.int64).view(U)
                    width = max(1, (int(offset.max()).bit_length() + 7) // 8)
                    rows.append((int(where[a]), b - a, base, width, _planes(h[a:b], 8) + _planes(offset, width)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["range", "n", "base", "width", "payload"])

    return run


class _Range:
    """Counts one range's shingles. Beyond `limit` entries, those with `hot` documents or more so far are given out as
    frequent and no longer held, so what is held follows the different shingles, not the documents of one of them."""

    def __init__(self, limit: int, hot: int):
        self.limit, self.hot = limit, hot
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.most, self.frequent = 0, limit, np.zeros(0, U)

    def add(self, n: int, base: int, width: int, payload: bytes) -> Iterator[pa.RecordBatch]:
        self.held.append((_from_planes(payload, n, 8), _from_planes(memoryview(payload)[8 * n :], n, width).view(np.int64) + base))
        self.size += n
        if self.size > self.most:
            yield self.settle(False)
            self.most = max(self.limit, 2 * self.size)

    def settle(self, last: bool) -> pa.RecordBatch:
        token, doc = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(starts, len(token)))
        frequent = np.isin(token[starts], self.frequent)
        if not last:
            frequent |= count >= self.hot
            self.frequent = np.union1d(self.frequent, token[starts[frequent]])
        df = np.repeat(np.where(frequent, HOT_COUNT, count if last else 0), count)
        out = df > 1
        self.held = [] if last else [(token[~out], doc[~out])]
        self.size = 0 if last else int((~out).sum())
        return pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(df[out].astype(np.int32)), pa.array(token[out].view(np.int64))], ["doc_id", "df", "token"])


def _shared(limit: int, hot: int):
    """Rows come sorted by range; of one range at a time: the shingles that two documents or more have, with each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if held:
                        yield held.settle(True)
                        trim()
                    held, now = _Range(limit, hot), key
                yield from held.add(*row)
        if held:
            yield held.settle(True)
        held = None
        trim()

    return run


def groups_of(n: int) -> tuple[int, int]:
    """The two group counts under which a set of n shingles indexes its combinations; sets that can link share one."""
    size = n.bit_length()
    return max(1, (1 << size) // 16), max(1, (1 << (size + 1)) // 16)


def signatures(n: int, df: np.ndarray, token: np.ndarray, threshold: int, rare: int) -> np.ndarray:
    """Signatures of a set of n shingles, of which the given ones are shared with other documents; they ascend by (df, token)."""
    tau = n - (n * threshold + 99) // 100
    need = tau + 1 - (n - len(token))
    if need <= 0:
        return np.zeros(0, U)
    token = token.view(U)
    split = int(np.searchsorted(df, rare, "right"))
    single = token[:split][:need]
    need -= len(single)
    out = [mix(single)]
    common = token[split:]
    for g in sorted(set(groups_of(n))) if need > 0 and len(common) else ():
        prefix = common[: need + g]
        group = mix(prefix + U(7)) % U(g)
        for of in np.unique(group):
            mine = np.sort(prefix[group == of])
            if len(mine) > 1:
                a, b = np.triu_indices(len(mine), 1)
                out.append(mix(mix(mine[a]) + mine[b] * U(3) + U(g)))
    return np.unique(np.concatenate(out))


SKETCH = ("k0", "k1", "k2", "k3")


def sketch(token: np.ndarray) -> np.ndarray:
    """256 parity bits of a set: two sets' sketches differ in no more bits than the sets differ in members."""
    at = mix(token.view(U) + U(11)) >> U(56)
    bits = U(1) << (at & U(63))
    return np.array([np.bitwise_xor.reduce(bits[(at >> U(6)) == U(w)], initial=U(0)) for w in range(4)], dtype=U)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """df and token of a column of SHARED, end to end, and where each row's begin, with the end of the last."""
    at = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = column.flatten()
    return flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False), at


def _signed(threshold: int, rare: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df, token, at = _lists(batch.column("shared"))
            size, sizes = np.diff(at), batch.column("n_shingles").to_pylist()
            sigs = [signatures(n, df[at[i] : at[i + 1]], token[at[i] : at[i + 1]], threshold, rare) for i, n in enumerate(sizes)]
            each = [len(x) for x in sigs]
            kept = np.array([sketch(token[at[i] : at[i + 1]]) if each[i] else np.zeros(4, U) for i in range(len(sizes))], dtype=U).reshape(-1, 4).view(np.int64)
            n = np.array(sizes, dtype=np.int64)
            columns = {"doc_id": batch.column("doc_id").to_numpy(zero_copy_only=False), "n": n, "alone": n - size} | {c: np.ascontiguousarray(kept[:, j]) for j, c in enumerate(SKETCH)}
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sigs, np.zeros(0, U)]).view(np.int64)), *[pa.array(np.repeat(c, each)) for c in columns.values()]], ["sig", *columns])
        trim()

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs(a, b, ...), those that link."""
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("shared.token").alias(f"t_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("t_a", "t_b")))
    return both.where(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * threshold).drop("n_a", "n_b", "t_a", "t_b", "common")


#: What a row of a list carries about its document.
ABOUT = ("n", "alone", *SKETCH)


def _fit(threshold: int, x, y) -> Column:
    """Whether two documents can link: by size, and by how many members their sets differ in at least (those that only one
    document has, and the sketches' differing bits). x and y give a column of either by its name."""
    size = F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * threshold
    apart = x("alone") + y("alone")
    for c in SKETCH:
        apart = apart + F.bit_count(x(c).bitwiseXOR(y(c)))
    return size & (apart * (100 + threshold) <= (x("n") + y("n")) * (100 - threshold))


def _proposals(label: DataFrame, threshold: int, partners: int = 2) -> DataFrame:
    """a, b, of_a, of_b: for each document the partners in other components with which it shares most lists, among the lists'
    hubs. In number these pairs follow the documents, not the lists."""
    hubs = label.groupBy("sig").agg(F.min(F.struct("alone", "doc_id", "n", *SKETCH, "of")).alias("hub"))
    near = label.join(hubs, "sig").where((F.col("of") != F.col("hub.of")) & _fit(threshold, F.col, lambda c: F.col(f"hub.{c}")))
    near = near.groupBy(F.col("doc_id").alias("a"), F.col("of").alias("of_a"), F.col("hub.doc_id").alias("b"), F.col("hub.of").alias("of_b")).agg(F.count("*").alias("lists"))
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("lists"), "b"))).where(F.col("r") <= partners)
    return best.select("a", "b", "of_a", "of_b")


def _joined(found: DataFrame | None, links: DataFrame, most: int) -> DataFrame:
    """found (node, component) with the components that the links join up as single nodes, so the graph shrinks from round to round.
    most: documents in lists, so as many nodes at most; links are not more than a few for each."""
    step = components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), most)
    if found is None:
        return cut(step, most)
    moved = found.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = cut(moved.union(step.join(found, "node", "left_anti").select("node", "component")), most)
    drop(found)
    return out


def _renamed(df: DataFrame, found: DataFrame, column: str = "of") -> DataFrame:
    """df with the components as they are now."""
    now = found.select(F.col("node").alias(column), F.col("component").alias("component_now"))
    return df.join(now, column, "left").withColumn(column, F.coalesce("component_now", column)).drop("component_now")


def _open(label: DataFrame, direct: int) -> tuple[DataFrame, int, int]:
    """The rows of lists with a pair across components that is not decided, with the list's hub (null: few pairs), written,
    and how many are of lists with few pairs and of others. Lists with sides have pairs of one side with the other."""
    lists = label.groupBy("sig").agg(
        F.count("*").alias("rows"), F.count_if(F.col("side") == 1).alias("one"), F.count_if(F.col("side") == 2).alias("two"),
        F.min("of").alias("x"), F.max("of").alias("y"), F.min(F.struct("alone", "doc_id")).alias("hub"),
    )
    sided = F.col("one") + F.col("two") > 0
    lists = lists.where((F.col("x") != F.col("y")) & (~sided | ((F.col("one") > 0) & (F.col("two") > 0))))
    pairs = F.when(sided, F.col("one") * F.col("two")).otherwise(F.col("rows") * (F.col("rows") - 1) / 2)
    lists = lists.select("sig", F.when(pairs > direct * F.col("rows"), F.col("hub.doc_id")).alias("hub"))
    out = cut(label.join(lists, "sig"), total(label), few=F.count_if(F.col("hub").isNull()), many=F.count_if(F.col("hub").isNotNull()))
    return out, total(out, "few"), total(out, "many")


def _direct(label: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The links among the pairs of the lists that have few."""
    few = label.where("hub is null").drop("hub")
    x, y = few.alias("x"), few.alias("y")
    meets = (F.col("x.side") == 0) & (F.col("x.doc_id") < F.col("y.doc_id")) | (F.col("x.side") == 1) & (F.col("y.side") == 2)
    fit = _fit(threshold, lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"))
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & meets & (F.col("x.of") != F.col("y.of")) & fit)
    # plain columns: of structs, compared in one expression, the JVM's compiler took 444 MB, which an executor kept
    first = F.col("x.doc_id") < F.col("y.doc_id")
    both = [F.when(first, F.col(f"{s}.{c}")).otherwise(F.col(f"{t}.{c}")).alias(name) for s, t, c, name in (("x", "y", "doc_id", "a"), ("y", "x", "doc_id", "b"), ("x", "y", "of", "of_a"), ("y", "x", "of", "of_b"))]
    pairs = pairs.select(*both).distinct()
    return _verified(pairs, sets, threshold).select("of_a", "of_b")


def _measure(threshold: int):
    """Of rows with a document's shared shingles (own) and its hub's (ref): e; place (0 close, 1 between, 2 far); delta, the
    members of own xor ref, those of own first, from rare to frequent, then the others, which fewest lack first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, own, at = _lists(batch.column("own"))
            _, ref, of = _lists(batch.column("ref"))
            es, places, deltas = [], [], []
            for i, (n, alone) in enumerate(zip(batch.column("n").to_pylist(), batch.column("alone").to_pylist(), strict=True)):
                x, r = own[at[i] : at[i + 1]], ref[of[i] : of[i + 1]]
                extra, missing = x[~np.isin(x, r)], r[~np.isin(r, x)]
                d = alone + len(extra) + len(missing)
                es.append((100 + threshold) * d - (100 - threshold) * n)
                # a partner of a close document (2 d <= n) is not beyond the middle: d differs by (100 - t) / (100 + t) of both sizes at most
                places.append(0 if 2 * d <= n else 1 if threshold * d <= (150 - threshold) * n else 2)
                deltas.append(np.concatenate([extra, missing[::-1]]))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in deltas])]).astype(np.int32)
            delta = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*deltas, np.zeros(0, np.int64)]), pa.int64()))
            kept = [c for c in batch.schema.names if c not in ("own", "ref")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(es, pa.int64()), pa.array(places, pa.int32()), delta], [*kept, "e", "place", "delta"])
        trim()

    return run


def _measured(label: DataFrame, sets: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The members of the lists with many pairs, measured against their hubs and written, with z: the one of least e; and the links to it."""
    pairs = label.where("hub is not null").select("hub", "doc_id", *ABOUT, "of").distinct()
    own, ref = sets.select("doc_id", F.col("shared").alias("own")), sets.select(F.col("doc_id").alias("hub"), F.col("shared").alias("ref"))
    both = pairs.join(own, "doc_id").join(ref, "hub")
    kinds = ", ".join(f"{c} long" for c in ("hub", "doc_id", *ABOUT, "of"))
    out = cut(both.select("hub", "doc_id", *ABOUT, "of", "own", "ref").mapInArrow(_measure(threshold), kinds + ", e long, place int, delta array<long>"), WIDE * total(label, "many"))
    least = out.groupBy("hub").agg(F.min(F.struct("e", "doc_id", "of")).alias("z"), F.min(F.when(F.col("place") > 0, F.col("e"))).alias("least_far"))
    out = out.join(least.select("hub", F.col("z.e").alias("z_e"), F.col("z.of").alias("z_of"), "least_far"), "hub")
    return out, out.where("e + z_e <= 0 and of != z_of").select(F.col("of").alias("of_a"), F.col("z_of").alias("of_b")).distinct()


def _refined(measured: DataFrame, threshold: int) -> DataFrame:
    """Lists over prefixes of the deltas: whatever pairs of measured documents are not yet in one component and can link meet there."""
    both = 2 * (100 + threshold)
    need = lambda partner: F.greatest(F.lit(1), F.ceil((F.col("e") + partner) / both))
    other = F.greatest(F.col("z_e"), 1 - F.col("z_e"))  # least e of a document that didn't link with z outright
    inside = F.col("of") == F.col("z_of")
    near = F.col("place") < 2
    families = [
        (near, F.when(inside, 1).otherwise(2), F.when(inside, need(other)).otherwise(need(F.col("z_e")))),
        (near & ~inside, F.lit(0), need(other)),
        (F.col("place") > 0, F.lit(0), need(F.col("least_far"))),
    ]
    parts = [F.when(kept, F.struct(F.lit(i).alias("family"), side.cast("int").alias("side"), (F.size("delta") - least + 1).cast("int").alias("first"))) for i, (kept, side, least) in enumerate(families)]
    rows = measured.select("hub", "doc_id", *ABOUT, "of", "delta", F.explode(F.filter(F.array(*parts), lambda p: p["first"] > 0)).alias("p"))
    rows = rows.select("hub", "doc_id", *ABOUT, "of", "p.family", "p.side", F.explode(F.slice("delta", F.lit(1), F.col("p.first"))).alias("token"))
    return rows.select(F.xxhash64("hub", "family", "token").alias("sig"), "doc_id", "side", *ABOUT, "of")


def link_components(docs: DataFrame, threshold: int = 75, k: int = 5, rare: int = RARE, direct: int = DIRECT, range_shingles: int = RANGE_SHINGLES, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id with the same set), from docs(doc_id, text)."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = cut(compact(docs.mapInArrow(_classes(k), "doc_id long, n_shingles long, h1 long, h2 long"), docs), shingles=F.sum("n_shingles"))
    classes = cut(each.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("class_id")), total(each))
    ranges = max(1, -(-(total(each, "shingles") or 0) // range_shingles))
    packed = _distinct(docs, each, classes).mapInArrow(_packed(k, ranges), "range long, n long, base long, width int, payload binary")
    shared = packed.repartition(min(ranges, 100_000), "range").sortWithinPartitions("range").mapInArrow(_shared(4 * range_shingles, hot), "doc_id long, df int, token long")
    reps = classes.where("n_shingles > 0").select(F.col("class_id").alias("doc_id"), "n_shingles")
    lists = shared.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("shared"))
    # with fewer shared shingles than the threshold asks for, a set links with none
    sets = cut(reps.join(lists, "doc_id").where(F.size("shared") * 100 >= F.col("n_shingles") * threshold).select("doc_id", "n_shingles", "shared"), WIDE * total(classes))
    signed = cut(sets.mapInArrow(_signed(threshold, rare), "sig long, doc_id long, " + ", ".join(f"{c} long" for c in ABOUT)))
    sized = signed.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1").select("sig")
    label = cut(signed.join(sized, "sig").select("sig", "doc_id", F.lit(0).alias("side"), *ABOUT, F.col("doc_id").alias("of")), total(signed))
    drop(signed)
    found = None
    for _ in range(2):
        found = _joined(found, _verified(_proposals(label, threshold), sets, threshold), total(sets))
        old, label = label, cut(_still_open(_renamed(label, found)), total(label))
        drop(old)
    while True:
        old, (label, few, many) = label, _open(label, direct)
        drop(old)
        if not few and not many:
            break
        links, measured = _direct(label, sets, threshold), None
        if many:
            measured, outright = _measured(label, sets, threshold)
            links = links.union(outright) if few else outright
        found = _joined(found, links, total(sets))
        drop(label)
        if measured is None:
            break
        direct = max(direct, min(DIRECT_GROWTH * direct, DIRECT_MOST))
        label = cut(compact(_refined(_renamed(_renamed(measured, found), found, "z_of"), threshold), docs))
    named = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select("n_shingles", "h1", "h2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return each.join(named, ["n_shingles", "h1", "h2"]).select("doc_id", "n_shingles", "component_id", "class_id")


def _distinct(docs: DataFrame, each: DataFrame, classes: DataFrame) -> DataFrame:
    """docs without those that only repeat another one's set: a shingle that only copies have would count as shared, and all of their
    sets would be indexed. While copies are few, which is counted, their ids are broadcast; else the texts meet the classes' ids."""
    same = each.join(classes, ["n_shingles", "h1", "h2"])
    copies = cut(same.where("doc_id != class_id").select("doc_id"))
    if total(copies) <= COPIES:
        return docs.join(F.broadcast(copies), "doc_id", "left_anti")
    return docs.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")


def _still_open(label: DataFrame) -> DataFrame:
    """The rows of lists that are in more than one component."""
    many = label.groupBy("sig").agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x != y").select("sig")
    return label.join(many, "sig", "left_semi")
