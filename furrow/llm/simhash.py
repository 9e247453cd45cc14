"""Near-duplicate groups by SimHash with deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments, so that of two fingerprints that differ in at most
two bits one segment differs in at most one. Each segment is indexed under its one-wildcard variants
(one bit left out), variants meet in an equality join on the key, and every candidate pair is verified
by its bit distance. Work is done on distinct fingerprints, so copies add nothing.

A key that more than ``SMALL`` distinct fingerprints share gives no pairs. Its members are linked by a
second, exact equality join: each emits itself and its 64 one-bit neighbours, and fingerprints that
meet at such a centre (65 at most) differ by at most two bits. Cost grows with the number of
fingerprints there, never with its square.

Components come from alternating large-star and small-star steps on edge tables, each step checkpointed
in the shared folder; nothing of it visits the driver but row counts.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; rows that
repeat a doc_id are one document given twice and keep or lose their place together; a null doc_id
takes part, but is never a component's name unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, split_by_field

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Keys that so many distinct fingerprints share are compared pair by pair.
SMALL = 8
_PIECE = 1 << 16
#: The looser grouping of :func:`drop_near_duplicates`: words of a shingle, least similarity, bands of minima and minima of a band.
CLOSE_SHINGLE, CLOSE, BANDS, BAND_ROWS = 5, 0.8, 14, 5
#: A band key of more than one in so many documents is hot.
HOT_SHARE = 4096
#: Texts of a block that is compared with another in one task.
BLOCK = 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not tokens:
        return 0
    shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(shingle))))) or [b" ".join(tokens)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        bits = np.unpackbits(hashes[at : at + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per document; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp bigint")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 2 x 32 one-wildcard variants of each fingerprint's segments."""
    key = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda v: F.call_function("shiftleft", v.cast("long"), F.lit(32)).bitwiseOR(
            F.when(v < 32, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), v % 32)))
        ),
    )
    return fps.select(F.explode(key).alias("key"), "fp")


def _spread(fps: DataFrame) -> DataFrame:
    """The fingerprints dealt over enough tasks for 64 variants of each (about 20,000 fingerprints a task)."""
    return fps.repartition(max(fps.sparkSession.sparkContext.defaultParallelism, -(-fps.count() // 20_000)), "fp")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def links(fps: DataFrame, *, small: int = SMALL) -> DataFrame:
    """Distinct edges (a, b), a < b, that connect distinct fingerprints at two or fewer bits.

    Pairs within small keys are all given; in large ones each centre gives a star, which connects the
    same fingerprints.
    """
    variants = _variants(_spread(fps))
    shared = cut(variants.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    twos = shared.where("n = 2").select("a", "b")
    members = variants.join(shared.where((F.col("n") > 2) & (F.col("n") <= small)).select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y > x) & _near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = members.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    dense = variants.join(shared.where(F.col("n") > small).select("key"), "key", "left_semi").select("fp").distinct()
    centre = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    stars = dense.select("fp", F.explode(F.concat(F.array("fp"), centre)).alias("c")).groupBy("c").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1)
    many = stars.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a < b")
    return twos.unionByName(few).unionByName(many).where(_near(F.col("a"), F.col("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b); root is the component's smallest node."""
    now, before = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == before or not seen[0]:
            return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    marked = cut(fingerprints(docs, id_col=id_col, text_col=text_col))
    distinct = marked.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(distinct.select("fp"), small=small))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(firsts, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = CLOSE_SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; empty without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    shingles = set(map(b" ".join, zip(*(tokens[i:] for i in range(shingle))))) or {b" ".join(tokens)}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))


def band_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, mark, keys): the size and a 128-bit mark of each text's shingle set, and its bands' keys; no row without words.

    A key hashes a band of minima of the shingle hashes under fixed permutations.
    """
    rng = np.random.default_rng(SEED)
    mul, add = rng.integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sizes, marks, keys = [], [], [], []
            for k, t in enumerate(b.column(1)):
                hashes = shingle_set(t.as_py())
                if len(hashes):
                    low = np.min([((hashes[None, i : i + 4096] ^ add) * mul).min(axis=1) for i in range(0, len(hashes), 4096)], axis=0)
                    at.append(k)
                    sizes.append(len(hashes))
                    marks.append(xxhash.xxh128_digest(hashes.tobytes(), SEED))
                    keys.append(np.array([xxhash.xxh64_intdigest(low[i * BAND_ROWS : (i + 1) * BAND_ROWS].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "size", "mark", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, size bigint, mark binary, keys array<bigint>")


def _meet(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Rows with the columns of a table (key, n, ...) by an equality join; keys with many rows (``n``) come in a bounded broadcast."""
    is_hot = F.col("n") * HOT_SHARE > total
    hot = F.broadcast(table.where(is_hot))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(table.where(~is_hot), key))


def _verified(pairs: DataFrame, given: DataFrame, least: float, per_task: int) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar; comparisons with a much-used ``a`` are salted."""
    given, _ = split_by_field(given, "id", pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    uses = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).cast("int").alias("parts"))
    left = given.join(uses, given.id == uses.a).select("a", F.col("t").alias("ta"), "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    salted = pairs.join(uses, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"))
    right = salted.join(given.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    both = right.join(left.select("a", "salt", "ta"), ["a", "salt"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, one, keep = None, None, []
            for k, (a, ta, tb) in enumerate(zip(batch.column(0), batch.column(2), batch.column(3))):
                if (a, ta) != last:  # rows of one document come together
                    last, one = (a, ta), shingle_set(ta.as_py())
                two = shingle_set(tb.as_py())
                same = len(np.intersect1d(one, two, assume_unique=True))
                if same and same >= least * (len(one) + len(two) - same):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(keep, pa.int32()))

    kind = given.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _cell_links(rows: pa.Table, least: float) -> tuple[list, list]:
    """Edges that join the components (column ``root``) of one cell's texts wherever two of them are similar: a forest of them."""
    ids, roots = rows.column("id").to_pylist(), rows.column("root").to_pylist()
    sets = [shingle_set(t) for t in rows.column("t").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    _, group = np.unique(np.array(roots, object).astype(str), return_inverse=True)
    flags, found = np.zeros(len(codes), np.int32), ([], [])
    for k in np.flatnonzero(rows.column("outside").to_numpy()):
        mine = codes[starts[k] : starts[k] + sizes[k]]
        flags[mine] = 1
        same = np.add.reduceat(flags[codes], starts)
        flags[mine] = 0
        for j in np.flatnonzero((same >= least * (sizes + sizes[k] - same)) & (group != group[k])):
            if group[j] != group[k]:
                found[0].append(ids[k])
                found[1].append(ids[j])
                group[group == group[j]] = group[k]
    return found


def _rest_links(met: DataFrame, given: DataFrame, labels: DataFrame, total: int, least: float, block: int) -> DataFrame:
    """Edges between components (labels: node, root) that still share a band key: all such members are compared.

    A key's members outside its largest component are dealt into blocks and compared with one another
    and with the blocks of the largest one, a cell for each two blocks.
    """
    named = cut(met.where("n > 3").select("id", "key").join(labels, F.col("id") == F.col("node"), "left").select("id", "key", F.coalesce("root", "id").alias("root")))
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("c"))
    live = cut(sizes.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("k")).where("k > 1").select("key", "n", F.col("top.root").alias("most"), F.col("top.c").alias("inside")))
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    outside = F.col("root") != F.col("most")
    dealt = _meet(named, live, "key", total).select("id", "key", "root", outside.alias("outside"), blocks(F.col("n") - F.col("inside")).alias("o"), blocks(F.col("inside")).alias("g"))
    spot = F.pmod(F.xxhash64("id"), F.when(F.col("outside"), F.col("o")).otherwise(F.col("g"))).cast("int")
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))  # noqa: E731  blocks from o on are the largest component's
    of_outside = F.transform(F.sequence(F.lit(0), F.col("o") + F.col("g") - 1), lambda j: pair(F.least(F.col("spot"), j), F.greatest(F.col("spot"), j)))
    of_inside = F.transform(F.sequence(F.lit(0), F.col("o") - 1), lambda i: pair(i, F.col("o") + F.col("spot")))
    cells = dealt.withColumn("spot", spot).select("id", "key", "root", "outside", F.explode(F.when(F.col("outside"), of_outside).otherwise(of_inside)).alias("p"))
    kind = given.schema["id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        a, b = _cell_links(rows, least)
        return pa.table([pa.array(a, rows.schema.field("id").type), pa.array(b, rows.schema.field("id").type)], names=["a", "b"])

    cells = cut(cells)
    given, _ = split_by_field(given, "id", cells.select("id").distinct(), "id")
    return cells.join(given, "id").select("id", "key", "root", "outside", "p.i", "p.j", "t").groupBy("key", "i", "j").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def close_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = CLOSE, per_task: int = 10_000, known: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Distinct edges (a, b) that connect documents whose sets of five-word shingles have a similarity of ``least`` or more.

    Every two documents that share a band key and are similar end in one component of these edges and
    the ``known`` ones (a, b); every edge is verified on whole texts. Equal sets are linked first and
    then stand for one. Members of a key are compared with its smallest and largest id and with its
    hub, the member that shares keys most often; what these leave apart is compared member by member.
    """
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    sets = cut(band_rows(given, id_col="id", text_col="t"))
    total = sets.count() + 1
    marks = sets.groupBy("mark").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    equal = cut(_meet(sets.select("id", "mark"), cut(marks), "mark", total).where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    linked = equal if known is None else equal.unionByName(known)
    labels = components(linked)
    reps = sets.groupBy("mark").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    rows = reps.select("id", "size", F.explode("keys").alias("key"))
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = _meet(rows, counts, "key", BANDS * total)
    weights = F.sum("n").over(Window.partitionBy("id"))
    met = cut(met.join(labels, F.col("id") == F.col("node"), "left").select("id", "size", "key", "n", F.coalesce("root", "id").alias("root")).withColumn("weight", weights))
    one = F.struct("id", "size", "root")
    pivots = cut(met.groupBy("key").agg(F.count("*").alias("n"), F.min(one).alias("lo"), F.max(one).alias("hi"), F.max(F.struct("weight", "id", "size", "root")).alias("hub"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key", "n", F.array("lo", "hi", F.struct("hub.id", "hub.size", "hub.root")).alias("pivots")))
    tried = _meet(met.drop("n"), pivots, "key", BANDS * total).select("id", "size", "root", F.explode("pivots").alias("p"))
    fits = F.least("size", "p.size") >= F.lit(least) * F.greatest("size", "p.size")
    pairs = cut(tried.where(fits & (F.col("root") != F.col("p.root"))).select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct())
    direct = cut(_verified(pairs, given, least, per_task))
    labels = components(linked.unionByName(direct))
    rest = cut(_rest_links(met, given, labels, BANDS * total, least, block))
    return equal.unionByName(direct).unionByName(rest).distinct()


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group, with all its columns; null ids stay.

    Links by fingerprint and by shingle similarity, which a distance of two bits seldom reaches, make
    the groups together, over all documents.
    """
    key = free_name(docs, "dropped_id")
    near = near_duplicates(docs, id_col=id_col, text_col=text_col).where(F.col(id_col) != F.col("component_id"))
    near = cut(near.select(F.col("component_id").alias("a"), F.col(id_col).alias("b")).distinct())
    groups = components(near.unionByName(close_pairs(docs, id_col=id_col, text_col=text_col, known=near)).distinct())
    dropped = cut(groups.where("node <> root").select(F.col("node").alias(key)).distinct())
    possible, others = split_by_field(docs, id_col, dropped, key)
    return possible.join(dropped, F.col(id_col) == F.col(key), "left_anti").unionByName(others)
