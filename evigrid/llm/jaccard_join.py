"""Exact Jaccard join on word n-grams with set relations.

Sets are indexed by their rarest shingles (prefix lists). Two relations save work. Inside a list, blocks of sets whose size,
position or signature rules out the needed overlap are skipped without looking at the sets. Between sets, answers
are taken over: the most central set of a list answers first, a set similar to it joins its component and inherits what the
component reaches, and later comparisons happen only between different components. Equal sets are one set from the start.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, store

#: Buckets of the shingle frequencies that order the shingles (as bits), and words of the short signature.
ORDER_BITS, SHORT = 18, 4
#: A block of a list; longer ones are split.
BLOCK = 1000
#: Sets and members of a piece of a component; larger components are counted piece by piece. Members in at most RARE sets are counted pair by pair.
PIECE, PIECE_MEMBERS, RARE = 1000, 1 << 20, 16


def shingles(text: str, n: int = 3) -> np.ndarray:
    """The distinct ``n``-word shingles of a text as sorted 64-bit numbers: A-Z lower-cased, words between the six blanks;
    fewer words are one shingle, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i:len(words) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signed(numbers: np.ndarray) -> np.ndarray:
    return numbers.view(np.int64)


def identity(members: np.ndarray) -> int:
    """64-bit number of a set: equal sets are one. Two of a billion different sets share one with chance 0.03."""
    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), seed=len(members))).astype(np.int64))


def signature(members: np.ndarray) -> list[int]:
    """Parity bits, a power of two of them and at least one per member: every member flips one.

    Two sets differ in at least as many members as their signatures do in bits, and XOR of its halves gives the signature
    of half the length, so signatures of any two lengths can be compared.
    """
    bits = 64 * SHORT
    while bits < len(members):
        bits *= 2
    odd = np.bincount((members >> np.uint64(7)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _summaries(batches, n):
    """Kind 0: key, set, size and signature of every document; kind 1: shingles per frequency bucket."""
    import pyarrow as pa

    sums = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in slices(batches):
        sets = [shingles(t or "", n) for t in batch.column(1).to_pylist()]
        for s in sets:
            np.add.at(sums, (s >> np.uint64(64 - ORDER_BITS)).astype(np.int64), 1)
        marks = [signature(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array([0] * len(sets), pa.int32()), batch.column(0), pa.array([identity(s) if len(s) else None for s in sets], pa.int64()),
             pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.list_(pa.int64()))], ["kind", "key", "set", "n", "mark"])
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at)), pa.int32()), pa.array(at, pa.int64()), pa.nulls(len(at), pa.int64()),
                                      pa.array(sums[at], pa.int64()), pa.nulls(len(at), pa.list_(pa.int64()))], ["kind", "key", "set", "n", "mark"])


def _postings(batches, n, order, percent):
    """Prefix shingles of the sets of one task: shingle, set, size, place."""
    import pyarrow as pa

    seen: set[int] = set()
    for batch in slices(batches):
        parts = []
        for t in batch.column(0).to_pylist():
            s = shingles(t or "", n)
            if not len(s) or (no := identity(s)) in seen:
                continue
            seen.add(no)
            # Two sets with the needed overlap share one of their first shingles in any common order; here rare buckets first.
            take = len(s) - -(-percent * len(s) // 100) + 1
            first = s[np.lexsort((s, order[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]))[:take]]
            parts.append((first, no, len(s)))
        if parts:
            sizes = [len(p[0]) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate([p[0] for p in parts])), pa.int64()), pa.array(np.repeat([p[1] for p in parts], sizes), pa.int64()),
                 pa.array(np.repeat([p[2] for p in parts], sizes), pa.int32()), pa.array(np.concatenate([np.arange(k) for k in sizes]), pa.int32())],
                ["shingle", "set", "n", "place"])


def _members(batches, n, wanted):
    """The sets of one task whose number hits the bitmap ``wanted``."""
    import pyarrow as pa

    seen: set[int] = set()
    for batch in slices(batches):
        numbers, members = [], []
        for t in batch.column(0).to_pylist():
            s = shingles(t or "", n)
            if not len(s) or (no := identity(s)) in seen:
                continue
            seen.add(no)
            bit = (no & (1 << 64) - 1) >> 42
            if wanted[bit >> 6] >> np.uint64(bit & 63) & np.uint64(1):
                numbers.append(no)
                members.append(signed(s))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(members, pa.list_(pa.int64()))], ["set", "members"])


def needed(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of sets of sizes n and m at the threshold: percent * (n + m) / (100 + percent), rounded up."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent) - 1e-9)


def room(a: str, b: str, percent: int) -> Column:
    """Whether sizes and places leave room for the needed overlap.

    If the shared shingle is the first one shared, nothing in front of it in either set is shared; the list of the first shared
    shingle sees every pair, so nothing similar is lost.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (
        F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place")) >= needed(n, m, percent))


def near(n: Column, m: Column, apart: Column, percent: int) -> Column:
    """Whether sets of sizes n and m that differ in ``apart`` members or more can reach the threshold."""
    return n + m - apart >= 2 * needed(n, m, percent)


def folded(mark: Column, size: Column) -> Column:
    """A signature shortened to ``size`` words, its own or half its length."""
    halves = F.zip_with(F.slice(mark, F.lit(1), size), F.slice(mark, size + 1, size), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(mark) > size, halves).otherwise(mark)


def apart(x: Column, y: Column) -> Column:
    """In how many bits two signatures differ (their sizes are at most one power of two apart)."""
    size = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(folded(x, size), folded(y, size), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _short_word(i: int) -> Column:
    """Word ``i`` of a signature folded to ``SHORT`` words."""
    every = F.filter("mark", lambda w, at: at % SHORT == i)
    return F.aggregate(every, F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(w))


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose signatures allow the threshold."""
    left = sets.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("mark").alias("ma"))
    right = sets.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("mark").alias("mb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(near(F.col("na"), F.col("nb"), apart(F.col("ma"), F.col("mb")), percent)).select("a", "b")


def bitmap(sets: DataFrame) -> np.ndarray:
    """2^22 bits that hold the numbers of ``sets`` (column ``set``), by their first bits; 65536 words at most reach the driver."""
    top = F.shiftrightunsigned("set", 48)
    rows = sets.groupBy(top.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(shiftrightunsigned(set, 42) & 63))")).alias("bits")).collect()
    out = np.zeros(1 << 16, np.int64)
    for r in rows:
        out[r["w"]] = r["bits"]
    return out.view(np.uint64)


def similar(pairs: DataFrame, docs: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """The pairs (columns ``a``, ``b``) that reach the threshold, checked on the whole sets."""
    spark = docs.sparkSession
    pairs = store(pairs, "join-pairs")
    if not pairs.head(1):
        return pairs
    wanted = spark.sparkContext.broadcast(bitmap(pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set")))))
    # Not stored: both joins read one exchange of the sets.
    members = docs.select(text).mapInArrow(lambda batches: _members(batches, n, wanted.value), "set long, members array<long>").dropDuplicates(["set"])
    both = (pairs.join(members.select(F.col("set").alias("b"), F.col("members").alias("y")), "b")
            .join(members.select(F.col("set").alias("a"), F.col("members").alias("x")), "a"))
    shared = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y")
    return store(both.where(100 * shared >= percent * (total - shared)).select("a", "b"), "join-links")


def components(links: DataFrame) -> DataFrame:
    """``set`` and ``root`` (one per component) of all sets in ``links`` (columns ``a``, ``b``).

    Every round each set points to the smallest number around it, chains are cut short, and the edges between
    different roots go to the next round; numbers are hashes, so the edges shrink by a factor each time.
    """
    edges, known = links.where("a <> b").select("a", "b").distinct(), None
    while True:
        edges = store(edges, "join-edges")
        if not edges.head(1):
            break
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = store(around.groupBy(F.col("a").alias("set")).agg(F.least(F.min("b"), F.col("a")).alias("up")), "join-parents")
        two = parent.select(F.col("set").alias("up"), F.col("up").alias("upper"))
        short = store(parent.join(two, "up").select("set", F.col("upper").alias("root")), "join-short")
        known = short if known is None else store(
            known.withColumnRenamed("root", "set0").withColumnRenamed("set", "first").join(
                short.withColumnRenamed("set", "set0"), "set0", "left")
            .select(F.col("first").alias("set"), F.coalesce("root", "set0").alias("root"))
            .unionByName(short), "join-known").groupBy("set").agg(F.min("root").alias("root"))
        r = short.select(F.col("set").alias("a"), F.col("root").alias("ra"))
        edges = (edges.join(r, "a").join(r.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
                 .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if known is None:
        return links.sparkSession.createDataFrame([], "set long, root long")
    return known


def _indexed(docs: DataFrame, n: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``raw`` (key, text), ``documents`` (key, set, n), ``sets`` (set, n, mark) and ``entries`` (shingle, set, n, place) of lists with two sets or more."""
    spark = docs.sparkSession
    raw = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    base = store(raw.mapInArrow(lambda batches: _summaries(batches, n), "kind int, key long, set long, n long, mark array<long>"), "join-sets")
    order = np.zeros(1 << ORDER_BITS, np.int64)
    for r in base.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect():  # one row per bucket
        order[r["key"]] = r["n"]
    sent = spark.sparkContext.broadcast(order)
    documents = base.where("kind = 0")
    sets = store(documents.where("n > 0").groupBy("set").agg(F.first("n").cast("int").alias("n"), F.first("mark").alias("mark")), "join-distinct")

    postings = store(raw.select("text").mapInArrow(lambda batches: _postings(batches, n, sent.value, percent),
                                                   "shingle long, set long, n int, place int"), "join-postings")
    # Lists with two sets or more.
    lists = postings.groupBy("shingle").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("shingle")
    entries = store(postings.join(lists, "shingle").distinct(), "join-entries")
    return raw, documents, sets, entries


def _list_pairs(entries: DataFrame, sets: DataFrame, percent: int, which: Column) -> DataFrame:
    """The pairs (``a`` < ``b``) of sets in one list that sizes, places and short signatures allow, block by block of similar size; ``which``
    says of the entries x and y whether they are asked for."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    short = sets.select("set", *[_short_word(i).alias(f"m{i}") for i in range(SHORT)])
    left = store(entries.join(short, "set").withColumn("band", band), "join-open")
    long = store(left.groupBy("shingle", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")).where("chunks > 1"), "join-long")
    chunks = F.coalesce("chunks", F.lit(1))
    x = left.join(long, ["shingle", "band"], "left").withColumn("chunk", F.pmod(F.xxhash64("set"), chunks).cast("int"))
    # A set meets its own band and the one above; more distant sizes cannot be similar. Long bands are met chunk by chunk.
    y = (left.withColumn("own", F.col("band")).withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
         .join(long, ["shingle", "band"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))))
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.chunk") == F.col("y.chunk"))
    # Sets of one band meet in both directions: keep one of them.
    once = (F.col("y.own") != F.col("x.band")) | (F.col("x.set") < F.col("y.set"))
    bits = sum((F.bit_count(F.col(f"x.m{i}").bitwiseXOR(F.col(f"y.m{i}"))) for i in range(SHORT)), F.lit(0))
    return (x.alias("x").join(y.alias("y"), same & which & once & room("x", "y", percent)
                              & near(F.col("x.n"), F.col("y.n"), bits, percent))
            .select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct())


def _roots(raw: DataFrame, sets: DataFrame, entries: DataFrame, n: int, percent: int) -> DataFrame:
    """``set`` and ``root`` (one per component) of all sets that link with another one."""
    # Their most central sets, those with the fewest rarer shingles in front, answer first.
    leads = entries.groupBy("shingle").agg(F.min(F.struct("place", "set", "n")).alias("lead"), F.count("*").alias("many")).select(
        "shingle", "lead.*", "many")
    star = (entries.alias("x").join(leads.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.set") != F.col("y.set"))
                                    & room("x", "y", percent)).select(F.col("y.set").alias("a"), F.col("x.set").alias("b")).distinct())
    links = similar(plausible(star, sets, percent), raw, n, percent, "text")
    roots = store(components(links), "join-roots")

    # What the first answers left open: pairs of a list in different components. A list's lead has met
    # all others, so lists of two are done.
    rest = entries.join(leads.where("many > 2").select("shingle", F.col("set").alias("lead")), "shingle").where("set <> lead")
    rest = rest.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")).select("shingle", "set", "n", "place", "root")
    rest = store(rest, "join-rest")
    mixed = rest.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    open_pairs = _list_pairs(rest.join(mixed, "shingle"), sets, percent, F.col("x.root") != F.col("y.root"))
    links = links.unionByName(similar(plausible(open_pairs, sets, percent), raw, n, percent, "text"))
    return store(components(links), "join-roots")


def jaccard_links(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All links between different sets: ``a`` < ``b`` (numbers of the sets), one row per pair with 100 * intersection >= ``percent`` * union.

    Unlike ``jaccard_classes`` nothing is skipped because its component is known: a family of m similar sets has up to m * (m - 1) / 2 rows.
    """
    raw, _, sets, entries = _indexed(docs, n, percent, key, text)
    return similar(plausible(_list_pairs(entries, sets, percent, F.lit(True)), sets, percent), raw, n, percent, "text")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of ``sets`` (each sorted, without repeats) as a matrix; the diagonal is not filled."""
    m = len(sets)
    ids, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    many = np.diff(np.append(starts, len(ids)))
    column = np.repeat(np.arange(len(many)), many)
    rare = many[column] <= RARE
    found, at, of = np.zeros(m * m, np.float32), column[rare], owner[rare]
    for d in range(1, min(RARE, int(many.max()))):
        both = at[d:] == at[:-d]
        if both.any():
            found += np.bincount(of[:-d][both] * m + of[d:][both], minlength=m * m).astype(np.float32)
    found = found.reshape(m, m)
    found += found.T
    common = np.flatnonzero(many > RARE)
    for k in range(0, len(common), 4096):
        wide = np.zeros((m, min(4096, len(common) - k)), np.float32)
        for j, c in enumerate(common[k:k + 4096]):
            wide[owner[starts[c]:starts[c] + many[c]], j] = 1
        found += wide @ wide.T
    return found


def _piece_counts(batches, percent):
    """Links of the sets of a piece, or between two pieces, of a component; rows of one (root, low, high) follow each other."""
    import pyarrow as pa

    def counted(rows):
        numbers, parts, low, high, copies, members = zip(*rows, strict=True)
        size = np.array([len(x) for x in members], np.float64)
        shared = overlaps(list(members)).astype(np.float64)
        linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
        np.fill_diagonal(linked, False)
        if low[0] != high[0]:  # inside of a piece is counted by its own rows
            part = np.array(parts)
            linked &= part[:, None] != part[None, :]
        return numbers, (linked @ np.array(copies, np.int64)).tolist()

    def out(numbers, others):
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(others, pa.int64())], ["set", "others"])

    here, rows, numbers, others = None, [], [], []
    for batch in slices(batches):
        lists = batch.column("members")
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        columns = [batch.column(c).to_pylist() for c in ("root", "low", "high", "set", "part", "copies")]
        for i, (root, low, high, no, part, copies) in enumerate(zip(*columns, strict=True)):
            if (root, low, high) != here:
                if len(rows) > 1:
                    found = counted(rows)
                    numbers += found[0]
                    others += found[1]
                here, rows = (root, low, high), []
                if len(numbers) > 4096:
                    yield out(numbers, others)
                    numbers, others = [], []
            rows.append((no, part, low, high, copies, flat[ends[i]:ends[i + 1]].copy()))
    if len(rows) > 1:
        found = counted(rows)
        numbers += found[0]
        others += found[1]
    yield out(numbers, others)


def _other_links(roots: DataFrame, rows: DataFrame, sets: DataFrame, raw: DataFrame, n: int, percent: int) -> DataFrame:
    """(set, others): the rows of other sets that the sets of ``roots`` (set, root) link with.

    Linked sets have one root, so the sets of a component are compared with each other, whole sets, no pair left out. They
    meet piece by piece inside tasks, and only counts per set come out: a component of m sets in k pieces makes m * k rows, not m * m.
    """
    spark = raw.sparkSession
    if not roots.head(1):
        return spark.createDataFrame([], "set long, others long")
    sized = roots.join(sets.select("set", "n"), "set").groupBy("root").agg(
        F.ceil(F.greatest(F.count("*") / F.lit(PIECE), F.sum("n") / F.lit(PIECE_MEMBERS))).cast("int").alias("pieces"))
    large = store(sized.where("pieces > 1"), "join-large")
    wanted = spark.sparkContext.broadcast(bitmap(roots.select("set")))
    members = raw.select("text").mapInArrow(lambda batches: _members(batches, n, wanted.value), "set long, members array<long>").dropDuplicates(["set"])
    pieces = F.coalesce("pieces", F.lit(1))
    placed = (members.join(roots, "set").join(rows, "set").join(large, "root", "left").withColumn("part", F.pmod(F.xxhash64("set"), pieces).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1))))
    placed = placed.select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "set", "part", "copies", "members")
    # By a key, so that a component's piece is in one partition; sorted, so that it is held alone.
    placed = placed.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    counts = placed.mapInArrow(lambda batches: _piece_counts(batches, percent), "set long, others long")
    return counts.groupBy("set").agg(F.sum("others").alias("others"))


def _with_links(documents: DataFrame, roots: DataFrame, sets: DataFrame, raw: DataFrame, n: int, percent: int) -> DataFrame:
    """``documents`` with words and ``n_links``: the other rows of their set and of the sets it links with."""
    rows = store(documents.where("n > 0").groupBy("set").agg(F.count("*").alias("copies")), "join-copies")
    others = _other_links(roots, rows, sets, raw, n, percent)
    per_set = store(rows.join(others, "set", "left").select("set", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "join-counts")
    return documents.where("n > 0").join(per_set, "set")


def link_counts(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_links``, the number of other rows it links with, those with an equal set included."""
    raw, documents, sets, entries = _indexed(docs, n, percent, key, text)
    roots = _roots(raw, sets, entries, n, percent)
    full = _with_links(documents, roots, sets, raw, n, percent).select("key", "n_links")
    return full.unionByName(documents.where("n = 0").select("key", F.lit(0).cast("long").alias("n_links"))).select(F.col("key").alias(key), "n_links")


def jaccard_join(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``jaccard_classes`` with ``n_links``, the number of other rows a document links with, those with an equal set included.

    Every link between different sets is found and counted, inside the classes. Rows without words have 0 links.
    """
    raw, documents, sets, entries = _indexed(docs, n, percent, key, text)
    roots = _roots(raw, sets, entries, n, percent)
    full = store(_with_links(documents, roots, sets, raw, n, percent).join(roots, "set", "left").select("key", "n", F.coalesce("root", "set").alias("root"), "n_links"), "join-rooted")
    first = store(full.groupBy("root").agg(F.min("key").alias("component_id")), "join-first")  # stored, so that a hot class can be split
    out = full.join(first, "root").select("key", "n", "component_id", "n_links")
    alone = documents.where("n = 0").select("key", "n", F.col("key").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links")


def jaccard_classes(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_shingles`` (size of its set of ``n``-word shingles), ``component_id`` (the smallest key
    reachable over links, its own included). Two documents link when 100 * intersection >= ``percent`` * union.

    Null and empty texts have an empty set and link with nothing. Equal texts link always; rows that repeat a key are
    rows of their own; a null key never is a component's id unless all its keys are null. An empty table gives an
    empty result; other columns are ignored. Keys are whole numbers.
    """
    raw, documents, sets, entries = _indexed(docs, n, percent, key, text)
    roots = _roots(raw, sets, entries, n, percent)

    # Documents without words link with nothing and stay out of the joins.
    full = documents.where("n > 0").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    full = store(full.select("key", "n", "root"), "join-rooted")
    first = store(full.groupBy("root").agg(F.min("key").alias("component_id")), "join-first")  # stored, so that a hot class can be split
    out = full.join(first, "root").select("key", "n", "component_id")
    alone = documents.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return out.unionByName(alone).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


#: The same rows in DuckDB: all shingles, all pairs that share one, links, reachability.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT w.doc_id, count(g)::BIGINT AS n_shingles, coalesce(list(g ORDER BY g), [])::VARCHAR AS whole FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
-- equal sets first, so that only one of each is paired
r AS (SELECT whole, min(doc_id) AS rep, min(n_shingles) AS n, count(*) AS m FROM n WHERE n_shingles > 0 GROUP BY whole),
t AS (SELECT rep, n, g FROM r JOIN s ON s.doc_id = r.rep),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (na + nb - k)),
z(a, b) AS (SELECT rep, rep FROM r UNION SELECT z.a, l.b FROM z JOIN l ON z.b = l.a),
c AS (SELECT a AS rep, min(b) AS component_id FROM z GROUP BY a),
o AS (SELECT l.a AS rep, sum(r.m) AS others FROM l JOIN r ON r.rep = l.b GROUP BY l.a)
SELECT n.doc_id, n.n_shingles, coalesce(c.component_id, n.doc_id) AS component_id, coalesce(r.m - 1 + coalesce(o.others, 0), 0)::BIGINT AS n_links
FROM n LEFT JOIN r ON n.whole = r.whole AND n.n_shingles > 0 LEFT JOIN c ON c.rep = r.rep LEFT JOIN o ON o.rep = r.rep
"""
