"""Near-duplicate documents: bottom-k sketches from one hash, inverted lists, estimates, exact confirmation."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, row_mapper, stored
from .components import connected_components
from .words import A, B, WordHash, mix, words_of

#: Retained values of a sketch. At a similarity of 0.8 each of the k least values of a union is shared with
#: probability 0.8, so no two neighbours among them are both shared with probability below 0.512 ** 47 = 3e-14. Sets of
#: up to K shingles are kept whole, and there two neighbours are always shared.
K = 48
#: Documents of an inverted list that are compared in one block, and bytes of full sets that are.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Estimates from the union sketch that far (in their standard deviations) below the threshold are dropped.
MARGIN = 5.0
#: Up to this many ids or keys are broadcast (8 MB of longs); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_set(text: str | None, shingle: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text: A-Z lower-cased, words cut at ASCII
    white space. With fewer words the whole sequence is one shingle; without words there is none."""
    words = words_of(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, np.uint64(width))
        for i in range(width):
            out = mix(out * A + h[i : len(h) - width + 1 + i] * B)
    return np.unique(out)


def _links(same: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * same >= percent * (a + b - same)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, n, sig, sketch): size of the shingle set, a 128-bit digest of it, and its K least values."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("sketch", pa.binary())])

    def make():
        hashes = WordHash()

        def row(r):
            s = shingle_set(r[1], shingle, hashes)
            return [(r[0], r[2], len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[:K].tobytes())]

        return row

    docs = docs.select("i", "t", F.xxhash64("t").alias("x"))
    return docs.mapInArrow(row_mapper(make, ("i", "t", "x"), schema), "doc_id long, text_hash long, n long, sig binary, sketch binary")


def list_keys(sketch: np.ndarray) -> np.ndarray:
    """Keys of the inverted lists that hold a document: each retained value with the one after it. Two frequent
    shingles stand side by side in two sketches far less often than one frequent shingle stands in both."""
    with np.errstate(over="ignore"):
        return mix(sketch[:-1] * A + sketch[1:]).view(np.int64)


def postings(classes: DataFrame) -> DataFrame:
    """(key, rep, n): the inverted lists. Sets of one shingle link only with equal sets."""
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("n", pa.int64())])

    def make():
        return lambda r: [(k, r[0], r[1]) for k in list_keys(np.frombuffer(r[2], np.uint64)).tolist()]

    return classes.where("n > 1").select("rep", "n", "sketch").mapInArrow(row_mapper(make, ("rep", "n", "sketch"), schema), "key long, rep long, n long")


def union_estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities estimated from the K least values of the unions of sketches, one row of ``a`` and ``b`` a pair.
    Rows are filled up with the largest value."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    fill = np.uint64(0xFFFFFFFFFFFFFFFF)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != fill)
    fresh = np.ones_like(both, bool)
    fresh[:, 1:] = both[:, 1:] != both[:, :-1]
    fresh &= both != fill
    rank = np.cumsum(fresh, axis=1)
    shared = (twice & (rank[:, 1:] <= K)).sum(axis=1)
    return shared / np.maximum(np.minimum(rank[:, -1], K), 1)


def _filled(sketch: bytes) -> np.ndarray:
    s = np.frombuffer(sketch, np.uint64)
    return np.concatenate([s, np.full(K - len(s), 0xFFFFFFFFFFFFFFFF, np.uint64)])


def _least_estimate(percent: int) -> float:
    j = percent / 100
    return j - MARGIN * (j * (1 - j) / K) ** 0.5


def _likely(edges: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that the union-sketch estimate does not rule out."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"{x}_sketch"))
    rows = edges.join(side("a"), "a").join(side("b"), "b")
    least = _least_estimate(percent)

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, y = (np.stack([_filled(s) for s in part.column(part.schema.get_field_index(c)).to_pylist()]) for c in ("a_sketch", "b_sketch"))
                keep = pa.array(union_estimates(x, y) >= least)
                yield part.select(["a", "b"]).filter(keep)

    return rows.select("a", "b", "a_sketch", "b_sketch").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(rep, members): full shingle sets of the documents with these ids, made again from their texts."""
    few = ids.count() <= BROADCAST_IDS
    wanted = ids.select(F.col("id").alias("i"))
    rows = docs.join(F.broadcast(wanted) if few else wanted, "i", "left_semi")
    schema = pa.schema([("rep", pa.int64()), ("members", pa.binary())])

    def make():
        hashes = WordHash()
        return lambda r: [(r[0], shingle_set(r[1], shingle, hashes).tobytes())]

    return rows.mapInArrow(row_mapper(make, ("i", "t"), schema), "rep long, members binary")


def _confirmed(edges: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) whose full shingle sets reach the threshold."""
    edges = stored(edges)
    sets = stored(_sets(docs, edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), shingle))
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("members").alias(f"{x}_set"))
    rows = edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def make():
        def row(r):
            x, y = np.frombuffer(r[2], np.uint64), np.frombuffer(r[3], np.uint64)
            same = len(np.intersect1d(x, y, assume_unique=True))
            return [(r[0], r[1])] if _links(same, len(x), len(y), percent) else []

        return row

    return rows.mapInArrow(row_mapper(make, ("a", "b", "a_set", "b_set"), schema), "a long, b long")


def _dealt(rows: DataFrame, parts: Column, own: str, p: str, q: str) -> DataFrame:
    """Rows of lists with their block ``own`` and the pair of blocks (p, q) in which they are compared. Of a list in
    ``parts`` blocks every two meet once; a short list is one block."""
    rows = rows.withColumn("parts", parts.cast("int")).withColumn(own, F.pmod(F.xxhash64("rep", "key"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn(p, F.least(own, "other")).withColumn(q, F.greatest(own, "other")).drop("parts", "other")


def _narrowed(hot: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n, comp, cnt, keys) of lists that replace those of more than BLOCK documents. hot: (rep, n, comp) of
    all that stand in such lists.

    A link needs so many common values in two sketches (``_least_estimate``) that, in any one order of all values, two
    linked documents share one of their first values, as many as may be missing and one. In an order that has frequent
    values last these lists are short, unless documents hold little but frequent values. A common shingle then brings
    together only those that share a rare one too. ``keys``: the first values, by which a pair is looked at once.
    """
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("comp", pa.int64()), ("value", pa.int64()), ("size", pa.int32())])

    def make():
        def row(r):
            values = np.frombuffer(r[3], np.int64)
            return [(r[0], r[1], r[2], v, len(values)) for v in values.tolist()]

        return row

    rows = hot.join(classes.select("rep", "sketch"), "rep")
    rows = stored(rows.mapInArrow(row_mapper(make, ("rep", "n", "comp", "sketch"), schema), "rep long, n long, comp long, value long, size int"))
    frequent = stored(rows.groupBy("value").agg(F.count("*").alias("cnt")).where(F.col("cnt") > BLOCK).select("value", F.lit(1).alias("often")))
    few = frequent.count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(frequent) if few else frequent, "value", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), F.xxhash64("value").alias("h"), "value")))
    held = F.col("size") - F.ceil(F.col("size") * F.lit(_least_estimate(percent)) - F.lit(1e-9)).cast("int") + 1
    firsts = rows.groupBy("rep", "n", "comp", "size").agg(order.alias("values")).withColumn("keys", F.transform(F.slice("values", F.lit(1), held), lambda x: x["value"]))
    rows = stored(firsts.select("rep", "n", "comp", "keys"))
    posted = rows.select(F.explode("keys").alias("key"), "rep", "n", "comp", "keys")
    lists = posted.groupBy("key").agg(F.count("*").alias("cnt"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "cnt")
    return posted.join(lists, "key")


def _incidence(sets: list[np.ndarray]) -> np.ndarray:
    """0/1 rows of sets over the values that at least two of them hold."""
    sizes = [len(s) for s in sets]
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    keep = counts[at] > 1
    out = np.zeros((len(sets), max(1, int((counts > 1).sum()))), np.float32)
    out[np.repeat(np.arange(len(sets)), sizes)[keep], column[at[keep]]] = 1
    return out


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs; the values are taken a slab at a time."""
    total = np.zeros((len(sets), len(sets)), np.float32)
    slabs = max(1, sum(map(len, sets)) * len(sets) // 16_000_000)
    for k in range(slabs):
        part = sets if slabs == 1 else [s[s % np.uint64(slabs) == k] for s in sets]
        m = _incidence(part)
        total += m @ m.T
    return total


def _block(table: pa.Table, sets_col: str) -> tuple[dict[str, np.ndarray], list[bytes]]:
    table = table.combine_chunks()
    numbers = {c: table.column(c).to_numpy() for c in ("key", "rep", "n", "comp", "own", "p", "q")}
    return numbers, table.column(sets_col)


def _able(sets: list[np.ndarray], comp: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Places of the sets that hold at least ``need`` values which sets of other components hold too. The others have
    no partner, and without them fewer values are shared, so it is asked again until all that are left hold enough."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    kinds = np.unique(comp, return_inverse=True)[1]
    left = np.ones(len(sets), bool)
    while True:
        live = left[owner]
        seen = np.unique(at[live] * (kinds.max() + 1) + kinds[owner[live]])
        spread = np.bincount(seen // (kinds.max() + 1), minlength=len(at))
        enough = left & (np.bincount(owner[live & (spread[at] > 1)], minlength=len(sets)) >= need)
        if (enough == left).all() or not enough.any():
            return np.flatnonzero(enough)
        left = enough


def _pairs_to_compare(x: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Mask of pairs i < j in different components, from both blocks, whose sizes allow a link."""
    n, comp, own = x["n"], x["comp"], x["own"]
    mask = np.triu(comp[:, None] != comp[None, :], 1)
    mask &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    if len(own) and x["p"][0] != x["q"][0]:
        mask &= own[:, None] != own[None, :]
    return mask


def _only(x: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in x.items()}


_LEFT = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("comp", pa.int64()), ("own", pa.int32()), ("p", pa.int32()), ("q", pa.int32())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _survivors(percent: int):
    """Of one block pair of one list: the documents with a partner that the estimate does not rule out. Pairs are
    looked at only in the first of the lists that they share, by their ``keys`` where they have them."""
    least = _least_estimate(percent)

    def run(table: pa.Table) -> pa.Table:
        x, raw = _block(table, "sketch")
        nothing = _LEFT.empty_table()
        if len(x["n"]) < 2 or (x["comp"] == x["comp"][0]).all():
            return nothing
        sets = [np.frombuffer(s, np.uint64) for s in raw.to_pylist()]
        # Of the union's K least values a share of ``least`` is in both sketches, if the estimate is to pass.
        able = _able(sets, x["comp"], least * np.array([len(s) for s in sets]) - 1e-9)
        if len(able) < 2:
            return nothing
        own_keys = [list_keys(s) if k is None else np.array(k, np.int64) for s, k in zip(sets, table.column("keys").to_pylist(), strict=True)]
        x, sets, own_keys = _only(x, able), [sets[k] for k in able], [own_keys[k] for k in able]
        sizes = np.array([len(s) for s in sets])
        mask = _pairs_to_compare(x, percent)
        i, j = np.nonzero(mask & (_overlaps(sets) >= least * np.maximum(sizes[:, None], sizes[None, :]) - 1e-9))
        if not len(i):
            return nothing
        hit = np.zeros(len(sets), bool)
        filled = np.stack([_filled(s) for s in sets])
        none = np.iinfo(np.int64).max
        keys = np.full((len(sets), K), none)
        for r, own in enumerate(own_keys):
            keys[r, : len(own)] = own
        for at in range(0, len(i), 4096):
            a, b = i[at : at + 4096], j[at : at + 4096]
            ok = union_estimates(filled[a], filled[b]) >= least
            a, b = a[ok], b[ok]
            both = np.sort(np.concatenate([keys[a], keys[b]], axis=1), axis=1)
            first = np.where(both[:, 1:] == both[:, :-1], both[:, 1:], none).min(axis=1, initial=none) == x["key"][0]
            hit[a[first]] = hit[b[first]] = True
        return pa.table([pa.array(x[c][hit], t) for c, t in zip(_LEFT.names, _LEFT.types, strict=True)], schema=_LEFT)

    return run


def _block_links(percent: int):
    """Of one block pair of one list: links between components, as few as join what they join."""

    def run(table: pa.Table) -> pa.Table:
        x, raw = _block(table, "members")
        sets = [np.frombuffer(s, np.uint64) for s in raw.to_pylist()]
        able = _able(sets, x["comp"], percent / 100 * x["n"] - 1e-9) if len(sets) > 1 else []
        if len(able) < 2:
            return _EDGE.empty_table()
        x, sets = _only(x, able), [sets[k] for k in able]
        n = x["n"]
        i, j = np.nonzero(_pairs_to_compare(x, percent) & _links(_overlaps(sets).astype(np.int64), n[:, None], n[None, :], percent))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        rep, comp = x["rep"].tolist(), x["comp"].tolist()
        out = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if (u := find(comp[a])) != (v := find(comp[b])):
                root[u] = v
                out.append((rep[a], rep[b]))
        return pa.table([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], schema=_EDGE)

    return run


def _labelled(rows: DataFrame, components: DataFrame) -> DataFrame:
    named = components.select(F.col("node").alias("rep"), F.col("comp").alias("found"))
    return rows.join(named, "rep", "left").withColumn("comp", F.coalesce("found", "rep")).drop("found")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for each row: connected components of documents whose shingle
    sets have 100 * intersection >= percent * union. ``percent`` is 76 or more; below, too many pairs would share no list.

    Documents with equal sets are one class, represented by the least id. Classes meet in inverted lists of pairs of
    neighbouring retained values. First each class is compared with one member of each of its lists, chosen by a hash,
    which joins nearly all that belongs together without pairing whole lists. Lists that still hold several components
    are then compared in blocks: only pairs across components, estimates from the union sketches first, full sets for
    what they leave. Lists of more than BLOCK documents are replaced by those of their rarer values (_narrowed), and
    blocks are bounded in documents and in bytes. Every link reported or relied on was confirmed on full sets, and every pair across components that
    shares a list was ruled out by size, by estimate or by full sets.

    Texts that are null, empty or without words have no shingles and link with nothing, each its own component. A row
    with a null id links with nothing: component_id is null and it is kept. Repeated rows and rows that share an id
    with different texts are labelled by their own class. An empty table gives an empty result; other columns are not
    read.
    """
    if percent < 76:
        raise ValueError("percent has to be 76 or more")
    source = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    rows = stored(sketches(source, shingle))
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = stored(classes)
    posted = postings(classes)
    # The least hash of an id, so that the lists of similar documents choose few members between them.
    lead = F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "n"))
    lists = posted.groupBy("key").agg(F.count("*").alias("cnt"), lead.alias("lead")).where("cnt > 1")
    members = stored(posted.join(lists.select("key", "cnt", F.col("lead.rep").alias("lead"), F.col("lead.n").alias("lead_n")), "key"))

    first = members.where((F.col("rep") != F.col("lead")) & (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")))
    first = first.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    linked = stored(_confirmed(_likely(first, classes, percent), source, shingle, percent))
    found = connected_components(linked)

    # Lists of two have been compared already.
    open_ = _labelled(members.where("cnt > 2").select("key", "rep", "n", "cnt"), found)
    mixed = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    mixed = stored(mixed)
    few = mixed.count() <= BROADCAST_IDS
    open_ = stored(open_.join(F.broadcast(mixed) if few else mixed, "key", "left_semi"))
    hot = stored(open_.where(F.col("cnt") > BLOCK).select("rep", "n", "comp").distinct())
    open_ = open_.where(F.col("cnt") <= BLOCK).withColumn("keys", F.lit(None).cast("array<long>"))
    if not hot.isEmpty():
        open_ = open_.unionByName(_narrowed(hot, classes, percent))
    open_ = stored(_dealt(open_, F.ceil(F.col("cnt") / BLOCK), "own", "p", "q"))
    with_sketch = open_.join(classes.select("rep", "sketch"), "rep")
    left = with_sketch.groupBy("key", "p", "q").applyInArrow(_survivors(percent), "key long, rep long, n long, comp long, own int, p int, q int")
    left = stored(left)
    sets = _sets(source, left.select(F.col("rep").alias("id")).distinct(), shingle)
    # The window holds a block pair, so twice BLOCK rows at most.
    size = F.sum(F.col("n") * 8).over(Window.partitionBy("key", "p", "q"))
    left = _dealt(left, F.ceil(size / BLOCK_BYTES), "fine", "fine_p", "fine_q")
    more = left.join(sets, "rep").groupBy("key", "p", "q", "fine_p", "fine_q").applyInArrow(_block_links(percent), "a long, b long")
    more = stored(more.distinct())
    if not more.isEmpty():
        found = connected_components(linked.union(more))

    named = _labelled(classes.select("sig", "rep"), found).select("sig", "comp")
    out = rows.join(named, "sig", "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("comp"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_hash")


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the document with the least id, of rows
    with the same id and text one. Rows with a null id and texts without words stay; see near_duplicates()."""
    found = stored(near_duplicates(docs, shingle, percent).where("doc_id IS NOT NULL").select("doc_id", "text_hash", "kept"))
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_confab_g_id"), F.col("text_hash").alias("_confab_g_hash")).distinct()
    few = gone.count() <= BROADCAST_IDS
    here = lambda i, h: (F.col("doc_id") == F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h))
    left = docs.join(F.broadcast(gone) if few else gone, here("_confab_g_id", "_confab_g_hash"), "left_anti")
    again = found.where("kept").groupBy(F.col("doc_id").alias("_confab_a_id"), F.col("text_hash").alias("_confab_a_hash")).count().where("count > 1").drop("count")
    again = stored(again)
    if again.isEmpty():
        return left
    few = again.count() <= BROADCAST_IDS
    again = F.broadcast(again) if few else again
    once = left.join(again, here("_confab_a_id", "_confab_a_hash"), "left_anti")
    return once.unionByName(left.join(again, here("_confab_a_id", "_confab_a_hash"), "left_semi").dropDuplicates(["doc_id", "text"]))
