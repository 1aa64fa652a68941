"""Near-duplicate groups: MinHash bands, sequential Bayesian pruning, exact verification, components.

1. One pass over the texts gives each document's number of shingles, a digest of its shingle set,
   band keys and a signature.  Documents with equal sets are one class from here on.
2. Classes that share a band key are a bucket.  Each member is a candidate with the bucket's pivot, the
   member that shares most buckets with others: a bucket of n classes makes n - 1 candidates.
3. A candidate pair's signatures are compared batch by batch; it is dropped once the posterior
   probability of enough similarity falls below the chosen miss probability.  Survivors are verified
   on their whole shingle sets.
4. Links give components.  In buckets whose members are still in several components, the members
   outside the largest one are a query set that is compared with the bucket's other members in blocks,
   by the same sequential rule and the same exact check; only links become rows.  Where one bucket asks
   for very many comparisons, pairs that meet again in further bands are linked first; what is then still
   in several components is compared whole all the same, so the division saves work and decides nothing.

Everything between documents is a join or a partial aggregation on ids or keys; what is used twice
is written to the shared folder and deleted once the components are known.  No step gathers a bucket,
a group or the corpus in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.arrays import NOT_BLANK, Slice, fold, mix, slices, words
from tallymill.session import checkpoint_root, remove, scratch_path

BANDS, ROWS = 40, 7
BATCH = 35
#: A pair is dropped when its posterior chance of enough similarity is below this.
MISS = 1e-5
#: Members in a block, and comparisons in a bucket beyond which further bands are looked at first.
BLOCK, WORK = 128, 1 << 24
#: Further bands by which a divided bucket is keyed, and how often one is divided.
FURTHER, DEPTH = 6, 2
#: Parts of a group of equal documents in the last join.
SALT = 8
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(part: Slice, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a slice, sorted by text and hash, and the bounds of each text."""
    w = words(part, NOT_BLANK)
    texts = len(w.counts)
    long = len(w.hashes) >= n
    hashes = fold(w.hashes, n) if long else np.zeros(0, np.uint64)
    doc = w.doc[: len(hashes)]
    whole = w.doc[n - 1 :] == doc if long else np.zeros(0, bool)
    hashes, doc = hashes[whole], doc[whole]
    first = np.concatenate([[0], np.cumsum(w.counts)])
    for k in np.flatnonzero((w.counts > 0) & (w.counts < n)):
        mine = w.hashes[first[k] : first[k + 1]]
        hashes, doc = np.append(hashes, fold(mine, len(mine))), np.append(doc, k)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(texts + 1))


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (64 bits each) and signatures (16 bits a hash) of texts that have shingles."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    least = np.empty((len(full), BANDS * ROWS), np.uint64)
    if len(full):
        for k, seed in enumerate(_SEEDS):
            least[:, k] = np.minimum.reduceat((hashes ^ seed) * (seed | np.uint64(1)), bounds[full])
    least = mix(least)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS))
    key = mix(key + np.uint64(1))
    for k in range(ROWS):
        key = mix(key * np.uint64(31) + least[:, k::ROWS])
    bands = np.zeros((len(bounds) - 1, BANDS), np.int64)
    marks = np.zeros((len(bounds) - 1, BANDS * ROWS), np.uint16)
    bands[full], marks[full] = key.view(np.int64), (least >> np.uint64(48)).astype(np.uint16)
    return bands, marks


def _fixed(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows)
    width = raw.itemsize * raw.shape[1]
    bounds = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])


def sketches(docs: DataFrame, n: int, text: str, key: str) -> DataFrame:
    """id, n_shingles, digest (d1, d2), bands and signature of every row."""
    names = ["id", "n_shingles", "d1", "d2", "bands", "signature"]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                hashes, bounds = shingle_sets(part, n)
                counts = np.diff(bounds)
                total = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(hashes, out=total[0, 1:])
                np.cumsum(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1, 1:])
                digest = [pa.array((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64)) for t in total]
                bands, marks = signatures(hashes, bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                ids = batch.column(0).slice(part.first, part.last - part.first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), *digest, lists, _fixed(marks)], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("id"), docs[text].alias("_text")).mapInArrow(sketched, f"id {kind}, n_shingles long, d1 long, d2 long, bands array<long>, signature binary")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """id and all shingle hashes (sorted, 8 bytes each) of (id, _text)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                hashes, bounds = shingle_sets(part, n)
                raw = [hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.last - part.first), pa.array(raw, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(listed, f"id {docs.schema['id'].dataType.simpleString()}, shingles binary")


def least_matches(percent: int, miss: float) -> list[int]:
    """After each batch: the fewest matches with which a pair is still likely enough similar.

    With a uniform prior, n hashes of which m match make the similarity Beta(m + 1, n - m + 1)
    distributed; its upper tail at t is the chance of at most m hits in n + 1 draws of chance t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def prune(pairs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) that stay; pairs carry sa and sb (signatures), na and nb (set sizes)."""
    needed = least_matches(percent, miss)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb, na, nb = batch.columns
            rows = len(batch)
            left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(rows, -1) for x in (sa, sb))
            na, nb = na.to_numpy(), nb.to_numpy()
            alive = np.flatnonzero(100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            matched = np.zeros(rows, np.int64)
            for k, least in enumerate(needed):
                span = slice(k * BATCH, (k + 1) * BATCH)
                matched[alive] += (left[alive, span] == right[alive, span]).sum(axis=1)
                alive = alive[matched[alive] >= least]
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(compared, f"a {kind}, b {kind}")


def verify(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of which 100 * intersection >= percent * union; pairs carry xa and xb (whole sets)."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (left, right) in enumerate(zip(batch.column(2), batch.column(3))):
                if enough(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right)), percent):
                    keep.append(k)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "xa", "xb").mapInArrow(linked, f"a {kind}, b {kind}")


def _kept(df: DataFrame, name: str, tables: list[str]) -> DataFrame:
    """The rows, written to the shared folder and read again: used twice, computed once.  The path joins ``tables``."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for every id that has a link.

    Large and small stars in turn: each round hangs neighbours on the smallest id around, which halves
    distances.  A round is two partial aggregations and joins; the edges are written after each.
    """
    spark = links.sparkSession
    checkpoint_root(spark)

    def stars(edges: DataFrame) -> DataFrame:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.x).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        joined = large.join(small, large.u == small.x)
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("x", "m")).where("u <> v").distinct()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(edges)
    while before[0]:
        edges = stars(edges).checkpoint()
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots).distinct()


def _shared(banded: DataFrame) -> DataFrame:
    """Rows (key, id, band) of keys that several ids have, with n, the size of the bucket."""
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return banded.join(sizes, "key")


def _stars(buckets: DataFrame) -> DataFrame:
    """Candidates (a, b): each member of a bucket with its pivot.

    The pivot is the member whose buckets are largest in sum: the one most like the others.
    """
    weight = buckets.groupBy("id").agg(F.sum("n").alias("weight"))
    weighed = buckets.select("key", "id").join(weight, "id")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", "id")).getField("id").alias("pivot"))
    pairs = buckets.select("key", "id").join(pivots, "key").where("id <> pivot")
    return pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _open(buckets: DataFrame, component: DataFrame, tables: list[str]) -> DataFrame:
    """Members (key, id, band, component, n, outside, straggler) of buckets that are in several components."""
    named = buckets.join(component.withColumnRenamed("id", "x"), buckets.id == F.col("x"), "left").select("key", "id", "band", "n", F.coalesce("component", "id").alias("component"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("m"))
    split = sizes.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), (F.sum("m") - F.max("m")).alias("outside")).where("outside > 0")
    return _kept(named.join(split, "key").withColumn("straggler", F.col("component") != F.col("main")).drop("main"), "open-buckets", tables)


def enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets that are not empty."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _block_links(rows: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) between a straggler and a member of another component of its bucket.

    Members lie in blocks of about BLOCK rows; each block of stragglers meets each block of its bucket,
    and a task compares the two blocks' signatures as matrices and verifies what stays likely.  A pair
    counts in the bucket of the first band it shares, not in each of them: all its buckets are open.
    """
    needed = least_matches(percent, miss)
    sided = rows.join(reps.select(F.col("id").alias("x"), "n_shingles", "signature"), F.col("id") == F.col("x")).drop("x")
    sided = sided.join(sets.select(F.col("id").alias("x"), "shingles"), F.col("id") == F.col("x"))
    part = lambda n: F.ceil(n / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("id"), part(n)).cast("int")
    packed = F.collect_list(F.struct("id", "component", "n_shingles", "signature", "shingles"))
    few = sided.where("straggler").groupBy("key", "band", block(F.col("outside")).alias("i")).agg(packed.alias("left"), F.first("n").alias("n"))
    every = sided.groupBy("key", block(F.col("n")).alias("j")).agg(packed.alias("right"))
    both = few.withColumn("j", F.explode(F.sequence(F.lit(0), part(F.col("n")) - 1))).join(every, ["key", "j"])

    def columns(side: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        ids, group, size, signature, shingles = (side.field(k) for k in range(5))
        marks = np.frombuffer(b"".join(signature.to_pylist()), np.uint16).reshape(len(ids), -1)
        return ids, group.to_numpy(zero_copy_only=False), size.to_numpy(), marks, shingles

    def pairs(left: pa.ListScalar, right: pa.ListScalar, band: int) -> tuple[pa.Array, pa.Array]:
        ia, ga, na, sa, xa = columns(left.values)
        ib, gb, nb, sb, xb = columns(right.values)
        near = 100 * np.minimum(na[:, None], nb) >= percent * np.maximum(na[:, None], nb)
        x, y = np.nonzero(near & (ga[:, None] != gb))
        matched = np.zeros(len(x), np.int64)
        for k, least in enumerate(needed):
            span = slice(k * BATCH, (k + 1) * BATCH)
            matched += (sa[x, span] == sb[y, span]).sum(axis=1)
            alive = matched >= least
            x, y, matched = x[alive], y[alive], matched[alive]
        if len(x):
            shared = (sa[x] == sb[y]).reshape(len(x), BANDS, ROWS).all(axis=2)
            mine = shared.argmax(axis=1) == band
            x, y = x[mine], y[mine]
        whole = lambda column, k: np.frombuffer(column[k].as_buffer(), np.uint64)
        linked = np.array([enough(whole(xa, int(i)), whole(xb, int(j)), percent) for i, j in zip(x, y)], bool)
        return ia.take(pa.array(x[linked])), ib.take(pa.array(y[linked]))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                yield pa.RecordBatch.from_arrays([*pairs(*(batch.column(k)[row] for k in range(2)), batch.column(2)[row].as_py())], ["a", "b"])

    kind = rows.schema["id"].dataType.simpleString()
    return both.select("left", "right", "band").mapInArrow(compared, f"a {kind}, b {kind}")


def divided(many: DataFrame, reps: DataFrame, depth: int) -> DataFrame:
    """Members of buckets keyed anew by the bucket and each of the next FURTHER bands after the one they came from.

    Similar documents share about a fifth of their bands, so they meet again below some of the buckets
    they share; documents that only share a passage part.
    """
    band = reps.select(F.col("id").alias("x"), "bands")
    rows = many.select("key", "id", "band").join(band, F.col("id") == F.col("x"))
    steps = F.sequence(F.lit(depth * FURTHER + 1), F.lit(depth * FURTHER + FURTHER))
    following = F.transform(steps, lambda k: F.get("bands", (F.col("band") + k) % BANDS))
    return rows.select("key", "id", "band", F.explode(following).alias("next")).select(F.xxhash64("key", "next").alias("key"), "id", "band")


def groups(docs: DataFrame, *, words_per_shingle: int = 5, percent: int = 80, miss: float = MISS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the id column, n_shingles, component_id and kept.

    A document's set holds its distinct shingles of ``words_per_shingle`` words (maximal runs without
    white space, A-Z lower-cased), or with fewer words the whole sequence.  Documents with
    100 * intersection >= percent * union are linked; component_id is the smallest id reachable.
    Null and empty texts have no shingles and are linked with nothing.  Rows without an id are linked
    with nothing either: their component_id is null, and they are kept.  Repeated rows are answered
    each; an id with several texts is linked if any of them is.  Ids may be of any sortable type.
    """
    tables: list[str] = []
    base = docs.select(docs[key].alias("id"), docs[text].alias("_text"))
    sketch = _kept(sketches(docs, words_per_shingle, text, key), "sketches", [])
    linkable = sketch.where("n_shingles > 0 and id is not null")
    classes = linkable.groupBy("d1", "d2").agg(F.min("id").alias("class"), F.max("id").alias("last"))
    first = classes.select(F.col("class").alias("x"))
    reps = _kept(linkable.join(first, F.col("id") == F.col("x"), "left_semi").select("id", "n_shingles", "bands", "signature"), "classes", tables)

    banded = reps.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = _kept(_shared(banded), "buckets", tables)
    members = buckets.select(F.col("id").alias("x")).distinct()
    wanted = base.join(members, F.col("id") == F.col("x"), "left_semi")
    sets = _kept(full_sets(wanted, words_per_shingle), "shingle-sets", tables)

    def likely(pairs: DataFrame) -> DataFrame:
        side = lambda x: reps.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
        return prune(pairs.join(side("b"), "b").join(side("a"), "a"), percent, miss)

    def links(pairs: DataFrame) -> DataFrame:
        whole = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"x{x}"))
        return verify(pairs.join(whole("b"), "b").join(whole("a"), "a"), percent)

    def linked(found: DataFrame | None, more: DataFrame, component: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        more = _kept(more, "links", tables)
        if component is not None and more.isEmpty():
            return found, component
        found = more if found is None else found.union(more)
        return found, components(found)

    found, component = linked(None, links(likely(_stars(buckets))), None)
    level, rows, divided_once = buckets, _open(buckets, component, tables), False
    for depth in range(DEPTH):
        many = (rows if level is buckets else _open(level, component, tables)).where(F.col("outside") * F.col("n") > WORK)
        if many.isEmpty():
            break
        level, divided_once = _kept(_shared(divided(many, reps, depth)), "divided-buckets", tables), True
        found, component = linked(found, links(likely(_stars(level))), component)
    if divided_once:
        rows = _open(buckets, component, tables)
    found, component = linked(found, _block_links(rows, reps, sets, percent, miss), component)
    for path in tables:
        remove(docs.sparkSession, path)

    # documents of a group of copies or of a component; a group's rows are dealt out to SALT joins
    named = classes.join(component.withColumnRenamed("id", "x"), F.col("class") == F.col("x"), "left").where("class <> last or component is not null")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    named = named.select("d1", "d2", F.coalesce("component", "class").alias("group"), salts)
    salted = linkable.select("id", "n_shingles", "d1", "d2", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt"))
    joined = salted.join(named, ["d1", "d2", "salt"], "left").select("id", "n_shingles", F.coalesce("group", "id").alias("group"))
    alone = sketch.where("not (n_shingles > 0 and id is not null)").select("id", "n_shingles", F.col("id").alias("group"))
    rows = joined.unionByName(alone)
    return rows.select(F.col("id").alias(key), F.col("n_shingles"), F.col("group").alias("component_id"), F.coalesce(F.col("id") == F.col("group"), F.lit(True)).alias("kept"))
