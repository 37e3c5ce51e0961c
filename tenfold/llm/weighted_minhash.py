"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words; its weight in a text is its count times an inverse document frequency.
Document frequencies are counted exactly over all texts: documents are dealt into groups, a group
sends each distinct shingle and the number of its texts that hold it to the shingle's bucket once, and
gets the sums back in the same order.  Consistent weighted sampling draws, for each
of a signature's places, one shingle of a text together with a quantised weight; two texts draw the
same with a chance of their weighted Jaccard similarity.  Texts that agree in all places of a band are
candidates, and candidates are verified by the weighted Jaccard similarity itself.

Texts of the same words are one node.  A bucket of a band does not emit its pairs: first its texts
meet a leader each.  Pairs within a component need no test after that.  Where buckets still hold
several components, their texts meet by prefix filter: ordered by how many of these texts have a
shingle, the rarest first, two texts can only be similar if they share one among those that make up
the first fifth of each one's weight.  The holders of such a shingle first meet one leader each, for a
few rounds; then every text outside its bucket's largest component meets the texts that are still of
other components and share one.  So no link between components is lost, and a large group of copies or
near copies costs few pairs a text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tenfold.llm import common, exchange, words
from tenfold.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
#: Bands and the places of each: at a similarity of 0.8 all but 3 in 100,000 pairs are candidates.
BANDS, PLACES = 20, 4
#: Rows of random numbers that shingles share by hash.
RANDOM = 1 << 14
AT_ONCE = 1 << 20
#: Leaders of a bucket differ by band, modulo this; rounds at most in which a shingle's holders meet a leader.
LEADERS, ROUNDS = 2, 3
#: Allowance for rounding in bounds; what passes them is verified.
SLACK = 1e-4


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the text of each; a text of fewer words is one shingle."""
    starts, ends, row = words.spans(raw, off)
    h = words.hashes(raw, starts, ends)
    found = words.rolled(h, SHINGLE)
    whole = np.flatnonzero(row[: len(found)] == row[SHINGLE - 1 :]) if len(found) else np.zeros(0, np.int64)
    hashes, rows = [found[whole]], [row[whole]]
    size = np.bincount(row, minlength=len(off) - 1)
    first = np.searchsorted(row, np.arange(len(off) - 1))
    for n in range(1, SHINGLE):
        short = np.flatnonzero(size == n)
        if len(short):
            hashes.append(words.rolled(h, n)[first[short]] ^ np.uint64(n))
            rows.append(short)
    return np.concatenate(hashes), np.concatenate(rows)


def _stable(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 on; those of 16 bits are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x, kind="stable")


def _order(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Order by `of`, then hash."""
    order = np.argsort(h)
    return order[_stable(of[order])]


def counted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, by text, then hash: hashes, texts and counts."""
    order = _order(h, row)
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    cut = np.flatnonzero(new)
    return h[cut], row[cut], np.diff(np.append(cut, len(h)))


def inverse(n: int, frequency: np.ndarray) -> np.ndarray:
    """Weight of one occurrence of a shingle of each frequency: 1 + ln((1 + n) / (1 + frequency)), 1 at least."""
    return np.maximum(1.0, 1.0 + np.log((1 + n) / (1 + frequency))).astype(np.float32)


@functools.lru_cache(1)
def _random(places: int) -> tuple[np.ndarray, ...]:
    """For each row of random numbers and place: r ~ Gamma(2, 1), 1 / r, b ~ U(0, 1) and ln c - r + r b with c ~ Gamma(2, 1)."""
    rng = np.random.Generator(np.random.PCG64(20260101))
    r = rng.gamma(2.0, 1.0, (RANDOM, places)).astype(np.float32)
    b = rng.random((RANDOM, places), np.float32)
    c = np.log(rng.gamma(2.0, 1.0, (RANDOM, places))).astype(np.float32)
    return r, 1 / r, b, c - r + r * b


def sampled(h: np.ndarray, weight: np.ndarray, places: int) -> np.ndarray:
    """A hash of the (shingle, quantised weight) drawn for each place; shingles in ascending order of hash."""
    r, inverse_r, b, c = _random(places)
    least, drawn, place = np.full(places, np.inf, np.float32), np.zeros(places, np.uint64), np.arange(places)
    for a in range(0, len(h), 4096):
        part, log = h[a : a + 4096], np.log(weight[a : a + 4096])
        at = (part >> np.uint64(20)).astype(np.int64) % RANDOM
        t = inverse_r.take(at, axis=0)
        t *= log[:, None]
        t += b.take(at, axis=0)
        np.floor(t, out=t)
        t *= r.take(at, axis=0)
        left = c.take(at, axis=0)
        left -= t  # ln c - r - r (t - b)
        best = left.argmin(axis=0)
        low, row = left[best, place], at[best]
        level = np.floor(inverse_r[row, place] * log[best] + b[row, place]).astype(np.int64)
        key = common.mix(part[best] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        closer = low < least
        least, drawn = np.where(closer, low, least), np.where(closer, key, drawn)
    return drawn


SIGNED = "doc_id long, node binary, bands array<bigint>, idf binary"
#: Low digits of a shingle's hash; those above decide its bucket.
KEY = np.dtype([("low", "<u4"), ("high", "<u2")])
PACKED = "b int, g int, keys binary, n binary"


#: Bytes, offsets, first row and distinct shingles (as in `counted`) of a run of a group's rows.
Part = tuple[np.ndarray, np.ndarray, int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _parts(group: exchange.Group) -> list[Part]:
    return [(raw, off, a, counted(*shingles(raw, off))) for a, _, raw, off in group.slices(AT_ONCE)]


def _hashes(parts: list[Part]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(found[0] for *_, found in parts)])


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each distinct shingle, these in ascending order, and their order by bucket."""
    bucket = ((h >> np.uint64(44)) % np.uint64(buckets)).astype(np.int32)
    return bucket, _stable(bucket)


def _cuts(of: np.ndarray) -> np.ndarray:
    """Edges of the runs of equal numbers."""
    return np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else np.zeros(1, np.int64)


def summed(by_group: DataFrame, size: int, buckets: int) -> DataFrame:
    """b, g and n: for each group and bucket, of how many texts the group's shingles there are, in order of hash."""

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, n = np.unique(_hashes(_parts(exchange.Group(table))), return_counts=True)
        bucket, order = _by_bucket(h, buckets)
        h, n, bucket = h[order], n[order].astype("<u4"), bucket[order]
        keys = np.zeros(len(h), KEY)
        keys["low"], keys["high"] = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) & np.uint64(0xFFFF)
        cut = _cuts(bucket)
        data = [pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for x in (keys, n)]
        return pa.Table.from_arrays([pa.array(bucket[cut[:-1]]), pa.array([key[0].as_py()] * (len(cut) - 1), pa.int32()), *data], names=["b", "g", "keys", "n"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(d.as_buffer(), KEY) for d in table["keys"]])
        n = np.concatenate([np.frombuffer(d.as_buffer(), "<u4") for d in table["n"]])
        sizes = [len(d.as_buffer()) // KEY.itemsize for d in table["keys"]]
        k = keys["low"].astype(np.uint64) | keys["high"].astype(np.uint64) << np.uint64(32)
        order = np.argsort(k)
        cut = _cuts(k[order])
        total = np.empty(len(k), "<u4")
        total[order] = np.repeat(np.add.reduceat(n[order], cut[:-1], dtype=np.int64), np.diff(cut))
        edge = np.cumsum([0, *sizes])
        data = pa.array([total[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())
        return pa.Table.from_arrays([table["b"], table["g"], data], names=["b", "g", "n"])

    packed = common.spread(by_group.groupBy("g").applyInArrow(gather, PACKED), size, "b")
    return packed.groupBy("b").applyInArrow(add, "b int, g int, n binary")


def signed(docs: DataFrame, bands: int = BANDS, places: int = PLACES) -> DataFrame:
    """doc_id, node (a hash of the words, null without any), bands (a hash of each band's draws) and idf (that of each distinct shingle, in order of hash)."""
    n_texts = docs.count()
    size = common.size_of(docs)
    groups, buckets = (common.parts_for(docs.sparkSession, size, x) for x in (exchange.GROUP, exchange.BUCKET))
    by_group = common.spread(common.text_of(docs).withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")), size, "g")

    def rows(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        group = exchange.Group(table)
        parts = _parts(group)
        h = _hashes(parts)
        # the number of each shingle among the distinct ones of the group
        order, number = np.argsort(h), np.empty(len(h), np.int64)
        cut = _cuts(h[order])
        number[order] = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        _, by_bucket = _by_bucket(h[order[cut[:-1]]], buckets)
        idf = np.empty(len(by_bucket), np.float32)
        idf[by_bucket] = inverse(n_texts, np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(d.as_buffer(), "<u4") for d in found.sort_by("b")["n"])]).astype(np.int64))
        nodes, keys, weights = (np.full(group.table.num_rows, None, object) for _ in range(3))
        at = 0
        for raw, off, a, (h, row, n) in parts:
            own_idf = idf[number[at : at + len(h)]]
            at += len(h)
            weight = n.astype(np.float32) * own_idf
            cut = _cuts(row)
            worded = row[cut[:-1]]
            drawn = np.zeros((len(worded), bands, places), np.uint64)
            for i, p, q in zip(range(len(worded)), cut, cut[1:]):
                drawn[i] = sampled(h[p:q], weight[p:q], bands * places).reshape(bands, places)
            k = np.arange(bands, dtype=np.uint64)
            for j in range(places):
                k = common.mix(k * np.uint64(0x9E3779B97F4A7C15) + drawn[:, :, j])
            for i, p, q, own in zip(worded, cut, cut[1:], k.astype(np.int64)):
                nodes[a + i] = node_of(raw[off[i] : off[i + 1]].tobytes())
                keys[a + i] = own
                weights[a + i] = own_idf[p:q].astype("<f4").tobytes()
        return pa.Table.from_arrays([group.table["doc_id"], pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(weights, pa.binary())], names=["doc_id", "node", "bands", "idf"])

    return by_group.groupBy("g").cogroup(summed(by_group, size, buckets).groupBy("g")).applyInArrow(rows, SIGNED)


def _idf(column: pa.Array) -> np.ndarray:
    """The packed weights of all rows."""
    return np.frombuffer(common.utf8(column)[0].tobytes(), "<f4").astype(np.float64)


def node_of(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.split()))


def similarities(a: pa.Array, b: pa.Array, idf_a: pa.Array, idf_b: pa.Array) -> np.ndarray:
    """The weighted Jaccard similarity of each two texts; `idf_a` and `idf_b` as in `signed`."""
    out = []
    (raw_a, off_a), (raw_b, off_b) = common.utf8(a), common.utf8(b)
    for lo, hi in common.slices(off_a + off_b, AT_ONCE):
        n = hi - lo
        parts = [shingles(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for raw, off in ((raw_a, off_a), (raw_b, off_b))]
        h, row, count = counted(np.concatenate([p[0] for p in parts]), np.concatenate([parts[0][1], parts[1][1] + n]))
        weight = np.concatenate([_idf(x.slice(lo, n)) for x in (idf_a, idf_b)])
        pair = row % n
        order = _order(h, pair)
        h, pair, count, weight = h[order], pair[order], count[order], weight[order]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
        both = np.where(same, np.minimum(count, np.append(0, count[:-1])), 0)
        shared = np.bincount(pair, weight * both, n)
        total = np.bincount(pair, weight * count, n)
        out.append(shared / np.maximum(total - shared, 1e-300))
    return np.concatenate(out) if out else np.zeros(0)


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """u, v of pairs (u, v) whose texts (node, text, idf) are similar."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(similarities(*(batch.column(i) for i in (2, 3, 4, 5))) >= least - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["u", "v"])

    one = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a"), F.col("idf").alias("idf_a")), "u")
    two = one.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b"), F.col("idf").alias("idf_b")), "v")
    return two.select("u", "v", "a", "b", "idf_a", "idf_b").mapInArrow(rows, "u binary, v binary")


def _texts(docs: DataFrame, wanted: DataFrame, signs: DataFrame, tables: common.Tables) -> DataFrame:
    """node, text and idf, one for each of the wanted nodes (node, doc_id)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = common.utf8(batch.column(1))
            nodes = [node_of(raw[off[i] : off[i + 1]].tobytes()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column(1)], names=["node", "text"])

    one = common.text_of(docs).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    found = one.mapInArrow(rows, "node binary, text string")
    found = found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    # texts of the same words have the same shingles, so any row's weights are the node's
    idf = signs.select("node", "idf").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    return tables.write(found.join(idf, "node"), "texts")


def _mixed(placed: DataFrame, tables: common.Tables) -> DataFrame:
    """Rows of buckets that hold several components, with the largest of these."""
    sizes = placed.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("k")).filter("k > 1")
    mixed = tables.write(mixed.select("band", "key", F.col("most.component").alias("largest")), "mixed")
    return tables.write(placed.join(mixed, ["band", "key"]), "inside")


def prefixes(nodes: DataFrame, texts: DataFrame, tables: common.Tables, least: float = SIMILAR) -> DataFrame:
    """node, shingle, after, total: of each node the shingles that fewest of the nodes have, until what is left weighs less than `least` of it.

    `total` is the node's weight, `after` that of the shingle and those after it; shingles of one node alone are left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = common.utf8(batch.column(1))
            for a, b in common.slices(off, AT_ONCE):
                h, row, n = counted(*shingles(raw[off[a] : off[b]], off[a : b + 1] - off[a]))
                weight = n * _idf(batch.column(2).slice(a, b - a))
                total = np.bincount(row, weight, b - a)[row]
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), batch.column(0).take(pa.array(row + a)), pa.array(weight.astype(np.float32)), pa.array(total.astype(np.float32))], names=["shingle", "node", "weight", "total"])

    found = texts.join(nodes, "node", "left_semi").select("node", "text", "idf").mapInArrow(rows, "shingle long, node binary, weight float, total float")
    found = tables.write(found, "shingles")
    holders = tables.write(found.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"), "holders")
    # a shingle that one node alone has joins nothing, but counts for what stands before the others
    ranked = found.join(holders, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    order = Window.partitionBy("node").orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("total").cast("double")
    after = total - F.coalesce(F.sum(F.col("weight").cast("double")).over(order), F.lit(0.0))
    return ranked.withColumn("after", after).filter((F.col("after") >= total * (least - SLACK)) & (F.col("n") > 1)).select("node", "shingle", "after", total.alias("total"))


def _classes(docs: DataFrame, least: float = SIMILAR, bands: int = BANDS, places: int = PLACES) -> DataFrame:
    """doc_id, node, component and class_id of each row, as `classes` has them; component names the class even where doc_ids repeat."""
    tables = common.Tables(docs.sparkSession)
    rows = tables.write(signed(docs, bands, places), "signed")
    nodes = rows.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = tables.write(nodes, "nodes")

    # the buckets of several nodes, and their leaders
    entries = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    leader = F.min_by("node", F.xxhash64("node", F.col("band") % LEADERS))
    several = entries.groupBy("band", "key").agg(F.count("*").alias("n"), leader.alias("leader")).filter("n > 1").select("band", "key", "leader")
    members = tables.write(entries.join(tables.write(several, "buckets"), ["band", "key"]), "members")
    pair = [F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")]
    pairs = tables.write(members.filter("node <> leader").select(*pair).distinct(), "pairs")
    texts = _texts(docs, nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id"), rows, tables)
    links = tables.write(verified(pairs, texts, least), "links")
    joined = tables.write(components(links, tables), "components")

    # buckets that hold several components: their nodes meet those of other components by prefix
    placed = members.select("band", "key", "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    inside = _mixed(tables.write(placed, "placed"), tables)
    nodes_inside = tables.write(inside.groupBy("node").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("largest")).alias("outside")), "nodes-inside")
    prefix = tables.write(prefixes(nodes_inside.select("node"), texts, tables, least).join(nodes_inside.select("node", "outside"), "node"), "prefixes")
    # what two texts share from their first common shingle on is no more than either has from there
    enough = F.least("xa", "ya") >= (F.col("xt") + F.col("yt")) * (least / (1 + least) - SLACK)
    edges = [F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")]
    own = [F.col("node").alias("x"), F.col("component").alias("xc"), F.col("after").alias("xa"), F.col("total").alias("xt")]
    other = [F.col("node").alias("y"), F.col("component").alias("yc"), F.col("after").alias("ya"), F.col("total").alias("yt")]

    def placed_prefixes() -> DataFrame:
        return tables.write(prefix.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed-prefixes")

    # first the holders of a shingle meet one of them, round after round, which joins most of a group of near copies
    for k in range(ROUNDS):
        now = placed_prefixes()
        # a text whose own bound admits texts of its weight, by chance otherwise
        rank = F.struct(F.col("after") < F.col("total") * (2 * least / (1 + least)), F.xxhash64("node", "shingle", F.lit(k)))
        leaders = now.groupBy("shingle").agg(F.min_by(F.struct("node", "component", "after", "total"), rank).alias("one")).select("shingle", "one.*").select("shingle", *other)
        star = now.select("shingle", *own).join(leaders, "shingle").filter((F.col("xc") != F.col("yc")) & enough)
        star = tables.write(star.select(*edges).distinct().join(pairs, ["u", "v"], "left_anti"), "pairs")
        more = tables.write(verified(star, texts, least), "links")
        if more.isEmpty():
            break
        pairs, links = pairs.unionByName(star), links.unionByName(more)
        joined = tables.write(components(links, tables), "components")

    # then all of other components that share one
    now = placed_prefixes()
    across = now.filter("outside").select("shingle", *own).join(now.select("shingle", "outside", *other), "shingle")
    across = across.filter(F.expr("xc <> yc AND (NOT outside OR x < y)") & enough)
    across = across.select(*edges).distinct().join(pairs, ["u", "v"], "left_anti")
    more = tables.write(verified(across, texts, least), "links")
    if not more.isEmpty():
        joined = tables.write(components(links.unionByName(more), tables), "components")

    grouped = nodes.select("node", "doc_id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = tables.write(grouped, "grouped")
    smallest = tables.write(grouped.groupBy("component").agg(F.min("doc_id").alias("class_id")), "smallest")
    of = grouped.join(smallest, "component").select("node", "component", "class_id")
    out = common.written(rows.select("doc_id", "node").join(of, "node", "left").withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))), "minhash-classes")
    tables.drop()
    return out


def classes(docs: DataFrame, least: float = SIMILAR, bands: int = BANDS, places: int = PLACES) -> DataFrame:
    """doc_id, node and class_id, the smallest doc_id of all texts that links of similarity `least` or more join.

    Texts of the same words are one class whatever their white space.  Rows with a null doc_id and
    texts without words (null ones too) join no class: their class_id is their doc_id, their node
    null.  Rows that repeat a doc_id and text are rows of the same class.
    """
    return _classes(docs, least, bands, places).select("doc_id", "node", "class_id")


def keep(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """One row of each class of `docs`, all columns as they are; rows of no class (see `classes`) all stay.

    It is a row of the smallest doc_id; if the class has several texts of that doc_id, one of the text
    whose hash is smallest.
    """
    own = "_node"
    while own in docs.columns:
        own += "_"
    found = _classes(docs, least).filter("doc_id IS NOT NULL AND node IS NOT NULL")
    kept = found.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("kept")).select(F.col("kept.doc_id").alias(f"{own}doc"), F.col("kept.node").alias(f"{own}text"))
    kept = common.written(kept, "minhash-kept")
    schema = StructType([*docs.schema.fields, StructField(own, BinaryType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = common.utf8(batch.column(batch.schema.get_field_index("text")).cast(pa.string()))
            texts = (raw[off[i] : off[i + 1]].tobytes() for i in range(batch.num_rows))
            nodes = [node_of(t) if t.split() else None for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], names=[*batch.schema.names, own])

    named = docs.mapInArrow(rows, schema)
    in_class = F.col("doc_id").isNotNull() & F.col(own).isNotNull()
    same = (F.col("doc_id").cast("long") == F.col(f"{own}doc")) & (F.col(own) == F.col(f"{own}text"))
    one = named.filter(in_class).join(kept, same, "left_semi").dropDuplicates(["doc_id", own])
    return one.unionByName(named.filter(~in_class)).drop(own)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and whether the document is the one of its class that stays."""
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("stays"))
