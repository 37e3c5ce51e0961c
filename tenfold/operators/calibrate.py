"""Templates from unlabelled glyphs: clusters around leaders, their labels, and a reduced bank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RADIUS, LEAST, MOST = 0.07, 4, 96
ALPHABET = [*map(str, range(10)), *(f"{d}o" for d in range(10)), "X", "/", "-", *map(chr, range(65, 91))]
CLUSTERS = "cluster_id int, exemplar array<float>, centroid array<float>, count long, roles array<string>"


class Leaders:
    """Clusters by their first member, in order of arrival; beyond `most` clusters new shapes are dropped."""

    def __init__(self, radius: float, most: int):
        self.radius, self.most = radius, most
        self.leaders: np.ndarray | None = None
        self.n, self.sums, self.counts, self.roles = 0, [], [], []

    def add(self, vec: np.ndarray, role: str) -> None:
        if self.leaders is None:
            self.leaders = np.empty((self.most, len(vec)), np.float32)
        if self.n:
            d = np.abs(self.leaders[: self.n] - vec).mean(axis=1)
            at = int(d.argmin())
            if d[at] <= self.radius:
                self.sums[at] += vec
                self.counts[at] += 1
                self.roles[at].add(role)
                return
        if self.n < self.most:
            self.leaders[self.n] = vec
            self.n += 1
            self.sums.append(vec.astype(np.float32).copy())
            self.counts.append(1)
            self.roles.append({role})

    def found(self, least: int) -> list[tuple]:
        """Exemplar, centroid, count and roles of clusters of `least` members, the largest first."""
        keep = sorted((i for i in range(self.n) if self.counts[i] >= least), key=lambda i: -self.counts[i])
        return [(self.leaders[i], self.sums[i] / self.counts[i], self.counts[i], sorted(self.roles[i])) for i in keep]


def clusters(glyphs: DataFrame, radius: float = RADIUS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Leader clusters of glyphs (pos, vec, role) in order of pos.

    The result depends on the order of all glyphs, so one task folds them; it streams them from the
    sorted partition and holds `most` leaders only.
    """

    def fold(batches):
        state = Leaders(radius, most)
        for batch in batches:
            for vec, role in zip(batch.column("vec").to_pylist(), batch.column("role").to_pylist()):
                state.add(np.asarray(vec, np.float32), role or "")
        rows = [(k, e.tolist(), c.tolist(), n, r) for k, (e, c, n, r) in enumerate(state.found(least))]
        if rows:
            kinds = [pa.int32(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["cluster_id", "exemplar", "centroid", "count", "roles"])

    role = F.col("role") if "role" in glyphs.columns else F.lit("")
    return glyphs.select("pos", "vec", role.alias("role")).repartition(1).sortWithinPartitions("pos").mapInArrow(fold, CLUSTERS)


def reduced(glyphs: DataFrame, radius: float = 0.05, top: int = 8) -> DataFrame:
    """label, rank and vec: the centroids of each label's `top` largest leader clusters of glyphs (pos, label, vec)."""

    def fold(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        state = Leaders(radius, max(1, table.num_rows))
        for vec in table.sort_by("pos")["vec"].to_pylist():
            state.add(np.asarray(vec, np.float32), "")
        best = state.found(1)[:top]
        return pa.table({"label": pa.array([key[0].as_py()] * len(best), pa.string()), "rank": pa.array(range(1, len(best) + 1), pa.int32()), "vec": pa.array([c.tolist() for _, c, _, _ in best], pa.list_(pa.float32()))})

    return glyphs.select("pos", F.col("label").cast("string").alias("label"), "vec").groupBy("label").applyInArrow(fold, "label string, rank int, vec array<float>")


def carried_labels(found: DataFrame, typed: DataFrame) -> DataFrame:
    """Clusters with the labels typed before (cluster_id, label), blank where none was."""
    return found.join(typed.select("cluster_id", "label"), "cluster_id", "left").withColumn("label", F.coalesce("label", F.lit("")))


def parsed_labels(raw: DataFrame) -> DataFrame:
    """cluster_id and label from rows of JSON text (value), a bad or missing text giving no rows."""
    m = raw.select(F.explode(F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>"))).alias("k", "label"))
    return m.filter(F.col("k").rlike("^[0-9]+$")).select(F.col("k").cast("int").alias("cluster_id"), "label")


def bank(found: DataFrame, typed: DataFrame) -> DataFrame:
    """template_id, label, vec of clusters with a label; blank labels are discarded, one outside the alphabet is an error."""
    label = F.regexp_replace("label", r"^\s+|\s+$", "")
    t = typed.select("cluster_id", label.alias("label")).filter("label <> ''")
    ok = F.col("label").isin(ALPHABET)
    t = t.withColumn("label", F.when(ok, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("label outside the alphabet: "), F.col("label")))))
    return found.join(t, "cluster_id").select(F.col("cluster_id").alias("template_id"), "label", F.col("centroid").alias("vec"))


def labelled(glyphs: DataFrame, expected: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Glyphs paired by position with the expected tokens of their cell, and the cells whose counts differ.

    `glyphs` has cx, ix and vec; `expected` has text.
    """
    from tenfold.functions.throws import tokens

    g = glyphs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cx", "ix", "vec"))).alias("_g"))
    both = g.join(expected.select(*keys, tokens(F.col("text")).alias("_t")), keys)
    even = F.size("_g") == F.size("_t")
    pairs = both.filter(even).select(*keys, F.posexplode(F.arrays_zip(F.col("_g").alias("g"), F.col("_t").alias("t"))).alias("ix", "p"))
    wrong = both.filter(~even).select(*keys, F.size("_g").alias("n_glyphs"), F.size("_t").alias("n_tokens"))
    return pairs.select(*keys, "ix", F.col("p.t").alias("label"), F.col("p.g.vec").alias("vec")), wrong


def top_per_label(rows: DataFrame, label: str, order: list, top: int) -> DataFrame:
    by = Window.partitionBy(label).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
