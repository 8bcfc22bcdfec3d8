"""MinHash near-duplicate detection with fast similarity sketching.

A document's set holds its distinct five-word shingles (64-bit hashes). Its sketch has T coordinates and is filled in
rounds: in round i < T every element goes to one hashed bin with a value that starts with i; in round T + j every
element goes to bin j. The smallest value in a bin is its coordinate, so the first rounds fill most bins with one hash
per element, and the last T rounds guarantee that every bin fills, with the concentration of T independent trials.
Documents whose sketches agree in all coordinates of a band are candidates; candidates are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferweave.llm.common import materialize, rows_of, ship_package, table, worker_memo

#: Coordinates and bands: a pair at the bound of 0.75 shares no band with probability (1 - 0.75^4)^32, about 5 in a million.
T, BANDS = 128, 32
ROWS = T // BANDS
#: Candidates carry a second sketch of so many coordinates, a byte each. A pair of similarity 0.75 agrees in fewer than
#: LEAST of them with a probability under one in a million (5 standard deviations); others are verified on full sets.
FINE = 1024
LEAST = int(FINE * (0.75 - 5 * (0.75 * 0.25 / FINE) ** 0.5))
#: Members of a bucket are compared in blocks of about so many.
BLOCK = 1024
#: Up to so many candidate ids (8 bytes each) are broadcast to filter the documents; above, the ids are joined by shuffle.
BROADCAST_IDS = 1_000_000
WORDS_A_SHINGLE = 5
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class WordHashes(dict):
    """64-bit hashes of words; at most so many stay."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes() -> WordHashes:
    return worker_memo("word hashes", WordHashes)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; with fewer than five words one hash of all of them; without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, U64)
    h = np.array(list(map(word_hashes().__getitem__, words)), dtype=U64)
    k = min(WORDS_A_SHINGLE, len(h))
    out = np.full(len(h) - k + 1, k, U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """One row of t coordinates per non-empty set (t is 1024 at most)."""
    n, none = len(sets), np.iinfo(U64).max
    out = np.full(n * t, none, U64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets) if n else np.empty(0, U64)
    todo = n
    with np.errstate(over="ignore"):
        for i in range(2 * t if n else 0):
            h = mix(values + U64(0x9E3779B97F4A7C15) * U64(2 * i + 1))
            bins = (h % U64(t)).astype(np.int64) if i < t else np.full(len(h), i - t, np.int64)
            # the round in the top bits, the rest of the hash below
            np.minimum.at(out, owner * t + bins, (U64(i) << U64(53)) | (mix(h) >> U64(11)))
            missing = (out.reshape(n, t) == none).any(axis=1)
            if not missing.any():
                break
            if missing.sum() < todo:
                todo = missing.sum()
                keep = missing[owner]
                owner, values = owner[keep], values[keep]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key per band."""
    rows = sketch.reshape(len(sketch), BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93), rows.shape[:2])
        for r in range(ROWS):
            key = mix(key * U64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key


def chunks(columns: tuple, size: int = 400_000) -> Iterator[list[tuple]]:
    """Rows (id, text), some characters at a time."""
    out, n = [], 0
    for row in zip(*columns, strict=True):
        out.append(row)
        n += len(row[1] or "")
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (a 128-bit digest of the set) and bands (array<bigint>, empty for the empty set)."""

    def run(batches):
        import pyarrow as pa

        for columns in rows_of(batches, "doc_id", "text"):
            for rows in chunks(columns):
                sets = [shingles(t) for _, t in rows]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(sketches([sets[i] for i in full])).view(np.int64)
                offsets = np.cumsum([0, *(BANDS * bool(len(s)) for s in sets)], dtype=np.int32)
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """rep, set (sorted 64-bit hashes), fine (the second sketch) and bands (the band keys) of documents (doc_id, text) with a set that isn't empty."""

    def run(batches):
        import pyarrow as pa

        for columns in rows_of(batches, "doc_id", "text"):
            for rows in chunks(columns):
                rows = [(i, s) for i, t in rows if len(s := shingles(t))]
                fine = (mix(sketches([s for _, s in rows], FINE)) >> U64(56)).astype(np.uint8)
                bands = band_keys(sketches([s for _, s in rows]))
                columns_out = [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in ((s for _, s in rows), fine, bands)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), *columns_out], names=["rep", "set", "fine", "bands"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "rep bigint, set binary, fine binary, bands binary")


def joined_on_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with column of a and of b as x and y."""
    left = sets.select(F.col("rep").alias("a"), F.col(column).alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b")


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose second sketches agree in LEAST coordinates or more."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, FINE) for c in "xy")
            keep = pa.array((x == y).sum(axis=1) >= LEAST)
            yield batch.select(["a", "b"]).filter(keep)

    return joined_on_both(pairs, sets, "fine").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs that the full sets confirm: 100 * intersection >= percent * union."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(*next(rows_of([batch], "x", "y")), strict=True):
                n, m = len(x) // 8, len(y) // 8
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(np.frombuffer(x, U64), np.frombuffer(y, U64), assume_unique=True))
                keep.append(100 * common >= percent * (n + m - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined_on_both(pairs, sets, "set").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, comp (the smallest node of its component) for the nodes of links (a, b), by alternating large and small stars.

    Each half round is a minimum per node (combined before the shuffle) and a join; rounds grow with the logarithm of
    the longest chain. Edges are written to the shared folder each round.
    """
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def within_buckets(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Likely pairs of different components that share a bucket; the buckets are compared block by block, on second sketches.

    members: key, m (size of the bucket), rep. Only buckets with several components are looked at. A block pair holds
    at most some 2 x BLOCK members, however large the bucket is. Two documents are compared in the bucket of the first
    band they share, and so once.
    """
    labelled = materialize(members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "labelled")
    open_ = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = labelled.join(open_, "key").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "comp")
    rows = dealt.join(sets.select("rep", "fine", "bands"), "rep")

    def compare(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rep")
        rep, comp, part = (pdf[c].to_numpy() for c in ("rep", "comp", "part"))
        fine = np.frombuffer(b"".join(pdf["fine"]), np.uint8).reshape(-1, FINE)
        bands = np.frombuffer(b"".join(pdf["bands"]), np.int64).reshape(-1, BANDS)
        band = int(np.argmax(bands[0] == pdf["key"].iat[0]))
        across = pdf["i"].iat[0] != pdf["j"].iat[0]
        out_a, out_b = [], []
        for k in range(len(rep) - 1):
            ok = comp[k + 1 :] != comp[k]
            if across:
                ok &= part[k + 1 :] != part[k]
            rest = np.flatnonzero(ok) + k + 1
            rest = rest[(bands[rest, : band + 1] == bands[k, : band + 1]).argmax(axis=1) == band]
            rest = rest[(fine[rest, :128] == fine[k, :128]).sum(axis=1) >= 64]
            rest = rest[(fine[rest] == fine[k]).sum(axis=1) >= LEAST]
            out_a.append(np.full(len(rest), rep[k]))
            out_b.append(rep[rest])
        return pd.DataFrame({"a": np.concatenate(out_a) if out_a else np.empty(0, np.int64), "b": np.concatenate(out_b) if out_b else np.empty(0, np.int64)})

    return rows.groupBy("key", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def repeated_ids(found: DataFrame, classes: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The doc_ids whose rows have different sets, and the links (a, b) between each and the classes of its sets; None where there are none."""
    digest = ["n_shingles", "d1", "d2"]
    named = found.where("doc_id IS NOT NULL")
    several = F.min(F.struct(*digest)).alias("lo"), F.max(F.struct(*digest)).alias("hi")
    again = materialize(named.groupBy("doc_id").agg(*several).where("lo != hi").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return None, None
    links = named.join(again, "doc_id").where("n_shingles > 0").join(classes, digest).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    return again, materialize(links, "repeated-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for docs (doc_id, text).

    Two documents are linked if 100 * |A & B| >= 75 * |A | B| for their sets of five-word shingles; component_id is the
    smallest doc_id reachable over links. Documents of equal sets are one class, which its smallest doc_id stands for.
    Classes that share a band are candidates: first each with the smallest of its bucket; then, in buckets where several
    components remain, the pairs of different components. No pair within a component is made, none across is left out.

    Null or blank texts have the empty set and are linked with nothing. Rows that share a doc_id count as one node (each
    keeps its own n_shingles): it is linked with whatever one of its texts is linked with, and all its rows have one
    component_id. A row without doc_id stays by itself: its component_id is null and it is kept. An empty table gives
    an empty table.
    """
    ship_package(docs.sparkSession)
    found = materialize(sketch_documents(docs), "sketches")
    digest = ["n_shingles", "d1", "d2"]
    named = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(named.groupBy(*digest).agg(F.min("doc_id").alias("rep")), "classes")

    bands = named.join(classes, digest).where("doc_id = rep").select("rep", F.explode("bands").alias("key")).distinct()
    bands = materialize(bands, "bands")
    buckets = bands.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("leader")).where("m > 1")
    members = materialize(bands.join(buckets, "key"), "members")
    ids = materialize(members.select("rep").distinct(), "candidates")
    n_ids = ids.count()
    chosen = ids.withColumnRenamed("rep", "doc_id")
    sets = materialize(full_sets(docs.select(F.col("doc_id").cast("bigint"), "text").join(F.broadcast(chosen) if n_ids <= BROADCAST_IDS else chosen, "doc_id", "left_semi")), "sets")

    stars = members.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialize(verified(materialize(likely(stars, sets), "likely"), sets), "links")
    again, same = repeated_ids(found, classes)
    links = links.union(same) if same is not None else links
    labels = materialize(connected_components(links), "labels")
    more = verified(materialize(within_buckets(members.select("key", "m", "rep"), labels, sets), "likely"), sets)
    labels = materialize(connected_components(links.union(materialize(more, "links"))), "labels")

    of_class = materialize(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*digest, F.coalesce("comp", "rep").alias("component_id")), "components")
    out = found.drop("bands").join(of_class, digest, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    if again is not None:
        shared = labels.join(again.withColumnRenamed("doc_id", "node"), "node").select(F.col("node").alias("doc_id"), F.col("comp").alias("_comp"))
        out = out.join(shared, "doc_id", "left")
        component = F.coalesce("_comp", component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: five words, similarity 0.75."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
