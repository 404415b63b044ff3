"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

Texts are weighted sets of five-word shingles (weight: occurrences). Each unit of
an element's weight is a region of its own in which hashed darts arrive as a
Poisson process; a dart has a rank (arrival time) and a coordinate. Only darts
earlier than a threshold set by the text's total weight are thrown, the earliest
per coordinate is kept, and texts whose coordinates stay empty throw further. Equal
coordinates then have the weighted Jaccard similarity as their probability.

Texts with equal hash collapse before anything else. Bands of the signatures form
buckets; in each round a bucket's members are compared with its few leaders only,
the nearest by signature, across classes not yet joined. Exact
weighted Jaccard on 48-bit unit hashes confirms a link. Rounds take other leaders until
one adds no link, three at most; they only collapse the large groups. Every text of a bucket that still holds more than one class
is then compared with all such texts of other classes that share a unit among the
rarest of both: a prefix, length and position filter that no similar pair fails.

Defined cases: null, empty and word-free texts are never near duplicates (class =
own doc_id); texts of one to four words have a single shingle; words ignore case
and outer punctuation; long texts are read whole; repeated rows fall into one
class; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomery.llm.columns import fresh
from loomery.llm.components import MOST_BROADCAST, connected_components
from loomery.session import durable, importable, release

BANDS, ROWS, WORDS, SIMILARITY = 20, 4, 5, 0.8
#: Darts that a text throws for its coordinates, and units and darts that a worker holds at once.
DARTS, AT_ONCE = 600, 600_000
#: Leaders of a bucket in each round after the first, which has one.
LEADERS = 3
#: Coordinates of 80 that must agree before a member is compared with a leader; the exact finish has no such test.
LIKELY = 58
#: Parts into which the pairs of one text and the texts of one class are dealt.
SALTS = 16
_OUTER = re.compile(r"^\W+|\W+$")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Maps a white-space chunk to its word's 64-bit hash, 0 where there is no word; bounded memory."""

    def __missing__(self, chunk: str) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        word = _OUTER.sub("", chunk).lower()
        out = (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1) if word else 0
        if len(chunk) < 64:
            self[chunk] = out
        return out


_hashes = WordHashes()


def shingle_units(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of (shingle, occurrence number): the unit regions of the weighted set."""
    chunks = (text or "").split()
    words = np.fromiter(map(_hashes.__getitem__, chunks), np.uint64, len(chunks))
    words = words[words != 0]
    if not len(words):
        return words
    size = min(WORDS, len(words))
    h = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)])
        h.sort()
        first = np.concatenate([[True], h[1:] != h[:-1]])
        starts = np.flatnonzero(first)
        occurrence = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
        return np.sort(mix(h + occurrence.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def dart_signatures(units: np.ndarray, owner: np.ndarray, count: int, k: int) -> np.ndarray:
    """count x k dart ids; texts without units keep zeros."""
    signature = np.zeros((count, k), np.uint64)
    if not len(units):
        return signature
    totals = np.bincount(owner, minlength=count)
    theta = np.where(totals > 0, k * (np.log(k) + 3) / np.maximum(totals, 1), 0.0)
    with np.errstate(over="ignore"):
        while len(units):
            ranks, ids, keys = [], [], []
            x, who, rank, throw = units, owner, np.zeros(len(units)), 0
            while len(x):
                dart = mix(x + np.uint64((throw * 0xA0761D6478BD642F + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))
                rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                early = rank <= theta[who]
                x, who, rank, dart = x[early], who[early], rank[early], dart[early]
                dart = mix(dart)
                ranks.append(rank)
                ids.append(dart)
                keys.append(who * k + (dart % np.uint64(k)).astype(np.int64))
                throw += 1
            order = np.argsort(np.concatenate(ranks))[::-1]
            flat = np.zeros(count * k, np.uint64)
            filled = np.zeros(count * k, bool)
            key = np.concatenate(keys)[order]
            flat[key], filled[key] = np.concatenate(ids)[order], True
            whole = filled.reshape(count, k).all(axis=1)
            done = whole & (totals > 0)
            signature[done] = flat.reshape(count, k)[done]
            totals = np.where(done, 0, totals)
            theta = theta * 2
            more = totals[owner] > 0
            units, owner = units[more], owner[more]
    return signature


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash for each band, its number included."""
    count = len(signature)
    with np.errstate(over="ignore"):
        h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (count, 1))
        for r in range(ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signature.reshape(count, BANDS, ROWS)[:, :, r])
    return h.view(np.int64)


def _signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        at = 0
        while at < len(texts):
            units, size, stop = [], 0, at
            # Units and darts at once bound the memory; however short, a text throws about DARTS of them.
            while stop < len(texts) and size < AT_ONCE:
                units.append(shingle_units(texts[stop]))
                size += len(units[-1]) + DARTS
                stop += 1
            owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
            signature = dart_signatures(np.concatenate(units) if units else np.zeros(0, np.uint64), owner, len(units), BANDS * ROWS)
            bands, sketches = band_hashes(signature), [x.tobytes() for x in signature.astype(np.uint8)]
            lists = [b.tolist() if len(u) else None for b, u in zip(bands, units, strict=True)]
            part = batch.slice(at, stop - at)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "node", "bands", "sketch"])
            at = stop


def pack_units(units: np.ndarray) -> bytes:
    """Distinct units by their low 48 bits, six bytes each in order: among a million of them two would agree by chance once in 500 texts."""
    return np.unique(units & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_units(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view(np.int64).ravel()


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [pack_units(shingle_units(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary())], names=["node", "units"])


def _likely_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sketches x and y, one byte for each coordinate, agree in ``LIKELY`` places."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for i in (2, 3))
        agree = (x == y).sum(axis=1)
        mask = pa.array(agree >= LIKELY, pa.bool_())
        yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(mask) for i in (0, 1)), pa.array(agree, pa.int32()).filter(mask)], names=["a", "b", "agree"])


def _similar_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = unpack_units(x), unpack_units(y)
            if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                keep.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(common >= SIMILARITY * (len(x) + len(y) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])


def _listed_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [unpack_units(u) for u in batch.column(2).to_pylist()]
        sizes = pa.array([len(u) for u in units], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(units, pa.list_(pa.int64()))], names=["text", "class", "n", "units"])


def _left_pairs(now: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes, from all texts of buckets (bucket, node, class) that hold several; no similar pair is left out.

    Units are ordered by their frequency, those of a single class first. With x <= y
    units and 9 common >= 4 (x + y), the first common unit has at least the common
    ones from it on in both texts, so it is among the first ninth of the shorter and
    the first fifth of the longer. Two texts of a unit's largest class never meet.
    """
    mixed = now.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("bucket")
    left = now.join(mixed, "bucket", "left_semi").select("node", "class").distinct()
    # Short numbers instead of hashes, for every unit carries them. Two classes of one number would never meet: a chance of 2^-64 for each pair.
    left = durable(left.select("node", F.xxhash64("class").alias("class"), F.monotonically_increasing_id().alias("text")))
    sent = F.broadcast if left.count() <= MOST_BROADCAST else lambda df: df
    listed = units.join(sent(left), "node").select("text", "class", "units").mapInArrow(_listed_units, "text long, class long, n int, units array<long>")
    held = listed.select("text", "class", "n", F.explode("units").alias("unit"))
    of_class = held.groupBy("unit", "class").agg(F.count("*").cast("int").alias("texts"))
    across = of_class.groupBy("unit").agg(F.sum("texts").alias("texts"), F.count("*").alias("classes"), F.max_by("class", F.struct("texts", "class")).alias("largest")).where("classes > 1")
    text = Window.partitionBy("text")
    place = F.row_number().over(text.orderBy("texts", "unit")) - 1 + F.col("n") - F.count("*").over(text)
    early = durable(held.join(across.drop("classes"), "unit").withColumn("i", place).where("5 * i <= n").select("unit", "text", "class", "n", "i", "largest"))
    # By x_shorter, whether x is the shorter text of the pair or as long; a text may be both.
    sides = lambda longer, shorter: F.explode(F.when(F.expr("9 * i <= n"), F.array(F.lit(longer), F.lit(shorter))).otherwise(F.array(F.lit(longer)))).alias("x_shorter")
    x = early.where("class <> largest").select("unit", sides(False, True), *[F.col(c).alias(f"x_{c}") for c in ("text", "class", "n", "i")])
    y = early.select("unit", sides(True, False), *[F.col(c).alias(f"y_{c}") for c in ("text", "class", "n", "i")])
    near = F.expr("x_class <> y_class AND x_shorter = (x_n <= y_n) AND 9 * (x_n - x_i) >= 4 * (x_n + y_n) AND 9 * (y_n - y_i) >= 4 * (x_n + y_n)")
    met = x.join(y, ["unit", "x_shorter"]).where(near).select(F.least("x_text", "y_text").alias("x"), F.greatest("x_text", "y_text").alias("y")).distinct()
    named = lambda end, side: sent(left.select(F.col("text").alias(end), F.col("node").alias(side)))
    return met.join(named("x", "a"), "x").join(named("y", "b"), "y").select("a", "b")


def _verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (a, b) whose units reach the similarity.

    Units of a travel with each pair; those of b, which may be a leader of many
    pairs, travel once to each of the ``SALTS`` parts that its pairs are dealt to.
    """
    x, y = units.select(F.col("node").alias("a"), F.col("units").alias("x")), units.select(F.col("node").alias("b"), F.col("units").alias("y"))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    few = pairs.count() <= MOST_BROADCAST
    left = x.join(F.broadcast(dealt), "a") if few else dealt.join(x, "a")
    parts = dealt.select("b", "salt").distinct()
    right = y.join(F.broadcast(parts) if few else parts, "b")
    return left.join(right, ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(_similar_rows, "a binary, b binary")


def _class_of_nodes(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, class_id, class_size, keeper) of texts that other rows or texts share a class with."""
    linked = nodes.select("node", "doc_id", "copies", "keeper").join(classes, "node", "left").where("component IS NOT NULL OR copies > 1")
    linked = durable(linked.select("node", "doc_id", "copies", "keeper", F.coalesce("component", "node").alias("component"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt")))
    parts = linked.groupBy("component", "salt").agg(F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"), F.min("keeper").alias("keeper"))
    whole = Window.partitionBy("component")
    totals = parts.select("component", "salt", F.min("doc_id").over(whole).alias("class_id"), F.sum("copies").over(whole).alias("class_size"), F.min("keeper").over(whole).alias("keeper"))
    return linked.select("node", "component", "salt").join(totals, ["component", "salt"]).select("node", "class_id", "class_size", "keeper")


def near_classes(docs: DataFrame, text: str = "text", most_rounds: int = 3) -> DataFrame:
    """One row per document: doc_id, node (hash of its text), class_id (least doc_id of its class), class_size, keeps."""
    importable(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("node"), F.col(text).cast("string").alias("text"))
    signed = durable(keyed.mapInArrow(_signed_rows, "doc_id long, node binary, bands array<long>, sketch binary"))
    keeper = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("node"))
    of_text = (F.first(F.struct("bands", "sketch")).alias("signed"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min(keeper).alias("keeper"))
    nodes = durable(signed.where("bands IS NOT NULL").groupBy("node").agg(*of_text).select("node", "signed.*", "doc_id", "copies", "keeper"))
    banded = nodes.select("node", "sketch", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("bucket", "low")
    members = durable(banded.join(buckets, "bucket"))
    # Unit hashes of the texts that share a bucket; one document stands for each text.
    stand = nodes.select("doc_id", "node").join(members.select("node").distinct(), "node", "left_semi")
    shared = keyed.alias("k").join(stand.alias("s"), F.col("k.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("k.node") == F.col("s.node")), "left_semi")
    units = durable(shared.select("node", "text").mapInArrow(_unit_rows, "node binary, units binary").dropDuplicates(["node"]))
    classes = None
    of_buckets = lambda: members.select("bucket", "node", "sketch").join(classes, "node", "left").select("bucket", "node", "sketch", F.coalesce("component", "node").alias("class"))
    joined = lambda found: connected_components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    for turn in range(most_rounds):
        if turn == 0:
            pairs = members.groupBy("node").agg(F.min("low").alias("b")).select(F.col("node").alias("a"), "b").where("a <> b")
        else:
            now = of_buckets()
            # Several leaders a round: members far from one may be near another. Only pairs whose signatures look near are worth an exact look here.
            leaders = F.array(*[F.min_by(F.struct("node", "class", "sketch"), F.xxhash64("node", F.lit(turn * LEADERS + j), "bucket")) for j in range(LEADERS)])
            mixed = now.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most"), leaders.alias("leaders")).where("least <> most")
            met = now.join(mixed.select("bucket", F.array_distinct("leaders").alias("leaders")), "bucket")
            apart = met.select("node", "class", "sketch", F.explode("leaders").alias("leader")).where(F.col("class") != F.col("leader.class"))
            sides = apart.select(F.col("node").alias("a"), F.col("leader.node").alias("b"), F.col("sketch").alias("x"), F.col("leader.sketch").alias("y"))
            likely = sides.mapInArrow(_likely_rows, "a binary, b binary, agree int")
            # A list holds at most LEADERS for each band.
            nearest = F.slice(F.sort_array(F.collect_set(F.struct("agree", "b")), asc=False), 1, LEADERS)
            pairs = likely.groupBy("a").agg(nearest.alias("near")).select("a", F.explode("near.b").alias("b"))
        release(docs.sparkSession)
        found = durable(_verified(durable(pairs), units))
        if turn and found.isEmpty():
            break
        classes = joined(found) if turn else connected_components(found)
    release(docs.sparkSession)
    left = durable(_left_pairs(of_buckets(), units))
    release(docs.sparkSession)
    found = durable(_verified(left, units))
    if not found.isEmpty():
        classes = joined(found)
    release(docs.sparkSession)
    shared = durable(_class_of_nodes(classes, nodes))
    out = signed.select("doc_id", "node").join(shared, "node", "left")
    keeps = F.col("keeper").isNull() | ((F.col("keeper.node") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")))
    return out.select("doc_id", "node", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), keeps.alias("keeps"))


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each class stays, with all its columns; texts without words all stay."""
    # One key for join and row number: a single shuffle of the texts serves both.
    key_name, nth_name = fresh(docs.columns, "near_key", "nth")
    key = lambda node: F.concat(node, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    keepers = near_classes(docs, text).where("keeps").select(key(F.col("node")).alias(key_name)).dropDuplicates()
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    kept = docs.withColumn(key_name, key(F.unhex(F.md5(body)))).join(keepers, key_name, "left_semi")
    nth = F.row_number().over(Window.partitionBy(key_name).orderBy(key_name))
    once = kept.withColumn(nth_name, nth).where((F.col(nth_name) == 1) | ~F.coalesce(F.col(text).rlike(r"(?U)\w"), F.lit(False)))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
