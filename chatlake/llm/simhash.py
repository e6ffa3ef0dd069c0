"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``distance`` bits have a common variant within half of it
of both. So every distinct fingerprint emits its ball of that radius, the
variants are shuffled, and neighbours under one variant are linked: consecutive
ones in sorted order, which connects all that share it without listing pairs.
Links are deduplicated and their distance is verified; what they reach is found
by star contraction, whose state stays in tables.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import cols, fresh, same, written
from chatlake.session import ship_package

#: Bytes to bytes: A-Z to lower case.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64 bits of a UTF-8 text: bit b is set if over half of the shingles'
    XXH64 hashes (seed 42) have it; 0 for a text without words."""
    import numpy as np
    import xxhash

    words = text.translate(_LOWER).split()      # bytes split at ASCII white space
    if not words:
        return 0
    flat, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        hashes = [hash_(flat, 42)]
    else:
        hashes = [hash_(flat[a:z - 1], 42) for a, z in zip(ends, ends[shingle:])]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t or b"", shingle) for t in b.column(b.num_columns - 1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*b.schema.names[:-1], "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) for each row, as a written table; fp is the
    fingerprint's 64 bits as a signed long, text_hash tells rows of one id apart."""
    ship_package(docs.sparkSession)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(id_.alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    kind = docs.select(id_).schema[0].dataType.simpleString()
    return written(rows.mapInArrow(_fingerprints(shingle), f"doc_id {kind}, text_hash long, fp long"), "simhash-fp")


def ball(radius: int) -> list[int]:
    """The XOR masks, as signed longs, of all fingerprints within ``radius`` bits."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) with a < b: verified links that connect all of the distinct ``fp``
    that are within ``distance`` bits of one another. The ball of half the
    distance, rounded up, is complete for odd distances too."""
    masks = F.array(*[F.lit(m) for m in ball((distance + 1) // 2)])
    variants = distinct.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    # with an odd distance a variant can join two that are too far apart, and then
    # a chain of neighbours would not do: link by the ball's own pairs there
    if distance % 2:
        other = variants.select(F.col("fp").alias("b"), "variant")
        pairs = variants.select(F.col("fp").alias("a"), "variant").join(other, "variant").where("a < b")
    else:
        last = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
        pairs = variants.select(last.alias("a"), F.col("fp").alias("b")).where("a IS NOT NULL")
    return pairs.select("a", "b").distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of (a, b): root is the smallest node reachable.

    Alternating large and small stars; each round is written, and the rounds end
    when one changes nothing. Only sums come to the driver.
    """
    edges = written(edges, "simhash-edges")
    before = None
    while True:
        # large star: the larger neighbours of a node go to its smallest
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = (both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a < b").distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = (large.join(low, "b").select(F.col("low"), F.explode(F.array("a", "b")).alias("node"))
                 .where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
        edges = written(small, "simhash-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def classes(fps: DataFrame, distance: int = 2) -> DataFrame:
    """(doc_id, text_hash, fp) to those with root, the class's smallest
    fingerprint, and component_id, its smallest id. Equal fingerprints are one
    node, however many rows have them; the last join has a table on either side,
    so that Spark can split a fingerprint that many rows share."""
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(own.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = written(own.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(written(rooted.join(least, "root").drop("least"), "simhash-classes"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest id reachable over links, its own included.

    NULL and wordless texts have fingerprint 0 and are linked like any other.
    NULL ids count as no id: a class of them alone has a NULL component_id.
    """
    rows = classes(fingerprints(docs, shingle, id_col, text_col), distance)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class left: the one of smallest id (NULL
    ids last, then the text's hash decides). Columns stay as they are."""
    rows = classes(fingerprints(docs, shingle, id_col, text_col), distance)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("k")
    id_, hash_, here, number = fresh(docs, "id", "hash", "here", "number")
    keep = rows.groupBy("root").agg(first).select(F.col("k.doc_id").alias(id_), F.col("k.text_hash").alias(hash_))
    own = docs.withColumn(here, F.xxhash64(F.col(f"`{text_col}`")))
    kept = own.join(keep, same(F.col(f"`{id_col}`"), F.col(id_)) & (F.col(here) == F.col(hash_)))
    # equal rows may repeat: one of them
    one = Window.partitionBy(f"`{id_col}`", here).orderBy(F.lit(0))
    return kept.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).select(cols(docs))
