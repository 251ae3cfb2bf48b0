"""Near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles; two documents are linked at
a Jaccard similarity of 3/4 or more. Documents of equal sets are one class
from the start. Among classes:

1. A sketch keeps the SKETCH least hashes of the set. Linked sets share at
   least `SURE_OVERLAP` of them (surely if both sets are whole in their
   sketches, else but for a chance of about 1e-8).
2. Inverted lists of retained values generate overlaps. A class enters only
   the lists of its rarest values, so many that two classes of that overlap
   still meet in one: values of widespread passages make no lists of their own.
3. Lists with the same least member are one block, so that a group whose
   members share many values is looked at once. A block over TILE members is
   dealt to tiles, each with the least member; who is joined to that needs no
   look at others who are, so only the rest of a tile meets the other tiles.
4. In a block the sketch of the union estimates similarities. What may reach
   3/4 is verified on the whole sets, likeliest first, unless links found
   before join the two already: a block yields no more links than members.
   Components of the links are the groups.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import WordHashes, bounded_batches, forget, materialize, mix, per_row, slices, slim

WORDS = 5
SIMILAR = (75, 100)
SKETCH = 64
#: Binomial(64, 3/4) is below 27 with a chance under 1e-8.
SURE_OVERLAP = 27
#: The union's sketch holds no more shared values than both sketches do: an estimate under this has the overlap's chance.
SURE_ESTIMATE = SURE_OVERLAP / SKETCH
#: Linked sketches, as sets, are at least this similar: 27 shared of 64 and 64.
LEAST_FIRST = SURE_OVERLAP / (2 * SKETCH - SURE_OVERLAP)
#: A tile has about so many members, and so many bytes of whole sets, at most.
TILE = 512
TILE_BYTES = 16 << 20
#: Small blocks go to Python together, about so many rows and bytes at a time.
ROWS_PER_CALL = 2000
BYTES_PER_CALL = 4 << 20
#: A table of ids of up to this many rows may be broadcast.
BROADCAST_ROWS = 500_000


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The set, as ascending 64-bit hashes; a shorter text is one shingle, one without words is empty."""
    words = hashes.of(text)
    if not len(words):
        return words
    if len(words) < WORDS:
        return mix(np.array([int.from_bytes(blake2b(words.tobytes(), digest_size=8, person=b"short").digest(), "little")], np.uint64))
    n = len(words) - WORDS + 1
    folded = np.zeros(n, np.uint64)
    for i in range(WORDS):
        folded = mix(folded ^ words[i : i + n]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mix(folded))


def signature(found: np.ndarray) -> bytes | None:
    """What equal sets share; None for the empty set."""
    return blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two ascending sets reaches SIMILAR."""
    if min(len(a), len(b)) * SIMILAR[1] < max(len(a), len(b)) * SIMILAR[0]:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * SIMILAR[1] >= (len(a) + len(b) - shared) * SIMILAR[0]


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, sig, sketch) of every whole text."""

    def start():
        hashes = WordHashes()

        def of(doc_id, text, key):
            found = shingles(text, hashes)
            return doc_id, key, len(found), signature(found), found[:SKETCH].view(np.int64)

        return of

    rows = slim(docs).withColumn("text_hash", F.xxhash64("text"))
    return per_row(rows, start, _SKETCHED, "doc_id long, text_hash long, n_shingles long, sig binary, sketch array<long>")


def lists(classes: DataFrame) -> DataFrame:
    """(v, id): the inverted lists of at least two members, each class in those of its rarest values."""
    postings = classes.select("id", F.explode("sketch").alias("v"))
    shared = postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    common = postings.join(shared, "v").join(classes.select("id", F.col("n_shingles").alias("n"), F.size("sketch").alias("k")), "id")
    own = Window.partitionBy("id")
    least = F.least(F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]), F.lit(SURE_OVERLAP))
    # values of no other class are rarer than all others: they come first
    rank = F.row_number().over(own.orderBy("df", "v")) + F.col("k") - F.count(F.lit(1)).over(own)
    return common.withColumn("rank", rank).where(F.col("rank") <= F.col("k") - least + 1).select("v", "id")


def blocks(members: DataFrame) -> DataFrame:
    """(head, id): for the least member of each list, all that share such a list with it, itself included."""
    heads = members.groupBy("v").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return members.join(heads, "v").select("head", "id").distinct()


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, members) of the documents with the wanted doc_ids, members as bytes of ascending hashes."""
    texts = slim(docs).join(_small(wanted), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")

    def run(batches):
        hashes = WordHashes()
        for part in (p for batch in batches for p in slices(batch)):
            sets = [s for s in (shingles(t, hashes) for t in part.column(0).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "members"])

    return texts.mapInArrow(run, "sig binary, members binary")


def _sketch_similarities(sketches: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of every two sketches as sets: a first look, without their union's order."""
    lengths = np.array([len(s) for s in sketches])
    _, where, counts = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    useful = counts > 1
    column = np.cumsum(useful) - 1
    keep = useful[where]
    has = np.zeros((len(sketches), int(useful.sum())), np.float32)
    has[np.repeat(np.arange(len(sketches)), lengths)[keep], column[where[keep]]] = 1
    shared = has @ has.T
    return shared / (lengths[:, None] + lengths - shared)


def union_estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity as the bottom SKETCH of two sketches' union shows it; exact if both sets are whole in theirs."""
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~twice])][:SKETCH]
    return float(np.count_nonzero(both[1:][twice] <= union[-1]) / len(union))


def likely_pairs(sizes: np.ndarray, sketches: list[np.ndarray], sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may be linked as sizes and sketches go, and how alike the sketches are; given sides, only pairs across."""
    first = _sketch_similarities(sketches)
    near = np.minimum(sizes[:, None], sizes) * SIMILAR[1] >= np.maximum(sizes[:, None], sizes) * SIMILAR[0]
    likely = np.triu(near & (first >= LEAST_FIRST), 1)
    if sides is not None:
        likely &= sides[:, None] != sides
    return likely, first


def block_links(block: pd.DataFrame, sides: np.ndarray | None = None) -> tuple[list[tuple], list[int]]:
    """Verified links that join what can be joined in a block, and each row's root by them; given sides, only pairs across."""
    ids = block["sig"].to_list()
    sets = [np.frombuffer(m, np.uint64) for m in block["members"]]
    sketches = [x[:SKETCH] for x in sets]
    likely, first = likely_pairs(np.array([len(x) for x in sets]), sketches, sides)
    left, right = np.nonzero(likely)
    order = np.argsort(-first[left, right], kind="stable")
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        a, b = root(i), root(j)
        if a == b or union_estimate(sketches[i], sketches[j]) < SURE_ESTIMATE:
            continue
        if similar(sets[i], sets[j]):
            parent[max(a, b)] = min(a, b)
            found.append((ids[i], ids[j]))
    return found, [root(i) for i in range(len(ids))]


def _within_tiles(group: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of links, and (head, id, tile, tiles) of members of tiled blocks that their tile does not join to the head."""
    links, apart = [], []
    for head, block in group.groupby("head", sort=True):
        if len(block) > 1:
            block = block.sort_values("sig")
            found, roots = block_links(block)
            links += found
            if block["tiles"].iloc[0] > 1:
                at_head = roots[block["id"].to_list().index(head)]
                apart += [(head, *row) for row, r in zip(block[["id", "tile", "tiles"]].itertuples(index=False, name=None), roots, strict=True) if r != at_head]
    rows = [(a, b, None, None, None, None) for a, b in links] + [(None, None, *row) for row in apart]
    return pd.DataFrame(rows, columns=["a", "b", "head", "id", "tile", "tiles"], dtype=object)


def _likely_across(group: pd.DataFrame) -> pd.DataFrame:
    """Of the rest of a block and the members of one tile those that sketches leave a partner on the other side."""
    sides = group["rest"].to_numpy()
    hit = np.zeros(len(group), bool)
    if sides.any() and not sides.all():
        likely, _ = likely_pairs(group["n_shingles"].to_numpy(), group["sketch"].to_list(), sides)
        hit = likely.any(axis=0) | likely.any(axis=1)
    return group.loc[hit, ["head", "part", "tile", "rest", "sig"]]


def _across_tiles(group: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of links between the rest of a block and the members of one tile."""
    sides = group["rest"].to_numpy()
    found = []
    if sides.any() and not sides.all():
        block = group.sort_values(["rest", "sig"])
        found, _ = block_links(block, block["rest"].to_numpy())
    return pd.DataFrame(found, columns=["a", "b"], dtype=object)


def _small(table: DataFrame) -> DataFrame:
    """The table, broadcast if it is of up to BROADCAST_ROWS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def verified_links(paired: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) by sig: links, verified on whole sets, whose components are those of all links."""
    bounded_batches(docs.sparkSession)
    needed = paired.select("id").distinct()
    wanted = materialize(classes.join(needed, "id", "left_semi").select(F.col("doc_id").alias("wanted")).distinct(), "wanted")
    sets = materialize(whole_sets(docs, wanted).dropDuplicates(["sig"]), "sets")
    sized = paired.join(classes.select("id", (F.col("n_shingles") * 8).alias("bytes")), "id")
    sizes = materialize(sized.groupBy("head").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes")), "sizes")
    rows, whole = sizes.agg(F.sum("size"), F.sum("bytes")).first()
    tiles = F.ceil(F.greatest(F.col("size") / TILE, F.col("bytes") / TILE_BYTES)).cast("int").alias("tiles")
    tiled = paired.join(sizes.select("head", tiles), "head")
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    every_tile = F.sequence(F.lit(0), F.col("tiles") - 1)
    calls = max(1, (rows or 0) // ROWS_PER_CALL, (whole or 0) // BYTES_PER_CALL)
    call = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("head"), F.lit(calls))).otherwise(F.col("head"))
    places = F.when(F.col("id") == F.col("head"), every_tile).otherwise(F.array("tile"))
    dealt = tiled.select("head", "id", "tiles", call.alias("call"), F.explode(places).alias("tile"))
    filled = dealt.join(classes.select("id", "sig"), "id").join(sets, "sig")
    inside = filled.groupBy("call", "tile").applyInPandas(_within_tiles, "a binary, b binary, head long, id long, tile int, tiles int")
    inside = materialize(inside, "inside")
    links = inside.where(F.col("a").isNotNull()).select("a", "b")
    apart = inside.where(F.col("id").isNotNull()).select("head", "id", "tile", "tiles")
    if apart.limit(1).count():
        weighed = apart.join(classes.select("id", (F.col("n_shingles") * 8).alias("bytes")), "id")
        parts = weighed.groupBy("head").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("bytes") / TILE_BYTES)).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64(F.lit("rest"), "id"), F.col("parts")).cast("int")
        others = F.array_remove(every_tile, F.col("tile"))  # its own tile it has met
        rest = apart.join(parts, "head").select("head", part.alias("part"), F.explode(others).alias("tile"), "id", F.lit(True).alias("rest"))
        each_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        met = tiled.join(parts, "head").select("head", each_part.alias("part"), "tile", "id", F.lit(False).alias("rest"))
        both = materialize(rest.union(met), "rest")
        pairs = _small(both).join(classes.select("id", "sig", "n_shingles", "sketch"), "id")
        likely = pairs.groupBy("head", "part", "tile").applyInPandas(_likely_across, "head long, part int, tile int, rest boolean, sig binary")
        likely = materialize(likely, "likely")
        across = _small(likely).join(sets, "sig").groupBy("head", "part", "tile").applyInPandas(_across_tiles, "a binary, b binary")
        links = links.union(materialize(across, "across"))
        forget(both, likely)
    forget(wanted, sets, sizes)
    return links


def components(links: DataFrame) -> DataFrame:
    """(sig, label) of every class in a link; label is the least class of its component.

    Each round takes the least label among neighbours, then the label's own
    label, which halves long chains. Nothing but a count comes to the driver.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("sig")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("sig").alias("b"), "label"), "b").groupBy(F.col("a").alias("sig")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "sig").select("sig", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("sig").alias("label"), F.col("label").alias("further"))
        stepped = lower.join(jump, "label").select("sig", "was", F.least("label", "further").alias("label"))
        new = materialize(stepped, "labels")
        moved = new.where(F.col("label") != F.col("was")).limit(1).count()
        forget(labels)
        labels = new.select("sig", "label")
        if not moved:
            forget(edges)
            return labels


def grouped(docs: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(doc_id, text_hash, n_shingles, label, component_id) of every row, and the tables that it reads.

    label is null for texts without words.
    """
    base = materialize(sketched(docs), "sketched")
    full = base.where(F.col("sig").isNotNull())
    least_id = full.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    held = full.select("sig", "n_shingles", "sketch").dropDuplicates(["sig"])
    # a class goes by 64 bits of its sig where only candidates are made; two of the same would both be candidates
    classes = materialize(held.join(least_id, "sig").withColumn("id", F.xxhash64("sig")), "classes")
    members = materialize(lists(classes), "lists")
    paired = materialize(blocks(members), "blocks")
    near = verified_links(paired, classes, docs)
    labels = components(near)
    label = F.coalesce("label", "sig")
    named = classes.select("sig", "doc_id").join(labels, "sig", "left").withColumn("label", label)
    # written, so that the join deals both sides anew and a hot label's part can be split
    named = materialize(named, "named")
    least = materialize(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    placed = materialize(named.join(least, "label").select("sig", "label", "component_id"), "placed")
    forget(classes, members, paired, near, labels, named, least)
    slimmed = base.select("doc_id", "text_hash", "n_shingles", "sig")
    columns = ("doc_id", "text_hash", "n_shingles", "label", "component_id")
    found = slimmed.where(F.col("sig").isNotNull()).join(placed, "sig").select(*columns)
    alone = slimmed.where(F.col("sig").isNull()).withColumn("label", F.lit(None).cast("binary")).withColumn("component_id", F.col("doc_id"))
    return found.union(alone.select(*columns)), (base, placed)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    A null text, or one without words, has no set and is alone. Rows of equal
    sets, repeated rows too, are one class. component_id is the least doc_id of
    the component, null only if all its doc_ids are; kept marks the rows whose
    doc_id that is. An empty table gives no rows.
    """
    found = grouped(docs)[0].select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, same columns, with one row of each component: its least doc_id (null last, ties by a hash of the text).

    Null texts and texts without words stay, repeated or not; of repeated rows
    with words one stays. Other columns pass through; an empty table gives no
    rows.
    """
    found, read = grouped(docs)
    rows = materialize(found.where(F.col("label").isNotNull()).select("doc_id", "text_hash", "label"), "rows")
    forget(*read)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    chosen = materialize(rows.groupBy("label").agg(F.min(order).alias("kept")), "chosen")
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    gone = materialize(rows.join(chosen, "label").where(~same).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct(), "gone")
    again = rows.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_text"))
    again = materialize(again, "again")
    forget(rows, chosen)
    row = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    left = row.join(_small(gone), F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_text")), "left_anti")
    if again.limit(1).count():  # rows of equal doc_id and text: one of them stays too
        again = _small(again)
        is_again = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("text_hash") == F.col("again_text"))
        twins = left.join(again, is_again, "left_semi").dropDuplicates(["doc_id", "text_hash"])
        left = left.join(again, is_again, "left_anti").union(twins)
    return left.select("row.*")
