"""Operator 8: classes of near duplicates by BagMinHash bands and exact multiset overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logloom.functions.checkpoints import saved, stored
from logloom.llm.bagminhash import bags, signatures
from logloom.llm.common import rows, text_slices, whole_runs
from logloom.llm.components import components
from logloom.llm.textvec import mix, ragged, shingle_hashes, slices

BANDS, ROWS = 32, 6
NO_ID = -(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
Pairs = tuple[np.ndarray, np.ndarray]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[F.Column, F.Column]:
    """The id with null as the least long, and the 16 bytes that name a text; a null text counts as empty."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), F.unhex(F.md5(text))


def band_hashes(texts: list[str], words: int, bands: int, per_band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bands of each text, a byte of each of its places, and the number of its shingles."""
    shingle, doc, _ = shingle_hashes(texts, words)
    element, owner, count = bags(shingle, doc)
    places = signatures(element, owner, count, len(texts), bands * per_band).reshape(-1, bands, per_band)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), places.shape[:2]).copy()
    for k in range(per_band):
        out = mix(out * _STEP + places[:, :, k])
    return out.view(np.int64), (mix(places) >> np.uint64(56)).astype(np.uint8).reshape(len(texts), -1), np.bincount(doc, minlength=len(texts))


def nodes_of(docs: DataFrame, words: int, bands: int, per_band: int, id_col: str, text_col: str) -> DataFrame:
    """(node, key, rid, total, sign): a row for each different text, rid being its least id; sign holds its bands and then its places."""
    rid, key = keyed(docs, id_col, text_col)
    schema = pa.schema([("key", pa.binary()), ("rid", pa.int64()), ("total", pa.int64()), ("sign", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches, 400_000):
            first: dict[bytes, tuple[int, int]] = {}
            for i, x in enumerate(ids):  # copies in a slice are signed once
                k = bytes(x["key"])
                first[k] = min(first.get(k, (x["rid"], i)), (x["rid"], i))
            hashes, places, total = band_hashes([texts[i] for _, i in first.values()], words, bands, per_band)
            yield rows(schema, list(first), [r for r, _ in first.values()], total, [h.tobytes() + p.tobytes() for h, p in zip(hashes, places, strict=True)])

    texts = docs.select(F.struct(rid.alias("rid"), key.alias("key")).alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    signed = texts.mapInArrow(run, "key binary, rid long, total long, sign binary")
    one = signed.groupBy("key").agg(F.min("rid").alias("rid"), F.max("total").alias("total"), F.max("sign").alias("sign"))
    return saved(one.withColumn("node", F.monotonically_increasing_id()))


def texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the wanted nodes: the one pass that moves texts. Its key has the id too, so copies lie apart."""
    rid, key = keyed(docs, id_col, text_col)
    named = nodes.select("node", "key", "rid").join(wanted, "node").select("node", "key", "rid")
    texts = docs.select(key.alias("key"), rid.alias("rid"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return saved(texts.join(named.hint("shuffle_hash"), ["key", "rid"]).select("node", "text"))


def connected(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> Pairs:
    """For links between the rows i and j: each node that has one to a lesser, with the least that it is connected to. So many pairs stand for any number of links."""
    names, at = np.unique(node, return_inverse=True)
    i, j, label = at[i], at[j], np.arange(len(names))
    while True:
        least, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return names[label < np.arange(len(names))], names[label[label < np.arange(len(names))]]
        label = new


def in_tiles(tiles: DataFrame, keys: list[str], compare: Callable[[pa.Table, np.ndarray], Pairs]) -> DataFrame:
    """(a, b) of what compare finds in tables of whole tiles, given where each starts. Tiles are rows of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, len(keys)):
            yield rows(_PAIR, *compare(table, starts))

    # A fixed number of partitions, as a tile's work is not in proportion to its bytes.
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def alike_pairs(places: np.ndarray, total: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, threshold: float) -> Pairs:
    """Of the pairs of a row of left and one of right, those that agree in at least least places and whose numbers of shingles allow the threshold."""
    found = [(np.zeros(0, np.int64),) * 2]
    for a in range(0, len(left), 32):
        part = left[a : a + 32]
        agree = (places[part][:, None] == places[right]).sum(2)
        i, j = np.nonzero((agree >= least) & (part[:, None] != right) & near(total[part][:, None], total[right], threshold))
        found.append((part[i], right[j]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(x, y) >= threshold * np.maximum(x, y)


def upto(n: F.Column) -> F.Column:
    return F.sequence(F.lit(0).cast("long"), n - 1)


def dealt(n: F.Column) -> F.Column:
    return F.pmod(F.xxhash64("node"), n)


def tiles_with_first(members: DataFrame) -> DataFrame:
    """Each block of a bucket (h, blocks, node, ...) with its first block: two rows for a member."""
    own = members.withColumn("block", dealt(F.col("blocks")))
    there = F.when(F.col("block") == 0, upto(F.col("blocks"))).otherwise(F.array("block"))
    return own.select("h", F.lit(0).cast("long").alias("i"), F.explode(there).alias("j"), "block", "node", "total", "places")


def left_apart(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (h, node) with their labels, and (h, most, rest, others) of each bucket that labels (node, label) leave apart: its largest group, how many are in it, and how many not."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = named.groupBy("h", "label").agg(F.count("*").alias("n"))
    each = groups.groupBy("h").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n")).where("n > m.n")
    return named, each.select("h", F.col("m.label").alias("most"), (F.col("n") - F.col("m.n")).alias("rest"), F.col("m.n").alias("others"))


def tiles_of_the_rest(named: DataFrame, apart: DataFrame, tile_nodes: int) -> DataFrame:
    """Of each bucket in apart: the members outside its largest group, in blocks, each with all blocks of the bucket."""
    blocks = lambda n: F.ceil(F.col(n) / tile_nodes)
    own = named.join(apart.withColumns({"rest": blocks("rest"), "others": blocks("others")}), "h")
    is_rest = F.col("label") != F.col("most")
    placed = own.withColumn("block", F.when(is_rest, dealt(F.col("rest"))).otherwise(F.col("rest") + dealt(F.col("others"))))
    placed = placed.withColumn("other", F.explode(upto(F.when(is_rest, F.col("rest") + F.col("others")).otherwise(F.col("rest")))))
    return placed.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node")


def candidates(nodes: DataFrame, threshold: float, bands: int, per_band: int, tile_nodes: int) -> DataFrame:
    """(node, label) of nodes that are connected by pairs which share a band, agree in about enough places and have about as many shingles.

    Members of a bucket are dealt into blocks of about tile_nodes. All blocks are compared with the first one, and of what is
    then apart, in all that buckets have linked, each block with all others; two blocks are a tile of one task. So the rows of tiles grow with the members of a bucket where these are alike.
    The places agree in the binomial way, so six standard deviations below the threshold lose a pair in a billion.
    """
    size = bands * per_band
    least = size * threshold - 6 * (size * threshold * (1 - threshold)) ** 0.5
    banded_schema = pa.schema([("node", pa.int64()), ("h", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.frombuffer(b"".join(s[: 8 * bands] for s in batch.column("sign").to_pylist()), np.int64)
            yield rows(banded_schema, np.repeat(batch.column("node").to_numpy(), bands), h)

    banded = nodes.select("node", "sign").mapInArrow(spread, "node long, h long")
    buckets = banded.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(banded.join(buckets, "h").select("node", "h", F.ceil(F.col("n") / tile_nodes).alias("blocks")), "buckets")
    placed = nodes.select("node", "total", F.substring("sign", 8 * bands + 1, size).alias("places"))

    def compare(table: pa.Table, starts: np.ndarray) -> Pairs:
        i, j, block, node, total = (table.column(c).to_numpy() for c in ("i", "j", "block", "node", "total"))
        places = np.frombuffer(b"".join(table.column("places").to_pylist()), np.uint8).reshape(len(node), size)
        sizes = np.diff(np.append(starts, len(node)))
        found = []
        for s in np.unique(sizes[(sizes <= 32) & (i[starts] == j[starts])]).tolist():  # small buckets of one size side by side
            first = starts[(sizes == s) & (i[starts] == j[starts])]
            x, y = np.triu_indices(s, 1)
            a, b = (first[:, None] + x).ravel(), (first[:, None] + y).ravel()
            for c in range(0, len(a), 1 << 16):
                p, q = a[c : c + (1 << 16)], b[c : c + (1 << 16)]
                ok = ((places[p] == places[q]).sum(1) >= least) & near(total[p], total[q], threshold)
                found.append((node[p[ok]], node[q[ok]]))
        for k in np.flatnonzero((sizes > 32) | (i[starts] != j[starts])).tolist():
            own = np.arange(starts[k], starts[k] + sizes[k])
            x, y = alike_pairs(places, total, own[block[own] == i[own]], own[block[own] == j[own]], least, threshold)
            found.append(connected(node, x, y))
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return connected(np.concatenate([a, b]), np.arange(len(a)), len(a) + np.arange(len(b)))

    first = in_tiles(tiles_with_first(shared.join(placed, "node")), ["h", "i", "j"], compare)
    labels = saved(components(first))
    large = shared.where("blocks > 1")
    if not large.take(1):
        return labels
    named, apart = left_apart(large.select("h", "node"), labels)
    apart = saved(apart)
    if not apart.take(1):
        return labels
    more = in_tiles(tiles_of_the_rest(named, apart, tile_nodes).join(placed, "node"), ["h", "i", "j"], compare)
    return saved(components(more.unionAll(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))))


def shared_values(row: np.ndarray, value: np.ndarray, n: int, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many values each of the rows left has in common with each of the rows right, of n rows whose values differ."""
    _, column, often = np.unique(value, return_inverse=True, return_counts=True)
    several = often > 1
    row, column = row[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)))
    for c in range(0, int(several.sum()), width):
        a, b = np.searchsorted(column, (c, c + width))
        dense = np.zeros((n, width), np.float32)
        dense[row[a:b], column[a:b] - c] = 1
        out += dense[left] @ dense[right].T
    return out


def elements_of(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text, each copy of one being an element of its own, and how many each text has."""
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in slices(texts):
        shingle, doc, _ = shingle_hashes(texts[a:b], words)
        element, owner, count = bags(shingle, doc)
        item, copy = ragged(count)
        found.append(mix(element[item] + copy.astype(np.uint64) * _STEP))
        counts.append(np.bincount(owner[item], minlength=b - a))
    return np.concatenate(found), np.concatenate(counts)


def linked(element: np.ndarray, owner: np.ndarray, total: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Pairs:
    """The pairs of a row of left and one of right with different labels whose multisets overlap by the threshold, exactly. Two without shingles are alike."""
    if len(total) == 2:  # most clusters are pairs
        common = np.array([[len(np.intersect1d(element[owner == 0], element[owner == 1], assume_unique=True))]])
        left, right = np.array([0]), np.array([1])
    else:
        common = shared_values(owner, element, len(total), left, right)
    union = total[left][:, None] + total[right] - common
    i, j = np.nonzero((label[left][:, None] != label[right]) & (np.where(union > 0, common / np.maximum(union, 1), 1.0) >= threshold))
    return left[i], right[j]


def verified(tiles: DataFrame, threshold: float, words: int) -> DataFrame:
    """(a, b): links that connect what is linked within tiles (cluster, i, j, block, node, label, total, text) of blocks i and j."""

    def compare(table: pa.Table, starts: np.ndarray) -> Pairs:
        i, j, block, node, label, total = (table.column(c).to_numpy() for c in ("i", "j", "block", "node", "label", "total"))
        ends = np.append(starts[1:], len(node))
        found, at = [(np.zeros(0, np.int64),) * 2], 0
        while at < len(starts):  # as many tiles at once as have half a million shingles
            upto = at + 1
            while upto < len(starts) and total[starts[at] : ends[upto]].sum() <= 500_000:
                upto += 1
            base = starts[at]
            element, count = elements_of(table.column("text").slice(base, ends[upto - 1] - base).to_pylist(), words)
            edge = np.append(0, np.cumsum(count))
            for k in range(at, upto):
                own = np.arange(starts[k], ends[k])
                if len(own) > 1:
                    x, y = (np.flatnonzero(block[own] == b[own]) for b in (i, j))
                    part = element[edge[starts[k] - base] : edge[ends[k] - base]]
                    found.append(connected(node[own], *linked(part, np.repeat(np.arange(len(own)), count[own - base]), count[own - base], label[own], x, y, threshold)))
            at = upto
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    return in_tiles(tiles, ["cluster", "i", "j"], compare)


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = BANDS, per_band: int = ROWS, tile_nodes: int = 512, tile_shingles: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, class_id, keeper): the class of each row; keeper marks the rows of the text that stands for it.

    Texts are linked if the multisets of their runs of five lower-case words have a weighted Jaccard similarity of at least
    threshold, and classes are what links connect; class_id is the least doc_id in the class. A text of fewer words is one run, texts without
    words are alike, a null text counts as empty, a null id as less than any other (class_id is then null). Rows that repeat are in one class.

    Two texts of similarity s meet in a band with probability 1 - (1 - s**6)**32: all but 6 in 100 000 at 0.8, 3 in ten million at 0.85. Those that meet
    and whose signatures agree enough are in one cluster, and within a cluster every pair is compared by its whole multisets, so a cluster may find links that no band has shown.

    Clusters of more members or shingles than fill a tile are dealt into blocks. All blocks are compared with the first one; then only members
    outside the largest group that this makes are compared with all others, so work grows with the members and not with their pairs where a group has
    a common likeness. Where it has not (many texts that are alike, but not enough) every pair is compared, in tiles of bounded memory, none is left out, and a tile gives out no more links than it has members.
    """
    nodes = nodes_of(docs, words, bands, per_band, id_col, text_col)
    clusters = candidates(nodes, threshold, bands, per_band, tile_nodes).withColumnRenamed("label", "cluster")
    texts = texts_of(clusters.select("node"), nodes, docs, id_col, text_col)
    members = clusters.join(nodes.select("node", "total"), "node")
    blocks = lambda n, shingles: F.ceil(F.greatest(F.col(n) / tile_nodes, F.col(shingles) / tile_shingles, F.lit(1.0)))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("total").alias("shingles")).select("cluster", blocks("n", "shingles").alias("blocks"))
    members = saved(members.join(sizes, "cluster"))
    first = members.withColumn("block", dealt(F.col("blocks"))).withColumn("j", F.explode(F.when(F.col("block") == 0, upto(F.col("blocks"))).otherwise(F.array("block"))))
    first = first.join(texts, "node").select("cluster", F.lit(0).cast("long").alias("i"), "j", "block", "node", F.col("node").alias("label"), "total", "text")
    labels = saved(components(verified(first, threshold, words)))

    large = members.where("blocks > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = large.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("total").alias("shingles"))
    each = groups.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.max(F.struct("n", "label", "shingles")).alias("m"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).where("n > m.n")
    each = each.select("cluster", "most", (F.col("n") - F.col("m.n")).alias("n_rest"), (F.col("shingles") - F.col("m.shingles")).alias("s_rest"), F.col("m.n").alias("n_most"), F.col("m.shingles").alias("s_most"))
    apart = saved(large.drop("blocks").join(each.select("cluster", "most", blocks("n_rest", "s_rest").alias("rest"), blocks("n_most", "s_most").alias("others")), "cluster"))
    if apart.take(1):
        is_rest = F.col("label") != F.col("most")
        placed = apart.withColumn("block", F.when(is_rest, dealt(F.col("rest"))).otherwise(F.col("rest") + dealt(F.col("others"))))
        placed = placed.withColumn("other", F.explode(upto(F.when(is_rest, F.col("rest") + F.col("others")).otherwise(F.col("rest")))))
        second = placed.join(texts, "node").select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "total", "text")
        more = saved(verified(second, threshold, words))
        labels = saved(components(more.unionAll(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))))

    labelled = nodes.select("node", "key", "rid").join(labels, "node", "left").select("key", "rid", F.coalesce("label", "node").alias("label"))
    least = labelled.groupBy("label").agg(F.min(F.struct("rid", "key")).alias("least"))
    named = labelled.join(least, "label").select("key", F.col("least.rid").alias("class_id"), (F.col("least.key") == F.col("key")).alias("stands"))
    rid, key = keyed(docs, id_col, text_col)
    out = docs.select(docs[id_col].cast("long").alias("doc_id"), rid.alias("rid"), key.alias("key")).join(named, "key")
    return out.select("doc_id", "key", F.when(F.col("class_id") != NO_ID, F.col("class_id")).alias("class_id"), (F.col("stands") & (F.col("rid") == F.col("class_id"))).alias("keeper"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: object) -> DataFrame:
    """The rows of docs, all columns as they are and whatever their names, without those that repeat another of their class: the row of the least id stays.

    Of rows with the same id and text the one stays whose other columns, as JSON, have the least digest. An empty table stays empty; ids and texts that are null count as in
    ``near_duplicate_classes``.
    """
    rid, key = keyed(docs, id_col, text_col)
    kept = near_duplicate_classes(docs, id_col=id_col, text_col=text_col, **settings).where("keeper").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), "key").distinct()
    others = [docs[c] for c in docs.columns if c not in (id_col, text_col)]
    marked = docs.select(rid.alias("rid"), key.alias("key"), F.md5(F.to_json(F.struct(*others)) if others else F.lit("")).alias("other"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    order = W.partitionBy("rid", "key").orderBy("other")
    return marked.join(kept, ["rid", "key"], "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1").select("row.*")
