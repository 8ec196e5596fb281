"""MinHash near-dedup by a chosen-path set similarity join.

Texts become sets of word shingles. Equal sets are one from the start. In each of several
independent trees, sets branch by minwise tokens chosen by tree and depth: a small node's sets are
all compared, a crowded node's branch further. The number of trees follows from the recall that is
asked for, for a pair at the threshold that meets at the last depth.

Comparisons in nodes use sketches and yield candidate pairs; links are confirmed on full sets. As
components are asked for, not pairs, each set's best candidates are confirmed first. For this, a
node that is crowded at the last depth is dealt into blocks by a hash, and two of its sets, the
pivots, join every block. Then what is not connected yet is compared in full: small nodes by
sketches again, and the sets of crowded nodes exactly. For that, each set is told by its residue, the
shingles by which it differs from what most of its crowd has, and a prefix join on the residues' rarest
tokens finds the pairs, so that a template which a crowd shares brings none of its sets together.
A dense group of near copies thus yields pairs in proportion to its size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, documents, gram_hashes, mix, rabin_karp, steps, text_bytes, word_hashes, word_spans

SHINGLE, PERCENT = 5, 80
#: Bytes of text that one vectorised step handles here: its arrays take some 60 times as much.
STEP = 1 << 19
#: Minwise tokens of which the trees choose, and of which sketches keep a byte each.
TOKENS, HASHES = 128, 512
#: Chosen tokens down to each depth of a tree, sets of a small node, and the recall that sets the number of trees.
DEPTHS, LEAF, RECALL = (2, 4, 6), 64, 0.9999
#: Standard errors that a sketch's estimate may lie below the threshold.
SLACK = 4.0
#: Buckets in which tokens of crowded sets' residues are counted (they only order the tokens), rows of a token in one share
#: of its join, and tokens that two residues must have together, if they must have so many, before their texts are compared.
COUNTED, SHARE, TOGETHER = 1 << 18, 1024, 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's set of n-word shingles as ascending hashes; fewer words are one shingle, none none."""
    data, ends = text_bytes(texts)
    data = _LOWER[data]
    starts, stops, first = word_spans(data, ends)
    words = word_hashes(data, starts, stops)
    grams, at = gram_hashes(words, first, n)
    cuts = np.searchsorted(at, first)
    sizes = np.diff(first)
    whole = rabin_karp(words, first[:-1], np.where(sizes < n, first[1:], first[:-1])) if len(words) else np.zeros(len(sizes), np.uint64)
    return [np.unique(grams[a:b]) if s >= n else whole[k : k + 1] if s else grams[:0] for k, (a, b, s) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), sizes.tolist(), strict=True))]


def minhashes(tokens: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(tokens), 256):
        np.minimum(least, (_FACTORS[:, None] * tokens[None, at : at + 256]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set; null if empty), signature, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=STEP):
            sets = shingle_sets(batch.column("text"), shingle)
            marks = [minhashes(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if m is None else m[:TOKENS].tobytes() for m in marks], pa.binary()),
                    pa.array([None if m is None else m.astype(np.uint8).tobytes() for m in marks], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_id", "signature", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_id binary, signature binary, sketch binary")


def trees_for(percent: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** DEPTHS[-1]))


def paths(sets: DataFrame, trees: int) -> DataFrame:
    """set, and its path's name at each depth (node0, node1, ...), one row for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = [np.random.default_rng(t).permutation(TOKENS)[: DEPTHS[-1]] for t in range(trees)]
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, TOKENS).astype(np.uint64)
            for tree, at in enumerate(chosen):
                name, names = np.full(len(tokens), tree + 1, dtype=np.uint64), []
                for depth in range(DEPTHS[-1]):
                    name = mix(name * np.uint64(0x9E3779B97F4A7C15) + tokens[:, at[depth]])
                    if depth + 1 in DEPTHS:
                        names.append(pa.array(name.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("set"), *names], names=["set", *(f"node{k}" for k in range(len(DEPTHS)))])

    return sets.select("set", "signature").mapInArrow(run, "set long, " + ", ".join(f"node{k} long" for k in range(len(DEPTHS))))


def nodes(sets: DataFrame, trees: int, scratch: Scratch) -> DataFrame:
    """node, block, set, crowded: where sets are compared; the blocks of a node of the last depth that is crowded don't compare it in full."""
    crowd, out, last, held = paths(sets, trees), [], len(DEPTHS) - 1, []
    for depth in range(len(DEPTHS)):
        node = f"node{depth}"
        sizes = scratch.cut(crowd.groupBy(node).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        # both sides of the join are plain exchanges, so that AQE can split a crowded node
        here = scratch.cut(crowd.join(sizes, node))
        scratch.drop(sizes)
        held.append(here)
        small = here if depth == last else here.where(F.col("n") <= LEAF)
        blocks = F.ceil(F.col("n") / LEAF)
        out.append(small.select(F.col(node).alias("node"), F.pmod(F.xxhash64("set", node), blocks).cast("int").alias("block"), "set", (F.col("n") > LEAF).alias("crowded")))
        if depth < last:
            crowd = here.where(F.col("n") > LEAF).drop("n")
            continue
        ends = here.where(F.col("n") > LEAF).groupBy(F.col(node).alias("node")).agg(F.min(F.struct(F.xxhash64("set"), "set")).alias("one"), F.max(F.struct(F.xxhash64("set"), "set")).alias("two"), F.first("n").alias("n"))
        pivots = ends.select("node", F.explode(F.array("one.set", "two.set")).alias("set"), blocks.alias("blocks"))
        out.append(pivots.select("node", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), "set", F.lit(True).alias("crowded")))
    placed = out[0]
    for part in out[1:]:
        placed = placed.unionByName(part)
    placed = scratch.cut(placed)
    scratch.drop(*held)
    return placed


def candidates(placed: DataFrame, sets: DataFrame, percent: int, best: bool, scratch: Scratch) -> DataFrame:
    """a < b, agree (equal sketch bytes) of pairs within a node whose sketches don't rule a link out.

    best: each set's best partner in each of its nodes. Otherwise all pairs of sets with different
    labels; placed then has a column label.
    """
    s = percent / 100
    least = int(math.floor(HASHES * (s - SLACK * math.sqrt(s * (1 - s) / HASHES))))

    def of_group(ids: np.ndarray, labels: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(ids)
        agree = np.zeros((n, n), dtype=np.int32)
        for k in range(n - 1):
            agree[k, k + 1 :] = (sketches[k + 1 :] == sketches[k]).sum(1)
        apart = ids[:, None] != ids[None] if best else labels[:, None] != labels[None]  # a pivot may meet itself
        agree = np.where(apart, agree, 0)
        if not best:
            one, two = np.nonzero(agree >= least)
        else:
            both = agree + agree.T
            one, two = np.arange(n), both.argmax(1)
            hit = both[one, two] >= least
            one, two = one[hit], two[hit]
            agree = both
        return np.minimum(ids[one], ids[two]), np.maximum(ids[one], ids[two]), agree[one, two]

    def compare(table: pa.Table) -> pa.RecordBatch | None:
        ids, node, block = (table.column(c).to_numpy() for c in ("set", "node", "block"))
        labels = ids if best else table.column("label").to_numpy()
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
        ends = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (block[1:] != block[:-1]), True])
        found = [of_group(ids[i:j], labels[i:j], sketches[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True) if j - i > 1]
        if not found:
            return None
        a, b, agree = map(np.concatenate, zip(*found, strict=True))
        pairs, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(agree[first].astype(np.int32))], names=["a", "b", "agree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = np.stack([batch.column("node").to_numpy(), batch.column("block").to_numpy()])
            change = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
            held.append(batch)
            if len(change):  # all but the last group of what is held is complete
                table = pa.Table.from_batches([*held[:-1], batch.slice(0, int(change[-1]))])
                held = [batch.slice(int(change[-1]))]
                if out := compare(table):
                    yield out
        if held and (out := compare(pa.Table.from_batches(held))):
            yield out

    met = placed.join(sets.select("set", "sketch"), "set").select(*placed.columns, "sketch")
    found = met.repartition("node", "block").sortWithinPartitions("node", "block").mapInArrow(run, "a long, b long, agree int")
    return scratch.cut(found.groupBy("a", "b").agg(F.max("agree").alias("agree")))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough; texts: set, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text_a", STEP):
            keep = []
            for one, two in zip(shingle_sets(batch.column("text_a"), shingle), shingle_sets(batch.column("text_b"), shingle), strict=True):
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (texts.select(F.col("set").alias(c), F.col("text").alias(f"text_{c}")) for c in ("a", "b"))
    return scratch.cut(pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))


def with_tokens(texts: DataFrame, shingle: int) -> DataFrame:
    """set, label, family, tokens (hashes of the shingles) of each set (set, label, family, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, limit=STEP):
            sets = shingle_sets(batch.column("text"), shingle)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("set", "label", "family")), lists], names=["set", "label", "family", "tokens"])

    return texts.select("set", "label", "family", "text").mapInArrow(run, "set long, label long, family long, tokens array<long>")


def counted_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """family, token, n: how many sets of a batch (family, tokens) have each token."""
    for batch in batches:
        lists = batch.column("tokens")
        tokens, family = lists.flatten().to_numpy(), np.repeat(batch.column("family").to_numpy(), lists.value_lengths().to_numpy())
        order = np.lexsort((tokens, family))
        tokens, family = tokens[order], family[order]
        first = np.flatnonzero(np.append(True, (tokens[1:] != tokens[:-1]) | (family[1:] != family[:-1])))[: len(tokens)]
        yield pa.RecordBatch.from_arrays([pa.array(family[first]), pa.array(tokens[first]), pa.array(np.diff(np.append(first, len(tokens))))], names=["family", "token", "n"])


def residues(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """set, label, family, size, tokens: by which shingles each set differs from its family's template, those that most of its sets have.

    Two sets differ in the shingles that only one of their residues has.
    """
    members = scratch.cut(sets.groupBy("family").agg(F.count(F.lit(1)).alias("m")))
    common = sets.select("family", "tokens").mapInArrow(counted_tokens, "family long, token long, n long").groupBy("family", "token").agg(F.sum("n").alias("n"))
    # more than half of the sets have each of these, so they are fewer than twice a set's mean size
    template = scratch.cut(common.join(members, "family").where("2 * n > m").groupBy("family").agg(F.collect_list("token").alias("template")))
    both = sets.join(template, "family", "left").withColumn("template", F.coalesce("template", F.array().cast("array<long>")))
    named = lambda tokens, kind: F.transform(tokens, lambda t: F.xxhash64("family", t, F.lit(kind)))
    more, less = F.array_except("tokens", "template"), F.array_except("template", "tokens")
    return both.select("set", "label", "family", F.size("tokens").cast("long").alias("size"), F.concat(named(more, "more"), named(less, "less")).alias("tokens"))


def token_counts(rows: DataFrame) -> np.ndarray:
    """Number of residues (column tokens) with a token of each bucket: at most COUNTED numbers reach the driver."""
    found = rows.select(F.explode("tokens").alias("token")).select(F.shiftrightunsigned("token", 46).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(COUNTED, dtype=np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """token, set, label, slack, r, at, short, few, least: the first tokens of each residue, rarest first.

    rows: set, label, size, slack, top (the largest slack of the family), tokens. A pair's residues
    must have -(slack + slack) / (2 * (100 + percent)) tokens in common. So the first ones of both
    have `few` (of the set with the more slack, whose first ones are `short`) or `least` (of the
    other) in common. What the other needs is bounded by `top`, and by the partner's residue being
    no smaller than what is in common.
    """
    counts = token_counts(rows)
    points = 100 + percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, slack, top = (batch.column(c).to_numpy() for c in ("size", "slack", "top"))
            tokens = [t.values.to_numpy().view(np.uint64) for t in batch.column("tokens")]
            r = np.array([len(t) for t in tokens], dtype=np.int64)
            common_short = np.maximum(1, -(slack // points))
            common = np.maximum.reduce([np.ones_like(slack), -((top + slack) // (2 * points)), -((100 * (100 - percent) * size + percent * slack) // (percent * points))])
            few, least = np.minimum(TOGETHER, common_short), np.minimum(TOGETHER, common)
            first, kept = np.clip(r - common_short + few, 0, r), np.clip(r - common + least, 0, r)
            row = np.repeat(np.arange(len(r)), kept)
            at = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
            values = [t[np.lexsort((t, counts[(t >> np.uint64(46)).astype(np.int64)]))[:n]] for t, n in zip(tokens, kept.tolist(), strict=True)]
            numbers = {"slack": slack[row], "r": r[row], "at": at, "short": at < first[row], "few": few[row], "least": least[row]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values).view(np.int64)), *(batch.column(c).take(pa.array(row)) for c in ("set", "label")), *map(pa.array, numbers.values())], names=["token", "set", "label", *numbers]
            )

    return rows.select("set", "label", "size", "slack", "top", "tokens").mapInArrow(run, "token long, set long, label long, slack long, r long, at long, short boolean, few long, least long")


def crowd_pairs(crowd: DataFrame, shingle: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links, and candidates for the other links, as a < b, of sets (set, label, family, text) of one family with different labels.

    Where residues are short enough, sets are linked whatever they are; links to the hub, the set with
    the most slack, connect all of these. The rest must have tokens of their residues in common, and
    tokens of a template are not in residues. A token's rows of its commonest label are joined with
    the rest only, not with each other.
    """
    sets = scratch.cut(with_tokens(crowd, shingle))
    differ = scratch.cut(residues(sets, scratch).withColumn("slack", F.lit(100 - percent) * F.col("size") - F.lit(100 + percent) * F.size("tokens")))
    hubs = scratch.cut(differ.groupBy("family").agg(F.max(F.struct("slack", "set", "label")).alias("hub")))
    rows = differ.join(hubs, "family").withColumn("near", F.col("slack") + F.col("hub.slack") >= 0)
    sure = scratch.cut(rows.where("near AND label != hub.label").select(F.least("set", "hub.set").alias("a"), F.greatest("set", "hub.set").alias("b")))
    rows = scratch.cut(rows.select("set", F.when(F.col("near"), F.col("hub.label")).otherwise(F.col("label")).alias("label"), "size", "slack", F.col("hub.slack").alias("top"), "tokens"))
    every = scratch.cut(prefixes(rows, percent))
    scratch.drop(sets, differ, hubs, rows)
    labels = every.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("short"))
    shared = labels.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"), F.max("short").alias("any"), F.max(F.struct("n", "label")).alias("most"))
    shared = scratch.cut(shared.where("labels > 1 AND any").select("token", F.ceil(F.col("n") / SHARE).cast("int").alias("shares"), F.col("most.label").alias("most")))
    rows = scratch.cut(every.join(shared, "token").select(*every.columns, "shares", (F.col("label") != F.col("most")).alias("minor")))
    scratch.drop(every, shared)
    side = lambda df, k: df.select("token", "share", *(F.col(c).alias(f"{c}_{k}") for c in ("set", "label", "slack", "r", "at", "few", "least", "minor")))
    one = side(rows.where("short").withColumn("share", F.pmod(F.xxhash64("set"), "shares").cast("int")), 1)
    two = side(rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))), 2)
    met = one.where("minor_1").join(two, ["token", "share"]).unionByName(one.where("NOT minor_1").join(two.where("minor_2"), ["token", "share"]))
    # of the first TOGETHER tokens that a pair has in common, each leaves enough behind it for the rest
    early = f"{2 * (100 + percent)}L * ({TOGETHER - 1} + least(r_1 - at_1, r_2 - at_2)) + slack_1 + slack_2 >= 0"
    met = met.where(f"label_1 != label_2 AND struct(slack_1, set_1) > struct(slack_2, set_2) AND {early}")
    # both residues are in the same order, so that behind the last token in common either has only so many left
    behind = f"{2 * (100 + percent)}L * (n + least(r_1 - at_1, r_2 - at_2) - 1) + slack_1 + slack_2 >= 0"
    fixed = [F.first(f"{c}_{k}").alias(f"{c}_{k}") for c in ("slack", "r", "few", "least") for k in (1, 2)]
    able = met.groupBy("set_1", "set_2").agg(F.count(F.lit(1)).alias("n"), F.max("at_1").alias("at_1"), F.max("at_2").alias("at_2"), *fixed).where(f"n >= least(few_1, least_2) AND {behind}")
    maybe = scratch.cut(able.select(F.least("set_1", "set_2").alias("a"), F.greatest("set_1", "set_2").alias("b")))
    scratch.drop(rows)
    return sure, maybe


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (smallest node reachable) of every node of edges (a < b) but the labels themselves.

    Each node takes its smallest neighbour as parent, parents are followed to the roots by doubling,
    the edges are drawn between the roots, and so on until none is left.
    """
    labels, own = None, []
    while not edges.isEmpty():
        parent = scratch.cut(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"), F.lit(True).alias("moved")))
        while not parent.where("moved").isEmpty():
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("above"))
            higher = scratch.cut(parent.drop("moved").join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")))
            scratch.drop(parent)
            parent = higher
        at = lambda c: parent.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}"))
        drawn = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y")).where("x != y")
        drawn = scratch.cut(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(*own)
        edges, own = drawn, [drawn]
        parent = parent.select("node", "label")
        if labels is not None:
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("above"))
            parent = scratch.cut(labels.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label")).unionByName(parent))
        labels = parent
    return labels if labels is not None else edges.select(F.col("b").alias("node"), F.col("a").alias("label"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) of every row of docs (doc_id, text).

    Texts are linked if their shingle sets' intersection is at least `percent` of their union. Texts
    without words, null ones among them, are linked with nothing. A row repeated with its doc_id
    must repeat its text; each such row is returned. No rows: no rows. Other columns are ignored.
    Memory of a task: a batch of texts, or one text however long.
    """
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession)
    marks = scratch.cut(signed(docs, shingle))
    rows = scratch.cut(marks.select("doc_id", "n_shingles", "set_id"))
    full = marks.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
    sets = scratch.cut(full.groupBy("set_id").agg(F.min("doc_id").alias("set"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")))
    scratch.drop(marks)
    placed = nodes(sets, trees_for(percent, recall), scratch)
    pairs = candidates(placed.drop("crowded"), sets, percent, True, scratch)
    # whoever has a candidate in a node that is compared in full has a best one, so these texts do for both rounds
    wanted = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(placed.where("crowded").select(F.col("set").alias("doc_id"))).distinct())
    texts = scratch.cut(docs.join(wanted, "doc_id").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("set"), "text"))
    # each set's best candidate, and its best one with a smaller id: enough to join most of a dense group
    both = pairs.select(F.explode(F.array("a", "b")).alias("set"), "agree", "a", "b")
    best = both.groupBy("set").agg(F.max(F.struct("agree", "a", "b")).alias("x")).select("x.a", "x.b")
    lower = pairs.groupBy("b").agg(F.max(F.struct("agree", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    nearest = scratch.cut(best.unionByName(lower).distinct())
    scratch.drop(wanted, pairs)
    links = confirmed(nearest, texts, shingle, percent, scratch)
    label = components(links, scratch).withColumnRenamed("node", "set")
    labelled = scratch.cut(placed.join(label, "set", "left").select("node", "block", "set", F.coalesce("label", "set").alias("label"), "crowded"))
    scratch.drop(placed)
    small, crowds = labelled.where("NOT crowded").drop("crowded"), labelled.where("crowded")
    ends = F.min("label").alias("low"), F.max("label").alias("high")
    mixed = scratch.cut(small.groupBy("node", "block").agg(*ends).where("low != high").select("node", "block"))
    rest = candidates(small.join(mixed, ["node", "block"]), sets, percent, False, scratch).select("a", "b")
    mixed = scratch.cut(crowds.groupBy("node").agg(*ends, F.min("set").alias("a")).where("low != high").select("node", "a"))
    crowds = scratch.cut(crowds.join(mixed, "node").select("a", "set", "label").distinct())
    scratch.drop(labelled)
    if not crowds.isEmpty():
        # crowded nodes with a set in common are one family
        family = components(crowds.where("a != set").select("a", F.col("set").alias("b")).distinct(), scratch).select(F.col("node").alias("set"), F.col("label").alias("family"))
        crowd = crowds.select("set", "label").distinct().join(family, "set", "left").select("set", "label", F.coalesce("family", "set").alias("family"))
        sure, maybe = crowd_pairs(texts.join(crowd, "set"), shingle, percent, scratch)
        links, rest = links.unionByName(sure), rest.unionByName(maybe).distinct()
    more = confirmed(rest.join(nearest, ["a", "b"], "left_anti"), texts, shingle, percent, scratch)
    scratch.drop(texts)
    label = components(links.unionByName(more), scratch)
    group = scratch.cut(sets.select("set_id", "set").join(label.select(F.col("node").alias("set"), "label"), "set", "left").select("set_id", F.coalesce("label", "set").alias("label")))
    scratch.drop(sets)
    return rows.join(group, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents: three-word shingles, 85 percent."""
    return near_groups(documents(spark, sf_dir), shingle=3, percent=85).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o) AS shingle, coalesce(lead(i, 2) OVER o, 0) > 0 OR n < 3 AND i = 1 AS whole
  FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words)
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
sets AS MATERIALIZED (SELECT doc_id, shingle, count(*) OVER (PARTITION BY doc_id) AS n FROM shingles WHERE whole),
links AS MATERIALIZED (
  SELECT a.doc_id AS one, b.doc_id AS two
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY ALL
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
),
reached AS (
  SELECT two AS doc_id, one AS reach FROM links
  UNION SELECT one, two FROM links
  UNION
  SELECT r.doc_id, CASE WHEN l.one = r.reach THEN l.two ELSE l.one END
  FROM reached r JOIN links l ON r.reach = l.one OR r.reach = l.two
),
least AS (SELECT doc_id, min(reach) AS reach FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.reach, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.reach, d.doc_id) AS kept
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, n FROM sets) s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""
