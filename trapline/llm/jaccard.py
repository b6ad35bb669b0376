"""Set similarity join of documents on their shingles: rare-first prefix filtering.

Documents of one set of shingles are one class. Between classes:

1. Scouts. Under any order of shingles two linked sets share, among their first
   ``slack(n) + l`` shingles each, at least ``l``. With hashes as order and ``l`` a
   tenth of the set that takes 0.3 of all shingles, and leaves out, exactly, every
   class that shares too few of them with other classes. The texts of the rest are
   read again.
2. Rare first. The shingles of the rest are counted and ordered by count, those of
   one class alone first: these can't be shared, and a set with more of them than
   ``slack`` has no partner. A set's prefix is its first ``slack(n) + 1`` shingles.
3. Pairs meet by prefix shingle, and pass a length filter, a positional filter (what
   may still follow the shingle's places) and, once a pair, a suffix filter: the
   ordered sets behind their unshared heads, cut into ``BINS`` parts by hash, cannot
   share more than the lesser part of each. What passes is verified once, on whole
   sets.

A group of near copies shares its prefixes as a whole. To lose no link and yet not
make all its pairs, pairs are first made with one leader a shingle, the set with the
fewest shingles of its own; what they link is one component, and later only pairs of
different components are made, until all of those are verified or excluded.

Shingles of many sets are known from a sample of documents and go another way than
through one task: they count as shared, with the sample's estimate as their place in
the order. Which shingles these are changes where rows go, never what is linked.

Defined cases: a null or blank text has an empty set, is linked with nothing and is
a component of its own; with fewer words than a shingle the whole text is one;
equal sets are linked; rows of one id are judged each by its own text; null ids
count last, so a component's id is null only if all its ids are; an empty table
gives no rows; of the input only ``doc_id`` and ``text`` are used. Shingles are 64-bit
hashes, whole sets 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_root
from . import common, ordering, repeats, shingles, spread
from .components import component_roots

WORDS, PERCENT = 5, 80
#: of the documents, one in so many is looked at for shingles of many sets
SAMPLE, SAMPLE_LEAST = 64, 8
#: parts of the suffix filter
BINS = 32
#: rounds with one leader a shingle, at most, while they link something and open pairs outnumber their rows so many times
ROUNDS, MANY = 3, 200


def _need(n, percent: int):
    """Least overlap of a set of ``n`` with a linked one."""
    return -(-n * percent // 100)


def _need_column(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / F.lit(100.0)).cast("long")


def _pair_need(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of linked sets of ``n`` and ``m``."""
    return F.floor(((n + m) * percent + (99 + percent)) / F.lit(100.0 + percent)).cast("long")


def _scouts(values: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are scouts: a set's first ``slack + l`` by hash; and their owners."""
    n = np.diff(off)
    take = n - _need(n, percent) + -(-n // 10)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(values)) - off[owner] < take[owner], owner


def _set_batches(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = common.flat(batch.column("text"))
        for lo, hi in common.slices(off):
            values, at = shingles.shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
            whole = [xxhash.xxh3_128_intdigest(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            s1 = np.array([w >> 64 for w in whole], np.uint64)
            s2 = np.array([w & ((1 << 64) - 1) for w in whole], np.uint64)
            part = batch.slice(lo, hi - lo)
            yield pa.record_batch({
                **{c: part.column(c) for c in ("doc_id", "order_id", "text_key")}, "n": pa.array(np.diff(at)), "s1": pa.array(common.signed(s1)), "s2": pa.array(common.signed(s2)),
            })
    common.give_back()


def _scout_batches(batches: Iterator[pa.RecordBatch], words: int, percent: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each scout, with its set's first hash; hot ones in one row a document (no ``token``, their number)."""
    for batch in batches:
        raw, off = common.flat(batch.column("text"))
        for lo, hi in common.slices(off):
            values, at = shingles.shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
            picked, owner = _scouts(values, at, percent)
            sets = np.array([xxhash.xxh3_128_intdigest(values[a:b].tobytes()) >> 64 for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
            known = picked & np.isin(values, hot)
            light = picked & ~known
            number = np.bincount(owner[known], minlength=hi - lo)
            some = np.flatnonzero(number)
            token = pa.concat_arrays([pa.array(common.signed(values[light])), pa.nulls(len(some), pa.int64())])
            count = np.concatenate([np.ones(int(light.sum()), np.int32), number[some].astype(np.int32)])
            yield pa.record_batch({"token": token, "s1": pa.array(common.signed(np.concatenate([sets[owner[light]], sets[some]]))), "number": pa.array(count)})
    common.give_back()


def _hot(rows: DataFrame, counted: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more rows than a fraction of a task's, by a sample's ``(token, n)``; and their estimated counts.

    There are at most ``spread.SHARE`` of them a partition."""
    counts = repeats.stored(rows.groupBy("token").agg(F.sum(counted).alias("n")), "shingle-sample")
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = max(SAMPLE_LEAST, spread.hot_bound(rows, total * SAMPLE) // SAMPLE)
    found = sorted((r["token"], r["n"]) for r in counts.where(F.col("n") >= bound).collect())
    return np.array([t for t, _ in found], np.int64).view(np.uint64), np.array([n for _, n in found], np.int64) * SAMPLE


def _token_batches(batches: Iterator[pa.RecordBatch], words: int, hot: np.ndarray, estimate: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set; ``known`` is a hot one's estimated count, else 0."""
    for batch in batches:
        raw, off = common.flat(batch.column("text"))
        key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
        for lo, hi in common.slices(off):
            values, at = shingles.shingle_sets(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words)
            owner = lo + np.repeat(np.arange(hi - lo), np.diff(at))
            known = np.zeros(len(values), np.int64)
            if len(hot):
                place = np.minimum(np.searchsorted(common.signed(hot), common.signed(values)), len(hot) - 1)
                known = np.where(hot[place] == values, estimate[place], 0)
            yield pa.record_batch({"token": pa.array(common.signed(values)), "key": pa.array(key[owner]), "n": pa.array(n[owner]), "known": pa.array(known)})
    common.give_back()


_SETS = "key long, n long, own long, tokens array<long>, bins array<int>"


def _gathered_batches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A row for each set that may have a partner: its shared shingles, rarest first, and their parts' sizes."""
    out, held = [], 0

    def close(key: int, n: int, parts: list[np.ndarray]) -> dict | None:
        tokens = np.concatenate(parts)
        tokens = tokens[np.sort(np.unique(tokens, return_index=True)[1])]  # a row may come twice
        if len(tokens) < _need(n, percent):
            return None
        return {"key": key, "n": n, "own": n - len(tokens), "tokens": tokens, "bins": np.bincount(tokens.view(np.uint64) % np.uint64(BINS), minlength=BINS).astype(np.int32)}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.record_batch({
            **{c: pa.array([r[c] for r in rows], pa.int64()) for c in ("key", "n", "own")},
            "tokens": pa.array([r["tokens"] for r in rows], pa.list_(pa.int64())), "bins": pa.array([r["bins"] for r in rows], pa.list_(pa.int32())),
        })

    key, n, parts = None, 0, []
    for new, run in ordering.runs(batches, ["key"]):
        if new:
            if parts and (row := close(key, n, parts)):
                out.append(row)
                held += row["tokens"].nbytes
            if held > 4 << 20:
                yield batch(out)
                out, held = [], 0
            key, n, parts = run.column("key")[0].as_py(), run.column("n")[0].as_py(), []
        parts.append(run.column("token").to_numpy())
    if parts and (row := close(key, n, parts)):
        out.append(row)
    if out:
        yield batch(out)
    common.give_back()


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, order_id, text_key, n, s1, s2)``: each document's set, by size and hash."""
    schema = "doc_id long, order_id long, text_key long, n long, s1 long, s2 long"
    return repeats.stored(docs.mapInArrow(lambda it: _set_batches(it, words), schema), "sets")


def _candidates(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Classes that share enough scouts: ``(key, n, s1, s2, least, order_id, text_key, copies)``; ``key`` is a number."""
    schema = "token long, s1 long, number int"
    sample = docs.where(F.pmod("text_key", F.lit(SAMPLE)) == 0).mapInArrow(lambda it: _scout_batches(it, words, percent, np.zeros(0, np.uint64)), schema)
    hot, _ = _hot(sample, "number")
    scouts = docs.mapInArrow(lambda it: _scout_batches(it, words, percent, hot), schema)
    # rows without a token are of hot scouts, which count as shared
    group = Window.partitionBy("token", F.when(F.col("token").isNull(), F.col("s1")))
    shared = scouts.withColumn("shared", F.col("token").isNull() | (F.min("s1").over(group) != F.max("s1").over(group))).where("shared")
    shared = shared.groupBy("s1").agg(F.sum("number").alias("shared"))
    rows = sets.where("n > 0").groupBy("s1", "s2", "n", "order_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    classes = rows.groupBy("s1", "s2", "n").agg(F.min(F.struct("order_id", "text_key", "rows")).alias("first"), F.sum("rows").alias("copies"))
    # a linked set is no smaller than need(n), so at least a tenth of that many scouts are shared
    least = F.ceil(_need_column(F.col("n"), percent) / F.lit(10.0))
    kept = classes.join(shared, "s1").where(F.col("shared") >= F.col("copies") * least)
    kept = kept.select("n", "s1", "s2", F.col("first.order_id").alias("order_id"), F.col("first.text_key").alias("text_key"), F.col("first.rows").alias("rows"))
    return repeats.stored(kept.withColumn("key", F.monotonically_increasing_id()), "candidates")


def _ordered_sets(docs: DataFrame, candidates: DataFrame, words: int, percent: int) -> DataFrame:
    """Candidates' shared shingles, rarest first."""
    wanted = candidates.select("order_id", "text_key", "key", "n", "rows")
    # merged, not broadcast, however few there are: the number of candidates grows with the documents
    texts = docs.select("order_id", "text_key", "text").join(wanted.hint("merge"), ["order_id", "text_key"])
    texts = repeats.stored(texts.select("key", "n", "rows", "text"), "candidate-texts")
    if not wanted.where("rows > 1").isEmpty():
        texts = texts.where("rows = 1").unionByName(texts.where("rows > 1").dropDuplicates(["key"]))
    texts = texts.select("key", "n", "text")
    schema = "token long, key long, n long, known long"
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sample = texts.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).mapInArrow(lambda it: _token_batches(it, words, *none), schema)
    hot, estimate = _hot(sample.withColumn("one", F.lit(1)), "one")
    tokens = texts.mapInArrow(lambda it: _token_batches(it, words, hot, estimate), schema)
    group = Window.partitionBy("token", F.when(F.col("known") > 0, F.col("key")))
    counted = tokens.withColumn("sets", F.when(F.col("known") > 0, F.col("known")).otherwise(F.count(F.lit(1)).over(group))).where("sets > 1")
    dealt = counted.select("key", "n", "sets", "token").repartition("key").sortWithinPartitions("key", "sets", "token")
    return repeats.stored(dealt.mapInArrow(lambda it: _gathered_batches(it, percent), _SETS), "ordered-sets")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``(token, key, n, own, place)``: a row for each shared shingle of a set's prefix, with its place in the set."""
    slack = F.col("n") - _need_column(F.col("n"), percent)
    head = F.slice("tokens", F.lit(1), F.greatest(slack + 1 - F.col("own"), F.lit(0)).cast("int"))
    rows = sets.select("key", "n", "own", F.posexplode(head).alias("at", "token"))
    return rows.select("token", "key", "n", "own", (F.col("own") + F.col("at")).alias("place"))


def _possible(percent: int) -> Column:
    """Length and positional filter of a pair that meets at places ``place`` and ``place2``."""
    n, m = F.col("n"), F.col("n2")
    after = F.least(n - F.col("place"), m - F.col("place2"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (after >= _pair_need(n, m, percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs ``(a, b)`` looked at, once each, and those linked; many may share ``a``."""
    pairs = repeats.stored(pairs.distinct(), "pairs")
    small, whole = sets.select("key", "n", "bins"), sets.select("key", "n", "tokens")

    def both(side: DataFrame, rows: DataFrame, value: str) -> DataFrame:
        rows = spread.spread_join(rows, side.select(F.col("key").alias("a"), "n", F.col(value).alias("left")), ["a"], "b")
        return rows.join(side.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col(value).alias("right")), "b")

    need = _pair_need(F.col("n"), F.col("m"), percent)
    room = F.aggregate(F.zip_with("left", "right", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    passed = repeats.stored(both(small, pairs, "bins").where(room >= need).select("a", "b"), "passed")
    overlap = F.size(F.array_intersect("left", "right")).cast("long")
    links = both(whole, passed, "tokens").where(overlap >= need).select("a", "b")
    return pairs, repeats.stored(links, "links")


def _led_pairs(entries: DataFrame, first: list[Column], percent: int) -> DataFrame:
    """Pairs of each shingle's leader (the least by ``first``) with the shingle's other sets."""
    leader = F.min(F.struct(*first, F.col("key").alias("a"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("comp").alias("comp2"))).alias("led")
    leaders = entries.groupBy("token").agg(leader).select("token", "led.a", "led.n2", "led.place2", "led.comp2")
    met = spread.spread_join(entries, leaders, ["token"], "key")
    return met.where((F.col("comp") != F.col("comp2")) & _possible(percent)).select("a", F.col("key").alias("b"))


def _crossing_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """All possible pairs of one shingle and different components.

    The smaller set of a pair meets the other within a shorter prefix: at least ``n - place``
    shingles of it must be shared, and the other is no smaller.
    """
    short = entries.where(F.col("n") - F.col("place") >= _pair_need(F.col("n"), F.col("n"), percent))
    right = short.select("token", F.col("comp").alias("comp2"), F.col("key").alias("key2"), F.col("n").alias("n2"), F.col("place").alias("place2"))
    larger = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("key2") < F.col("key")))
    both = spread.spread_join(entries, right, ["token"], "key").where(larger & (F.col("comp") != F.col("comp2")) & _possible(percent))
    return both.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b"))


def _unsettled(entries: DataFrame, roots: DataFrame) -> tuple[DataFrame, float]:
    """Prefix rows of shingles that still join different components, and how many pairs a row those make."""
    entries = entries.drop("comp").join(roots, "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
    entries = repeats.stored(entries, "prefix-components")
    c = entries.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    c = c.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same")).where("comps > 1")
    c = repeats.stored(c, "open-shingles")
    pairs, rows = c.agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("same")) / 2), F.sum("n")).first()
    kept = spread.spread_join(entries, c.select("token"), ["token"], "key")
    return repeats.stored(kept, "open-prefixes"), (pairs or 0) / (rows or 1)


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(sets, candidates, links, roots)``: each document's set, the classes looked at, a spanning set of their
    links and the components these make.

    Every two linked classes are linked directly or through others of these links.
    """
    checkpoint_root(docs.sparkSession)
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(repeats.LAST_ID)).alias("order_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    sets = _classes(docs, words)
    candidates = _candidates(docs, sets, words, percent)
    ordered = _ordered_sets(docs, candidates, words, percent)
    entries = repeats.stored(_prefixes(ordered, percent).withColumn("comp", F.col("key")), "prefixes")
    looked = found = docs.sparkSession.createDataFrame([], "a long, b long")
    for k in range(ROUNDS):
        first = [F.expr("own * 1000 div n").alias("own")] if not k else [F.xxhash64("key", F.lit(k)).alias("own")]
        seen, linked = _verified(_led_pairs(entries, first, percent).join(looked, ["a", "b"], "left_anti"), ordered, percent)
        looked = looked.unionByName(seen).unionByName(seen.select(F.col("b").alias("a"), F.col("a").alias("b")))
        none = linked.isEmpty()
        if none and k:  # another leader won't help
            break
        found = found.unionByName(linked)
        roots = component_roots(found).select(F.col("node").alias("key"), "root")
        entries, pairs = _unsettled(entries, roots)
        if none or pairs <= MANY:
            break
    if pairs:
        linked = _verified(_crossing_pairs(entries, percent).join(looked, ["a", "b"], "left_anti"), ordered, percent)[1]
        if not linked.isEmpty():
            roots = component_roots(found.unionByName(linked)).select(F.col("node").alias("key"), "root")
            found = found.unionByName(linked)
    return sets, candidates, found, roots


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, class_1, class_2, component_id)`` of each row; equal classes are equal sets."""
    sets, candidates, _, roots = links(docs, words, percent)
    least = sets.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"))
    members = repeats.stored(candidates.join(roots, "key").join(least, ["s1", "s2"]).select("s1", "s2", "root", "least"), "members")
    of_root = members.groupBy("root").agg(F.min("least").alias("component"))
    moved = spread.spread_join(members, of_root, ["root"], "s1").select("s1", "s2", "component")
    named = repeats.stored(least.join(moved, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("component", "least").alias("component")), "components")
    joined = spread.spread_join(sets, named, ["s1", "s2"], "text_key", "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("s1").alias("class_1"), F.col("s2").alias("class_2"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )
