"""The prefix trie of rebuilt conversations, by composable fingerprints.

A sequence of turns has the fingerprint (sum of t_i * B^i mod 2^61-1, length); two
sequences one after the other have (x + B^n * y, n + m), so fingerprints form a monoid and
the prefix of a rebuilt conversation is composed from its base's head and its own suffix
(a difference of two prefix sums) without a rebuilt text. Two independent bases are used.
Texts are read once, for their digests and lengths.

Rows of a conversation never meet in one task: turns are numbered by a range sort, sums
run over blocks of ``BLOCK`` turns and then over the blocks, and every later join goes by
(conversation, block) or by a node's own key. Equal prefixes meet in an aggregation that
Spark combines before it shuffles. A group of equal fingerprints is verified: all its
members must share the stored digest (SHA-256) of their last turn and their parent's
fingerprint, which by induction over the depth makes the sequences equal. If a group fails,
everything is repeated with other bases.

The node with smallest member c at depth d is (c, d), and the nodes of one c form a chain
that starts below another chain. Sums over subtrees are sums along a chain, plus the totals
of chains that start there; totals come by pointer doubling, in as many rounds as the
logarithm of the nesting.

The digest of the ids that end at a node is taken over chunks of sorted ids, in order;
SHA-256 is sequential, so one task streams the packed chunks of one node (never holding them).

Edge cases: rows without a conv_id are ignored; a null role or text is empty; turns of
equal number follow the order of SHA-256 of (role length in bytes, ':', role, text), so
repeated rows are repeated turns; an absent base adds no turns; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..sources.articles import assign_ids
from .common import save
from .words import U, mix

STRIDE = 5        # a conversation's base is its id less its remainder by this
HEADS = 9         # heads have crc32 modulo this many turns
BLOCK = 4096
CHUNK = 4096
PRIME = (1 << 61) - 1
SEEDS = (1, 2, 3, 4)
_G = ["_g1", "_g2", "_g3", "_g4"]
_P, _LOW29, _LOW32 = U(PRIME), U((1 << 29) - 1), U((1 << 32) - 1)
EMPTY = hashlib.sha256(b"").hexdigest()


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x >> U(61)) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a * b`` modulo 2^61-1 for values below it."""
    a1, a0, b1, b0 = a >> U(32), a & _LOW32, b >> U(32), b & _LOW32
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    return _reduced(U(8) * a1 * b1 + (middle >> U(29)) + ((middle & _LOW29) << U(32)) + (low >> U(61)) + (low & _P))


def power(base: int, e: np.ndarray) -> np.ndarray:
    """``base ** e`` modulo 2^61-1."""
    e, out, b = e.astype(U), np.ones(len(e), dtype=U), base % PRIME
    while e.any():
        out = np.where(e & U(1), times(out, np.full(len(e), b, dtype=U)), out)
        e, b = e >> U(1), b * b % PRIME
    return out


def _bases(seed: int) -> tuple[int, int]:
    """Two bases; seed 0 is degenerate (a fingerprint tells the length alone), for tests."""
    rng = np.random.default_rng(seed)
    return tuple(int(x) for x in rng.integers(1 << 40, PRIME, 2)) if seed else (1, 1)


def _u(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(U)


def turns(conversations: DataFrame) -> DataFrame:
    """``_c, _turn, _g1.._g4, _bytes`` of every turn, stored; the digest in words that sort like it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("_c"), F.col("turn").cast("long").alias("_turn"),
        F.sha2(whole.cast("binary"), 256).alias("_d"), F.octet_length(text).cast("long").alias("_bytes"))
    words = [F.conv(F.substring("_d", 16 * i + 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(-1 << 63)).alias(g)
             for i, g in enumerate(_G)]
    return save(rows.select("_c", "_turn", *words, "_bytes"), "turns")



def placed(rows: DataFrame) -> DataFrame:
    """Every turn with its place ``_pos`` in its conversation of ``_n`` turns, stored."""
    # The row number makes the order total, so that equal rows may be dealt apart.
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    numbered = save(assign_ids(rows, ["_c", "_turn", *_G, "_row"], "_id").drop("_turn", "_row"), "numbered")
    first = numbered.groupBy("_c").agg(F.min("_id").alias("_f"), F.count("*").alias("_n"))
    spans = first.select("_c", "_f", "_n", F.expr(
        f"explode(sequence(_f div {BLOCK}, (_f + _n - 1) div {BLOCK}))").alias("_b"))
    return save(numbered.withColumn("_b", F.expr(f"_id div {BLOCK}")).join(spans, ["_c", "_b"]).select(
        "_c", "_b", (F.col("_id") - F.col("_f")).alias("_pos"), "_n", *_G, "_bytes"), "placed")


def _terms(batches, seed):
    bases = _bases(seed)
    for batch in batches:
        pos, arrays = _u(batch, "_pos"), list(batch.columns)
        for k, base in enumerate(bases):
            t = _reduced(mix(_u(batch, _G[k]) + U(seed))) if seed else np.ones(len(pos), dtype=U)
            arrays.append(pa.array(times(t, power(base, pos)).view(np.int64)))
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "_x1", "_x2"])


def _prefix_sums(batches):
    for batch in batches:
        out = {n: batch.column(n) for n in ("_c", "_pos", "_n", *_G, "_bytes")}
        for k in "12":
            high = _reduced(_u(batch, f"_high{k}"))
            after = _reduced(times(high, np.full(len(high), 1 << 32, dtype=U)) + _reduced(_u(batch, f"_low{k}")))
            before = _reduced(after + _P - _u(batch, f"_x{k}"))
            out |= {f"_a{k}": pa.array(after.view(np.int64)), f"_p{k}": pa.array(before.view(np.int64))}
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def prefixes(rows: DataFrame, seed: int) -> DataFrame:
    """``_c, _pos, _n, _g.., _bytes`` with the sums up to (``_a1, _a2``) and before (``_p1, _p2``) each turn."""
    schema = ", ".join(f"{n} long" for n in [*rows.columns, "_x1", "_x2"])
    terms = save(rows.mapInArrow(lambda b: _terms(b, seed), schema), "terms")
    halves = {f"_{half}{k}": e for k in "12" for half, e in (
        ("high", F.shiftright(f"_x{k}", 32)), ("low", F.col(f"_x{k}").bitwiseAND(F.lit(0xFFFFFFFF))))}
    inside = Window.partitionBy("_c", "_b").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = terms.groupBy("_c", "_b").agg(*[F.sum(e).alias(n) for n, e in halves.items()])
    carry = sums.select("_c", "_b", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before{n}") for n in halves])
    run = terms.select("*", *[F.sum(e).over(inside).alias(n) for n, e in halves.items()]).join(carry, ["_c", "_b"])
    run = run.select("_c", "_pos", "_n", *_G, "_bytes", "_x1", "_x2",
                     *[(F.col(n) + F.col(f"_before{n}")).alias(n) for n in halves])
    names = ["_c", "_pos", "_n", *_G, "_bytes", "_a1", "_p1", "_a2", "_p2"]
    return save(run.mapInArrow(_prefix_sums, ", ".join(f"{n} long" for n in names)), "prefixes")


def _head_length():
    return F.crc32(F.col("_c").cast("string").cast("binary")) % HEADS


def rebuilt(prefix: DataFrame) -> DataFrame:
    """One row per conversation: how it is put together, and the products at the seam; stored."""
    entry = F.struct("_pos", "_a1", "_a2", *_G, "_bytes")
    heads = prefix.filter(F.col("_pos") < HEADS - 1).groupBy("_c").agg(
        F.sort_array(F.collect_list(entry)).alias("_first"), F.max("_n").alias("_n"))  # at most 8 entries
    heads = save(heads, "heads")
    base = heads.select(F.col("_c").alias("_base"), F.col("_first").alias("_other"))
    rows = heads.join(base, F.col("_c") - F.col("_c") % STRIDE == F.col("_base"), "left").withColumn("_h", _head_length())
    size = F.coalesce(F.size("_other"), F.lit(0))
    rows = rows.withColumn("_hb", F.least(F.col("_h"), F.greatest(size, F.lit(0)).cast("long")))
    rows = rows.withColumn("_head", F.slice(F.coalesce("_other", F.slice("_first", 1, 0)), 1, F.col("_hb").cast("int")))
    seam = [F.coalesce(F.get(a, n.cast("int") - 1)[x], F.lit(0)).alias(f"_{s}{x[-1]}")
            for s, a, n in (("t", "_head", F.col("_hb")), ("o", "_first", F.col("_h"))) for x in ("_a1", "_a2")]
    own = F.greatest(F.col("_n") - F.col("_h"), F.lit(0))
    return save(rows.select("_c", "_n", "_h", "_hb", "_head", *seam, (F.col("_hb") + own).alias("_len")), "rebuilt")


_MEMBER = ["_c", "_depth", "_a1", "_a2", "_p1", "_p2", *_G, "_bytes"]
_MEMBER_SCHEMA = ", ".join(f"{n} long" for n in _MEMBER) + ", _ends boolean"


def _joined(batches, seed):
    """Products of the rebuilt prefixes that end in a conversation's own turns."""
    bases = _bases(seed)
    for batch in batches:
        h, hb = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("_h", "_hb"))
        depth = hb + batch.column("_pos").to_numpy(zero_copy_only=False) - h + 1
        out = {"_c": batch.column("_c"), "_depth": pa.array(depth)}
        for kind in "ap":
            for k, base in zip("12", bases, strict=True):
                inverse = pow(base, -1, PRIME)
                shift = np.array([pow(inverse, i, PRIME) for i in range(HEADS)], dtype=U)[h - hb]
                suffix = _reduced(_u(batch, f"_{kind}{k}") + _P - _u(batch, f"_o{k}"))
                out[f"_{kind}{k}"] = pa.array(_reduced(_u(batch, f"_t{k}") + times(shift, suffix)).view(np.int64))
        out |= {n: batch.column(n) for n in (*_G, "_bytes")}
        out["_ends"] = pa.array(depth == batch.column("_len").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def members(prefix: DataFrame, seam: DataFrame, seed: int) -> DataFrame:
    """One row per conversation and depth, root included; stored."""
    zero = F.lit(0).cast("long")
    blocks = seam.filter("_n > _h").drop("_head", "_n").withColumn("_last", F.col("_len") - F.col("_hb") + F.col("_h") - 1)
    blocks = blocks.select("*", F.expr(f"explode(sequence(_h div {BLOCK}, _last div {BLOCK}))").alias("_b")).drop("_last")
    own = prefix.filter(F.col("_pos") >= _head_length()).withColumn("_b", F.expr(f"_pos div {BLOCK}")).drop("_n")
    own = own.join(blocks, ["_c", "_b"]).mapInArrow(lambda b: _joined(b, seed), _MEMBER_SCHEMA)
    head = seam.select("_c", "_len", "_head", F.posexplode("_head").alias("_i", "_e"))
    before = [F.coalesce(F.get("_head", F.col("_i") - 1)[f"_a{k}"], zero).alias(f"_p{k}") for k in "12"]
    head = head.select("_c", (F.col("_i") + 1).cast("long").alias("_depth"), "_e._a1", "_e._a2", *before,
                       *[f"_e.{g}" for g in _G], "_e._bytes", (F.col("_i") + 1 == F.col("_len")).alias("_ends"))
    root = seam.select("_c", *[zero.alias(n) for n in _MEMBER[1:]], (F.col("_len") == 0).alias("_ends"))
    return save(own.union(head).union(root), "members")


def nodes(rows: DataFrame) -> DataFrame:
    """One row per group of equal fingerprints; ``_mixed`` where its members' references differ."""
    checked = ["_p1", "_p2", *_G]
    low = [F.min(n).alias(n) for n in checked]
    high = [F.max(n).alias(f"{n}_max") for n in checked]
    out = rows.groupBy("_depth", "_a1", "_a2").agg(
        F.min("_c").alias("_conv"), F.count("*").alias("_n"), F.max("_bytes").alias("_bytes"),
        F.min(F.when(F.col("_ends"), F.col("_c"))).alias("_first_end"), *low, *high)
    mixed = reduce(lambda a, b: a | b, [F.col(n) != F.col(f"{n}_max") for n in checked])
    return save(out.select("_conv", "_depth", "_a1", "_a2", "_p1", "_p2", "_n", "_first_end",
                           ((F.col("_n") - 1) * F.col("_bytes")).alias("_saved"), mixed.alias("_mixed")), "nodes")


def _chunks(batches):
    """Runs of one node's sorted ids as decimal text, ``CHUNK`` ids at most."""
    for batch in batches:
        key = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("_depth", "_a1", "_a2")]
        n = batch.num_rows
        new = np.ones(n, dtype=bool)
        new[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in key])
        cuts = np.flatnonzero(new)
        cuts = np.unique(np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(cuts, [*cuts[1:], n])] or [cuts]))
        ids = pc.cast(batch.column("_c"), pa.string()).to_pylist()
        text = [",".join(ids[a:b]).encode() for a, b in zip(cuts, [*cuts[1:], n])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(pa.array(cuts)) for c in ("_depth", "_a1", "_a2", "_c")] + [pa.array(text, pa.binary())],
            ["_depth", "_a1", "_a2", "_from", "_ids"])


def _hashed(batches):
    now, digest, out = None, None, []

    def rows(done):
        keys = list(zip(*[d[0] for d in done], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in keys] + [pa.array([d[1] for d in done])],
                                          ["_depth", "_a1", "_a2", "_sha"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("_depth", "_a1", "_a2", "_ids")), strict=True):
            if key != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids)
            else:
                digest.update(b",")
                digest.update(ids)
        if len(out) > 5000:
            yield rows(out)
            out = []
    if now is not None:
        yield rows([*out, (now, digest.hexdigest())])


def ends_digests(rows: DataFrame) -> DataFrame:
    """``_depth, _a1, _a2, _sha`` of the nodes at which conversations end."""
    key = ["_depth", "_a1", "_a2"]
    ends = save(rows.filter("_ends").select(*key, "_c"), "ends")
    chunks = ends.repartitionByRange(*key, "_c").sortWithinPartitions(*key, "_c").mapInArrow(
        _chunks, "_depth long, _a1 long, _a2 long, _from long, _ids binary")
    return chunks.repartition(*key).sortWithinPartitions(*key, "_from").mapInArrow(
        _hashed, "_depth long, _a1 long, _a2 long, _sha string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """``_conv, _saved, _leaves`` summed over each chain and all chains below it.

    ``chains``: ``_conv, _above`` (null for the root's), ``_saved, _leaves`` of the chain
    itself. Round i adds what lies 2^i chains below and doubles the distance.
    """
    state = save(chains, "chain-sums")
    while state.filter("_above is not null").limit(1).count():
        active = state.filter("_above is not null")
        gain = active.groupBy(F.col("_above").alias("_conv")).agg(F.sum("_saved").alias("_s"), F.sum("_leaves").alias("_l"))
        up = state.filter("_above is not null").select(F.col("_conv").alias("_above"), F.col("_above").alias("_next"))
        up = lookup_join(active.select("_conv", "_above"), up, ["_above"]).select("_conv", "_next")
        zero = F.lit(0)
        state = save(state.join(gain, "_conv", "left").join(up, "_conv", "left").select(
            "_conv", F.col("_next").alias("_above"), (F.col("_saved") + F.coalesce("_s", zero)).alias("_saved"),
            (F.col("_leaves") + F.coalesce("_l", zero)).alias("_leaves")), "chain-sums")
    return state.select("_conv", "_saved", "_leaves")


def _below(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_saved`` and ``_leaves`` summed from each node to its chain's end."""
    rows = save(rows.withColumn("_b", F.expr(f"_depth div {BLOCK}")), "chain-nodes")
    inside = Window.partitionBy("_conv", "_b").orderBy(F.desc("_depth")).rowsBetween(Window.unboundedPreceding, 0)
    deeper = Window.partitionBy("_conv").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_conv", "_b").agg(F.sum("_saved").alias("_s"), F.sum("_leaves").alias("_l"))
    tail = sums.select("_conv", "_b", *[F.coalesce(F.sum(n).over(deeper), F.lit(0)).alias(n) for n in ("_s", "_l")])
    out = rows.withColumns({n: F.sum(n).over(inside) for n in ("_saved", "_leaves")}).join(tail, ["_conv", "_b"])
    return out.withColumns({"_saved": F.col("_saved") + F.col("_s"), "_leaves": F.col("_leaves") + F.col("_l")})


def prefix_trie(conversations: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``."""
    rows = placed(turns(conversations))
    for seed in seeds:
        prefix = prefixes(rows, seed)
        members_ = members(prefix, rebuilt(prefix), seed)
        found = nodes(members_)
        if not found.filter("_mixed").limit(1).count():
            break
    else:
        raise ArithmeticError("fingerprints of different prefixes collide for every seed")
    key, zero = ["_depth", "_a1", "_a2"], F.lit(0)
    start = found.groupBy("_conv").agg(F.min(F.struct("_depth", "_p1", "_p2")).alias("s")).select(
        "_conv", F.col("s._depth").alias("_start"), (F.col("s._depth") - 1).alias("_depth"),
        F.col("s._p1").alias("_a1"), F.col("s._p2").alias("_a2"))
    above = found.select(F.col("_conv").alias("_above"), *key)
    chains = save(lookup_join(save(start, "starts"), above, key, "left").select(
        "_conv", "_above", "_start"), "chains")
    here = chains.filter("_above is not null").groupBy(
        F.col("_above").alias("_conv"), (F.col("_start") - 1).alias("_depth")).agg(F.count("*").alias("_chains"))
    first = chains.select("_conv", F.col("_start").alias("_depth"), "_above", F.lit(True).alias("_is_start"))
    goes_on = (F.col("_first_end").isNull() | (F.col("_first_end") > F.col("_conv"))).cast("long")
    place = ["_conv", "_depth"]
    linked = found.join(here, place, "left").join(first, place, "left").withColumn(
        "_children", F.coalesce("_chains", zero) + goes_on)
    linked = save(linked.select(*place, "_a1", "_a2", "_n", "_saved", "_children",
                                F.when(F.col("_is_start"), F.col("_above")).otherwise(F.col("_conv")).alias("_parent"),
                                (F.col("_children") == 0).cast("long").alias("_leaves")), "linked")
    own = linked.groupBy("_conv").agg(F.sum("_saved").alias("_saved"), F.sum("_leaves").alias("_leaves"))
    total = chain_totals(chains.select("_conv", "_above").join(own, "_conv"))
    hung = chains.filter("_above is not null").join(total, "_conv").groupBy(
        F.col("_above").alias("_conv"), (F.col("_start") - 1).alias("_depth")).agg(
        F.sum("_saved").alias("_s"), F.sum("_leaves").alias("_l"))
    summed = _below(linked.join(hung, place, "left").withColumns({
        "_saved": F.col("_saved") + F.coalesce("_s", zero), "_leaves": F.col("_leaves") + F.coalesce("_l", zero)}
    ).drop("_s", "_l"))
    return summed.join(ends_digests(members_), key, "left").select(
        F.col("_conv").alias("conv_id"), F.col("_depth").alias("depth"), F.col("_parent").alias("parent_conv_id"),
        F.col("_n").alias("n_convs"), F.col("_children").alias("n_children"), F.col("_leaves").alias("n_leaves"),
        F.col("_saved").alias("saved_tokens"), F.coalesce("_sha", F.lit(EMPTY)).alias("ends_sha256"))
