"""Combine records of several sources so that each contributes a target share of the total size.

Method: *multivariate-hypergeometric splitting tree*. Quotas are exact: how often each source is
used whole, and up to which place of its random permutation once more. The permuted copies of a
source are cut into blocks; a tree over the output shards divides the numbers of blocks of all
sources by multivariate-hypergeometric draws, so every shard gets the mixture that drawing
without replacement would give it; the shards then take disjoint runs of permuted blocks and
order their records by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pigmenta.session import cut_lineage

TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


@dataclass
class MixSettings:
    """Parameters; the defaults are those of production."""

    shards: int = 16
    block: int = 16  # copies in a block
    seed: int = 7
    bits: int = 12  # of the permutation that a step of the search for a quota's place decides
    bucket_rows: int = 50_000  # records that are ranked together
    total_tokens: int | None = None  # the largest total that meets all shares, if not given


def tokens_of(text: str = "text") -> F.Column:
    """Size of a text in tokens by rule: runs of letters, digits and underscores, and single other characters."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def public_tokens(documents: DataFrame, path: str) -> DataFrame:
    """Adds ``n_tokens`` by a public tokenizer: the file of a vocabulary for the tokenizers library."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            sizes = [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            yield pd.Series([None if t is None else n for t, n in zip(texts, sizes, strict=True)], dtype=object)

    return documents.withColumn("n_tokens", count("text"))


def quotas(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None) -> dict[str, float]:
    """Tokens that each source is to give.

    Shares of sources that have nothing are divided among the others in proportion. Without a
    total it is the largest at which every source can give its share; with one, sources that
    can't give theirs give all they may and the rest is divided among the others.
    """
    limit = {s: sizes.get(s, 0) * repeats for s, (_, repeats) in targets.items()}
    share = {s: w for s, (w, _) in targets.items() if w > 0 and limit[s] > 0}
    if not share:
        return {}
    whole = sum(share.values())
    share = {s: w / whole for s, w in share.items()}
    if total is None:
        total = min(limit[s] / w for s, w in share.items())
        return {s: total * w for s, w in share.items()}
    out: dict[str, float] = {}
    open_ = dict(share)
    left = float(total)
    while open_:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / weight >= limit[s]]
        if not full:
            out |= {s: left * w / weight for s, w in open_.items()}
            break
        for s in full:
            out[s] = float(limit[s])
        left -= sum(limit[s] for s in full)
        for s in full:
            del open_[s]
        if left <= 0:
            out |= dict.fromkeys(open_, 0.0)
            break
    return out


MOST_BLOCKS = 500_000_000  # of all sources together: what hypergeometric draws take


def block_size(copies: int, settings: MixSettings) -> int:
    """Copies in a block: ``block``, or as many as it takes that there are no more than MOST_BLOCKS blocks."""
    return max(settings.block, -(-copies // MOST_BLOCKS))


def splitting_tree(blocks: dict[str, int], shards: int, seed: int) -> dict[str, list[int]]:
    """How many blocks of each source each shard gets; sums over shards are exact."""
    names = sorted(blocks)
    out: dict[str, list[int]] = {s: [0] * shards for s in names}

    def split(first: int, count: int, have: np.ndarray) -> None:
        if count == 1:
            for s, n in zip(names, have, strict=True):
                out[s][first] = int(n)
            return
        left = count // 2
        rng = np.random.default_rng([seed, first, count])
        total = int(have.sum())
        take = total * left // count + int(rng.random() < (total * left % count) / count)
        got = np.zeros_like(have)
        rest = total
        for i, n in enumerate(have):  # the draw for one source after the other, by its marginal
            rest -= int(n)
            got[i] = rng.hypergeometric(int(n), rest, take) if take and n else 0
            take -= int(got[i])
        split(first, left, got)
        split(first + left, count - left, have - got)

    split(0, shards, np.array([blocks[s] for s in names], dtype=np.int64))
    return out


def _places(rows: DataFrame, rest: dict[str, float], settings: MixSettings) -> dict[str, int]:
    """For each source the place in the permutation up to which tokens come nearest to ``rest``.

    A histogram of the leading bits finds the bucket in which the place lies, further ones find
    it inside; sources and buckets are few, whatever the number of records.
    """
    spark = rows.sparkSession
    low = dict.fromkeys(rest, 0)
    need = dict(rest)
    width = 62
    while width > 0 and low:
        step = min(settings.bits, width)
        width -= step
        where = spark.createDataFrame([(s, low[s]) for s in low], "source string, low long")
        inside = rows.join(F.broadcast(where), "source").filter(F.shiftright(F.col("place"), width + step) == F.shiftright(F.col("low"), width + step))
        counted = inside.groupBy("source", (F.shiftright(F.col("place"), width) % (1 << step)).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()
        single = True
        for s in low:
            for r in sorted((r for r in counted if r["source"] == s), key=lambda r: r["bucket"]):
                if r["tokens"] >= need[s]:
                    low[s] += r["bucket"] << width
                    if r["n"] > 1:
                        single = False
                    elif need[s] * 2 >= r["tokens"]:
                        low[s] += 1 << width  # the record that straddles the quota is nearer in than out
                        need[s] = 0
                    break
                need[s] -= r["tokens"]
            else:
                low[s] += 1 << (width + step)
                need[s] = 0
        if single:
            break
    return low


PLAN = "doc_id, source, n_tokens, copy_no, shard, order_key"


def mixture(documents: DataFrame, targets: DataFrame, settings: MixSettings | None = None) -> DataFrame:
    """doc_id, source, n_tokens, copy_no, shard, order_key: one row for each time a record is used.

    ``documents``: doc_id, source, n_tokens (text, for records whose n_tokens is null).
    ``targets``: source, target_share, max_repeats. Records without a source, of a source that
    isn't listed or without tokens take no part; a source listed twice counts with its first row
    by order of share. Records are used as often as their source's quota says, in whole rounds
    and one round up to a place of the permutation, so counts of two records of a source differ
    by one at most and no quota is missed by more than a record. The same seed gives the same
    mixture. Nothing to mix gives an empty result.
    """
    settings = settings or MixSettings()
    spark = documents.sparkSession
    tokens = F.coalesce("n_tokens", tokens_of("text").cast("long")) if "text" in documents.columns else F.col("n_tokens")
    rows = documents.select("doc_id", "source", tokens.alias("n_tokens")).filter("source is not null and n_tokens > 0")
    rows = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(settings.seed), "source", "doc_id"), 2))
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.filter("source is not null and target_share > 0 and max_repeats > 0").orderBy("source", "target_share", "max_repeats").collect():
        wanted.setdefault(r["source"], (r["target_share"], r["max_repeats"]))
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    rows = cut_lineage(rows.join(F.broadcast(names), "source"))  # narrow; read once for each step of the search
    sizes = {r["source"]: (r["tokens"], r["n"]) for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    give = {s: q for s, q in quotas({s: t for s, (t, _) in sizes.items()}, wanted, settings.total_tokens).items() if q > 0}
    empty = rows.select("doc_id", "source", "n_tokens", F.lit(0).alias("copy_no"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("order_key")).limit(0)
    if not give:
        return empty
    rounds = {s: min(int(q // sizes[s][0]), wanted[s][1]) for s, q in give.items()}
    rest = {s: q - rounds[s] * sizes[s][0] for s, q in give.items() if rounds[s] < wanted[s][1]}
    place = _places(rows.select("source", "place", "n_tokens"), rest, settings)
    plan = spark.createDataFrame([(s, rounds[s], place.get(s, 0), 1 + sizes[s][1] // settings.bucket_rows) for s in give], "source string, rounds int, upto long, buckets long")
    used = rows.join(F.broadcast(plan), "source").withColumn("copies", F.col("rounds") + (F.col("place") < F.col("upto")).cast("int")).filter("copies > 0")
    # Positions of copies in the permuted order of their source: buckets of it are ranked apart.
    used = cut_lineage(used.withColumn("bucket", (F.col("place") / F.lit(float(1 << 62)) * F.col("buckets")).cast("long")).select("doc_id", "source", "n_tokens", "place", "copies", "bucket"))
    counts = used.groupBy("source", "bucket").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = used.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(offsets, ["source", "bucket"])
    copies = placed.select("doc_id", "source", "n_tokens", (F.col("first") + F.col("offset")).alias("first"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    totals = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    size = block_size(sum(totals.values()), settings)
    blocks = {s: -(-n // size) for s, n in totals.items()}
    shares = splitting_tree(blocks, settings.shards, settings.seed)
    # Disjoint runs of permuted blocks: block b stands at (b * factor + shift) mod blocks.
    ranges = []
    for s, n in blocks.items():
        rng = np.random.default_rng([settings.seed, n])
        factor = next(f for f in (int(rng.integers(1, n + 1)) for _ in iter(int, 1)) if np.gcd(f, n) == 1)
        bounds = np.concatenate([[0], np.cumsum(shares[s])])
        ranges.append((s, n, factor, int(rng.integers(0, n)), [int(b) for b in bounds[1:]]))
    runs = spark.createDataFrame(ranges, "source string, blocks long, factor long, shift long, bounds array<long>")
    block = F.floor((F.col("first") + F.col("copy_no") - 1) / size)
    seat = ((block * F.col("factor").cast("decimal(38,0)") + F.col("shift")) % F.col("blocks")).cast("long")
    return copies.join(F.broadcast(runs), "source").select(
        "doc_id",
        "source",
        "n_tokens",
        "copy_no",
        F.size(F.filter("bounds", lambda b: b <= seat)).alias("shard"),
        F.xxhash64(F.lit(settings.seed + 1), "doc_id", "copy_no").alias("order_key"),
    )


def write_shards(mixed: DataFrame, path: str) -> None:
    """The mixture as files by shard, each in its random order."""
    mixed.repartition("shard").sortWithinPartitions("shard", "order_key", "doc_id", "copy_no").write.partitionBy("shard").mode("overwrite").parquet(path)


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a listed source: target_share, share_reached, tokens, documents, copies, most_copies.

    A source without records has a share of 0.
    """
    by_doc = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    by_source = by_doc.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.sum("n").alias("copies"), F.max("n").cast("int").alias("most_copies")
    )
    total = by_source.agg(F.sum("tokens").alias("total"))
    listed = targets.filter("source is not null").groupBy("source").agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    return (
        listed.join(by_source, "source", "left")
        .crossJoin(total)  # one row
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce(F.round(F.col("tokens") / F.col("total"), 6), F.lit(0.0)).alias("share_reached"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("copies", F.lit(0)).alias("copies"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )
